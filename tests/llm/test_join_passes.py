"""The passes of the Jaccard join over the texts: sets are made once for the hubs and the join with them."""

import re

import numpy as np
import pyarrow as pa

from tersa.llm import blocks, jaccard_join


def test_prefixes_are_made_once(spark, monkeypatch):
    plans, plain = [], jaccard_join.written

    def seen(df, tag, *spent):
        if tag == "fronts":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, tag, *spent)

    monkeypatch.setattr(jaccard_join, "written", seen)
    base = " ".join(f"w{k}" for k in range(60))
    texts = [*(f"{base} {i}" for i in range(20)), *(f"alone{i} a b c d" for i in range(10)), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs, 4, 85).collect()}
    assert found == {i: (58, 0) if i < 20 else (2, i) if i < 30 else (0, i) for i in range(32)}
    assert len(plans) == 1 and "ReusedExchange" in plans[0].split("== Initial Plan ==")[0]


def test_words_are_runs_of_bytes():
    texts = [bytes([c]) + b"Az" for c in range(256)] + [b"", b" \t", b"A\xc3\x89 b\nC", None]
    for lower in (False, True):
        words = blocks.Words(pa.array(texts, pa.binary()), lower=lower)
        spelled = [re.findall(rb"[^\x20\x09-\x0D]+", t or b"") for t in texts]
        assert words.count.tolist() == [len(x) for x in spelled]
        flat = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) if lower else w for x in spelled for w in x]
        names = {}
        assert all(names.setdefault(h, w) == w for h, w in zip(words.hash.tolist(), flat, strict=True)) and len(names) == len(set(flat))


def test_distinct_values():
    for values in ([], [3], [2, 2], [5, 1, 5, 2**64 - 1, 0, 1]):
        x = np.array(values, dtype=np.uint64)
        assert blocks.distinct(x).tolist() == sorted(set(values)) and x.tolist() == values
