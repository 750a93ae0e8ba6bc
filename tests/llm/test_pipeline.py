import random
import shutil
from collections import defaultdict
from pathlib import Path

import corpus_pipeline
from tersa.llm.common import shared_dir
from tersa.llm.tokens import default_tokenizer, encoder

from .test_dedup_and_scoring import brute_lines, jaccard_classes
from .test_quality_rules import brute
from .test_tokens_and_binary import checked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, note string"


def table(n=150):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    common = "Subscribe to the newsletter and accept the terms of this site"
    out = [(-1, None, None, None, None, "x"), (-2, "", "en", "s0", 0, "x"), (-3, "too short", "en", "s1", 9, None)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.2 and i:
            text = out[rng.randrange(3, len(out))][1]
        elif kind < 0.4 and i:
            w = out[rng.randrange(3, len(out))][1].split(" ")
            w[rng.randrange(len(w))] = word()
            text = " ".join(w)
        else:
            text = "\n".join(" ".join(word() for _ in range(40)) for _ in range(rng.randrange(1, 4)))
        if i % 3 == 0 and common not in text:
            text += "\n" + common
        out.append((i, text, rng.choice(["en", "fr"]), f"s{i % 3}", len(text), "x"))
    return out


def test_stages_against_brute_force(spark, tmp_path):
    rows = table()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, d = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, d)
        if k < 4:
            assert made.columns == docs.columns
        made.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
    clean = {w[0]: w[9] for w in brute([(r[0], r[1], r[3]) for r in rows], 20, 10) if w[7]}
    assert {r.doc_id: r.text for r in seen[0]} == clean and len(clean) < len(rows)
    gone, _ = brute_lines(sorted(clean.items()), 80)
    left = {}
    for doc, text in clean.items():
        kept = "\n".join(x for p, x in enumerate(text.split("\n")) if (doc, p) not in gone)
        if kept.split():
            left[doc] = kept
    assert {r.doc_id: r.text for r in seen[1]} == left and len(left) < len(clean)
    classes = jaccard_classes(sorted(left.items()), 5, 80)
    stay = {c for _, c in classes.values()}
    assert {r.doc_id: r.text for r in seen[2]} == {x: left[x] for x in stay}
    words = {x: len(left[x].encode().split()) for x in stay}
    times = defaultdict(int)
    for r in seen[3]:
        assert r.text == left[r.doc_id] and r.n_chars == len(r.text)
        times[r.doc_id] += 1
    assert max(times.values()) <= 2 and set(times) <= stay
    total = sum(words[x] * n for x, n in times.items())
    assert sum(words.values()) <= total + max(words.values()) * 6 and total <= sum(words.values()) + max(words.values()) * 6
    enc = encoder(default_tokenizer())
    want = sum(len(enc.whole(r.text)) // enc.dtype.itemsize + 1 for r in seen[3])
    assert sum(r.length for r in seen[4]) == want
    n = checked(seen[4], 4096)
    assert -(-want // 4096) <= n <= -(-want // 4096) + 1
    assert corpus_pipeline.run(spark, d).count() == len(seen[4])


def test_pipeline_of_nothing_and_of_hard_rows(spark, tmp_path):
    """An empty table; then nulls in every column, a repeated row, a very long text and columns with the names that stages use."""
    wide = SCHEMA + ", root string, key string, hub string, doc string, block string, n string"
    long_text = " ".join(f"word{i * 7919 % 100_003}" for i in range(60_000))
    clean = [(i, f"document {i} has these {i * 31} words and those {i * 17} and no others {i} at all", "en", "a", 60, "x", *"abcdef") for i in range(12)]
    rows = [(None,) * 12, (1, None, *[None] * 10), clean[0], *clean, (99, long_text, "en", None, len(long_text), None, *"abcdef")]
    for name, table_ in (("none", []), ("hard", rows)):
        for folder in (Path(shared_dir(spark).removeprefix("file://")) / "tersa").glob("*"):
            shutil.rmtree(folder)
        spark.createDataFrame(table_, wide).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        left = {p.name.rpartition("-")[0] for p in (Path(shared_dir(spark).removeprefix("file://")) / "tersa").iterdir()}
        assert left <= {"stage-mixing", "pieces"}
        assert {r.doc_id for r in got} == ({*range(12), 99} if table_ else set())
