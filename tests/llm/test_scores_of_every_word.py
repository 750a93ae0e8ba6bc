import math
from collections import Counter

import pytest

from tersa.llm import blocks, lm_scoring

from .test_dedup_and_scoring import LOWER, WORD, corpus


def loop(rows, target):
    """Target and background loss of each document, with every word and every bigram."""
    split = {d: WORD.findall(t.translate(LOWER)) for d, t in rows}
    uni, bi, history = ([Counter(), Counter()] for _ in range(3))
    for d, ws in split.items():
        m = d not in target
        uni[m].update(ws)
        bi[m].update(zip([None, *ws], ws))
        history[m].update([None, *ws] if ws else [])
    symbols = len(uni[0] | uni[1]) + 1
    out = {}
    for d, ws in split.items():
        loss = [0.0, 0.0]
        for a, b in zip([None, *ws], ws):
            for m in (0, 1):
                plain = (uni[m][b] + 0.5) / (sum(uni[m].values()) + 0.5 * symbols)
                loss[m] -= math.log(0.6 * bi[m][a, b] / history[m][a] + 0.4 * plain if history[m][a] else plain)
        out[d] = [x / max(1, len(ws)) for x in loss]
    return out


@pytest.mark.parametrize("size", [4 << 20, 1])
def test_every_word_and_bigram_counts(docs_of, spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
    rows = corpus(n=120)
    # More words than the former vocabulary, each in one document: those past it were one symbol.
    rows += [(5000 + k, " ".join(f"rare{k}x{i}" for i in range(12_000))) for k in range(4)] + [(6000, "")]
    target = {d for d, _ in rows if d % 4 == 0}
    frame = spark.createDataFrame([(d,) for d in target], "doc_id long")
    got = {r.doc_id: r for r in lm_scoring.score(docs_of(rows).repartition(4), frame).collect()}
    want = loop(rows, target)
    assert set(got) == set(want)
    for d, (t, b) in want.items():
        assert math.isclose(got[d].target_loss, t, abs_tol=1e-9) and math.isclose(got[d].background_loss, b, abs_tol=1e-9)


def test_a_document_is_left_out_of_its_own_model(docs_of, spark):
    rows = [*corpus(n=60), (6000, ""), (6001, None), (6002, "alone"), (6003, "twice the same twice the same"), (6004, "twice the same twice the same")]
    target = {d for d, _ in rows if d % 4 == 0}
    frame = spark.createDataFrame([(d,) for d in target], "doc_id long")
    got = {r.doc_id: r for r in lm_scoring.score(docs_of(rows, extra=("key", "n")).repartition(3), frame, leave_out=True).collect()}
    symbols = len({w for _, t in rows for w in WORD.findall((t or "").translate(LOWER))}) + 1
    for d, text in rows:
        ws, loss = WORD.findall((text or "").translate(LOWER)), []
        for m in (True, False):
            uni, bi, history = Counter(), Counter(), Counter()
            for e, t in rows:
                if e != d and (e in target) == m:
                    w = WORD.findall((t or "").translate(LOWER))
                    uni.update(w)
                    bi.update(zip([None, *w], w))
                    history.update([None, *w] if w else [])
            total = 0.0
            for a, b in zip([None, *ws], ws):
                plain = (uni[b] + 0.5) / (sum(uni.values()) + 0.5 * symbols)
                total -= math.log(0.6 * bi[a, b] / history[a] + 0.4 * plain if history[a] else plain)
            loss.append(total / max(1, len(ws)))
        assert math.isclose(got[d].target_loss, loss[0], abs_tol=1e-9) and math.isclose(got[d].background_loss, loss[1], abs_tol=1e-9)
        assert math.isclose(got[d].difference, loss[0] - loss[1], abs_tol=1e-9)
