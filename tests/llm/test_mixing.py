import hashlib
from collections import defaultdict
from fractions import Fraction

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tersa.llm import mixing

from .conftest import EDGES


def level(caps, weights, budget):
    """Real-valued shares by raising a common level until the budget is spent."""
    share, open_ = [Fraction(0)] * len(caps), [i for i, w in enumerate(weights) if w]
    left = Fraction(budget)
    while open_ and left > 0:
        per = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if share[i] + per * weights[i] >= caps[i]]
        if not full:
            for i in open_:
                share[i] += per * weights[i]
            break
        for i in full:
            left -= caps[i] - share[i]
            share[i] = Fraction(caps[i])
            open_.remove(i)
        # Those that remain start again from the level of nobody full.
        for i in open_:
            left += share[i]
            share[i] = Fraction(0)
    return share


NODE = st.lists(st.tuples(st.integers(0, 50), st.integers(0, 5)), min_size=1, max_size=7)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(NODE, st.integers(0, 150)), min_size=1, max_size=12))
def test_fill_against_a_rising_level(spark, families):
    rows = [(f"f{k}", f"n{i}", cap, w, budget) for k, (nodes, budget) in enumerate(families) for i, (cap, w) in enumerate(nodes)]
    nodes = spark.createDataFrame(rows, "family string, name string, cap long, weight long, budget long")
    got = {(r.family, r["name"]): r.share for r in mixing.fill(nodes, ["family"], "name").collect()}
    for k, (pairs, budget) in enumerate(families):
        caps, weights = zip(*pairs, strict=True)
        want = level(caps, weights, budget)
        mine = [got[f"f{k}", f"n{i}"] for i in range(len(pairs))]
        assert sum(mine) == min(budget, sum(c for c, w in pairs if w))
        assert all(0 <= m <= c and abs(m - x) <= 1 for m, c, x in zip(mine, caps, want, strict=True))


def test_prefixes_against_a_loop(docs_of):
    rows = [(i, "w " * (i * 7 % 23), "en" if i % 3 else "fr", f"s{i % 2}", 0) for i in range(400)]
    docs = docs_of(rows, extra=("domain", "share", "key", "g", "cap", "weight", "budget"))
    chosen, leaves = mixing.mix(docs, budget=3000, max_epochs=3, weights={("x", "fr"): 9, ("x", "*", "s1"): 2}, domain=F.lit("x"))
    got, total = defaultdict(list), 0
    for r in chosen.collect():
        got[r.lang, r.source].append((r.epoch, r.order_key, r.doc.doc_id))
        assert r.doc.text == rows[r.doc.doc_id][1]
    for leaf in leaves.collect():
        own = [r for r in rows if (r[2], r[3]) == (leaf.lang, leaf.source)]
        want, epoch, left = [], 0, leaf.share
        total += leaf.share
        while left > 0:
            tokens = 0
            key = lambda r: hashlib.md5(f"17:{epoch}:{r[0]}".encode()).hexdigest()  # noqa: B023, E731
            for r in sorted(own, key=key):
                if tokens < left or left >= leaf.tokens:
                    want.append((epoch, key(r), r[0]))
                tokens += len(r[1].split())
            left, epoch = left - min(left, tokens), epoch + 1
        assert sorted(got[leaf.lang, leaf.source]) == sorted(want)
    assert total == 3000


def test_joins_instead_of_broadcasts(docs_of, monkeypatch):
    rows = [(i, "some words here", "en", f"s{i % 4}", 0) for i in range(50)]
    want = sorted(mixing.mix(docs_of(rows))[0].select("doc.doc_id", "epoch").collect())
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    assert sorted(mixing.mix(docs_of(rows))[0].select("doc.doc_id", "epoch").collect()) == want
    assert len(want) >= 50


def test_edges(edges, docs_of):
    chosen, leaves = mixing.mix(edges, max_epochs=1)
    words = sum(len((e[1] or "").encode().split()) for e in EDGES)
    assert sum(r.share for r in leaves.collect()) == words
    assert {r.doc.doc_id for r in chosen.collect()} >= {5, 9, 12}
    assert mixing.mix(docs_of([]))[0].count() == 0
    assert mixing.mix(docs_of([(1, None), (2, "")]))[0].count() == 0


def test_no_budget_is_lost_under_a_weight_of_zero(docs_of):
    rows = [(1, "w " * 1000, "en", "a", 0), (2, "w " * 100, "fr", "a", 0), (3, "w " * 1000, "fr", "b", 0)]
    domain = F.col("source")
    _, leaves = mixing.mix(docs_of(rows), budget=600, max_epochs=1, weights={("a", "en"): 0}, domain=domain)
    assert {(r.domain, r.lang): r.share for r in leaves.collect()} == {("a", "en"): 0, ("a", "fr"): 100, ("b", "fr"): 500}
    _, leaves = mixing.mix(docs_of(rows), budget=600, max_epochs=1, weights={("b",): 0, ("a", "*", "a"): 0}, domain=domain)
    assert sum(r.share for r in leaves.collect()) == 0


def test_rows_without_an_id_or_with_one_id_are_single_documents(docs_of):
    rows = [(None, "w " * 10)] * 50 + [(i, "w " * 10) for i in range(50)] + [(99, "x " * 10)] * 30
    for budget in (100, 595, 1300, 1999):
        chosen, _ = mixing.mix(docs_of(rows), budget=budget, seed=7)
        taken = chosen.collect()
        assert budget <= sum(r.n_tokens for r in taken) < budget + 10
        assert len({(r.epoch, r.order_key) for r in taken}) == len(taken)
