import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tersa.llm import packing, token_output
from tersa.llm.tokens import default_tokenizer, encoder

from .conftest import EDGES

ENC = encoder(default_tokenizer())


def ids(text):
    raw = np.frombuffer(ENC.whole(text or ""), ENC.dtype).tolist()
    return [*raw, 1]


def crc(x):
    return zlib.crc32(np.array(x, dtype="<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x250), max_size=60) | st.text(max_size=20))
def test_word_cache_equals_the_library(text):
    assert ENC(text) == ENC.whole(text)


def test_word_cache_on_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    for r in rows:
        assert ENC(r.text) == ENC.whole(r.text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700))
def test_elias_fano_select(values):
    values = sorted(values)
    packed = token_output.EliasFano(memoryview(token_output.ef_pack(np.array(values, dtype=np.uint64))))
    assert packed.all().tolist() == values
    assert [packed[i] for i in range(len(values))] == values


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 50_000))
    assert len(token_output.ef_pack(ends)) < 50_000 * 2


def test_write_and_index(edges):
    got = sorted(
        ((r.start, r.n_tokens, -1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in token_output.write_and_index(edges).collect())
    )
    want, at = [], 0
    for doc, text in sorted(((-1 if e[0] is None else e[0], e[1]) for e in EDGES), key=lambda x: x[0]):
        x = ids(text)
        want.append((at, len(x), doc, crc(x)))
        at += len(x)
    assert got == want


def test_segments_round_trip(spark, docs_of, tmp_path):
    docs = docs_of([(i * 3 - 20, f"text number {i} " * (i % 7)) for i in range(200)])
    token_output.write_ids(docs, f"file://{tmp_path}/ids")
    found = {}
    for r in token_output.read_ids(spark, f"file://{tmp_path}/ids").collect():
        s = token_output.Segment(r.payload)
        found |= {d: s.document(i).tolist() for i, d in enumerate(s.doc_ids)}
    assert found == {i * 3 - 20: ids(f"text number {i} " * (i % 7)) for i in range(200)}


def checked(rows, capacity):
    """Every sequence is gapless from 0 and within capacity; returns the number of sequences."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_pack_edges(edges):
    rows = packing.pack(edges, capacity=64, with_ids=True).collect()
    assert checked(rows, 64) >= sum(len(ids(e[1])) for e in EDGES) / 64
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for doc, text in {(e[0], e[1]) for e in EDGES}:
        whole, parts = ids(text), sorted(by_doc[doc], key=lambda r: (r.piece, r.offset))
        if doc == 5:
            parts = parts[:: 2] if len(parts) == 2 else parts
        assert [r.start for r in parts] == list(range(0, len(whole), 64))
        assert [x for r in parts for x in np.frombuffer(r.ids, ENC.dtype).tolist()] == whole
        assert all(r.ids_crc32 == crc(whole[r.start : r.start + r.length]) for r in parts)


def test_empty_tables(docs_of):
    assert packing.pack(docs_of([])).count() == 0
    assert token_output.write_and_index(docs_of([])).count() == 0


def fewest(lengths, capacity):
    """The least number of bins, by exhaustive search."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for room in sorted({b for b in bins if b >= lengths[i]}):
            rest = list(bins)
            rest.remove(room)
            go(i + 1, [*rest, room - lengths[i]])
        go(i + 1, [*bins, capacity - lengths[i]])

    go(0, [])
    return best[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_dominance_keeps_the_optimum(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    fixed, left = packing.dominant_sets(counts, 20)
    rest = [n for n, c in left.items() for _ in range(c)]
    assert sum(t for t, _ in fixed) + fewest(rest, 20) == fewest(lengths, 20)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
def test_solve_places_every_piece(counts):
    patterns = packing.solve(counts, 50)
    placed = defaultdict(int)
    for times, items in patterns:
        assert times > 0 and sum(n * k for n, k in items) <= 50
        for n, k in items:
            placed[n] += times * k
    assert placed == counts
    n = sum(t for t, _ in patterns)
    total = sum(n * c for n, c in counts.items())
    assert n <= 1 + total * 11 / 9 / 50 + 1 or n <= 1 + 2 * total / 50


def test_ids_that_are_null_or_one_fill_several_shards(docs_of):
    for same in (None, 7):
        rows = [(same, f"text {i} of many") for i in range(200)] + [(-1, "first"), (9, "last")]
        got = sorted(token_output.write_and_index(docs_of(rows)).collect(), key=lambda r: r.start)
        assert len({r.shard for r in got if r.doc_id == same}) > 4
        assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
        known = [r.doc_id for r in got if r.doc_id is not None]
        assert known == sorted(known) and [r.doc_id for r in got].index(-1) == (0 if same else 200)
