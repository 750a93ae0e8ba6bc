import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tersa.llm import fingerprints as fp

from .conftest import EDGES

SETS = st.lists(st.tuples(st.sets(st.integers(0, 300), max_size=90), st.sets(st.integers(0, 300), max_size=90)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(SETS)
def test_peeling_recovers_the_differences(pairs):
    a, b = [list(x) for x, _ in pairs], [list(y) for _, y in pairs]
    only_a, only_b = fp.differences(fp.keyed(a), fp.keyed(b), len(pairs))
    assert only_a.tolist() == [len(x - y) for x, y in pairs]
    assert only_b.tolist() == [len(y - x) for x, y in pairs]
    want = [len(x & y) / len(x | y) if x | y else 1.0 for x, y in pairs]
    assert np.allclose(fp.likeness(a, b), want)


def test_peel_returns_the_digests_themselves():
    a, b = [[11, 12, 13, 99]], [[12, 13, 77]]
    doc, digest, side, empty = fp.peel(fp.subtract(fp.sketch(fp.keyed(a), 1, 48), fp.sketch(fp.keyed(b), 1, 48)))
    assert empty.all() and set(zip(digest.tolist(), side.tolist())) == {(11, 1), (99, 1), (77, -1)}


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for i, (doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        sets = [set(fp.paragraph_digests(x)) for x in (text, changed, following)]
        near = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), *near))
    return out


def key(r):
    return tuple(map(str, r))


def check(docs, rows):
    got = fp.fingerprint(docs).collect()
    mine = [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got]
    assert sorted(mine, key=key) == sorted(brute(rows), key=key)
    return got


def test_edges(edges):
    check(edges, [(e[0], e[1]) for e in EDGES])


def test_many_ranges(docs_of):
    rows = [(i * 7 % 1009, f"Part {i % 5}. Next {i % 11}! And {i}?\nline {i % 3}" * (i % 4)) for i in range(1009)]
    got = check(docs_of(rows), rows)
    by_text = {}
    texts = dict(rows)
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_one_and_none(docs_of):
    check(docs_of([(4, "alone. by itself")]), [(4, "alone. by itself")])
    assert fp.fingerprint(docs_of([])).count() == 0


def test_marks_are_read():
    for text, other in (("!!!", ""), ("...abc", "abc"), ("a. ?? b", "a. b")):
        assert set(fp.paragraph_digests(text)) != set(fp.paragraph_digests(other))


def test_a_false_peel_is_tried_again(monkeypatch):
    """Checks of one bit let cells of several digests pass for one; the numbers of both sides tell."""
    monkeypatch.setattr(fp, "_check", lambda digest: (digest & np.uint64(1)).astype(np.uint32))
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = ([int(x) for x in np.unique(rng.integers(0, 4000, 40))] for _ in range(2))
        near = fp.likeness([a], [b])[0]
        assert 0 <= near <= 1


def test_recovered_digests_are_returned(docs_of):
    rows = [(1, "one. two. three. four."), (2, "five. six.")]
    got = {r.doc_id: r for r in fp.fingerprint(docs_of(rows)).collect()}
    signed = lambda texts: sorted(np.array([fp.paragraph_digests(t)[0] for t in texts], dtype=np.uint64).view(np.int64).tolist())
    text = fp.edited(rows[0][1], rows[1][1])
    own, new = ({x for x in fp.paragraph_digests(t)} for t in (rows[0][1], text))
    number = lambda x: sorted(np.array(sorted(x), dtype=np.uint64).view(np.int64).tolist())
    assert sorted(got[1].lost) == number(own - new) and sorted(got[1].gained) == number(new - own) and got[1].lost
    assert signed(["one."])[0] not in got[1].lost


def test_many_rows_without_an_id_or_with_one(docs_of):
    for same in (None, 7):
        rows = [(same, f"Text {i}. Of {i * i}.") for i in range(200)] + [(i, "some. other.") for i in range(3)]
        got = fp.fingerprint(docs_of(rows)).collect()
        assert sorted(r.n_chars for r in got) == sorted(len(t) for _, t in rows)
        # Each text is followed once: the edits are those of one order of all rows.
        texts = [t for d, t in rows if d == same]
        ends = {hashlib.sha256(fp.edited(a, b).encode()).hexdigest() for a in texts for b in [*texts, "some. other."]}
        assert all(r.edited_sha256 in ends for r in got if r.doc_id == same)
