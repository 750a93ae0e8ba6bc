import re
from collections import Counter, defaultdict

from tersa.llm import quality_rules as qr

from .conftest import EDGES

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, min_documents, max_percent, once=True):
    """doc_id, text, host rows to the contract's columns, kept and the text that is left, by plain loops."""
    norm = lambda line: " ".join(WORD.findall(line.encode().lower().decode()))
    rows = [(d, t or "", h or "") for d, t, h in rows]
    docs, totals = defaultdict(set), defaultdict(set)
    for i, (_, t, h) in enumerate(rows):
        totals[h].add(t if once else i)
        for line in t.split("\n"):
            if WORD.search(line):
                docs[h, norm(line)].add(t if once else i)
    often = {k for k, v in docs.items() if len(v) > min_documents and 100 * len(v) > max_percent * len(totals[k[0]])}
    out = []
    for d, t, h in rows:
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
        gone = sum(len(WORD.findall(x)) for x in lines if (h, norm(x)) in often)
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        left = "\n".join(x for x in t.split("\n") if not WORD.search(x) or (h, norm(x)) not in often)
        kept = not failed and 100 * (len(w) - gone) >= 30 * len(w)
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed, kept, gone, left if kept else None))
    return out


def check(docs, rows, once=True, **limits):
    want = brute(rows, limits["min_documents"], limits["max_percent"], once)
    limits["equal_texts_once"] = once
    verdict, _ = qr.judge(docs, **limits)
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.removed_words) for r in verdict.collect()]
    assert sorted(map(str, got)) == sorted(str(w[:9]) for w in want)
    left = [(r.doc_id, r.text, r.n_chars) for r in qr.cleaned(docs, **limits).collect()]
    assert sorted(map(str, left)) == sorted(str((w[0], w[9], len(w[9]))) for w in want if w[7])
    return want


def table():
    rows = []
    for i in range(120):
        lines = [f"a line of its own number {i} with some more words {i * 7}"]
        if i % 3 == 0:
            lines.append("Accept   All Cookies, please # * |")
        if i % 4 == 0:
            lines = ["accept all COOKIES, please # * |", "another line that many of the documents here have in common", f"tiny {i}"]
        rows.append((i, "\n".join(lines), "en", None if i % 5 == 0 else f"h{i % 2}", 0))
    rows += [(500 + i, rows[3][1], "en", "h0", 0) for i in range(60)]
    rows.append((900, "one two three four five six seven " * 3, "en", "h1", 0))
    return rows


def test_against_brute_force(docs_of, monkeypatch):
    rows = table()
    given = [(r[0], r[1], r[3]) for r in rows]
    want = check(docs_of(rows, extra=("host", "row", "line")), given, min_documents=5, max_percent=10)
    assert any(w[8] for w in want) and any(not w[6] and not w[7] for w in want)
    every = check(docs_of(rows), given, once=False, min_documents=5, max_percent=10)
    assert sum(not w[7] for w in every) > sum(not w[7] for w in want)
    monkeypatch.setattr(qr, "BROADCAST_LINES", 0)
    check(docs_of(rows), given, min_documents=5, max_percent=10)


def test_edges(edges, docs_of):
    check(edges, [(e[0], e[1], e[3]) for e in EDGES], min_documents=1, max_percent=1)
    assert qr.judge(docs_of([]))[0].count() == 0 and qr.cleaned(docs_of([])).count() == 0
