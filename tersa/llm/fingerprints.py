"""Document fingerprints: invertible Bloom lookup tables over hashed paragraphs.

A fingerprint is a table of cells (count, xor of digests, xor of their checks). Two tables of one size
subtract; peeling the difference recovers the digests that only one side has, and where a table is
too small for that, both are built anew four times as large. Likeness is then exact
on the recovered sets: paragraphs in common over paragraphs of either.

All documents of a batch are sketched, subtracted and peeled together, as arrays.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersa.llm.common import Ranges, partitions, pick
from tersa.llm.tokens import batches

#: Cells of the fingerprint itself, in three parts; a failed peel goes to GROW times as many.
CELLS, PARTS, GROW = 12, 3, 4
#: Documents, and code points, that are worked on together.
BATCH_DOCS, BATCH_CHARS = 500, 4_000_000
#: A paragraph is a line; at the end of a sentence, or after so many code points, a long one is cut. Marks that no sentence
#: comes before are a paragraph too, so that all of a text but its white space is in one.
_PARAGRAPH = re.compile(r"[^.!?\n]{1,400}[.!?]*|[.!?]+")
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)

Keys = tuple[np.ndarray, np.ndarray]  # document number, digest; no pair twice
Table = tuple[np.ndarray, np.ndarray, np.ndarray]  # count, digests, checks: documents x cells


def paragraph_digests(text: str) -> list[int]:
    """Distinct 64-bit digests of the paragraphs of a text, white space at their ends aside."""
    return list({xxhash.xxh3_64_intdigest(p) for x in _PARAGRAPH.findall(text) if (p := x.strip())})


def keyed(digests: list[list[int]]) -> Keys:
    n = [len(x) for x in digests]
    flat = np.fromiter((d for x in digests for d in x), dtype=np.uint64, count=sum(n))
    return np.repeat(np.arange(len(n)), n), flat


def _mix(x: np.ndarray, salt: np.uint64) -> np.ndarray:
    x = (x ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cells(doc: np.ndarray, digest: np.ndarray, cells: int) -> list[np.ndarray]:
    part = cells // PARTS
    level = np.uint64(cells * 0x9E3779B1)
    return [doc * cells + j * part + (_mix(digest, _SALT[j] + level) % np.uint64(part)).astype(np.int64) for j in range(PARTS)]


def _check(digest: np.ndarray) -> np.ndarray:
    return (_mix(digest, _SALT[PARTS]) >> np.uint64(32)).astype(np.uint32)


def sketch(keys: Keys, docs: int, cells: int = CELLS) -> Table:
    doc, digest = keys
    count, held, checks = np.zeros(docs * cells, np.int32), np.zeros(docs * cells, np.uint64), np.zeros(docs * cells, np.uint32)
    own = _check(digest)
    for at in _cells(doc, digest, cells):
        np.add.at(count, at, 1)
        np.bitwise_xor.at(held, at, digest)
        np.bitwise_xor.at(checks, at, own)
    return count.reshape(docs, cells), held.reshape(docs, cells), checks.reshape(docs, cells)


def subtract(a: Table, b: Table) -> Table:
    return a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2]


def peel(table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, digest and side (1: first, -1: second) of every recovered digest, and whether each
    document's table came out empty. The table is used up."""
    count, held, checks = (x.reshape(-1) for x in table)
    docs, cells = table[0].shape
    found: list[tuple[np.ndarray, ...]] = []
    pure = np.flatnonzero(np.abs(count) == 1)
    # A table gives at most as many digests as it has cells; a false one could go round for ever.
    for _ in range(cells):
        pure = pure[(np.abs(count[pure]) == 1) & (_check(held[pure]) == checks[pure])]
        if not len(pure):
            break
        # A digest alone in two cells is one find; finds of a document and a digest are made distinct.
        order = np.lexsort((held[pure], pure // cells))
        pure = pure[order]
        doc, digest, side = pure // cells, held[pure], count[pure]
        first = np.ones(len(pure), dtype=bool)
        first[1:] = (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])
        doc, digest, side = doc[first], digest[first], side[first]
        found.append((doc, digest, side))
        own, touched = _check(digest), []
        for at in _cells(doc, digest, cells):
            np.subtract.at(count, at, side)
            np.bitwise_xor.at(held, at, digest)
            np.bitwise_xor.at(checks, at, own)
            touched.append(at)
        pure = np.unique(np.concatenate(touched))
    empty = ~((count != 0) | (held != 0) | (checks != 0)).reshape(docs, cells).any(axis=1)
    if not found:
        none = np.array([], dtype=np.int64)
        return none, none.astype(np.uint64), none, empty
    return *(np.concatenate(x) for x in zip(*found, strict=True)), empty


def differing(a: Keys, b: Keys, docs: int, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, digest and side (1: only ``a`` has it, -1: only ``b``) of every digest that differs.

    A peel counts if it leaves the table empty and agrees with the numbers of digests of both sides; else, as when a cell of
    several digests passes for one, both tables are built anew larger, with other places."""
    found: list[tuple[np.ndarray, ...]] = []
    left = np.arange(docs)
    while len(left):
        doc, digest, side, empty = peel(subtract(sketch(a, len(left), cells), sketch(b, len(left), cells)))
        excess = np.bincount(doc, weights=side, minlength=len(left)).astype(np.int64)
        sizes = [np.bincount(k[0], minlength=len(left)) for k in (a, b)]
        gone = np.bincount(doc[side > 0], minlength=len(left))
        good = empty & (excess == sizes[0] - sizes[1]) & (gone <= sizes[0])
        keep = good[doc]
        found.append((left[doc[keep]], digest[keep], side[keep]))
        place = np.full(len(left), -1)
        place[~good] = np.arange((~good).sum())
        left = left[~good]
        a, b = ((place[k[0]][stay], k[1][stay]) for k, stay in ((k, place[k[0]] >= 0) for k in (a, b)))
        cells *= GROW
    none = np.array([], dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip((none, none.astype(np.uint64), none), *found, strict=True))


def differences(a: Keys, b: Keys, docs: int, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """For each document the number of digests that only ``a`` has, and that only ``b`` has."""
    doc, _, side = differing(a, b, docs, cells)
    return np.bincount(doc[side > 0], minlength=docs), np.bincount(doc[side < 0], minlength=docs)


def recovered(a: list[list[int]], b: list[list[int]]) -> tuple[np.ndarray, list[list[int]], list[list[int]]]:
    """Of each pair its likeness, shared digests over all digests (1 where both have none), and the digests that only
    the first and only the second have, ascending."""
    n = np.array([len(x) for x in a], dtype=np.int64)
    doc, digest, side = differing(keyed(a), keyed(b), len(a))
    sides = [[[] for _ in a], [[] for _ in a]]
    for i, d, s in sorted(zip(doc.tolist(), digest.tolist(), side.tolist(), strict=True)):
        sides[s < 0][i].append(d)
    only_a, only_b = (np.array([len(x) for x in side], dtype=np.int64) for side in sides)
    either = n + only_b
    return np.where(either == 0, 1.0, (n - only_a) / np.maximum(either, 1)), *sides


def likeness(a: list[list[int]], b: list[list[int]]) -> np.ndarray:
    return recovered(a, b)[0]


def spelled(table: Table) -> list[str]:
    """The cells of each document as base64: counts, digests, checks, little-endian."""
    parts = [table[0].astype("<i4"), table[1].astype("<u8"), table[2].astype("<u4")]
    return [base64.b64encode(b"".join(p[i].tobytes() for p in parts)).decode() for i in range(len(parts[0]))]


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many, or all, of another text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame) -> DataFrame:
    """p, guest, doc_id, tie, text: ranges of doc_id, sorted, each ending with the row that follows it.

    That row, the guest, is the first of the next range, and after the last range the first of
    all. Which rows those are comes from one id a range; the text moves once.
    """
    n = partitions(docs.sparkSession)
    ranges = Ranges(docs, "doc_id", 4 * n, F.xxhash64("text"))
    docs = docs.select("doc_id", ranges.ties.alias("tie"), "text")

    def numbered(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            p = pa.array(ranges.of(batch.column(0), batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([p, *batch.columns], ["p", "doc_id", "tie"])

    # One row a range comes to the driver: their number does not follow the data.
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("o")
    firsts = docs.select("doc_id", "tie").mapInArrow(numbered, "p long, doc_id long, tie long").groupBy("p").agg(least)
    heads = sorted((r.p, r.o.doc_id, r.o.tie) for r in firsts.collect())
    goes = {(d, t): heads[i - 1][0] for i, (_, d, t) in enumerate(heads)}

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            own = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            guests: dict[tuple, tuple[str, int]] = {}
            for i, key in enumerate(own):
                if key in goes:
                    text = batch.column(2)[i].as_py()
                    guests[key] = min(guests.get(key, (text, i)), (text, i))
            extra = [i for _, i in guests.values()]
            p = np.append(ranges.of(batch.column(0), batch.column(1)), np.array([goes[own[i]] for i in extra], dtype=np.int64))
            rows_ = batch.take(pa.array([*range(len(own)), *extra], pa.int64()))
            flag = [False] * len(own) + [True] * len(extra)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(flag), *rows_.columns], ["p", "guest", "doc_id", "tie", "text"])

    dealt = docs.mapInArrow(deal, "p long, guest boolean, doc_id long, tie long, text string")
    return dealt.repartition(n, "p").sortWithinPartitions("p", "guest", "doc_id", "tie", "text")


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_paragraphs long, lost array<long>, gained array<long>"
)


def fingerprint(docs: DataFrame) -> DataFrame:
    """OUT rows: each document's fingerprint, that of its edited text, their likenesses, and the digests of paragraphs, recovered
    by peeling, that the edit took away (lost) and brought (gained), as signed 64-bit numbers.

    A null text counts as empty. Documents go by ascending doc_id, a null id first, equal ids by
    a hash of their text, where they are many, and their text; the last is followed by the first, so a single one by itself. Texts without
    paragraphs have a fingerprint of empty cells and are wholly alike. Repeated rows each
    get a row. Only doc_id and text are read.
    """

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool, int | None, int, str]] = []

        def flush(own: list[tuple[int, bool, int | None, int, str]], after: str) -> pa.RecordBatch:
            texts = [r[4] for r in own]
            following = [*texts[1:], after]
            changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
            digests = [paragraph_digests(x) for x in [*texts, after]]
            new = [paragraph_digests(x) for x in changed]
            keep = [i for i, r in enumerate(own) if not r[1]]
            digests, following_, new = digests[:-1], digests[1:], new
            near, lost, gained = recovered(digests, new)
            signed = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
            cols = [
                [r[2] for r in own],
                [len(x) for x in texts],
                [hashlib.sha256(x.encode()).hexdigest() for x in changed],
                spelled(sketch(keyed(digests), len(own))),
                spelled(sketch(keyed(new), len(own))),
                near,
                likeness(digests, following_),
                [len(x) for x in digests],
                [signed(x) for x in lost],
                [signed(x) for x in gained],
            ]
            names = [c.split()[0] for c in OUT.split(", ")]
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int64(), *[pa.list_(pa.int64())] * 2]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
            return batch.take(pa.array(keep, pa.int64()))

        # A guest may come more than once: the first after a range's last row is the one that follows it.
        size = 0
        for batch in batches(rows):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) > BATCH_DOCS or size > BATCH_CHARS and len(held) > 1:
                    yield flush(held[:-1], held[-1][4])
                    held, size = held[-1:], len(held[-1][4])
                held.append(row)
                size += len(row[4])
        if len(held) > 1:
            yield flush(held[:-1], held[-1][4])

    plain = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return in_order(plain).mapInArrow(compare, OUT)
