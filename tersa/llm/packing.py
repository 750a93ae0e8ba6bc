"""Packing token pieces into sequences of fixed length: Martello-Toth dominance reduction,
then best-fit for the remainder.

Pieces of one length are interchangeable, so the instance is its histogram of lengths: at most
``capacity`` numbers, whatever the corpus. The driver solves that; each fixed set or filled
bin is a pattern with a multiplicity. Rows then find their place by their rank among the
pieces of their length, which is counted in two levels and never in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tersa.llm.common import pick, written
from tersa.llm.tokens import END_ID, as_uint32, batches, default_tokenizer, encoder

CAPACITY = 4096
#: Groups within a length for ranking; a length may hold most rows.
RANK_GROUPS = 1024

#: A multiplicity, and the (length, times) that each of these sequences holds.
Pattern = tuple[int, list[tuple[int, int]]]


def dominant_sets(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns that some best packing holds, and the counts that remain.

    For each length, largest first, with free room ``r`` beside one piece:
    nothing fits, so it stays alone; the largest partner ``k`` fills ``r`` or no two
    pieces fit ``r``, so (length, k) dominates every other set; no three fit ``r`` and no
    pair has its lesser piece above ``b``, the largest that fits beside ``k``, so
    (length, k, b) does. Passes repeat until one changes nothing.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for length in sorted(left, reverse=True):
            while left.get(length, 0) and (found := _dominant(length, left, capacity)):
                need: dict[int, int] = {}
                for x in found:
                    need[x] = need.get(x, 0) + 1
                times = min(left[x] // k for x, k in need.items())
                fixed.append((times, sorted(need.items(), reverse=True)))
                for x, k in need.items():
                    left[x] -= times * k
                    if not left[x]:
                        del left[x]
                changed = True
    return fixed, left


def _dominant(length: int, left: dict[int, int], capacity: int) -> list[int] | None:
    room = capacity - length
    rest = dict(left)
    rest[length] -= 1
    sizes = sorted(x for x, c in rest.items() if c > 0)
    at = bisect_right(sizes, room)
    if not at:
        return [length]
    k = sizes[at - 1]
    least: list[int] = []
    for x in sizes[:3]:
        least += [x] * min(rest[x], 3 - len(least))
    if k == room or len(least) < 2 or least[0] + least[1] > room:
        return [length, k]
    if len(least) == 3 and sum(least) <= room:
        return None
    rest[k] -= 1
    fits = [x for x in sizes[: bisect_right(sizes, room - k)] if rest[x] > 0]
    if not fits:
        return None
    b = fits[-1]
    rest[k] += 1
    above: list[int] = []
    for x in sizes[bisect_right(sizes, b) :][:2]:
        above += [x] * min(rest[x], 2 - len(above))
    if len(above) < 2 or sum(above) > room or sum(above) <= k:
        return [length, k, b]
    return None


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit in descending length, for all pieces of a length at once."""
    bins: dict[int, list[Pattern]] = {}
    rooms: list[int] = []  # ascending, those in use

    def add(room: int, times: int, items: list[tuple[int, int]]) -> None:
        if room not in bins:
            bins[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        bins[room].append((times, items))

    for length in sorted(counts, reverse=True):
        want = counts[length]
        while want > 0:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, rest = divmod(want, each)
                if full:
                    add(capacity - each * length, full, [(length, each)])
                if rest:
                    add(capacity - rest * length, 1, [(length, rest)])
                break
            room = rooms[at]
            times, items = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[at]
            each = min(room // length, want)
            used = min(times, want // each)
            add(room - each * length, used, [*items, (length, each)])
            want -= used * each
            if times > used:
                add(room, times - used, items)
    return [p for group in bins.values() for p in group]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, left = dominant_sets(counts, capacity)
    return fixed + best_fit(left, capacity)


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each length its ranks cut into runs: (length, first rank, copies in a sequence,
    first sequence, offset there). A rank finds its run by bisection."""
    rows, taken, base = [], {}, 0
    for times, items in patterns:
        offset = 0
        for length, copies in items:
            rows.append((length, taken.get(length, 0), copies, base, offset))
            taken[length] = taken.get(length, 0) + times * copies
            offset += length * copies
        base += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(len(rows), 5)
    return dict(zip(("length", "first", "copies", "sequence", "offset"), table.T.copy(), strict=True))


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, as bytes) of every piece of every document."""

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end, width = enc.end(end_id), enc.dtype.itemsize
        for batch in batches(rows):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc(text) + end
                for k, at in enumerate(range(0, len(ids), capacity * width)):
                    part = ids[at : at + capacity * width]
                    crc = zlib.crc32(as_uint32(part, enc.dtype).tobytes())
                    out.append((doc, k, at // width, len(part) // width, crc, part if with_ids else None))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            keep = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols[:keep], kinds[:keep], strict=True)], names[:keep]
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_rank``: a number of its own, from 0, for each row of one length."""
    grouped = rows.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_GROUPS)))
    before = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    base = grouped.groupBy("length", "_g").agg(F.count("*").alias("_c"))
    base = base.select("length", "_g", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_g").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = grouped.withColumn("_n", F.row_number().over(within) - 1)
    return numbered.join(base, ["length", "_g"]).withColumn("_rank", F.col("_base") + F.col("_n")).drop("_g", "_n", "_base")


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (with ``length``) to the same pieces with sequence_id and offset.

    ``rows`` must be cheap to read more than once, as a written table is.
    """
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(solve(counts, capacity))
    keys = table["length"] << 44 | table["first"]

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(names.index("_rank")).to_numpy()
            run = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            bin_, copy = np.divmod(rank - table["first"][run], table["copies"][run])
            added = [table["sequence"][run] + bin_, table["offset"][run] + copy * length]
            held = [i for i, n in enumerate(names) if n != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in held] + [pa.array(a, pa.int64()) for a in added],
                [names[i] for i in held] + ["sequence_id", "offset"],
            )

    kinds = ", ".join(f"{n} {k}" for n, k in rows.dtypes)
    order = [*rows.columns, "_rank"]
    return ranked(rows).select(order).mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) for every piece.

    A null or empty text is one piece, the end id alone. Rows repeated, ids included, are
    packed as often as they come. An empty table gives no rows. Only doc_id and text are read.
    """
    rows = pieces(pick(docs, "doc_id", "text"), tokenizer or default_tokenizer(), capacity, end_id, with_ids)
    return packed(written(rows, "pieces"), capacity)
