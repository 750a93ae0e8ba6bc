"""Documents in blocks of bounded size, and word arithmetic on whole blocks with numpy.

A block is some megabytes of text, written once to the shared folder with a number of its own. Jobs
that need several passes refer to a row as (block, place in the block), so ids may repeat or
be null, and ask the rest of the corpus about a block's distinct keys instead of about each
word of each document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersa.llm.common import written
from tersa.llm.tokens import batches

#: A block closes when its texts have so many bytes.
BLOCK_BYTES = 4 << 20
BLOCK_SCHEMA = "block long, n_docs int, payload binary"

_U = np.uint64
_BASE, _ROLL = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
#: For each byte, whether it is of a word.
_IN_WORD = bytes(c not in (0x20, *range(0x09, 0x0E)) for c in range(256))


def in_blocks(docs: DataFrame, most: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text and any flags) as a written table of blocks, of ``most`` bytes of text where that is less than
    BLOCK_BYTES; null texts become empty."""
    full = min(most or BLOCK_BYTES, BLOCK_BYTES)

    def build(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, number = 0, 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
            with pa.ipc.new_stream(sink, table.schema.remove(0), options=options) as out:
                out.write_table(table.drop_columns(["_part"]))
            block = (table.column("_part")[0].as_py() << 32) + number
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([table.num_rows], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                ["block", "n_docs", "payload"],
            )

        for batch in batches(rows, 200):
            ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)) + 1 + np.arange(batch.num_rows)
            at, done = 0, 0
            while at < batch.num_rows:
                # Up to the row with which the block is full; a text longer than a block ends the one it is in.
                stop = min(int(np.searchsorted(ends, done + full - size)) + 1, batch.num_rows)
                held.append(batch.slice(at, stop - at))
                size += int(ends[stop - 1]) - done
                at, done = stop, int(ends[stop - 1])
                if size >= full:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = docs.select(
        F.spark_partition_id().alias("_part"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), *others
    )
    return written(plain.mapInArrow(build, BLOCK_SCHEMA), "blocks")


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs (first, end) of texts with about so many bytes at most, one text at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, stop
        at = stop


def opened(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        size = -(-n // (1 << 20)) << 20
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ _U(salt)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """The words of the texts of a block: ``hash`` by word, ``doc`` by word, ``first`` word of each document."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = texts.cast(pa.large_binary())
        texts = texts.fill_null(b"") if texts.null_count else texts
        n = len(texts)
        ends = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        ends = ends - ends[0]
        # One space between documents, so that no word spans two, and one at both ends.
        spaced = b" ".join([b"", *texts.to_pylist(), b""]) if n else b" "
        spaced = spaced.lower() if lower else spaced  # of bytes: A-Z only
        raw = np.frombuffer(spaced, np.uint8)
        in_word = np.frombuffer(spaced.translate(_IN_WORD), np.bool_)
        edge = np.flatnonzero(in_word[1:] != in_word[:-1]) + 1
        start, stop = edge[::2], edge[1::2]
        up, down = _powers(len(raw) + 1)
        # In place: eight bytes for each byte of text, once.
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        sums[1:] = raw
        sums[1:] += _U(1)
        sums[1:] *= up[: len(raw)]
        np.cumsum(sums[1:], out=sums[1:])
        self.hash = mixed((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64) * _ROLL)
        self.n_docs = n
        bounds = ends[:-1] + np.arange(1, n + 1)
        self.first = np.append(np.searchsorted(start, bounds), len(start))
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)

    def windows(self, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``size`` words from each word on, and whether they are all of one document."""
        return rolling(self.hash, size, salt), self.inside(size)

    def inside(self, size: int) -> np.ndarray:
        """Whether a window of ``size`` words from each word on stays in its document."""
        at = np.arange(len(self.hash))
        return at + size <= self.first[self.doc + 1] if len(at) else np.zeros(0, dtype=bool)


def rolling(hashes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of ``size`` numbers; runs that pass the end are cut off by the caller."""
    n = len(hashes)
    up, down = _powers(n + size + 1)
    sums = np.zeros(n + size + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1 : n + 1])
    sums[n + 1 :] = sums[n]
    return mixed((sums[size : n + size] - sums[:n]) * down[:n], salt)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def unsigned(x: pa.Array | list | None) -> np.ndarray:
    """A list of longs, as collected by Spark, back to sorted 64-bit numbers."""
    if x is None:
        return np.array([], dtype=np.uint64)
    return np.sort(np.asarray(x, dtype=np.int64).view(np.uint64))


def distinct(x: np.ndarray) -> np.ndarray:
    """The ascending distinct values of a short array; np.unique takes longer to begin than to sort it."""
    x = np.sort(x)
    first = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def member(x: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(sorted_set, x)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == x


def each_block(table: DataFrame, work: Callable[..., pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work`` on each row of a table of blocks: block, opened payload, then further columns as Python or Arrow values."""
    extra = [c for c in table.columns if c not in ("block", "n_docs", "payload")]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 1):
            block, payload = batch.column(0)[0].as_py(), opened(batch.column(1)[0].as_py())
            out = work(block, payload, *(batch.column(i + 2)[0] for i in range(len(extra))))
            if out is not None and out.num_rows:
                yield from batches(iter([out]), 20_000)

    return table.select("block", "payload", *extra).mapInArrow(run, schema)


def list_of(scalar: pa.Scalar) -> np.ndarray:
    """An Arrow list value of longs as sorted unsigned numbers."""
    if not scalar.is_valid:
        return np.array([], dtype=np.uint64)
    return np.sort(scalar.values.to_numpy(zero_copy_only=False).view(np.uint64))
