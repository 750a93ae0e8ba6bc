"""Token ids as binary segments: one concatenated id array a segment, with document
boundaries and document ids in Elias-Fano form.

A segment is the content of one file (``SEGMENT`` below), kept as a binary value of a
Parquet table so that Spark's own writers commit it and any store can hold it.

Segment, all numbers little-endian: 8 bytes magic; id width (1 byte), 7 bytes zero; number of
documents, of ids, of documents with a null doc_id (8 bytes each); least doc_id (8, signed);
Elias-Fano list of the n + 1 boundaries; Elias-Fano list of doc_id less the least one;
the ids. Elias-Fano list: count (8), bytes of the low part (8), of the high part (8), of the
select samples (8), bits of a low part (1), 7 bytes zero; low parts, high bits, samples.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tersa.llm.common import Ranges, new_path, partitions, pick
from tersa.llm.tokens import END_ID, batches, default_tokenizer, encoder

MAGIC = b"TERSAEF1"
HEAD, LIST_HEAD = struct.Struct("<8sB7xQQQq"), struct.Struct("<QQQQB7x")
#: One sampled position for so many set bits.
SAMPLE = 256
#: A segment is closed when its ids have so many bytes, or its documents are at an end.
SEGMENT_BYTES = 4 << 20
SEGMENT_SCHEMA = "shard long, seq int, n_docs long, n_ids long, payload binary"


def ef_pack(values: np.ndarray) -> bytes:
    """An ascending list of unsigned numbers in about 2 + log2(last / count) bits a value."""
    v = np.asarray(values, dtype=np.uint64)
    n, last = len(v), int(v[-1]) if len(v) else 0
    low = max(0, (last // n).bit_length() - 1) if n else 0
    bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    lows = np.packbits(bits.ravel(), bitorder="little").tobytes()
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
    high[ones] = 1
    highs = np.packbits(high, bitorder="little").tobytes()
    samples = ones[::SAMPLE].astype("<u4").tobytes()
    return LIST_HEAD.pack(n, len(lows), len(highs), len(samples), low) + lows + highs + samples


class EliasFano:
    """A packed list: ``self[i]`` by select over the high bits, ``all()`` at once."""

    def __init__(self, data: memoryview):
        self.n, a, b, c, self.low = LIST_HEAD.unpack_from(data)
        at = LIST_HEAD.size
        self.lows = np.frombuffer(data, np.uint8, a, at)
        self.highs = np.frombuffer(data, np.uint8, b, at + a)
        self.samples = np.frombuffer(data, "<u4", c // 4, at + a + b)
        self.size = at + a + b + c

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, seen = at >> 3, -bin(int(self.highs[at >> 3]) & ((1 << (at & 7)) - 1)).count("1")
        while seen + (ones := bin(int(self.highs[byte])).count("1")) <= left:
            seen, byte = seen + ones, byte + 1
        inside = np.flatnonzero(np.unpackbits(self.highs[byte : byte + 1], bitorder="little"))[left - seen]
        high = byte * 8 + int(inside) - i
        bit = i * self.low
        word = int.from_bytes(self.lows[bit >> 3 : (bit + self.low + 7) >> 3].tobytes(), "little")
        return high << self.low | word >> (bit & 7) & ((1 << self.low) - 1)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
            out |= (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out.astype(np.int64)


def pack_segment(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """One segment; documents come in ascending doc_id order, nulls first."""
    ends = np.cumsum([0, *(len(x) // width for x in ids)])
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    least = int(known[0]) if len(known) else 0
    head = HEAD.pack(MAGIC, width, len(ids), int(ends[-1]), len(ids) - len(known), least)
    return b"".join([head, ef_pack(ends), ef_pack(known.astype(np.uint64) - np.uint64(least % (1 << 64))), *ids])


class Segment:
    """A segment read back: ``doc_ids``, ``bounds`` (Elias-Fano) and ``ids``."""

    def __init__(self, payload: bytes):
        data = memoryview(payload)
        magic, width, self.n_docs, self.n_ids, nulls, least = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        self.dtype = np.dtype("<u2" if width == 2 else "<u4")
        self.bounds = EliasFano(data[HEAD.size :])
        at = HEAD.size + self.bounds.size
        known = EliasFano(data[at:])
        self.doc_ids = [None] * nulls + (known.all() + least).tolist()
        self.ids = np.frombuffer(data, self.dtype, self.n_ids, at + known.size)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds[i] : self.bounds[i + 1]]

    def spans(self) -> Iterator[tuple[int, int]]:
        """Where each document begins and ends, by one select a document; no table of boundaries is made."""
        start = self.bounds[0]
        for i in range(1, self.n_docs + 1):
            stop = self.bounds[i]
            yield start, stop
            start = stop


def encoded(docs: DataFrame, tokenizer: str, end_id: int, ranges: Ranges) -> DataFrame:
    """shard, doc_id, tie, ids (little-endian bytes, with the end id) of every document."""

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = enc.end(end_id)
        for batch in batches(rows):
            ids = [enc(x) + end for x in batch.column(2).to_pylist()]
            shard = ranges.of(batch.column(0), batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int64()), batch.column(0), batch.column(1), pa.array(ids, pa.binary())],
                ["shard", "doc_id", "tie", "ids"],
            )

    plain = docs.select(F.col("doc_id").cast("long"), ranges.ties.alias("tie"), "text")
    return plain.mapInArrow(encode, "shard long, doc_id long, tie long, ids binary")


def segments(rows: DataFrame, width: int) -> DataFrame:
    """Rows dealt and sorted by (shard, doc_id) to SEGMENT_SCHEMA rows."""

    def build(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seq, known, ids, size = None, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            payload = pack_segment(known, ids, width)
            values = [[shard], [seq], [len(ids)], [size // width], [payload]]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds, strict=True)],
                ["shard", "seq", "n_docs", "n_ids", "payload"],
            )

        for batch in batches(rows):
            for at, doc, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (at != shard or size >= SEGMENT_BYTES):
                    yield flush()
                    seq, known, ids, size = seq + 1 if at == shard else 0, [], [], 0
                shard = at
                known.append(doc)
                ids.append(x)
                size += len(x)
        if ids:
            yield flush()

    return rows.mapInArrow(build, SEGMENT_SCHEMA)


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encodes every whole text (null: empty), appends ``end_id`` and writes segments to ``path``.

    Ascending (shard, seq) is ascending doc_id; a null id comes first; rows that share an id are ordered by their
    ids' bytes, and, where they are so many that they fill shards of their own, by a hash of their text first. An empty
    table writes an empty one. Only doc_id and text are read.
    """
    docs = pick(docs, "doc_id", "text")
    tokenizer = tokenizer or default_tokenizer()
    n = partitions(docs.sparkSession)
    ranges = Ranges(docs, "doc_id", 4 * n, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    rows = encoded(docs, tokenizer, end_id, ranges)
    dealt = rows.repartition(n, "shard").sortWithinPartitions("shard", "doc_id", "tie", "ids").drop("tie")
    segments(dealt, encoder(tokenizer).dtype.itemsize).write.parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT_SCHEMA).parquet(path)


def index(table: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, shard, seq, from segments.

    Offsets in a segment come from the select structure of its boundaries. Global starts are a running sum over the segments of a
    shard, and one over the shards, whose number does not follow the data.
    """

    def decode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 1):
            shard, seq, payload = (c[0].as_py() for c in batch.columns)
            s = Segment(payload)
            found = [(a, b - a, zlib.crc32(s.ids[a:b].astype("<u4").tobytes())) for a, b in s.spans()]
            at, size, crc = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
            n = s.n_docs
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * n, pa.int64()),
                    pa.array([seq] * n, pa.int32()),
                    pa.array(s.doc_ids, pa.int64()),
                    pa.array(at, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                ["shard", "seq", "doc_id", "_at", "n_tokens", "ids_crc32"],
            )

    found = table.select("shard", "seq", "payload").mapInArrow(
        decode, "shard long, seq int, doc_id long, _at long, n_tokens long, ids_crc32 long"
    )
    def before(column: str, window: WindowSpec) -> Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    shards = table.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    shards = shards.select("shard", before("_n", Window.orderBy("shard")).alias("_shard_base"))
    base = table.select("shard", "seq", before("n_ids", Window.partitionBy("shard").orderBy("seq")).alias("_base")).join(shards, "shard")
    base = base.select("shard", "seq", (F.col("_base") + F.col("_shard_base")).alias("_base"))
    return found.join(base, ["shard", "seq"]).select(
        "doc_id", (F.col("_base") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32", "shard", "seq"
    )


def write_and_index(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the documents' ids to the shared folder and returns ``index`` of what it reads back."""
    spark = docs.sparkSession
    path = new_path(spark, "token-ids")
    write_ids(docs, path, tokenizer, end_id)
    return index(read_ids(spark, path))
