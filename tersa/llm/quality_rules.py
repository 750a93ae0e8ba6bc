"""Quality rules from line frequency across documents: hash normalised lines, count distinct
documents a host, remove lines above the limit, and reject documents that this depletes.

The text is read once, in Arrow batches, to one row a document with its rule counts and the
hashes of its lines; everything across documents is counts over those rows.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersa.llm.common import pick, written
from tersa.llm.tokens import batches

#: White space between words, and symbols that count against a text. Fixed by the contract.
SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A line goes when more documents of its host hold it than both of these say.
MIN_DOCUMENTS = 20
MAX_PERCENT_OF_HOST = 10
#: A document goes when less of its words than this remains.
MIN_KEPT_PERCENT = 30
#: Frequent lines up to this many are broadcast; above it they join by shuffle.
BROADCAST_LINES = 200_000

_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
PROFILE = f"row long, doc_id long, host string, digest long, {_STATS}, lines array<long>, line_words array<long>"
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by a window of so many words that the list holds twice or more."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], dtype=np.uint64)
    if len(ids) == n:
        return 0
    w = (w + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    w ^= w >> np.uint64(33)
    h = np.zeros(n - window + 1, dtype=np.uint64)
    for k in range(window):
        h += (w[k : n - window + 1 + k] ^ (w[k : n - window + 1 + k] >> np.uint64(29))) * (_MIX[k % 5] + np.uint64(2 * (k // 5)))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def normal_line(line: bytes) -> bytes:
    """Words joined by one space, A-Z in lower case."""
    return b" ".join(line.lower().split())


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def _digest() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def profile(docs: DataFrame, host: str) -> DataFrame:
    """PROFILE rows: the rule counts of each document, and its distinct normalised lines with
    the words that each accounts for."""

    def measure(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            out = []
            for row, doc, place, digest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode()
                words = raw.split()
                seen, repeated, per_line = set(), 0, {}
                for line in raw.split(b"\n"):
                    own = line.split()
                    if own:
                        repeated += line in seen
                        seen.add(line)
                        h = line_hash(b" ".join(own).lower())
                        per_line[h] = per_line.get(h, 0) + len(own)
                chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACES)))
                symbols = len(raw) - len(raw.translate(None, SYMBOLS))
                out.append((row, doc, place, digest, len(words), chars, symbols, repeated, repeated_words(words), list(per_line), list(per_line.values())))
            kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 6, pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["row", "doc_id", "host", "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"]
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        _digest().alias("digest"),
        "text",
    ).mapInArrow(measure, PROFILE)


def frequent_lines(
    profiles: DataFrame, min_documents: int = MIN_DOCUMENTS, max_percent: int = MAX_PERCENT_OF_HOST, equal_texts_once: bool = False
) -> DataFrame:
    """host, line, n_docs of the lines above the limit. With ``equal_texts_once`` documents of a host that have equal texts count
    as one: copies are for deduplication to remove, and do not make their lines boilerplate."""
    name = "digest" if equal_texts_once else "row"
    lines = profiles.select("host", name, F.explode("lines").alias("line"))
    lines = lines.distinct() if equal_texts_once else lines
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_documents)
    totals = profiles.select("host", name).distinct().groupBy("host").agg(F.count("*").alias("n_host"))
    return counts.join(totals, "host").where(100 * F.col("n_docs") > max_percent * F.col("n_host")).select("host", "line", "n_docs")


def _held(lines: DataFrame) -> DataFrame:
    """Frequent lines are few (each is in a fixed share of its host's documents), which is
    checked before they are broadcast."""
    return F.broadcast(lines) if lines.count() <= BROADCAST_LINES else lines


def judge(docs: DataFrame, host: str = "source", **limits: int | bool) -> tuple[DataFrame, DataFrame]:
    """The verdict on each row of ``docs``, and the frequent lines behind it.

    Verdict: row, doc_id, host, the rule counts, base_failed, removed_words, kept. A document is kept
    if it passes the base rules (10 words or more; at most 20 in 100 words in repeated 5-word
    windows) and keeps at least 30 in 100 of its words once frequent lines are out. A null
    text counts as empty, a null host as a host of its own; an empty text fails the base
    rules. Repeated rows get a verdict each.
    """
    keep = limits.pop("min_kept_percent", MIN_KEPT_PERCENT)
    rows = written(profile(pick(docs, "doc_id", host, "text"), host), "line-profiles")
    lines = written(frequent_lines(rows, **limits), "frequent-lines")
    each = rows.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
    each = each.select("row", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    gone = each.join(_held(lines), ["host", "line"]).groupBy("row").agg(F.sum("words").alias("removed_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    verdict = (
        rows.drop("lines", "line_words", "digest")
        .join(gone, "row", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn(
            "kept",
            ~F.col("base_failed") & (100 * (F.col("n_words") - F.col("removed_words")) >= keep * F.col("n_words")),
        )
    )
    return verdict, lines


def without_lines(text: str, frequent: set[int]) -> str:
    """The text without its lines of these hashes; other lines, blank ones too, stay as they are."""
    lines = text.split("\n")
    kept = [x for x in lines if not (own := x.encode().split()) or line_hash(b" ".join(own).lower()) not in frequent]
    return text if len(kept) == len(lines) else "\n".join(kept)


def _passes(text: str | None, frequent: set[int], keep: int) -> str | None:
    """The text to keep, or None for a document that is rejected."""
    words = (text or "").encode().split()
    if len(words) < MIN_WORDS or 100 * repeated_words(words) > MAX_REPEAT_PERCENT * len(words):
        return None
    left = without_lines(text, frequent)
    return left if 100 * len(left.encode().split()) >= keep * len(words) else None


def cleaned(docs: DataFrame, host: str = "source", **limits: int | bool) -> DataFrame:
    """The documents that ``judge`` keeps, all their columns, their text without frequent lines.

    A null text counts as empty, and fails the base rules; a null host is a host of its own; rows that repeat are documents
    of their own, and stay or go together; an empty table gives no rows.
    ``n_chars``, where there is one, follows the text. Up to BROADCAST_LINES frequent lines go to
    the workers as sets; beyond that each (host, text) gets its own by a join.
    """
    keep = limits.pop("min_kept_percent", MIN_KEPT_PERCENT)
    rows = written(profile(pick(docs, "doc_id", host, "text"), host), "line-profiles")
    lines = written(frequent_lines(rows, **limits), "frequent-lines")
    names = docs.columns
    place = F.coalesce(F.col(host).cast("string"), F.lit(""))
    held: dict[str, set[int]] = {}
    if lines.count() <= BROADCAST_LINES:
        for r in lines.toLocalIterator():
            held.setdefault(r["host"], set()).add(r["line"])
        given = docs.select(*names, place.alias("_host"), F.array().cast("array<long>").alias("_gone"))
    else:
        each = rows.select("host", "digest", F.explode("lines").alias("line")).join(lines, ["host", "line"])
        gone = each.groupBy(F.col("host").alias("_host"), F.col("digest").alias("_digest")).agg(F.collect_set("line").alias("_gone"))
        given = docs.select(*names, place.alias("_host"), _digest().alias("_digest"))
        given = given.join(gone, ["_host", "_digest"], "left").select(*names, "_host", "_gone")
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def keep_clean(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            hosts, gone = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
            text = [
                _passes(x, held.get(h, set()) if held else set(g or ()), keep)
                for x, h, g in zip(batch.column(at).to_pylist(), hosts, gone, strict=True)
            ]
            cols = [batch.column(i) for i in range(len(names))]
            cols[at] = pa.array(text, pa.string())
            if size is not None:
                cols[size] = pa.array([x and len(x) for x in text], pa.int64()).cast(cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array([x is not None for x in text]))

    return given.mapInArrow(keep_clean, docs.schema)
