"""Substring deduplication by relative Lempel-Ziv parsing against an index of every block.

Each block of the corpus is a reference. Its text is cut at anchors, chosen by content alone, into
phrases: a phrase is the words of all windows of WINDOW words that have one anchor (the
least hash among the word n-grams of the window, leftmost on a tie). Equal windows have equal anchors
at equal places, so whatever repeats, repeats under its anchor, and the index of all blocks is
two tables of hashes:

1. Phrases. Whole phrases that the index holds twice continue a factor of the parse.
2. Windows. Where a phrase is alone but its anchor is not, a factor may end or begin inside: these
   boundaries are checked window by window, against the windows of every distinct phrase
   of the anchor.

A document's factors are the maximal runs of windows found elsewhere; they have WINDOW words or more, and
cover what is removed. Only the hashes travel: copies of a phrase count once a block and
then once in all, so no passage, however frequent, gathers its texts anywhere.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersa.llm.blocks import Words, each_block, in_blocks, list_of, member, rolling, signed
from tersa.llm.common import pick, written

WINDOW = 35
#: Words of the n-grams that anchors are chosen from.
GRAM = 10
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start:int,length:int>>"


class Phrases:
    """Windows, anchors and phrases of a block. ``of``: the phrase of each window; windows are given by
    their first word, ``at``."""

    def __init__(self, words: Words, window: int):
        self.window = window
        gram = min(GRAM, window)
        grams = rolling(words.hash, gram, 0x51ED27)
        span = window - gram + 1
        least = _sliding_argmin(grams, span)
        self.at = np.flatnonzero(words.inside(window))
        anchor = least[self.at]
        doc = words.doc[self.at]
        new = np.ones(len(self.at), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        self.of = np.cumsum(new) - 1
        first = self.at[new]
        last = np.append(self.at[:-1][new[1:]], self.at[-1:])
        self.anchor = grams[anchor[new]]
        # A phrase by its words and by where in it the anchor is.
        up = _span_hash(words.hash, first, last + window)
        self.phrase = up ^ ((anchor[new] - first).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def _sliding_argmin(x: np.ndarray, span: int) -> np.ndarray:
    """For each place the place of the least of the ``span`` values from it on, leftmost on ties."""
    n = len(x)
    best = np.arange(n)
    have = 1
    while have < span:
        step = min(have, span - have)
        other = best[step:]
        mine = best[: n - step]
        best = np.concatenate([np.where(x[other] < x[mine], other, mine), best[n - step :]]) if step < n else best
        have += step
    return best


def _span_hash(hashes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    from tersa.llm.blocks import _powers, mixed

    up, down = _powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mixed(hashes, 0x2545F491) * up[: len(hashes)], out=sums[1:])
    return mixed((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


def phrase_rows(blocks: DataFrame, window: int) -> DataFrame:
    """anchor, phrase, block, n: every distinct phrase of every block."""

    def rows(block: int, docs: pa.Table) -> pa.RecordBatch | None:
        p = Phrases(Words(docs.column("text")), window)
        if not len(p.phrase):
            return None
        # The anchor belongs to the phrase: equal phrases have equal anchors.
        phrase, first, n = np.unique(p.phrase, return_index=True, return_counts=True)
        cols = [signed(p.anchor[first]), signed(phrase), pa.array(np.full(len(n), block)), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(cols, ["anchor", "phrase", "block", "n"])

    return each_block(blocks, rows, "anchor long, phrase long, block long, n long")


def index_phrases(rows: DataFrame) -> DataFrame:
    """block with two lists: ``twice``, its phrases that the index holds twice or more, and ``check``, the
    phrases whose windows it adds to the index of windows, as the first block that holds them.

    Both steps are sums, combined before they shuffle, and joins on keys that AQE may split.
    """
    phrases = rows.groupBy("anchor", "phrase").agg(F.sum("n").alias("n"), F.min("block").alias("owner"))
    phrases = written(phrases.withColumn("n", F.least("n", F.lit(2))), "phrases")
    shared = phrases.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where("all > 1")
    marked = phrases.join(shared, "anchor").select("phrase", "n", "owner", "kinds")
    found = rows.select("phrase", "block").join(marked, "phrase")
    twice = F.when(F.col("n") > 1, F.col("phrase"))
    check = F.when((F.col("kinds") > 1) & (F.col("owner") == F.col("block")), F.col("phrase"))
    return found.groupBy("block").agg(F.collect_list(twice).alias("twice"), F.collect_list(check).alias("check"))


def window_rows(blocks: DataFrame, window: int) -> DataFrame:
    """window, block, n, asks: windows of the phrases to check; ``asks`` where the phrase is alone and so
    needs the answer."""

    def rows(block: int, docs: pa.Table, twice: pa.Scalar, check: pa.Scalar) -> pa.RecordBatch | None:
        check, twice = list_of(check), list_of(twice)
        if not len(check):
            return None
        words = Words(docs.column("text"))
        p = Phrases(words, window)
        held = member(p.phrase, check)
        # Each phrase once: the first that has its hash.
        once = np.zeros(len(p.phrase), dtype=bool)
        once[np.unique(p.phrase, return_index=True)[1]] = True
        alone = ~member(p.phrase, twice)
        use = (held & once)[p.of]
        hashes, asks = rolling(words.hash, window, 0x7A3C)[p.at[use]], alone[p.of[use]]
        value, place, n = np.unique(hashes, return_inverse=True, return_counts=True)
        need = np.zeros(len(value), dtype=bool)
        need[place[asks]] = True
        cols = [signed(value), pa.array(np.full(len(n), block)), pa.array(n.astype(np.int64)), pa.array(need)]
        return pa.RecordBatch.from_arrays(cols, ["window", "block", "n", "asks"])

    return each_block(blocks, rows, "window long, block long, n long, asks boolean")


def index_windows(rows: DataFrame) -> DataFrame:
    """block with ``windows``: those it asks about that the index holds twice or more."""
    twice = rows.groupBy("window").agg(F.sum("n").alias("all"), F.max("asks").alias("any")).where("all > 1 AND any")
    found = rows.where("asks").select("window", "block").join(twice.select("window"), "window")
    return found.groupBy("block").agg(F.collect_list("window").alias("windows"))


def repeated(words: Words, twice: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """Whether each word is in a window that occurs elsewhere."""
    edge = np.zeros(len(words.hash) + 1, dtype=np.int64)
    p = Phrases(words, window)
    if len(p.at):
        hit = member(p.phrase, twice)[p.of]
        rest = np.flatnonzero(~hit)
        if len(windows):
            hit[rest] = member(rolling(words.hash, window, 0x7A3C)[p.at[rest]], windows)
        at = p.at[hit]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0


def factor(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """OUT rows (and the kept text): the factors of each document that occur elsewhere, as word spans, and what
    is left without them.

    A window counts as repeated if its words start anywhere else in the table, the same
    document included; windows are judged on the input. A null or empty text has no words.
    Rows that repeat whole repeat each other's windows. Ids may repeat or be null. An empty
    table gives no rows. Only doc_id and text are read. Hashes have 64 bits.
    """
    blocks = in_blocks(pick(docs, "doc_id", "text"))
    rows = written(phrase_rows(blocks, window), "phrase-rows")
    asked = written(index_phrases(rows), "asked")
    checks = written(window_rows(blocks.join(asked, "block"), window), "window-rows")
    answers = asked.select("block", "twice").join(index_windows(checks), "block", "left")

    def parse(block: int, docs: pa.Table, twice: pa.Scalar, windows: pa.Scalar) -> pa.RecordBatch:
        words = Words(docs.column("text"))
        gone = repeated(words, list_of(twice), list_of(windows), window)
        out = []
        for i, (doc, text) in enumerate(zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True)):
            mask = gone[words.first[i] : words.first[i + 1]]
            own = text.encode().split()
            kept = b" ".join(compress(own, ~mask) if mask.any() else own)
            step = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            spans = [{"start": a, "length": b - a} for a, b in step.reshape(-1, 2).tolist()]
            out.append((doc, len(own), int(mask.sum()), hashlib.sha256(kept).hexdigest(), spans, kept.decode()))
        span = pa.struct([("start", pa.int32()), ("length", pa.int32())])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(span), pa.string()][: 6 if with_text else 5]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "factors", "kept"][: len(kinds)]
        cols = list(zip(*out, strict=True))[: len(kinds)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return each_block(blocks.join(answers, "block", "left"), parse, OUT + ", kept string" * with_text)
