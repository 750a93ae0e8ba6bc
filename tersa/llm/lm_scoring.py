"""Language-model scoring by cross-entropy difference.

Two bigram models of one form, one of a target (documents labelled good), one of the background
(all others), share one vocabulary and smoothing. A document's score is its mean loss a token under the
target model less that under the background model; the less, the more it reads like the target.

Counts cover every word and every bigram of every document, and so grow with the corpus; none are gathered. Words are
named by their hashes. Each block of documents asks for its distinct words and bigrams, and scores its documents
with the answers. What no other block holds is not answered: the block has its counts already. A document can be left out of
the model that scores it, so that what it alone says counts for nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersa.llm.blocks import Words, each_block, in_blocks, member, mixed, unsigned
from tersa.llm.common import partitions, pick, written
from tersa.llm.tokens import batches

#: What stands before the first word of a document, and, in a pruned model, for each word outside the vocabulary.
START, OTHER = np.uint64(0x5374617274), np.uint64(0x4F74686572)
#: In a pruned model, bigrams seen fewer times in all back off in both models.
LEAST_COUNT = 2
#: Weight of the bigram estimate where its history was seen, and what each word is added to its count.
BIGRAM_WEIGHT, ADDED = 0.6, 0.5
#: Bytes of text whose words are numbered, counted and scored together, and of how many such blocks the keys are summed together.
SCORED_BYTES, BLOCKS_A_PART = 3 << 19, 8
#: Target ids up to this many are broadcast; above it they join.
BROADCAST_IDS = 500_000
OUT = "doc_id long, n_tokens long, target_loss double, background_loss double, difference double, is_target boolean"


def flagged(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, text, is_target."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    target = written(target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct(), "target-ids")
    named = target.withColumn("is_target", F.lit(True))
    named = F.broadcast(named) if target.count() <= BROADCAST_IDS else named
    return docs.join(named, "doc_id", "left").select("doc_id", "text", F.coalesce("is_target", F.lit(False)).alias("is_target"))


def word_counts(blocks: DataFrame) -> DataFrame:
    """word, target, background: counts by block."""

    def rows(_: int, docs: pa.Table) -> pa.RecordBatch:
        words = Words(docs.column("text"), lower=True)
        good = docs.column("is_target").to_numpy()[words.doc] if words.n_docs else np.zeros(0, dtype=bool)
        value, place = np.unique(words.hash, return_inverse=True)
        cols = [np.bincount(place[good], minlength=len(value)), np.bincount(place[~good], minlength=len(value))]
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), *map(pa.array, cols)], ["word", "target", "background"])

    counts = each_block(blocks, rows, "word long, target long, background long")
    return counts.groupBy("word").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


class Vocabulary:
    """How words are read, and the totals: ``symbols`` that a word may be, ``tokens`` by model."""

    def __init__(self, symbols: int, tokens: tuple[int, int], kept: np.ndarray | None = None):
        self.symbols, self.tokens, self.kept = symbols, np.array(tokens, dtype=np.int64), kept

    def read(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The symbol of each word, and the one before it."""
        own = words.hash if self.kept is None else np.where(member(words.hash, self.kept), words.hash, OTHER)
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[words.first[:-1][words.count > 0]] = START
        return own, before

    def losses(self, pairs: np.ndarray, seen: np.ndarray, counts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Loss in nats under both models, from the counts by model of bigrams, of their histories and of their words, and of all tokens."""
        plain = (counts + ADDED) / (tokens + ADDED * self.symbols)
        both = BIGRAM_WEIGHT * pairs / np.maximum(seen, 1) + (1 - BIGRAM_WEIGHT) * plain
        return -np.log(np.where(seen > 0, both, plain))


def vocabulary(blocks: DataFrame, size: int | None) -> Vocabulary:
    """Of every word, or of the ``size`` most frequent ones; one further symbol is any other word."""
    counts = word_counts(blocks)
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("target", "background")]
    if size is None:
        n, *tokens = written(counts.agg(F.count("*").alias("n"), *[x.alias(f"t{k}") for k, x in enumerate(sums)]), "totals").first()
        return Vocabulary(n + 1, tokens)
    counts = written(counts, "word-counts")
    top = counts.orderBy(F.desc(F.col("target") + F.col("background")), "word").limit(size).collect()
    return Vocabulary(len(top) + 1, counts.agg(*sums).first(), unsigned([r.word for r in top]))


class Asked:
    """The distinct symbols and bigrams of a block: ``key``, and ``counts`` of them in the block, a row a model."""

    def __init__(self, docs: pa.Table, known: Vocabulary):
        self.words = Words(docs.column("text"), lower=True)
        good = docs.column("is_target").to_numpy()
        own, before = known.read(self.words)
        self.bigram, place = np.unique(mixed(mixed(before, 1) + own, 2), return_inverse=True)
        n = len(self.bigram)
        some = self.words.count > 0
        symbol, at = np.unique(np.append(own, np.full(some.sum(), START)), return_inverse=True)
        self.key = np.append(self.bigram, symbol)
        place_of = np.append(place, n + at)
        flags = good[self.words.doc]
        flags = np.concatenate([flags, flags, good[some]])
        self.counts = np.stack([np.bincount(place_of[flags == m], minlength=len(self.key)) for m in (True, False)])
        self.place = place
        # By bigram, where its word and its history are.
        self.word, self.history = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.word[place] = n + at[: len(own)]
        self.history[place] = n + np.searchsorted(symbol, before)

    def parts(self, n: int) -> list[np.ndarray]:
        """Places of the keys of each of ``n`` ranges of hashes, in ascending order of keys."""
        order = np.argsort(self.key)
        cuts = np.array([(i << 64) // n for i in range(1, n)], dtype=np.uint64)
        return np.split(order, np.searchsorted(self.key[order], cuts))

    def answer(self, parts: list[np.ndarray], told: list[dict]) -> None:
        """Counts of the whole corpus in the place of the block's own, where others hold a key too."""
        for row in told:
            at = parts[row["part"]]
            shared, *counts = unpacked(row["payload"], (len(at), row["n"], row["n"]), (np.uint8, np.uint32, np.uint32))
            for m in (0, 1):
                self.counts[m, at[shared.astype(bool)]] = counts[m]


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers byte by byte, the first bytes of all numbers first: leading zeros, and small counts, take next to nothing."""
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpacked(payload: bytes, lengths: tuple[int, ...], kinds: tuple[type, ...]) -> list[np.ndarray]:
    sizes = [n * np.dtype(k).itemsize for n, k in zip(lengths, kinds, strict=True)]
    data, out, at = np.frombuffer(pa.decompress(payload, sum(sizes), codec="zstd", asbytes=True), np.uint8), [], 0
    for n, kind, size in zip(lengths, kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(data[at : at + size].reshape(-1, n).T).reshape(-1).view(kind) if n else np.array([], dtype=kind))
        at += size
    return out


ASKED = "part int, block long, n int, payload binary"


def asked_rows(blocks: DataFrame, known: Vocabulary, n_parts: int) -> DataFrame:
    """For each block and range of hashes the distinct symbols and bigrams, as steps from one to the next, with their counts."""

    def rows(block: int, docs: pa.Table) -> pa.RecordBatch:
        asked = Asked(docs, known)
        parts = [(p, at) for p, at in enumerate(asked.parts(n_parts)) if len(at)]
        counts = asked.counts.astype(np.uint32)
        payloads = [packed(np.diff(asked.key[at], prepend=np.uint64(0)), counts[0, at], counts[1, at]) for _, at in parts]
        cols = [
            pa.array([p for p, _ in parts], pa.int32()),
            pa.array([block] * len(parts), pa.int64()),
            pa.array([len(at) for _, at in parts], pa.int32()),
            pa.array(payloads, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(cols, ["part", "block", "n", "payload"])

    return each_block(blocks, rows, ASKED)


def told_rows(asked: DataFrame) -> DataFrame:
    """part, block, n, payload: for each row of ``asked`` which of its keys other blocks hold too, and their counts in all.

    The rows of a range of hashes meet in one task. There are as many ranges as a few blocks go to, so a range is as large as a few
    blocks, however many there are; a key has one entry a block."""

    def work(part: int, rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        found = [unpacked(payload, (n, n, n), (np.uint64, np.uint32, np.uint32)) for _, n, payload in rows]
        key, place, times = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in found]), return_inverse=True, return_counts=True)
        sums = [np.bincount(place, weights=np.concatenate([x[m] for x in found]), minlength=len(key)).astype(np.uint32) for m in (1, 2)]
        at = 0
        for block, n, _ in rows:
            own = place[at : at + n]
            at, shared = at + n, times[own] > 1
            own = own[shared]
            if len(own):
                payload = packed(shared.view(np.uint8), sums[0][own], sums[1][own])
                cols = [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([len(own)], pa.int32()), pa.array([payload], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "block", "n", "payload"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches(rows, 100):
            for p, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part and held:
                    yield from work(part, held)
                    held = []
                part = p
                held.append(tuple(row))
        if held:
            yield from work(part, held)

    dealt = asked.repartition(partitions(asked.sparkSession), "part").sortWithinPartitions("part", "block")
    return dealt.mapInArrow(run, ASKED)


def own_counts(words: Words, symbols: np.ndarray, bigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of a block how often its document holds its bigram, its history and itself."""

    def times(x: np.ndarray) -> np.ndarray:
        _, at, n = np.unique(words.doc * (int(x.max(initial=0)) + 1) + x, return_inverse=True, return_counts=True)
        return n[at]

    of_word = times(symbols)
    of_history = np.ones_like(of_word)
    of_history[1:] = of_word[:-1]
    of_history[words.first[:-1][words.count > 0]] = 1  # each document begins once
    return times(bigrams), of_history, of_word


def score(docs: DataFrame, target: DataFrame, size: int | None = None, leave_out: bool = False) -> DataFrame:
    """OUT rows, one for each row of ``docs`` (doc_id, text); ``target`` has the doc_id of target documents.

    Words are what white space (ASCII) separates, A-Z in lower case. A null or empty text has no tokens
    and losses and difference 0. Without any target document that model is uniform over the vocabulary. A
    null id is background; rows that repeat count as often as they come. An empty table gives no rows.
    Further columns are ignored. Hashes of words and bigrams have 64 bits. With ``leave_out`` a row is scored by its own model as
    if it had not been counted: its own words and bigrams are taken from the counts first. With ``size`` the model is pruned: so
    many words, and bigrams seen LEAST_COUNT times.
    """
    blocks = in_blocks(flagged(pick(docs, "doc_id", "text"), target), SCORED_BYTES)
    known = vocabulary(blocks, size)
    minimum = 0 if size is None else LEAST_COUNT
    n_parts = max(partitions(docs.sparkSession), blocks.count() // BLOCKS_A_PART)
    # Written, so that the keys of all blocks need not stay on disk until the answers are read.
    told = written(told_rows(asked_rows(blocks, known, n_parts)), "told")
    told = told.groupBy("block").agg(F.collect_list(F.struct("part", "n", "payload")).alias("told"))

    def rows(_: int, docs: pa.Table, told: pa.Scalar) -> pa.RecordBatch:
        asked = Asked(docs, known)
        asked.answer(asked.parts(n_parts), told.as_py() or [])
        words, place = asked.words, asked.place
        good = docs.column("is_target").to_numpy()
        own, n = (0, 0, 0), words.count
        if leave_out:
            own = own_counts(words, asked.word[place], place)
        loss = []
        for m, of_model in enumerate((good, ~good)):
            # Rows of this model, where they are left out of it.
            out = of_model[words.doc] if leave_out else np.zeros(len(place), dtype=bool)
            pairs, seen, count = (asked.counts[m, at[place]] - out * x for at, x in zip((np.arange(len(asked.bigram)), asked.history, asked.word), own, strict=True))
            if minimum:
                pairs = np.where(asked.counts[:, place].sum(axis=0) >= minimum, pairs, 0)
            tokens = known.tokens[m] - out * (n[words.doc] if leave_out else 0)
            loss.append(known.losses(pairs, seen, count, tokens))
        n = np.maximum(n, 1)
        mean = [np.bincount(words.doc, weights=x, minlength=words.n_docs) / n for x in loss]
        cols = [docs.column("doc_id").combine_chunks(), pa.array(words.count), *map(pa.array, (*mean, mean[0] - mean[1]))]
        flag = docs.column("is_target").combine_chunks()
        return pa.RecordBatch.from_arrays([*cols, flag], [c.split()[0] for c in OUT.split(", ")])

    return each_block(blocks.join(told, "block", "left"), rows, OUT)
