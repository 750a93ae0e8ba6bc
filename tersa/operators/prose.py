"""Extractive compression of prose: the best sentences by relevance, salience and position, in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersa.functions.text import let, salience, sentences
from tersa.operators.relevance import with_relevance


def omitted(n: Column) -> Column:
    return F.concat(F.lit("[…"), n.cast("string"), F.lit(" sentence"), F.when(n > 1, "s").otherwise(""), F.lit(" omitted…]"))


def scored(blobs: DataFrame) -> DataFrame:
    """Adds sents and scores (arrays) to blobs (text, query)."""
    rows = with_relevance(blobs.withColumn("sents", sentences(F.col("text"))), "sents", "query", "_rel")

    def scores(pairs: Column) -> Column:
        def score(p: Column, i: Column) -> Column:
            zero = F.lit(0.0)
            lead = F.greatest(zero, 1.0 - i / 3.0) * 0.2
            recency = F.greatest(zero, 1.0 - (F.size(pairs) - 1 - i) / 3.0) * 0.2
            return F.lit(0.6) * p["_rel"] + F.lit(0.35) * salience(p["sents"]) + lead + recency

        return F.transform(pairs, score)

    return rows.withColumn("scores", let(F.arrays_zip("sents", "_rel"), scores)).drop("_rel")


def selected(blobs: DataFrame, ratio: float) -> DataFrame:
    """Adds kept: ascending places of the sentences that stay; all of them where there are three or fewer."""
    rows = scored(blobs)
    n = F.size("sents")
    quota = F.greatest(F.lit(3), F.floor(n * F.lit(ratio)).cast("int"))
    ranked = F.reverse(F.array_sort(F.transform("scores", lambda s, i: F.struct(s.alias("s"), i.alias("i")))))
    best = F.array_sort(F.transform(F.slice(ranked, 1, quota), lambda x: x["i"]))
    every = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1))
    return rows.withColumn("kept", F.when(n <= 3, every).otherwise(best))


def _rendered(c: Column) -> Column:
    """Kept sentences with a note in the place of each gap; c: sents and kept."""
    kept, sents = c["kept"], c["sents"]

    def part(i: Column, j: Column) -> Column:
        gap = i - F.when(j == 0, F.lit(-1)).otherwise(F.get(kept, j - 1)) - 1
        return F.when(gap > 0, F.array(omitted(gap), F.get(sents, i))).otherwise(F.array(F.get(sents, i)))

    tail = F.size(sents) - 1 - F.get(kept, F.size(kept) - 1)
    rest = F.when(tail > 0, F.array(omitted(tail))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.flatten(F.transform(kept, part)), rest), "\n")


def compress(blobs: DataFrame, ratio: float) -> DataFrame:
    """Adds compressed to blobs (text, query); the text itself where there are three sentences or fewer."""
    rows = selected(blobs, ratio)
    text = F.when(F.size("sents") <= 3, F.col("text")).otherwise(let(F.struct("sents", "kept"), _rendered))
    return rows.withColumn("compressed", text).drop("sents", "scores", "kept")
