"""BM25 of the items of one blob against a query, inside the row: no shuffle, whatever the number of blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersa.functions.text import let, stem, stems, terms

# Saturation, length weight, squash, boost of a long identifier and its least length.
K1, B, SQUASH, ID_BOOST, ID_LENGTH = 1.5, 0.75, 3.0, 0.35, 12


def counted(text: Column, asked: Column) -> Column:
    """size: how many terms a text has; tf: how often each of the stems ``asked`` is among them. A stem is the beginning of its term,
    so only terms that begin with one that is asked for are stemmed."""

    def counts(c: Column) -> Column:
        near = F.filter(c["terms"], lambda t: F.exists(c["q"], lambda q: F.startswith(t, q)))
        found = let(F.struct(F.transform(near, stem).alias("near"), c["q"].alias("q")), lambda n: F.transform(n["q"], lambda q: F.size(F.filter(n["near"], lambda t: t == q))))
        return F.struct(F.size(c["terms"]).alias("size"), found.alias("tf"))

    return let(F.struct(terms(text).alias("terms"), asked.alias("q")), counts)


def scores(docs: Column, asked: Column) -> Column:
    """Of each of ``docs`` (as ``counted`` has them) its score from 0 to 1. Rounded to 12 digits, so that the order of summation cannot
    flip a tie."""

    def weights(c: Column) -> Column:
        def weight(term: Column, i: Column) -> Column:
            df = F.size(F.filter(c["docs"], lambda d: F.get(d["tf"], i) > 0))
            long_id = (F.length(term) >= ID_LENGTH) | F.contains(term, F.lit("-"))
            return F.struct(i.alias("i"), F.log(1 + (c["n"] - df + 0.5) / (df + 0.5)).alias("idf"), long_id.alias("long"))

        return F.transform(c["q"], weight)

    def score(c: Column, all_weights: Column, doc: Column) -> Column:
        def part(x: Column) -> Column:
            tf = F.get(doc["tf"], x["i"]).cast("double")
            return x["idf"] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc["size"] / c["mean"]))

        def squashed(hits: Column) -> Column:
            raw = F.aggregate(hits, F.lit(0.0), lambda a, x: a + part(x))
            plain = 1 - F.exp(-raw / SQUASH)
            return F.round(F.when(F.exists(hits, lambda x: x["long"]), F.least(F.lit(1.0), plain + ID_BOOST)).otherwise(plain), 12)

        hit = let(F.filter(all_weights, lambda x: F.get(doc["tf"], x["i"]) > 0), squashed)
        return F.when(F.exists(doc["tf"], lambda n: n > 0), hit).otherwise(F.lit(0.0))

    def sized(c: Column) -> Column:
        total = F.aggregate(c["docs"], F.lit(0).cast("long"), lambda a, d: a + d["size"])
        n = F.size(c["docs"]).cast("double")
        mean = F.coalesce(F.nullif(total / n, F.lit(0.0)), F.lit(1.0))
        return F.struct(c["docs"].alias("docs"), c["q"].alias("q"), n.alias("n"), mean.alias("mean"))

    def every(c: Column) -> Column:
        return let(weights(c), lambda w: F.transform(c["docs"], lambda d: score(c, w, d)))

    return let(F.struct(docs.alias("docs"), asked.alias("q")), lambda c: let(sized(c), every))


def with_relevance(rows: DataFrame, items: str, query: str, out: str) -> DataFrame:
    """Adds ``out``: for each text of the array ``items`` its score from 0 to 1 against ``query``; 0 without a query."""
    asked = F.array_sort(F.array_distinct(stems(F.coalesce(F.col(query), F.lit("")))))
    parts = F.struct(F.col(items).alias("items"), asked.alias("q"))
    found = let(parts, lambda c: let(F.struct(F.transform(c["items"], lambda s: counted(s, c["q"])).alias("docs"), c["q"].alias("q")), lambda d: scores(d["docs"], d["q"])))
    return rows.withColumn(out, found)
