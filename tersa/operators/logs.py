"""Log compression: lines by template, repeated templates once with a count, salient lines as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersa.functions.text import lines, mask, salience

# The salience that keeps a line, and how often a template collapses.
SALIENT, REPEATS = 0.6, 3


def numbered(blobs: DataFrame) -> DataFrame:
    """blob_id, idx, line, salient for every line that is not blank."""
    rows = blobs.select("blob_id", F.posexplode(lines(F.col("text"))).alias("idx", "line")).where(F.col("line").rlike(r"(?U)\S"))
    return rows.withColumn("salient", salience(F.col("line")) >= SALIENT)


def groups(rows: DataFrame) -> DataFrame:
    """blob_id, template, n, first_idx, first_line, last_line of the other lines."""
    masked = rows.where(~F.col("salient")).withColumn("template", mask(F.col("line")))
    return masked.groupBy("blob_id", "template").agg(
        F.count("*").alias("n"),
        F.min("idx").alias("first_idx"),
        F.min_by("line", "idx").alias("first_line"),
        F.max_by("line", "idx").alias("last_line"),
    )


def compress(blobs: DataFrame) -> DataFrame:
    """blob_id, compressed for blobs (blob_id, text)."""
    rows = numbered(blobs)
    found = groups(rows)
    none = F.array().cast("array<string>")
    few = F.when(F.col("n") == 2, F.array("first_line", "last_line")).otherwise(F.array("first_line"))
    many = F.array(
        F.concat("template", F.lit("   [x"), F.col("n").cast("string"), F.lit("]")), F.concat(F.lit("  e.g. "), "first_line")
    )
    events = found.select(
        "blob_id", F.col("first_idx").alias("idx"), F.when(F.col("n") < REPEATS, few).otherwise(many).alias("out"), F.lit(0).alias("kept")
    ).unionByName(rows.where("salient").select("blob_id", "idx", F.array("line").alias("out"), F.lit(1).alias("kept")))
    body = events.groupBy("blob_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "out"))), lambda e: e["out"])).alias("body"),
        F.sum("kept").alias("kept"),
        F.sum(1 - F.col("kept")).alias("patterns"),
    )
    sized = blobs.select("blob_id", F.size(lines(F.col("text"))).alias("total")).join(body, "blob_id", "left")
    body, kept, patterns = F.coalesce("body", none), F.coalesce("kept", F.lit(0)), F.coalesce("patterns", F.lit(0))
    head = F.format_string(
        "[log summary: %d lines -> %d shown; %d unique patterns; %d error/warn lines kept verbatim]",
        F.col("total").cast("long"), F.size(body).cast("long"), patterns.cast("long"), kept.cast("long"),
    )
    return sized.select("blob_id", F.concat(head, F.lit("\n"), F.array_join(body, "\n")).alias("compressed"))
