"""Content type of a text: JSON, then log, then code, and prose for the rest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tersa.functions.text import LOG_LEVEL, TIMESTAMP, let, lines
from tersa.operators.code import looks_like_code
from tersa.operators.json_tables import parses, unparsed

# Least lines of a log, lines probed, least share of them with a timestamp or level.
LOG_LINES, LOG_PROBED, LOG_SHARE = 10, 50, 0.4


def looks_like_log(text: Column) -> Column:
    def shaped(full: Column) -> Column:
        def hit(probe: Column) -> Column:
            return F.size(F.filter(probe, lambda s: s.rlike(TIMESTAMP) | s.rlike(LOG_LEVEL))) >= F.size(probe) * LOG_SHARE

        return (F.size(full) >= LOG_LINES) & let(F.slice(full, 1, LOG_PROBED), hit)

    # A line with a timestamp or level has two colons or a level's word; of other texts no line is looked at.
    maybe = text.like("%:__:%")
    for word in ("INFO", "DEBUG", "WARN", "ERROR", "FATAL", "TRACE"):
        maybe = maybe | F.contains(text, F.lit(word))
    return F.when(maybe, let(F.filter(lines(text), lambda s: s.rlike(r"(?U)\S")), shaped)).otherwise(False)


@F.pandas_udf(BooleanType())
def _parses(texts: pd.Series) -> pd.Series:
    return texts.map(parses).astype(bool)


def _begins(text: Column) -> Column:
    return text.rlike(r"(?U)\A\s*[\[{]")


def is_json(text: Column) -> Column:
    """Only texts that begin like JSON travel to the parser, which decides, in Arrow batches; the row stays where it is."""
    return F.coalesce(_begins(text) & _parses(F.when(_begins(text), text)), F.lit(False))


def routed(blobs: DataFrame) -> DataFrame:
    """Adds content_type to blobs (blob_id, text); a null text is prose."""
    text = F.coalesce("text", F.lit(""))
    kind = F.when(is_json(text), "json").when(looks_like_log(text), "log").when(looks_like_code(text), "code").otherwise("text")
    return blobs.withColumn("content_type", kind)


def like_json(blobs: DataFrame) -> DataFrame:
    """The blobs whose text begins like JSON: those of content_type json, and others that the JSON compressor leaves out."""
    return blobs.where(_begins(F.coalesce("text", F.lit("")))).withColumn("content_type", F.lit("json"))


def of_kind(blobs: DataFrame, kind: str) -> DataFrame:
    """The blobs of one content_type, as ``routed`` has it. What built-in expressions can tell comes first, so that few others are
    looked at any further; texts that begin like JSON go to the parser in pieces, and those that are none come back."""
    text = F.coalesce("text", F.lit(""))
    if kind == "json":
        return like_json(blobs).where(is_json(text))
    log, code, begins = looks_like_log(text), looks_like_code(text), _begins(text)
    told = {"log": log, "code": code & ~log, "text": ~log & ~code}[kind]
    rows = blobs.where(~begins & told).unionByName(unparsed(blobs.where(begins & told)))
    return rows.withColumn("content_type", F.lit(kind))
