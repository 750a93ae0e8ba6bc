"""Compression of single blobs and of conversations under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tersa.config import Config
from tersa.functions.text import content_ref, marker, token_estimate
from tersa.operators import code, json_tables, logs, prose
from tersa.operators.router import like_json, of_kind


def compress_blobs(blobs: DataFrame, config: Config = Config()) -> DataFrame:
    """blob_id, content_type, ref, lossy, compressed (with its marker) for the blobs (blob_id, text, query) that a
    compressor changes; ref is null where nothing is lost. Each type is filtered before its compressor runs. Blobs of any size are
    compressed: ``max_blob_chars`` is for callers who keep large ones back."""
    given = blobs.where("text IS NOT NULL")
    part = {"json": like_json(given)} | {kind: of_kind(given, kind) for kind in ("log", "code", "text")}
    done = {
        "json": json_tables.compress(part["json"], config.json_max_rows),
        "log": logs.compress(part["log"]).withColumn("lossy", F.lit(True)),
        "code": code.compress(part["code"]).withColumn("lossy", F.lit(True)),
    }
    def known(rows: DataFrame, *more: Column) -> DataFrame:
        """What the marker says of each text, found in its row: the text itself is not carried on."""
        text = F.col("text")
        return rows.select("blob_id", "content_type", content_ref(text, config.salt).alias("ref"), token_estimate(text).alias("tokens"), *more)

    # Prose is compressed in its row: neither text nor summary is shuffled. The generator computes the summary once for filter and result.
    brief = prose.compress(part["text"], config.text_ratio)
    changed = F.filter(F.array("compressed"), lambda c: c != F.col("text"))
    brief = brief.select("blob_id", "text", "content_type", F.explode(changed).alias("compressed"))
    rows = known(brief, F.lit(True).alias("lossy"), F.col("compressed"))
    for kind, found in done.items():
        rows = rows.unionByName(known(part[kind]).join(found.where("compressed IS NOT NULL"), "blob_id"))
    mark = marker(F.col("ref"), F.col("tokens"), F.col("content_type"), config.marker_prefix)
    text = F.when(F.col("lossy"), F.concat(mark, F.lit("\n"), "compressed")).otherwise(F.col("compressed"))
    return rows.select("blob_id", "content_type", F.when(F.col("lossy"), F.col("ref")).alias("ref"), "lossy", text.alias("compressed"))


def measured(messages: DataFrame, config: Config = Config(), query: str = "", able: str | None = None) -> DataFrame:
    """Adds size, before (of the conversation), protected, query (the last user turn) and candidate to
    messages (conv_id, idx, role, content). One shuffle by conversation serves all. A given ``query`` stands for the
    last user turn; ``able`` names a flag of the messages that may change."""
    conv = Window.partitionBy("conv_id")
    rows = messages.withColumn("size", token_estimate(F.col("content")))
    rows = rows.withColumn("before", F.sum("size").over(conv)).withColumn("_n", F.max("idx").over(conv) + 1)
    rows = rows.withColumn("protected", (F.col("role") == "system") | (F.col("idx") >= F.col("_n") - config.live_messages))
    last = F.max_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("idx"))).over(conv)
    rows = rows.withColumn("query", F.lit(query) if query else F.coalesce(last, F.lit("")))
    free = (F.col(able) if able else F.lit(True)) & ~F.col("protected") & F.col("content").isNotNull() & (F.col("size") >= config.min_compress_tokens)
    return rows.withColumn("candidate", free & (F.col("before") > config.target_tokens)).drop("_n")


def compress_conversations(messages: DataFrame, config: Config = Config(), query: str = "", able: str | None = None) -> DataFrame:
    """conv_id, idx, role, content, applied, content_type, ref, saved, before, after.

    Candidates come largest first, then oldest; each is applied while the conversation is over its target, and only
    where it saves enough. What the ones before have saved is a running sum, so no loop is needed.
    """
    rows = measured(messages, config, query, able)
    key = F.struct("conv_id", "idx")
    blobs = rows.where("candidate").select(key.cast("string").alias("blob_id"), F.col("content").alias("text"), "query")
    done = compress_blobs(blobs, config)
    rows = rows.withColumn("blob_id", key.cast("string")).join(done, "blob_id", "left")
    saved = F.col("size") - token_estimate(F.col("compressed"))
    worth = F.col("candidate") & F.col("compressed").isNotNull() & (saved >= config.min_saving_tokens)
    rows = rows.withColumn("_eff", F.when(worth, saved).otherwise(0))
    order = Window.partitionBy("conv_id").orderBy(F.col("candidate").desc(), F.col("size").desc(), "idx")
    so_far = F.coalesce(F.sum("_eff").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    applied = (F.col("_eff") > 0) & (F.col("before") - so_far > config.target_tokens)
    rows = rows.withColumn("applied", applied).withColumn("saved", F.when(applied, F.col("_eff")).otherwise(0))
    rows = rows.withColumn("after", F.col("before") - F.sum("saved").over(Window.partitionBy("conv_id")))
    kept = lambda c: F.when(F.col("applied"), F.col(c))
    return rows.select(
        "conv_id", "idx", "role", F.coalesce(kept("compressed"), "content").alias("content"), "applied",
        kept("content_type").alias("content_type"), kept("ref").alias("ref"), "saved", "before", "after",
    )


def totals(compressed: DataFrame) -> DataFrame:
    """conv_id, tokens_before, tokens_after, ratio."""
    rows = compressed.groupBy("conv_id").agg(F.first("before").alias("tokens_before"), F.first("after").alias("tokens_after"))
    ratio = F.when(F.col("tokens_before") == 0, 0.0).otherwise(1.0 - F.col("tokens_after") / F.col("tokens_before"))
    return rows.withColumn("ratio", F.round(ratio, 9))
