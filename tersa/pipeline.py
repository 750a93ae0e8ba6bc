"""The public entry point: a pipeline over DataFrames of messages or blobs, with a store of originals.

    pipe = Pipeline(spark, Config(target_tokens=400), store_path)
    done = pipe.compress(messages)            # conv_id, idx, role, content -> compressed, originals stored first
    done.totals                               # tokens before and after, ratio
    pipe.retrieve(refs)                       # the originals, byte for byte

``compress_messages`` and ``compress_blob`` take and return Python values, for one conversation or text at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tersa.config import Config
from tersa.functions.text import is_ref, token_estimate
from tersa.operators import budget
from tersa.sources import store


@dataclass
class Compressed:
    messages: DataFrame
    transforms: DataFrame
    totals: DataFrame


@dataclass
class Result:
    """One conversation: its messages, what was done to them, and its tokens."""

    messages: list[dict[str, Any]]
    tokens_before: int
    tokens_after: int
    transforms: list[dict[str, Any]]

    @property
    def savings_ratio(self) -> float:
        return 1.0 - self.tokens_after / self.tokens_before if self.tokens_before else 0.0


def content_text(content: Any) -> str:
    """Text as it is; of a list of blocks their texts, by lines; nothing for None."""
    if isinstance(content, list):
        return "\n".join(str(b.get("text") or "") for b in content if isinstance(b, dict))
    return "" if content is None else str(content)


class Pipeline:
    """``store_path``: a folder of the store; each call adds to it, readers keep the latest entry of a reference. Without one the
    pipeline keeps originals in a folder of its own, in the one that driver and executors share (spark.checkpoint.dir), so whatever
    a marker names can be had back. Contents of more than ``max_blob_chars`` come back as they are; only this interface keeps them back,
    the operators compress them too."""

    def __init__(self, spark: SparkSession, config: Config | None = None, store_path: str | None = None, ttl_seconds: float = store.TTL_SECONDS, key: bytes | None = None, cipher: store.Cipher | None = None):
        self.spark, self.config, self.path, self.ttl, self.key = spark, config or Config(), store_path or store.own_folder(spark), ttl_seconds, key
        self.cipher = cipher
        self.tokens_in = self.tokens_out = 0

    def _small(self, text: str) -> Column:
        return F.coalesce(F.length(text) <= self.config.max_blob_chars, F.lit(True))

    def _put(self, originals: DataFrame) -> None:
        """Stores originals (text) before anything that names them is returned."""
        store.private(self.spark, self.path)
        store.put(store.entries(originals.distinct(), F.current_timestamp(), self.config.salt, self.key, self.cipher), self.path)

    def compress(self, messages: DataFrame) -> Compressed:
        """messages: conv_id, idx (from 0), role, content. Only rows that are applied reach the store."""
        done = budget.compress_conversations(messages.withColumn("_small", self._small("content")), self.config, able="_small").persist()
        applied = done.where("applied")
        lost = applied.where("ref IS NOT NULL").select("conv_id", "idx").join(messages, ["conv_id", "idx"])
        self._put(lost.select(F.col("content").alias("text")))
        transforms = applied.select("conv_id", "idx", "content_type", "ref", F.col("ref").isNotNull().alias("lossy"), F.col("saved").alias("tokens_saved"))
        return Compressed(done.select("conv_id", "idx", "role", "content"), transforms, budget.totals(done))

    def compress_blobs(self, blobs: DataFrame) -> DataFrame:
        """blobs: blob_id, text, query. All of them, changed or not, as blob_id, compressed; there is no guard on gain."""
        done = budget.compress_blobs(blobs.where(self._small("text")), self.config).persist()
        self._put(blobs.join(done.where("lossy").select("blob_id"), "blob_id").select("text"))
        return blobs.join(done.select("blob_id", "compressed"), "blob_id", "left").select("blob_id", F.coalesce("compressed", "text").alias("compressed"))

    def retrieve(self, refs: DataFrame, touch: bool = False) -> DataFrame:
        """Only entries that are asked for, in the folders of their shards, are read and merged. Each entry found counts as used just
        now: it is put again, so that the time to live and the bound by recency run from its last use."""
        if not store.exists(self.spark, self.path):
            return refs.withColumn("text", F.lit(None).cast("string"))
        asked = refs.where(is_ref(F.col("ref"))).select("ref", F.substring("ref", 1, 2).alias("shard")).distinct()
        rows = store.load(self.spark, self.path).join(asked, ["shard", "ref"], "left_semi").drop("shard")
        found = store.retrieve(refs, store.merged(rows.limit(0), rows), F.current_timestamp(), self.ttl, self.key, self.cipher)
        if touch:
            self._put(found.where("text IS NOT NULL").select("text"))
        return found

    def purge(self) -> None:
        """Rewrites the store without expired entries and with one entry a reference; the old folder goes when the new one is whole."""
        if store.exists(self.spark, self.path):
            store.compact(self.spark, self.path, F.current_timestamp(), self.ttl)

    def compress_messages(self, messages: list[dict[str, Any]], query: str = "") -> Result:
        """Blocks count but stay as they are; further keys of a message stay too."""
        rows = [(0, i, m.get("role"), content_text(m.get("content")), isinstance(m.get("content"), str)) for i, m in enumerate(messages)]
        frame = self.spark.createDataFrame(rows, "conv_id int, idx int, role string, content string, plain boolean")
        frame = frame.withColumn("able", F.col("plain") & self._small("content"))
        done = budget.compress_conversations(frame, self.config, query=query, able="able").persist()
        self._put(done.where("ref IS NOT NULL").select("idx").join(frame, "idx").select(F.col("content").alias("text")))
        out, transforms, before, after = [dict(m) for m in messages], [], 0, 0
        rows = done.orderBy("idx").collect()
        done.unpersist()
        for r in rows:
            before, after = r.before, r.after
            if r.applied:
                out[r.idx]["content"] = r.content
                transforms.append({"content_type": r.content_type, "ref": r.ref, "lossy": r.ref is not None, "message_index": r.idx, "tokens_saved": r.saved})
        return Result(out, before, after, transforms)

    def compress_blob(self, text: str, query: str = "") -> str:
        frame = self.spark.createDataFrame([(0, text, query)], "blob_id int, text string, query string")
        row = self.compress_blobs(frame).withColumn("a", token_estimate(F.lit(text))).withColumn("b", token_estimate(F.col("compressed"))).first()
        self.tokens_in, self.tokens_out = self.tokens_in + row.a, self.tokens_out + row.b
        return row.compressed

    def retrieve_one(self, ref: str) -> str | None:
        return self.retrieve(self.spark.createDataFrame([(str(ref),)], "ref string"), touch=True).first().text

    def stats(self) -> str:
        saved = self.tokens_in - self.tokens_out
        pct = saved / self.tokens_in * 100 if self.tokens_in else 0.0
        return f"tokens in: {self.tokens_in:,} | out: {self.tokens_out:,} | saved: {saved:,} ({pct:.0f}%)"

