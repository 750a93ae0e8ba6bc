"""The store of originals: content-addressed rows (ref, payload, stored_at) as Parquet, by the first two digits of ref."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tersa.functions.text import content_ref, is_ref

SCHEMA = "ref string, payload binary, stored_at timestamp"
TTL_SECONDS = 6 * 3600


#: What is done to a payload before it is stored, and what undoes it: expressions of a binary column.
Cipher = tuple[Callable[[Column], Column], Callable[[Column], Column]]


def aes(key: bytes) -> Cipher:
    """AES-GCM."""
    return (lambda c: F.aes_encrypt(c, F.lit(key))), (lambda c: F.aes_decrypt(c, F.lit(key)))


def _cipher(key: bytes | None, cipher: Cipher | None) -> Cipher:
    return cipher or (aes(key) if key else ((lambda c: c), (lambda c: c)))


def entries(originals: DataFrame, now: Column, salt: str = "", key: bytes | None = None, cipher: Cipher | None = None) -> DataFrame:
    """Rows to store for originals (text); payloads go through a cipher: AES with a key, or a pair of one's own."""
    held = _cipher(key, cipher)[0](F.col("text").cast("binary"))
    return originals.select(content_ref(F.col("text"), salt).alias("ref"), held.alias("payload"), now.cast("timestamp").alias("stored_at"))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: the latest entry of each ref. A partial aggregate, so copies meet before they shuffle."""
    rows = old.unionByName(new)
    return rows.groupBy("ref").agg(F.max_by("payload", "stored_at").alias("payload"), F.max("stored_at").alias("stored_at"))


def live(store: DataFrame, now: Column, ttl_seconds: float = TTL_SECONDS) -> DataFrame:
    return store.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros("stored_at") <= int(ttl_seconds * 1_000_000))


def newest(store: DataFrame, capacity: int, by: str = "stored_at") -> DataFrame:
    """The ``capacity`` entries used last. Top-k, not a global window: each task keeps its own best first."""
    return store.orderBy(F.desc(by), "ref").limit(capacity)


def newest_of_each(store: DataFrame, tenant: str, capacity: int, by: str = "stored_at") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(tenant).orderBy(F.desc(by), "ref"))
    return store.withColumn("_r", rank).where(F.col("_r") <= capacity).drop("_r")


def retrieve(refs: DataFrame, store: DataFrame, now: Column, ttl_seconds: float = TTL_SECONDS, key: bytes | None = None, cipher: Cipher | None = None) -> DataFrame:
    """refs (ref, anything) with text: null for a malformed, unknown or expired one."""
    found = live(store, now, ttl_seconds).select("ref", "payload")
    asked = refs.withColumn("_ok", is_ref(F.col("ref")))
    payload = _cipher(key, cipher)[1](F.col("payload"))
    joined = asked.join(found, (asked["ref"] == found["ref"]) & F.col("_ok"), "left")
    return joined.select(*[asked[c] for c in refs.columns], payload.cast("string").alias("text"))


def save(store: DataFrame, path: str) -> None:
    store.withColumn("shard", F.substring("ref", 1, 2)).write.mode("overwrite").partitionBy("shard").parquet(path)


def put(rows: DataFrame, path: str) -> None:
    """Adds rows to the store."""
    rows.withColumn("shard", F.substring("ref", 1, 2)).write.mode("append").partitionBy("shard").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Reads prune to the shard of a ref where the query names it."""
    return spark.read.schema(f"{SCHEMA}, shard string").parquet(path)


def own_folder(spark: SparkSession) -> str:
    """A new folder where the driver and all executors can write: in spark.checkpoint.dir, or, in a local session that names none, in a
    temporary folder that only its owner can read."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("give a store path, or name a shared folder in spark.checkpoint.dir")
        root = f"file://{tempfile.mkdtemp(prefix='originals-')}"
    return f"{root.rstrip('/')}/originals-{uuid.uuid4().hex}"


def written(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` as a Parquet table at ``path``, for what reads them many times. A page ends with the text that fills it; by default it
    would hold a hundred, however large."""
    rows.write.option("parquet.page.size.row.check.min", 1).option("parquet.page.size.row.check.max", 100).option("parquet.enable.dictionary", "false").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def private(spark: SparkSession, path: str) -> None:
    """Makes the folder of a store, where there is none, for its owner only."""
    files, at = _files(spark, path)
    if not files.exists(at):
        files.mkdirs(at)
        files.setPermission(at, spark._jvm.org.apache.hadoop.fs.permission.FsPermission("700"))


def compact(spark: SparkSession, path: str, now: Column, ttl_seconds: float = TTL_SECONDS) -> None:
    """The live entries, the latest of each reference, take the place of all of them."""
    rows = load(spark, path).drop("shard")
    private(spark, f"{path}.new")
    put(live(merged(rows.limit(0), rows), now, ttl_seconds), f"{path}.new")
    files, at = _files(spark, path)
    _, new = _files(spark, f"{path}.new")
    files.delete(at, True)
    files.rename(new, at)
    spark.catalog.refreshByPath(path)
