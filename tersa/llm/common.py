"""What several operators of this subpackage share: shared folders, written tables, shard bounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local session that names none gets one made here; on a cluster each executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tersa-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_MADE: list[list[str]] = []


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/tersa/{tag}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Deletes at its end the tables that operators wrote inside it, but those whose tag is to be kept. What is lazy and reads them has
    to be written or consumed before; what an outer scope made is not touched."""
    _MADE.append([])
    try:
        yield
    finally:
        made = _MADE.pop()
        held = [p for p in made if p.rpartition("/")[2].rpartition("-")[0] in keep]
        if _MADE:
            _MADE[-1].extend(held)
        for path in set(made) - set(held):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Shuffle files of a job that has written its table go at once, not when the driver next collects its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str, *spent: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, so a lost
    executor costs a reread and not a recomputation. ``spent`` are written tables that nothing after it reads."""
    spark = df.sparkSession
    path, before = new_path(spark, tag), spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE, before)
    discard(*spent)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of written tables, and no others."""
    for table in tables:
        spark = table.sparkSession
        for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getParent().getName() == "tersa":
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Ranges:
    """Near-equal ranges of ascending ``key``, nulls first, at most ``n`` and a few.

    A distributed quantile sketch finds the cuts; ``n`` follows the number of shuffle partitions, so what the driver holds has
    a known size. Nulls, and a key so frequent that it would fill ranges of its own, are split further by a 64-bit
    ``tie``, which is only worked out (``ties``) where that happens. Equal rows stay together.
    """

    def __init__(self, df: DataFrame, key: str, n: int, tie: Column):
        rows = df.select(F.col(key).cast("long").alias(key))
        count, known = rows.agg(F.count("*"), F.count(key)).first()
        cuts = rows.approxQuantile(key, [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 and known else []
        self.ids = np.sort(np.array(cuts, dtype=np.int64))
        again = np.concatenate([[0], np.cumsum(self.ids[1:] == self.ids[:-1])]) if len(self.ids) else np.array([], dtype=np.int64)
        new = np.searchsorted(self.ids, self.ids)  # the first cut of each key
        turn = np.arange(len(self.ids)) - new
        times = np.searchsorted(self.ids, self.ids, side="right") - new
        self.hashes = np.array([-(1 << 63) + (int(t) << 64) // int(k) for t, k in zip(turn, times, strict=True)], dtype=np.int64)
        self.nulls = max(1, -(-(count - known) * n // max(count, 1)))
        self.ties = tie if self.nulls > 1 or again.any() else F.lit(0).cast("long")

    def __getstate__(self) -> dict:
        """What goes to the workers: all but the column."""
        return {k: v for k, v in self.__dict__.items() if k != "ties"}

    def of(self, ids: pa.Array, ties: pa.Array) -> np.ndarray:
        """The number of the range of each row."""
        none = ids.is_null().to_numpy(zero_copy_only=False)
        own, tie = ids.fill_null(0).to_numpy(), ties.to_numpy()
        low, high = np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, side="right")
        place = self.nulls + high
        for i in np.flatnonzero((high - low > 1) & ~none):
            place[i] = self.nulls + low[i] + np.searchsorted(self.hashes[low[i] : high[i]], tie[i], side="right")
        place[none] = [((int(t) + (1 << 63)) * self.nulls) >> 64 for t in tie[none]]
        return place


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads, so that further ones cannot clash with its own."""
    return df.select(*[df[n] for n in names])
