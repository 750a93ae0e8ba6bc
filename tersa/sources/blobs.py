"""Blobs and messages from tables: the inputs of the compressors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of blobs are dealt to so many tasks at least: what a task sorts, or holds as arrays, is of few blobs.
BLOB_TASKS = 64


def by_blob(rows: DataFrame) -> DataFrame:
    """``rows``, those of a blob_id in one task."""
    return rows.repartition(max(BLOB_TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "blob_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, idx (from 0), role, content."""
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("idx"), "role", F.col("text").alias("content"))


def prose(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("blob_id"), "text", F.lit(query).alias("query"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blob_id (user_id), event_id, line: one log line for each event."""
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    line = F.concat(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z "), level, F.lit(" user="), F.col("user_id").cast("string"),
        F.lit(" "), "event_type", F.lit(" took "), F.round("value").cast("long").cast("string"), F.lit("ms props="), "props",
    )
    return table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("blob_id"), "event_id", line.alias("line"))


def log_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_blob(log_lines(spark, sf_dir)).groupBy("blob_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "line"))).alias("a"))
    return rows.select("blob_id", F.array_join(F.transform("a", lambda x: x["line"]), "\n").alias("text"))


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blob_id (customer modulo 200), row, and typed values of one object for each order."""
    rows = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 200).alias("blob_id"), "o_orderkey",
        F.struct(
            F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"),
            F.struct(F.lit("eu").alias("region"), F.col("o_orderpriority").alias("priority")).alias("meta"),
        ).alias("object"),
    )
    return rows


def json_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_blob(json_rows(spark, sf_dir)).groupBy("blob_id").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "object"))).alias("a"))
    return rows.select("blob_id", F.to_json(F.transform("a", lambda x: x["object"])).alias("text"))


def json_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of json_blobs as blob_id, text (binary, an object each), _more (the next row goes on) and _at (from 1), each blob's rows
    together and in order: a task sorts, and spills, rows of one object and never holds the arrays of its blobs."""
    rows = by_blob(json_rows(spark, sf_dir).select("blob_id", "o_orderkey", "object"))
    order = Window.partitionBy("blob_id").orderBy("o_orderkey", "object")
    at, more = F.row_number().over(order), F.lead(F.lit(True), 1, False).over(order)
    rows = rows.select("blob_id", at.alias("_at"), more.alias("_more"), "object")
    text = F.concat(F.when(F.col("_at") == 1, "[").otherwise(","), F.to_json("object"), F.when(F.col("_more"), "").otherwise("]"))
    return rows.select("blob_id", text.cast("binary").alias("text"), "_more", "_at")


def code_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blob_id, text, query: for each nation a Python module and, at blob_id + 1000, a file in a brace language."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    ident = F.regexp_replace(F.lower("n_name"), "[^a-z0-9]+", "_")
    python = F.concat(
        F.lit('"""Module."""\nimport os\nfrom sys import argv\n\nLIMIT = 10\n\nclass '), F.initcap(ident), F.lit(':\n    """Rates of a nation."""\n\n    def load(self, path):\n        """Reads a file."""\n'
        "        with open(path) as f:\n            data = f.read()\n        rows = data.split(',')\n        return rows[:LIMIT]\n\n    def cache_get(self, key):\n"
        "        value = self.cache.get(key)\n        if value is None:\n            value = self.load(key)\n            self.cache[key] = value\n        return value\n\n"
        "def main():\n    for a in argv:\n        print(os.path.basename(a))\n        print(len(a))\n        print(a.upper())\n        print('"), "n_name", F.lit("')\n"),
    )
    braces = F.concat(
        F.lit("package rates;\n\nimport java.util.List;\n\n// rates of "), "n_name", F.lit("\npublic class Rates {\n    private int base = 1;\n\n    public int load(int a) {\n        int x = a * 2;\n"
        "        for (int i = 0; i < a; i++) {\n            x += i;\n            x -= base;\n        }\n        call(x);\n        call(a);\n        return x;\n    }\n}\n"),
    )
    query = F.lit("how does the cache get a value")
    return n.select(F.col("k").alias("blob_id"), python.alias("text"), query.alias("query")).unionByName(
        n.select((F.col("k") + 1000).alias("blob_id"), braces.alias("text"), query.alias("query"))
    )
