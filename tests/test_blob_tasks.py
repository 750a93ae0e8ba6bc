"""A task sorts, or holds as arrays, rows of few blobs, however few shuffle partitions there are."""

import json

from pyspark.sql import functions as F

from tersa.operators import json_tables
from tersa.plans import catalog

BLOBS = 60


def most_in_a_task(rows):
    tasks = rows.select("blob_id", F.spark_partition_id().alias("task")).distinct().groupBy("task").count()
    return tasks.agg(F.max("count"), F.sum("count")).first()


def test_a_selection_is_dealt_by_few_blobs(spark):
    text = json.dumps([{"key": i, "status": "P", "price": i * 1.5} for i in range(40)])
    blobs = spark.createDataFrame([(k, text, "price 42") for k in range(BLOBS)], "blob_id int, text string, query string")
    most, every = most_in_a_task(json_tables.chosen(blobs, 30))
    assert every == BLOBS and most <= 10


def test_lossy_tables_come_of_few_blobs_a_task(spark, tmp_path):
    rows = [(i, i % BLOBS, "P", float(i), f"{i % 5}-LOW") for i in range(BLOBS * 40)]
    names = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/orders.parquet")
    found = catalog.json_table_lossy(spark, str(tmp_path))
    most, every = most_in_a_task(found)
    assert every == BLOBS and most <= 10
    assert "collect_list(struct(o_orderkey" not in found._jdf.queryExecution().toString()
