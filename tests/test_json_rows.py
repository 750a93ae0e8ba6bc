"""JSON queries whose texts come as rows of one object: no task holds the arrays of its blobs."""

import pytest
from pyspark.sql import functions as F

from tersa.plans import catalog
from tersa.sources import blobs

SF = "/root/testdata/sf0.01"


def test_rows_of_objects_make_the_texts_of_blobs(spark):
    rows = blobs.json_pieces(spark, SF).groupBy("blob_id").agg(F.array_sort(F.collect_list(F.struct("_at", "text", "_more"))).alias("a"))
    whole = F.array_join(F.transform("a", lambda x: x["text"].cast("string")), "").alias("whole")
    ends = F.size(F.filter("a", lambda x: ~x["_more"])).alias("ends")
    both = blobs.json_blobs(spark, SF).join(rows.select("blob_id", whole, ends), "blob_id", "full")
    assert both.count() == 200 and both.where("text <=> whole AND ends = 1").count() == 200


@pytest.mark.parametrize("query", ["json_cells", "json_pins", "json_table"])
def test_no_arrays_of_blobs(spark, query):
    df = catalog.QUERIES[query](spark, SF)
    assert "json_blobs" not in catalog.QUERIES[query].__code__.co_names
    assert "collect_list(struct(o_orderkey" not in df._jdf.queryExecution().optimizedPlan().toString()
