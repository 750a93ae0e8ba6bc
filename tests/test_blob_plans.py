"""Blobs of several kinds: prose is compressed in its row, and kinds are told the same way everywhere."""

import json

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tersa.config import Config
from tersa.operators import budget
from tersa.operators.router import of_kind, routed

LOG = "\n".join(f"2026-07-19T10:00:{i:02d}Z INFO GET /api/users/{i} 200" for i in range(20))
CODE = "import os\n\n" + "\n".join(f"def f{i}(x):\n    y = x + {i}\n    return y\n" for i in range(6))
TEXTS = ["One line here. " * 9, LOG, CODE, json.dumps([{"a": i, "b": 1} for i in range(50)]), "[not json", "", None, "INFO 10:20:30 once\n" + "Plain words. " * 20, "a\x0b" * 12, "{" * 30]


def test_kinds_are_those_of_the_router(spark):
    blobs = spark.createDataFrame(list(enumerate(TEXTS)), "blob_id int, text string")
    want = {r.blob_id: r.content_type for r in routed(blobs).collect()}
    got = [(r.blob_id, r.content_type) for kind in ("json", "log", "code", "text") for r in of_kind(blobs, kind).collect()]
    assert len(got) == len(TEXTS) and dict(got) == want and set(want.values()) == {"json", "log", "code", "text"}


def test_prose_is_neither_joined_nor_computed_twice(spark):
    blobs = spark.createDataFrame([(i, t, "words") for i, t in enumerate(TEXTS)], "blob_id int, text string, query string")
    done = budget.compress_blobs(blobs)
    plan = done._jdf.queryExecution().optimizedPlan()
    prose = next(p for p in (plan.children().apply(i) for i in range(plan.children().size())) if "Join" not in p.toString())
    assert prose.toString().count("Generate explode") == 1
    assert {(r.blob_id, r.content_type) for r in done.select("blob_id", "content_type").where(F.col("lossy")).collect()} >= {(1, "log"), (2, "code"), (3, "json")}


def test_no_kind_is_told_from_large_batches(spark, monkeypatch):
    """Parsers get large texts that begin like JSON in pieces, not some thousand whole ones at a time."""

    def checked(frame, run, schema, plain=DataFrame.mapInArrow):
        def small(batches):
            for b in batches:
                if b.num_rows and b.nbytes > 15e6:
                    raise MemoryError(f"{b.nbytes} bytes in a batch")
                yield b

        return plain(frame, lambda batches: run(small(batches)), schema)

    monkeypatch.setattr(DataFrame, "mapInArrow", checked)
    table = json.dumps([{"a": i, "b": "x" * 90} for i in range(10_000)])
    odd, minor = table[:-1] + "x]", json.dumps(list(range(150_000)))
    texts = spark.createDataFrame([(t, "") for t in (table, odd, minor)], "text string, query string")
    blobs = texts.crossJoin(spark.range(8)).coalesce(1).withColumn("blob_id", F.monotonically_increasing_id())
    done = budget.compress_blobs(blobs, Config(max_blob_chars=10**9))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan
    got = done.groupBy("content_type", "lossy").count().collect()
    assert {(r.content_type, r.lossy): r["count"] for r in got if r.content_type == "json"} == {("json", True): 8, ("json", False): 8}
