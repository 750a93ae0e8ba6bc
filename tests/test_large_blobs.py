"""Blobs of any size are compressed by the operators; only the public pipeline keeps large ones back."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tersa.config import Config
from tersa.functions import text as T
from tersa.operators import budget
from tersa.pipeline import Pipeline
from tersa.plans import catalog
from tersa.sources import blobs as sources

LOG = "\n".join(f"2026-07-19T10:00:{i:02d}Z INFO GET /api/users/{i} 200" for i in range(40))
CODE = "import os\n\n" + "\n".join(f"def f{i}(x):\n    y = x + {i}\n    z = y * y\n    return z\n" for i in range(40))
TEXTS = {"text": "One line here. " * 90, "log": LOG, "code": CODE, "json": json.dumps([{"a": i, "b": 1} for i in range(90)])}


def blobs(spark, texts):
    return spark.createDataFrame([(k, t, "") for k, t in texts.items()], "blob_id string, text string, query string")


def test_size_decides_on_no_blob(spark):
    assert min(map(len, TEXTS.values())) > 1000
    found = [budget.compress_blobs(blobs(spark, TEXTS), c).orderBy("blob_id").collect() for c in (Config(), Config(max_blob_chars=1000))]
    assert found[0] == found[1] and [r.blob_id for r in found[1]] == ["code", "json", "log", "text"] and all(r.lossy for r in found[1])


def test_a_large_log_is_compressed(spark):
    large = "\n".join(f"2026-07-19T10:00:00Z INFO request {i} {'took its time ' * 200}" for i in range(3200))
    assert len(large) > Config().max_blob_chars
    (row,) = budget.compress_blobs(blobs(spark, {"log": large})).collect()
    assert row.content_type == "log" and row.lossy and len(row.compressed) < 0.01 * len(large) and "[x3200]" in row.compressed


def test_the_pipeline_keeps_large_blobs_back(spark, tmp_path):
    small = {"small": LOG[:900]}
    pipe = Pipeline(spark, Config(max_blob_chars=1000, target_tokens=9, live_messages=0, min_compress_tokens=9, min_saving_tokens=9), f"file://{tmp_path}/store")
    done = {r.blob_id: r.compressed for r in pipe.compress_blobs(blobs(spark, TEXTS | small)).collect()}
    assert all(done[k] == t for k, t in TEXTS.items()) and done["small"] != small["small"]
    said = [{"role": "tool", "content": t} for t in (LOG, small["small"])]
    out = pipe.compress_messages(said)
    assert out.messages[0] == said[0] and [t["message_index"] for t in out.transforms] == [1]
    rows = [(1, i, m["role"], m["content"]) for i, m in enumerate(said)]
    frames = pipe.compress(spark.createDataFrame(rows, "conv_id int, idx int, role string, content string"))
    assert [r.idx for r in frames.transforms.collect()] == [1] and frames.messages.columns == ["conv_id", "idx", "role", "content"]


@pytest.mark.parametrize("text", ["", " \n\x0b\x85 ", "a" * 6 + " " + "b" * 7 + "_", "é漢!😀,x 12", "word, word. " * 99, None])
def test_tokens_are_counted_without_an_array_of_pieces(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(T.token_estimate(F.col("t")).alias("n"))
    pieces = re.findall(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]", text or "")
    parts = sum(1 + (len(p) - 1) // 6 for p in pieces)
    assert row.first().n == (max(1, parts * 3 // 4, len(text) // 4) if text else 0)
    assert "regexp_extract_all" not in row._jdf.queryExecution().optimizedPlan().toString()


def test_no_text_is_joined_with_its_summary(spark):
    """References and token counts are found where a text is read, so joins carry them and not the text."""
    stack, joined = [budget.compress_blobs(blobs(spark, TEXTS))._jdf.queryExecution().optimizedPlan()], []
    while stack:
        p = stack.pop()
        below = [p.children().apply(i) for i in range(p.children().size())]
        stack += below
        if p.nodeName() == "Join" and "compressed#" in p.output().toString():
            joined.append(p.output().toString())
    assert len(joined) == 3 and all("tokens#" in x and "text#" not in x for x in joined)


def test_the_texts_of_a_roundtrip_are_made_once(spark):
    done = catalog.mixed_roundtrip(spark, "/root/testdata/sf0.001")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" not in plan
    assert done.where("md5 IS NULL").count() == 0


@pytest.mark.parametrize("made", [sources.log_blobs, sources.json_blobs])
def test_texts_are_made_of_few_blobs_a_task(spark, made):
    rows = made(spark, "/root/testdata/sf0.01")
    tasks = rows.select(F.spark_partition_id().alias("task")).groupBy("task").count().agg(F.max("count"), F.sum("count")).first()
    assert tasks[0] <= 12 and tasks[1] >= 40
