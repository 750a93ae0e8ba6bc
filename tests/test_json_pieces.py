"""Tables of JSON blobs in bounded memory: objects are read one at a time, rows leave in pieces."""

import json
import math
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tersa.operators import json_tables


class Frame:
    """Takes the Arrow function that an operator maps over blobs."""

    columns, dtypes = ["blob_id", "text"], [("blob_id", "int"), ("text", "string")]

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        self.run = run
        return self


def large(n):
    return json.dumps([{"key": i, "status": "P", "price": i * 1.5, "meta": {"region": "eu", "priority": f"{i % 5}-LOW"}} for i in range(n)])


def passed(operator, text, **more):
    """Rows, the rows of the largest batch, and the peak of Python's memory in bytes."""
    run = operator(Frame(), **more).run
    batch = pa.RecordBatch.from_arrays([pa.array([7], pa.int32()), pa.array([text])], ["blob_id", "text"])
    tracemalloc.start()
    try:
        sizes = [b.num_rows for b in run(iter([batch]))]
        return sum(sizes), max(sizes), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


N = 40_000
TEXT = large(N)


def test_selection_carries_no_objects(spark):
    blobs = spark.createDataFrame([(1, large(300), "price 42")], "blob_id int, text string, query string")
    assert "object" not in json_tables.pinned(json_tables.listed(blobs.select("blob_id", "text"))).columns
    rows = json_tables.chosen(blobs, 30).collect()
    assert len(rows) == 300 and {0, 1, 2, 28, 42, 298, 299} <= {r.row for r in rows if r.keep}
    assert {r.row for r in rows if r.ranked} == {28, 42} | {r.row for r in rows if r.ranked and r.score <= json_tables.STRONG}


def test_cells_leave_in_pieces():
    rows, largest, peak = passed(json_tables.cells, TEXT)
    assert rows == 5 * N and largest <= json_tables.PIECE_ROWS and peak < 25e6


def test_columns_hold_one_object_at_a_time():
    rows, _, peak = passed(json_tables.columns, TEXT)
    assert rows == 5 and peak < 3 * len(TEXT)


@pytest.mark.parametrize("values", [[random.Random(3).gauss(0, 1) for _ in range(500)], [0] * 8 + [1] * 2, [1e308] * 9, [float("nan")] * 3 + [1.0] * 9, [5] * 20 + [10**400]])
def test_outliers_as_spark_has_deviations(spark, values):
    nums = spark.createDataFrame([(i, float(v) if abs(v) < 10**300 or v != v else math.inf if v > 1e308 else float(v)) for i, v in enumerate(values)], "row int, num double").coalesce(1)
    m, s = nums.agg(F.avg("num"), F.stddev_pop("num")).first()
    text = json.dumps([{"id": f"r{i}", "v": v} for i, v in enumerate(values)])
    got = {r.row for r in json_tables.outliers(spark.createDataFrame([(1, text)], "blob_id int, text string")).collect()}
    stats = nums.where(F.lit(s) > 0).where(F.abs(F.col("num") - F.lit(m)) > 2 * F.lit(s))
    assert got == ({r.row for r in stats.collect()} if len(set(map(str, values))) > 1 else set())


def test_outliers_hold_one_object_at_a_time():
    rows, _, peak = passed(json_tables.outliers, TEXT.replace('"price": 30.0', '"price": 9e9'))
    assert rows == 1 and peak < 3 * len(TEXT)


def test_pins_come_from_rows_in_pieces():
    rows, largest, peak = passed(json_tables.listed, TEXT)
    assert rows == N and largest <= json_tables.PIECE_ROWS and peak < 4 * len(TEXT)


def test_a_large_table_is_rendered_from_objects_one_at_a_time():
    tracemalloc.start()
    out = json_tables._Profile(TEXT).rendered(None, 1_000_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.count("\n") == N + 1 and out.endswith(f"{N - 1}|{(N - 1) * 1.5}|{(N - 1) % 5}-LOW") and peak < 4 * len(TEXT)


def test_a_lossy_table_of_many_rows(spark):
    blobs = spark.createDataFrame([(1, large(3000), "")], "blob_id int, text string, query string")
    row = json_tables.tabular(blobs, 30).first()
    lines = row.compressed.split("\n")
    assert row.lossy and lines[0] == "#table cols=key|price|meta.priority rows=30of3000" and lines[-1].startswith("2999|")
    kept = [int(x.split("|")[0]) for x in lines[2:] if "|" in x]
    gaps = [int(x[2:].split(" ")[0]) for x in lines[2:] if x.startswith("…(")]
    assert len(kept) == 30 and sum(gaps) == 2970


#: Operators on texts that Spark hands to an Arrow function.
READERS = {
    "columns": json_tables.columns,
    "cells": lambda blobs: json_tables.cells(blobs, ("row", "col", "cell")),
    "pins": lambda blobs: json_tables.pinned(json_tables.listed(blobs.select("blob_id", "text"))),
    "table": lambda blobs: json_tables.tabular(blobs, 1_000_000),
    "table_lossy": lambda blobs: json_tables.tabular(blobs, 30),
}


@pytest.mark.parametrize("reader", READERS)
def test_texts_come_in_small_batches(spark, monkeypatch, reader):
    def checked(frame, run, schema, plain=DataFrame.mapInArrow):
        def small(batches):
            for b in batches:
                if b.num_rows and b.slice(0).nbytes > 15e6:
                    raise MemoryError(f"{b.nbytes} bytes in a batch")
                yield b

        return plain(frame, lambda batches: run(small(batches)), schema)

    monkeypatch.setattr(DataFrame, "mapInArrow", checked)
    blobs = spark.createDataFrame([(large(8_000), "")], "text string, query string").crossJoin(spark.range(24).withColumnRenamed("id", "blob_id")).coalesce(1)
    assert READERS[reader](blobs).select("blob_id").distinct().count() == 24


def test_pieces_of_a_text_are_put_together(spark):
    size = json_tables.PIECE_BYTES
    plain = [json.dumps([{"a": "x" * n, "b": i} for i in range(2)]) + " " * k for n in range(size // 2 - 30, size // 2 + 5) for k in range(2)]
    wide = [json.dumps([{"a": "é€😀" * n + "x" * k, "b": i} for i in range(3)], ensure_ascii=False) for n in (40, 120, 500) for k in range(4)]
    texts = [*plain, *wide, None, "", "[]", "{", "no JSON " * size]
    assert {len(t.encode()) for t in plain} >= {size - 1, size, size + 1}
    rows = spark.createDataFrame(list(enumerate(texts)), "blob_id int, text string")
    got = {(r.blob_id, r.row, r.col): r.cell for r in json_tables.cells(rows).collect()}
    assert got == {(k, i, c): str(v) for k, t in enumerate(texts[:-5]) for i, obj in enumerate(json.loads(t)) for c, v in obj.items()}
