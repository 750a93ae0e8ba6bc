"""Each line is made once in a pass over the texts, and the rows of bands are dealt once."""

import re

from pyspark.sql import functions as F

from tersa.llm import line_dedup


def plain(text):
    """Lines as they are compared, with their places."""
    found = [re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower() for x in text.split("\n")]
    return {(i, x) for i, x in enumerate(found) if x}


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_as_before(spark):
    texts = ["A  b\tC\n \t\x0b\n\nÉcole  Straße\r\n İI ΑΣ\nΣΑΣ ", "\n\n", "", "\x0c\r\t ", "x  Y z\n　", "one\ttwo\n ONE two \n" + "Q" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in line_dedup.lines_of(docs).collect():
        got.setdefault(r.doc, set()).add((r.place, r.line))
    assert got == {i: plain(t) for i, t in enumerate(texts) if plain(t)}


def test_a_line_is_made_once(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert planned(line_dedup.lines_of(docs)).count("regexp_replace") == 1


def test_least_hashes_are_of_every_shingle(spark):
    texts = ["ab", "abcdefghi", *["".join(chr(97 + (7 * i * i + i) % 26) for i in range(n)) for n in range(9, 30)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc: [r[f"m{k}"] for k in range(line_dedup.ROWS)] for r in line_dedup.marked(docs).collect()}
    lines = line_dedup.lines_of(docs).select("doc", F.explode(line_dedup._hashes(F.col("line"))).alias("h"))
    least = [F.min(line_dedup._flipped(line_dedup._turned(F.col("h"), k), k)).alias(f"m{k}") for k in range(line_dedup.ROWS)]
    assert got == {r.doc: [r[f"m{k}"] for k in range(line_dedup.ROWS)] for r in lines.groupBy("doc").agg(*least).collect()}


def test_parities_are_of_the_set(spark):
    line = "abcabcabcabc abcabcabcabc the rest of it differs" * 3
    docs = spark.createDataFrame([(1, line), (2, "short")], "doc_id long, text string")
    keys = line_dedup.lines_of(docs).select(F.lit(1).cast("long").alias("hub"), F.xxhash64("line").alias("key"))
    for r in line_dedup.near_lines(docs, keys).collect():
        own = spark.createDataFrame([(r.line,)], "line string").select(F.explode(F.array_distinct(line_dedup._hashes(F.col("line")))).alias("h"))
        hashes = [x.h for x in own.collect()]
        words = [0] * line_dedup.PARITIES
        for h in hashes:
            words[(h >> 6) % line_dedup.PARITIES] ^= 1 << (h & 63)
        assert r.n == len(hashes) and [r[f"p{k}"] % (1 << 64) for k in range(line_dedup.PARITIES)] == words


def test_bands_are_dealt_once(spark):
    docs = spark.createDataFrame([(i, f"a line that is much like the others, number {i}") for i in range(40)], "doc_id long, text string")
    meets = line_dedup.meetings(line_dedup.marked(docs))
    assert meets.count() > 40
    plan = meets._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(band" in plan and "ShuffledHashJoin" in plan
