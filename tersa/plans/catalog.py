"""The queries over the compressor's operators: one a name, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tersa.config import Config
from tersa.functions import text as T
from tersa.operators import budget, code, json_tables, logs, prose
from tersa.operators.relevance import with_relevance
from tersa.operators.router import routed
from tersa.sources import blobs, store
from tersa.streaming import templates

QUERY = "the nation of Théreies entution and estoreing overlyinganen"
SMALL = Config(target_tokens=400, live_messages=2, min_compress_tokens=64, min_saving_tokens=16)
NOW = "2026-01-01 12:00:00"

Query = Callable[[SparkSession, str], DataFrame]


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.table(spark, sf_dir, "documents").select("doc_id", "text")


def token_estimate(spark, d):
    return docs(spark, d).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


def conv_tokens(spark, d):
    return blobs.messages(spark, d).groupBy("conv_id").agg(F.sum(T.token_estimate(F.col("content"))).alias("tokens"), F.count("*").alias("turns"))


def budget_gate(spark, d):
    rows = budget.measured(blobs.messages(spark, d), SMALL)
    return rows.groupBy("conv_id").agg(F.first("before").alias("before"), F.first(F.col("before") > SMALL.target_tokens).alias("over"))


def protected_messages(spark, d):
    return budget.measured(blobs.messages(spark, d), SMALL).select("conv_id", "idx", "protected")


def candidates_ordered(spark, d):
    rows = budget.measured(blobs.messages(spark, d), SMALL).where("candidate")
    order = Window.partitionBy("conv_id").orderBy(F.desc("size"), "idx")
    return rows.select("conv_id", "idx", "size", F.row_number().over(order).cast("long").alias("place"))


def last_user_query(spark, d):
    return budget.measured(blobs.messages(spark, d), SMALL).groupBy("conv_id").agg(F.first("query").alias("query"))


def content_ref(spark, d):
    return docs(spark, d).select("doc_id", T.content_ref(F.col("text")).alias("ref"))


def content_ref_salted(spark, d):
    return docs(spark, d).select("doc_id", T.content_ref(F.col("text"), "tenant-7").alias("ref"))


def valid_ref(spark, d):
    ref = T.content_ref(F.col("text"))
    shapes = F.array(ref, F.upper(ref), F.substring(ref, 1, 23), F.concat(ref, F.lit("\n")), F.lit(""))
    rows = docs(spark, d).select("doc_id", F.posexplode(shapes).alias("shape", "ref"))
    return rows.select("doc_id", F.col("shape").cast("long").alias("shape"), T.is_ref(F.col("ref")).alias("valid"))


def marker(spark, d):
    text = F.col("text")
    return docs(spark, d).select("doc_id", T.marker(T.content_ref(text), T.token_estimate(text), F.lit("text")).alias("marker"))


def terms(spark, d):
    return docs(spark, d).select("doc_id", F.explode(T.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def stems(spark, d):
    return docs(spark, d).select(F.explode(T.terms(F.col("text"))).alias("term")).distinct().select("term", T.stem(F.col("term")).alias("stem"))


def term_freq(spark, d):
    return docs(spark, d).select("doc_id", F.explode(T.stems(F.col("text"))).alias("stem")).groupBy("doc_id", "stem").agg(F.count("*").alias("tf"))


def doc_freq(spark, d):
    return docs(spark, d).select(F.explode(F.array_distinct(T.stems(F.col("text")))).alias("stem")).groupBy("stem").agg(F.count("*").alias("df"))


def idf(spark, d):
    n = docs(spark, d).agg(F.count("*").cast("double").alias("n"))
    rows = doc_freq(spark, d).crossJoin(F.broadcast(n))  # one row: the number of documents
    return rows.select("stem", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 9).alias("idf"))


def salience(spark, d):
    rows = blobs.log_lines(spark, d)
    return rows.select("event_id", T.salience(F.col("line")).alias("salience"))


def sentences(spark, d):
    rows = docs(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), "sentence")


def _bm25(spark, d, query):
    rows = blobs.prose(spark, d, query).withColumn("sents", T.sentences(F.col("text")))
    rows = with_relevance(rows, "sents", "query", "rel").select(F.col("blob_id").alias("doc_id"), F.posexplode("rel").alias("i", "r"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), F.round("r", 9).alias("relevance"))


def bm25_sentences(spark, d):
    return _bm25(spark, d, QUERY)


def bm25_long_id_boost(spark, d):
    return _bm25(spark, d, "of oftenthstthoring ciónciónarmente enauxvitionellement the")


def text_select(spark, d):
    rows = prose.selected(blobs.prose(spark, d, QUERY), 0.4)
    return rows.select(F.col("blob_id").alias("doc_id"), F.explode("kept").alias("i")).select("doc_id", F.col("i").cast("long").alias("i"))


def text_gaps(spark, d):
    rows = prose.selected(blobs.prose(spark, d, QUERY), 0.4)
    at = F.concat(F.array(F.lit(-1)), "kept", F.array(F.size("sents")))
    gaps = F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda j: F.get(at, j) - F.get(at, j - 1) - 1)
    rows = rows.where(F.size("sents") > 0).select(F.col("blob_id").alias("doc_id"), F.explode(gaps).alias("gap")).where("gap > 0")
    return rows.groupBy("doc_id").agg(F.count("*").alias("gaps"), F.sum("gap").alias("omitted"))


def text_compress(spark, d):
    rows = prose.compress(blobs.prose(spark, d, QUERY), 0.4)
    return rows.select(F.col("blob_id").alias("doc_id"), "compressed")


def log_mask(spark, d):
    return blobs.log_lines(spark, d).select("event_id", T.mask(F.col("line")).alias("template"))


def log_groups(spark, d):
    rows = logs.groups(logs.numbered(blobs.log_blobs(spark, d)))
    return rows.select("blob_id", "template", "n", F.col("first_idx").cast("long").alias("first_idx"), "first_line", "last_line")


def log_salient(spark, d):
    rows = logs.numbered(blobs.log_blobs(spark, d)).where("salient")
    return rows.select("blob_id", F.col("idx").cast("long").alias("idx"), "line")


def log_compress(spark, d):
    return logs.compress(blobs.log_blobs(spark, d))


def _mixed(spark, d):
    tagged = lambda kind, rows: rows.select(F.concat(F.lit(kind), F.col("blob_id").cast("string")).alias("blob_id"), "text")
    rows = tagged("doc", blobs.prose(spark, d, "")).unionByName(tagged("log", blobs.log_blobs(spark, d)))
    return rows.unionByName(tagged("json", blobs.json_blobs(spark, d))).unionByName(tagged("code", blobs.code_blobs(spark, d)))


def route(spark, d):
    return routed(_mixed(spark, d)).select("blob_id", "content_type")


def json_cells(spark, d):
    rows = json_tables.cells(blobs.json_pieces(spark, d), ("row", "col", "cell")).where("col IS NOT NULL")
    return rows.select("blob_id", F.col("row").cast("long").alias("row"), "col", "cell")


def json_columns(spark, d):
    rows = json_tables.columns(blobs.json_blobs(spark, d))
    return rows.select("blob_id", "col", "freq", F.col("n_rows").cast("long").alias("n_rows"), "constant")


def json_outliers(spark, d):
    return json_tables.outliers(blobs.json_blobs(spark, d)).select("blob_id", F.col("row").cast("long").alias("row"))


def json_pins(spark, d):
    rows = json_tables.pinned(json_tables.listed(blobs.json_pieces(spark, d)))
    return rows.select("blob_id", F.col("row").cast("long").alias("row"), "anchor", "salient", "outlier")


def json_selection(spark, d):
    asked = blobs.json_blobs(spark, d).withColumn("query", F.lit("urgent order with status P"))
    rows = json_tables.chosen(asked, 30)
    return rows.select("blob_id", F.col("row").cast("long").alias("row"), F.coalesce("ranked", F.lit(False)).alias("ranked"), "sampled", "keep")


def json_table(spark, d):
    rows = blobs.json_pieces(spark, d).withColumn("query", F.lit(""))
    return json_tables.tabular(rows, 1_000_000).select("blob_id", "compressed", "lossy")


def json_table_lossy(spark, d):
    rows = blobs.json_pieces(spark, d).withColumn("query", F.lit("urgent order with status P"))
    return json_tables.tabular(rows, 30)


def json_minify(spark, d):
    rows = blobs.table(spark, d, "orders").groupBy((F.col("o_custkey") % 200).alias("blob_id")).agg(
        F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"), F.count("*").alias("n")
    )
    text = F.concat(
        F.lit('{  "first" :  '), F.col("a").cast("string"), F.lit(",\n    \"last\" :   "), F.col("b").cast("string"),
        F.lit(' ,\n   "n" : ['), F.col("n").cast("string"), F.lit(' ,   null,  true ]   }'),
    )
    return json_tables.minified(rows.select("blob_id", text.alias("text")))


def code_outline_lines(spark, d):
    rows = code.outline_lines(blobs.code_blobs(spark, d))
    rows = rows.select("blob_id", F.posexplode("marks").alias("at", "line"))
    return rows.select("blob_id", F.col("at").cast("long").alias("at"), "line")


def code_generic(spark, d):
    return code.generic(blobs.code_blobs(spark, d)).select("blob_id", "compressed")


def code_python(spark, d):
    return code.python(blobs.code_blobs(spark, d))


def code_compress(spark, d):
    return code.compress(blobs.code_blobs(spark, d))


def line_jaccard(spark, d):
    """Whole texts by pairs: each document and the one whose doc_id follows its own."""
    rows = docs(spark, d).select("doc_id", F.array_distinct(T.stems(F.col("text"))).alias("s"))
    rows = rows.join(rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t")), "doc_id")
    return rows.select("doc_id", F.round(T.jaccard(F.col("s"), F.col("t")), 12).alias("jaccard"))


def compress_blob(spark, d):
    rows = blobs.prose(spark, d, QUERY)
    done = budget.compress_blobs(rows)
    return done.select(F.col("blob_id").alias("doc_id"), "content_type", "ref", "lossy", "compressed")


def budget_apply(spark, d):
    rows = budget.compress_conversations(blobs.messages(spark, d), SMALL)
    return rows.select("conv_id", "idx", "applied", "ref", "saved", "content")


def savings(spark, d):
    return budget.totals(budget.compress_conversations(blobs.messages(spark, d), SMALL))


def session_stats(spark, d):
    done = budget.totals(budget.compress_conversations(blobs.messages(spark, d), SMALL))
    total = done.agg(F.sum("tokens_before").alias("b"), F.sum("tokens_after").alias("a"))
    return total.select(F.col("b").alias("tokens_in"), F.col("a").alias("tokens_out"), T.savings_line(F.col("b"), F.col("a")).alias("line"))


def _stored(spark, d, apart=60):
    """Originals, stored ``apart`` seconds apart by doc_id; copies share a reference."""
    rows = blobs.table(spark, d, "documents")
    at = F.lit(NOW).cast("timestamp") - F.make_interval(secs=F.col("doc_id") * apart)
    return rows.select(T.content_ref(F.col("text")).alias("ref"), F.col("text").cast("binary").alias("payload"), at.alias("stored_at"))


def _merged(spark, d, apart=60):
    rows = _stored(spark, d, apart)
    return store.merged(rows.limit(0), rows)


def store_roundtrip(spark, d):
    asked = docs(spark, d).select("doc_id", T.content_ref(F.col("text")).alias("ref"))
    # All stored just now: every original has to come back. Expiry is for ttl_purge.
    found = store.retrieve(asked, _merged(spark, d, 0), F.lit(NOW))
    return found.select("doc_id", F.md5("text").alias("md5"))


def mixed_roundtrip(spark, d):
    """Prose, logs, JSON and code compressed together; what is lossy comes back from the store by the reference in its marker."""
    folder = store.own_folder(spark)
    # The compressors of four kinds read the texts some twenty times, and two joins read what is lossy: both are made once.
    rows = store.written(_mixed(spark, d), f"{folder}/texts").withColumn("query", F.lit(QUERY))
    lossy = budget.compress_blobs(rows, Config(json_max_rows=20)).where("lossy")
    named = F.regexp_extract("compressed", r"^\[ctx-ref ([0-9a-f]{24}) ", 1).alias("ref")
    lossy = store.written(lossy.select("blob_id", named), f"{folder}/named")
    kept = store.entries(rows.join(lossy.select("blob_id"), "blob_id").select("text"), F.lit(NOW))
    back = store.retrieve(lossy, store.merged(kept.limit(0), kept), F.lit(NOW))
    found = rows.select("blob_id", F.md5("text").alias("own")).join(back.select("blob_id", F.md5("text").alias("stored"), F.lit(True).alias("lossy")), "blob_id", "left")
    return found.select("blob_id", F.when(F.col("lossy"), F.col("stored")).otherwise(F.col("own")).alias("md5"))


def ttl_purge(spark, d):
    rows = store.live(_merged(spark, d), F.lit(NOW))
    return rows.select("ref", F.unix_seconds("stored_at").alias("stored_at"))


def lru_bound(spark, d):
    return store.newest(_merged(spark, d), 100).select("ref", F.unix_seconds("stored_at").alias("stored_at"))


def memo_dedupe(spark, d):
    rows = docs(spark, d).withColumn("memo", T.content_ref(F.concat("text", F.lit("\0" + QUERY))))
    return rows.groupBy("memo").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("uses"))


def template_counts(spark, d):
    return templates.hourly(blobs.table(spark, d, "events"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        token_estimate, conv_tokens, budget_gate, protected_messages, candidates_ordered, last_user_query, content_ref,
        content_ref_salted, valid_ref, marker, terms, stems, term_freq, doc_freq, idf, salience, sentences, bm25_sentences,
        bm25_long_id_boost, text_select, text_gaps, text_compress, log_mask, log_groups, log_salient, log_compress, route,
        json_cells, json_columns, json_outliers, json_pins, json_selection, json_table, json_table_lossy, json_minify,
        code_outline_lines, code_generic, code_python, code_compress, line_jaccard, compress_blob, budget_apply, savings,
        session_stats, store_roundtrip, mixed_roundtrip, ttl_purge, lru_bound, memo_dedupe, template_counts,
    )
}
