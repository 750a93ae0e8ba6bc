"""The queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersa.llm import fingerprints, jaccard_join, line_dedup, lm_scoring, mixing, packing, quality_rules, sharding, substring_dedup, token_output
from tersa.llm.common import documents


def op1_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return lm_scoring.score(documents(spark, sf_dir), good, leave_out=True)


def op2_lempel_ziv_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.factor(documents(spark, sf_dir), window=35)


def op3_bloom_lookup_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(documents(spark, sf_dir))


def op4_minhash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.decide(documents(spark, sf_dir))
    return rows.select(F.col("doc").alias("doc_id"), "n_lines", F.size("removed").alias("n_removed"), "removed")


#: Target weights of the query and of the pipeline: the first domain half as much again, English triple.
MIX_WEIGHTS = {("d0",): 3, ("d1",): 2, ("d2",): 2, ("d3",): 2, ("*", "en"): 3}


def op5_hierarchical_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, _ = mixing.mix(documents(spark, sf_dir), max_epochs=2, weights=MIX_WEIGHTS, seed=17)
    return chosen.select(
        F.col("doc.doc_id").alias("doc_id"),
        "domain",
        F.col("doc.lang").alias("lang"),
        F.col("doc.source").alias("source"),
        "epoch",
        "n_tokens",
        "order_key",
    )


#: Siblings share a budget: a node is full if, at the level that fills it, all of them together take no more than there is.
_FILL = """
{n}_full AS (
  SELECT a.*, a.weight > 0 AND (
           SELECT sum(least(b.cap::HUGEINT * a.weight, b.weight::HUGEINT * a.cap)) FROM {n}_in b WHERE b.weight > 0 AND {same}
         ) <= a.budget::HUGEINT * a.weight AS is_full
  FROM {n}_in a
), {n}_left AS (
  SELECT *, budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (PARTITION BY {p}), 0) AS rest,
         sum(CASE WHEN NOT is_full THEN weight ELSE 0 END) OVER (PARTITION BY {p}) AS weights,
         row_number() OVER (PARTITION BY {p}, is_full OR weight = 0 ORDER BY cap::DOUBLE / nullif(weight, 0)::DOUBLE, {k}) - 1 AS place
  FROM {n}_full
), {n}_low AS (
  SELECT *, CASE WHEN is_full OR weight = 0 THEN 0 ELSE weight::HUGEINT * rest // weights END AS low FROM {n}_left
), {n} AS (
  SELECT *, CASE WHEN is_full THEN cap WHEN weight = 0 THEN 0
                 ELSE least(cap, low + CASE WHEN place < rest - sum(low) OVER (PARTITION BY {p}) THEN 1 ELSE 0 END) END AS share FROM {n}_low
)"""

#: What a node can take is summed from its leaves up, nothing where a weight is 0; budgets go from the root down.
OP5_SQL = (
    r"""
WITH d AS (
  SELECT doc_id, lang AS lang0, source AS source0, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         'd' || CAST((instr('0123456789abcdef', substr(md5(coalesce(source, '')), 1, 1)) - 1) // 4 AS VARCHAR) AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens, md5(coalesce(text, '')) AS same
  FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens) AS tokens, 1 AS weight, 2 * sum(n_tokens) AS cap FROM d GROUP BY ALL
), langs AS (
  SELECT domain, lang, CASE lang WHEN 'en' THEN 3 ELSE 1 END AS weight, sum(cap) AS cap FROM leaves GROUP BY ALL
), s1_in AS (
  SELECT domain, CASE domain WHEN 'd0' THEN 3 ELSE 2 END AS weight, sum(cap) AS cap, (SELECT sum(n_tokens) FROM d) AS budget, 0 AS root
  FROM langs GROUP BY domain
), """
    + _FILL.format(n="s1", p="root", k="domain", same="a.root = b.root").strip()
    + """, s2_in AS (
  SELECT langs.*, s1.share AS budget FROM langs JOIN s1 USING (domain)
), """
    + _FILL.format(n="s2", p="domain", k="lang", same="a.domain = b.domain").strip()
    + """, s3_in AS (
  SELECT leaves.*, s2.share AS budget FROM leaves JOIN s2 USING (domain, lang)
), """
    + _FILL.format(n="s3", p="domain, lang", k="source", same="a.domain = b.domain AND a.lang = b.lang").strip()
    + """, leaf AS (
  SELECT domain, lang, source, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS epochs,
         share - CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END * tokens AS rest
  FROM s3
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY domain, lang, source, doc_id ORDER BY n_tokens, same) - 1 AS turn FROM d
), named AS (
  SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || CASE turn WHEN 0 THEN '' ELSE ':' || CAST(turn AS VARCHAR) END AS name FROM turns
), keyed AS (
  SELECT named.*, epochs, rest, md5('17:' || CAST(epochs AS VARCHAR) || ':' || name) AS key FROM named JOIN leaf USING (domain, lang, source)
), done AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed
), each AS (
  SELECT *, unnest(range(CAST(epochs + CASE WHEN before < rest THEN 1 ELSE 0 END AS BIGINT))) AS epoch FROM done
)
SELECT doc_id, domain, lang0 AS lang, source0 AS source, epoch, n_tokens, md5('17:' || CAST(epoch AS VARCHAR) || ':' || name) AS order_key
FROM each
"""
)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), capacity=4096)


def op7_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir), size=4, percent=85)


def op8_elias_fano_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_output.write_and_index(documents(spark, sf_dir))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(documents(spark, sf_dir), shards=24)
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
    )


def op10_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Copies in their thousands would make each of their own lines frequent, and clean documents go.
    verdict, _ = quality_rules.judge(documents(spark, sf_dir), host="source", equal_texts_once=True)
    return verdict.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "removed_words",
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), l AS (
  SELECT doc_id, host, t, k, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw
  FROM (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line,
               unnest(range(len(string_split(t, chr(10))))) AS k FROM d)
), n AS (
  SELECT doc_id, host, t, k, line, len(lw) AS words,
         translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM l WHERE len(lw) > 0
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM n GROUP BY doc_id
), hosts AS (
  SELECT host, count(DISTINCT t) AS n_host FROM d GROUP BY host
), freq AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT t) AS n_docs FROM n GROUP BY host, norm)
  JOIN hosts USING (host) WHERE n_docs > 20 AND 100 * n_docs > 10 * n_host
), gone AS (
  SELECT doc_id, sum(words) AS removed_words FROM n JOIN freq USING (host, norm) GROUP BY doc_id
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words
  FROM twice, (SELECT unnest(range(5)) AS j) GROUP BY doc_id
), base AS (
  SELECT doc_id, len(w) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND 100 * (n_words - removed_words) >= 30 * n_words AS kept,
       removed_words
FROM base
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_cross_entropy_difference": op1_cross_entropy_difference,
        "op2_lempel_ziv_substrings": op2_lempel_ziv_substrings,
        "op3_bloom_lookup_fingerprints": op3_bloom_lookup_fingerprints,
        "op4_minhash_lines": op4_minhash_lines,
        "op5_hierarchical_budgets": op5_hierarchical_budgets,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_prefix_tree_join": op7_prefix_tree_join,
        "op8_elias_fano_ids": op8_elias_fano_ids,
        "op9_virtual_slots": op9_virtual_slots,
        "op10_line_frequency": op10_line_frequency,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_hierarchical_budgets": OP5_SQL,
        "op10_line_frequency": OP10_SQL,
    }
