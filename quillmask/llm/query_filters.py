"""Queries of the document filters: quality rules and classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.llm import quality_classifier as classifier
from quillmask.llm.quality_rules import quality_rules


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).selectExpr(
        "doc_id", "q_words AS n_words", "q_word_chars AS word_chars", "q_symbols AS n_symbols", "q_dup_lines AS n_dup_lines",
        "q_repeat_words AS n_repeat_words", "q_base_failed AS base_failed", "q_kept AS kept",
    )


#: Documents are predicted good from this score on.
GOOD_SCORE = 0.3


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.score(docs, model).select(
        "doc_id",
        classifier.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= GOOD_SCORE, 1).otherwise(0).alias("predicted"),
    )


#: {docs} is the name of the table.
OP1_MEASURES_SQL = r"""
d AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS body FROM {docs}),
w AS (SELECT rid, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS win
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM
          (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM win), range(8) r(k) WHERE c > 1 GROUP BY rid),
m AS (SELECT rid, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines FROM w),
q AS (SELECT d.*, n_words, word_chars, n_dup_lines, n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             length(regexp_replace(body, '\P{L}+', '', 'g')) AS letters,
             len(regexp_extract_all(body, '!')) AS bangs, len(regexp_extract_all(body, '\p{Lu}')) AS caps
      FROM d JOIN m USING (rid) LEFT JOIN rep USING (rid)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             10 * n_symbols > 3 * n_words OR word_chars > 20 * n_words OR 2 * word_chars < 3 * n_words
             OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines) OR 2 * bangs > n_words OR 10 * caps > 6 * letters
             OR 2 * letters < length(body) AS ruled FROM q)
"""

QUERIES = {"op1_quality_rules": op1_quality_rules, "op8_quality_classifier": op8_quality_classifier}

ORACLE_SQL = {
    "op1_quality_rules": "WITH " + OP1_MEASURES_SQL.replace("{docs}", "documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ruled AS kept FROM v"""
}
