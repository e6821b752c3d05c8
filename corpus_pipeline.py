"""Corpus pipeline: from raw documents to packed token sequences.

Each stage works on all that its predecessor kept. All but the last return
documents (doc_id, text, lang, source, n_chars); the last returns pieces.

Defined results: null texts count as empty, which the rules reject; rows
without doc_id pass all stages, as nothing is matched with them; rows repeated
with one id and text become one at the near duplicates; rows that share an id
but not the text are documents of their own; other columns of the input are
left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.llm import quality_classifier as classifier
from quillmask.llm.jaccard_join import jaccard_components
from quillmask.llm.line_dedup import dedup_lines
from quillmask.llm.quality_rules import quality_rules
from quillmask.llm.query_filters import GOOD_SCORE
from quillmask.llm.query_tokens import packed
from quillmask.llm.tables import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules(docs.select(*COLUMNS)).filter("q_kept").select(*COLUMNS)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a good score; the classifier learns from the labelled documents of the raw table."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = classifier.train(raw, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.score(docs.select(*COLUMNS), model, into="q_score").filter(F.col("q_score") >= GOOD_SCORE).select(*COLUMNS)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line matches; documents that lose all their words go."""
    left = dedup_lines(docs.select(*COLUMNS), removed_col="q_removed")
    return left.filter("q_removed = 0 OR text RLIKE '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]'").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the least id; documents without id stay.

    Rows of one id and text are one document. Rows that share an id but not the
    text all stay if the id is the least of the component of any of them.
    """
    docs = docs.select(*COLUMNS)
    found = jaccard_components(docs.select("doc_id", "text"))
    stays = found.filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(stays, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(docs.filter("doc_id IS NULL")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of all documents in sequences."""
    return packed(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("line_dedup", lines_stage),
    ("jaccard_join", near_duplicates_stage),
    ("packing", packing_stage),
]

#: A trained model is no SQL; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is a written table before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
