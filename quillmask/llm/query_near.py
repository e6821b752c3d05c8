"""Queries of similarity joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.llm.jaccard_join import jaccard_components
from quillmask.llm.line_dedup import dedup_lines


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines removed from every document, and what is left of its text."""
    docs = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", F.col("lines_removed").alias("n_removed"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


QUERIES = {"op4_line_dedup": op4_line_dedup, "op3_jaccard_join": op3_jaccard_join}

ORACLE_SQL = {
    "op3_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
link AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
         JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)""",
    "op4_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i::BIGINT AS i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
w AS (SELECT doc_id, i, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM l),
s AS (SELECT DISTINCT doc_id, i, array_to_string(ws[k:k + 4], ' ') AS s FROM (SELECT doc_id, i, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, i, count(*) AS n FROM s GROUP BY ALL),
gone AS (SELECT DISTINCT x_id, x_i FROM (SELECT x.doc_id AS x_id, x.i AS x_i, y.doc_id AS y_id, y.i AS y_i, count(*) AS common
             FROM s x JOIN s y ON x.s = y.s AND (y.doc_id, y.i) < (x.doc_id, x.i) GROUP BY ALL) p
         JOIN n a ON a.doc_id = x_id AND a.i = x_i JOIN n b ON b.doc_id = y_id AND b.i = y_i
         WHERE 100 * common >= 75 * (a.n + b.n - common)),
k AS (SELECT doc_id, count(x_i) AS n_removed, string_agg(CASE WHEN x_i IS NULL THEN line END, chr(10) ORDER BY i) AS text
      FROM l LEFT JOIN gone ON x_id = doc_id AND x_i = i GROUP BY doc_id)
SELECT doc_id, n_removed, length(coalesce(text, ''))::BIGINT AS n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM k""",
}
