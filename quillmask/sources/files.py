"""File sources and sinks: step metrics as CSV, captures and annotations as JSON, row logs as JSON lines, lists of URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.operators.metrics import STEP_COLUMNS, STEP_SCHEMA, csv_cell, upsert

ANNOTATION = (
    "site string, capture string, positives array<struct<element:int,field:string,type:string,value:string,note:string>>, "
    "benign_lookalikes array<struct<element:int,field:string,value:string,kind:string,expect:string>>, notes array<string>"
)


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """Step metrics from CSV with a header; columns that a file lacks become 0 or null."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', inferSchema=False)
    kinds = dict(f.split() for f in STEP_SCHEMA.split(", "))
    columns = []
    for c in STEP_COLUMNS:
        if c not in raw.columns:
            columns.append(F.lit(0.0 if kinds[c] == "double" else None).cast(kinds[c]).alias(c))
        else:
            columns.append(F.col(c).try_cast(kinds[c]).alias(c))
    return raw.select(*columns)


def write_steps(steps: DataFrame, path: str) -> None:
    """Step metrics as CSV with a header, whole numbers plain and others with two decimals; null becomes an empty cell."""
    kinds = dict(steps.dtypes)
    cells = [F.regexp_replace(csv_cell(F.col(c), kinds[c]), '(?s)^"(.*)"$', "$1").alias(c) if kinds[c] == "double" else F.col(c).cast("string").alias(c) for c in STEP_COLUMNS]
    steps.select(*cells).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_store(steps: DataFrame, path: str) -> None:
    """The keyed store: Parquet in STORE_BUCKETS folders by a hash of the run, appended to; a later row with one (run_id, step) replaces an earlier one when read."""
    steps.withColumn("bucket", store_bucket(F.col("run_id"))).write.mode("append").partitionBy("bucket").parquet(path)


#: Folders of a keyed store, whatever the number of runs.
STORE_BUCKETS = 64


def store_bucket(run_id: Column) -> Column:
    """The folder of a run."""
    return F.pmod(F.xxhash64(run_id.cast("string")), F.lit(STORE_BUCKETS)).cast("int")


def read_store(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    rows = rows if run_id is None else rows.filter((F.col("bucket") == store_bucket(F.lit(run_id))) & (F.col("run_id") == run_id))
    return upsert(rows.drop("bucket")).orderBy("ts", "step")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANNOTATION).json(path, multiLine=True)


def append_rows(rows: DataFrame, path: str) -> None:
    """JSON lines, appended."""
    rows.write.mode("append").json(path)


def read_rows(spark: SparkSession, path: str, schema: str, start: int = 0, count: int | None = None, index: str = "index") -> DataFrame:
    """JSON lines of a range of indexes, so that a run can go on where another stopped."""
    rows = spark.read.schema(schema).json(path).filter(F.col(index) >= start)
    return rows if count is None else rows.filter(F.col(index) < start + count)


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """Category (null if there is none) and url from lines; comments and anything but https go."""
    line = F.trim("value")
    rows = spark.read.text(path).select(line.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    parts = F.split("line", "\\s+")
    rows = rows.select(F.when(F.size(parts) > 1, parts[0]).alias("category"), F.element_at(parts, -1).alias("url"))
    return rows.filter(F.col("url").startswith("https://"))


def verified_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files by name and SHA-256, with ``ok`` only where an expected digest (name, sha256) is met."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"))
    return files.join(expected, "name", "left").withColumn("ok", F.coalesce(F.col("digest") == F.lower("sha256"), F.lit(False)))


def requests_from_json(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Requests from JSON text; null columns where it can't be read."""
    return lines.withColumn("request", F.from_json(value, schema)).select(*[c for c in lines.columns if c != value], "request.*")
