"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmask.session import cut_lineage


def row_numbers(rows: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """The rows with their number within ``keys``, from 1, by ``order`` (which should tell all rows apart).

    Rows are dealt by ranges of (keys, order) and numbered range by range, each
    starting after those before it: a large group is shared by many tasks,
    where a plain window gives it to one. Nulls are a key like any other.
    """
    ranged = rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    kept = cut_lineage(ranged)  # kept, as a second run might draw other ranges
    sizes = kept.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("size"))  # a row per group and range
    before = F.sum("size").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("size")
    sizes = sizes.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_at"), before.alias("_before"))
    on = F.col("_range") == F.col("_at")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return kept.join(sizes, on).withColumn(name, F.col("_before") + place).select(*rows.columns, name)
