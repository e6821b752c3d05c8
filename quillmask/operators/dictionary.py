"""Placeholder dictionaries: stable tokens for (scope, type, normalised value), and joins with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmask.functions.text import TOKEN, normalize_value
from quillmask.operators.ranks import row_numbers


def number_values(found: DataFrame, scope: str = "scope", order: str = "pos", wide: bool = False) -> DataFrame:
    """A dictionary (scope, token, type, value, norm, n): values are numbered within scope and type as they first come.

    ``found`` has scope, type, value and an order column. Values of one normal
    form share a token, and the first spelling is kept. The numbering is over
    distinct values, after a partial aggregation: by a window, which suits
    scopes as small as a page or a session, or, with ``wide``, by ranges, for
    scopes that may hold a large part of all values.
    """
    first = found.withColumn("norm", normalize_value(F.col("value"))).groupBy(scope, "type", "norm").agg(F.min(F.struct(order, "value")).alias("first"))
    first = first.select(scope, "type", "norm", F.col(f"first.{order}").alias("_first"), "first.value")
    if wide:
        numbered = row_numbers(first, [scope, "type"], ["_first", "norm"]).withColumn("n", F.col("n").cast("int"))
    else:
        numbered = first.withColumn("n", F.row_number().over(Window.partitionBy(scope, "type").orderBy("_first", "norm")))
    return numbered.select(scope, F.format_string("<%s_%d>", "type", "n").alias("token"), "type", "value", "norm", "n")


def import_dictionary(rows: DataFrame, scope: str = "scope") -> DataFrame:
    """A dictionary from exported rows (scope, token, type, value)."""
    return rows.select(scope, "token", "type", "value", normalize_value(F.col("value")).alias("norm"), F.regexp_extract("token", "_(\\d+)>\\z", 1).try_cast("int").alias("n"))


def assign_tokens(found: DataFrame, dictionary: DataFrame, scope: str = "scope") -> DataFrame:
    """The rows with the token of their (scope, type, value), null if the dictionary has none."""
    keyed = found.withColumn("norm", normalize_value(F.col("value")))
    return keyed.join(dictionary.select(scope, "type", "norm", "token"), [scope, "type", "norm"], "left").drop("norm")


def tokens_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per token of a text, in order (column ``token``)."""
    return texts.withColumn("token", F.explode(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))))


def resolve_tokens(texts: DataFrame, dictionary: DataFrame, text: str = "text", scope: str = "scope") -> tuple[DataFrame, DataFrame]:
    """The tokens of texts with their type and value, and those the dictionary doesn't hold."""
    tokens = tokens_of(texts, text)
    keys = [scope, "token"]
    return tokens.join(dictionary.select(*keys, "type", "value"), keys), tokens.join(dictionary.select(*keys), keys, "left_anti")


def legend(dictionary: DataFrame, scope: str = "scope") -> DataFrame:
    """For each scope a map from token to type."""
    return dictionary.groupBy(scope).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("token", "type")))).alias("legend"))


def entries(dictionary: DataFrame, scope: str = "scope") -> DataFrame:
    """For each scope the dictionary as an array of (token, type, value) in the order of numbers."""
    return dictionary.groupBy(scope).agg(F.transform(F.array_sort(F.collect_list(F.struct("type", "n", "token", "value"))), lambda e: F.struct(e["token"].alias("token"), e["type"].alias("type"), e["value"].alias("value"))).alias("entries"))
