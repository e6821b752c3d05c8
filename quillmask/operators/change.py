"""Change detection: screen keys, reuse of unchanged screens, pixel tiles and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmask.functions.text import fnv1a


def half_pixels(c: Column) -> Column:
    """A length in steps of two pixels, halves up."""
    return F.floor(c / 2 + 0.5).cast("bigint").cast("string")


def element_line(e: Column) -> Column:
    """What the key reads of an element; what only guides detection (options, boilerplate, contact) is left out."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    box = F.concat_ws(",", *(half_pixels(e[k]) for k in ("x", "y", "w", "h")))
    return F.concat_ws("\u0001", *(text(e[k]) for k in ("nodeId", "role", "name", "text", "value", "checked", "disabled", "context")), box)


def observation_key(url: Column, width: Column, height: Column, elements: Column, opaque_lines: Column) -> Column:
    """A key of a screen: two with one key have one sanitised form. Hashes are chained over the elements in order."""
    start = fnv1a(F.concat(url, F.lit("|"), width.cast("string"), F.lit("x"), height.cast("string")))
    chained = F.aggregate(F.concat(F.transform(elements, element_line), opaque_lines), start, lambda h, line: fnv1a(line, h))
    return F.concat_ws(".", F.size(elements).cast("string"), F.size(opaque_lines).cast("string"), F.lower(F.hex(chained)))


def mark_reused(steps: DataFrame, session: str = "session_id", order: str = "step", key: str = "key") -> DataFrame:
    """Rows with ``reused``: the key is that of the step before."""
    before = F.lag(key).over(Window.partitionBy(session).orderBy(order))
    return steps.withColumn("reused", F.coalesce(before == F.col(key), F.lit(False)))


def mark_repeated(actions: DataFrame, session: str = "session_id", order: str = "step") -> DataFrame:
    """Rows with ``repeated``: operation, element and text are those of the action before."""
    w = Window.partitionBy(session).orderBy(order)
    first = F.row_number().over(w) == 1
    same = [F.lag(c).over(w).eqNullSafe(F.col(c)) for c in ("op", "element_id", "text")]
    return actions.withColumn("repeated", ~first & same[0] & same[1] & same[2])


def step_times(marks: DataFrame, run: str = "run_id", order: str = "step", names: tuple[str, ...] = ("observe", "sanitize", "vision", "gate", "server", "validate", "confirm", "execute")) -> DataFrame:
    """Times of steps from the clock at their marks (array ``marks``: the start, then the end of each stage that was reached), as ms_<stage> and ms_total; stages not reached took 0."""
    at = lambda i: F.try_element_at("marks", F.lit(i))
    stages = [F.coalesce(at(i + 2) - at(i + 1), F.lit(0.0)).alias(f"ms_{n}") for i, n in enumerate(names)]
    return marks.select(run, order, *stages, F.coalesce(F.try_element_at("marks", F.lit(-1)) - at(1), F.lit(0.0)).alias("ms_total"))


def last_rows(history: DataFrame, n: int = 10, session: str = "session_id", order: str = "step") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return history.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def dirty_tiles(frames: DataFrame, session: str = "session_id", order: str = "step", tiles: str = "tiles", most: int = 2) -> DataFrame:
    """One row (session, order, tile) per tile whose hash differs from the frame before in more than ``most`` bits; all tiles of a first frame."""
    before = F.lag(tiles).over(Window.partitionBy(session).orderBy(order))
    rows = frames.withColumn("_before", before).select(session, order, "_before", F.posexplode(tiles).alias("tile", "hash"))
    old = F.try_element_at("_before", F.col("tile") + 1)
    return rows.filter(F.col("_before").isNull() | (F.bit_count(old.bitwiseXOR(F.col("hash"))) > most)).select(session, order, "tile")


def tile_box(tile: Column, width: Column, height: Column, grid: int = 8) -> Column:
    return F.struct((tile % grid * width / grid).alias("x"), (F.floor(tile / grid) * height / grid).alias("y"), (width / grid).alias("w"), (height / grid).alias("h"))


def cache_rates(requests: DataFrame, key: str = "key", group: str = "session_id") -> DataFrame:
    """Hits, misses and hit rate of a cache that keeps all: a first request of a key misses."""
    counted = requests.groupBy(group, key).agg(F.count(F.lit(1)).alias("n"))
    out = counted.groupBy(group).agg(F.sum(F.col("n") - 1).alias("hits"), F.count(F.lit(1)).alias("misses"))
    return out.withColumn("hit_rate", F.col("hits") / F.greatest(F.lit(1), F.col("hits") + F.col("misses")))


def once_per_text(rows: DataFrame, text: str, detect: object) -> DataFrame:
    """The rows with ``spans`` from a detector that runs once for each distinct text and is joined back."""
    distinct = rows.select(text).filter(F.col(text).isNotNull()).distinct().withColumn("spans", detect(F.col(text)))
    return rows.join(distinct, text, "left")
