"""Text lines and regions of images: which boxes to mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.functions.fields import dom_rule_type
from quillmask.functions.geometry import clipped, span_box
from quillmask.functions.patterns import detect_patterns, no_spans, span
from quillmask.functions.text import WIDE_SPACE, ascii_edges

#: Lines of less confidence are masked whole.
LEAST_CONFIDENCE = 0.6
#: "Label: value" lines.
LABELLED = f"^[{WIDE_SPACE}]*([A-Za-z][A-Za-z ./'()-]{{1,30}}?)[{WIDE_SPACE}]*[:：][{WIDE_SPACE}]*([^{WIDE_SPACE}].*)$"
NAMING = "(?i)\\b(name|father|mother|husband|spouse|guardian|s/o|d/o|w/o|address)\\b"


def labelled_value(text: Column) -> Column:
    """The span of the value in a line "label: value" whose label names a type, as an array of at most one."""
    label, value = F.regexp_extract(text, LABELLED, 1), F.regexp_extract(text, LABELLED, 2)
    none = F.lit(None).cast("string")
    named = F.when(label.rlike(ascii_edges(NAMING)), F.when(label.rlike("(?i)address"), "ADDRESS").otherwise("NAME"))
    kind = F.coalesce(dom_rule_type(none, none, none, none, label, none), named)
    clean = F.regexp_replace(value, f"[{WIDE_SPACE}]+\\z", "")
    start = F.length(text) - F.length(value)
    return F.when((value != "") & kind.isNotNull(), F.array(span(kind, start, start + F.length(clean), clean, F.lit("dom_rule"), F.lit(1.0)))).otherwise(no_spans())


def mask_lines(lines: DataFrame, text: str = "text", confidence: str = "confidence", box: str = "box") -> DataFrame:
    """One row per mask (type, mask, value) of recognised lines; uncertain lines are masked whole as LOW_CONF_TEXT."""
    t = F.col(text)
    found = F.transform(F.concat(detect_patterns(t), labelled_value(t)), lambda s: F.struct(s["type"].alias("type"), span_box(F.col(box), F.length(t), s["start"], s["end"]).alias("mask"), s["value"].alias("value")))
    whole = F.array(F.struct(F.lit("LOW_CONF_TEXT").alias("type"), F.col(box).alias("mask"), F.lit(None).cast("string").alias("value")))
    return lines.withColumn("m", F.explode(F.when(F.col(confidence) < LEAST_CONFIDENCE, whole).otherwise(found))).select(*lines.columns, "m.*")


def usable_regions(regions: DataFrame, box: str = "box", width: str = "width", height: str = "height", least: int = 48) -> DataFrame:
    """Regions clipped to their frame; too small ones go."""
    return regions.withColumn("clip", clipped(F.col(box), F.col(width), F.col(height), least)).filter("clip IS NOT NULL")


def heading(text: Column, headings: list[str]) -> Column:
    """The only known heading in a text (its letters in upper case), else null."""
    plain = F.regexp_replace(F.regexp_replace(F.upper(text), "[^A-Z ]", ""), "\\s+", " ")
    hits = F.filter(F.array(*map(F.lit, headings)), lambda h: plain.contains(h))
    return F.when(F.size(hits) == 1, hits[0])


def reading_order(lines: DataFrame, image: str = "image_id", box: str = "box", tie: str | None = None) -> DataFrame:
    """Lines with ``place`` within their image, from top to bottom, then left to right, then by the column ``tie`` if one is given."""
    from pyspark.sql import Window

    return lines.withColumn("place", F.row_number().over(Window.partitionBy(image).orderBy(f"{box}.y", f"{box}.x", *([tie] if tie else []))))
