"""Sanitising observed screens: elements with real values become elements with typed tokens.

Elements come as rows (scope, pos, and the element's columns). Spans are
detected in value, name, text and options, fused, gated and numbered in the
order of first encounter; then every span is replaced by its token.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmask.functions.fields import accepted_types, dom_rule_type
from quillmask.functions.patterns import SPANS, detect_patterns, no_spans
from quillmask.functions.spans import enough_letters, known_values, merge_spans, not_boilerplate, not_site_contact, redact, shift_spans, trim_span
from quillmask.functions.text import blank, fixed, host_of, normalize_value, origin_of, round3
from quillmask.operators.dictionary import number_values
from quillmask.session import cut_lineage

Detector = Callable[[Column], Column]
ELEMENT = (
    "scope string, pos int, nodeId string, url string, tag string, role string, name string, text string, value string, inputType string, autocomplete string, "
    "htmlName string, htmlId string, placeholder string, disabled boolean, checked boolean, context string, options array<string>, boilerplate boolean, contact string, "
    "x double, y double, w double, h double, viewport_w double, viewport_h double"
)
#: Fixed value: what a planner is told of a region that it cannot read.
OPAQUE_NOTE = ": pixels not in this list; use need_visual to see it"
#: Fields of an element in the order in which their values are met.
PARTS = ("value", "name", "text")


def spans_of(text: Column, context: Column, is_value: Column, boilerplate: Column, contact: Column, page_host: Column, detectors: tuple[Detector, ...] = (), known: Column | None = None) -> Column:
    """The fused and gated spans of one string of an element; ``context`` is only read by the patterns."""
    pre = F.when(blank(context), F.lit("")).otherwise(F.concat(context, F.lit(": ")))
    lists = [] if known is None else [known_values(text, known)]
    lists.append(shift_spans(detect_patterns(F.concat(pre, text)), F.length(pre)))
    lists += [d(text) for d in detectors]
    found = F.transform(merge_spans(*lists), lambda s: trim_span(text, s))
    kept = F.filter(found, lambda s: enough_letters(s) & not_site_contact(s, contact, boilerplate, page_host) & not_boilerplate(s, is_value, boilerplate))
    return F.when(blank(text), no_spans()).otherwise(kept)


def detected(elements: DataFrame, detectors: tuple[Detector, ...] = (), known: str | None = None) -> DataFrame:
    """Elements with rule, value_spans, name_spans, text_spans and option_spans."""
    c = {n: F.col(n) for n in elements.columns}
    host = host_of(c["url"])
    entries = c[known] if known else None
    rule = dom_rule_type(c["inputType"], c["autocomplete"], c["htmlName"], c["htmlId"], c["name"], c["placeholder"])

    whole = F.array(F.struct(F.col("rule").alias("type"), F.lit(0).alias("start"), F.length("value").alias("end"), F.col("value"), F.lit("dom_rule").alias("source"), F.lit(1.0).alias("confidence"))).cast(SPANS)
    ruled = F.col("rule").isNotNull() & ~blank(c["value"])

    def part(text: Column, context: Column, is_value: bool) -> Column:
        return F.struct(text.alias("text"), context.cast("string").alias("context"), F.lit(is_value).alias("is_value"))

    nothing = F.lit(None).cast("string")
    strings = F.array(
        part(F.when(~ruled, c["value"]), c["name"], True), part(c["name"], c["context"], False), part(F.when(blank(c["text"]) | (c["text"] == c["name"]), nothing).otherwise(c["text"]), c["context"], False)
    )
    strings = F.concat(strings, F.transform(F.coalesce(c["options"], F.array().cast("array<string>")), lambda o: part(o, c["name"], False)))
    # one expression for all strings of an element, however many there are
    found = F.transform(strings, lambda p: spans_of(p["text"], p["context"], p["is_value"], c["boilerplate"], c["contact"], host, detectors, entries))
    spans = F.col("spans")
    out = elements.withColumn("rule", rule).withColumn("spans", found)
    return out.withColumns({"value_spans": F.when(ruled, whole).otherwise(spans[0]), "name_spans": spans[1], "text_spans": spans[2], "option_spans": F.slice(spans, 4, F.size(spans))}).drop("spans")


def found_values(elements: DataFrame) -> DataFrame:
    """(scope, type, value, pos) of every span, in the order of encounter: element, then value, name, text, options, then place."""
    def tagged(spans: Column, k: int, i: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(F.struct(F.col("pos").alias("e"), F.lit(k).alias("k"), i.cast("int").alias("i"), s["start"].alias("at")).alias("pos"), s["type"].alias("type"), s["value"].alias("value")))

    options = F.flatten(F.transform(F.col("option_spans"), lambda spans, i: tagged(spans, 3, i)))
    parts = F.concat(*(tagged(F.col(f"{p}_spans"), k, F.lit(0)) for k, p in enumerate(PARTS)), options)
    return elements.select("scope", F.explode(parts).alias("f")).select("scope", "f.type", "f.value", "f.pos")


def sanitize(elements: DataFrame, detectors: tuple[Detector, ...] = (), known: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Screen elements, dictionary and detections of observed elements (columns of ``ELEMENT``).

    Screen: scope, id, role, label, field_type, value, state, options, bbox,
    fingerprint, accepts, nodeId. Detections are numbered d1, d2, ... within a
    scope. Hits in options are replaced, but are no detections; nor are those
    in the alternative texts of opaque regions, which are rows with a ``kind``
    (null or no such column: an element). Detection runs when this is called; its result is kept in the
    shared folder of ``spark.checkpoint.dir``.
    """
    # kept once, as dictionary, screen and detections all read it: pages are parsed and texts searched a single time
    kinds = elements if "kind" in elements.columns else elements.withColumn("kind", F.lit(None).cast("string"))
    marked = cut_lineage(detected(kinds, detectors, known))
    dictionary = number_values(found_values(marked))
    tokens = dictionary.groupBy("scope").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "type", "norm"), "token"))).alias("tokens"))
    marked = marked.join(tokens, "scope", "left")

    def safe(text: Column, spans: Column) -> Column:
        named = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(F.col("tokens"), F.concat_ws(":", s["type"], normalize_value(s["value"]))).alias("token")))
        return F.when(F.size(spans) == 0, F.coalesce(text, F.lit(""))).otherwise(redact(text, named))

    label, text = safe(F.col("name"), F.col("name_spans")), safe(F.col("text"), F.col("text_spans"))
    shown = F.when(blank(F.col("text")) | (F.col("text") == F.col("name")), label).when(blank(label), text).otherwise(F.concat(label, F.lit(" | "), text))
    opaque = F.col("kind").isNotNull()
    shown = F.when(opaque, F.concat(F.when(blank(label), F.col("kind")).otherwise(label), F.lit(" ("), "kind", F.lit(OPAQUE_NOTE), F.lit(")"))).otherwise(shown)
    sides = [round3(F.col("x") / F.col("viewport_w")), round3(F.col("y") / F.col("viewport_h")), round3(F.col("w") / F.col("viewport_w")), round3(F.col("h") / F.col("viewport_h"))]
    state = F.map_concat(F.when(F.coalesce("disabled", F.lit(False)), F.create_map(F.lit("disabled"), F.lit(True))).otherwise(F.create_map().cast("map<string,boolean>")), F.when(F.col("checked").isNotNull(), F.create_map(F.lit("checked"), F.col("checked"))).otherwise(F.create_map().cast("map<string,boolean>")))
    screen = marked.select(
        "scope",
        F.concat(F.lit("e"), F.col("pos").cast("string")).alias("id"),
        "role",
        shown.alias("label"),
        F.when(~blank(F.col("inputType")), F.col("inputType")).when(F.col("tag") == "textarea", "textarea").alias("field_type"),
        safe(F.col("value"), F.col("value_spans")).alias("value"),
        state.alias("state"),
        F.when(F.size("option_spans") > 0, F.zip_with("options", "option_spans", safe)).alias("options"),
        F.array(*sides).alias("bbox"),
        F.when(opaque, F.array().cast("array<string>")).otherwise(accepted_types(F.col("rule"), F.col("inputType"), F.col("autocomplete"))).alias("accepts"),
        "nodeId",
        "pos",
    ).withColumn("fingerprint", F.concat_ws("|", "role", "label", F.array_join(F.transform("bbox", lambda v: fixed(v)), ",")))
    hits = F.concat(*(_placed(p, k) for k, p in enumerate(PARTS)))
    place = F.row_number().over(Window.partitionBy("scope").orderBy("pos", "h.k", "h.at", "h.s.type"))
    detections = marked.filter(~opaque).select("scope", "pos", "nodeId", F.explode(hits).alias("h")).withColumn("id", F.concat(F.lit("d"), place.cast("string")))
    return screen, dictionary, detections.select("scope", "id", "pos", "nodeId", F.col("h.k").alias("part"), "h.at", "h.s.type", "h.s.source", "h.s.confidence")


def wire_screen(screen: DataFrame, pages: DataFrame) -> DataFrame:
    """What leaves the device, a row per scope of ``pages`` (scope, url): url_origin and elements, without nodes, fingerprints and accepted types."""
    fields = ["id", "role", "label", "field_type", "value", "state", "options", "bbox"]
    lists = screen.groupBy("scope").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.to_json(F.struct(*fields)).alias("e")))), lambda x: x["e"]).alias("elements"))
    return pages.select("scope", origin_of(F.col("url")).alias("url_origin")).join(lists, "scope", "left").withColumn("elements", F.coalesce("elements", F.array().cast("array<string>")))


def _placed(part: str, k: int) -> Column:
    return F.transform(F.col(f"{part}_spans"), lambda s: F.struct(F.lit(k).alias("k"), s["start"].alias("at"), s.alias("s")))


def sanitize_text(texts: DataFrame, scope: str = "scope", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Plain texts (a task, say) with their values replaced, and the dictionary: a screen of one element."""
    none = F.lit(None).cast("string")
    own = spans_of(F.col(text), none, F.lit(False), F.lit(False), none, F.lit(""))
    spans = cut_lineage(texts.select(F.col(scope).alias("scope"), F.col(text).alias("text"), own.alias("spans")))
    each = spans.select("scope", F.explode("spans").alias("s"))
    dictionary = number_values(each.select("scope", "s.type", "s.value", F.col("s.start").alias("pos")))
    tokens = dictionary.groupBy("scope").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "type", "norm"), "token"))).alias("tokens"))
    named = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(F.col("tokens"), F.concat_ws(":", s["type"], normalize_value(s["value"]))).alias("token")))
    return spans.join(tokens, "scope", "left").select("scope", F.when(F.size("spans") == 0, F.col("text")).otherwise(redact(F.col("text"), named)).alias("safe")), dictionary
