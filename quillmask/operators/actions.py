"""Planned actions: schema guards, validation against screens, a rule planner, loop notes and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.functions.checksums import digits_only, luhn_valid
from quillmask.functions.fields import wanted_type
from quillmask.functions.patterns import detect_patterns
from quillmask.functions.text import TOKEN, ascii_edges, blank, fixed, tokens_in

# Operations, verbs with consequences, roles and field types that the rules name.
OPERATIONS = "click type select scroll wait done ask_user need_visual".split()
CONSEQUENTIAL = "(?i)submit|pay|place order|delete|remove|send|upload|confirm|transfer|buy|sign ?up|register"
SUBMITS = "(?i)submit|continue|next|save|register|sign ?up|proceed|pay"
FILLABLE = "text tel email number textarea search".split()
HINT_LABELS = "login registration checkout search error".split()
ACTION = "struct<op:string,element_id:string,text:string,reason:string>"
GUARD = {
    "PHONE": "(?<![\\d+])(?:\\+91[ -]?)?[6-9]\\d{4}[ -]?\\d{5}\\b",
    "PAN": "\\b[A-Z]{3}[ABCFGHLJPT][A-Z]\\d{4}[A-Z]\\b",
    "EMAIL": "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}\\b",
}
GUARD_CARD = "\\b(?:\\d[ -]?){12,18}\\d\\b"


def raw_types(text: Column) -> Column:
    """Types of raw identifiers in a request, never the values: PHONE, PAN, EMAIL, CARD."""
    cards = F.exists(F.regexp_extract_all(text, F.lit(ascii_edges(GUARD_CARD)), F.lit(0)), lambda v: F.length(digits_only(v)).between(13, 19) & luhn_valid(digits_only(v)))
    found = [F.when(text.rlike(ascii_edges(p)), k) for k, p in GUARD.items()] + [F.when(cards, "CARD")]
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*found)))


def valid_schema(op: Column) -> Column:
    return F.coalesce(op.isin(OPERATIONS), F.lit(False))


def consequential(op: Column, label: Column) -> Column:
    return F.coalesce((op == "click") & label.rlike(CONSEQUENTIAL), F.lit(False))


def request_error(version: Column, task: Column, ids: Column, legend: Column, manifest_legend: Column, has_manifest: Column, hint_label: Column, hint_score: Column, hint_margin: Column) -> Column:
    """The first rule that a step request breaks, else null."""
    same = F.array_sort(F.map_entries(legend)) == F.array_sort(F.map_entries(manifest_legend))
    clash = has_manifest & (F.size(legend) > 0) & (F.size(manifest_legend) > 0) & ~same
    hint = hint_label.isNotNull() & ~(hint_label.isin(HINT_LABELS) & hint_score.between(-1, 1) & hint_margin.between(0, 2))
    return (
        F.when(F.exists(ids, lambda i: ~i.rlike("\\Ae\\d+\\z")), "element_id")
        .when(F.length(task) > 4000, "task_length")
        .when(F.coalesce(hint, F.lit(False)), "semantic_hint")
        .when(F.coalesce(clash, F.lit(False)), "legend_mismatch")
        .when(has_manifest & (F.coalesce(version, F.lit(1)) < 2), "payload_version")
    )


def parse_action(reply: Column) -> Column:
    """The action in a model's reply: the outermost braces as JSON; null if there is none or its operation is unknown."""
    raw = F.regexp_extract(F.coalesce(reply, F.lit("")), "(?s)\\{.*\\}", 0)
    parsed = F.from_json(F.when(raw != "", raw), ACTION)
    clean = F.struct(parsed["op"].alias("op"), parsed["element_id"].alias("element_id"), parsed["text"].alias("text"), F.substring(F.coalesce(parsed["reason"], F.lit("")), 1, 200).alias("reason"))
    return F.when(valid_schema(parsed["op"]), clean)


def validate_actions(actions: DataFrame, planned: DataFrame, current: DataFrame, dictionary: DataFrame, key: str = "scope") -> DataFrame:
    """Actions (key, op, element_id, text) with ok, reason, needs_confirm and the operation after repair.

    Reasons, first come: schema, missing_element, unknown_element,
    stale_element, disabled_element, unknown_token, token_type_mismatch,
    raw_value_in_text. Screens are rows (key, id, role, label, field_type,
    state, options, accepts, fingerprint).
    """
    now = current.select(key, F.col("id").alias("element_id"), F.lit(True).alias("there"), "role", "label", "field_type", "state", "options", "accepts", "fingerprint")
    then = planned.select(key, F.col("id").alias("element_id"), F.col("fingerprint").alias("planned_print"))
    types = dictionary.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("token", "type")))).alias("types"))
    rows = actions.join(now, [key, "element_id"], "left").join(then, [key, "element_id"], "left").join(types, key, "left")
    types_ = F.coalesce("types", F.create_map().cast("map<string,string>"))
    text = F.coalesce("text", F.lit(""))
    repaired = F.when((F.col("op") == "click") & ~blank(F.col("text")) & (F.col("role") == "combobox") & F.array_contains("options", F.col("text")), "select").otherwise(F.col("op"))
    op = F.col("op_now")
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))

    def token_reason(t: Column) -> Column:
        kind = F.try_element_at(types_, t)
        fits = F.when(F.col("accepts").isNull(), F.coalesce(F.col("field_type") != "password", F.lit(True))).otherwise(F.array_contains("accepts", kind))
        return F.when(kind.isNull(), "unknown_token").when(~fits, "token_type_mismatch")

    writes = op.isin("type", "select")
    bad = F.try_element_at(F.filter(F.transform(tokens, token_reason), lambda r: r.isNotNull()), F.lit(1))
    raw = F.size(detect_patterns(F.regexp_replace(text, TOKEN, " "))) > 0
    touched = op.isin("click", "type", "select")
    reason = (
        F.when(~valid_schema(F.col("op")), "schema")
        .when(touched & blank(F.col("element_id")), "missing_element")
        .when(touched & F.col("there").isNull(), "unknown_element")
        .when(touched & ~F.col("planned_print").eqNullSafe(F.col("fingerprint")), "stale_element")
        .when(touched & F.coalesce(F.try_element_at("state", F.lit("disabled")), F.lit(False)), "disabled_element")
        .when(writes & bad.isNotNull(), bad)
        .when(writes & raw, "raw_value_in_text")
    )
    out = rows.withColumn("op_now", repaired).withColumn("why", reason)
    return out.select(*actions.columns, F.col("why").isNull().alias("ok"), F.col("why").alias("reject_reason"), F.col("op_now").alias("op_done"), (F.col("why").isNull() & consequential(op, F.col("label"))).alias("needs_confirm"))


def plan_next(requests: DataFrame) -> DataFrame:
    """A rule planner: requests (task, screen_map, legend, history) with their next action.

    The first empty field whose wanted type has an unused token in the task
    (or, if the task names none, in the legend) gets it; else the first submit
    button is clicked, once; else it is done.
    """
    task_tokens = F.regexp_extract_all(F.coalesce("task", F.lit("")), F.lit(TOKEN), F.lit(0))
    candidates = F.when(F.size(task_tokens) > 0, task_tokens).otherwise(F.map_keys("legend"))
    typed = F.filter("history", lambda h: h["op"] == "type")
    used, filled = F.transform(typed, lambda h: h["text"]), F.transform(typed, lambda h: h["element_id"])
    enabled = lambda e: ~F.coalesce(F.try_element_at(e["state"], F.lit("disabled")), F.lit(False))

    def choice(e: Column) -> Column:
        open_ = e["role"].isin("textbox", "combobox") & blank(e["value"]) & ~F.array_contains(filled, e["id"]) & (e["field_type"].isNull() | e["field_type"].isin(FILLABLE)) & enabled(e)
        want = wanted_type(e["field_type"], e["label"])
        token = F.try_element_at(F.filter(candidates, lambda t: ~F.array_contains(used, t) & (F.try_element_at(F.col("legend"), t) == want)), F.lit(1))
        text = F.concat(F.when(blank(e["label"]), e["id"]).otherwise(e["label"]), F.lit(" expects "), want)
        return F.when(F.coalesce(open_, F.lit(False)) & token.isNotNull(), F.struct(F.lit("type").alias("op"), e["id"].alias("element_id"), token.alias("text"), text.alias("reason")))

    fill = F.try_element_at(F.filter(F.transform("screen_map", choice), lambda a: a.isNotNull()), F.lit(1))
    button = F.try_element_at(F.filter("screen_map", lambda e: (e["role"] == "button") & e["label"].rlike(SUBMITS) & enabled(e)), F.lit(1))
    clicked = F.exists("history", lambda h: (h["op"] == "click") & (h["element_id"] == button["id"]))
    act = lambda op, element, text, why: F.struct(F.lit(op).alias("op"), element.cast("string").alias("element_id"), text.cast("string").alias("text"), F.lit(why).alias("reason"))
    none = F.lit(None)
    rest = F.when(button.isNull(), act("done", none, none, "nothing left to do")).when(clicked, act("done", none, none, "submitted")).otherwise(act("click", button["id"], none, "all matching fields filled"))
    return requests.withColumn("action", F.coalesce(fill, rest))


def loop_note(action: Column, last: Column, legend: Column, element: Column) -> Column:
    """Which of four notes an action calls for, first come: repeats, unknown_placeholder, not_an_input, click_on_text_field; else null."""
    empty = lambda c: F.when(c != "", c)
    repeats = last.isNotNull() & action["op"].eqNullSafe(last["op"]) & action["element_id"].eqNullSafe(last["element_id"]) & empty(action["text"]).eqNullSafe(empty(last["text"]))
    unknown = F.exists(F.regexp_extract_all(F.coalesce(action["text"], F.lit("")), F.lit("<[A-Z_]+_\\d+>"), F.lit(0)), lambda t: ~F.map_contains_key(legend, t))
    writes = action["op"].isin("type", "select") & element.isNotNull() & ~element["role"].isin("textbox", "combobox", "searchbox", "spinbutton")
    clicks = (action["op"] == "click") & (element["role"] == "textbox")
    return F.when(action.isNull(), F.lit(None)).when(repeats, "repeats").when(unknown, "unknown_placeholder").when(writes, "not_an_input").when(clicks, "click_on_text_field")


#: Fixed value: the prompt's line on the guess of an image classifier, around label, score and margin.
HINT = (
    "\nOptional local image classifier (experimental, five fixed UI states): ", "; cosine score ", ", top-two margin ",
    ". May be wrong; use the elements and masked image as primary evidence.",
)


def render_screen(requests: DataFrame, most: int = 150) -> DataFrame:
    """Requests with column ``prompt``: the screen as text, with legend, unused tokens and the last ten actions.

    A column ``semantic_hint`` (label, score, margin) is told where the request has an image too (column ``has_image``).
    """
    quote = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), "(?s)^\\{\"v\":(.*)\\}$", 1)
    quote_all = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, quote), ", "), F.lit("]"))
    flags = lambda e: F.map_keys(F.map_filter(e["state"], lambda k, v: v))

    def line(e: Column) -> Column:
        parts = [
            e["id"], e["role"],
            F.when(~blank(e["label"]), quote(e["label"])),
            F.when(~blank(e["field_type"]), F.concat(F.lit("type="), e["field_type"])),
            F.when(~blank(e["value"]), F.concat(F.lit("value="), quote(e["value"]))),
            F.when(F.size(e["options"]) > 0, F.concat(F.lit("options="), quote_all(e["options"]))),
            F.when(F.size(flags(e)) > 0, F.concat(F.lit("["), F.array_join(flags(e), ","), F.lit("]"))),
        ]
        return F.concat_ws(" ", *parts)

    more = F.size("screen_map") - most
    lines = F.concat(F.transform(F.slice("screen_map", 1, most), line), F.when(more > 0, F.array(F.format_string("... %d more elements not shown", more))).otherwise(F.array().cast("array<string>")))
    words = lambda c, none: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(none)
    used = F.transform(F.filter("history", lambda h: h["op"].isin("type", "select") & ~blank(h["text"])), lambda h: h["text"])
    shown = words(F.transform(F.map_entries("legend"), lambda e: F.concat_ws("=", e["key"], e["value"])), "(none)")
    unused = words(F.array_except(F.map_keys("legend"), used), "(all used)")
    last = F.slice("history", F.greatest(F.size("history") - 9, F.lit(1)), 10)
    done = F.transform(last, lambda h: F.rtrim(F.concat(F.lit("- "), h["op"], F.lit(" "), F.coalesce(h["element_id"], F.lit("")), F.lit(" "), F.coalesce(h["text"], F.lit("")))))
    hint = F.lit("")
    if "semantic_hint" in requests.columns:
        h = F.col("semantic_hint")
        told = F.concat(F.lit(HINT[0]), h["label"], F.lit(HINT[1]), fixed(h["score"], 3), F.lit(HINT[2]), fixed(h["margin"], 3), F.lit(HINT[3]))
        hint = F.coalesce(F.when(h.isNotNull() & F.col("has_image"), told), F.lit(""))
    # the words between the parts are fixed values: a planner's prompt
    prompt = F.concat(
        F.lit("Task: "), F.col("task"), F.lit("\nSite: "), F.col("url_origin"), F.lit("\nLegend (placeholder=type): "), shown, F.lit("\nNot used yet: "), unused,
        F.lit("\n\nElements:\n"), F.array_join(lines, "\n"), hint, F.lit("\n\nDone so far:\n"), F.when(F.size(done) > 0, F.array_join(done, "\n")).otherwise("(none)"), F.lit("\n\nNext action JSON:"),
    )
    return requests.withColumn("prompt", prompt)


def manifest(label: Column, value: Column, options: Column) -> Column:
    """The distinct tokens that an element carries across label, value and options."""
    return F.array_distinct(F.flatten(F.concat(F.array(tokens_in(label), tokens_in(value)), F.transform(F.coalesce(options, F.array().cast("array<string>")), tokens_in))))


SCHEME = "quillmask-redact/2"


def redaction_manifest(screen: DataFrame, dictionary: DataFrame, opaque: DataFrame | None = None, key: str = "scope", scheme: str = SCHEME) -> DataFrame:
    """For each scope: scheme, placeholder_format, legend, masked_elements, masked_element_count, opaque_regions, and all as JSON."""
    carried = screen.withColumn("tokens", manifest(F.col("label"), F.col("value"), F.col("options"))).filter(F.size("tokens") > 0)
    masked = carried.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(F.col("id").alias("element_id"), "tokens").alias("m")))), lambda x: x["m"]).alias("masked_elements"))
    types = dictionary.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("token", "type")))).alias("legend"))
    out = screen.select(key).distinct().join(masked, key, "left").join(types, key, "left")
    if opaque is not None:
        out = out.join(opaque.groupBy(key).agg(F.count("*").cast("int").alias("opaque_regions")), key, "left")
    none = F.array().cast("array<struct<element_id:string,tokens:array<string>>>")
    regions = F.coalesce("opaque_regions", F.lit(0)) if opaque is not None else F.lit(0)
    out = out.select(
        key, F.lit(scheme).alias("scheme"), F.lit("<TYPE_N>").alias("placeholder_format"), F.coalesce("legend", F.create_map().cast("map<string,string>")).alias("legend"),
        F.coalesce("masked_elements", none).alias("masked_elements"), F.size(F.coalesce("masked_elements", none)).alias("masked_element_count"), regions.alias("opaque_regions"),
    )
    return out.withColumn("json", F.to_json(F.struct(*[c for c in out.columns if c != key])))


def payload_json(payload: Column) -> Column:
    """A payload as it is sent: null fields are left out."""
    return F.to_json(payload, {"ignoreNullFields": "true"})


def unused_tokens(legend: Column, shown: Column) -> Column:
    """Tokens of a legend (a map) that a text does not hold."""
    return F.array_except(F.map_keys(legend), tokens_in(shown))
