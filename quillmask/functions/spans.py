"""Work on arrays of spans: fusion, trimming, gates, redaction and restoration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmask.functions.patterns import SPANS, no_spans, overlaps, span
from quillmask.functions.text import TOKEN, WIDE_SPACE, ascii_edges, let

TRIMMED = f"[{WIDE_SPACE},.:;]"
#: What a cut before a postal code can leave behind.
PIN_TAIL = f"(?i)[{WIDE_SPACE},]*\\b(pin ?code|pin|zip|postal code)\\z"


def moved(s: Column, start: Column, end: Column, text: Column | None = None) -> Column:
    """A span with other ends; with ``text``, its value is cut out anew."""
    value = s["value"] if text is None else F.substring(text, start + 1, end - start)
    return span(s["type"], start, end, value, s["source"], s["confidence"])


def shift_spans(spans: Column, by: Column) -> Column:
    """Spans moved left by ``by`` characters; those that would start before the text go."""
    return F.filter(F.transform(spans, lambda s: moved(s, s["start"] - by, s["end"] - by)), lambda s: s["start"] >= 0)


def of_types(spans: Column, types: list[str]) -> Column:
    return F.filter(spans, lambda s: s["type"].isin(types))


def subtract_spans(spans: Column, rules: Column) -> Column:
    """Each span's pieces outside of all rule spans."""

    def cut(pieces: Column, r: Column) -> Column:
        def sides(p: Column) -> Column:
            left = moved(p, p["start"], F.greatest(p["start"], r["start"]))
            right = moved(p, F.least(p["end"], r["end"]), p["end"])
            return F.when(~overlaps(p, r), F.array(p)).otherwise(F.filter(F.array(left, right), lambda x: x["end"] > x["start"]))

        return F.flatten(F.transform(pieces, sides))

    return F.flatten(F.transform(spans, lambda s: F.aggregate(rules, F.array(s).cast(SPANS), cut)))


def merge_spans(*lists: Column) -> Column:
    """Fusion: rule spans stay; model spans (source ``ner``) lose what rules cover, and model spans that overlap become one."""

    def fused(every: Column) -> Column:
        rules = F.filter(every, lambda s: s["source"] != "ner")
        pieces = subtract_spans(F.filter(every, lambda s: s["source"] == "ner"), rules)
        ordered = F.transform(F.array_sort(F.transform(F.concat(rules, pieces), lambda s, i: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), i.alias("i"), s.alias("s")))), lambda x: x["s"])

        def add(out: Column, s: Column) -> Column:
            last = F.try_element_at(out, F.lit(-1))
            clash = (F.size(out) > 0) & (s["start"] < last["end"])
            grow = (s["end"] > last["end"]) & (last["source"] == "ner") & (s["source"] == "ner")
            longer = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(moved(last, last["start"], s["end"])))
            return F.when(F.coalesce(clash & grow, F.lit(False)), longer).when(F.coalesce(clash, F.lit(False)), out).otherwise(F.concat(out, F.array(s)))

        return F.aggregate(ordered, no_spans(), add)

    return let(F.concat(*(F.coalesce(x, no_spans()) for x in lists)), fused)


def trim_span(text: Column, s: Column) -> Column:
    """A span without white space and punctuation around its value; an address also without the label of a postal code."""
    body = F.substring(text, s["start"] + 1, s["end"] - s["start"])
    lead = F.length(F.regexp_extract(body, f"\\A{TRIMMED}*", 0))
    core = F.regexp_replace(F.substring(body, lead + 1, F.length(body)), f"{TRIMMED}+\\z", "")
    core = F.when(s["type"] == "ADDRESS", F.regexp_replace(core, ascii_edges(PIN_TAIL), "")).otherwise(core)
    start = F.least(s["start"] + lead, s["end"])
    return let(F.struct(start.alias("a"), core.alias("v")), lambda x: span(s["type"], x["a"], x["a"] + F.length(x["v"]), x["v"], s["source"], s["confidence"]))


def enough_letters(s: Column) -> Column:
    """Not a model span of fewer than three ASCII letters or digits."""
    return (s["source"] != "ner") | (F.length(F.regexp_replace(s["value"], "[^A-Za-z0-9]", "")) >= 3)


def not_site_contact(s: Column, contact: Column, boilerplate: Column, page_host: Column) -> Column:
    """Not the published address of the site itself: a mailto link in boilerplate or of the page's domain, a tel link in boilerplate."""
    domain = F.lower(F.coalesce(F.try_element_at(F.split(s["value"], "@"), F.lit(2)), F.lit("")))
    host = F.coalesce(page_host, F.lit(""))
    own = (host != "") & (domain != "") & ((domain == host) | domain.endswith(F.concat(F.lit("."), host)))
    boiler = F.coalesce(boilerplate, F.lit(False))
    mail = (contact == "mailto") & (s["type"] == "EMAIL") & (boiler | own)
    tel = (contact == "tel") & (s["type"] == "PHONE") & boiler
    return ~F.coalesce(mail | tel, F.lit(False))


def not_boilerplate(s: Column, is_value: Column, boilerplate: Column) -> Column:
    """Not a model span in boilerplate, unless in a field's value."""
    return F.coalesce(is_value, F.lit(False)) | ~F.coalesce(boilerplate, F.lit(False)) | (s["source"] != "ner")


def redact(text: Column, spans: Column, token: Column | None = None) -> Column:
    """The text with each span replaced by its token: ``spans`` hold structs with start, end and token, apart from one another."""
    state = "struct<out:string,pos:int>"

    def step(acc: Column, s: Column) -> Column:
        done = F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), s["token"])
        return F.when(s["start"] < acc["pos"], acc).otherwise(F.struct(done.alias("out"), s["end"].cast("int").alias("pos")).cast(state))

    ordered = F.array_sort(spans, lambda a, b: a["start"] - b["start"])
    return F.aggregate(ordered, F.struct(F.lit("").alias("out"), F.lit(0).alias("pos")).cast(state), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))


def rehydrate(text: Column, dictionary: Column) -> Column:
    """The text with the values of the tokens in ``dictionary`` (a map); others stay."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    values = F.transform(found, lambda t: F.coalesce(F.try_element_at(dictionary, t), t))
    return F.array_join(F.flatten(F.zip_with(F.split(text, TOKEN, -1), values, lambda piece, v: F.array(F.coalesce(piece, F.lit("")), F.coalesce(v, F.lit(""))))), "")


def unknown_tokens(text: Column, dictionary: Column) -> Column:
    """The tokens of a text that the dictionary doesn't hold, in order, with repetitions."""
    return F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: ~F.map_contains_key(dictionary, t))


def known_values(text: Column, entries: Column) -> Column:
    """Spans (source ``known``) of dictionary values (array of type, value) wherever they stand alone in a text, in any case."""
    from quillmask.functions.text import quoted

    def found(e: Column) -> Column:
        pattern = F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), quoted(e["value"]), F.lit("(?![A-Za-z0-9])"))
        hits = F.regexp_extract_all(text, pattern, F.lit(0))
        state = "struct<pos:int,out:" + SPANS + ">"
        pieces = F.filter(F.zip_with(F.split(text, pattern, -1), hits, lambda p, v: F.struct(p.alias("p"), v.alias("v"))), lambda x: x["v"].isNotNull())

        def step(acc: Column, x: Column) -> Column:
            at = acc["pos"] + F.length(x["p"])
            end = at + F.length(x["v"])
            return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span(e["type"], at, end, x["v"], F.lit("known"), F.lit(1.0)))).alias("out")).cast(state)

        return F.aggregate(pieces, F.struct(F.lit(0).alias("pos"), F.array().alias("out")).cast(state), step, lambda acc: acc["out"])

    return F.flatten(F.transform(F.filter(entries, lambda e: F.length(e["value"]) >= 3), found))


