"""Detectors of personal identifiers in text: patterns, their checks, and overlap resolution, as one expression.

A span is ``STRUCT<type, start, end, value, source, confidence>`` with offsets
in characters, the end excluded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmask.functions.checksums import digits_only, gstin_valid, luhn_valid, valid_date, verhoeff_valid
from quillmask.functions.text import WIDE_SPACE, ascii_edges, let

SPAN = "struct<type:string,start:int,end:int,value:string,source:string,confidence:double>"
SPANS = f"array<{SPAN}>"

# Patterns, prefixes and codes that decide what is detected.
CARD_PREFIX = "^(4|5[1-5]|2[2-7]|3[47]|3[0689]|35|6011|64[4-9]|65|60|81|82|508|5[06-8]|6[37])"
VEHICLE_STATES = "AN AP AR AS BR CH CG DD DL DN GA GJ HP HR JH JK KA KL LA LD MH ML MN MP MZ NL OD OR PB PY RJ SK TN TR TS UK UA UP WB BH".split()
ACCOUNT_BEFORE = "(?i)\\b(account|acct|a/c)\\b[^0-9]{0,20}\\z"
BIRTH_BEFORE = "(?i)\\b(d[o0]b|d\\.[o0]\\.b|birth|born)\\b"
PIN_BEFORE = f"(?i)(pin ?code|pin|postal|zip|[A-Za-z]+,)[{WIDE_SPACE}]*[:\\-]?[{WIDE_SPACE}]*\\z"
MONTHS = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)"

Check = Callable[[Column, Callable[[int], Column]], Column]


@dataclass(frozen=True)
class Rule:
    name: str
    type: str
    priority: int
    confidence: float
    pattern: str
    #: From the value and the text before it (by width) whether the match counts.
    check: Check | None = None


def _has(c: Column, pattern: str) -> Column:
    return c.rlike(ascii_edges(pattern))


def _account_label(before: Callable[[int], Column]) -> Column:
    return _has(before(40), ACCOUNT_BEFORE)


def _same_digit(c: Column) -> Column:
    return c.rlike("^(\\d)\\1+$")


def _card(value: Column, before: Callable[[int], Column]) -> Column:
    d = digits_only(value)
    number = F.length(d).between(13, 19) & luhn_valid(d) & ~_same_digit(d) & d.rlike(CARD_PREFIX)
    return number & (~_account_label(before) | _has(before(40), "(?i)card"))


def _octets(value: Column, before: Callable[[int], Column]) -> Column:
    return F.forall(F.split(value, "\\."), lambda o: (o.cast("int") <= 255) & ~((F.length(o) > 1) & o.startswith("0")))


def _numeric_date(value: Column, before: Callable[[int], Column]) -> Column:
    part = lambda i: F.element_at(F.split(value, "[/.-]"), i).cast("int")
    return valid_date(part(1), part(2), part(3)) & _has(before(40), BIRTH_BEFORE)


S = f"[{WIDE_SPACE}]"
#: In the order that decides ties.
RULES = (
    Rule("email", "EMAIL", 90, 0.99, "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}\\b"),
    Rule("email_spelled", "EMAIL", 89, 0.9, f"(?i)\\b[A-Za-z0-9._%+-]+{S}*[\\[(]{S}*at{S}*[\\])]{S}*[A-Za-z0-9-]+(?:{S}*(?:[\\[(]{S}*dot{S}*[\\])]|\\.){S}*[A-Za-z0-9-]+)+\\b"),
    Rule("upi", "UPI", 85, 0.95, "\\b[A-Za-z0-9][A-Za-z0-9._-]{1,255}@[A-Za-z]{2,64}\\b(?!\\.[A-Za-z])"),
    Rule("gstin", "GSTIN", 80, 0.99, "(?i)\\b\\d{2}[A-Z]{5}\\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]\\b", lambda v, b: gstin_valid(v)),
    Rule("pan", "PAN", 75, 0.97, "\\b[A-Z]{3}[ABCFGHLJPT][A-Z]\\d{4}[A-Z]\\b"),
    Rule("aadhaar", "AADHAAR", 70, 0.99, "(?<!\\d[ -]?)[2-9]\\d{3}[ -]?\\d{4}[ -]?\\d{4}(?![ -]?\\d)", lambda v, b: verhoeff_valid(digits_only(v)) & (~_account_label(b) | _has(b(40), "(?i)aadha+r|uid"))),
    Rule("card", "CARD", 65, 0.98, "\\b(?:\\d[ -]?){12,18}\\d\\b", _card),
    Rule("ifsc", "IFSC", 60, 0.97, "\\b[A-Z]{4}0[A-Z0-9]{6}\\b"),
    Rule("phone", "PHONE", 55, 0.93, "(?<![\\d+.])(?:\\+91[ -]?|0)?[6-9]\\d{4}[ .-]?\\d{5}\\b(?!\\.\\d)"),
    Rule("vehicle", "VEHICLE", 50, 0.9, "\\b([A-Z]{2})[ -]?\\d{1,2}[ -]?[A-Z]{1,3}[ -]?\\d{4}\\b", lambda v, b: F.substring(v, 1, 2).isin(VEHICLE_STATES)),
    Rule("passport", "PASSPORT", 45, 0.85, "\\b[A-PR-WY][1-9]\\d{6}\\b", lambda v, b: _has(b(40), "(?i)passport")),
    Rule("ip", "IP", 40, 0.95, "\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b", _octets),
    Rule("birth_numeric", "DOB", 35, 0.9, "\\b(\\d{1,2})[/.-](\\d{1,2})[/.-](\\d{4})\\b", _numeric_date),
    Rule("birth_spelled", "DOB", 34, 0.88, f"(?i)\\b(?:\\d{{1,2}}(?:st|nd|rd|th)?{S}+{MONTHS}[a-z]*,?{S}+\\d{{4}}|{MONTHS}[a-z]*{S}+\\d{{1,2}}(?:st|nd|rd|th)?,?{S}+\\d{{4}}|\\d{{4}}-\\d{{2}}-\\d{{2}})\\b", lambda v, b: _has(b(40), BIRTH_BEFORE)),
    Rule("account_alone", "ACCOUNT", 31, 0.7, f"\\A{S}*\\d{{9,18}}{S}*\\z", lambda v, b: ~_same_digit(F.regexp_replace(v, S, ""))),
    Rule("account_labelled", "ACCOUNT", 32, 0.85, "\\b\\d{9,18}\\b", lambda v, b: _account_label(b)),
    Rule("pincode", "PINCODE", 30, 0.85, "\\b[1-9]\\d{2}[ ]?\\d{3}\\b", lambda v, b: _has(b(30), PIN_BEFORE)),
)
BY_NAME = {r.name: r for r in RULES}


def span(kind: Column, start: Column, end: Column, value: Column, source: Column, confidence: Column) -> Column:
    return F.struct(kind.alias("type"), start.cast("int").alias("start"), end.cast("int").alias("end"), value.alias("value"), source.alias("source"), confidence.cast("double").alias("confidence"))


def no_spans() -> Column:
    return F.array().cast(SPANS)


def matches(text: Column, pattern: str) -> Column:
    """Array of (value, start) of all matches of a pattern, by the pieces between them."""
    state = "struct<pos:int,out:array<struct<value:string,start:int>>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), found, lambda piece, value: F.struct(piece.alias("piece"), value.alias("value")))
    pairs = F.filter(pairs, lambda p: p["value"].isNotNull())

    def step(acc: Column, p: Column) -> Column:
        at = acc["pos"] + F.length(p["piece"])
        return F.struct((at + F.length(p["value"])).alias("pos"), F.concat(acc["out"], F.array(F.struct(p["value"].alias("value"), at.alias("start")))).alias("out")).cast(state)

    return F.aggregate(pairs, F.struct(F.lit(0).alias("pos"), F.array().alias("out")).cast(state), step, lambda acc: acc["out"])


def rule_spans(text: Column, rule: Rule) -> Column:
    """The spans that one rule finds, in order."""
    pattern = ascii_edges(rule.pattern)

    def made(m: Column) -> Column:
        return span(F.lit(rule.type), m["start"], m["start"] + F.length(m["value"]), m["value"], F.lit("pattern"), F.lit(rule.confidence))

    def counts(m: Column) -> Column:
        return rule.check(m["value"], lambda width: F.substring(text, F.greatest(m["start"] - width, F.lit(0)) + 1, F.least(m["start"], F.lit(width))))

    found = matches(text, pattern)
    if rule.check is not None:
        found = F.filter(found, counts)
    return F.when(text.rlike(pattern), F.transform(found, made)).otherwise(no_spans())


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def by_start(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: a["start"] - b["start"])


def keep_apart(ranked: Column) -> Column:
    """Of spans in falling rank those that overlap no kept one, by start."""
    kept = F.aggregate(ranked, no_spans(), lambda acc, s: F.when(F.exists(acc, lambda k: overlaps(s, k)), acc).otherwise(F.concat(acc, F.array(s))))
    return by_start(kept)


def detect_patterns(text: Column) -> Column:
    """All spans of a text, overlaps resolved by priority, then length, then the order of rules and places; null gives none."""
    def rank(rule: Rule, order: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(F.lit(-rule.priority).alias("p"), (s["start"] - s["end"]).alias("l"), F.lit(order).alias("i"), s["start"].alias("at"), s.alias("span"))

    ranked = [F.transform(rule_spans(text, rule), rank(rule, i)) for i, rule in enumerate(RULES)]
    found = let(F.array_sort(F.concat(*ranked)), lambda xs: keep_apart(F.transform(xs, lambda x: x["span"])))
    # every rule needs a digit, an @ or a bracket
    return F.when(F.coalesce(text.rlike("[0-9@\\[(]"), F.lit(False)), found).otherwise(no_spans())
