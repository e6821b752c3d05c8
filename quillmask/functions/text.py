"""Scalar text functions: normalisation, tokens, hashes, rounding and URLs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of ECMAScript.
WIDE_SPACE = "\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
#: A word boundary over ASCII word characters, whatever stands around them.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
TOKEN = "<([A-Z]+)_(\\d+)>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank(c: Column) -> Column:
    """Null or empty text."""
    return F.coalesce(c, F.lit("")) == ""


def ascii_edges(pattern: str) -> str:
    """A pattern whose ``\\b`` mean ASCII word boundaries."""
    return pattern.replace("\\b", EDGE)


def normalize_value(c: Column) -> Column:
    """Lower case without white space and ``- _ . ( ) / + , :``."""
    return F.regexp_replace(F.lower(c), f"[{WIDE_SPACE}\\-_.()/+,:]", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(c, f"[{WIDE_SPACE}]+", " "))


def split_identifiers(c: Column) -> Column:
    """camelCase, snake_case, kebab-case and dotted names as words."""
    return F.regexp_replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), "[_\\-.]", " ")


def quoted(c: Column) -> Column:
    """Text as a literal inside a regular expression."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def host_of(url: Column) -> Column:
    """Host of an absolute URL in lower case without ``www.``; empty if there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www\\.", ""), F.lit(""))


def origin_of(url: Column) -> Column:
    """Scheme and authority of an http or https URL, default ports left out; empty if there is none."""
    parts = F.lower(F.regexp_extract(url, "^(?i)(https?)://(?:[^/?#@]*@)?([^/?#]+)", 1)), F.lower(F.regexp_extract(url, "^(?i)(https?)://(?:[^/?#@]*@)?([^/?#]+)", 2))
    host = F.when(parts[0] == "http", F.regexp_replace(parts[1], ":80$", "")).otherwise(F.regexp_replace(parts[1], ":443$", ""))
    return F.when(F.coalesce(parts[1], F.lit("")) == "", F.lit("")).otherwise(F.concat(parts[0], F.lit("://"), host))


def tokens_in(c: Column) -> Column:
    """Distinct placeholders of a text, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0)))


def round3(c: Column) -> Column:
    """Three decimals, halves up."""
    return F.floor(c * 1000 + 0.5) / 1000


def fixed(c: Column, digits: int = 2, even: bool = False) -> Column:
    """A number with a fixed number of decimals (one at least) and no grouping, rounded by its exact value.

    Of two that are as near, the one further from 0, with ``even`` the one with
    an even last digit. (``format_string`` rounds the shortest decimal text of
    the number, so that 0.35, which is a little less, becomes 0.4.)
    """
    scale = 10**digits

    def rounded(x: Column) -> Column:
        ones = F.floor(F.abs(x))
        size = F.abs(x) - ones
        product = size * float(scale)
        whole = F.floor(product)
        above = product - whole
        high = size * float((1 << 27) + 1) - (size * float((1 << 27) + 1) - size)  # the upper half of the bits: its multiple is exact
        left = (high * float(scale) - product) + (size - high) * float(scale)  # what the product lost
        tie = whole % 2 == 1 if even else F.lit(True)
        return ones * scale + whole + F.when((above > 0.5) | ((above == 0.5) & ((left > 0) | ((left == 0) & tie))), 1).otherwise(0)

    def shown(x: Column) -> Column:
        cut = lambda n: F.concat(F.when(x < 0, "-").otherwise(""), F.substring(n, F.lit(1), F.length(n) - digits), F.lit("."), F.right(n, F.lit(digits)))
        plain = let(rounded(x).cast("string"), lambda n: let(F.when(F.length(n) > digits, n).otherwise(F.lpad(n, digits + 1, "0")), cut))
        return F.when(F.abs(x) < float(1 << 52), plain).otherwise(F.format_string(f"%.{digits}f", x))  # larger ones have halves at most

    return let(c.cast("double"), shown)


FNV_START, FNV_PRIME, MASK = 0x811C9DC5, 0x01000193, 0xFFFFFFFF


def fnv1a(text: Column, start: Column | None = None) -> Column:
    """32-bit FNV-1a over the characters of a text, as a long; ``start`` chains hashes."""
    units = F.filter(F.split(text, ""), lambda ch: ch != "")
    first = F.lit(FNV_START).cast("long") if start is None else start.cast("long")
    return F.aggregate(units, first, lambda h, ch: (h.bitwiseXOR(F.expr("0L") + F.ascii(ch)) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(MASK).cast("long")))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def estimate_tokens(text_bytes: Column, image: Column) -> Column:
    """A token for four bytes, and 765 for an image."""
    return (F.ceil(text_bytes / 4) + F.when(image, 765).otherwise(0)).cast("long")


def base64_bytes(c: Column) -> Column:
    return F.octet_length(F.unbase64(c))


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def clip(c: Column, length: int) -> Column:
    """At most ``length`` characters, the last an ellipsis where text was cut."""
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length - 1), F.lit("…"))).otherwise(c)


def blank_boxes(payload: Column) -> Column:
    """A serialised payload with empty bounding boxes."""
    return F.regexp_replace(payload, '"bbox":\\[[^\\]]*\\]', '"bbox":[]')


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if one has length 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)
