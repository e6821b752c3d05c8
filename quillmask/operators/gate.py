"""The leak gate: does a text that is about to leave hold a mapped value, an identifier or a canary?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.functions.patterns import detect_patterns
from quillmask.functions.text import normalize_value, quoted

HITS = "array<struct<kind:string,type:string,token:string,where:string>>"
MIN_NORMALIZED = 6
#: Widths of the stretches by which canaries are looked for.
WINDOWS = (16, 4, 1)
#: Bits of the filter of canaries: 512 KB, whatever their number.
FILTER_BITS = 1 << 22
#: Neither part of a longer word or number nor of a decimal.
BEFORE, AFTER = "(?i)(?<![A-Za-z0-9])(?<!\\d[.,])", "(?![A-Za-z0-9]|[.,]\\d)"


def stands_alone(text: Column, value: Column) -> Column:
    """The value occurs by itself, in any case."""
    return F.lower(text).contains(F.lower(value)) & F.rlike(text, F.concat(F.lit(BEFORE), quoted(value), F.lit(AFTER)))


def in_wire(text: Column, norm: Column, value: Column, least: int = MIN_NORMALIZED) -> Column:
    """The leak predicate of evaluations: normalised containment for long values, else by itself."""
    nv = normalize_value(value)
    return F.when(F.length(nv) >= least, norm.contains(nv)).otherwise(stands_alone(text, value))


def _hit(kind: Column, type_: Column, token: Column, where: str) -> Column:
    return F.struct(kind.alias("kind"), type_.cast("string").alias("type"), token.cast("string").alias("token"), F.lit(where).alias("where"))


def scan(text: Column, entries: Column, canaries: Column, where: str, least: int = MIN_NORMALIZED) -> Column:
    """Hits in a text: dictionary entries (token, type, value), identifiers, canaries."""
    norm = normalize_value(text)

    def kind(e: Column) -> Column:
        nv = normalize_value(e["value"])
        close = (F.length(nv) >= least) & norm.contains(nv)
        return F.when(nv == "", F.lit(None)).when(stands_alone(text, e["value"]), "map_exact").when(close, "map_normalized")

    mapped = F.filter(F.transform(F.coalesce(entries, F.array().cast("array<struct<token:string,type:string,value:string>>")), lambda e: _hit(kind(e), e["type"], e["token"], where)), lambda h: h["kind"].isNotNull())
    patterns = F.transform(detect_patterns(text), lambda s: _hit(F.lit("ocr" if where == "image" else "pattern"), s["type"], F.lit(None), where))
    planted = F.filter(F.coalesce(canaries, F.array().cast("array<string>")), lambda c: text.contains(c) | norm.contains(normalize_value(c)))
    return F.concat(mapped, patterns, F.transform(planted, lambda c: _hit(F.lit("canary"), F.lit(None), F.lit(None), where))).cast(HITS)


def leak_gate(payloads: DataFrame, payload: str = "payload", entries: str = "entries", canaries: str = "canaries", image_text: str = "image_text", least: int = MIN_NORMALIZED) -> DataFrame:
    """The rows with hits, pass, sha256 and bytes of their payload. Missing input columns count as null."""
    have = lambda c: F.col(c) if c in payloads.columns else F.lit(None)
    entry, canary, image = have(entries), have(canaries), have(image_text)
    body = F.coalesce(F.col(payload), F.lit(""))
    seen = F.when(F.coalesce(image.cast("string"), F.lit("")) != "", scan(image.cast("string"), entry, canary, "image", least)).otherwise(F.array().cast(HITS))
    return payloads.withColumn("hits", F.concat(scan(body, entry, canary, "payload", least), seen)).withColumns({"pass": F.size("hits") == 0, "sha256": F.sha2(body, 256), "bytes": F.octet_length(body).cast("long")})


def _key_form(c: Column) -> Column:
    """The normal form with one small sigma, as lower case depends on what stands beside it: a text that holds another has its form within its own."""
    return F.translate(normalize_value(c), "\u03c2", "\u03c3")


def _windows(c: Column, width: int) -> Column:
    """Hashes of all stretches of ``width`` characters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1)), lambda w: F.xxhash64(w)))


def _filter_of(keys: DataFrame) -> DataFrame:
    """One row: the widths of the keys (width, w), and a Bloom filter of FILTER_BITS bits as an array of longs.

    Its column ``zero`` is computed, as a join on a literal becomes a cross join.
    """
    at = F.pmod("w", F.lit(FILTER_BITS))
    words = keys.groupBy(F.floor(at / 64).alias("id")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(w, {FILTER_BITS}) % 64 AS INT))")).alias("m"))
    full = keys.sparkSession.range(FILTER_BITS // 64).join(words, "id", "left").agg(F.min("id").alias("zero"), F.array_sort(F.collect_list(F.struct("id", F.coalesce("m", F.lit(0)).alias("m")))).alias("a"))
    widths = keys.agg((F.min("width").cast("long") * 0).alias("zero"), F.collect_set("width").alias("widths"))
    return full.select("zero", F.transform("a", lambda x: x["m"]).alias("bits")).join(widths, "zero")


def canary_hits(payloads: DataFrame, canaries: DataFrame, key: str = "id", payload: str = "payload", canary: str = "canary", normalized: bool = True) -> DataFrame:
    """(key, canary) for payloads that hold a canary as it stands or in normal form, as in :func:`scan`; only as it stands without ``normalized``.

    A row for each payload and distinct canary in it, also where payloads share
    their key. A join by equality: a canary is looked for only in payloads that share a
    window of its normal form, the one that the fewest canaries have; candidates
    are then tested. Windows are as wide as the canary allows; a canary without
    a normal form is in every payload. A filter of fixed size thins out the
    payloads' windows first.
    """
    form = _key_form if normalized else lambda c: c
    forms = canaries.select(canary).filter(F.col(canary).isNotNull()).distinct().withColumn("form", form(F.col(canary)))
    width = F.lit(0)
    for n in sorted(WINDOWS):
        width = F.when(F.length("form") >= n, n).otherwise(width)
    forms = forms.withColumn("width", width)
    of_width = F.array(F.lit(0).cast("long"))
    for n in WINDOWS:
        of_width = F.when(F.col("width") == n, _windows(F.col("form"), n)).otherwise(of_width)
    own = forms.select(canary, "width", F.explode(of_width).alias("w"))
    shared = own.groupBy("width", "w").agg(F.count(F.lit(1)).alias("n"))
    keys = own.join(shared, ["width", "w"]).groupBy(canary, "width").agg(F.min(F.struct("n", "w")).alias("least")).select(canary, "width", F.col("least.w").alias("w"))

    texts = payloads.filter(F.col(payload).isNotNull()).select(F.col(key).alias("k"), F.col(payload).alias("p"))
    none = F.array().cast("array<long>")
    asked_for = lambda n, found: F.when(F.array_contains("widths", n), found).otherwise(none)
    windows = F.concat(asked_for(0, F.array(F.lit(0).cast("long"))), *(asked_for(n, _windows(form(F.col("p")), n)) for n in WINDOWS))
    bit = lambda w: F.expr("bits")[F.floor(F.pmod(w, F.lit(FILTER_BITS)) / 64).cast("int")].bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (F.pmod(w, F.lit(FILTER_BITS)) % 64).cast("int")))
    left = texts.withColumn("zero", F.length("p").cast("long") * 0).join(F.broadcast(_filter_of(keys)), "zero")
    left = left.select("k", F.explode(F.array_distinct(F.filter(windows, lambda w: bit(w) != 0))).alias("w"))
    asked = left.join(keys, "w").select(F.col("k").alias("hit"), canary).distinct()
    held = F.col("p").contains(F.col(canary))
    if normalized:
        held = held | normalize_value(F.col("p")).contains(normalize_value(F.col(canary)))
    return texts.join(asked, F.col("k").eqNullSafe(F.col("hit"))).filter(held).select(F.col("k").alias(key), canary)
