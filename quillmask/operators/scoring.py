"""Evaluation: predictions against truth, by type, page, site and template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.functions.text import normalize_value

#: Types that rules are not meant for.
UNSTRUCTURED = ("NAME", "ADDRESS")


def _share(a: Column, b: Column, none: Column) -> Column:
    return F.when(a + b > 0, a / (a + b)).otherwise(none)


def with_rates(counts: DataFrame, none: Column | None = None) -> DataFrame:
    """Rows (tp, fp, fn) with precision, recall and f1; ``none`` (1 if absent) where nothing was counted."""
    empty = F.lit(1.0) if none is None else none
    out = counts.withColumns({"precision": _share(F.col("tp"), F.col("fp"), empty), "recall": _share(F.col("tp"), F.col("fn"), empty)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0 if none is None else F.lit(None)))


def matched(predicted: DataFrame, truth: DataFrame, decoys: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """Rows (key, type, norm, outcome tp, fn or fp, decoy) from predictions and truth (key, type, value).

    Truth counts per row, predictions per distinct (type, normal form).
    """
    norm = normalize_value(F.col("value")).alias("norm")
    p, t = predicted.select(key, "type", norm).distinct(), truth.select(key, "type", norm)
    on = [key, "type", "norm"]
    tp = t.join(p, on, "left_semi").withColumn("outcome", F.lit("tp"))
    fn = t.join(p, on, "left_anti").withColumn("outcome", F.lit("fn"))
    fp = p.join(t, on, "left_anti").withColumn("outcome", F.lit("fp"))
    out = tp.unionByName(fn).unionByName(fp)
    if decoys is None:
        return out.withColumn("decoy", F.lit(False))
    d = decoys.select(key, norm).distinct().withColumn("_decoy", F.lit(True))
    return out.join(d, [key, "norm"], "left").withColumn("decoy", F.coalesce("_decoy", F.lit(False)) & (F.col("outcome") == "fp")).drop("_decoy")


def by_type(outcomes: DataFrame) -> DataFrame:
    """Rates for each type, for structured and unstructured types, and for all, as one pass of grouping sets (level type, kind, all)."""
    marked = outcomes.withColumn("structured", ~F.col("type").isin(*UNSTRUCTURED))
    counted = marked.groupingSets([["type", "structured"], ["structured"], []], "type", "structured").agg(
        *(F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")), F.grouping("type").alias("g1"), F.grouping("structured").alias("g2")
    )
    level = F.when(F.col("g2") == 1, "all").when(F.col("g1") == 1, "kind").otherwise("type")
    return with_rates(counted.withColumn("level", level).drop("g1", "g2"))


def by_template(outcomes: DataFrame, template: str = "template") -> DataFrame:
    """Recall and counts for each template and in total (template null)."""
    return with_rates(outcomes.rollup(template).agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn"))))


def leak_counters(pages: DataFrame) -> DataFrame:
    """One row from pages (leaked array of types, gate_pass, canary_pass): values leaked, pages with a leak, gates passed and passed with a leak."""
    leak = F.size("leaked") > 0
    return pages.agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.size("leaked")).alias("leaked_values"), F.count_if(leak).alias("pages_with_leak"), F.count_if(F.col("gate_pass")).alias("gate_passed"), F.count_if(F.col("gate_pass") & leak).alias("gate_passed_with_leak"),
        F.count_if(F.col("canary_pass")).alias("canary_passed"), F.count_if(F.col("canary_pass") & leak).alias("canary_passed_with_leak"),
    )


def within_values(inner: DataFrame, outer: DataFrame, key: str, least: int) -> DataFrame:
    """The distinct (key, inner, outer) where a value is part of another, or equal to it, from distinct (key, inner) and (key, outer).

    Only inner values of ``least`` or more characters count. An outer value
    gives its parts of those lengths that its key's inner values have, and the
    parts meet the inner values by equality: no pair is formed that isn't a
    match. Meant for values of fields, not for whole texts.
    """
    long = inner.filter(F.length("inner") >= least)
    lengths = long.select(key, F.length("inner").alias("n")).distinct()
    slots = outer.withColumn("size", F.length("outer")).join(lengths, key).filter(F.col("n") <= F.col("size"))
    parts = F.transform(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1), lambda i: F.substring(F.col("outer"), i, F.col("n")))
    return slots.select(key, "outer", F.explode(F.array_distinct(parts)).alias("inner")).join(long, [key, "inner"]).select(key, "inner", "outer")


def score_sites(masked: DataFrame, positives: DataFrame, benign: DataFrame, key: str = "site") -> DataFrame:
    """Per site: positives, tp, fn, fp, tn, benign_masked, type_ok and rates, from masked and annotated values (key, type, value).

    Two values are the same if their normal forms are equal, or one of six or
    more characters is in the other; a benign value is masked if either holds
    the other. Distinct values are matched, then counted by their rows. Of
    several masked values that fit, the least token gives the type.
    """
    norm = normalize_value(F.col("value"))
    m = masked.select(key, F.col("token"), F.col("type").alias("m_type"), norm.alias("m"))
    p = positives.select(key, F.col("type").alias("p_type"), norm.alias("p"))
    b = benign.select(key, norm.alias("b"))
    m_values = m.groupBy(key, "m").agg(F.min(F.struct("token", "m_type")).alias("first"))
    p_values, b_values = p.select(key, "p").distinct(), b.select(key, "b").distinct()

    def either(others: DataFrame, name: str, least: int) -> DataFrame:
        inner, outer = m_values.select(key, F.col("m").alias("inner")), others.select(key, F.col(name).alias("outer"))
        one = within_values(inner, outer, key, least).select(key, F.col("inner").alias("m"), F.col("outer").alias(name))
        two = within_values(outer.withColumnRenamed("outer", "inner"), inner.withColumnRenamed("inner", "outer"), key, least).select(key, F.col("outer").alias("m"), F.col("inner").alias(name))
        return one.unionByName(two)

    equal = m_values.select(key, "m").join(p_values.withColumn("m", F.col("p")), [key, "m"])
    hits = either(p_values, "p", 6).unionByName(equal).distinct()
    first = hits.join(m_values, [key, "m"]).groupBy(key, "p").agg(F.min("first").alias("first"))
    ok = F.col("first.m_type") == F.col("p_type")
    positive = p.join(first, [key, "p"], "left").groupBy(key).agg(F.count(F.lit(1)).alias("positives"), F.count("first").alias("tp"), F.count_if(F.col("first").isNull()).alias("fn"), F.count_if(ok).alias("type_ok"))
    false = m.join(hits.select(key, "m").distinct(), [key, "m"], "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("fp"))
    touched = either(b_values, "b", 0).select(key, "b").distinct().withColumn("hit", F.lit(True))
    negative = b.join(touched, [key, "b"], "left").groupBy(key).agg(F.count_if(F.col("hit").isNull()).alias("tn"), F.count("hit").alias("benign_masked"))
    out = positive.join(false, key, "left").join(negative, key, "left").na.fill(0, ["fp", "tn", "benign_masked"])
    return with_rates(out, F.lit(None)).withColumn("type_accuracy", F.when(F.col("tp") > 0, F.col("type_ok") / F.col("tp")))


def micro_macro(sites: DataFrame) -> DataFrame:
    """One row of totals with micro rates and the means of the sites' rates (null counts as 0)."""
    total = sites.agg(*(F.sum(c).alias(c) for c in ("tp", "fn", "fp", "tn", "positives")), F.avg(F.coalesce("precision", F.lit(0.0))).alias("macro_precision"), F.avg(F.coalesce("recall", F.lit(0.0))).alias("macro_recall"))
    return with_rates(total, F.lit(None))


def byte_reduction(pages: DataFrame, group: str = "template") -> DataFrame:
    """Mean raw and sanitised bytes and the reduction in per cent (columns raw, safe)."""
    out = pages.groupBy(group).agg(F.count(F.lit(1)).alias("pages"), F.avg(F.octet_length("raw")).alias("raw_mean"), F.avg(F.octet_length("safe")).alias("safe_mean"))
    return out.withColumn("reduction_pct", F.floor((100 * (1 - F.col("safe_mean") / F.col("raw_mean"))) * 10 + 0.5) / 10)


def screen_recall(truth: DataFrame, found: DataFrame, key: str = "page_id", node: str = "nodeId") -> DataFrame:
    """Per page: interactive elements, how many are on the screen, and how many have the label they should (by its first 24 characters)."""
    clean = lambda c: F.lower(F.trim(F.regexp_replace(c, "\\s+", " ")))
    both = truth.join(found.select(key, node, F.col("label").alias("shown")), [key, node], "left")
    want = F.substring(clean(F.col("label")), 1, 24)
    return both.groupBy(key).agg(F.count(F.lit(1)).alias("truth"), F.count("shown").alias("found"), F.count_if((want != "") & clean(F.col("shown")).contains(want)).alias("label_ok"))


def suppression(cards: DataFrame) -> DataFrame:
    """Per type: values, how many could be read before masking and after (columns type, value, before, after)."""
    nv = normalize_value(F.col("value"))
    read = lambda c: F.count_if(normalize_value(F.col(c)).contains(nv))
    return cards.groupBy("type").agg(F.count(F.lit(1)).alias("n"), read("before").alias("readable_before"), read("after").alias("readable_after"))


def heading_failure(found: Column, header: Column) -> Column:
    """correct, wrong_header, ambiguous_header or unreadable_header from the headings found in a text."""
    one = F.try_element_at(found, F.lit(1))
    return F.when(F.size(found) > 1, "ambiguous_header").when(F.size(found) == 0, "unreadable_header").when(one == header, "correct").otherwise("wrong_header")
