"""Quality rules: a short-circuit cascade of cheap document checks, in DataFrame functions only.

Every rule is a Boolean column that is true where a document must go. The
cascade is one nested CASE, so a document is tested by later rules only if the
earlier ones let it pass. The order of the rules comes from a bounded sample:
each rule's share of rejected rows (selectivity) and its run time (cost: the
least time of several runs over the repeated sample, less that of an empty
run, as a power of two) are measured, and rules go by falling rejection per
cost, of equals by name. As a document is kept only if no rule rejects it, the
order changes the work and never the verdict. The base measures are results of
their own, so they are taken of every document; a rule's cost is what it adds.

Defined results: null text counts as empty (no words, base_failed true, kept
false); an empty table gives an empty result; repeated rows are judged one by
one; other columns of the input are not touched (``measure`` adds columns whose
names start with ``q_``).
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Rows of the sample on which cost and selectivity are estimated, the longest text in it, and the share of rows it is thinned to.
SAMPLE_ROWS = 400
SAMPLE_CHARS = 20_000
SAMPLE_SHARE = 0.05
#: How often a run goes over the sample, and how often a run is timed.
REPEATS = 8
RUNS = 3
#: The least cost of a rule, in seconds a row.
LEAST_COST = 1e-7


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text: runs of anything but the six ASCII white-space characters."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def _tail(xs: Column, skip: int) -> Column:
    return F.slice(xs, skip + 1, F.greatest(F.size(xs) - skip, F.lit(0)))


def _head(xs: Column, drop: int) -> Column:
    return F.slice(xs, 1, F.greatest(F.size(xs) - drop, F.lit(0)))


def _windows(words: Column) -> Column:
    """One 64-bit hash for each 8-word window, by doubling: 1 -> 2 -> 4 -> 8 words."""

    def double(xs: Column, step: int) -> Column:
        return F.zip_with(_head(xs, step), _tail(xs, step), lambda a, b: F.xxhash64(a, b))

    one = F.transform(words, lambda w: F.xxhash64(w))
    return let(one, lambda a: let(double(a, 1), lambda b: let(double(b, 2), lambda c: double(c, 4))))


def _covered(windows: Column) -> Column:
    """Words under windows whose hash occurs twice or more, first occurrences included."""
    placed = F.array_sort(
        F.zip_with(windows, F.sequence(F.lit(0), F.size(windows) - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )

    def doubled(s: Column) -> Column:
        # neighbours in (hash, place) order with the same hash mark both places
        pairs = F.zip_with(_head(s, 1), _tail(s, 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

    def length(at: Column) -> Column:
        gaps = F.zip_with(_head(at, 1), _tail(at, 1), lambda a, b: F.least(b - a, F.lit(WINDOW)).cast("long"))
        return F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda acc, g: acc + g)

    return let(placed, lambda s: let(doubled(s), length))


def repeat_words(words: Column) -> Column:
    """Words in 8-word windows found twice or more in the text."""
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(
        let(
            _windows(words),
            lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_covered(w)),
        )
    )


def _removed(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, chars, ""))).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with the base measures: q_words, q_word_chars, q_symbols, q_dup_lines, q_repeat_words (all long)."""
    body = F.coalesce(F.col(text), F.lit(""))
    stats = let(
        words_of(F.col(text)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n"),
            F.length(F.array_join(w, "")).cast("long").alias("chars"),
            repeat_words(w).alias("repeats"),
        ),
    )
    lines = let(_lines(body), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return (
        docs.withColumn("q_stats", stats)
        .withColumn("q_words", F.col("q_stats.n"))
        .withColumn("q_word_chars", F.col("q_stats.chars"))
        .withColumn("q_repeat_words", F.col("q_stats.repeats"))
        .withColumn("q_symbols", F.size(F.regexp_extract_all(body, F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("long"))
        .withColumn("q_dup_lines", lines)
        .drop("q_stats")
    )


def base_failed() -> Column:
    return (F.col("q_words") < MIN_WORDS) | (100 * F.col("q_repeat_words") > MAX_REPEAT_PERCENT * F.col("q_words"))


def rules(text: str = "text") -> dict[str, Column]:
    """The rules beyond the base, each true where the document must go."""
    body, n = F.coalesce(F.col(text), F.lit("")), F.col("q_words")
    letters = F.length(F.regexp_replace(body, r"\P{L}+", ""))
    return {
        "symbols": 10 * F.col("q_symbols") > 3 * n,
        "word_length": (F.col("q_word_chars") > 20 * n) | (2 * F.col("q_word_chars") < 3 * n),
        "repeated_lines": let(F.size(_lines(body)).cast("long"), lambda k: (k >= 4) & (2 * F.col("q_dup_lines") > k)),
        "exclamations": 2 * _removed(body, "!") > n,
        "capitals": 10 * _removed(body, r"\p{Lu}+") > 6 * letters,
        "few_letters": 2 * letters < F.length(body),
    }


def sample_of(docs: DataFrame, rows: int, text: str) -> DataFrame:
    """At most ``rows`` texts: every 20th or so of the partitions that are read for them, or the first where these are too few.

    Partitions are read only until there are enough rows, so it costs the same
    at any size. Texts over SAMPLE_CHARS are passed over: the sample only
    steers the order of the rules.
    """
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text)).filter(F.length(text) <= SAMPLE_CHARS)
    taken = texts.sample(SAMPLE_SHARE, seed=1).take(rows)
    if len(taken) < rows:
        taken = texts.take(rows)
    return docs.sparkSession.createDataFrame([(r[0],) for r in taken], f"`{text}` string")


def costs(sample: DataFrame, checks: dict[str, Column], clock: Callable[[], float] = time.perf_counter) -> dict[str, float]:
    """Seconds a row of each rule over a measured sample, as powers of two."""
    often = sample.withColumn("q_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def least(rule: Column) -> float:
        took = []
        for _ in range(RUNS):
            began = clock()
            often.agg(F.count_if(rule)).collect()
            took.append(clock() - began)
        return min(took)

    empty, n = least(F.col("q_words") < 0), max(1, sample.count()) * REPEATS
    return {name: 2.0 ** round(math.log2(max((least(rule) - empty) / n, LEAST_COST))) for name, rule in checks.items()}


def rule_order(docs: DataFrame, checks: dict[str, Column], sample_rows: int = SAMPLE_ROWS, text: str = "text") -> list[str]:
    """Names of the rules by falling rejection per cost, measured on a sample of at most ``sample_rows`` rows."""
    sample = measure(sample_of(docs, sample_rows, text), text).persist()
    try:
        hits = sample.agg(*(F.count_if(rule).alias(name) for name, rule in checks.items())).first()
        cost = costs(sample, checks)
        return sorted(checks, key=lambda k: (-(hits[k] + 0.5) / cost[k], k))
    finally:
        sample.unpersist()


def cascade(checks: dict[str, Column], order: list[str]) -> Column:
    """The name of the first rule that rejects, null where all let pass; later rules are not evaluated."""
    first = F.lit(None).cast("string")
    for name in reversed(order):
        first = F.when(checks[name], F.lit(name)).otherwise(first)
    return first


def quality_rules(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The input with the base measures, q_base_failed, q_rule (what rejected it, else null) and q_kept."""
    checks = rules(text)
    order = rule_order(docs, checks, sample_rows, text)
    return (
        measure(docs, text)
        .withColumn("q_base_failed", base_failed())
        .withColumn("q_rule", F.when(F.col("q_base_failed"), F.lit("base")).otherwise(cascade(checks, order)))
        .withColumn("q_kept", F.col("q_rule").isNull())
    )
