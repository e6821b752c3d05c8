"""Step metrics: quantiles by three definitions, rollups by run, CSV lines and the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmask.functions.text import escape_html, fixed
from quillmask.session import cut_lineage

STEP_SCHEMA = (
    "run_id string, step int, ts bigint, origin string, outcome string, action string, reused boolean, elements int, opaque int, placeholders int, image_detections int, "
    "image_sent boolean, bytes bigint, tokens_est bigint, gate_hits int, ms_observe double, ms_sanitize double, ms_vision double, ms_gate double, ms_server double, "
    "ms_total double, model_load_ms double, ms_validate double, ms_confirm double, ms_execute double"
)
STEP_COLUMNS = [f.split()[0] for f in STEP_SCHEMA.split(", ")]
STAGES = ("observe", "sanitize", "vision", "gate", "server", "validate", "confirm", "execute", "total")


#: Where a quantile stands among n sorted values, as places from 0: between two of them, at floor(q n), or at ceil(q n) - 1.
PLACES = {
    "linear": lambda n, q: (F.floor((n - 1) * q), F.ceil((n - 1) * q)),
    "floor": lambda n, q: (F.least(n - 1, F.floor(n * q)),) * 2,
    "ceil": lambda n, q: (F.greatest(F.ceil(n * q), F.lit(1)) - 1,) * 2,
}


def _between(low: Column, high: Column, part: Column) -> Column:
    """low * (1 - part) + high * part, the first product unrounded: what lies between equal values is that value, to the last bit."""
    upper = lambda x: x * float((1 << 27) + 1) - (x * float((1 << 27) + 1) - x)
    rest = 1 - part
    a, b = low * rest, high * part
    lost = upper(low) * upper(rest) - a + upper(low) * (rest - upper(rest)) + (low - upper(low)) * upper(rest) + (low - upper(low)) * (rest - upper(rest))
    total = a + b
    return F.nanvl(total + ((a - (total - (total - a))) + (b - (total - a)) + lost), total)


def quantiles(rows: DataFrame, by: str, value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact quantiles of each group, a row per value of ``by``; ``wanted`` maps a column's name to (kind, q), kinds as in ``PLACES``.

    Values are counted before they are shuffled, dealt by ranges of (group,
    value), and numbered range by range: a group of any size is shared by many
    tasks. Nulls are no values; a group without values has null.
    """
    counted = rows.groupBy(by, value).agg(F.count(value).alias("n")).repartitionByRange(by, value)
    ranges = cut_lineage(counted.withColumn("part", F.spark_partition_id()))  # kept, as a second run might draw other ranges
    w = Window.partitionBy(by).orderBy("part")
    sizes = ranges.groupBy(by, "part").agg(F.sum("n").alias("size"))  # a row per group and range
    sizes = sizes.withColumns({"before": F.sum("size").over(w) - F.col("size"), "total": F.sum("size").over(Window.partitionBy(by))})
    sizes = sizes.select(F.col(by).alias("_by"), F.col("part").alias("_part"), "before", "total")
    ranked = ranges.join(sizes, F.col(by).eqNullSafe(F.col("_by")) & (F.col("part") == F.col("_part")))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(by, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranked.withColumn("upto", upto)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("n") <= place) & (place < F.col("upto")), F.col(value)))

    n, picked, columns = F.col("total"), [], [F.col(by)]
    for name, (kind, q) in wanted.items():
        low, high = PLACES[kind](n, q)
        picked += [at(low).alias(f"{name}_low"), at(high).alias(f"{name}_high")]
        part = (F.col("total") - 1) * q - F.floor((F.col("total") - 1) * q)
        between = _between(F.col(f"{name}_low").cast("double"), F.col(f"{name}_high").cast("double"), part)
        columns.append((between if kind == "linear" else F.col(f"{name}_low")).alias(name))
    return ranked.groupBy(by).agg(F.max("total").alias("total"), *picked).select(*columns)


def _stage(name: str) -> Column:
    return F.coalesce(F.col(f"ms_{name}"), F.lit(0.0))


def summarize_steps(steps: DataFrame) -> DataFrame:
    """One row: runs, steps, shares of reused and image steps, blocked, payload means, totals, and p50 and p95 of every stage (0 without steps)."""
    n = F.greatest(F.lit(1), F.count(F.lit(1)))
    out = steps.agg(
        F.count_distinct("run_id").alias("runs"), F.count(F.lit(1)).alias("steps"), (100 * F.count_if(F.col("reused")) / n).alias("reused_pct"), (100 * F.count_if(F.col("image_sent")) / n).alias("image_pct"),
        F.count_if(F.col("outcome") == "blocked").alias("blocked"), (F.coalesce(F.sum("bytes"), F.lit(0)) / n).alias("bytes_mean"), (F.coalesce(F.sum("tokens_est"), F.lit(0)) / n).alias("tokens_mean"),
        F.coalesce(F.sum("tokens_est"), F.lit(0)).alias("tokens_total"), F.greatest(F.lit(0.0), F.max("model_load_ms")).alias("model_load_ms"),
    )
    times = steps.select(F.inline(F.array(*(F.struct(F.lit(s).alias("stage"), _stage(s).alias("ms")) for s in STAGES))))
    found = quantiles(times, "stage", "ms", {"p50": ("linear", 0.5), "p95": ("linear", 0.95)})
    one = lambda s, p: F.coalesce(F.max(F.when(F.col("stage") == s, F.col(p))), F.lit(0.0)).alias(f"{s}_{p}")
    return out.crossJoin(found.agg(*(one(s, p) for s in STAGES for p in ("p50", "p95"))))  # two single rows


def _running(steps: DataFrame) -> DataFrame:
    """The steps with their run's time so far: added step by step, as sums of doubles depend on the order."""
    return steps.withColumn("_so_far", F.sum(_stage("total")).over(Window.partitionBy("run_id").orderBy("step")))


def _task_time() -> Column:
    return F.coalesce(F.max_by("_so_far", "step"), F.sum(_stage("total"))).alias("ms_task")


def summarize_runs(steps: DataFrame) -> DataFrame:
    """One row per run: steps, the outcome of the last, whole and server time, whether any step was blocked."""
    return _running(steps).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("steps"), F.max_by("outcome", "step").alias("outcome"), _task_time(), F.sum(_stage("server")).alias("ms_server"), F.bool_or(F.col("outcome") == "blocked").alias("blocked")
    )


def run_table(steps: DataFrame) -> DataFrame:
    """The dashboard's row per run."""
    return _running(steps).groupBy("run_id").agg(
        F.max_by("origin", "step").alias("origin"), F.count(F.lit(1)).alias("steps"), F.count_if(F.col("reused")).alias("reused"), F.count_if(F.col("image_sent")).alias("images"),
        F.max("placeholders").alias("placeholders"), F.sum("bytes").alias("bytes"), _task_time(), F.max_by("outcome", "step").alias("outcome"),
    )


def detections_by_type(rows: DataFrame, spans: str = "spans", most: int = 8) -> DataFrame:
    """The most frequent types of detections (type, n), by falling number, then by name: a report of at most ``most`` rows."""
    return counts_desc(rows.select(F.explode(spans).alias("s")).select("s.type"), "type").limit(most)


def counts_desc(rows: DataFrame, column: str) -> DataFrame:
    """How many rows have each value, by falling number, then by value."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def step_deltas(steps: DataFrame, columns: tuple[str, ...] = ("bytes", "tokens_est")) -> DataFrame:
    """The steps with the change of each column since the step before of its run (``d_...``, null at the first)."""
    w = Window.partitionBy("run_id").orderBy("step")
    return steps.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(w) for c in columns})


def outcome_histogram(steps: DataFrame) -> DataFrame:
    return steps.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def upsert(steps: DataFrame, arrival: str = "ts") -> DataFrame:
    """Of rows with one (run_id, step) the one that arrived last."""
    last = F.row_number().over(Window.partitionBy("run_id", "step").orderBy(F.desc(arrival)))
    return steps.withColumn("_rank", last).filter("_rank = 1").drop("_rank")


def until_end(steps: DataFrame, most: int = 20) -> DataFrame:
    """The steps of each run up to its first terminal outcome and the step limit."""
    ended = F.min(F.when(F.col("outcome").isin("blocked", "rejected", "declined", "done", "error"), F.col("step"))).over(Window.partitionBy("run_id"))
    return steps.withColumn("_end", ended).filter((F.col("step") <= most) & (F.col("_end").isNull() | (F.col("step") <= F.col("_end")))).drop("_end")


def csv_cell(c: Column, kind: str) -> Column:
    """A CSV cell: whole numbers plain, others with two decimals, quotes where needed."""
    if kind in ("double", "float"):
        text = F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(fixed(c))
    else:
        text = c.cast("string")
    return F.when(text.rlike('[",\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(text, F.lit("")))


def csv_lines(steps: DataFrame) -> DataFrame:
    """The rows with column ``line``: their CSV line in the order of the columns."""
    kinds = dict(steps.dtypes)
    return steps.withColumn("line", F.concat_ws(",", *(csv_cell(F.col(c), kinds[c]) for c in STEP_COLUMNS)))


def dashboard(steps: DataFrame, most: int = 500) -> DataFrame:
    """One row with column ``html``: headline numbers, stage times and a table of runs.

    The table is a report of the first ``most`` runs by id, and says how many
    more there are; ``run_table`` has them all.
    """
    one = lambda c, d=1: F.when(F.lit(d == 0), F.floor(F.col(c) + 0.5).cast("string")).otherwise(fixed(F.col(c), max(d, 1), even=True))
    tasks = summarize_runs(steps).select(F.lit(True).alias("all"), "ms_task")
    task = quantiles(tasks, "all", "ms_task", {"task_p50": ("linear", 0.5), "task_p95": ("linear", 0.95)}).agg(*(F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("task_p50", "task_p95")))
    card = lambda *parts: [F.lit("<b>"), *parts, F.lit("</b>")]
    cards = F.concat(
        F.lit("<section>"), *card(F.col("steps").cast("string"), F.lit(" steps / "), F.col("runs").cast("string"), F.lit(" runs")), *card(one("total_p50", 0), F.lit(" / "), one("total_p95", 0), F.lit(" ms a step")),
        *card(one("task_p50", 0), F.lit(" / "), one("task_p95", 0), F.lit(" ms a task")), *card(one("reused_pct"), F.lit("% reused")), *card(one("image_pct"), F.lit("% images")),
        *card(one("bytes_mean", 0), F.lit(" B / "), one("tokens_mean", 0), F.lit(" tok")), *card(F.col("blocked").cast("string"), F.lit(" blocked")), *card(one("model_load_ms", 0), F.lit(" ms warm-up")), F.lit("</section>"),
    )
    stages = F.concat(F.lit("<table>"), *(x for k in STAGES for x in (F.lit(f"<tr><td>{k}</td><td>"), one(f"{k}_p50"), F.lit("</td><td>"), one(f"{k}_p95"), F.lit("</td></tr>"))), F.lit("</table>"))
    cells = [F.col("run_id"), F.col("origin"), *(F.col(c).cast("string") for c in ("steps", "reused", "images", "placeholders", "bytes")), one("ms_task", 0), F.col("outcome")]
    row = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), escape_html(F.coalesce(c, F.lit(""))), F.lit("</td>")) for c in cells), F.lit("</tr>"))
    listed = run_table(steps).orderBy("run_id").limit(most).agg(F.count(F.lit(1)).alias("listed"), F.transform(F.array_sort(F.collect_list(F.struct("run_id", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    rest = F.col("runs") - F.col("listed")
    more = F.when(rest > 0, F.concat(F.lit("<p>"), rest.cast("string"), F.lit(" more runs</p>"))).otherwise("")
    page = F.when(F.col("steps") == 0, "<p>No metrics yet.</p>").otherwise(F.concat(cards, stages, F.lit("<table>"), F.array_join("rows", ""), F.lit("</table>"), more))
    return summarize_steps(steps).crossJoin(task).crossJoin(listed).select(page.alias("html"))  # three single rows
