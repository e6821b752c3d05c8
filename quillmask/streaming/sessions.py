"""Streams of session steps: token dictionaries in state, gate counters, windowed metrics, sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmask.sources.files import store_bucket

NUMBERED = "session_id string, pos long, type string, norm string, value string, token string"
IDLE = "30 minutes"


def per_session(rows: DataFrame, order: str, columns: str, state: str, advance: Callable[[pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]], idle: str = IDLE) -> DataFrame:
    """A stream by session (column session_id, a string) with a state for each.

    ``advance`` takes the session's new rows, sorted by ``order``, and its state
    (null at first), and returns rows of ``columns`` and the next state. A
    session without rows for ``idle`` (minutes) is forgotten. The rows of a
    session within one batch are taken together, so that order holds in it.
    """
    wait = int(idle.split()[0]) * 60_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        new = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        out, after = advance(new, held.get if held.exists else None)
        held.update(after)
        held.setTimeoutDuration(wait)
        yield out

    return rows.groupBy("session_id").applyInPandasWithState(run, columns, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def number_tokens(values: DataFrame, idle: str = IDLE) -> DataFrame:
    """Values (session_id, pos, type, norm, value) of a stream with their tokens.

    A session's dictionary is its state: a value keeps its token for as long
    as the session lives; an idle session is forgotten. A row of type
    ``DONE`` clears the dictionary.
    """

    def advance(new: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        known = {} if state is None else dict(zip(*state, strict=True))
        parts = []
        for _, part in new.groupby((new["type"] == "DONE").cumsum(), sort=True):  # what lies between two clearings
            if part["type"].iloc[0] == "DONE":
                known, part = {}, part.iloc[1:]  # noqa: PLW2901
            keys = part["type"] + ":" + part["norm"]
            fresh = part.assign(key=keys)[~keys.isin(list(known))].drop_duplicates("key")
            used = pd.Series([k.partition(":")[0] for k in known], dtype=object).value_counts()
            number = fresh.groupby("type").cumcount() + 1 + fresh["type"].map(used).fillna(0).astype("int64")
            known.update(zip(fresh["key"], "<" + fresh["type"] + "_" + number.astype(str) + ">", strict=True))
            parts.append(part.assign(token=keys.map(known)))
        out = pd.concat(parts)[["session_id", "pos", "type", "norm", "value", "token"]]
        return out, (list(known), list(known.values()))

    rows = values.select(F.col("session_id").cast("string"), F.col("pos").cast("long"), "type", F.coalesce("norm", F.lit("")).alias("norm"), "value")
    return per_session(rows.filter("type is not null"), "pos", NUMBERED, "keys array<string>, tokens array<string>", advance, idle)


def mark_reused_stream(screens: DataFrame, idle: str = IDLE) -> DataFrame:
    """Screens (session_id, step, key) of a stream with ``reused``: the key is that of the session's screen before, which is its state."""

    def advance(new: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        before = new["key"].shift(fill_value=None)
        if state is not None:
            before.iloc[0] = state[0]
        return new.assign(reused=(before == new["key"]) & new["key"].notna()), (new["key"].iloc[-1],)

    rows = screens.select(F.col("session_id").cast("string"), F.col("step").cast("long"), F.col("key").cast("string"))
    return per_session(rows, "step", "session_id string, step long, key string, reused boolean", "key string", advance, idle)


def histories(actions: DataFrame, most: int = 10, idle: str = IDLE) -> DataFrame:
    """Actions (session_id, step, op, element_id, text) of a stream, each with the session's last ``most`` before it, as an array of JSON; these are its state."""

    def advance(new: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        lines = ([] if state is None else list(state[0])) + list(new["json"])
        first = len(lines) - len(new)
        past = [lines[max(0, first + i - most) : first + i] for i in range(len(new))]
        return new.drop(columns="json").assign(history=past), (lines[-most:],)

    parts = [F.col(c).cast("string").alias(c) for c in ("op", "element_id", "text")]
    rows = actions.select(F.col("session_id").cast("string"), F.col("step").cast("long"), *parts).withColumn("json", F.to_json(F.struct("op", "element_id", "text")))
    return per_session(rows, "step", "session_id string, step long, op string, element_id string, text string, history array<string>", "lines array<string>", advance, idle)


def cached(requests: DataFrame, capacity: int = 256, idle: str = IDLE) -> DataFrame:
    """Requests (session_id, pos, key) of a stream with ``hit``: a cache of the ``capacity`` keys used last, a state for each session."""

    def advance(new: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        kept, hits = dict.fromkeys([] if state is None else state[0]), []
        for key in new["key"]:  # what is evicted depends on all before
            hits.append(key in kept)
            kept.pop(key, None)
            kept[key] = None
            if len(kept) > capacity:
                del kept[next(iter(kept))]
        return new.assign(hit=hits), (list(kept),)

    rows = requests.select(F.col("session_id").cast("string"), F.col("pos").cast("long"), F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"))
    return per_session(rows, "pos", "session_id string, pos long, key string, hit boolean", "keys array<string>", advance, idle)


def gate_counters(verdicts: DataFrame, session: str = "session_id") -> DataFrame:
    """For each session the blocked steps so far and the last verdict (columns step, pass): a batch, or the whole life of a stream."""
    return verdicts.groupBy(session).agg(F.sum((~F.col("pass")).cast("long")).alias("blocked"), F.max_by("pass", "step").alias("last_pass"))


def gate_stream(verdicts: DataFrame, idle: str = IDLE) -> DataFrame:
    """Verdicts (session_id, step, pass) of a stream, each with the session's blocked steps so far; an idle session starts anew."""

    def advance(new: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        blocked = (~new["pass"].astype(bool)).cumsum() + (0 if state is None else state[0])
        return new.assign(blocked=blocked), (int(blocked.iloc[-1]),)

    rows = verdicts.select(F.col("session_id").cast("string"), F.col("step").cast("long"), F.coalesce("pass", F.lit(False)).alias("pass"))
    return per_session(rows, "step", "session_id string, step long, pass boolean, blocked long", "blocked long", advance, idle)


def windowed_steps(events: DataFrame, time: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", group: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and means by window of event time: an extension over the events table, tumbling, or sliding with ``slide``."""
    window = F.window(time, width) if slide is None else F.window(time, width, slide)
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(window.alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n", "mean")


def quiet_sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions that end after a quiet gap: a debounce, an extension over the events table; of a stream, rows later than ``late`` are left out."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_metrics(steps: DataFrame, path: str, checkpoint: str):  # noqa: ANN201  the query handle
    """Appends a stream of step metrics to the keyed store, in the folders of ``write_store``."""
    bucketed = steps.withColumn("bucket", store_bucket(F.col("run_id")))
    return bucketed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("bucket").outputMode("append").start()


def inspect_payloads(payloads: DataFrame, path: str, checkpoint: str):  # noqa: ANN201  the query handle
    """For each batch of a stream of payloads, their raw types and distinct sorted tokens, as JSON lines."""
    from quillmask.functions.text import tokens_in
    from quillmask.operators.actions import raw_types

    def write(batch: DataFrame, _: int) -> None:
        batch.select("id", raw_types(F.col("payload")).alias("raw_types"), F.array_sort(tokens_in(F.col("payload"))).alias("tokens")).write.mode("append").json(path)

    return payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
