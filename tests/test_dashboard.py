"""The dashboard beside its SQL where rounding and the order of sums decide."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmask import catalog
from quillmask.functions.text import fixed


@pytest.mark.parametrize("values", [[2.0], [34.65], [0.7, 0.7], [0.25, 4e15, -4e15, 1.0, 1.0], [33.3, 0.1, 0.2, 1.15]])
def test_equals_sql(spark, tmp_path, values):
    """The first value of a file comes last in time."""
    at = lambda i: datetime.datetime(2024, 1, 2, 12 if i == 0 else 3, i)
    rows = [(i, at(i), 7, "click", v, "{}") for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert catalog.QUERIES["x14_dashboard"](spark, str(tmp_path)).first().html == con.execute(catalog.ORACLE_SQL["x14_dashboard"]).fetchone()[0]


def test_quantiles_equal_duckdb(spark):
    """To the last bit, as a tie may follow."""
    import random

    from quillmask.operators.metrics import quantiles

    draw = random.Random(3)
    rows = [(g, round(draw.random() * 600, 2) / draw.choice([1, 8, 64])) for g in range(300) for _ in range(g % 40 + 1)] + [(400, 34.65)] * 7
    got = quantiles(spark.createDataFrame(rows, "g long, v double"), "g", "v", {"p50": ("linear", 0.5), "p95": ("linear", 0.95)}).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest($1::BIGINT[]) AS g, unnest($2::DOUBLE[]) AS v", [[g for g, _ in rows], [v for _, v in rows]])
    assert sorted(map(tuple, got)) == con.execute("SELECT g, quantile_cont(v, 0.5), quantile_cont(v, 0.95) FROM t GROUP BY g ORDER BY g").fetchall()


def test_fixed_is_exact(spark):
    xs = [k / 100 for k in range(-300, 30000, 5)] + [k / 16 for k in range(1000)] + [0.0, 0.04, -0.04, 9.95, 0.999, 1e15 + 0.25, 4e15 + 0.5, 1e17, 123456789.005]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *(fixed(F.col("x"), d, even=True).alias(f"d{d}") for d in (1, 2, 3)), fixed(F.col("x"), 1).alias("up")).collect()
    assert [(r.d1, r.d2, r.d3) for r in got] == [tuple(f"{r.x:.{d}f}" for d in (1, 2, 3)) for r in got]
    up = {r.x: r.up for r in got}
    assert (up[0.25], up[0.35], up[34.65], up[-0.25]) == ("0.3", "0.3", "34.6", "-0.3")
