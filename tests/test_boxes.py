"""Boxes of images against plain versions; queries over all rows of the smallest tables."""

import math
import random

import duckdb

from pyspark.sql import functions as F

from quillmask import catalog
from quillmask.functions import geometry
from quillmask.operators.images import reading_order
from verify import digest

D = "/root/testdata/sf0.001"


def lines():
    """(order, line, x, y, w, h) of all rows, as the queries' shared SQL makes them."""
    return duckdb.sql(f"SELECT l_orderkey, l_linenumber, l_partkey % 50, l_suppkey % 40, l_quantity::DOUBLE, l_linenumber * 5 FROM '{D}/lineitem.parquet'").fetchall()


def images():
    out = {}
    for k, *rest in lines():
        out.setdefault(k, []).append(rest)
    return out


def pixels(boxes):
    cover = set()
    for _, x, y, w, h in boxes:
        xs = range(max(0, math.floor(x - 4)), min(100, math.ceil(x + w + 4)))
        ys = range(max(0, math.floor(y - 4)), min(100, math.ceil(y + h + 4)))
        cover |= {(a, b) for a in xs for b in ys}
    return len(cover) / 10000


def test_masked_share_of_all_orders_equals_pixels(spark):
    got = {r.k: r.share for r in catalog.QUERIES["a16_masked_share"](spark, D).collect()}
    want = {k: pixels(v) for k, v in images().items()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_masked_share_equals_sql(spark):
    df = catalog.QUERIES["a16_masked_share"](spark, D)
    out = duckdb.sql(catalog.ORACLE_SQL["a16_masked_share"].replace("FROM lineitem", f"FROM '{D}/lineitem.parquet'"))
    assert digest(df.columns, [list(r) for r in df.collect()]) == digest(out.columns, out.fetchall())


def overlap(a, b):
    w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


def greedy(faces):
    """Faces (line, score, box) that stay, best score first, then least line."""
    kept = []
    for f in sorted(faces, key=lambda f: (-f[1], f[0], f[2])):
        if all(overlap(f[2], g[2]) <= 0.3 for g in kept):
            kept.append(f)
    return kept


def rows_of(kept):
    return [(f["line"], f["score"], tuple(f["box"])) for f in kept]


def test_suppression_equals_greedy_choice(spark):
    rng = random.Random(5)
    faces = {k: [(i, float(rng.randrange(3)), tuple(float(rng.randrange(1, 20)) for _ in range(4))) for i in range(rng.randrange(1, 15))] for k in range(80)}
    rows = [(k, *f) for k, v in faces.items() for f in v]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "k int, line int, score double, box struct<x:double,y:double,w:double,h:double>").repartition(4)
    got = d.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("line", "score", "box"))).alias("f")).select("k", geometry.suppress(F.col("f")).alias("kept"))
    assert {r.k: rows_of(r.kept) for r in got.collect()} == {k: greedy(v) for k, v in faces.items()}


def test_kept_boxes_of_all_orders_equal_greedy_choice(spark):
    want = {k: greedy([(b[0], float(b[0] * 10 + k % 3), (b[0] % 3 * 4.0, 0.0, 10.0, 10.0)) for b in v]) for k, v in images().items()}
    got = catalog.QUERIES["j19_suppress_faces"](spark, D).collect()
    assert {r.k: rows_of(r.kept) for r in got} == want
    assert {r.k: r.best for r in got} == {k: sum(f[1] == v[0][1] for f in v) for k, v in want.items()}


def test_reading_order_places_all_boxes(spark):
    want = [(k, b[0], n) for k, v in images().items() for n, b in enumerate(sorted(v, key=lambda b: (b[2], b[1], b[0])), 1)]
    got = [(r.k, r.i, r.place) for r in catalog.QUERIES["l02_reading_order"](spark, D).collect()]
    assert sorted(got) == sorted(want)


def test_ties_of_reading_order_go_by_line(spark):
    d = spark.createDataFrame([(1, i, (5.0, 7.0)) for i in (4, 2, 9, 1)], "image_id int, line int, box struct<x:double,y:double>").repartition(3)
    assert {r.line: r.place for r in reading_order(d, tie="line").collect()} == {1: 1, 2: 2, 4: 3, 9: 4}
