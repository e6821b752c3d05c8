"""Canaries of a table in payloads of another, beside the gate's own scan of one payload."""

from pyspark.sql import functions as F

from quillmask.operators import gate

CANARIES = ["Quick-Brown fox, jumps over", "CANARY-7", "ab", "-.-", "a.b", "\u03a3\u0391\u03a3", "no such thing in any of them", "caf\u00e9 cr\u00e8me"]
PAYLOADS = [
    (1, "the Quick-Brown fox, jumps over it"),
    (2, "the quick brown FOX jumps\n over it"),
    (3, "thequick_brown(fox)jumpsoverx"),
    (4, "xxQuick-Brown fox, jumps overxx CANARY-7x"),
    (5, "a canary 7 and A B"),
    (6, "x\u03a3\u0391\u03a3\u0391 CAF\u00c9CR\u00c8ME"),
    (7, ""),
    (None, "Canary_7"),
    (8, None),
]


def test_hits_equal_scan(spark):
    d = spark.createDataFrame(PAYLOADS, "id long, payload string")
    c = spark.createDataFrame([(x,) for x in [*CANARIES, CANARIES[0], None]], "canary string")
    got = [(r.id, r.canary) for r in gate.canary_hits(d, c).collect()]
    each = d.filter("payload IS NOT NULL").crossJoin(c.filter("canary IS NOT NULL").distinct())
    want = [(r.id, r.canary) for r in each.filter(F.exists(gate.scan(F.col("payload"), F.lit(None), F.array("canary"), "payload"), lambda h: h["kind"] == "canary")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {(2, CANARIES[0]), (3, CANARIES[0]), (4, CANARIES[0]), (5, "CANARY-7"), (5, "ab"), (7, "-.-"), (None, "CANARY-7")} <= set(got)


def test_hits_as_they_stand(spark, tmp_path):
    """The query equals its SQL where passages stand in other case or spacing, texts are repeated or share an id."""
    import duckdb

    from quillmask import catalog

    docs = [(k, p) for k, p in PAYLOADS if k is not None] + [(1, "CANARY-7 and the Quick-Brown fox, jumps over"), (9, "CANARY-7"), (9, "CANARY-7"), (9, "canary-7")]
    items = [*enumerate(CANARIES), (90, CANARIES[1]), (91, ""), (92, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = [tuple(r) for r in catalog.QUERIES["j05_canaries"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(catalog.ORACLE_SQL["j05_canaries"]).fetchall())
    assert got.count((9, 1)) == 2 and (2, 0) not in got
