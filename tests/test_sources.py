import json

import pytest
from pyspark.sql import functions as F

from quillmask.operators import change, dictionary, metrics, scoring, screen
from quillmask.operators.actions import redaction_manifest
from quillmask.plans.common import STEPS, run
from quillmask.sources import files, pages
from quillmask.streaming import sessions

D = "/root/testdata/sf0.001"
FORM = """<body><form id="kyc"><label for="m">Mobile</label><input id="m" value="98765 43210"><label>Aadhaar <input name="aadhaar" value="x"></label>
<input type="password" value="secret" placeholder="Pass"><input type="hidden" value="h"><div style="display:none"><p>gone</p></div>
<select aria-label="State"><option>KA</option><option selected>MH</option></select><button>Sub<b>mit</b></button></form>
<p>Phone: <span>98765</span> <span>43210</span></p><img src="a.png" alt="Card of a@b.co"><footer><a href="mailto:x@y.in">x@y.in</a></footer>
<table><tr><th>PAN</th></tr><tr><td>ABCPE1234F</td></tr></table></body>"""


def test_observed_form():
    elements, opaque = pages.observe(FORM)
    by = {e["nodeId"]: e for e in elements}
    assert [e["name"] for e in elements] == ["Mobile", "Aadhaar", "Pass", "State", "Submit", "Phone: 98765 43210", "x@y.in", "PAN", "ABCPE1234F"]
    assert [e["role"] for e in elements][:5] == ["textbox", "textbox", "textbox", "combobox", "button"]
    assert elements[3]["value"] == "MH" and elements[3]["options"] == ["KA", "MH"] and elements[0]["insideSensitiveForm"]
    assert elements[6]["contact"] == "mailto" and elements[6]["boilerplate"] and elements[8]["context"] == "PAN"
    assert [(o["kind"], o["name"]) for o in opaque] == [("img", "Card of a@b.co")] and len(by) == len(elements)
    assert pages.observe(None) == ([], []) and pages.observe("<p>a<p>b")[0][1]["text"] == "b"


def test_sanitized_form(spark):
    seen = pages.observed(spark.createDataFrame([(1, "https://www.y.in/a", FORM)], "page_id long, url string, html string"))
    shown, words, found = screen.sanitize(pages.element_rows(seen))
    rows = {r.id: r for r in shown.collect()}
    assert rows["e1"].value == "<PHONE_1>" and rows["e2"].value == "<AADHAAR_1>" and rows["e3"].value == "<PASSWORD_1>"
    assert rows["e6"].label == "Phone: <PHONE_1>" and rows["e7"].label == "x@y.in" and rows["e9"].label == "<PAN_1>"
    assert rows["e1"].bbox[:2] == [0.008, 0.013] and rows["e2"].accepts == ["AADHAAR"]
    assert {(r.token, r.value) for r in words.collect()} == {("<PHONE_1>", "98765 43210"), ("<AADHAAR_1>", "x"), ("<PASSWORD_1>", "secret"), ("<PAN_1>", "ABCPE1234F")}
    assert found.filter("source = 'dom_rule'").count() == 2
    manifest = redaction_manifest(shown, words, pages.opaque_rows(seen)).first()
    assert manifest.masked_element_count == 5 and manifest.opaque_regions == 1 and json.loads(manifest.json)["legend"]["<PAN_1>"] == "PAN"
    assert [r.id for r in found.orderBy("pos", "part", "at").collect()] == [f"d{i + 1}" for i in range(found.count())]
    whole, words_too, _ = screen.sanitize(pages.screen_rows(seen))
    image = whole.filter("id = 'e10'").first()
    assert image.label.startswith("Card of <EMAIL_1> (img: pixels") and image.role == "image" and image.accepts == [] and whole.count() == 10 and words_too.count() == 5
    sent = screen.wire_screen(whole, seen.select(F.col("page_id").cast("string").alias("scope"), "url")).first()
    assert sent.url_origin == "https://www.y.in" and len(sent.elements) == 10 and "nodeId" not in sent.elements[0] and "98765" not in "".join(sent.elements)
    imported = dictionary.import_dictionary(words.select("scope", "token", "type", "value"))
    assert {r.n for r in imported.collect()} == {1} and dictionary.entries(words).count() == 1


def test_csv_round_trip(spark, tmp_path):
    steps = run(spark, D, STEPS).limit(50)
    files.write_steps(steps, f"{tmp_path}/csv")
    back = files.read_steps(spark, f"{tmp_path}/csv")
    a = {(r.run_id, r.step): r for r in steps.collect()}
    for r in back.collect():
        mine = a[r.run_id, r.step]
        assert r.outcome == mine.outcome and r.reused == mine.reused and abs(r.ms_total - mine.ms_total) < 0.006
    spark.createDataFrame([("r", 1)], "run_id string, step int").write.csv(f"{tmp_path}/short", header=True)
    short = files.read_steps(spark, f"{tmp_path}/short").first()
    assert short.ms_validate == 0 and short.bytes is None


def test_store_logs_and_lists(spark, tmp_path):
    steps = run(spark, D, STEPS).limit(20)
    files.write_store(steps, f"{tmp_path}/store")
    files.write_store(steps.withColumn("ts", F.col("ts") + 1).withColumn("outcome", F.lit("late")), f"{tmp_path}/store")
    stored = files.read_store(spark, f"{tmp_path}/store")
    assert stored.count() == 20 and {r.outcome for r in stored.collect()} == {"late"}
    files.append_rows(spark.range(6).withColumnRenamed("id", "index"), f"{tmp_path}/rows")
    assert files.read_rows(spark, f"{tmp_path}/rows", "index long", 2, 3).count() == 3
    (tmp_path / "urls.txt").write_text("# a\nnews https://a.example.com\nhttps://b.example.com\nhttp://c\n\n")
    assert [tuple(r) for r in files.read_urls(spark, f"{tmp_path}/urls.txt").collect()] == [("news", "https://a.example.com"), (None, "https://b.example.com")]
    (tmp_path / "a.json").write_text(json.dumps({"site": "s", "capture": "c", "positives": [{"element": 1, "field": "f", "type": "PAN", "value": "v", "note": ""}], "benign_lookalikes": []}, indent=1))
    assert files.read_annotations(spark, f"{tmp_path}/a.json").first().positives[0].type == "PAN"
    digest = __import__("hashlib").sha256((tmp_path / "urls.txt").read_bytes()).hexdigest()
    good = files.verified_files(spark, f"{tmp_path}/urls.txt", spark.createDataFrame([("urls.txt", digest)], "name string, sha256 string")).first()
    assert good.ok


def test_session_stream(spark, tmp_path):
    rows = [("s1", 1, "PAN", "a", "A"), ("s1", 2, "PAN", "b", "B"), ("s1", 3, "PAN", "a", "a"), ("s2", 1, "PAN", "b", "B"), ("s1", 4, "DONE", "", ""), ("s1", 5, "PAN", "b", "B")]
    schema = "session_id string, pos long, type string, norm string, value string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = sessions.number_tokens(stream).writeStream.format("memory").queryName("numbered").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.session_id, r.pos): r.token for r in spark.table("numbered").collect()}
    assert got == {("s1", 1): "<PAN_1>", ("s1", 2): "<PAN_2>", ("s1", 3): "<PAN_1>", ("s2", 1): "<PAN_1>", ("s1", 5): "<PAN_1>"}


def test_payload_stream_and_counters(spark, tmp_path):
    spark.createDataFrame([(1, "call 98765 43210 <PAN_2> <PAN_1>")], "id long, payload string").write.parquet(f"{tmp_path}/in")
    q = sessions.inspect_payloads(spark.readStream.schema("id long, payload string").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    seen = spark.read.json(f"{tmp_path}/out").first()
    assert seen.raw_types == ["PHONE"] and seen.tokens == ["<PAN_1>", "<PAN_2>"]
    v = spark.createDataFrame([("s", 1, False), ("s", 2, True)], "session_id string, step int, pass boolean")
    assert tuple(sessions.gate_counters(v).first()) == ("s", 1, True)


@pytest.fixture(autouse=True)
def _no_empty_batches(spark):
    """Streams with timeouts run empty batches for ever, so that one that takes all there is would not end."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def _in_batches(spark, tmp_path, batches, schema, make):
    """The rows that a stream gives when each batch is a file of its own."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = make(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert not q.exception(), i
    return spark.read.parquet(f"{tmp_path}/out").collect()


def test_screen_and_gate_state_lives_across_batches(spark, tmp_path):
    batches = [[("a", 2, "y"), ("a", 1, "x"), ("b", 1, "y")], [("a", 3, "y"), ("b", 2, None)], [("b", 3, None), ("a", 4, "x")]]
    got = {(r.session_id, r.step): r.reused for r in _in_batches(spark, tmp_path / "k", batches, "session_id string, step long, key string", sessions.mark_reused_stream)}
    assert got == {("a", 1): False, ("a", 2): False, ("a", 3): True, ("a", 4): False, ("b", 1): False, ("b", 2): False, ("b", 3): False}
    batches = [[("a", 1, False), ("a", 2, True)], [("a", 3, False), ("b", 1, None)]]
    got = {(r.session_id, r.step): r.blocked for r in _in_batches(spark, tmp_path / "g", batches, "session_id string, step long, pass boolean", sessions.gate_stream)}
    assert got == {("a", 1): 1, ("a", 2): 1, ("a", 3): 2, ("b", 1): 1}


def test_histories_and_caches_live_across_batches(spark, tmp_path):
    schema = "session_id string, step long, op string, element_id string, text string"
    steps = [("a", i, "click", f"e{i}", None) for i in range(7)]
    rows = _in_batches(spark, tmp_path / "h", [steps[:3], steps[3:]], schema, lambda s: sessions.histories(s, most=2))
    got = {r.step: [json.loads(x)["element_id"] for x in r.history] for r in rows}
    assert got == {i: [f"e{j}" for j in range(max(0, i - 2), i)] for i in range(7)}
    keys = [("a", i, k) for i, k in enumerate("xyxzxyz")]
    rows = _in_batches(spark, tmp_path / "c", [keys[:4], keys[4:]], "session_id string, pos long, key string", lambda s: sessions.cached(s, capacity=2))
    assert {r.pos: r.hit for r in rows} == {0: False, 1: False, 2: True, 3: False, 4: True, 5: False, 6: False}


def test_tokens_are_numbered_across_batches(spark, tmp_path):
    batches = [[("s", 1, "PAN", "a", "A"), ("s", 2, "PAN", "b", "B"), ("s", 3, "IP", "1", "1")], [("s", 4, "PAN", "c", "C"), ("s", 5, "PAN", "a", "A"), ("s", 6, "DONE", None, None), ("s", 7, "PAN", "c", "C")]]
    rows = _in_batches(spark, tmp_path, batches, "session_id string, pos long, type string, norm string, value string", sessions.number_tokens)
    assert {r.pos: r.token for r in rows} == {1: "<PAN_1>", 2: "<PAN_2>", 3: "<IP_1>", 4: "<PAN_3>", 5: "<PAN_1>", 7: "<PAN_1>"}


def test_metrics_stream_is_a_store(spark, tmp_path):
    steps = run(spark, D, STEPS)
    steps.write.parquet(f"{tmp_path}/in")
    q = sessions.append_metrics(spark.readStream.schema(steps.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    one = steps.first().run_id
    assert files.read_store(spark, f"{tmp_path}/store").count() == steps.count() and files.read_store(spark, f"{tmp_path}/store", one).count() == steps.filter(F.col("run_id") == one).count()


def test_quantiles_by_place(spark):
    rows = [("a", float(v)) for v in (5, 1, 1, 1, 9, 3)] + [(None, 2.0), ("b", None)]
    wanted = {"m": ("linear", 0.5), "low": ("floor", 0.5), "high": ("ceil", 0.5), "top": ("linear", 1.0)}
    got = {r.g: tuple(r)[1:] for r in metrics.quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", wanted).collect()}
    assert got == {"a": (2.0, 3.0, 1.0, 9.0), None: (2.0, 2.0, 2.0, 2.0), "b": (None, None, None, None)}


def test_wide_scopes_are_numbered_alike(spark):
    rows = [(None if i % 7 == 0 else "s", "PAN" if i % 3 else "IP", f"V-{i * 37 % 90}", i // 2) for i in range(400)]
    found = spark.createDataFrame(rows, "scope string, type string, value string, pos int").repartition(5)
    plain, wide = (sorted(map(str, dictionary.number_values(found, wide=w).collect())) for w in (False, True))
    assert plain == wide and len(wide) > 90
    assert dictionary.number_values(found.limit(0), wide=True).count() == 0


def test_values_within_values(spark):
    inner, outer = ["", "a", "ab", "abcdef", "xyz", "ba"], ["", "ab", "abab", "zabcdefz", "q"]
    i, o = (spark.createDataFrame([("s", v) for v in vs] + [("t", vs[1])], f"site string, {n} string") for vs, n in ((inner, "inner"), (outer, "outer")))
    for least in (0, 2, 6):
        got = sorted(tuple(r) for r in scoring.within_values(i, o, "site", least).collect())
        want = [("s", x, y) for x in inner for y in outer if len(x) >= least and x in y] + [("t", x, y) for x, y in [(inner[1], outer[1])] if len(x) >= least and x in y]
        assert got == sorted(want)


def test_times_from_marks(spark):
    marks = spark.createDataFrame([("r", 1, [10.0, 11.5, 14.0]), ("r", 2, [1.0]), ("r", 3, None)], "run_id string, step int, marks array<double>")
    got = {r.step: (r.ms_observe, r.ms_sanitize, r.ms_vision, r.ms_total) for r in change.step_times(marks).collect()}
    assert got == {1: (1.5, 2.5, 0.0, 4.0), 2: (0.0, 0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0, 0.0)}


def test_empty_metrics(spark):
    empty = spark.createDataFrame([], metrics.STEP_SCHEMA)
    assert metrics.summarize_steps(empty).first().total_p95 == 0
    assert metrics.dashboard(empty).first().html.startswith("<p>")
