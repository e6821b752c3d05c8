"""Queries of gates on spans, wire forms, decoders, rankings, caches and replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.functions import geometry, ner, patterns, pixels, spans, text
from quillmask.operators import actions, change, images, metrics, scoring, screen
from quillmask.plans.common import oracle, run, spread, table
from quillmask.sources.pages import observed, opaque_rows, screen_rows

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201  a decorator
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return add


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_mktsegment")


@query("SELECT c_custkey AS k, c_name AS value, 3 AS start, 3 + length(c_name) AS stop FROM customer UNION ALL SELECT c_custkey, upper(c_name), 3 + length(c_name) + 5, 3 + 2 * length(c_name) + 5 FROM customer")
def p04_known_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapped value is found wherever it stands alone, in any case."""
    d = _customers(spark, sf_dir)
    t = F.concat(F.lit("is "), "c_name", F.lit(" and "), F.upper("c_name"), F.lit(", x"), "c_name")
    e = F.array(F.struct(F.lit("NAME").alias("type"), F.col("c_name").alias("value")))
    return d.select("k", F.explode(spans.known_values(t, e)).alias("s")).select("k", "s.value", "s.start", F.col("s.end").alias("stop"))


@query("""SELECT c_custkey AS k, NOT (c_custkey % 3 = 0 AND (c_custkey % 2 = 0 OR c_custkey % 5 = 0)) AS mail, NOT (c_custkey % 3 = 1 AND c_custkey % 2 = 0) AS tel, c_custkey % 7 = 0 OR c_custkey % 2 <> 0 AS model,
                 c_custkey % 4 <> 1 AS letters FROM customer""")
def p05_p07_span_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which spans stay: site contacts in boilerplate or of the page's domain go, as do model spans in boilerplate that are no values."""
    k = F.col("k")
    contact = F.when(k % 3 == 0, "mailto").when(k % 3 == 1, "tel")
    boiler = k % 2 == 0
    one = lambda t, v, s: patterns.span(F.lit(t), F.lit(0), F.lit(5), v, F.lit(s), F.lit(0.9))
    mail = one("EMAIL", F.when(k % 5 == 0, "a@in.site.com").otherwise("a@other.com"), "pattern")
    short = F.when(k % 4 == 0, one("NAME", F.lit("Ravi"), "ner")).when(k % 4 == 1, one("NAME", F.lit("- a."), "ner")).when(k % 4 == 2, one("NAME", F.lit("- a."), "pattern")).otherwise(one("NAME", F.lit("A. B9"), "ner"))
    return _customers(spark, sf_dir).select(
        "k", spans.not_site_contact(mail, contact, boiler, F.lit("site.com")).alias("mail"), spans.not_site_contact(one("PHONE", F.lit("9"), "pattern"), contact, boiler, F.lit("site.com")).alias("tel"),
        spans.not_boilerplate(one("NAME", F.lit("Ravi"), "ner"), k % 7 == 0, boiler).alias("model"),
        spans.enough_letters(short).alias("letters"),
    )


@query("SELECT event_id, event_type IN ('click', 'view') AS known, event_type = 'click' AND event_id % 3 = 0 AS confirm FROM events")
def p11_p12_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "view", "scroll").otherwise(F.col("event_type"))
    label = F.when(F.col("event_id") % 3 == 0, "Place order").otherwise("Read more")
    return e.select("event_id", actions.valid_schema(op).alias("known"), actions.consequential(op, label).alias("confirm"))


@query("""SELECT c_custkey AS k, '~"op":"click","element_id":"e' || c_custkey || '"' || CASE WHEN c_custkey % 2 = 0 THEN ',"text":"t"' ELSE '' END || '~' AS payload,
          CASE WHEN c_custkey % 3 = 0 THEN ['<A_1>'] WHEN c_custkey % 3 = 1 THEN ['<B_1>'] ELSE [] END AS unused FROM customer""")
def f40_payload_u04_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serialised actions leave null fields out; tokens of a legend that a screen does not show."""
    k = F.col("k")
    j = actions.payload_json(F.struct(F.lit("click").alias("op"), F.concat(F.lit("e"), k.cast("string")).alias("element_id"), F.when(k % 2 == 0, "t").alias("text")))
    shown = F.when(k % 3 == 0, "to <B_1> and <B_1>").when(k % 3 == 1, "<A_1>!").otherwise("<B_1><A_1>")
    legend = F.create_map(F.lit("<A_1>"), F.lit("A"), F.lit("<B_1>"), F.lit("B"))
    return _customers(spark, sf_dir).select("k", F.regexp_replace(F.regexp_replace(j, "^\\{", "~"), "\\}$", "~").alias("payload"), actions.unused_tokens(legend, shown).alias("unused"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN [c_name, c_mktsegment] ELSE [c_name] END AS texts FROM customer")
def f43_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.array(F.struct(F.col("c_name").alias("name"), F.lit("").alias("text"), F.when(F.col("k") % 2 == 0, F.col("c_mktsegment")).alias("value")))
    return _customers(spark, sf_dir).select("k", ner.text_list(e).alias("texts"))


@query("""WITH s AS (SELECT e.vec_id, l.vec_id AS label, list_cosine_similarity(e.embedding::DOUBLE[], l.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id < 5) l)
          SELECT vec_id, max_by(label, score) AS label, round(max(score), 6) AS score, round(max(score) - list_sort(list(score))[4], 6) AS margin FROM s GROUP BY vec_id""")
def l03_label_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of five fixed label vectors for every vector, and its lead over the second: labels travel as one array."""
    e = table(spark, sf_dir, "embeddings")
    labels = e.filter("vec_id < 5").agg(F.array_sort(F.collect_list(F.struct(F.col("vec_id").alias("label"), "embedding"))).alias("labels"))  # five rows
    scored = e.join(F.broadcast(labels)).select("vec_id", F.array_sort(F.transform("labels", lambda x: F.struct((-text.cosine(F.col("embedding"), x["embedding"])).alias("s"), x["label"].alias("label")))).alias("r"))
    return scored.select("vec_id", F.col("r")[0]["label"].alias("label"), F.round(-F.col("r")[0]["s"], 6).alias("score"), F.round(F.col("r")[1]["s"] - F.col("r")[0]["s"], 6).alias("margin"))


@query("SELECT c_custkey AS k, CASE c_custkey % 2 WHEN 0 THEN 'aab' ELSE 'b' END AS text, CASE c_custkey % 2 WHEN 0 THEN 0.8 ELSE 0.5 END AS confidence FROM customer")
def f22_ctc(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = lambda *v: F.array(*map(F.lit, v))
    a = F.array(frame(0.1, 0.8, 0.1), frame(0.2, 0.7, 0.1), frame(0.9, 0.1, 0.0), frame(0.1, 0.8, 0.1), frame(0.1, 0.1, 0.8))
    b = F.array(frame(0.9, 0.1, 0.0), frame(0.1, 0.4, 0.5), frame(0.1, 0.4, 0.5))
    out = ner.decode_ctc(F.when(F.col("k") % 2 == 0, a).otherwise(b), F.array(F.lit(""), F.lit("a"), F.lit("b")))
    return _customers(spark, sf_dir).select("k", out.alias("o")).select("k", "o.text", F.round("o.confidence", 6).alias("confidence"))


CELLS = "SELECT l_orderkey AS k, l_linenumber AS i, l_partkey % 80 AS cell, l_discount * 8 AS cls, 1 - l_tax AS obj, l_quantity / 100 AS d FROM {lineitem}"


@query(f"""SELECT k, i, round(sqrt(least(1, greatest(0, cls)) * least(1, greatest(0, obj))), 9) AS score, round(((cell % 20 + d) * 8 - exp(d) * 8 / 2) / 2, 9) AS x, round(exp(d) * 8 / 2, 9) AS w FROM ({CELLS})""")
def f23_face_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = run(spark, sf_dir, CELLS)
    b = geometry.face_box(F.col("cell"), F.lit(20), F.lit(8), F.col("d"), F.col("d"), F.col("d"), F.col("d"), F.lit(2))
    return d.select("k", "i", F.round(geometry.face_score(F.col("cls"), F.col("obj")), 9).alias("score"), F.round(b["x"], 9).alias("x"), F.round(b["w"], 9).alias("w"))


@query(f"""SELECT k, i, round(greatest(0, (cell - dd) * 2), 9) AS x, round(least(200 - greatest(0, (cell - dd) * 2), (10 + 2 * dd) * 2), 9) AS w FROM (SELECT *, 10 * 4.0 / (2 * 14) * 1.5 AS dd FROM ({CELLS}))""")
def f21_unclip(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = geometry.unclipped(geometry.box(F.col("cell"), F.lit(5), F.lit(10), F.lit(4)), F.lit(2.0), F.lit(2.0), F.lit(200.0), F.lit(100.0))
    return run(spark, sf_dir, CELLS).select("k", "i", F.round(b["x"], 9).alias("x"), F.round(b["w"], 9).alias("w"))


@query()
def j19_suppress_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of each image that stay, by score, then line, and how many of them have the best score: a greedy choice, which tests hold against a plain one."""
    f = table(spark, sf_dir, "lineitem")
    face = F.struct(F.col("l_linenumber").alias("line"), (F.col("l_linenumber") * 10 + F.col("l_orderkey") % 3).cast("double").alias("score"), geometry.box((F.col("l_linenumber") % 3) * 4.0, F.lit(0), F.lit(10), F.lit(10)).alias("box"))
    kept = f.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(face)).alias("f")).select("k", geometry.suppress(F.col("f")).alias("kept"))
    return kept.select("k", F.size(F.filter("kept", lambda x: x["score"] == F.array_max(F.transform("kept", lambda y: y["score"])))).cast("bigint").alias("best"), "kept")


@query("SELECT c_custkey AS k, CASE c_custkey % 2 WHEN 0 THEN c_mktsegment || ' x' END AS value FROM customer WHERE c_custkey % 2 = 0")
def f27_field_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names lose field words at their edges; names of field words alone go."""
    t = F.when(F.col("k") % 2 == 0, F.concat(F.lit("UPI id "), "c_mktsegment", F.lit(" x no."))).otherwise("PAN number")
    s = patterns.span(F.lit("NAME"), F.lit(0), F.length(t), t, F.lit("ner"), F.lit(0.9))
    return _customers(spark, sf_dir).select("k", F.explode(ner.drop_field_words(F.array(s))).alias("s")).select("k", "s.value")


@query("SELECT conv_id, turn, len(regexp_extract_all(text, '@')) > 0 AS has_at FROM conversations")
def j20_once_per_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector that runs once for each distinct text, joined back."""
    def detector(c):  # noqa: ANN001, ANN202
        return F.regexp_extract_all(c, F.lit("@"), F.lit(0))

    d = change.once_per_text(table(spark, sf_dir, "conversations"), "text", detector)
    return d.select("conv_id", "turn", (F.size("spans") > 0).alias("has_at"))


@query("""SELECT type, count(*) AS n FROM (SELECT unnest(CASE c_custkey % 3 WHEN 0 THEN ['EMAIL', 'IP'] WHEN 1 THEN ['IP'] ELSE [] END) AS type FROM customer) GROUP BY type ORDER BY n DESC, type LIMIT 8""")
def a11_top_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections by type, the most frequent first; the limit of eight is the feature."""
    k = F.col("k")
    t = F.when(k % 3 == 0, F.concat(F.lit("a"), k.cast("string"), F.lit("@example.com from 10.1.2.3"))).when(k % 3 == 1, "10.1.2.3 again").otherwise("nothing here, version 1.2")
    return metrics.detections_by_type(_customers(spark, sf_dir).select("k", patterns.detect_patterns(t).alias("spans")), "spans")


LINKED = """SELECT page_id, replace(replace(unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)), '&amp;', '&'), '&quot;', '"') AS name FROM pages"""


@query(f"""SELECT page_id, count(*) AS truth, count_if(name NOT LIKE '%e%') AS found, count_if(name NOT LIKE '%e%' AND name NOT LIKE '%o%' AND trim(name) <> '') AS label_ok FROM ({LINKED}) GROUP BY page_id""")
def a14_screen_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages on a screen that lacks those with an e and shows another label for those with an o."""
    seen = observed(spread(table(spark, sf_dir, "pages")))
    links = seen.select("page_id", F.explode("elements").alias("e")).filter("e.role = 'link'").select("page_id", "e.nodeId", F.col("e.name").alias("label"))
    shown = links.filter(~F.col("label").contains("e")).withColumn("label", F.when(F.col("label").contains("o"), "...").otherwise(F.concat(F.lit(" To  "), "label")))
    return scoring.screen_recall(links, shown)


@query()
def x05_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redaction manifests of the screens of all pages."""
    seen = observed(spread(table(spark, sf_dir, "pages")))
    shown, words, _ = screen.sanitize(screen_rows(seen))
    return actions.redaction_manifest(shown, words, opaque_rows(seen)).select("scope", "masked_element_count", "opaque_regions", "json")


@query("SELECT page_id, 10 AS steps, 9 - page_id % 4 AS skipped FROM pages")
def x12_replay_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten observations of every page, edited up to three times between them: the unchanged ones are skipped."""
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("step"))
    edits = F.least(F.floor(F.col("step") / 3), F.col("page_id") % 4)
    p = p.withColumn("key", change.observation_key(F.concat(F.lit("u"), F.col("page_id").cast("string")), F.lit(9), F.lit(9), F.array().cast("array<struct<nodeId:string,role:string,name:string,text:string,value:string,checked:string,disabled:string,context:string,x:double,y:double,w:double,h:double>>"), F.array(F.concat(F.lit("opaque "), edits.cast("string")))))
    return change.mark_reused(p, "page_id").groupBy("page_id").agg(F.count("*").alias("steps"), F.count_if(F.col("reused")).alias("skipped"))


@query("SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'V' || c_custkey WHEN 1 THEN 'm' || c_custkey END AS typed FROM customer")
def x13_replay_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step of a replay: plan, restore the token, and what is then typed."""
    k = F.col("k")
    element = lambda i, label, value: F.struct(F.lit(i).alias("id"), F.lit("textbox").alias("role"), F.lit(label).alias("label"), F.lit("text").alias("field_type"), value.alias("value"), F.create_map().cast("map<string,boolean>").alias("state"))
    screen_map = F.array(element("e1", "PAN", F.when(k % 3 == 0, "").otherwise("x")), element("e2", "E-mail", F.when(k % 3 == 2, "x").otherwise("")))
    d = _customers(spark, sf_dir).select("k", F.lit("<PAN_1> <EMAIL_1>").alias("task"), screen_map.alias("screen_map"), F.create_map(F.lit("<PAN_1>"), F.lit("PAN"), F.lit("<EMAIL_1>"), F.lit("EMAIL")).alias("legend"), F.array().cast("array<struct<op:string,element_id:string,text:string>>").alias("history"))
    values = F.create_map(F.lit("<PAN_1>"), F.concat(F.lit("V"), k.cast("string")), F.lit("<EMAIL_1>"), F.concat(F.lit("m"), k.cast("string")))
    return actions.plan_next(d).select("k", F.when(F.col("action.op") == "type", spans.rehydrate(F.col("action.text"), values)).alias("typed"))


@query("SELECT vec_id, vec_id % 7 = (3 * vec_id) % 7 AS same FROM embeddings")
def f13_pixel_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of two small images, which are equal if their pixels are."""
    v = F.col("vec_id")
    image = lambda c: F.unhex(F.repeat(F.lpad(F.hex(c.cast("long")), 2, "0"), 256))
    d = table(spark, sf_dir, "embeddings").select("vec_id", image(v % 7).alias("a"), image((3 * v) % 7).alias("b"), F.lit(8).alias("w"), F.lit(8).alias("h"))
    key = pixels.column("key")
    return d.select("vec_id", (key("a", "w", "h") == key("b", "w", "h")).alias("same"))


@query("SELECT c_custkey AS k, (c_custkey % 2 = 0)::INT + (c_custkey % 3 = 0)::INT + (c_custkey % 5 = 0)::INT AS masks FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0")
def x09_image_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of the lines of an image: a value by its pattern, one by its label, and an uncertain line."""
    line = lambda t, c: F.struct(F.lit(t).alias("text"), F.lit(c).alias("confidence"))
    k = F.col("k")
    lines = F.array(F.when(k % 2 == 0, line("PAN ABCPE1234F", 0.9)), F.when(k % 3 == 0, line("Name: A Kumar", 0.9)), F.when(k % 5 == 0, line("b1urr", 0.2)), line("Colour: red", 0.9))
    d = _customers(spark, sf_dir).select("k", F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("l")).select("k", "l.*", geometry.box(F.lit(0), F.lit(0), F.lit(90), F.lit(9)).alias("box"))
    return images.mask_lines(d).groupBy("k").agg(F.count("*").alias("masks"))


@query("""SELECT page_id, replace(replace(unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)), '&amp;', '&'), '&quot;', '"') AS name FROM pages""")
def s07_link_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accessible names of the links of every page."""
    seen = observed(spread(table(spark, sf_dir, "pages")))
    return seen.select("page_id", F.explode("elements").alias("e")).filter("e.role = 'link'").select("page_id", "e.name")


TABLES = """SELECT c_custkey AS page_id, 'u' AS url, '<table><tr><th>Name</th><th>PAN</th></tr><tr><td>' || c_name || '</td><td>x</td></tr></table><select><option>' || c_mktsegment || '</option><option> </option></select>' AS html FROM {customer}"""


@query("SELECT c_custkey AS page_id, c_name AS text, 'Name' AS context, [c_mktsegment] AS options FROM customer")
def s09_headers_s11_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell with its column's header, and the options of a list."""
    seen = observed(run(spark, sf_dir, TABLES))
    cell = F.filter("elements", lambda e: e["context"] == "Name")[0]
    box = F.filter("elements", lambda e: e["tag"] == "select")[0]
    return seen.select("page_id", cell["text"].alias("text"), cell["context"].alias("context"), box["options"].alias("options"))
