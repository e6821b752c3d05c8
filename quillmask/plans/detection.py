"""Queries of check digits, detectors, field rules and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.functions import checksums, fields, patterns, text
from quillmask.functions.spans import merge_spans, redact, rehydrate, subtract_spans, trim_span, unknown_tokens
from quillmask.operators.actions import raw_types
from quillmask.plans.common import IDENTIFIERS, TEXTS, TRUTH, gstin_char, luhn_digit, luhn_sum, oracle, padded, run, spread, table, verhoeff_digit, verhoeff_sum

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201  a decorator
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return add


KEYS = f"SELECT o_orderkey AS k, {padded('o_orderkey * 7 + 3', 12)} AS t12, {padded('(o_orderkey * 15485863) % 1000000000000000', 16)} AS t16 FROM {{orders}}"


@query(f"SELECT k, {verhoeff_sum('t12', 12, 0)} = 0 AS valid, CAST({verhoeff_digit('t12', 12)} AS INT) AS check_digit FROM ({KEYS})")
def c1_verhoeff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = run(spark, sf_dir, KEYS)
    return d.select("k", checksums.verhoeff_valid(F.col("t12")).alias("valid"), checksums.verhoeff_check_digit(F.col("t12")).alias("check_digit"))


@query(f"SELECT k, {luhn_sum('t16', 16, False)} % 10 = 0 AS valid, CAST({luhn_digit('t16', 16)} AS INT) AS check_digit FROM ({KEYS})")
def c2_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = run(spark, sf_dir, KEYS)
    return d.select("k", checksums.luhn_valid(F.col("t16")).alias("valid"), checksums.luhn_check_digit(F.col("t16")).cast("int").alias("check_digit"))


@query(f"SELECT k, {gstin_char('substr(gstin, 1, 14)')} AS check_char, true AS valid, false AS other_valid FROM ({IDENTIFIERS})")
def c3_gstin(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, g = run(spark, sf_dir, IDENTIFIERS), F.col("gstin")
    last = F.translate(F.substring(g, 15, 1), checksums.BASE36, checksums.BASE36[1:] + "0")
    return d.select("k", checksums.gstin_check_char(g).alias("check_char"), checksums.gstin_valid(g).alias("valid"), checksums.gstin_valid(F.concat(F.substring(g, 1, 14), last)).alias("other_valid"))


DATES = "SELECT o_orderkey AS k, o_orderkey % 35 AS d, o_orderkey % 15 AS m, 1890 + o_orderkey % 230 AS y FROM {orders}"


@query(f"SELECT k, y BETWEEN 1900 AND 2100 AND m BETWEEN 1 AND 12 AND d >= 1 AND try_cast(printf('%04d-%02d-%02d', y, m, d) AS DATE) IS NOT NULL AS valid FROM ({DATES})")
def c4_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, DATES).select("k", checksums.valid_date(F.col("d"), F.col("m"), F.col("y")).alias("valid"))


@query(f"WITH t AS ({TEXTS}) SELECT k, type, value, CAST(start AS INT) AS start, CAST(start + length(value) AS INT) AS stop, CAST(confidence AS DOUBLE) AS confidence FROM ({TRUTH}) x")
def d18_detect_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules and their resolution over texts that hold one identifier of each kind."""
    found = spread(run(spark, sf_dir, TEXTS)).select("k", F.explode(patterns.detect_patterns(F.col("text"))).alias("s"))
    return found.select("k", "s.type", "s.value", "s.start", F.col("s.end").alias("stop"), "s.confidence")


def _rule(column: str, rule: str, extra: str = "") -> None:
    """A query for one rule alone, over the texts."""

    def one(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = run(spark, sf_dir, TEXTS).select("k", F.explode(patterns.rule_spans(F.col("text"), patterns.BY_NAME[rule])).alias("s"))
        return found.select("k", "s.value", "s.start")

    one.__name__ = f"d_{rule}"
    lead = next(lead for c, _, lead, _ in _placed() if c == column)
    query(f"SELECT k, {column} AS value, CAST(instr(text, '{lead}' || {column}) + {len(lead)} - 1 AS INT) AS start FROM ({TEXTS}) t {extra}")(one)


def _next_digit(column: str) -> str:
    """An identifier with another last digit."""
    return f"substr({column}, 1, length({column}) - 1) || CAST((CAST(substr({column}, length({column}), 1) AS INT) + 1) % 10 AS STRING)"


#: For a rule a text with a right identifier and one with a near miss.
NEAR = (
    ("email", "'mail ' || email", "'mail user@host' || CAST(k AS STRING)"),
    ("upi", "'to ' || upi", "'to ' || upi || '.in'"),
    ("gstin", "'GST ' || gstin", "'GST ' || substr(gstin, 1, 14) || CASE WHEN substr(gstin, 15, 1) = 'A' THEN 'B' ELSE 'A' END"),
    ("pan", "'PAN ' || pan", "'PAN ' || lower(pan)"),
    ("aadhaar", "'no ' || aadhaar", f"'no ' || {_next_digit('aadhaar')}"),
    ("card", "'card ' || card", f"'card ' || {_next_digit('card')}"),
    ("ifsc", "'IFSC ' || ifsc", "'IFSC HDFC1' || substr(ifsc, 6)"),
    ("phone", "'mobile ' || phone", "'mobile 5' || substr(phone, 2)"),
    ("vehicle", "'car ' || vehicle", "'car XX' || substr(vehicle, 3)"),
    ("passport", "'passport ' || passport", "'passport K0' || substr(passport, 3)"),
    ("ip", "'host ' || ip", "'host 10.' || CAST(256 + k % 700 AS STRING) || '.1.7'"),
    ("birth_numeric", "'dob 05/02/1990'", "'dob 31/02/1990'"),
    ("account_labelled", "'account no ' || account", "'order of ' || account"),
    ("pincode", "'at Pune, ' || pincode", "'a sum of ' || pincode"),
)
NEAR_TEXTS = " UNION ALL ".join(f"SELECT k, '{rule}' AS rule, CASE WHEN (k + {j}) % 2 = 0 THEN {good} ELSE {bad} END AS text, (k + {j}) % 2 = 0 AS found FROM ({IDENTIFIERS}) i{j}" for j, (rule, good, bad) in enumerate(NEAR))


@query(f"SELECT k, rule, found FROM ({NEAR_TEXTS}) x")
def f36_near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right identifiers are found by their rule, near misses (another check digit, border, place or label) are not."""
    found = F.lit(None).cast("boolean")
    for rule, _, _ in NEAR:
        found = F.when(F.col("rule") == rule, F.size(patterns.rule_spans(F.col("text"), patterns.BY_NAME[rule])) > 0).otherwise(found)
    return run(spark, sf_dir, NEAR_TEXTS).select("k", "rule", found.alias("found"))


def _placed() -> tuple:
    from quillmask.plans.common import PLACED

    return PLACED


for _column, _name, _where in (
    ("email", "email", ""), ("upi", "upi", ""), ("gstin", "gstin", ""), ("pan", "pan", ""), ("aadhaar", "aadhaar", ""), ("card", "card", ""), ("ifsc", "ifsc", ""), ("phone", "phone", ""),
    ("vehicle", "vehicle", ""), ("passport", "passport", ""), ("ip", "ip", ""), ("dob", "birth_numeric", "WHERE dob_valid"), ("account", "account_labelled", ""), ("pincode", "pincode", ""),
):
    _rule(_column, _name, _where)


@query("SELECT doc_id, unnest(regexp_extract_all(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}\\b')) AS value FROM documents")
def d01_email_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(patterns.rule_spans(F.col("text"), patterns.BY_NAME["email"])).alias("s")).select("doc_id", "s.value")


SPELLED = "SELECT c_custkey AS k, 'write to user' || CAST(c_custkey AS STRING) || ' [at] mail' || CAST(c_custkey % 5 AS STRING) || ' [dot] com today' AS text FROM {customer}"


@query(f"SELECT k, replace(replace(text, 'write to ', ''), ' today', '') AS value, 9 AS start FROM ({SPELLED})")
def d02_email_spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, SPELLED).select("k", F.explode(patterns.rule_spans(F.col("text"), patterns.BY_NAME["email_spelled"])).alias("s")).select("k", "s.value", "s.start")


BORN = """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'born 3rd March 19' ELSE 'date of birth: 19' END || lpad(CAST(c_custkey % 90 + 10 AS STRING), 2, '0') ||
          CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '-02-11' WHEN 2 THEN '-12-30' ELSE ' March' END AS text FROM {customer}"""


@query(f"SELECT k, CASE k % 4 WHEN 0 THEN substr(text, 6) ELSE substr(text, 16) END AS value FROM ({BORN}) WHERE k % 4 <> 3")
def d14_birth_spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, BORN).select("k", F.explode(patterns.rule_spans(F.col("text"), patterns.BY_NAME["birth_spelled"])).alias("s")).select("k", "s.value")


ALONE = "SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN ' ' ELSE '' END || CAST(o_orderkey + 100000000 AS STRING) || CASE o_orderkey % 3 WHEN 1 THEN 'x' WHEN 2 THEN ' ' ELSE '' END AS text FROM {orders}"


@query(f"SELECT k, text AS value FROM ({ALONE}) WHERE regexp_full_match(text, '\\s*\\d{{9,18}}\\s*') AND NOT regexp_full_match(trim(text), '1+|2+|3+|4+|5+|6+|7+|8+|9+|0+')")
def d16_account_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, ALONE).select("k", F.explode(patterns.rule_spans(F.col("text"), patterns.BY_NAME["account_alone"])).alias("s")).select("k", "s.value")


@query()
def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of every document, counted by type."""
    docs = table(spark, sf_dir, "documents")
    found = spread(docs).select("doc_id", F.explode(patterns.detect_patterns(F.col("text"))).alias("s"))
    return found.groupBy("s.type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


@query(f"SELECT k, ['PHONE', 'PAN', 'EMAIL', 'CARD'] AS types, []::VARCHAR[] AS none FROM ({IDENTIFIERS})")
def p13_raw_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = run(spark, sf_dir, TEXTS)
    return d.select("k", raw_types(F.col("text")).alias("types"), raw_types(F.lit("nothing 12 here")).alias("none"))


#: Labels and the type that the rules give them.
LABELS = (
    ("Enter OTP", "OTP"), ("verification_code", "OTP"), ("cvv2", "CVV"), ("securityCode", "CVV"), ("M-PIN", "PIN"), ("mpin", "PIN"), ("pin code", "PINCODE"), ("Aadhaar number", "AADHAAR"), ("uid", "AADHAAR"),
    ("panNumber", "PAN"), ("Permanent Account Number", "PAN"), ("IFSC", "IFSC"), ("account_no", "ACCOUNT"), ("a/c", "ACCOUNT"), ("dateOfBirth", "DOB"), ("zip", "PINCODE"), ("cardNumber", "CARD"),
    ("passcode", "PASSWORD"), ("apiKey", "SECRET"), ("Full name", None), ("spanish", None), ("company", None),
)
LABEL_VALUES = ", ".join(f"({i}, '{label}')" for i, (label, _) in enumerate(LABELS))
FIELDS = f"SELECT c_custkey AS k, l AS label FROM {{customer}} c JOIN (VALUES {LABEL_VALUES}) AS v(i, l) ON c_custkey % {len(LABELS)} = i"
LABEL_TRUTH = " ".join(f"WHEN {i} THEN " + (f"'{t}'" if t else "NULL") for i, (_, t) in enumerate(LABELS))


@query(f"SELECT k, CASE k % {len(LABELS)} {LABEL_TRUTH} END AS type FROM ({FIELDS})")
def p01_field_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return run(spark, sf_dir, FIELDS).select("k", fields.dom_rule_type(none, none, none, none, F.col("label"), none).alias("type"))


KINDS = """SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'email' WHEN 1 THEN 'tel' WHEN 2 THEN 'password' WHEN 3 THEN 'text' ELSE '' END AS kind,
                  CASE c_custkey % 5 WHEN 0 THEN 'cc-csc' WHEN 1 THEN 'cc-exp' WHEN 2 THEN 'bday-year' WHEN 3 THEN 'tel-national' ELSE '' END AS auto FROM {customer}"""


@query(f"""SELECT k, CASE WHEN kind = 'password' THEN 'PASSWORD' WHEN auto = 'cc-csc' THEN 'CVV' WHEN auto LIKE 'cc-%' THEN 'CARD' WHEN auto LIKE 'bday%' THEN 'DOB' END AS rule,
                  CASE WHEN kind = 'password' THEN 'PASSWORD' WHEN auto = 'cc-csc' THEN 'CVV' WHEN auto LIKE 'cc-%' THEN 'CARD' WHEN auto LIKE 'bday%' THEN 'DOB'
                       WHEN kind = 'email' THEN 'EMAIL' WHEN kind = 'tel' OR auto LIKE 'tel%' THEN 'PHONE' END AS accepts FROM ({KINDS})""")
def p02_accepted_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    d = run(spark, sf_dir, KINDS).withColumn("rule", fields.dom_rule_type(F.col("kind"), F.col("auto"), none, none, none, none))
    return d.select("k", "rule", fields.accepted_types(F.col("rule"), F.col("kind"), F.col("auto"))[0].alias("accepts"))


HINT_VALUES = (("Aadhaar", "AADHAAR"), ("PAN card", "PAN"), ("UPI id", "UPI"), ("E-mail", "EMAIL"), ("Mobile", "PHONE"), ("Contact no", "PHONE"), ("Credit card", "CARD"), ("Birth date", "DOB"), ("Pincode", "PINCODE"), ("Address", "ADDRESS"), ("Name", "NAME"), ("Colour", None))
HINTED = "SELECT c_custkey AS k, l AS label FROM {customer} JOIN (VALUES " + ", ".join(f"({i}, '{x}')" for i, (x, _) in enumerate(HINT_VALUES)) + f") AS v(i, l) ON c_custkey % {len(HINT_VALUES)} = i"


@query(f"SELECT k, CASE k % {len(HINT_VALUES)} " + " ".join(f"WHEN {i} THEN " + (f"'{t}'" if t else "NULL") for i, (_, t) in enumerate(HINT_VALUES)) + f" END AS wanted FROM ({HINTED})")
def f29_wanted_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, HINTED).select("k", fields.wanted_type(F.lit(None).cast("string"), F.col("label")).alias("wanted"))


TRUE_KINDS = (("Your e-mail", "EMAIL"), ("captcha", None), ("pan no", "PAN"), ("acc_no", "ACCOUNT"), ("one time code", "OTP"), ("WhatsApp", "PHONE"), ("DOB", "DOB"), ("street", "ADDRESS"), ("user name", None), ("Name", "NAME"), ("other", None))
TRUE_SQL = "SELECT c_custkey AS k, l AS label FROM {customer} JOIN (VALUES " + ", ".join(f"({i}, '{x}')" for i, (x, _) in enumerate(TRUE_KINDS)) + f") AS v(i, l) ON c_custkey % {len(TRUE_KINDS)} = i"


@query(f"SELECT k, CASE k % {len(TRUE_KINDS)} " + " ".join(f"WHEN {i} THEN " + (f"'{t}'" if t else "NULL") for i, (_, t) in enumerate(TRUE_KINDS)) + f" END AS type FROM ({TRUE_SQL})")
def p15_truth_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return run(spark, sf_dir, TRUE_SQL).select("k", fields.truth_type(F.lit("input"), none, F.lit(False), F.col("label"), none, none, none, none).alias("type"))


@query("SELECT conv_id, turn, regexp_replace(lower(text), '[\\s\\-_.()/+,:]', '', 'g') AS norm FROM conversations")
def f01_normalize_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize_value(F.col("text")).alias("norm"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(c_mktsegment || 'fooBar_baz-qux.Quux', '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_\\-.]', ' ', 'g') AS words FROM customer")
def f09_split_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.split_identifiers(F.concat("c_mktsegment", F.lit("fooBar_baz-qux.Quux"))).alias("words"))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes, CAST(ceil(strlen(text) / 4.0) AS BIGINT) + CASE WHEN doc_id % 2 = 0 THEN 765 ELSE 0 END AS tokens FROM documents")
def f10_digest_bytes_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.octet_length("text").cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", text.sha256(F.col("text")).alias("sha256"), b.alias("bytes"), text.estimate_tokens(b, F.col("doc_id") % 2 == 0).alias("tokens"))


@query("""WITH RECURSIVE h(k, t, i, v) AS (SELECT c_custkey, c_name, 1, 2166136261::BIGINT FROM customer
          UNION ALL SELECT k, t, i + 1, (xor(v, ascii(t[i])::BIGINT) * 16777619) & 4294967295 FROM h WHERE i <= length(t))
          SELECT k AS c_custkey, v AS h FROM h WHERE i = length(t) + 1""")
def f11_fnv1a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.fnv1a(F.col("c_name")).alias("h"))


@query("SELECT page_id, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe, regexp_extract(lower(url), '^https?://(?:www\\.)?([^/:]+)', 1) AS host, regexp_extract(lower(url), '^(https?://[^/]+)', 1) AS origin FROM pages")
def p08_hosts_and_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.escape_html(u).alias("safe"), text.host_of(u).alias("host"), text.origin_of(u).alias("origin"))


@query("SELECT l_orderkey, l_linenumber, floor(l_extendedprice / 1280 * 1000 + 0.5) / 1000 AS x, printf('%.2f', CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) / 4) AS shown FROM lineitem")
def p09_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.round3(F.col("l_extendedprice") / 1280).alias("x"), text.fixed(F.col("l_quantity").cast("bigint").cast("double") / 4).alias("shown"))


@query("SELECT conv_id, turn, strlen(text) AS n FROM conversations")
def f35_base64_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.base64_bytes(F.base64(F.col("text").cast("binary"))).cast("bigint").alias("n"))


@query("SELECT vec_id, CAST(round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS DOUBLE) AS score FROM embeddings")
def f39_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    one = e.filter("vec_id = 0").select(F.col("embedding").alias("first"))  # a single row
    return e.join(F.broadcast(one)).select("vec_id", F.round(text.cosine(F.col("embedding"), F.col("first")), 6).alias("score"))


PAYLOADS = """SELECT c_custkey AS k, '{"a":"<PAN_' || CAST(c_custkey % 3 + 1 AS STRING) || '> and <NAME_1>, <PAN_1>","bbox":[0.1,2,3,' || CAST(c_custkey AS STRING) || '],"n":<X>}' AS t FROM {customer}"""
PAYLOADS = PAYLOADS.replace('{"a"', "<<a").replace("<<a", '~"a"').replace('":<X>}', '":<X>~')


@query(f"SELECT k, list_distinct(regexp_extract_all(t, '<[A-Z]+_\\d+>')).list_sort() AS tokens, regexp_replace(t, '\"bbox\":\\[[^\\]]*\\]', '\"bbox\":[]', 'g') AS blanked FROM ({PAYLOADS})")
def f05_tokens_and_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = run(spark, sf_dir, PAYLOADS)
    return d.select("k", F.array_sort(text.tokens_in(F.col("t"))).alias("tokens"), text.blank_boxes(F.col("t")).alias("blanked"))


@query(f"SELECT k, 'Email <EMAIL_1>' || substr(text, length(email) + 7) AS safe, text AS back, 1 AS n_unknown FROM ({TEXTS})")
def f02_redact_f03_rehydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = run(spark, sf_dir, TEXTS)
    spans = F.transform(F.filter(patterns.detect_patterns(F.col("text")), lambda s: s["type"] == "EMAIL"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("<EMAIL_1>").alias("token")))
    d = d.withColumn("safe", redact(F.col("text"), spans)).withColumn("map", F.create_map(F.lit("<EMAIL_1>"), F.col("email")))
    return d.select("k", "safe", rehydrate(F.col("safe"), F.col("map")).alias("back"), F.size(unknown_tokens(F.concat("safe", F.lit(" <PAN_9>")), F.col("map"))).alias("n_unknown"))


SPAN_ROWS = "SELECT l_orderkey AS k, l_linenumber AS i, l_partkey % 20 AS a, l_partkey % 20 + l_suppkey % 9 + 1 AS b, l_linenumber % 2 = 0 AS model FROM {lineitem}"


@query(f"""WITH s AS (SELECT DISTINCT k, a, b, model FROM ({SPAN_ROWS})), pos AS (SELECT k, a + p AS c FROM (SELECT k, a, b, unnest(range(b - a)) AS p FROM s WHERE model)),
           cov AS (SELECT DISTINCT k, c FROM pos WHERE NOT EXISTS (SELECT 1 FROM s r WHERE NOT r.model AND r.k = pos.k AND r.a <= pos.c AND pos.c < r.b))
           SELECT k, count(*) AS model_chars FROM cov GROUP BY k""")
def x02_merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that model spans keep after fusion."""
    rows = run(spark, sf_dir, SPAN_ROWS)
    one = patterns.span(F.lit("NAME"), F.col("a"), F.col("b"), F.lit("v"), F.when(F.col("model"), "ner").otherwise("pattern"), F.lit(0.5))
    merged = rows.groupBy("k").agg(merge_spans(F.collect_set(one)).alias("m"))
    chars = F.aggregate(F.filter("m", lambda s: s["source"] == "ner"), F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    return merged.select("k", chars.cast("bigint").alias("model_chars")).filter("model_chars > 0")


@query(f"""WITH s AS (SELECT DISTINCT k, a, b, model FROM ({SPAN_ROWS}))
           SELECT m.k, m.a, m.b, count(r.a) AS overlapping FROM s m LEFT JOIN s r ON r.k = m.k AND NOT r.model AND m.a < r.b AND r.a < m.b WHERE m.model GROUP BY ALL""")
def j06_span_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rule spans each model span overlaps: within a key's arrays, no range join."""
    rows = run(spark, sf_dir, SPAN_ROWS).select("k", F.struct(F.col("a").alias("start"), F.col("b").alias("end")).alias("s"), "model")
    both = rows.groupBy("k").agg(F.collect_set(F.when(F.col("model"), F.col("s"))).alias("m"), F.collect_set(F.when(~F.col("model"), F.col("s"))).alias("r"))
    out = both.select("k", "r", F.explode("m").alias("x"))
    return out.select("k", F.col("x.start").alias("a"), F.col("x.end").alias("b"), F.size(F.filter("r", lambda y: patterns.overlaps(F.col("x"), y))).cast("bigint").alias("overlapping"))


@query("SELECT c_custkey, 3 AS start, 3 + length(c_name) + 3 AS stop, c_name AS value, 2 AS pieces FROM customer")
def f06_trim_u02_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loose span trimmed to its value, and the pieces of one span around another."""
    t = F.concat(F.lit(" , "), F.col("c_name"), F.lit(" .;, PIN"))
    s = patterns.span(F.lit("ADDRESS"), F.lit(0), F.length(t), t, F.lit("ner"), F.lit(0.9))
    out = table(spark, sf_dir, "customer").select("c_custkey", trim_span(t, s).alias("s"), F.size(subtract_spans(F.array(s), F.array(patterns.span(F.lit("PAN"), F.lit(5), F.lit(9), F.lit("x"), F.lit("pattern"), F.lit(1.0))))).alias("pieces"))
    return out.select("c_custkey", "s.start", F.col("s.end").alias("stop"), F.regexp_replace("s.value", "[ .;,]+$", "").alias("value"), "pieces")
