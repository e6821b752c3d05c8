"""Inputs for the registered queries, made from the supplied tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quillmask.functions.checksums import BASE36, GROUP, INVERSE, POWERS

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to all cores where the input has fewer partitions than there are cores: for work that costs more than a shuffle of its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A shared SQL text over the tables it names in braces."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def oracle(sql: str) -> str:
    """The same text for DuckDB."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def digit(text: str, i: int) -> str:
    return f"CAST(substr({text}, {i}, 1) AS INT)"


def verhoeff_sum(text: str, n: int, shift: int) -> str:
    """Verhoeff's running value over the n digits of a text, from the last."""
    out = "0"
    for k in range(n):
        p = f"CAST(substr('{POWERS}', {((k + shift) % 8) * 10 + 1} + {digit(text, n - k)}, 1) AS INT)"
        out = f"CAST(substr('{GROUP}', 10 * {out} + {p} + 1, 1) AS INT)"
    return out


def verhoeff_digit(text: str, n: int) -> str:
    return f"substr('{INVERSE}', {verhoeff_sum(text, n, 1)} + 1, 1)"


def luhn_sum(text: str, n: int, doubled_last: bool) -> str:
    terms = []
    for k in range(n):
        d = digit(text, n - k)
        terms.append(f"(CASE WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)" if (k % 2 == 0) == doubled_last else d)
    return "(" + " + ".join(terms) + ")"


def luhn_digit(text: str, n: int) -> str:
    return f"CAST((10 - {luhn_sum(text, n, True)} % 10) % 10 AS STRING)"


def gstin_char(text: str) -> str:
    terms = []
    for i in range(14):
        v = f"(instr('{BASE36}', substr({text}, {i + 1}, 1)) - 1)"
        p = v if i % 2 == 0 else f"(2 * {v})"
        terms.append(f"CAST(floor({p} / 36.0) AS INT) + {p} % 36")
    return f"substr('{BASE36}', (36 - ({' + '.join(terms)}) % 36) % 36 + 1, 1)"


def letter(number: str) -> str:
    return f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(({number}) % 26 AS INT) + 1, 1)"


def padded(number: str, width: int) -> str:
    return f"lpad(CAST({number} AS STRING), {width}, '0')"


LEAP_DAYS = "CASE WHEN m IN (4, 6, 9, 11) THEN 30 WHEN m = 2 THEN CASE WHEN y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0) THEN 29 ELSE 28 END ELSE 31 END"

#: A row per customer with one identifier of each kind, all with right check digits.
IDENTIFIERS = f"""
SELECT k, 'user' || CAST(k AS STRING) || '@mail' || CAST(k % 7 AS STRING) || '.example.com' AS email, 'user' || CAST(k AS STRING) || '@okbank' AS upi, pan,
       a11 || {verhoeff_digit('a11', 11)} AS aadhaar, c15 || {luhn_digit('c15', 15)} AS card, 'HDFC0' || {padded('(k * 31) % 1000000', 6)} AS ifsc,
       '9' || {padded('(k * 104729 + 777) % 1000000000', 9)} AS phone, 'KA ' || {padded('k % 90 + 1', 2)} || ' AB ' || {padded('(k * 13) % 10000', 4)} AS vehicle,
       'K' || CAST(k % 9 + 1 AS STRING) || {padded('(k * 17) % 1000000', 6)} AS passport, '10.' || CAST(k % 250 AS STRING) || '.' || CAST((k * 3) % 250 AS STRING) || '.7' AS ip,
       {padded('d', 2)} || '/' || {padded('m', 2)} || '/' || CAST(y AS STRING) AS dob, d <= {LEAP_DAYS} AS dob_valid,
       '1' || {padded('(k * 7907) % 10000000000', 10)} AS account, CAST(k % 8 + 1 AS STRING) || {padded('(k * 37) % 100000', 5)} AS pincode, g14 || {gstin_char('g14')} AS gstin
FROM (SELECT *, {padded('k % 37 + 1', 2)} || pan || '1Z' AS g14
      FROM (SELECT c_custkey AS k, c_custkey % 31 + 1 AS d, c_custkey % 12 + 1 AS m, 1950 + c_custkey % 50 AS y,
                   CAST(c_custkey % 8 + 2 AS STRING) || {padded('(c_custkey * 7919 + 12345) % 10000000000', 10)} AS a11, '4' || {padded('(c_custkey * 15485863) % 100000000000000', 14)} AS c15,
                   {letter('c_custkey')} || {letter('c_custkey * 3 + 1')} || {letter('c_custkey * 5 + 2')} || 'P' || {letter('c_custkey * 7')} || {padded('(c_custkey * 11) % 10000', 4)} || {letter('c_custkey * 9 + 4')} AS pan
            FROM {{customer}}) a) b
"""

#: The order of identifiers in a text, with type, what stands before each, and its confidence.
PLACED = (
    ("email", "EMAIL", "Email ", 0.99), ("upi", "UPI", " and handle ", 0.95), ("pan", "PAN", " PAN ", 0.97), ("aadhaar", "AADHAAR", " Aadhaar ", 0.99), ("card", "CARD", " card ", 0.98),
    ("ifsc", "IFSC", " IFSC ", 0.97), ("phone", "PHONE", " mobile ", 0.93), ("vehicle", "VEHICLE", " car ", 0.9), ("passport", "PASSPORT", " passport ", 0.85), ("ip", "IP", " host ", 0.95),
    ("dob", "DOB", " dob ", 0.9), ("account", "ACCOUNT", " account no ", 0.85), ("pincode", "PINCODE", " at Pune, ", 0.85), ("gstin", "GSTIN", " GST ", 0.99),
)
TEXTS = "SELECT *, " + " || ".join(f"'{lead}' || {c}" for c, _, lead, _ in PLACED) + f" || ' end' AS text FROM ({IDENTIFIERS}) i"
#: What is in the texts, by construction.
TRUTH = " UNION ALL ".join(f"SELECT k, '{t}' AS type, {c} AS value, instr(text, '{lead}' || {c}) + {len(lead)} - 1 AS start, {conf} AS confidence FROM t" + (" WHERE dob_valid" if c == "dob" else "") for c, t, lead, conf in PLACED)

#: Step metrics from the events: a run is a user's day, steps by time.
STEPS = """
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS INT) AS step, event_id AS ts, 'https://site' || CAST(user_id % 9 AS STRING) || '.example.com' AS origin,
       CASE event_type WHEN 'error' THEN 'blocked' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'declined' ELSE 'sent' END AS outcome, event_type AS action, user_id % 3 = 0 AS reused,
       CAST(event_id % 40 AS INT) AS elements, CAST(event_id % 4 AS INT) AS opaque, CAST(event_id % 11 AS INT) AS placeholders, CAST(event_id % 6 AS INT) AS image_detections, event_id % 5 = 0 AS image_sent,
       CAST(length(props) * 10 AS BIGINT) AS bytes, CAST(length(props) * 3 AS BIGINT) AS tokens_est, CAST(event_id % 2 AS INT) AS gate_hits,
       value / 8 AS ms_observe, value / 4 AS ms_sanitize, CASE WHEN event_id % 5 = 0 THEN value ELSE 0.0 END AS ms_vision, value / 16 AS ms_gate, value AS ms_server, value * 2 AS ms_total,
       CAST(event_id % 700 AS DOUBLE) AS model_load_ms, value / 32 AS ms_validate, value / 64 AS ms_confirm, value / 2 AS ms_execute
FROM (SELECT *, CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS run_id FROM {events}) e
"""
