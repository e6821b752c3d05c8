import re
from collections import Counter

from pyspark.sql import functions as F

from quillmask.llm import quality_rules as q
from quillmask.llm.query_filters import op1_quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(spark):
    texts = [None, "", " \n\t", "a", "a b c d e f g h", "a b c d e f g h " * 3, "a " * 20, "x\n\nx\n x\nx ", "é b \U0001f600 c", "a b c d e f g h i a b c d e f g h\x0bi", "#$ |\n#$ |"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "k long, text string, q_words string")
    got = {r.k: r for r in q.quality_rules(rows).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.q_words, r.q_word_chars, r.q_symbols, r.q_dup_lines, r.q_repeat_words) == brute(t), t
        n, *_, repeats = brute(t)
        assert r.q_base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert not (r.q_base_failed and r.q_kept)
    assert q.quality_rules(rows.limit(0)).collect() == []


def test_order_changes_no_verdict(spark):
    docs = q.measure(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rules = q.rules()
    names = list(rules)
    a, b = (docs.filter(q.cascade(rules, order).isNull()).count() for order in (names, names[::-1]))
    assert a == b > 0


def test_cheap_and_selective_rules_go_first(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    heavy = F.col("text")
    for c in "abcdefgh":
        heavy = F.regexp_replace(heavy, f"{c}+[^{c}]", c)
    checks = {"heavy": F.length(heavy) > 40, "cheap": F.col("q_words") > 5, "never": F.col("q_words") < -5}
    assert q.rule_order(docs, checks)[0] == q.rule_order(docs, checks)[0] == "cheap"
    assert len(q.sample_of(docs, 50, "text").collect()) == 50
    assert set(q.rule_order(docs.limit(0), checks)) == set(checks)


def test_order_is_by_rejection_per_cost(spark):
    sample = q.measure(spark.createDataFrame([("a b c",)], "text string"))
    ticks = iter([0, 1, 0, 1, 0, 1, 0, 9, 0, 9, 0, 9, 0, 3, 0, 3, 0, 3])
    found = q.costs(sample, {"slow": F.lit(True), "fast": F.lit(True)}, lambda: float(next(ticks)))
    assert found == {"slow": 8 / q.REPEATS, "fast": 2 / q.REPEATS}


def test_odd_rows(spark):
    long = "word " * 400_000
    rows = [(1, long), (1, long), (2, None), (2, None), (3, " ".join(f"w{i}" for i in range(30)))]
    got = q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS q_kept", "1 AS q_again")).collect()
    assert len(got) == 5
    assert [(r.q_words, r.q_base_failed, r.q_kept) for r in got if r.doc_id == 1] == [(400_000, True, False)] * 2
    assert [(r.q_words, r.q_base_failed, r.q_kept) for r in got if r.doc_id == 2] == [(0, True, False)] * 2


def test_labelled_good_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    kept = op1_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1"), "doc_id")
    assert kept.filter("NOT base_failed AND NOT kept").count() == 0
