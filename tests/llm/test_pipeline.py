import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from quillmask.llm import quality_rules
from tests.llm import test_jaccard_join as near
from tests.llm import test_line_dedup as lines
from tests.llm import test_packing as packing
from tests.llm import test_quality_rules as rules

D = "/root/testdata/sf0.01"


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").filter("doc_id < 300")
    steps, now = {}, docs
    for name, stage in cp.STAGES:
        now = cp.written(stage(spark, now, D), name)
        steps[name] = now
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    kept = {i for i, _ in pairs(steps["quality_rules"])}
    measured = quality_rules.quality_rules(docs).collect()
    assert kept == {r.doc_id for r in measured if r.q_rule is None}
    assert all((r.q_words, r.q_word_chars, r.q_symbols, r.q_dup_lines, r.q_repeat_words) == rules.brute(r.text) for r in measured)
    good = pairs(steps["quality_classifier"])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    assert {i for i, _ in good} <= kept and np.mean([labels.get(i, 1) for i, _ in good]) > 0.97
    assert {i for i in kept if labels.get(i) == 1} <= {i for i, _ in good}
    left = pairs(steps["line_dedup"])
    want = [(i, t) for i, t, n in lines.brute(good) if n == 0 or near.WORD.search(t)]
    assert sorted(left) == sorted(want)
    one = pairs(steps["jaccard_join"])
    assert sorted(i for i, _ in one) == sorted(i for i, _, c in near.brute(left) if i == c)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in one}
    pieces = steps["packing"].collect()
    for r in pieces:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    packing.check([(r.doc_id, r.start, ids[r.doc_id][r.start : r.start + r.length], r.doc_tokens, r.sequence_id, r.offset) for r in pieces], ids)
    for name, _ in cp.STAGES[:-1]:
        assert steps[name].columns == cp.COLUMNS


def test_run_on_empty_documents(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{D}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_rows_that_share_an_id_but_not_the_text_stay(spark):
    a, b = (" ".join(f"{w}{i}" for i in range(20)) for w in "ab")
    rows = [(1, a), (1, a), (1, b), (2, a)]
    docs = spark.createDataFrame([(i, t, "de", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted((r.doc_id, r.text) for r in cp.near_duplicates_stage(spark, docs, D).collect()) == [(1, a), (1, b)]


def test_odd_rows_in_every_stage(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and further columns of clashing names."""
    good = [r.text for r in spark.read.parquet(f"{D}/labels.parquet").filter("quality = 1").join(spark.read.parquet(f"{D}/documents.parquet"), "doc_id").orderBy("doc_id").limit(6).collect()]
    rows = [(0, good[0]), (0, good[0]), (0, good[1]), (None, good[2]), (None, None), (1, None), (2, ""), (3, " ".join(good) * 30), (4, good[3]), (5, good[3]), (6, good[4])]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS q_kept", "'x' AS sig", "2 AS q_score", "3 AS line", "4 AS component_id").repartition(3)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, D).collect()
        if name == "quality_rules":
            assert {r.text for r in out} >= {good[0], good[1], good[2]} and not any(not r.text for r in out)
        if name == "line_dedup":
            assert sum(r.doc_id is None for r in out) == 2 and any(r.text == good[1] for r in out)
        if name == "jaccard_join":
            assert sorted(str(r.doc_id) for r in out if r.text == good[3]) == ["4"] and {good[0], good[1], good[2]} <= {r.text for r in out}
        if name == "packing":
            assert sum(r.doc_id is None for r in out) >= 2
