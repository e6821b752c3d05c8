import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillmask.llm import quality_classifier as qc
from quillmask.llm.query_filters import op8_quality_classifier


def test_held_out_accuracy_and_columns(spark):
    d = "/root/testdata/sf0.01"
    scored = op8_quality_classifier(spark, d)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r.held_out]
    assert len(out) > 30 and np.mean([r.predicted == r.quality for r in out]) >= 0.97
    assert scored.count() == spark.read.parquet(f"{d}/documents.parquet").count()


def test_held_out_labels_are_never_learnt(spark):
    docs = spark.createDataFrame([(i, f"w{i} x") for i in range(200)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 5 = 0, 1, 0) AS quality")
    assert qc.train(docs, labels).bias < 0


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9), (1, "", 9), (None, "a b", 9), (2, "\U0001f600 é " * 60_000, 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = qc.score(docs, qc.train(docs, labels)).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert qc.train(docs.limit(0), labels.limit(0)).bias == 0
    assert qc.score(docs.limit(0), qc.Model(np.zeros(1 << qc.BITS, np.float32), 0.0)).collect() == []


def test_score_is_the_sparse_dot_product():
    text = "Aa bb!! aa aa CC"
    (at, value), = qc.features(pa.array([text], pa.large_string()))
    assert np.sum(value**2) == pytest.approx(1, abs=1e-5)
    assert len(at) == len(set(at.tolist()))


def test_training_separates():
    rows = [(np.array([i % 2, 2 + i % 7]), np.array([0.8, 0.6], np.float32), i % 2) for i in range(400)]
    m = qc.train_ftrl(rows)
    assert m.weights[1] > 0 > m.weights[0]


def plain_features(text):
    """Features by a loop over bytes: runs, pairs of neighbours and marks, counted and scaled to length 1."""
    data = (text or "").encode()
    runs, at = [], 0
    while at < len(data):
        kind, end = qc.KINDS[data[at]], at
        while end < len(data) and qc.KINDS[data[end]] == kind:
            end += 1
        if kind:
            runs.append(data[at:end])
        at = end
    one = lambda b: qc.hash_spans(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]), True)[0]
    h = [one(b) for b in runs]
    mark = [int(m) % (1 << qc.BITS) for m in qc.mix(qc.STEP_KEYS[20:24])]
    counts = Counter(int(x) % (1 << qc.BITS) for x in h)
    with np.errstate(over="ignore"):
        counts.update(int(qc.mix(np.array([a * qc.STEP_KEYS[11] + b * qc.STEP_KEYS[12]]))[0]) % (1 << qc.BITS) for a, b in zip(h, h[1:], strict=False))
    for k, place in ((1, 0), (2, 1), (4, 2)):
        counts[mark[place]] += sum(a == b for a, b in zip(h[k:], h, strict=False))
    counts[mark[3]] += sum(len(b) > 1 and 65 <= b[0] <= 90 and 65 <= b[-1] <= 90 for b in runs)
    norm = max(sum(v * v for v in counts.values()) ** 0.5, 1.0)
    return {k: v / norm for k, v in counts.items() if v}


def plain_model(rows, alpha=0.5, beta=1.0, l1=1e-3, l2=1e-3):
    """The textbook updates, weight by weight."""
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda k: 0.0 if abs(z[k]) <= l1 else -(z[k] - (l1 if z[k] > 0 else -l1)) / ((beta + n[k] ** 0.5) / alpha + l2)
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(qc.PASSES):
        for i in order.permutation(len(rows)):
            x, label = rows[i]
            x = {**x, "bias": 1.0}
            w = {k: weight(k) for k in x}
            error = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items()))) - label
            for k, v in x.items():
                g = error * v
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / alpha * w[k]
                n[k] += g * g
    return lambda x: 1 / (1 + math.exp(-sum(weight(k) * v for k, v in {**x, "bias": 1.0}.items())))


def test_query_equals_a_plain_version(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    score = plain_model([(plain_features(texts[i]), labels[i]) for i in sorted(labels) if i in texts and not out(i)])
    got = op8_quality_classifier(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        want = score(plain_features(texts[r.doc_id]))
        assert r.held_out == out(r.doc_id) and r.score == pytest.approx(want, abs=1e-4)
        assert r.predicted == (r.score >= 0.3)
