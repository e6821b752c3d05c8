"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text is cut into runs of letters or digits and runs of signs. Its features
are the hashes, modulo the number of weights, of single runs (A-Z
lower-cased), of pairs of neighbours, and of a few marks: a run equal to the
one 1, 2 or 4 places before, and a run in capitals. Counts are scaled to
length 1. The score is the logistic function of a sparse dot product.

Training takes a bounded sample of the labelled documents (``rows`` of them,
by a hash of the id; their texts are taken whole). Executors
turn these into features; the driver, which gets no more than that, runs the
updates. Scoring reads every text as a whole.

Defined results: null text counts as empty and gets the score of the bias; an
empty table of labels gives weights of 0 and the score 0.5 everywhere; of
several labels of one id the greatest counts; repeated rows are scored one by
one. Columns of the input are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmask.llm.columns import STEP_KEYS, U64, blocks, buffers, frugal, hash_spans, mix, segments, spans
from quillmask.llm.tables import trim_driver

BITS = 18
TRAIN_ROWS = 6000
PASSES = 4
#: Classes of bytes: letters, digits and all beyond ASCII; signs; 0 for white space and controls.
KINDS = np.zeros(256, np.uint8)
KINDS[33:127] = 2
KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_IS_CAPITAL = np.zeros(256, bool)
_IS_CAPITAL[65:91] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and values of each row's features."""
    offsets, data = buffers(column)
    hashes, caps, rows = [], [], []
    for a, b in segments(offsets, data):
        part = data[a:b]
        starts, ends = spans(offsets, data, a, b, KINDS)
        hashes.append(hash_spans(part, starts, ends, lower=True))
        caps.append(_IS_CAPITAL[part[starts]] & _IS_CAPITAL[part[ends - 1]] & (ends - starts > 1))
        rows.append(np.searchsorted(offsets, starts + a, "right") - 1)
    h, c, r = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, U64), (caps, bool), (rows, np.int64)))
    first = np.searchsorted(r, np.arange(len(column) + 1))
    low = U64((1 << BITS) - 1)
    pair = mix(h[:-1] * STEP_KEYS[11] + h[1:] * STEP_KEYS[12]) if len(h) else h
    marks = (mix(STEP_KEYS[20:28]) & low).astype(np.int64)
    for i in range(len(column)):
        a, b = first[i], first[i + 1]
        x = h[a:b]
        n = [int(np.count_nonzero(x[k:] == x[:-k])) for k in (1, 2, 4)] + [int(np.count_nonzero(c[a:b]))]
        at = (np.concatenate([x, pair[a : max(a, b - 1)]]) & low).astype(np.int64)
        at, count = np.unique(np.concatenate([at, np.repeat(marks[:4], n)]), return_counts=True)
        value = count.astype(np.float32)
        yield at, value / max(np.sqrt(np.sum(value * value, dtype=np.float64)), 1.0).astype(np.float32) if len(value) else value


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int = PASSES, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> Model:
    """Follow-the-regularised-leader with a learning rate for each weight; the last weight is the bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weight(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            at, value, label = rows[i]
            at, value = np.append(at, size - 1), np.append(value, 1.0)
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w
            n[at] += g * g
    every = weight(np.arange(size))
    return Model(every[:-1].astype(np.float32), float(every[-1]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """A model from at most ``rows`` labelled documents (doc_id, text; doc_id, ``label``), none of them held out."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    chosen = known.select("doc_id", F.col(label).cast("int").alias("label")).orderBy(order, "doc_id", "label").limit(rows).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in blocks(batch, "text"):
                found = [(at.astype(np.int32).tobytes(), value.astype(np.float32).tobytes()) for at, value in features(column)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([a for a, _ in found], pa.binary()), pa.array([v for _, v in found], pa.binary())], ["doc_id", "label", "at", "value"])

    got = texts.mapInArrow(frugal(run), "doc_id long, label int, at binary, value binary").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    model = train_ftrl([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32), r["label"]) for r in got])
    del got
    trim_driver(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """The input with the probability of label 1 in column ``into``."""
    docs = docs.drop(*({into} & set(docs.columns)))
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in blocks(batch, text):
                sums = np.array([weights[at] @ value for at, value in features(column)], np.float64) + bias
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))))], [*part.schema.names, into])

    return docs.mapInArrow(frugal(run), T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))
