"""Packing: documents as token sequences of a fixed size, cut by order-preserving dynamic programming.

The tokens of a partition's documents form one stream in the order of its
rows; a sequence is a window of it. Windows may end at a document's end (free),
at a sentence's end (a small penalty) or, where neither comes for long, at any
token (a larger one). For each possible end the least cost of all before it is
found with a monotone queue: with the costs ``f`` and places ``p``,
``f(i) = size - p(i) + penalty(i) + min(f(j) + p(j))`` over the ends ``j`` at
most ``size`` before ``i``, so padding and penalties are least in sum. A
partition's last, partial window is dealt out as windows whose lengths are
powers of two, which need no padding.

The stream goes through in chunks; what follows a chunk's last chosen end is
carried to the next, so memory is bounded by a chunk and one document.

Defined results: null text counts as empty and is packed as its end token
alone; repeated rows are packed one by one; an empty table gives an empty
result. Columns of the input other than the id are left out.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.columns import frugal

SIZE = 2048
END_ID = 1
CHUNK_TOKENS = 400_000
SENTENCE_PENALTY = 2.0
ANY_PENALTY = 8.0
ANY_STEP = 16
PART_CHARS = 1 << 20
_GAP = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
#: Beyond these characters two libraries may hold different versions of Unicode.
_RARE = re.compile("[^\x00-ɏͰ-ͳΆ-ώЀ-ҁ‐-‧‰-⁞€一-龥]")


class Encoder:
    """Token ids as the tokenizers library gives them for a file.

    A byte-level BPE file whose merges rank as their ids is also loaded into
    tiktoken, which gives the same ids faster; texts with rare characters, and
    whatever it refuses, go to the tokenizers library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_str(json.dumps(spec))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.fast = self._ranked(spec)
        vocab = self.tokenizer.get_vocab()
        self.ends_sentence = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_sentence[[i for w, i in vocab.items() if w.rstrip("\"')”»").endswith((".", "!", "?", "Ċ")) or "Ċ" in w]] = True

    @staticmethod
    def _ranked(spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        import public_tokenizers
        import tiktoken

        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = [model["vocab"]["".join(p)] for p in pairs]
        if ranks != sorted(ranks) or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        table = {bytes(byte[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        parts = []
        for part in _parts(text):
            if self.fast is not None and not _RARE.search(part):
                try:
                    parts.append(self.fast.encode_to_numpy(part, allowed_special="all"))
                    continue
                except Exception:  # noqa: BLE001  its regular expression gives up on some long runs
                    pass
            parts.append(np.array(self.tokenizer.encode_batch_fast([part], add_special_tokens=False)[0].ids, np.uint32))
        return np.concatenate(parts).astype(np.uint32)


def _parts(text: str) -> Iterator[str]:
    """A text in parts that are cut before a single blank between two ASCII letters."""
    a = 0
    while len(text) - a > PART_CHARS and (gap := _GAP.search(text, a + PART_CHARS)):
        yield text[a : gap.start()]
        a = gap.start()
    yield text[a:]


def cut(ends: np.ndarray, penalty: np.ndarray, size: int = SIZE, whole: bool = False) -> list[int]:
    """The chosen ends among ``ends`` (rising, positive), so that padding and penalties of the windows between are least.

    Unless ``whole``, the last end stands less than ``size`` before the last candidate: the one with the least cost a token.
    """
    p, q = ends.tolist(), penalty.tolist()
    n = len(p)
    cost, back = [0.0] * n, [-1] * n
    queue: deque[tuple[float, int, int]] = deque([(0.0, -1, 0)])
    for i in range(n):
        at = p[i]
        while at - queue[0][2] > size:
            queue.popleft()
        least, j, _ = queue[0]
        c = size - at + q[i] + least
        cost[i], back[i] = c, j
        c += at
        while queue and queue[-1][0] >= c:
            queue.pop()
        queue.append((c, i, at))
    i = n - 1
    if not whole:
        last = p[-1]
        tail = [(cost[k] / p[k], k) for k in range(n - 1, -1, -1) if last - p[k] < size]
        i = min(tail)[1]
    out = []
    while i >= 0:
        out.append(p[i])
        i = back[i]
    return out[::-1]


def powers(n: int) -> list[int]:
    """A length as powers of two, the largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Places after which a window may end, and the penalties there."""
    penalty = np.full(len(ids) + 1, np.inf)
    penalty[1:][ends_sentence[ids]] = SENTENCE_PENALTY
    penalty[doc_ends] = 0.0
    places = np.flatnonzero(penalty < np.inf)
    edges = np.concatenate([[0], places, [len(ids)]])
    step = min(ANY_STEP, max(1, size // 2))
    for k in np.flatnonzero(np.diff(edges) > step).tolist():
        between = np.arange(edges[k] + step, edges[k + 1], step)
        penalty[between] = ANY_PENALTY
    penalty[len(ids)] = min(penalty[len(ids)], ANY_PENALTY)
    penalty[0] = np.inf
    places = np.flatnonzero(penalty < np.inf)
    return places, penalty[places]


class Packer:
    """Packs a stream of documents; ``pieces`` of a chunk come out as soon as it is full."""

    def __init__(self, ends_sentence: np.ndarray, first_id: int, size: int = SIZE, chunk: int = CHUNK_TOKENS):
        self.ends_sentence, self.next, self.size, self.chunk = ends_sentence, first_id, size, chunk
        self.docs: list[tuple] = []  # id, tokens in the stream, how many of the document's came before, all of them
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        self.docs.append((doc_id, len(ids), 0, len(ids)))
        self.parts.append(ids)
        self.held += len(ids)
        return self._pack(False) if self.held >= self.chunk else []

    def finish(self) -> list[tuple]:
        return self._pack(True) if self.held else []

    def _pack(self, final: bool) -> list[tuple]:
        ids = np.concatenate(self.parts)
        doc_ends = np.cumsum([d[1] for d in self.docs])
        places, penalty = candidates(ids, doc_ends, self.ends_sentence, self.size)
        chosen = cut(places, penalty, self.size) if len(ids) >= self.size else [0]
        if final:
            for step in powers(len(ids) - chosen[-1]):
                chosen.append(chosen[-1] + step)
        out, d, doc_start, a = [], 0, 0, 0
        for b in chosen:
            if b == 0:
                continue
            at = a
            while at < b:
                doc_id, n, before, every = self.docs[d]
                stop = min(b, doc_start + n)
                out.append((doc_id, before + at - doc_start, ids[at:stop], every, self.next, at - a))
                if stop == doc_start + n:
                    d, doc_start = d + 1, doc_start + n
                at = stop
            self.next += 1
            a = b
        rest = self.docs[d:]
        if rest and a > doc_start:
            doc_id, n, before, every = rest[0]
            rest[0] = (doc_id, n - (a - doc_start), before + a - doc_start, every)
        self.docs, self.parts, self.held = rest, [ids[a:]], len(ids) - a
        return out


SCHEMA = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, text: str = "text", size: int = SIZE, end_id: int = END_ID, chunk: int = CHUNK_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start in its document, ids (little-endian unsigned 32 bit), doc_tokens, sequence_id and offset there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        packer = Packer(encoder.ends_sentence, TaskContext.get().partitionId() << 36, size, chunk)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pieces = packer.add(doc_id, np.concatenate([encoder.ids(body.as_py() or ""), end]))
                if pieces:
                    yield _rows(pieces)
        pieces = packer.finish()
        if pieces:
            yield _rows(pieces)

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(frugal(run), SCHEMA)


def _rows(pieces: list[tuple]) -> pa.RecordBatch:
    doc_id, start, ids, every, sequence, offset = zip(*pieces, strict=True)
    columns = [pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(every, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])
