"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases.

A text is cut into sections (each ends with a blank line), these into
paragraphs (each ends with a line feed), and these into phrases: a phrase ends
where the hash of a word says so, so an edit moves no border but its own. The
parts of a level join up to the whole text. A phrase's digest is a 64-bit hash
of its bytes, a paragraph's is the SHA-256 of its bytes, a section's that of
its paragraphs' digests, and the root that of its sections' digests: equal
texts have equal roots, and comparing two trees from the root down finds the
branches that differ.

The fingerprint as text holds all levels: ``root:``, then for each section the
first 12 hexadecimal digits of its digest, ``=``, its paragraphs and ``/``; a
paragraph is 12 digits, ``-``, 8 digits a phrase and ``.``. Two fingerprints
are compared from the top: equal roots end it, sections that both have are
common as a whole, then paragraphs of what is left, then phrases of what is
still left, each counted with repetition. Likeness is 2 * common phrases /
(all phrases of both); :func:`differing` names the branches without an equal.

Defined results: null text counts as empty; two empty texts are alike (1.0),
an empty and another are not (0.0). Documents of one id follow by their text;
a single document is its own successor; rows without id come first, by a hash
of their text. An empty table gives an empty result. Other columns of the
input are left out.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.columns import SEGMENT, U64, frugal, hash_spans, segments, spans
from quillmask.llm.tables import Scratch

#: A word ends a phrase if its hash is a multiple of this.
PHRASE_WORDS = 6
ROWS_PER_GROUP = 1500
#: Groups of documents with ids at most; beyond, they have more rows.
MOST_GROUPS = 1 << 16
#: Upper bits of a text's hash that group the documents without id.
HASH_BITS = 10


def _phrases(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the phrases of one text, and their 64-bit hashes."""
    ends, hashes, whole = [], [], np.array([0, len(data)])
    for a, b in segments(whole, data):  # the cuts of a long text depend on its own bytes before them
        part = data[a:b]
        start, end = spans(whole, data, a, b)
        stop = hash_spans(part, start, end, lower=False) % U64(PHRASE_WORDS) == 0
        following = np.append(start[1:], b - a)[: len(start)]
        # a phrase ends before the next word, or after a line feed
        cut = np.unique(np.concatenate([following[stop], np.flatnonzero(part == 10) + 1, [b - a]]))
        feeds = np.concatenate([[0], np.cumsum(part == 10)])
        cut = cut[~np.isin(cut, following[stop & (feeds[following] > feeds[end])]) | (part[cut - 1] == 10) | (cut == b - a)]
        begin = np.concatenate([[0], cut[:-1]])
        hashes.append(hash_spans(part, begin, cut, lower=False))
        ends.append(cut + a)
    return (np.concatenate(ends), np.concatenate(hashes)) if ends else (np.zeros(0, np.int64), np.zeros(0, U64))


class Tree:
    """The Merkle tree of one text."""

    def __init__(self, text: str):
        raw = text.encode()
        self.size = len(raw)
        self.phrase_ends, self.phrases = _phrases(np.frombuffer(raw, np.uint8))
        self._grow(raw)

    def _grow(self, raw: bytes) -> None:
        paragraphs = [i + 1 for i in np.flatnonzero(np.frombuffer(raw, np.uint8) == 10).tolist()]
        if raw and (not paragraphs or paragraphs[-1] < len(raw)):
            paragraphs.append(len(raw))
        self.paragraph_ends, self.paragraphs = paragraphs, []
        self.section_ends, self.sections, a = [], [], 0
        section = hashlib.sha256()
        for b in paragraphs:
            digest = hashlib.sha256(raw[a:b]).digest()
            self.paragraphs.append(digest)
            section.update(digest)
            if b == len(raw) or not raw[a:b].strip():
                self.section_ends.append(b)
                self.sections.append(section.digest())
                section = hashlib.sha256()
            a = b
        self.root = hashlib.sha256(b"".join(self.sections)).hexdigest()

    def text(self) -> str:
        digits = (self.phrases >> U64(32)).astype(">u4").tobytes().hex()
        at = [0, *(8 * np.searchsorted(self.phrase_ends, self.paragraph_ends, "right")).tolist()]
        out, k = [self.root, ":"], 0
        for section, end in zip(self.sections, self.section_ends, strict=True):
            out += [section.hex()[:SHORT], "="]
            while k < len(self.paragraph_ends) and self.paragraph_ends[k] <= end:
                out += [self.paragraphs[k].hex()[:SHORT], "-", digits[at[k] : at[k + 1]], "."]
                k += 1
            out.append("/")
        return "".join(out)

    def ranges(self, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The byte ranges of paragraphs given by section and place in it."""
        before = [0, *np.searchsorted(self.paragraph_ends, self.section_ends, "right").tolist()]
        ends = [0, *self.paragraph_ends]
        return [(ends[before[i] + k], ends[before[i] + k + 1]) for i, k in places]


#: Hexadecimal digits of a section's or a paragraph's digest in a fingerprint.
SHORT = 12


def fingerprint(text: str | None) -> str:
    return Tree(text or "").text()


def _sections(fingerprint: str) -> list[str]:
    return fingerprint[65:].split("/")[:-1]


def _paragraphs(sections: Iterable[str]) -> list[str]:
    return [p for s in sections for p in s[SHORT + 1 :].split(".")[:-1]]


def _without(parts: list[str], common: Counter) -> list[str]:
    """The parts that are left when ``common`` is taken out."""
    spare, out = common.copy(), []
    for p in parts:
        if spare[p] > 0:
            spare[p] -= 1
        else:
            out.append(p)
    return out


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, from 0 to 1: their trees are compared from the root down."""
    if a[:64] == b[:64]:
        return 1.0
    x, y = _sections(a), _sections(b)
    phrases = lambda parts: sum(len(p) - SHORT - 1 for p in parts) // 8
    total = phrases(_paragraphs(x)) + phrases(_paragraphs(y))
    both = Counter(x) & Counter(y)
    common = phrases(_paragraphs(both.elements()))
    x, y = (_paragraphs(_without(v, both)) for v in (x, y))
    both = Counter(x) & Counter(y)
    common += phrases(both.elements())
    x, y = (Counter(p[i : i + 8] for p in _without(v, both) for i in range(SHORT + 1, len(p), 8)) for v in (x, y))
    return 2.0 * (common + (x & y).total()) / max(total, 1)


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """The paragraphs of fingerprint ``a``, by section and place in it, without an equal in ``b``; equal branches are not entered."""
    if a[:64] == b[:64]:
        return []
    theirs = _sections(b)
    sections, paragraphs = Counter(theirs), Counter(p[:SHORT] for p in _paragraphs(theirs))
    mine, out = _sections(a), []
    for s in (Counter(mine) & sections).elements():
        paragraphs.subtract(p[:SHORT] for p in _paragraphs([s]))
    for i, s in enumerate(mine):
        if sections[s] > 0:
            sections[s] -= 1
            continue
        for k, p in enumerate(_paragraphs([s])):
            paragraphs[p[:SHORT]] -= 1
            if paragraphs[p[:SHORT]] < 0:
                out.append((i, k))
    return out


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the start of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def id_groups(docs: DataFrame, scratch: Scratch, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """The documents with ``ord`` (the id, or a hash of the text where there is none) and ``grp``.

    ``grp`` never falls from one document to the next, and has about
    ``rows_per_group`` rows: quantiles of the ids cut it, at most MOST_GROUPS
    of them whatever the input. Rows without id are cut by their hash.
    """
    n = docs.count()
    wanted = min(MOST_GROUPS, max(1, n // rows_per_group))
    found = docs.approxQuantile("doc_id", [i / wanted for i in range(1, wanted)], 0.25 / wanted) if wanted > 1 else []
    cuts = scratch.broadcast(np.array(sorted({int(x) for x in found}), np.int64))

    @F.pandas_udf("long")
    def group(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts.value, ids.to_numpy(np.int64), "right"))

    docs = docs.withColumn("ord", F.coalesce("doc_id", F.xxhash64("text")))
    return docs.withColumn("grp", F.when(F.col("doc_id").isNull(), F.shiftright("ord", 64 - HASH_BITS) - (1 << HASH_BITS)).otherwise(group("ord")))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """For every document (doc_id, text) its fingerprint, that of its edited text, and their likeness and that to the next document.

    Groups of consecutive ids are dealt out once; the first document of a
    group also goes to the group before, so each knows its successor.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scratch = Scratch(docs.sparkSession)
    grouped = id_groups(rows, scratch, rows_per_group)
    # a row per group: at most MOST_GROUPS and 2 ** HASH_BITS, so bounded
    firsts = sorted((r["grp"], r["first"]) for r in grouped.groupBy("grp").agg(F.min("ord").alias("first")).collect())
    order = [g for g, _ in firsts]
    heads = {g: order[i - 1] for i, g in enumerate(order)}
    table = docs.sparkSession.createDataFrame([(g, first, heads[g]) for g, first in firsts], "grp long, ord long, before long")
    copies = grouped.join(F.broadcast(table), ["grp", "ord"]).select("doc_id", "text", F.col("before").alias("grp"), F.lit(1).alias("after"), "ord")
    dealt = grouped.select("doc_id", "text", "grp", F.lit(0).alias("after"), "ord").unionByName(copies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: tuple | None = None  # group, id, text, fingerprint, whether it is a copy
        size = 0
        for batch in batches:
            ids, groups, after = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for doc_id, text, group, copy in zip(ids, batch.column(1).to_pylist(), groups, after, strict=True):
                now = (group, doc_id, text, None, copy)
                if held and not held[4] and held[0] == group:
                    held, now = _finish(held, now, out)
                    size += len(held[2])
                elif held and held[4] and held[0] == group:
                    continue  # only the first of the copies follows
                held = now
                if size > SEGMENT:
                    yield _rows(out)
                    out, size = [], 0
        if out:
            yield _rows(out)

    spread = dealt.repartition("grp").sortWithinPartitions("grp", "after", "ord", "text")
    return spread.mapInArrow(frugal(run), SCHEMA)


def _finish(held: tuple, now: tuple, out: list[tuple]) -> tuple[tuple, tuple]:
    mine = held[3] or fingerprint(held[2])
    theirs = fingerprint(now[2])
    changed = edited(held[2], now[2])
    other = fingerprint(changed)
    out.append((held[1], len(held[2]), hashlib.sha256(changed.encode()).hexdigest(), mine, other, likeness(mine, other), likeness(mine, theirs)))
    return held, (*now[:3], theirs, now[4])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
