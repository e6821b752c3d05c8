"""Line dedup: an exact similarity join of lines, of which the later ones of a match are removed.

A line's tokens are its distinct shingles of five words; a line of fewer words
has its whole sequence as its one token. Lines are compared as
in :mod:`quillmask.llm.set_index`: tokens by rarity, prefixes, positions and
sizes; each pair left is verified by its Jaccard similarity. A line goes if an
earlier one has similarity 0.75 or more, whether or not that one stays itself.
Earlier is by doc_id, then by a hash of the text (for rows that share an id
but not the text), then by place in the text.

Equal lines are one set with the place of its first. For the sets it is enough
to find one earlier match: each is verified against the set it shares most
lists with, then against the earliest sets of its groups, and only what is
still unmatched is verified against all earlier candidates.

Defined results: lines are what stands between line feeds; lines without words
always stay and match nothing, as do those of fewer than ``min_words`` words;
null text stays null; rows repeated with one doc_id and text are one document
and get one result; rows that share a doc_id but not the text are documents of
their own; rows without doc_id stay as they are and match nothing; an empty
table gives an empty result. All other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmask.llm.columns import blocks, buffers, frugal, shingle_table
from quillmask.llm.jaccard_join import LINK, best_of, filled, listed, pairs_and_groups, postings_total, rarity_of, tallies, verified
from quillmask.llm.set_index import HOT_SETS, PART_POSTINGS, TokenCounters, bit_names, bit_patterns, block_pairs, candidates, compatible, signatures, within_bits
from quillmask.llm.tables import Scratch, may_hold

MIN_WORDS = 1
#: Longs of a line's bit pattern.
LONGS = 2
#: Rounds in which sets are verified against the earliest set of their groups, before all earlier candidates are.
LINE_ROUNDS = 2


def lines_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of the texts in order, and the row of each."""
    offsets, data = buffers(column)
    feeds = np.flatnonzero(data == 10)
    # a line starts with each row and after each feed
    row = np.concatenate([np.arange(len(column)), np.searchsorted(offsets, feeds, "right") - 1])
    start = np.concatenate([offsets[:-1], feeds + 1])
    order = np.argsort(row * 2 + (np.arange(len(row)) >= len(column)), kind="stable")
    row, start = row[order], start[order]
    last = np.append(row[1:] != row[:-1], True)
    end = np.where(last, offsets[row + 1], np.append(start[1:] - 1, 0))
    flat = data.copy()
    flat[feeds] = 32
    # a line keeps its feed as a blank, which no shingle sees, so the lines' offsets are their starts
    bounds = np.append(start, len(data)).astype(np.int64)
    assert np.all(end <= bounds[1:])
    return pa.Array.from_buffers(pa.large_string(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(flat)]), row


SURVEY_SCHEMA = "kind int, a long, key long, line long, sig long, n long, " + "".join(f"{b} long, " for b in bit_names(LONGS)) + "counts binary"


def survey(docs: DataFrame, min_words: int) -> DataFrame:
    """Rows of kind 0: doc_id (a), key, line, name of its set, size and bit pattern; of kind 2 what the order of tokens needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = TokenCounters()
        names = ["kind", "a", "key", "line", "sig", "n", *bit_names(LONGS), "counts"]
        for batch in batches:
            for part, column in blocks(batch, "text"):
                lines, row = lines_of(column)
                offsets, tokens = shingle_table(lines, least=min_words)
                counters.add(tokens)
                size = np.diff(offsets)
                keep = size > 0
                place = np.arange(len(row)) - np.searchsorted(row, row)
                ids, keys = (part.column(k).to_numpy(zero_copy_only=False)[row[keep]] for k in (0, 1))
                n = int(keep.sum())
                numbers = [ids, keys, place[keep], signatures(offsets, tokens)[keep], size[keep], *(b[keep] for b in bit_patterns(offsets, tokens, LONGS))]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), *(pa.array(v, pa.int64()) for v in numbers), pa.nulls(n, pa.binary())], names)
        yield tallies(counters, names)

    return docs.mapInArrow(frugal(run), SURVEY_SCHEMA)


def texts_of(asked: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(sig, text) of the lines asked for (sig, at: doc_id, key, line). Of each document only these lines go on."""
    wanted = asked.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.key").alias("key")).agg(F.collect_list(F.struct("at.line", "sig")).alias("lines"))
    wanted = scratch.written(wanted, "wanted")
    # a shuffle lies between the two Python steps, so that no task needs two workers
    found = docs.filter(may_hold(wanted, "key", scratch)(F.col("key"))).join(wanted.hint("merge"), ["doc_id", "key"]).select("text", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in blocks(batch, "text"):
                lines, row = lines_of(column)
                lists = part.column(1)
                first = np.searchsorted(row, np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())))
                flat = lists.flatten()
                at = first + flat.field("line").to_numpy()
                yield pa.RecordBatch.from_arrays([flat.field("sig"), lines.take(pa.array(at))], ["sig", "text"])

    return scratch.written(found.mapInArrow(frugal(run), "sig long, text string"), "texts", wide=True)


def matched_lines(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS, hot: int = HOT_SETS, per_part: int = PART_POSTINGS) -> DataFrame:
    """(doc_id, key, line) of every line with an earlier match, in docs (doc_id, key, text) with ids."""
    surveyed = scratch.written(survey(docs, min_words), "lines", wide=True)
    lines = surveyed.filter("kind = 0").select(F.col("a").alias("doc_id"), "key", "line", "sig", "n", *bit_names(LONGS))

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for _, column in blocks(batch, "text"):
                offsets, tokens = shingle_table(lines_of(column)[0], least=min_words)
                offsets = filled(offsets)
                if len(tokens):
                    yield signatures(offsets, tokens), offsets, tokens

    lists = scratch.written(candidates(blocks_of, docs.select("text"), postings_total(lines), rarity_of(surveyed), scratch, hot, per_part), "lists", wide=True)
    in_lists = listed(lists, scratch)
    # sets that have copies or are in lists
    classes = lines.groupBy("sig").agg(F.min(F.struct("doc_id", "key", "line")).alias("at"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), *(F.max(b).alias(b) for b in bit_names(LONGS)))
    classes = scratch.written(classes.withColumn("listed", in_lists(F.col("sig"))).filter("copies > 1 OR listed"), "classes", wide=True)
    known = classes.filter("listed")
    pairs, groups = pairs_and_groups(lists)
    for side, size in (("a", "n"), ("b", "m")):
        pairs = pairs.join(known.select(F.col("sig").alias(side), F.col("at").alias(f"{side}_at"), F.col("n").alias(size), *(F.col(b).alias(f"{side}_{b}") for b in bit_names(LONGS))), side)
    # x is the later one
    pairs = pairs.filter(within_bits(bit_names(LONGS, "a_"), bit_names(LONGS, "b_"), "n", "m"))
    pairs = scratch.written(pairs.select(F.expr("IF(a_at > b_at, a, b)").alias("x"), F.expr("IF(a_at > b_at, b, a)").alias("y"), "lists"), "pairs")
    members = scratch.written(groups.join(known.select(F.col("sig").alias("id"), F.col("at").alias("pos"), *bit_names(LONGS)), "id"), "members")
    asked = pairs.select(F.explode(F.array("x", "y")).alias("sig")).union(members.select("id")).distinct().join(known.select("sig", "at"), "sig")
    lines_asked = texts_of(asked, docs, scratch)
    scratch.release()
    scratch.drop(lists)

    place = known.select(F.col("sig").alias("a"), F.col("at").alias("a_at"))

    def later(found: DataFrame) -> DataFrame:
        """Of linked pairs (a, b) the later set."""
        links = found.filter(LINK).join(place, "a").join(place.toDF("b", "b_at"), "b")
        return links.select(F.expr("IF(a_at > b_at, a, b)").alias("id")).distinct()

    def verify(asked: DataFrame, name: str) -> DataFrame:
        wanted = asked.select(F.explode(F.array("a", "b")).alias("sig"))
        found = scratch.written(verified(asked, lines_asked.filter(may_hold(wanted, "sig", scratch)(F.col("sig")))), name)
        scratch.release()
        return found

    gone, known_pairs = None, None
    left, open_ = members, pairs
    for _ in range(LINE_ROUNDS):
        # the earliest set of each group, of those that are still unmatched, and the sets that share most lists
        heads = left.groupBy("g").agg(F.min(F.struct("pos", "id", "n", *bit_names(LONGS))).alias("y"))
        heads = heads.select("g", F.col("y.pos").alias("y_pos"), F.col("y.id").alias("y"), F.col("y.n").alias("m"), *(F.col(f"y.{b}").alias(f"y_{b}") for b in bit_names(LONGS)))
        met = left.join(heads, "g").filter((F.col("y_pos") < F.col("pos")) & compatible(F.col("n"), F.col("m"))).filter(within_bits(bit_names(LONGS), bit_names(LONGS, "y_"), "n", "m"))
        met = met.groupBy(F.col("id").alias("x"), "y").agg(F.count(F.lit(1)).alias("lists")).union(open_.select("x", "y", "lists"))
        if known_pairs is not None:
            met = met.withColumns({"a": F.greatest("x", "y"), "b": F.least("x", "y")}).join(known_pairs, ["a", "b"], "left_anti")
        asked = scratch.written(best_of(met.select("x", "y", "lists")), "asked")
        found = verify(asked, "round")
        known_pairs = found.select("a", "b") if known_pairs is None else known_pairs.union(found.select("a", "b"))
        new = later(found)
        gone = scratch.written(new if gone is None else gone.union(new).distinct(), "gone")
        # what is still unmatched and has anything before it
        least = left.groupBy("g").agg(F.min("pos").alias("least"))
        left = scratch.written(left.join(least, "g").filter("pos > least").drop("least").join(gone, "id", "left_anti"), "left")
        open_ = scratch.written(open_.join(gone.toDF("x"), "x", "left_anti"), "open")
    # all earlier candidates of what is left: only unmatched sets are tagged with their own name, the others with 0
    tagged = members.join(gone.withColumn("was", F.lit(True)), "id", "left").withColumn("tag", F.when(F.col("was").isNull(), F.col("id")).otherwise(0))
    asked = block_pairs(tagged, LONGS).union(open_.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))).distinct()
    asked = asked.join(known_pairs, ["a", "b"], "left_anti")
    asked = asked.join(place, "a").join(place.toDF("b", "b_at"), "b").withColumn("id", F.expr("IF(a_at > b_at, a, b)")).join(gone, "id", "left_anti").select("a", "b")
    gone = scratch.written(gone.union(later(verify(scratch.written(asked, "asked"), "last"))).distinct(), "gone")
    # lines of sets that have copies or an earlier match
    several = classes.select("sig", "at", "copies").join(gone.select(F.col("id").alias("sig"), F.lit(True).alias("near")), "sig", "left").filter("copies > 1 OR near")
    several = scratch.written(several.select("sig", "at", "near"), "several")
    marked = lines.select("doc_id", "key", "line", "sig").filter(may_hold(several, "sig", scratch)(F.col("sig"))).join(several, "sig")
    return marked.filter(F.col("near").isNotNull() | (F.struct("doc_id", "key", "line") > F.col("at"))).select("doc_id", "key", "line").distinct()


def without_lines(column: pa.Array, gone: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The texts without the lines of these numbers, and how many of each went."""
    offsets, data = buffers(column)
    lines, row = lines_of(column)
    starts, _ = buffers(lines)
    counts = np.diff(gone.offsets.to_numpy())
    stays = np.ones(len(row), bool)
    stays[np.searchsorted(row, np.repeat(np.arange(len(counts)), counts)) + gone.flatten().to_numpy()] = False
    keep = np.repeat(stays, np.diff(starts))
    # the last line that stays loses its feed, unless it ends its text without one
    at = np.flatnonzero(stays)
    last = at[np.append(row[at][1:] != row[at][:-1], True)] if len(at) else at
    cut = last[(last + 1 < len(row)) & (row[np.minimum(last + 1, len(row) - 1)] == row[last])]
    keep[starts[cut + 1] - 1] = False
    sums = np.concatenate([[0], np.cumsum(keep)])
    return pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(sums[offsets]), pa.py_buffer(np.ascontiguousarray(data[keep]))]), counts


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, hot: int = HOT_SETS, per_part: int = PART_POSTINGS, removed_col: str = "lines_removed") -> DataFrame:
    """The documents (doc_id, text and any others) without their matched lines, and how many of them went."""
    docs = docs.drop(*({removed_col} & set(docs.columns)))
    scratch = Scratch(docs.sparkSession)
    identity = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    plain = docs.select(identity[0].alias("doc_id"), identity[1].alias("key"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    matched = matched_lines(plain, scratch, min_words, hot, per_part)
    gone = scratch.written(matched.groupBy(F.col("doc_id").alias("_gone_id"), F.col("key").alias("_gone_key")).agg(F.collect_list("line").alias("_gone_lines")), "removed", wide=True)
    scratch.close(gone)
    # documents that lose nothing pass by; the others are joined with their lines
    loses = may_hold(gone, "_gone_key", scratch)(identity[1]) & identity[0].isNotNull() & F.col("text").isNotNull()
    stay = docs.filter(~loses).withColumn(removed_col, F.lit(0).cast("long"))
    marked = docs.filter(loses).join(gone.hint("merge"), (identity[0] == F.col("_gone_id")) & (identity[1] == F.col("_gone_key")), "left")
    marked = marked.drop("_gone_id", "_gone_key").withColumn("_gone_lines", F.coalesce("_gone_lines", F.array().cast("array<bigint>")))
    schema = T.StructType([*docs.schema.fields, T.StructField(removed_col, T.LongType())])
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in blocks(batch, "text"):
                left, counts = without_lines(column, part.column(len(names)))
                columns = [part.column(i) for i in range(len(names))]
                columns[at] = left
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*names, removed_col])

    return stay.unionByName(marked.mapInArrow(frugal(run), schema))
