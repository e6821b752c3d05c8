"""N-gram Jaccard join: documents whose sets of 5-word shingles are similar, and the components these links form.

Equal sets are one set from the start. Index lists come from
:mod:`quillmask.llm.set_index`, which also skips the blocks of long lists whose
positions leave too little to match. Which pairs are verified follows the
relations between sets:

1. Every set is verified against one set, the one it shares most lists with.
   A set that is linked knows its nearest such set (its centre) and the
   distance to it. Sets already in one component need no link between them,
   so in further rounds only sets of different components meet.
2. For two sets that are no centres, the answer often follows from what is
   computed: Jaccard distance is a metric, so the distance of two sets is at
   least that of their centres less their own distances to these. Only pairs
   that this leaves open are verified.

So the number of verified pairs follows the number of sets, not the square of
a group's size, and yet every link between two components is found.

Texts are only shuffled for sets that have a candidate, dealt by the set they
are verified against; one that many ask for is dealt over several tasks.

Defined results: a text without words (or null) has no shingles, is linked
with nothing and is its own component; fewer than five words count as one
shingle; equal texts are linked; repeated rows get one row each; rows without
doc_id have a null component and link nothing. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.llm.columns import blocks, frugal, shingle_table
from quillmask.llm.set_index import DEN, HOT_SETS, LEAST_SIZE, NUM, PART_POSTINGS, THRESHOLD, Rarity, TokenCounters, bit_names, bit_patterns, block_pairs, candidates, compatible, signatures, summed, within_bits
from quillmask.llm.tables import Scratch, components, may_hold

#: Sets that one task verifies against one set.
CENTRE_SETS = 2048
#: Longs of a document's bit pattern.
LONGS = 8
#: Rounds in which sets look for a link to one set of another component, before all pairs left are looked at: to one that
#: stands for a group, then to the one whose bit pattern is nearest.
ROUNDS = 2
NEAREST_ROUNDS = 2

SetsOf = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def filled(offsets: np.ndarray) -> np.ndarray:
    """The offsets of the rows that have any token."""
    return np.concatenate([offsets[:-1][np.diff(offsets) > 0], offsets[-1:]])


SURVEY_SCHEMA = "kind int, a long, sig long, n long, " + "".join(f"{b} long, " for b in bit_names(LONGS)) + "counts binary"


def survey(docs: DataFrame, sets_of: SetsOf = shingle_table) -> DataFrame:
    """Rows of kind 0: doc_id (a), name of its set (sig), its size (n) and bit pattern; of kind 2 what :func:`rarity_of` needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = TokenCounters()
        names = ["kind", "a", "sig", "n", *bit_names(LONGS), "counts"]
        for batch in batches:
            for part, column in blocks(batch, "text"):
                offsets, tokens = sets_of(column)
                counters.add(tokens)
                n = len(part)
                bits = [pa.array(b) for b in bit_patterns(offsets, tokens, LONGS)]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), part.column(0), pa.array(signatures(offsets, tokens)), pa.array(np.diff(offsets)), *bits, pa.nulls(n, pa.binary())], names)
        yield tallies(counters, names)

    return docs.mapInArrow(frugal(run), SURVEY_SCHEMA)


def tallies(counters: TokenCounters, names: list[str]) -> pa.RecordBatch:
    """Rows of kind 2: a chunk (a) of counters; all other columns are 0."""
    chunks = counters.chunks()
    n = len(chunks)
    first = [pa.array(np.full(n, 2, np.int32)), pa.array(np.arange(n))]
    return pa.RecordBatch.from_arrays([*first, *([pa.array(np.zeros(n, np.int64))] * (len(names) - 3)), pa.array(chunks, pa.binary())], names)


def rarity_of(surveyed: DataFrame) -> Rarity:
    """The order of tokens from a survey."""
    return Rarity(summed(surveyed.filter("kind = 2").select(F.col("a").cast("int").alias("chunk"), "counts")))


def postings_total(sets: DataFrame) -> int:
    """The number of postings that sets of sizes n may send."""
    return int(sets.filter(f"n >= {LEAST_SIZE}").agg(F.sum(F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1)).first()[0] or 0)


def listed(lists: DataFrame, scratch: Scratch) -> Callable[[Column], Column]:
    """A test for the names of sets in lists."""
    ids = lists.select(F.explode(F.when(F.col("kind") == 0, F.array("a", "b")).otherwise(F.array("b"))).alias("id")).distinct()
    return may_hold(scratch.written(ids, "ids"), "id", scratch)


def pairs_and_groups(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, lists) and groups (g, id, n, at) of lists."""
    pairs = lists.filter("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("lists"))
    groups = lists.filter("kind = 1").groupBy(F.col("a").alias("g"), F.col("b").alias("id"), "n").agg(F.min("m").alias("at"))
    return pairs, groups


def blocks_of(sets_of: SetsOf) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for _, column in blocks(batch, "text"):
                offsets, tokens = sets_of(column)
                offsets = filled(offsets)
                if len(tokens):
                    yield signatures(offsets, tokens), offsets, tokens

    return run


VERIFIED_SCHEMA = "a long, b long, n long, m long, both long"


def verified(pairs: DataFrame, texts: DataFrame, sets_of: SetsOf = shingle_table, centre_sets: int = CENTRE_SETS) -> DataFrame:
    """For pairs (a, b) of names of sets: their sizes n and m and how many tokens they share (both).

    ``texts`` has a text for each name ``sig``; a text that is not of that set is passed over.
    """
    counts = pairs.groupBy("b").agg(F.ceil(F.count("*") / centre_sets).cast("int").alias("salts"))
    members = pairs.join(counts, "b").select(F.col("a").alias("sig"), "b", F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt"), F.lit(1).alias("role"))
    centres = counts.select(F.col("b").alias("sig"), "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    # by a shuffle at every size
    asked = members.unionByName(centres).join(texts.hint("merge"), "sig").select("b", "salt", "role", "sig", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, centre = None, np.zeros(0, np.uint64)
        for batch in batches:
            for part, column in blocks(batch, "text"):
                offsets, every = sets_of(column)
                names, cuts, out = signatures(offsets, every).tolist(), offsets.tolist(), []
                for i, (own, asked_name, b, role) in enumerate(zip(names, part.column(3).to_pylist(), part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    tokens = every[cuts[i] : cuts[i + 1]]
                    if own != asked_name:
                        continue  # a row that only shares its id with the one asked for
                    if role == 0:
                        name, centre = b, tokens
                    elif name == b:
                        at = np.minimum(np.searchsorted(centre, tokens), len(centre) - 1)
                        out.append((own, b, len(tokens), len(centre), int(np.count_nonzero(centre[at] == tokens))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], ["a", "b", "n", "m", "both"])

    dealt = asked.repartition("b", "salt").sortWithinPartitions("b", "salt", "role")
    return dealt.mapInArrow(frugal(run), VERIFIED_SCHEMA)


#: Whether the Jaccard similarity of a verified pair reaches the threshold, and its Jaccard distance.
LINK = f"{DEN} * both >= {NUM} * (n + m - both)"
DISTANCE = "1 - both / (n + m - both)"


def best_of(found: DataFrame) -> DataFrame:
    """Of rows (x, y, lists) the y with most lists for each x, as pairs (a, b); the same pair from both sides is one."""
    best = found.groupBy("x").agg(F.max(F.struct("lists", "y")).alias("best"))
    return best.select(F.greatest("x", "best.y").alias("a"), F.least("x", "best.y").alias("b")).distinct()


def informed(rows: DataFrame, roots: DataFrame | None, column: str, root: str) -> DataFrame:
    """The rows with the root of the component of a set; one that is not linked is its own."""
    if roots is None:
        return rows.withColumn(root, F.col(column))
    return rows.join(roots.select(F.col("node").alias(column), F.col("root").alias(root)), column, "left").withColumn(root, F.coalesce(root, column))


def similarity_components(pairs: DataFrame, groups: DataFrame, texts: DataFrame, scratch: Scratch, longs: int = LONGS) -> DataFrame:
    """(node, root) of every set that is linked to another, from candidate pairs (a, b, lists), groups (g, id, n, at, b0 ...) and texts (sig, text)."""
    done, roots, members = None, None, groups

    def verify(asked: DataFrame, name: str) -> DataFrame:
        wanted = asked.select(F.explode(F.array("a", "b")).alias("sig"))
        found = scratch.written(verified(asked, texts.filter(may_hold(wanted, "sig", scratch)(F.col("sig")))), name)
        scratch.release()
        return found

    def apart(rows: DataFrame, a: str, b: str) -> DataFrame:
        """The rows whose sets are in different components."""
        return informed(informed(rows, roots, a, "a_root"), roots, b, "b_root").filter("a_root <> b_root").drop("a_root", "b_root")

    def mixed(rows: DataFrame) -> DataFrame:
        """The groups that hold sets of several components, with the root of each set."""
        rows = informed(rows.select("g", "id", "n", "at", *bit_names(longs)), roots, "id", "root")
        several = rows.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("g")
        return scratch.written(rows.join(several, "g", "left_semi"), "mixed")

    def by_stands(members: DataFrame, k: int) -> DataFrame:
        """For the sets of each group one of them that stands for it, by chance mostly of the largest component there; and all pairs of short lists."""
        open_ = apart(pairs, "a", "b")
        stands = members.groupBy("g").agg(F.max(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id", "root", "n", *bit_names(longs))).alias("s"))
        stands = stands.select("g", F.col("s.id").alias("y"), F.col("s.root").alias("y_root"), F.col("s.n").alias("m"), *(F.col(f"s.{b}").alias(f"y_{b}") for b in bit_names(longs)))
        met = members.join(stands, "g").filter((F.col("root") != F.col("y_root")) & compatible(F.col("n"), F.col("m"))).filter(within_bits(bit_names(longs), bit_names(longs, "y_"), "n", "m"))
        met = met.groupBy(F.col("id").alias("x"), "y").agg(F.count("*").alias("lists"))
        return met.union(open_.select(F.col("a").alias("x"), F.col("b").alias("y"), "lists")).union(open_.select(F.col("b").alias("x"), F.col("a").alias("y"), "lists"))

    for nearest, rounds in ((False, ROUNDS), (True, NEAREST_ROUNDS)):
        for k in range(rounds):
            members = mixed(members)
            met = block_pairs(members.withColumn("tag", F.col("root")), longs, nearest=True) if nearest else by_stands(members, k)
            if done is not None:
                met = met.join(both_ways(done).toDF("x", "y"), ["x", "y"], "left_anti")
            asked = scratch.written(best_of(met), "asked")
            tried = asked.count()
            if not tried:
                break
            found = verify(asked, "round")
            done = found if done is None else done.unionByName(found)
            hits = found.filter(LINK).count()
            if hits:
                roots = components(done.filter(LINK), scratch)
            if hits * 10 <= tried:
                break
    if done is None:  # no two sets can be similar
        return scratch.written(pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0), "roots")
    # all pairs left of different components
    members = mixed(members)
    met = block_pairs(members.withColumn("tag", F.col("root")), longs).union(apart(pairs, "a", "b").select("a", "b")).distinct()
    open_ = scratch.written(met.join(both_ways(done), ["a", "b"], "left_anti"), "open")
    # first the centres, whose answers stand for those of the sets near them
    near = both_ways(done.filter(LINK), DISTANCE).groupBy("a").agg(F.min(F.struct("d", "b")).alias("c")).select(F.col("a").alias("id"), F.col("c.b").alias("centre"), F.col("c.d").alias("d"))
    near = scratch.written(near, "near")
    for side in "ab":
        open_ = open_.join(near.toDF(side, f"{side}_centre", f"{side}_d"), side, "left").withColumns({f"{side}_centre": F.coalesce(f"{side}_centre", side), f"{side}_d": F.coalesce(f"{side}_d", F.lit(0.0))})
    open_ = scratch.written(open_.withColumns({"p": F.greatest("a_centre", "b_centre"), "q": F.least("a_centre", "b_centre")}), "placed")
    asked = open_.select(F.col("p").alias("a"), F.col("q").alias("b")).filter("a <> b").distinct().join(both_ways(done), ["a", "b"], "left_anti")
    done = done.unionByName(verify(scratch.written(asked, "asked"), "centres"))
    known = both_ways(done, DISTANCE).groupBy("a", "b").agg(F.max("d").alias("d"))
    left = open_.join(known.toDF("p", "q", "apart"), ["p", "q"], "left")
    limit = float(1 - THRESHOLD) + 1e-9
    left = left.filter(F.coalesce("apart", F.lit(0.0)) - F.col("a_d") - F.col("b_d") <= limit).select("a", "b").distinct()
    left = scratch.written(left.join(known.select("a", "b"), ["a", "b"], "left_anti"), "left")
    done = done.unionByName(verify(left, "last"))
    return components(done.filter(LINK), scratch)


def both_ways(done: DataFrame, value: str | None = None) -> DataFrame:
    """Pairs (a, b) in both directions; with ``value``, that expression as d."""
    more = [F.expr(value).alias("d")] if value else []
    return done.select("a", "b", *more).union(done.select(F.col("b").alias("a"), F.col("a").alias("b"), *more))


def jaccard_components(docs: DataFrame, hot: int = HOT_SETS, per_part: int = PART_POSTINGS) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, n_shingles, component_id."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    surveyed = scratch.written(survey(docs), "survey", wide=True)
    sets = surveyed.filter("kind = 0").select(F.col("a").alias("doc_id"), "sig", "n", *bit_names(LONGS))
    named = docs.filter("doc_id IS NOT NULL")
    lists = scratch.written(candidates(blocks_of(shingle_table), named, postings_total(sets), rarity_of(surveyed), scratch, hot, per_part), "lists", wide=True)
    in_lists = listed(lists, scratch)
    # of the sets in lists: their size, bit pattern and least document
    known = sets.filter("doc_id IS NOT NULL AND n > 0").filter(in_lists(F.col("sig"))).groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), *(F.max(b).alias(b) for b in bit_names(LONGS)))
    known = scratch.written(known, "known", wide=True)
    pairs, groups = pairs_and_groups(lists)
    for side, size in (("a", "n"), ("b", "m")):
        pairs = pairs.join(known.select(F.col("sig").alias(side), F.col("n").alias(size), *(F.col(b).alias(f"{side}_{b}") for b in bit_names(LONGS))), side)
    pairs = scratch.written(pairs.filter(within_bits(bit_names(LONGS, "a_"), bit_names(LONGS, "b_"), "n", "m")).select("a", "b", "lists"), "pairs")
    groups = scratch.written(groups.join(known.select(F.col("sig").alias("id"), *bit_names(LONGS)), "id"), "groups")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sig")).union(groups.select("id")).distinct()
    asked = scratch.written(asked.join(known.select("sig", "doc_id"), "sig"), "wanted")
    texts = scratch.written(asked.hint("merge").join(named.filter(may_hold(asked, "doc_id", scratch)(F.col("doc_id"))), "doc_id").select("sig", "text"), "texts", wide=True)
    scratch.release()
    scratch.drop(lists, known, asked)
    roots = similarity_components(pairs, groups, texts, scratch)
    # the least document of each set that is linked or has copies
    classes = sets.filter("doc_id IS NOT NULL AND n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    placed = classes.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    placed = scratch.written(placed, "classes", wide=True)
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = placed.select("sig", "root").join(least, "root").select("sig", "component_id")
    found = sets.select("doc_id", "sig", "n").join(of_class, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return scratch.close(scratch.written(found.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))), "components", wide=True))
