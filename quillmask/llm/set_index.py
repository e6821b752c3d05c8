"""Candidates for exact set-similarity joins: prefixes by rarity, dealt out as blocks of postings and read list by list.

A set's tokens are ordered by rarity: by how many tokens fall into the same of
a fixed number of counters, then by hash. All tokens of all sets are counted.
Two sets of ``n`` and ``m`` tokens with Jaccard similarity ``t`` or more share
one of the first ``n - ceil(t n) + 1`` tokens of the one and of the other. A
posting is (token, set, size, position). Mappers sort postings by part and
send each part as one block of bytes, so a shuffle moves arrays, not rows.
Sets that can only be similar to an equal set send none, and a task sends a
set that it has just sent only once.

Of a list of up to SHORT sets, all pairs that sizes and positions allow are
candidates. Longer lists are kept as groups: :func:`block_pairs` cuts them into
blocks of similar size and skips, by the blocks' bounds, the pairs of blocks
whose positions leave too little to match. Lists of tokens beyond ``hot`` sets
are salted over several parts, and their group is kept under one name.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.llm.columns import U64, by_row, frugal, mix
from quillmask.llm.tables import Scratch

THRESHOLD = Fraction(3, 4)
NUM, DEN = THRESHOLD.numerator, THRESHOLD.denominator
#: Sets smaller than this are only similar to equal sets.
LEAST_SIZE = -(-NUM // (DEN - NUM))
#: Counters of tokens; each is sent in chunks.
COUNTERS = 1 << 21
CHUNKS = 128
#: Sets in one salted part of a token's list.
HOT_SETS = 100_000
PART_POSTINGS = 400_000
#: Lists of up to this many sets give all their pairs; longer ones are groups.
SHORT = 16
#: Sets in a block of a group.
BLOCK_SETS = 512
#: A posting: the upper 40 bits of a token, the set, its size and the token's position.
POSTING = np.dtype([("token", "<u8"), ("id", "<i8"), ("size", "<i4"), ("at", "<i4")])
WIDTHS = {"token": 5, "id": 8, "size": 4, "at": 4}
TOKEN_SHIFT = U64(24)


def prefix(sizes: np.ndarray, t: Fraction = THRESHOLD) -> np.ndarray:
    """Tokens of a set that must be looked at: n - ceil(t n) + 1."""
    return sizes - -(-sizes * t.numerator // t.denominator) + 1


def overlap_needed(n: np.ndarray, m: np.ndarray, t: Fraction = THRESHOLD) -> np.ndarray:
    """The least intersection of sets of n and m tokens that are similar: ceil(t (n + m) / (1 + t))."""
    return -(-(n + m) * t.numerator // (t.denominator + t.numerator))


def signatures(offsets: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """A signed 64-bit name of each set of tokens; equal sets have equal names."""
    sums = np.zeros(len(tokens) + 1, U64)
    np.cumsum(mix(tokens ^ U64(0xA0761D6478BD642F)), out=sums[1:])
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(U64)).view(np.int64)


def bit_patterns(offsets: np.ndarray, tokens: np.ndarray, longs: int) -> list[np.ndarray]:
    """For each set that many longs: bit i of all is whether an odd number of its tokens hash to i.

    Where two patterns differ, the sets differ in at least one token of that
    hash, so the number of differing bits is at most the number of tokens that
    only one of the sets has.
    """
    n, full = len(offsets) - 1, np.flatnonzero(np.diff(offsets))
    hashes = mix(tokens + U64(7))
    bits, lane = U64(1) << (hashes & U64(63)), (hashes >> U64(6)) % U64(longs)
    out = []
    for k in range(longs):
        row = np.zeros(n, np.int64)
        if len(full):
            row[full] = np.bitwise_xor.reduceat(np.where(lane == U64(k), bits, U64(0)), offsets[full]).view(np.int64)
        out.append(row)
    return out


def bit_names(longs: int, prefix: str = "") -> list[str]:
    return [f"{prefix}b{k}" for k in range(longs)]


class Rarity:
    """Orders tokens by the counters they fall into; of fixed size."""

    def __init__(self, counters: np.ndarray):
        # 16 bits that grow with the counts: their exponents and first digits
        self.counters = (counters.astype(np.float32).view(np.uint32) >> 16).astype(np.uint16)
        # what rare tokens add to a counter by chance
        self.noise = float(np.median(counters))
        self.shift = U64(64 - (len(counters).bit_length() - 1))

    def of(self, tokens: np.ndarray) -> np.ndarray:
        return self.counters[(tokens >> self.shift).astype(np.int64)]

    def sets(self, tokens: np.ndarray) -> np.ndarray:
        """In about how many sets, at most, a token is: its counter less the noise. Depends on a token's upper bits only."""
        return (self.of(tokens).astype(np.uint32) << 16).view(np.float32) - self.noise


class TokenCounters:
    """Counts all tokens that pass into a fixed number of counters."""

    def __init__(self, n: int = COUNTERS):
        self.total, self.held, self.size = np.zeros(n, np.uint32), [], 0
        self.shift = U64(64 - (n.bit_length() - 1))

    def add(self, tokens: np.ndarray) -> None:
        self.held.append((tokens >> self.shift).astype(np.uint32))
        self.size += len(tokens)
        if self.size > 2 * len(self.total):
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.total += np.bincount(np.concatenate(self.held), minlength=len(self.total)).astype(np.uint32)
        self.held, self.size = [], 0

    def chunks(self) -> list[bytes]:
        self._flush()
        return [_squeezed(c) for c in np.split(self.total, CHUNKS)] if self.total.any() else []


def _squeezed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as they need, the first byte says how many, compressed."""
    most = int(counts.max())
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + zlib.compress(counts.astype(f"<u{width}").tobytes(), 1)


def _counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{data[0]}").astype(np.uint64)


def summed(chunks: DataFrame, n: int = COUNTERS) -> np.ndarray:
    """The sum of (chunk, counts) rows, as one array of ``n`` counters: added up on the executors, chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = _counts(data)
                sums[k] = sums[k] + part if k in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["chunk", "counts"])

    out = np.zeros(n, np.uint32)
    for row in chunks.repartition("chunk").mapInArrow(frugal(run), "chunk int, counts binary").collect():
        out.reshape(CHUNKS, -1)[row["chunk"]] += np.minimum(np.frombuffer(row["counts"], np.uint64), 0x7FFFFFFF).astype(np.uint32)
    return out


class Sent:
    """The sets that a task has sent of late; of fixed size, and never wrong: a set is only dropped where its name is there."""

    def __init__(self, slots: int = 1 << 17):
        self.names = np.zeros(slots, np.int64)

    def new(self, names: np.ndarray) -> np.ndarray:
        """Which of the names are the first of their kind here and were not sent before."""
        first = np.zeros(len(names), bool)
        first[np.unique(names, return_index=True)[1]] = True
        slot = (names.view(U64) % U64(len(self.names))).astype(np.int64)
        first &= self.names[slot] != names
        self.names[slot[first]] = names[first]
        return first


def postings(ids: np.ndarray, offsets: np.ndarray, tokens: np.ndarray, rarity: Rarity, wanted: np.ndarray | None = None) -> np.ndarray:
    """The prefix postings of the wanted sets (rows of distinct tokens that are sorted by hash)."""
    sizes = np.diff(offsets)
    keep = sizes >= LEAST_SIZE if wanted is None else wanted & (sizes >= LEAST_SIZE)
    tokens, ids, sizes = tokens[np.repeat(keep, sizes)], ids[keep], sizes[keep]
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(rarity.of(tokens), kind="stable")  # of equal counts the hash decides
    tokens = tokens[order[by_row(row[order], len(sizes))]]
    at = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = at < np.repeat(prefix(sizes), sizes)
    out = np.empty(int(keep.sum()), POSTING)
    out["token"], out["id"], out["size"], out["at"] = tokens[keep], ids[row[keep]], sizes[row[keep]], at[keep]
    return out


def salts(tokens: np.ndarray, ids: np.ndarray, rarity: Rarity, hot: int) -> np.ndarray:
    """The salt of each posting: 0 unless its token may be in more than ``hot`` sets."""
    seen = rarity.sets(tokens)
    if not (seen > hot).any():
        return np.zeros(len(tokens), U64)
    return np.where(seen > hot, mix(ids.view(U64)) % np.maximum(np.ceil(seen / hot), 1).astype(U64), U64(0))


def packed_block(found: np.ndarray) -> bytes:
    """Postings as the planes of their bytes, column by column, so that equal bytes stand together."""
    out = []
    for name, width in WIDTHS.items():
        column = np.ascontiguousarray(found[name])
        out.append(column.view(np.uint8).reshape(len(found), column.itemsize)[:, :width].T.tobytes())
    return b"".join(out)


def unpacked_block(data: bytes | pa.Buffer) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8)
    n = len(planes) // sum(WIDTHS.values())
    out, a = np.zeros(n, POSTING), 0
    for name, width in WIDTHS.items():
        column = np.zeros((n, POSTING[name].itemsize), np.uint8)
        column[:, :width] = planes[a : a + n * width].reshape(width, n).T
        out[name] = column.view(POSTING[name]).ravel()
        a += n * width
    return out


def deal(found: np.ndarray, parts: int, rarity: Rarity, hot: int) -> pa.RecordBatch:
    """Postings as blocks by part."""
    part = (mix(found["token"] + salts(found["token"], found["id"], rarity, hot) * U64(0x9E3779B97F4A7C15)) % U64(parts)).astype(np.int64)
    found["token"] >>= TOKEN_SHIFT
    # by part, and in it by the token's upper bits
    order = np.argsort(part.astype(U64) << U64(40) | found["token"]) if parts < 1 << 24 else np.argsort(part)
    part, found = part[order], found[order]
    edges = _runs(part) if len(part) else np.zeros(1, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]]), pa.array([packed_block(found[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], ["part", "block"])


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))


def read_lists(found: np.ndarray, rarity: Rarity, hot: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Of one part's postings: pairs (set, set, lists they share) and groups (name, set, size, position)."""
    found = found[np.argsort(found["token"], kind="stable")]
    hidden = rarity.sets(found["token"] << TOKEN_SHIFT) > hot
    edges = _runs(found["token"]) if len(found) else np.zeros(1, np.int64)
    found = found[np.repeat(np.diff(edges) > 1, np.diff(edges)) | hidden]
    found = found[np.lexsort((found["id"], found["size"], found["token"]))]
    if len(found):
        found = found[np.concatenate([[True], (found["token"][1:] != found["token"][:-1]) | (found["id"][1:] != found["id"][:-1])])]
    if not len(found):
        empty = np.zeros(0, np.int64)
        return (empty,) * 3, (empty,) * 4
    hidden = rarity.sets(found["token"] << TOKEN_SHIFT) > hot
    edges = _runs(found["token"])
    length = np.repeat(np.diff(edges), np.diff(edges))
    total = np.add.reduceat(mix(found["id"].view(U64)), edges[:-1])
    name = np.where(hidden, mix(found["token"] + U64(1)), mix(np.repeat(total, np.diff(edges)))).view(np.int64)
    keep = hidden | (length > SHORT)
    groups = name[keep], found["id"][keep], found["size"][keep].astype(np.int64), found["at"][keep].astype(np.int64)
    found = found[~keep]
    token, size = found["token"], found["size"].astype(np.int64)
    left, x, y = size - found["at"], [], []
    for k in range(1, SHORT):
        i = np.flatnonzero(token[k:] == token[:-k])
        if not len(i):
            break
        j = i + k
        fits = np.minimum(left[i], left[j]) >= overlap_needed(size[i], size[j])
        x.append(found["id"][i[fits]])
        y.append(found["id"][j[fits]])
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (x, y))
    return _counted(np.maximum(x, y), np.minimum(x, y)), groups


def _counted(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    if not len(x):
        return x, y, np.zeros(0, np.int64)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    edges = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
    return x[edges], y[edges], np.diff(np.append(edges, len(x)))


LISTS_SCHEMA = "kind int, a long, b long, n long, m long"


def candidates(blocks_of: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], source: DataFrame, total: int, rarity: Rarity, scratch: Scratch, hot: int = HOT_SETS, per_part: int = PART_POSTINGS) -> DataFrame:
    """Rows of kind 0: pairs (a, b: sets, n: shared lists); of kind 1: groups (a: name, b: set, n: size, m: position).

    ``blocks_of`` makes (ids, offsets, tokens) of the source's batches; ``total`` is the number of postings.
    """
    parts = max(1, -(-total // per_part))
    rarity_b = scratch.broadcast(rarity)  # of fixed size

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, sent = [], 0, Sent()
        for ids, offsets, tokens in blocks_of(batches):
            found = postings(ids, offsets, tokens, rarity_b.value, sent.new(ids))
            held.append(found)
            size += len(found)
            if size > 400_000:
                yield deal(np.concatenate(held), parts, rarity_b.value, hot)
                held, size = [], 0
        if size:
            yield deal(np.concatenate(held), parts, rarity_b.value, hot)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != now and held:
                    yield from _lists(held, rarity_b.value, hot)
                    held = []
                now = part
                held.append(unpacked_block(block.as_buffer()))
        if held:
            yield from _lists(held, rarity_b.value, hot)

    dealt = source.mapInArrow(frugal(emit), "part long, block binary").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(frugal(gather), LISTS_SCHEMA)


def _lists(held: list[np.ndarray], rarity: Rarity, hot: int) -> Iterator[pa.RecordBatch]:
    (x, y, shared), (name, member, size, at) = read_lists(np.concatenate(held), rarity, hot)
    columns = [np.concatenate(v) for v in ((x, name), (y, member), (shared, size), (np.zeros(len(x), np.int64), at))]
    kind = np.concatenate([np.zeros(len(x), np.int32), np.ones(len(name), np.int32)])
    for a in range(0, len(kind), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(v[a : a + 200_000]) for v in (kind, *columns)], ["kind", "a", "b", "n", "m"])


def compatible(n: Column, m: Column) -> Column:
    """Sets of these sizes can be similar."""
    return (DEN * n >= NUM * m) & (DEN * m >= NUM * n)


def within_bits(x: list[str], y: list[str], n: str, m: str) -> Column:
    """The bit patterns in two lists of columns do not differ in more places than similar sets can differ in tokens."""
    differing = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(q))) for p, q in zip(x[1:], y[1:], strict=True)), F.bit_count(F.col(x[0]).bitwiseXOR(F.col(y[0]))))
    # n + m - 2 * overlap needed; no division, and at most the real bound rounded down
    return (NUM + DEN) * differing <= (DEN - NUM) * (F.col(n) + F.col(m))


def block_pairs(entries: DataFrame, longs: int, block_sets: int = BLOCK_SETS, nearest: bool = False) -> DataFrame:
    """Pairs (a, b) of sets of one group with different tags that sizes, positions and bit patterns allow.

    With ``nearest``, rows (x, y, lists) instead: of the pairs of two blocks, for each tag only the one whose bit patterns
    differ least for their sizes (x is of that tag; lists grows with the likeness), so rows follow the tags, not the pairs.

    ``entries``: (g, id, n, at, tag, b0 ...). A group is cut into blocks by
    bands of size and a hash, of about ``block_sets`` sets each. Two blocks
    meet in one task unless their bounds rule out all their pairs: the least
    sizes, the most tokens left behind the positions, and one tag in both. So
    no group is ever in one task as a whole.
    """
    entries = entries.select("g", "id", "n", (F.col("n") - F.col("at")).alias("rest"), "tag", *bit_names(longs)).withColumn("band", F.floor(F.log("n") / float(np.log(DEN / NUM))).cast("int"))
    sizes = entries.groupBy("g", "band").agg(F.ceil(F.count("*") / block_sets).cast("int").alias("salts"))
    entries = entries.join(sizes, ["g", "band"]).withColumn("block", F.pmod(F.xxhash64("id"), "salts").cast("int")).drop("salts")
    bounds = entries.groupBy("g", "band", "block").agg(F.min("n").alias("n"), F.max("rest").alias("rest"), F.min("tag").alias("lo"), F.max("tag").alias("hi"))
    x, y = (bounds.select("g", *(F.col(c).alias(f"{p}_{c}") for c in bounds.columns[1:])) for p in "xy")
    x = x.withColumn("y_band", F.explode(F.array("x_band", F.col("x_band") + 1)))
    met = x.join(y, ["g", "y_band"]).filter((F.col("y_band") > F.col("x_band")) | (F.col("y_block") >= F.col("x_block")))
    met = met.filter((NUM + DEN) * F.least("x_rest", "y_rest") >= NUM * (F.col("x_n") + F.col("y_n"))).filter("x_lo <> x_hi OR y_lo <> y_hi OR x_lo <> y_lo")
    met = met.withColumn("key", F.xxhash64("g", "x_band", "x_block", "y_band", "y_block"))
    own = (F.col("x_band") == F.col("y_band")) & (F.col("x_block") == F.col("y_block"))
    sides = F.array(F.struct(F.col("x_band").alias("band"), F.col("x_block").alias("block"), F.when(own, 2).otherwise(0).alias("side")), F.when(~own, F.struct(F.col("y_band").alias("band"), F.col("y_block").alias("block"), F.lit(1).alias("side"))))
    asked = met.select("g", "key", F.explode(F.filter(sides, lambda s: s.isNotNull())).alias("s")).select("g", "key", "s.band", "s.block", "s.side")
    dealt = asked.join(entries, ["g", "band", "block"]).select("key", "side", "id", "n", "rest", "tag", *bit_names(longs)).repartition("key").sortWithinPartitions("key")

    meet = _nearest_met if nearest else _all_met

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in batch.columns]) if batch.num_rows else np.zeros((batch.num_columns, 0), np.int64)
            edges = _runs(rows[0]) if rows.shape[1] else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and now != rows[0, a]:
                    yield from meet(np.concatenate(held, axis=1))
                    held = []
                now = rows[0, a]
                held.append(rows[1:, a:b])
        if held:
            yield from meet(np.concatenate(held, axis=1))

    return dealt.mapInArrow(frugal(run), "x long, y long, lists double" if nearest else "a long, b long")


def _all_met(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    for x, y, _ in _meeting(rows):
        p, q = x[1], y[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(p, q)), pa.array(np.minimum(p, q))], ["a", "b"])


def _nearest_met(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    best = np.zeros((3, 0), np.int64), np.zeros(0)
    for x, y, differing in _meeting(rows):
        like = 1 - differing / (x[2] + y[2])
        sides = np.concatenate([best[0], [x[4], x[1], y[1]], [y[4], y[1], x[1]]], axis=1)
        like = np.concatenate([best[1], like, like])
        order = np.lexsort((sides[2], sides[1], -like, sides[0]))
        first = order[_runs(sides[0][order])[:-1]]
        best = sides[:, first], like[first]
    if len(best[1]):
        yield pa.RecordBatch.from_arrays([pa.array(best[0][1]), pa.array(best[0][2]), pa.array(best[1])], ["x", "y", "lists"])


def _meeting(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of the sets of two blocks (rows: side, id, n, rest, tag, bit patterns), and in how many bits they differ; of side 2: of one block with itself."""
    x, y = rows[:, rows[0] != 1], rows[:, rows[0] != 0]
    for a in range(0, x.shape[1], 256):
        part = x[:, a : a + 256]
        n, rest, tag = (part[k][:, None] for k in (2, 3, 4))
        i, j = np.nonzero((np.minimum(rest, y[3]) * (NUM + DEN) >= NUM * (n + y[2])) & (tag != y[4]) & (part[1][:, None] != y[1]))
        differing = np.zeros(len(i), np.int64)
        for k in range(5, rows.shape[0]):
            differing += np.bitwise_count((part[k][i] ^ y[k][j]).view(U64))
        fits = (NUM + DEN) * differing <= (DEN - NUM) * (part[2][i] + y[2][j])
        if fits.any():
            yield part[:5, i[fits]], y[:5, j[fits]], differing[fits]
