import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st

from quillmask.llm import packing as pk
from quillmask.llm.query_tokens import op6_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(pieces, want, size=2048):
    """pieces: doc_id, start, ids, doc_tokens, sequence_id, offset; want: lists of ids by doc_id."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for doc_id, start, ids, every, sequence, offset in pieces:
        docs[doc_id].append((start, list(ids), every))
        sequences[sequence].append((offset, len(ids)))
    for doc_id, found in docs.items():
        found.sort(key=lambda x: x[0])
        assert sum((ids for _, ids, _ in found), []) == want[doc_id]
        assert all(n == len(want[doc_id]) for _, _, n in found)
    assert docs.keys() == want.keys()
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= size
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / max(total, 1)


@given(st.lists(st.tuples(st.integers(1, 9), st.sampled_from([0.0, 1.0, 5.0])), min_size=1, max_size=9), st.integers(9, 14))
def test_cuts_are_the_cheapest(steps, size):
    ends = np.cumsum([s for s, _ in steps])
    penalty = np.array([p for _, p in steps])

    def least(i):
        if i < 0:
            return 0.0
        return min(least(j) + size - (ends[i] - (ends[j] if j >= 0 else 0)) + penalty[i] for j in range(-1, i) if ends[i] - (ends[j] if j >= 0 else 0) <= size)

    chosen = pk.cut(ends, penalty, size, whole=True)
    at = dict(zip(ends.tolist(), penalty.tolist(), strict=True))
    cost = sum(size - (b - a) + at[b] for a, b in zip([0, *chosen[:-1]], chosen, strict=True))
    assert chosen[-1] == ends[-1] and abs(cost - least(len(ends) - 1)) < 1e-9


@given(st.lists(st.integers(1, 300), max_size=30), st.integers(1, 5))
def test_streams_keep_every_token(lengths, chunk):
    rng = np.random.Generator(np.random.PCG64(1))
    packer, out, want = pk.Packer(np.arange(50) % 7 == 0, 0, 64, 100 * chunk), [], {}
    for i, n in enumerate(lengths):
        ids = rng.integers(1, 50, n).astype(np.uint32)
        want[i] = ids.tolist()
        out += packer.add(i, ids)
    out += packer.finish()
    check(out, want, 64)


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    library, ours = Tokenizer.from_file(PATH), pk.Encoder(PATH)
    assert ours.fast is not None
    allowed = [chr(c) for c in range(0xA000) if not pk._RARE.match(chr(c))]
    texts = ["", "a<|endoftext|> b", "x\x1cy\x85z\xa0w  \n\n q", "  \t " * 300, *(f"a{c}{c} {c}1 {c}." for c in allowed), "你好\U0001f600", "it's They'LL we're" * 3]
    for t in texts:
        assert ours.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    size, pk.PART_CHARS = pk.PART_CHARS, 20
    try:
        t = "Some words, and  more words.\nAnother line 12 of it " * 20
        assert ours.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids
    finally:
        pk.PART_CHARS = size


def test_query(spark):
    from tokenizers import Tokenizer

    d, library = "/root/testdata/sf0.01", Tokenizer.from_file(PATH)
    want = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op6_packing(spark, d).collect()
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert check([(r.doc_id, r.start, want[r.doc_id][r.start : r.start + r.length], r.doc_tokens, r.sequence_id, r.offset) for r in rows], want) < 0.004


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (2, "", 7), (None, "x", 7)], "doc_id long, text string, start int")
    assert sorted((str(r.doc_id), len(r.ids) // 4, r.doc_tokens) for r in pk.pack(df, PATH).collect()) == [("1", 1, 1), ("2", 1, 1), ("2", 1, 1), ("None", 2, 2)]
    assert pk.pack(df.limit(0), PATH).collect() == []
