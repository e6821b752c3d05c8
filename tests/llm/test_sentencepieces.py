import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from quillmask.llm import sentencepieces as sp
from quillmask.llm.query_tokens import op2_sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "   ", "a", " the  cat   sat\n\n\ton it ", "x" * 700, "<s> </s> <0x41>", "你好 \U0001f600 é́", "▁a ▁", "aaaa" * 40, "     " * 30 + "b", "Hello, world!! 1234567"]


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def unigram_file(path, to):
    """The same pieces as a unigram model, with invented log probabilities."""
    out, i = b"", 0
    for number, value in sp.fields(open(path, "rb").read()):
        if number == 1:
            piece = dict(sp.fields(value))
            score = 0.0 if piece.get(3, 1) != 1 else -3.0 - (i * 7919 % 1009) / 128 - 4 / len(piece[1])
            i += 1
            value = b"\x0a" + varint(len(piece[1])) + piece[1] + b"\x15" + np.float32(score).tobytes() + b"\x18" + varint(piece.get(3, 1))
        elif number == 2:
            value = value + b"\x18\x01"
        out += varint(number << 3 | 2) + varint(len(value)) + value
    to.write_bytes(out)
    return str(to)


@pytest.fixture(scope="module")
def texts(spark):
    return TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_ids_equal_the_library(texts, kind, tmp_path):
    path = PATH if kind == "bpe" else unigram_file(PATH, tmp_path / "u.model")
    ours, library = sp.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert (ours.kind == sp.BPE) == (kind == "bpe")
    ids, first = ours.encode(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        mine, theirs = ids[first[i] : first[i + 1]].tolist(), library.encode(t)
        if kind == "bpe" or len(t) < 800:
            assert mine == theirs, t[:200]
        else:  # the library adds up a whole text in 32 bits, so its near ties fall by rounding
            best = [np.sum(ours.scores[np.array(x)].astype(np.float64)) for x in (mine, theirs)]
            assert best[0] == pytest.approx(best[1], abs=1e-2) and len([1 for a, b in zip(mine, theirs, strict=False) if a != b]) < len(mine)
    assert ours.decode(ids, first) == [library.decode(library.encode(t)) for t in texts]


def test_viterbi_is_the_best_path(tmp_path):
    ours = sp.Pieces(unigram_file(PATH, tmp_path / "u.model"))

    def best(w):
        if not w:
            return 0.0
        return max(best(w[:i]) + (float(ours.scores[ours.index[w[i:]]]) if w[i:] in ours.index else float(ours.low)) for i in range(len(w)) if w[i:] in ours.index or i == len(w) - 1)

    for w in ("▁table", "▁thing", "ononon"):
        ours.encode_words([w])
        assert sum(float(ours.scores[i]) for i in ours.ids_of(w)) == pytest.approx(best(w), abs=1e-3)


def test_query_and_odd_rows(spark):
    d = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = {r.doc_id: library.encode(r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op2_sentencepieces(spark, d).collect()
    assert len(got) == len(want) and all(r.round_trip for r in got)
    for r in got:
        assert r.n_pieces == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(" ".join(map(str, want[r.doc_id])).encode())
    rows = spark.createDataFrame([(1, None, 5), (1, "", 6), (1, "", 6)], "doc_id long, text string, piece_ids int")
    assert [r.piece_ids for r in sp.encode_texts(rows, PATH).collect()] == [[], [], []]
    assert sp.decode_texts(sp.encode_texts(rows.limit(0), PATH), PATH).collect() == []
