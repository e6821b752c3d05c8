import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillmask.llm import token_counts as tc
from quillmask.llm.query_tokens import op10_token_counts

TEXTS = [None, "", " ", "a", "It's  <|endoftext|> a\tB\n\né́x ", "ΣΑΣ Σ", "x\x1cy\x85z w", "12 345 ...!!", "你好 \U0001f600", "word " * 5000, "a" * 3000, "a" * 3000, "long text, " * 500_000]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()
    texts = TEXTS + [r.text for r in docs]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").selectExpr("*", "'x' AS n_tokens", "'y' AS n_bytes").coalesce(2)
    assert tc.token_counts(rows, path).columns == ["k", "n_bytes", "n_tokens"]
    got = {r.k: r for r in tc.token_counts(rows, path).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_bytes == len((t or "").encode())
        assert got[i].n_tokens == count(t or ""), (i, t)
    assert tc.token_counts(rows.limit(0), path).collect() == []


@pytest.mark.parametrize(("name", "mode"), [("byte_bpe_50k.json", "gap"), ("word_bpe_49k.json", "word"), ("piece_bpe_32k.model", "gap")])
@pytest.mark.parametrize("size", [37, 1000])
def test_parts_equal_the_whole(monkeypatch, name, mode, size):
    counter = tc.Counter(public_tokenizers.path(name))
    assert counter.mode == mode
    texts = [t or "" for t in TEXTS] + ["It is so. And 12 of  them\n" * 200, "x" * 100 + " " + "\n" * 50 + "y <|endoftext|> z. " * 30]
    whole = [counter.lengths([t])[0] for t in texts]
    monkeypatch.setattr(tc, "PART_BYTES", size)
    assert counter.counts(pa.array(texts, pa.large_string())).tolist() == whole


def test_memo_is_bounded_by_characters(monkeypatch):
    counter = tc.Counter(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(tc, "MEMO_CHARS", 1000)
    for k in range(5):
        counter.counts(pa.array([f"junk{k}" * 400], pa.large_string()))
    assert len(counter.memo) <= 3 and counter.memo_chars < 5000


def test_query_equals_the_library(spark):
    d = "/root/testdata/sf0.01"
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    got = op10_token_counts(spark, d).collect()
    want = dict(zip(texts, (len(e.ids) for e in model.encode_batch_fast(list(texts.values()), add_special_tokens=False)), strict=True))
    assert sorted(map(tuple, got)) == sorted((i, len(t.encode()), want[i], want[i] > 2048) for i, t in texts.items())
    assert any(r.over_limit for r in got) and not all(r.over_limit for r in got)
