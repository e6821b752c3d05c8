"""Token counts of whole texts, as a tokenizer's own library gives them.

Texts are encoded in batches and only lengths leave the Arrow function. A
batch is a slice of about ``batch_bytes`` of text, whatever its rows; a text
beyond ``part_bytes`` is cut into parts at safe boundaries and its counts are
added up. A boundary is safe where the tokenizer never joins what stands on
both sides:

* ``.json`` whose normaliser turns runs of white space into one space and
  whose splitter drops it: at every blank or line feed. There the batch is
  further cut into words, words into a core and the signs after it, and each
  distinct core is encoded once, many to a text where they are letters only;
* ``.json`` with a byte-level splitter that keeps one blank before a word, and
  ``.model``: before a single blank between two ASCII letters;
* any other file: texts stay whole.

Defined results: null text counts as empty, with 0 tokens and 0 bytes; an
empty table gives an empty result; repeated rows are counted one by one.
Columns of the input are kept; the new ones are named by the caller.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillmask.llm.columns import blocks, buffers, frugal

BATCH_BYTES = 4 << 20
PART_BYTES = 4 << 20
#: Distinct words whose counts a task remembers, and their characters together.
MEMO_WORDS = 400_000
MEMO_CHARS = 16 << 20
JOINED_WORDS = 64
#: Signs that end a word; after an ASCII letter or digit the splitter always cuts before them.
_TRAIL = ".,!?;:%&*$#|"
_LETTER_GAP = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


class Counter:
    """Counts tokens with the library that a tokenizer's file belongs to."""

    def __init__(self, path: str):
        self.memo: dict[str, int] = {}
        self.memo_chars = 0
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.mode = "gap"
            self.lengths: Callable[[list[str]], list[int]] = lambda xs: [len(x) for x in model.encode(xs, num_threads=1)]
            self.lead = ""  # the library itself puts a blank before a text
        else:
            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            tokenizer = Tokenizer.from_str(json.dumps(spec))
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.mode, self.lead = _boundary(spec), " "
            self.encode = lambda xs: tokenizer.encode_batch_fast(xs, add_special_tokens=False)
            self.lengths = lambda xs: [len(x.ids) for x in self.encode(xs)]
            suffix = spec["model"].get("end_of_word_suffix")
            self.ends_word = np.zeros(tokenizer.get_vocab_size(), bool)
            if suffix:
                self.ends_word[[i for w, i in tokenizer.get_vocab(with_added_tokens=False).items() if w.endswith(suffix)]] = True

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each row."""
        return self._by_word(column) if self.mode == "word" else self._by_part(column)

    def _by_word(self, column: pa.Array) -> np.ndarray:
        offsets, data = buffers(column)
        flat = data.copy()
        flat[flat == 10] = 32
        lists = []
        for a, b in _cuts(offsets, flat):
            part = offsets[(offsets > a) & (offsets < b)] - a
            bounds = np.concatenate([[0], part, [b - a]]).astype(np.int64)
            text = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(flat[a:b].tobytes())])
            lists.append((a + bounds[:-1], pc.split_pattern(text, " ")))
        total = np.zeros(len(column), np.int64)
        for starts, words in lists:
            coded = words.flatten().dictionary_encode()
            known = self._known(coded.dictionary)
            sums = np.concatenate([[0], np.cumsum(known[coded.indices.to_numpy()])])
            edges = words.offsets.to_numpy()
            np.add.at(total, np.searchsorted(offsets, starts, "right") - 1, sums[edges[1:]] - sums[edges[:-1]])
        return total

    def _known(self, words: pa.Array) -> np.ndarray:
        """Tokens of distinct words: those of the core and those of the signs that end it."""
        if len(self.memo) > MEMO_WORDS or self.memo_chars > MEMO_CHARS:
            self.memo.clear()
            self.memo_chars = 0
        low = pc.if_else(pc.match_substring(words, "<"), words, pc.ascii_lower(words))
        core = pc.utf8_rtrim(low, characters=_TRAIL)
        safe = pc.and_(pc.match_substring_regex(core, "[a-z0-9]$"), pc.invert(pc.match_substring(words, "<")))
        core = pc.if_else(safe, core, low)
        tail = pa.array([w[len(c) :] for w, c in zip(low.to_pylist(), core.to_pylist(), strict=True)], pa.large_string())
        total = np.zeros(len(words), np.int64)
        for part in (core, tail):
            coded = part.dictionary_encode()
            total += self._memoized(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        return total

    def _memoized(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        new = list({w for w in words if w not in memo})
        self.memo_chars += sum(map(len, new))
        plain = [w for w in new if w.isalpha()]
        texts = [plain[i : i + JOINED_WORDS] for i in range(0, len(plain), JOINED_WORDS)]
        odd = [w for w in new if not w.isalpha()]
        for group, encoded in zip(texts, self.encode([" ".join(g) for g in texts]), strict=True):
            ends = np.flatnonzero(self.ends_word[encoded.ids])
            if len(ends) == len(group) and ends[-1] == len(encoded.ids) - 1:
                memo.update(zip(group, np.diff(ends, prepend=-1).tolist(), strict=True))
            else:  # a word that the splitter cuts in itself, or a file whose tokens don't show where words end
                odd += group
        memo.update(zip(odd, self.lengths(odd), strict=True))
        return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))

    def _by_part(self, column: pa.Array) -> np.ndarray:
        rows, parts = [], []
        for i, text in enumerate(column.to_pylist()):
            for j, part in enumerate(_parts(text) if self.mode == "gap" else [text]):
                rows.append(i)
                parts.append(self.lead + part if j else part)
        return np.bincount(rows, self.lengths(parts), len(column)).astype(np.int64) if rows else np.zeros(len(column), np.int64)


def _boundary(spec: dict) -> str:
    """Which boundaries are safe for a tokenizer's file: word, gap or none."""
    text = json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
    if '"pattern": {"Regex": "\\\\s+"}, "content": " "' in text and '"behavior": "Removed", "invert": true' in text and "[^\\\\s" in text:
        return "word"
    pre = spec.get("pre_tokenizer") or {}
    return "gap" if not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") else "none"


def _cuts(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PART_BYTES that end before a blank or between two rows."""
    a, n = 0, len(data)
    while a < n:
        b = a + PART_BYTES
        if b < n:
            row = int(offsets[np.searchsorted(offsets, b)])
            at = b
            while at < row and not (gap := np.flatnonzero(data[at : min(row, at + 65536)] == 32)).size:
                at += 65536
            b = at + int(gap[0]) if at < row else row
        yield a, min(b, n)
        a = min(b, n)


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about PART_BYTES characters; the blank at a cut belongs to the next part and is left out."""
    a = 0
    while len(text) - a > PART_BYTES and (gap := _LETTER_GAP.search(text, a + PART_BYTES)):
        yield text[a : gap.start()]
        a = gap.end()
    yield text[a:]


def token_counts(docs: DataFrame, path: str, text: str = "text", bytes_col: str = "n_bytes", tokens_col: str = "n_tokens", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The input's columns but ``text``, with the text's UTF-8 bytes and its tokens (both long)."""
    clash = {bytes_col, tokens_col} & {c for c in docs.columns if c != text}
    docs = docs.drop(*clash)
    schema = T.StructType([f for f in docs.schema if f.name != text] + [T.StructField(bytes_col, T.LongType()), T.StructField(tokens_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            for rows, column in blocks(batch, text, batch_bytes):
                offsets, _ = buffers(column)
                kept = [rows.column(i) for i, f in enumerate(rows.schema) if f.name != text]
                names = [f.name for f in rows.schema if f.name != text]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(offsets)), pa.array(counter.counts(column))], [*names, bytes_col, tokens_col])

    return docs.mapInArrow(frugal(run), schema)
