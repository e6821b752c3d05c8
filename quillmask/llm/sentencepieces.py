"""SentencePiece encoding and decoding in numpy, for whole Arrow batches.

The pieces and scores of a ``.model`` file are read from its bytes. Texts are
cut into words (blanks, then anything else, and characters that are in no
piece; no piece reaches over the borders),
each distinct word of a batch is encoded once, and words of equal length
advance together. A substring is found by its hash among the sorted hashes of
all pieces; hashes of all substrings come from prefix sums.

* A unigram file is encoded by Viterbi: for each end, the best score over all
  starts is a vectorised maximum, which also stores the backpointer.
* In a BPE file the score of a piece is its merge rank, and the best sum of
  scores is not what the merges give. There the same tables drive merge
  rounds: in each round every word of the group merges its best pair, the
  leftmost of equals.

Both give the ids of the sentencepiece library. Characters that are no piece
become byte pieces, or the unknown piece where the file has none.

Defined results: null text counts as empty and has no ids; an empty table
gives an empty result; repeated rows are encoded one by one; very long words
(beyond ``LONG_WORD`` characters) go through the merges one at a time with a
heap, in n log n steps.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillmask.llm.columns import STEP_KEYS, U64, blocks, buffers, frugal, mix

BLANK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MEMO_WORDS = 150_000
LONG_WORD = 256
BATCH_BYTES = 1 << 20
GROUP_CELLS = 1 << 17
_BASE = U64(STEP_KEYS[7])
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


def _codes(chars: np.ndarray) -> np.ndarray:
    return mix(chars.astype(U64) + U64(0x5851F42D4C957F2D))


class Pieces:
    """A model file's pieces, and encoding and decoding with them."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = f.read()
        pieces, kinds, scores = [], [], []
        self.kind, self.dummy, self.trim, charsmap = UNIGRAM, True, True, b""
        self._forget()
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                pieces.append(piece.get(1, b"").decode())
                scores.append(np.frombuffer(piece[2], np.float32)[0] if 2 in piece else np.float32(0))
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(fields(value))
                charsmap, self.dummy, self.trim = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.normalizer = None
        if charsmap:
            import sentencepiece

            self.normalizer = sentencepiece.SentencePieceProcessor(model_file=path)
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == BYTE}
        self.frozen = sorted((p for p, k in zip(pieces, kinds, strict=True) if k == USER_DEFINED), key=len, reverse=True)
        self.frozen_re = re.compile("|".join(map(re.escape, self.frozen))) if self.frozen else None
        known = [i for i, k in enumerate(kinds) if k in (NORMAL, USER_DEFINED)]
        if any(BLANK in pieces[i].lstrip(BLANK) for i in known):
            raise ValueError("a piece reaches over a blank")
        self.index = {pieces[i]: i for i in known}
        self.pieces, self.kinds, self.scores = pieces, kinds, np.array(scores, np.float32)
        hashes = np.array([self._hash(pieces[i]) for i in known], U64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(known, np.int64)[order]
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces have one hash")
        inside = set("".join(pieces[i] for i in known))
        #: ASCII bytes that are in no piece, so no piece reaches over them.
        self.breaks = np.array([b < 128 and b != 32 and chr(b) not in inside for b in range(256)])
        self.widest = max(len(pieces[i]) for i in known)
        self.low = np.float32(min((self.scores[i] for i in known if kinds[i] == NORMAL), default=0) - 10)
        self._decoding()

    def _forget(self) -> None:
        """Words already encoded: the slot of each, and the slots' ids one after another."""
        self.memo: dict[str, int] = {}
        self.slot_ends, self.store = np.zeros(1, np.int64), np.zeros(1 << 16, np.uint32)

    def _remember(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        used = int(self.slot_ends[-1])
        if used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(max(len(self.store), len(ids)), np.uint32)])
        self.store[used : used + len(ids)] = ids
        first = len(self.slot_ends) - 1
        self.memo.update(zip(words, range(first, first + len(words)), strict=True))
        self.slot_ends = np.concatenate([self.slot_ends, used + np.cumsum(lengths)])

    def ids_of(self, word: str) -> list[int]:
        k = self.memo[word]
        return self.store[self.slot_ends[k] : self.slot_ends[k + 1]].tolist()

    @staticmethod
    def _hash(piece: str) -> int:
        codes = _codes(np.frombuffer(piece.encode("utf-32-le"), np.uint32))
        powers = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(max(len(codes) - 1, 0), _BASE, U64)]))
        return mix(np.array([np.sum(codes * powers[: len(codes)], dtype=U64)], U64))[0]

    def find(self, sums: np.ndarray, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The piece that each substring is, or -1."""
        key = mix((sums[rows, end] - sums[rows, start]) * self.down[start])
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (end - start <= self.widest), self.ids[at], -1)

    def _sums(self, words: list[str]) -> np.ndarray:
        """Prefix sums of the substring hash for words of one length."""
        n = len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n)
        codes = _codes(np.where(chars == 32, ord(BLANK), chars))
        up = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n, _BASE, U64)]))
        self.down = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n, _INVERSE, U64)]))
        sums = np.zeros((len(words), n + 1), U64)
        np.cumsum(codes * up[:n], axis=1, out=sums[:, 1:])
        return sums

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For words of one length: the start of the best path's last piece for each end, and that piece (-1: unknown)."""
        sums, n = self._sums(words), len(words[0])
        rows = np.arange(len(words))
        best = np.full((len(words), n + 1), -np.inf, np.float32)
        best[:, 0] = 0
        back, piece = np.zeros((len(words), n + 1), np.int64), np.full((len(words), n + 1), -1)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.widest), end):
                found = self.find(sums, rows, np.full(len(words), start), np.full(len(words), end))
                gain = np.where(found >= 0, self.scores[found], -np.inf).astype(np.float32)
                if start == end - 1:
                    gain = np.where(found >= 0, gain, self.low).astype(np.float32)
                total = best[:, start] + gain
                better = total > best[:, end]
                best[better, end], back[better, end], piece[better, end] = total[better], start, found[better]
        return back, piece

    def merges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For words of one length, after all merges: the piece that starts at each place (-1: none), and where symbols start."""
        sums, n, g = self._sums(words), len(words[0]), len(words)
        ends = np.tile(np.arange(1, n + 1), (g, 1))
        before = np.tile(np.arange(-1, n - 1), (g, 1))
        alive = np.ones((g, n), bool)
        score = np.full((g, n), -np.inf, np.float32)
        pair = np.full((g, n), -1)

        def probe(r: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
            found = self.find(sums, r, s, e)
            pair[r, s] = found
            score[r, s] = np.where(found >= 0, self.scores[found], -np.inf)

        r = np.repeat(np.arange(g), n)
        s = np.tile(np.arange(n), g)
        piece = self.find(sums, r, s, s + 1).reshape(g, n)
        inner = s < n - 1
        probe(r[inner], s[inner], s[inner] + 2)
        rows = np.arange(g)
        while len(rows):
            at = np.argmax(score[rows], axis=1)
            going = score[rows, at] > -np.inf
            rows, at = rows[going], at[going]
            if not len(rows):
                break
            middle = ends[rows, at]
            end = ends[rows, middle]
            ends[rows, at] = end
            piece[rows, at] = pair[rows, at]
            alive[rows, middle] = False
            score[rows, middle] = -np.inf
            inside = end < n
            before[rows[inside], end[inside]] = at[inside]
            score[rows[~inside], at[~inside]] = -np.inf
            r, s = rows[inside], at[inside]
            probe(r, s, ends[r, end[inside]])
            previous = before[rows, at]
            some = previous >= 0
            probe(rows[some], previous[some], end[some])
        return piece, alive

    def _single(self, parts: list[str]) -> list[str]:
        """The merges of one word with a heap; ``parts`` are its symbols, those of several characters are frozen."""
        n = len(parts)
        symbols: list[str | None] = list(parts)
        free = [len(p) == 1 for p in parts]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple] = []

        def push(a: int) -> None:
            b = right[a] if a >= 0 else n
            if a >= 0 and b < n and free[a] and free[b]:
                piece = symbols[a] + symbols[b]
                i = self.index.get(piece)
                if i is not None:
                    heapq.heappush(heap, (-self.scores[i], a, b, piece))

        for a in range(n - 1):
            push(a)
        while heap:
            _, a, b, piece = heapq.heappop(heap)
            if symbols[a] is None or symbols[b] is None or right[a] != b or symbols[a] + symbols[b] != piece:
                continue
            symbols[a], symbols[b] = piece, None
            right[a] = right[b]
            if right[b] < n:
                left[right[b]] = a
            push(left[a])
            push(a)
        return [s for s in symbols if s is not None]

    def _ids(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            i = self.index.get(s)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in s.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def encode_words(self, words: list[str]) -> None:
        """Puts the ids of new words, whose blanks may be spaces, into the memo."""
        by_length, single = defaultdict(list), []
        for w in words:
            if self.kind == BPE and (len(w) > LONG_WORD or (self.frozen_re and self.frozen_re.search(w.replace(" ", BLANK)))):
                single.append(w)
            else:
                by_length[len(w)].append(w)
        for w in single:
            text = w.replace(" ", BLANK)
            parts, at = [], 0
            for m in self.frozen_re.finditer(text) if self.frozen_re else ():
                parts += [*text[at : m.start()], m[0]]
                at = m.end()
            self._symbols([w], [self._single([*parts, *text[at:]])])
        for n, group in by_length.items():
            step = max(1, GROUP_CELLS // (n + 1))
            for a in range(0, len(group), step):
                part = group[a : a + step]
                if self.kind == BPE:
                    piece, alive = self.merges(part)
                    odd = np.any(alive & (piece < 0), axis=1)
                    if odd.any():
                        starts = [[*np.flatnonzero(x).tolist(), n] for x in alive[odd]]
                        strange = [w for w, o in zip(part, odd.tolist(), strict=True) if o]
                        self._symbols(strange, [[w[i:j].replace(" ", BLANK) for i, j in zip(c[:-1], c[1:], strict=True)] for w, c in zip(strange, starts, strict=True)])
                        part = [w for w, o in zip(part, odd.tolist(), strict=True) if not o]
                        piece, alive = piece[~odd], alive[~odd]
                    self._remember(part, piece[alive], alive.sum(axis=1))
                else:
                    back, _ = self.viterbi(part)
                    found = []
                    for w, b in zip(part, back.tolist(), strict=True):
                        symbols, i = [], n
                        while i > 0:
                            symbols.append(w[b[i] : i].replace(" ", BLANK))
                            i = b[i]
                        found.append(symbols[::-1])
                    self._symbols(part, found)

    def _symbols(self, words: list[str], symbols: list[list[str]]) -> None:
        ids = [self._ids(x) for x in symbols]
        self._remember(words, np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64))

    def normalized(self, column: pa.Array) -> pa.Array:
        """The texts as the model sees them, with spaces for its blanks."""
        if self.normalizer is not None:
            return pa.array([self.normalizer.normalize(t).replace(BLANK, " ") for t in column.to_pylist()], pa.large_string())
        if pc.any(pc.match_substring(column, BLANK)).as_py():
            column = pc.replace_substring(column, BLANK, " ")
        if self.trim:
            column = pc.replace_substring_regex(pc.utf8_trim(column, " "), " +", " ")
        if self.dummy:
            column = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar(" ", pa.large_string())))
        return column

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order (uint32), and how many stand before each text (texts + 1)."""
        if len(self.memo) > MEMO_WORDS:
            self._forget()
        offsets, data = buffers(self.normalized(column))
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        begins = data == 32
        begins[1:] &= data[:-1] != 32
        alone = self.breaks[data]
        begins |= alone
        begins[1:] |= alone[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begins)
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(np.ascontiguousarray(data))])
        coded = words.dictionary_encode()
        known = coded.dictionary.to_pylist()
        self.encode_words([w for w in known if w not in self.memo])
        slots = np.fromiter(map(self.memo.__getitem__, known), np.int64, len(known))[coded.indices.to_numpy()]
        begin = self.slot_ends[slots]
        size = self.slot_ends[slots + 1] - begin
        places = np.concatenate([[0], np.cumsum(size)])
        return self.store[np.repeat(begin - places[:-1], size) + np.arange(places[-1])], places[np.searchsorted(starts, offsets)]

    def _decoding(self) -> None:
        parts = []
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            text = b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if i == self.unknown else p.replace(BLANK, " ").encode()
            parts.append(text)
        self.table = np.frombuffer(b"".join(parts), np.uint8)
        self.table_at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """Texts from ids: all pieces' bytes are copied at once by scatter indices."""
        starts = self.table_at[ids]
        size = self.table_at[ids.astype(np.int64) + 1] - starts
        places = np.concatenate([[0], np.cumsum(size)])
        data = self.table[np.repeat(starts - places[:-1], size) + np.arange(places[-1])].tobytes()
        cuts = places[first]
        texts = [data[a:b].decode(errors="replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return [t.removeprefix(" ") if self.dummy else t for t in texts]


def encode_texts(docs: DataFrame, path: str, text: str = "text", ids: str = "piece_ids") -> DataFrame:
    """The input with the ids of ``text`` (array of int) in column ``ids``."""
    docs = docs.drop(*({ids} & set(docs.columns)))
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            for rows, column in blocks(batch, text, BATCH_BYTES):
                found, first = pieces.encode(column)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], [*rows.schema.names, ids])

    return docs.mapInArrow(frugal(run), schema)


def decode_texts(encoded: DataFrame, path: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """The input with the text that the ids stand for; null ids give empty text."""
    encoded = encoded.drop(*({text} & set(encoded.columns)))
    schema = T.StructType([*encoded.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for whole in batches:
            for a in range(0, len(whole), 512):
                batch = whole.slice(a, 512)
                lists = batch.column(batch.schema.get_field_index(ids))
                size = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts = pieces.decode(flat, np.concatenate([[0], np.cumsum(size)]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    return encoded.mapInArrow(frugal(run), schema)
