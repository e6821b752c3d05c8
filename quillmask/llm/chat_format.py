"""Chat formatting: conversations as template text with a loss mask, assembled as columns of bytes.

A turn becomes ``<|start|>role\\ntext<|end|>\\n``. For a batch of turns the
lengths of all segments (marker, role, line feed, text, closing) are computed,
cumulative sums of them give the places, and headers and contents are copied
by scatter indices into one preallocated buffer, which is the output column.

Control strings inside a text are escaped reversibly: one backslash goes after
their first character, and one more where such backslashes stand already, so
``</s>`` becomes ``<\\/s>`` and ``<\\/s>`` becomes ``<\\\\/s>``. Only the
template itself then holds a bare control string. In a role, backslash and
line feed are escaped too.

Turns are formatted where they stand, without a shuffle, so no conversation is
too long for it. A conversation's formatted text is the concatenation of its
rows' ``formatted`` by turn, then role, then these bytes. Only reading back,
which gives one digest of each conversation, brings its turns together, and
handles them as a stream in the memory of one batch.

Defined results: null text and null role count as empty; repeated rows and
turns with one number are turns of their own; turns without a number come
first; rows without conv_id form one conversation; an empty table gives an
empty result. Other columns of the input are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.columns import frugal

START, END = "<|start|>", "<|end|>"
#: Strings that chat templates and tokenizers give a meaning of their own.
CONTROLS = (START, END, "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>")
_TAILS = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_TAILS})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_TAILS})")
_MAYBE = re.compile(r"[<\[]")

TURN_SCHEMA = "conv_id long, turn long, role string, formatted binary, loss_start long, loss_length long"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text) if _MAYBE.search(text) else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def assemble(roles: list[str], contents: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all turns, where each turn starts (rows + 1), and where its text starts and how long it is, in bytes."""
    n = len(contents)
    heads = [(START + escape_role(r) + "\n").encode() for r in roles]
    bodies = [escape(c).encode() for c in contents]
    tail = (END + "\n").encode()
    lengths = np.empty((n, 3), np.int64)
    lengths[:, 0] = np.fromiter(map(len, heads), np.int64, n)
    lengths[:, 1] = np.fromiter(map(len, bodies), np.int64, n)
    lengths[:, 2] = len(tail)
    places = np.concatenate([[0], np.cumsum(lengths.ravel())])
    out = np.empty(places[-1], np.uint8)
    for k, source in ((0, b"".join(heads)), (1, b"".join(bodies)), (2, tail * n)):
        size = lengths[:, k]
        before = np.cumsum(size) - size
        out[np.repeat(places[k:-1:3] - before, size) + np.arange(len(source))] = np.frombuffer(source, np.uint8)
    return out, places[::3], places[1::3][:n] - places[::3][:n], lengths[:, 1]


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role (null: empty), its formatted bytes and where in them the loss counts (assistant texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                roles, contents = ([x or "" for x in batch.column(i).to_pylist()] for i in (2, 3))
                out, places, start, length = assemble(roles, contents)
                offsets = pa.py_buffer(places.astype(np.int64))
                formatted = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, offsets, pa.py_buffer(out)]).cast(pa.binary())
                learn = np.array([r == "assistant" for r in roles], bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(roles), formatted, pa.array(start), pa.array(np.where(learn, length, 0))],
                    ["conv_id", "turn", "role", "formatted", "loss_start", "loss_length"],
                )

    cols = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")]
    return turns.select(*cols).mapInArrow(frugal(run), TURN_SCHEMA)


def parse_turn(formatted: bytes) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    body = formatted.decode().removeprefix(START).removesuffix(END + "\n")
    role, _, text = body.partition("\n")
    return unescape_role(role), unescape(text)


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the output of :func:`format_turns` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, state = None, None
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in (0, 3, 4, 5))
            for conv, data, start, length in zip(*columns, strict=True):
                if state is None or conv != key:
                    if state is not None:
                        done.append(_row(key, state))
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(data)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                learned = unescape(data[start : start + length].decode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(data.decode())
            if len(done) >= 4096:
                yield _batch(done)
                done = []
        if state is not None:
            done.append(_row(key, state))
        if done:
            yield _batch(done)

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return dealt.mapInArrow(frugal(run), DIGEST_SCHEMA)


def _row(key: int | None, state: list) -> tuple:
    return key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
