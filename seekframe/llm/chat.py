"""Chat formatting by columnar byte assembly.

Template, one turn after the other:  ``### <role>: <text></turn>\n``

Roles and texts are escaped: a backslash goes before each ``\\``, ``#`` and ``<`` (in roles also
before ``:``), so neither ``### `` nor ``</turn>`` can come out of a text, and dropping the first
of each backslash pair gives the text back.

Defined results: a null role or text is empty; a null conversation id is a conversation of its
own; rows with equal turns are ordered by role, then text; repeated rows are repeated turns;
further columns are ignored; an empty table gives no rows.  A conversation goes out as one row, or
as several numbered parts of about ``part_bytes`` each, so no row and no task holds an unbounded
one.  Conversations are dealt out by id and streamed in turn order, a batch at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import raw, slices

OPEN, MIDDLE, CLOSE = b"### ", b": ", b"</turn>\n"
_IN_TEXT = np.zeros(256, bool)
_IN_TEXT[list(b"\\#<")] = True
_IN_ROLE = _IN_TEXT.copy()
_IN_ROLE[ord(":")] = True
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)

FORMATTED = "conv_id long, part int, n_turns int, formatted string, loss array<struct<start:long,end:long>>"
PARSED = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray, special: np.ndarray) -> None:
    """Copies each row of data to ``at[row]``, a backslash before each special byte."""
    marks = special[data]
    row = np.repeat(np.arange(len(at)), np.diff(offsets))
    shift = np.cumsum(marks)
    before = np.concatenate(([0], shift))[offsets[:-1]]
    to = at[row] + (np.arange(len(data)) - offsets[row]) + (shift - before[row])
    out[to] = data
    out[to[marks] - 1] = ord("\\")


def _constant(out: np.ndarray, at: np.ndarray, piece: bytes) -> None:
    out[at[:, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of all turns, their n + 1 offsets, and where each escaped text starts and ends."""
    role, role_at = raw(roles)
    text, text_at = raw(texts)
    grown = lambda data, at, special: np.diff(at) + np.diff(np.concatenate(([0], np.cumsum(special[data])))[at])
    n_role, n_text = grown(role, role_at, _IN_ROLE), grown(text, text_at, _IN_TEXT)
    length = len(OPEN) + n_role + len(MIDDLE) + n_text + len(CLOSE)
    at = np.concatenate(([0], np.cumsum(length)))
    out = np.empty(at[-1], np.uint8)
    begin = at[:-1] + len(OPEN) + n_role + len(MIDDLE)
    _constant(out, at[:-1], OPEN)
    _scatter(out, at[:-1] + len(OPEN), role, role_at, _IN_ROLE)
    _constant(out, begin - len(MIDDLE), MIDDLE)
    _scatter(out, begin, text, text_at, _IN_TEXT)
    _constant(out, begin + n_text, CLOSE)
    return out, at, begin, begin + n_text


def _formatter(loss_role: str, part_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = object(), 0
        for whole in batches:
            for b, e in slices(whole["text"], part_bytes):
                batch = whole.slice(b, e - b)
                out, at, begin, end = assemble(batch["role"], batch["text"])
                points = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
                ids = batch["conv_id"].to_pylist()
                cut = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
                loss = np.array([r == loss_role for r in batch["role"].to_pylist()], bool)
                numbers, spans = [], []
                for i, j in zip(cut, cut[1:], strict=False):
                    part = part + 1 if ids[i] == last else 0
                    last = ids[i]
                    numbers.append(part)
                    base = points[at[i]]
                    spans.append([{"start": int(points[begin[k]] - base), "end": int(points[end[k]] - base)} for k in range(i, j) if loss[k]])
                joined = pa.StringArray.from_buffers(len(cut) - 1, pa.py_buffer(at[cut].astype(np.int32)), pa.py_buffer(out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in cut[:-1]], pa.int64()), pa.array(numbers, pa.int32()), pa.array(np.diff(cut), pa.int32()), joined, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    ["conv_id", "part", "n_turns", "formatted", "loss"],
                )

    return run


def format_chats(turns: DataFrame, loss_role: str = "assistant", part_bytes: int = 4 << 20) -> DataFrame:
    """Columns conv_id, part, n_turns, formatted, loss (code point spans of escaped ``loss_role`` texts), parts of a conversation in order."""
    columns: list[Column] = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")]
    rows = turns.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_formatter(loss_role, part_bytes), FORMATTED)


def unescape(piece: str) -> str:
    return _ESCAPED.sub(r"\1", piece)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a formatted conversation at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[list] = []
    now = None

    def done(x: list) -> list:
        return [x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]]

    def table(rows: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PARSED.split(", ")])

    for batch in batches:
        for row in batch.to_pylist():
            if now is None or now[0] != row["conv_id"]:
                if now is not None:
                    rows.append(done(now))
                now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(row["formatted"]):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
            for span in row["loss"]:
                text = unescape(row["formatted"][span["start"] : span["end"]])
                now[3] += len(text)
                now[4].update(text.encode())
            now[5] += len(row["formatted"])
        if rows:
            yield table(rows)
            rows = []
    if now is not None:
        yield table([done(now)])


def read_chats(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from the output of ``format_chats`` (parts as they come, in order)."""
    return formatted.mapInArrow(_reader, PARSED)
