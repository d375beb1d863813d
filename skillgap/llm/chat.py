"""Chat formatting by columnar byte assembly, and reading it back.

A turn is written as ``### role:``, a line end, the text, a line end and
``</turn>`` with a line end. Inside roles and texts a backslash becomes two, and
the control strings are broken up: a ``#`` with two more behind it becomes
``\\h``, the ``<`` of ``</turn>`` becomes ``\\l``; in roles also a colon ``\\c`` and a line end
``\\n``. Nothing else is changed, so a text comes back exactly.

Conversations are gathered by a sort, not as lists: a task reads turns in order
and writes each conversation as one row, or as several parts of whole turns when
it has more than ``part_bytes``. For a batch of turns, lengths of all segments are added up to
offsets, and one scatter per kind of segment copies headers, texts and ends
into one preallocated buffer, which becomes the Arrow column. Indices are made for
``SLICE`` bytes at a time, so beside the texts and the buffer little is held.

Turns go by (turn, role, text), nulls first. Null texts and roles count as
empty; turns whose id is null are one conversation. Repeated rows are repeated turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, BREAK, END = "### ", ":\n", "\n</turn>\n"
PART_BYTES = 4_000_000
#: Bytes that indices are made for at a time; a longer stretch is copied as it is.
SLICE = 1_000_000
_SHOWN = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c", "\n": "\\n"}
_HIDDEN = {v[1]: k for k, v in _SHOWN.items()}
_in_text = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_in_role = re.compile(r"\\|#(?=##)|<(?=/turn>)|:|\n")
_shown = re.compile(r"\\(.)")


def escape(text: str, role: bool = False) -> str:
    return (_in_role if role else _in_text).sub(lambda m: _SHOWN[m[0]], text)


def unescape(text: str) -> str:
    return _shown.sub(lambda m: _HIDDEN[m[1]], text) if "\\" in text else text


def _escaped(column: pa.Array) -> pa.Array:
    """Texts with the few that need it escaped."""
    column = pc.fill_null(column, "")
    needs = pc.or_(pc.or_(pc.match_substring(column, "\\"), pc.match_substring(column, "###")), pc.match_substring(column, "</turn>"))
    if not pc.any(needs).as_py():
        return column
    changed = [escape(t) for t in column.filter(needs).to_pylist()]
    return pc.replace_with_mask(column, needs, pa.array(changed, pa.string()))


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), cuts


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copy each stretch of ``data`` to its place in ``out``."""
    ends = np.cumsum(length)
    at = 0
    while at < len(length):
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + SLICE, "right")))
        if upto == at + 1:
            out[to[at] : to[at] + length[at]] = data[start[at] : start[at] + length[at]]
        else:
            n = length[at:upto]
            before = np.cumsum(n) - n
            step = np.arange(n.sum())
            out[step + np.repeat(to[at:upto] - before, n)] = data[step + np.repeat(start[at:upto] - before, n)]
        at = upto


def _points_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points before each of the places ``at``, which are in order."""
    found = np.zeros(len(at), np.int64)
    before = 0
    for lo in range(0, len(data) + 1, SLICE):
        begins = np.cumsum((data[lo : lo + SLICE] & 0xC0) != 0x80, dtype=np.int64)
        some = slice(*np.searchsorted(at, [lo, lo + SLICE]))
        found[some] = before + np.append(0, begins)[at[some] - lo]
        before += int(begins[-1]) if len(begins) else 0
    return found


def assemble(roles: pa.Array, texts: pa.Array, groups: np.ndarray) -> tuple[pa.Array, list, np.ndarray]:
    """One string per group of consecutive turns, the spans under the loss mask, and lengths in code points.

    ``groups`` holds the first turn of each group. Spans are code points from
    the string's start, of the texts of turns by the assistant.
    """
    names = roles.dictionary_encode()
    headers = [HEAD + escape(r or "", True) + BREAK for r in names.dictionary.to_pylist()] + [HEAD + BREAK]
    head_data, head_cuts = _buffers(pa.array(headers, pa.string()))
    which = pc.fill_null(names.indices, len(headers) - 1).to_numpy()
    text_data, text_cuts = _buffers(_escaped(texts))
    end = np.frombuffer(END.encode(), np.uint8)
    lengths = np.stack([np.diff(head_cuts)[which], np.diff(text_cuts), np.full(len(which), len(end))], axis=1)
    offsets = np.concatenate([[0], np.cumsum(lengths.ravel())])
    place = offsets[:-1].reshape(lengths.shape)
    out = np.empty(offsets[-1], np.uint8)
    _scatter(out, place[:, 0], head_data, head_cuts[which], lengths[:, 0])
    _scatter(out, place[:, 1], text_data, text_cuts[:-1], lengths[:, 1])
    _scatter(out, place[:, 2], end, np.zeros(len(which), np.int64), lengths[:, 2])
    cuts = np.append(offsets[::3][groups], offsets[-1])
    # Places whose code points count: where each text begins and ends, and each group begins.
    marks = np.concatenate([place[:, 1], place[:, 1] + lengths[:, 1], cuts])
    order = np.argsort(marks, kind="stable")
    points = np.empty(len(marks), np.int64)
    points[order] = _points_before(out, marks[order])
    first, last, bounds = points[: len(which)], points[len(which) : 2 * len(which)], points[2 * len(which) :]
    column = pa.StringArray.from_buffers(len(groups), pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(out))
    assistant = np.array([r == "assistant" for r in names.dictionary.to_pylist()] + [False])[which]
    owner = np.searchsorted(groups, np.arange(len(which)), "right") - 1
    base = bounds[:-1][owner]
    first, last = first - base, last - base
    spans: list[list[dict]] = [[] for _ in groups]
    for g, a, b in zip(owner[assistant].tolist(), first[assistant].tolist(), last[assistant].tolist()):
        spans[g].append({"start": a, "end": b})
    return column, spans, np.diff(bounds)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _same(ids: pa.Array) -> np.ndarray:
    """Whether each id but the first is that before it; null is a value."""
    if len(ids) < 2:
        return np.zeros(0, bool)
    a, b = ids.slice(0, len(ids) - 1), ids.slice(1)
    equal = pc.fill_null(pc.equal(a, b), False)
    return pc.or_(equal, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _made(turns: pa.Table, part: int, part_bytes: int) -> tuple[pa.RecordBatch, int]:
    """Formatted rows of turns in order, the first conversation from ``part`` on; the part after the last."""
    ids, roles, texts = (pa.concat_arrays(turns.column(i).chunks) for i in range(3))
    new = np.concatenate([[True], ~_same(ids)])
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    number = (size - np.where(first > 0, size[first - 1], 0)) // part_bytes
    cut = new.copy()
    cut[1:] |= number[1:] != number[:-1]
    groups = np.flatnonzero(cut)
    of = np.cumsum(new)[groups]
    parts = np.arange(len(groups)) - np.searchsorted(of, of)
    parts[of == 1] += part
    column, spans, points = assemble(roles, texts, groups)
    arrays = [ids.take(pa.array(groups)), pa.array(parts, pa.int64()), column, pa.array(spans, _SPANS), pa.array(points, pa.int64())]
    names = ["conv_id", "part", "formatted", "loss", "n_chars"]
    return pa.RecordBatch.from_arrays(arrays, names=names), int(parts[-1]) + 1


def _format(part_bytes: int):
    """The function for ``mapInArrow`` over turns in order; holds one part of one conversation at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        part, going = 0, None  # the next part of the conversation that goes on, and its last turn's id
        for batch in batches:
            if not batch.num_rows:
                continue
            turns = pa.Table.from_batches([batch])
            if held is None:
                if going is None or not _same(pa.concat_arrays([going, batch.column(0).slice(0, 1)]))[0]:
                    part = 0
                held = turns
            else:
                held = pa.concat_tables([held, turns])
            change = np.flatnonzero(~_same(pa.concat_arrays(held.column(0).chunks)))
            if len(change):
                cut = int(change[-1]) + 1
                yield _made(held.slice(0, cut), part, part_bytes)[0]
                held, part = held.slice(cut), 0
            if held.nbytes > part_bytes:
                out, part = _made(held, part, part_bytes)
                yield out
                going = held.column(0).chunks[-1].slice(len(held.column(0).chunks[-1]) - 1)
                held = None
        if held is not None:
            yield _made(held, part, part_bytes)[0]

    return run


_FORMATTED = "conv_id long, part long, formatted string, loss array<struct<start: bigint, end: bigint>>, n_chars long"


def format_chats(turns: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``conv_id``, ``part``, ``formatted``, ``loss`` (spans in code points) and ``n_chars`` from (conv_id, turn, role, text).

    The parts of a conversation, in order, are its formatted text. Other columns are left out.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", F.col("turn").cast("long").alias("turn"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format(part_bytes), _FORMATTED)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    out = []
    for turn in formatted.split(END)[:-1]:
        role, _, text = turn[len(HEAD) :].partition(BREAK)
        out.append((unescape(role), unescape(text)))
    return out


_READ = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order; one row per conversation."""
    nothing = object()
    now, rows = nothing, []
    n_turns = loss_chars = chars = 0
    turns = loss = hashlib.sha256()

    def row() -> tuple:
        return now, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)

    for batch in batches:
        for conv, formatted, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if conv != now:
                if now is not nothing:
                    rows.append(row())
                now, n_turns, loss_chars, chars = conv, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            text = formatted.as_py()
            chars += len(text)
            for role, said in turns_of(text):
                n_turns += 1
                turns.update(f"{role}\n{said}\n".encode())
            for span in spans.as_py():
                said = unescape(text[span["start"] : span["end"]])
                loss_chars += len(said)
                loss.update(said.encode())
        if rows:
            yield out()
            rows.clear()
    if now is not nothing:
        rows.append(row())
        yield out()


def read_chats(formatted: DataFrame) -> DataFrame:
    """Per conversation: turns and a digest of them, characters and a digest of the text under the loss mask, and length."""
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return dealt.select("conv_id", "formatted", "loss").mapInArrow(_read_back, ddl)
