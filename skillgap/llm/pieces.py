"""SentencePiece encoding and decoding with merge-type vocabularies.

A text is cut where no merge can reach across, and each cut stretch is merged
by a score-ordered agenda of adjacent symbol pairs; short stretches are merged
side by side in numpy, one pair of each per round. Stretches repeat (they are
mostly words), so each worker keeps the results of short ones, up to a number of
bytes. In every Arrow batch, new stretches are checked against the sentencepiece
library, and so is every whole text, with what it decodes to.

Only vocabularies whose model file says byte-pair merging and the identity
normalizer are taken. Nulls are encoded as the empty text: no ids.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Kinds of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(b: bytes, i: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        x = b[i]
        i += 1
        value |= (x & 127) << shift
        shift += 7
        if x < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one protocol-buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class Vocabulary:
    """Pieces, scores and settings of a model file."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer: dict[int, object] = {}
        normalizer: dict[int, object] = {}
        for field, value in _fields(model):
            if field == 1:
                parts = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
                self.pieces.append(parts[1].decode())
                scores.append(struct.unpack("<f", parts[2])[0])
                self.kinds.append(parts[3])
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or normalizer.get(2, b"") or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only byte-pair models with the identity normalizer are supported")
        if any(k in (USER_DEFINED, UNUSED) for k in self.kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = SPACE if normalizer.get(3, 1) else ""
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        #: For the agenda: the highest score is the smallest number.
        self.order = {p: -scores[i] for p, i in self.ids.items()}
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.byte_of = {i: bytes([b]) for b, i in self.byte_ids.items()}
        if len(self.byte_ids) not in (0, 256):
            raise ValueError("byte pieces must be all there or none")
        # A merge that spans two characters needs a piece that holds the two in a row.
        pairs = {(p[i], p[i + 1]) for p in self.ids for i in range(len(p) - 1)}
        if any(y == SPACE and x != SPACE for x, y in pairs):
            self.stretches = None
        elif any("\n" in pair for pair in pairs):
            self.stretches = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        else:
            self.stretches = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n").findall

    def merge(self, text: str) -> list[str]:
        """The symbols left when no pair of neighbours is a piece any more.

        The agenda holds pairs of neighbours by score, then by place. A pair is
        stale if either side has been merged since it was put in.
        """
        symbols: list[str] = list(text)
        n = len(symbols)
        order = self.order
        agenda = []
        for i in range(n - 1):
            score = order.get(symbols[i] + symbols[i + 1])
            if score is not None:
                agenda.append((score, i, i + 1, len(symbols[i]) + len(symbols[i + 1])))
        if not agenda:
            return symbols
        heapq.heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            left, right = symbols[i], symbols[j]
            if not left or not right or len(left) + len(right) != size:
                continue
            symbols[i], symbols[j] = merged, _ = left + right, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                score = order.get(merged + symbols[k])
                if score is not None:
                    heapq.heappush(agenda, (score, i, k, size + len(symbols[k])))
            h = before[i]
            if h >= 0:
                score = order.get(symbols[h] + merged)
                if score is not None:
                    heapq.heappush(agenda, (score, h, i, size + len(symbols[h])))
        return [s for s in symbols if s]

    def stretch_ids(self, stretch: str) -> list[int]:
        ids: list[int] = []
        for symbol in self.merge(stretch):
            i = self.ids.get(symbol)
            if i is not None:
                ids.append(i)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in symbol.encode())
            else:
                ids.append(self.unknown)
        return ids

    def surface(self, ids: list[int]) -> str:
        """Ids as text, the mark of a space still in place."""
        out, held = [], b""
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                held += byte
                continue
            if held:
                out.append(_bytes_text(held))
                held = b""
            kind = self.kinds[i]
            out.append(" ⁇ " if kind == UNKNOWN else "" if kind == CONTROL else self.pieces[i])
        if held:
            out.append(_bytes_text(held))
        return "".join(out)


def _bytes_text(b: bytes) -> str:
    """UTF-8 text; each byte that belongs to no character becomes a replacement mark."""
    try:
        return b.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(b):
            for n in (1, 2, 3, 4):
                try:
                    out.append(b[i : i + n].decode())
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                n = 1
            i += n
        return "".join(out)


#: Put in front of a stretch that no mark of a space precedes.
_BARE = "\x01"
_LINE = _BARE + "\n"
#: Stretches up to this many characters are merged side by side.
_SIDE_BY_SIDE = 24
#: Stretches up to this many characters are remembered, and about as many bytes of them by a worker.
REMEMBERED_CHARS, REMEMBERED_BYTES = 64, 96 << 20
#: What a remembered stretch takes beside its characters: three strings and two entries.
_ENTRY = 400


class Codec:
    """Encodes and decodes whole texts; remembers short stretches as (ids as text, surface)."""

    def __init__(self, model: bytes, remembered: int = REMEMBERED_BYTES, library=None):
        self.vocabulary = v = Vocabulary(model)
        self._ids: dict[str, str] = {}
        self._surface: dict[str, str] = {}
        self._remembered, self._held = remembered, 0
        self._library = library
        self.wrong: list[str] = []
        self._spaced = bool(v.prefix) and v.stretches is not None and v.stretches("a\nb") == ["a", "\n", "b"]
        # Every way to put a piece together from two: (left, right) as one number, and the piece.
        made = {}
        for piece, i in v.ids.items():
            for cut in range(1, len(piece)):
                left, right = v.ids.get(piece[:cut]), v.ids.get(piece[cut:])
                if left is not None and right is not None:
                    made[left << 32 | right] = i
        self._pairs = np.array(sorted(made), np.int64)
        self._made = np.array([made[k] for k in sorted(made)], np.int32)
        distinct = {s: k for k, s in enumerate(sorted(set(v.order.values())))}
        self._rank = np.full(len(v.pieces), len(distinct), np.int32)
        for piece, i in v.ids.items():
            self._rank[i] = distinct[v.order[piece]]
        self._char = np.full(0x110000, -2, np.int32)
        for piece, i in v.ids.items():
            if len(piece) == 1:
                self._char[ord(piece)] = i
        self._decimal = [str(i) for i in range(len(v.pieces))]
        self._special = {v.unknown, *v.byte_of}
        # Looked up side by side: what an id says as a decimal and decoded, also as the last of its stretch.
        shown = [p if k == NORMAL else "" for p, k in zip(v.pieces, v.kinds)]
        self._end = next(c for c in map(chr, range(1, 0x110000)) if not any(c in p for p in shown))
        self._parts = [np.array(x, object) for x in (self._decimal, shown)]
        self._plain = np.array([k == NORMAL and i not in self._special for i, k in enumerate(v.kinds)])

    def _score(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of neighbouring symbols; the rank is _NONE where they make no piece."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        made = self._made[at]
        there = (self._pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(there, self._rank[made], _NONE), made

    def _merge_side_by_side(self, marked: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``Vocabulary.merge`` for many short stretches at once: ids in a row, and how many each has.

        The id -2 stands for a character without a piece.

        One row per stretch, one column per character. A round takes from each
        row's agenda the pair of best score, leftmost first, and puts the two
        new neighbours of the merged symbol in.
        """
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        rows, width = len(marked), int(lengths.max())
        symbols = np.full((rows, width + 1), -1, np.int32)
        place = np.arange(width + 1) < lengths[:, None]
        symbols[place] = self._char[np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)]
        after = np.tile(np.arange(1, width + 2, dtype=np.int16), (rows, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int16), (rows, 1))
        rank = np.full((rows, width), _NONE, np.int32)
        made = np.zeros((rows, width), np.int32)
        pairs = place[:, 1:]
        r, c = np.nonzero(pairs)
        rank[r, c], made[r, c] = self._score(symbols[r, c], symbols[r, c + 1])
        open_ = np.arange(rows)
        while len(open_):
            part = rank if len(open_) == rows else rank[open_]
            i = part.argmin(axis=1)
            going = part[np.arange(len(open_)), i] != _NONE
            open_, i = open_[going], i[going]
            if not len(open_):
                break
            j = after[open_, i].astype(np.int64)
            symbols[open_, i] = made[open_, i]
            symbols[open_, j] = -1
            k = after[open_, j].astype(np.int64)
            after[open_, i] = k
            rank[open_, i] = _NONE
            inside = j < width
            rank[open_[inside], j[inside]] = _NONE
            right = k < lengths[open_]
            o, x, y = open_[right], i[right], k[right]
            before[o, y] = x
            rank[o, x], made[o, x] = self._score(symbols[o, x], symbols[o, y])
            h = before[open_, i].astype(np.int64)
            left = h >= 0
            o, x, y = open_[left], h[left], i[left]
            rank[o, x], made[o, x] = self._score(symbols[o, x], symbols[o, y])
        alive = symbols[:, :width] != -1
        return symbols[:, :width][alive], alive.sum(axis=1)

    def _entry(self, ids: list[int]) -> tuple[str, str]:
        pieces, decimal = self.vocabulary.pieces, self._decimal
        if not self._special.isdisjoint(ids):
            surface = self.vocabulary.surface(ids)
        else:
            surface = "".join([pieces[i] for i in ids])
        return ",".join([decimal[i] for i in ids]), surface

    def _learn(self, keys: set[str]) -> None:
        """Merge stretches not met so far and check them against the library."""
        few: list[str] = []
        for key in keys:
            if len(key) <= REMEMBERED_CHARS:
                few.append(key)
            else:
                self._learn_some([key])
        self._held += self._learn_some(few)

    def _learn_some(self, keys_: list[str]) -> int:
        """Learn stretches; about the bytes that they take."""
        marked = [key[1:] if key[:1] == _BARE else SPACE + key for key in keys_]
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        order = np.argsort(lengths, kind="stable")
        # The library sees no empty stretch, so that one is not compared.
        short = [n for n in order[(lengths[order] > 0) & (lengths[order] <= _SIDE_BY_SIDE)].tolist() if keys_[n]]
        held = 0
        for start in range(0, len(short), 20_000):
            some = short[start : start + 20_000]
            held += self._learn_short([keys_[n] for n in some], [marked[n] for n in some])
        singly = set(range(len(keys_))).difference(short)
        return held + self._learn_singly([(keys_[n], marked[n]) for n in singly])

    def _learn_short(self, keys_: list[str], marked: list[str]) -> int:
        """Stretches that are merged side by side; those with an id that is no plain piece, singly."""
        flat, counts = self._merge_side_by_side(marked)
        ends = np.cumsum(counts)
        odd = np.flatnonzero(~((flat >= 0) & self._plain[flat]))
        odd_rows = set(np.searchsorted(ends, odd, "right").tolist())
        if odd_rows:
            kept = np.ones(len(keys_), bool)
            kept[list(odd_rows)] = False
            flat, counts = flat[np.repeat(kept, counts)], counts[kept]
            ends = np.cumsum(counts)
        plain = [n for n in range(len(keys_)) if n not in odd_rows] if odd_rows else range(len(keys_))
        keys_of = [keys_[n] for n in plain]
        held = self._learn_singly([(keys_[n], marked[n]) for n in odd_rows])
        if not keys_of:
            return held
        decimals, surfaces = (self._rows(part, flat, ends, between) for part, between in zip(self._parts, (",", "")))
        self._ids.update(zip(keys_of, decimals))
        self._surface.update(zip(keys_of, surfaces))
        if self._library is not None:
            wanted = self._wanted(keys_of)
            same = np.array_equal(np.fromiter(map(len, wanted), np.int64, len(wanted)), counts)
            if not same or not np.array_equal(np.fromiter(itertools.chain.from_iterable(wanted), np.int64, len(flat)), flat):
                self.wrong += [k for k, want in zip(keys_of, wanted) if ",".join(map(str, want)) != self._ids[k]]
        sizes = sum(map(len, keys_of)) + sum(map(len, decimals)) + 4 * sum(map(len, surfaces))
        return held + sizes + _ENTRY * len(keys_of)

    def _rows(self, part: np.ndarray, flat: np.ndarray, ends: np.ndarray, between: str) -> list[str]:
        """What the ids of each stretch say, with ``between`` between them: one text for all, cut at the ends."""
        marks = np.full(len(flat), between, object)
        marks[ends - 1] = self._end
        both = np.empty(2 * len(flat), object)
        both[::2], both[1::2] = part[flat], marks
        return "".join(both.tolist()).split(self._end)[:-1]

    def _learn_singly(self, stretches: list[tuple[str, str]]) -> int:
        held = 0
        for key, marked in stretches:
            ids = self.vocabulary.stretch_ids(marked)
            decimals, surface = self._ids[key], self._surface[key] = self._entry(ids)
            held += len(key) + len(decimals) + 4 * len(surface) + _ENTRY
        if self._library is not None and stretches:
            keys_ = [key for key, _ in stretches]
            self.wrong += [k for k, want in zip(keys_, self._wanted(keys_)) if k and ",".join(map(str, want)) != self._ids[k]]
        return held

    def _wanted(self, keys_: list[str]) -> list[list[int]]:
        """The library's ids of stretches; one without a mark of its own is put behind a line end, which takes no part in a merge."""
        found = self._library.encode(["\n" + k[1:] if k[:1] == _BARE else k for k in keys_], num_threads=1)
        return [ids[2:] if k[:1] == _BARE else ids for k, ids in zip(keys_, found)]

    def _forget(self, keys: set[str]) -> None:
        """Drop the long ones among ``keys``, and all of them if too much is held."""
        if self._held > self._remembered:
            self._ids, self._surface, self._held = {}, {}, 0
        else:
            for key in keys:
                if len(key) > REMEMBERED_CHARS:
                    del self._ids[key], self._surface[key]

    def _keys(self, text: str) -> list[str] | None:
        """The text as stretches, or None if it isn't made of words with single spaces between them."""
        if not self._spaced or "  " in text or SPACE in text or _BARE in text or text[0] == " ":
            return None
        if "\n" in text:
            text = text.replace("\n", f" {_LINE} {_BARE}")
        return text.split(" ")

    def encode_all(self, texts: list[str]) -> list[tuple[str, str]]:
        """Each text's ids, as decimals with commas between them, and what they decode to."""
        cut = [self._keys(t) if t else None for t in texts]
        known = self._ids
        new = {key for keys in cut if keys for key in keys if key not in known}
        if new:
            self._learn(new)
        out = []
        for t, keys in zip(texts, cut):
            if not t:
                out.append(("", ""))
            elif keys is None:
                v = self.vocabulary
                marked = v.prefix + t.replace(" ", SPACE)
                ids: list[int] = []
                for stretch in v.stretches(marked) if v.stretches else [marked]:
                    ids.extend(v.stretch_ids(stretch))
                if self._library is not None and ids != self._library.encode(t):
                    self.wrong.append(t)
                out.append((",".join(map(str, ids)), self._shown(v.surface(ids))))
            else:
                ids_text = ",".join(filter(None, map(self._ids.__getitem__, keys)))
                out.append((ids_text, self._shown("".join(map(self._surface.__getitem__, keys)))))
        if new:
            self._forget(new)
        return out

    def _shown(self, surface: str) -> str:
        if self.vocabulary.prefix and surface.startswith(SPACE):
            surface = surface[1:]
        return surface.replace(SPACE, " ")

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_all([text])[0][0].split(",") if i]

    def decode(self, ids: list[int]) -> str:
        return self._shown(self.vocabulary.surface(ids))


_NONE = np.int32(2**31 - 1)
_codecs: dict[bytes, Codec] = {}


def _codec(model: bytes) -> Codec:
    """The codec of this worker."""
    import sentencepiece

    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs.clear()
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        _codecs[key] = Codec(model, library=library)
    return _codecs[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


#: Texts, and characters, whose words are looked up together; bounds memory, not what is done.
_AT_ONCE, _CHARS_AT_ONCE = 256, 500_000


def _runs(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts a few at a time; a longer one alone."""
    start, held, size = 0, [], 0
    for value in column:
        t = value.as_py() or ""
        if held and (len(held) == _AT_ONCE or size + len(t) > _CHARS_AT_ONCE):
            yield start, held
            start, held, size = start + len(held), [], 0
        held.append(t)
        size += len(t)
    if held:
        yield start, held


def encode_batches(model: bytes, text: str, keep: bool, whole: bool):
    """The function for ``mapInArrow``; every text is compared with the library, whatever ``whole`` is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        decimal = codec._decimal.__getitem__
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            kept = [(f.name, c) for f, c in zip(batch.schema, batch.columns) if f.name != text]
            for start, texts in _runs(column):
                rows: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
                ids_column, decoded_column = [], []
                for t, (ids, decoded) in zip(texts, codec.encode_all(texts)):
                    rows["n_tokens"].append(ids.count(",") + 1 if ids else 0)
                    rows["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                    rows["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                    check = codec._library.encode(t)
                    if ids != ",".join(map(decimal, check)) or decoded != codec._library.decode(check):
                        codec.wrong.append(t)
                    if keep:
                        ids_column.append(np.array(ids.split(",") if ids else [], np.int32))
                        decoded_column.append(decoded)
                if codec.wrong:
                    raise ValueError(f"ids differ from the library's for {codec.wrong[0][:200]!r}")
                arrays = [c.slice(start, len(texts)) for _, c in kept] + [pa.array(v) for v in rows.values()]
                names = [n for n, _ in kept] + list(rows)
                if keep:
                    arrays += [pa.array(ids_column, pa.list_(pa.int32())), pa.array(decoded_column, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def encode_pieces(
    df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", keep: bool = True, whole: bool = False
) -> DataFrame:
    """``key``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, with ``keep``, ``ids`` and ``decoded``.

    One row per row of ``df``, repeated rows and null keys too; other columns
    are left out. A null or empty text has no ids. Each stretch that a worker
    meets for the first time is checked against the library, and so is each whole text
    with its decoded form, also without ``whole``; a difference ends the job.
    """
    schema = df.select(key).schema.simpleString()[7:-1] + ", n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep:
        schema += ", ids array<int>, decoded string"
    return df.select(key, text).mapInArrow(encode_batches(read_model(model_path), text, keep, whole), schema)
