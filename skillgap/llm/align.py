"""Alignment of two tokenizers over the same bytes, by pointer jumping.

A text with a space in front is cut twice: into the tokens of a byte-level
vocabulary (A) and into the pieces of a merge vocabulary (B). Every token points
to the token farthest to the right that overlaps it; doubling the pointers
until they stand still takes each token to the last one of its component, and
that names the group. All texts of a slice are laid end to end and go through
the same few numpy steps.

Counts of id pairs over the whole corpus are needed for each link of each
document. Documents are packed into chunks of bounded text; a chunk holds its
distinct pairs once and each document's links as places in them. So what is
shuffled is a row per chunk and distinct pair, however often a pair occurs, and
a pair found in every document is no larger a key than the number of chunks.
A chunk is many short rows, a block of documents each, and one of its pairs, so
that neither a worker nor the JVM has to hold one in a piece.

Texts that are null, empty, or whose tokens do not add up to the space and the
text in either vocabulary have no tokens: empty lists, zeros and an empty digest.
Strings of special tokens inside a text are plain text. Repeated rows and null
keys give a row each; other columns are left out; an empty table gives no rows.
A text of any length is taken whole; it is then a block of its own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skillgap.llm.pieces import BYTE, NORMAL, SPACE, Vocabulary
from skillgap.sources.scratch import materialize

#: Splits text before the merges of the byte-level vocabulary (fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts worked on together, and texts of one chunk, in characters.
SLICE, CHUNK = 200_000, 4_000_000
#: Runs of white space of this length go to the slower of the two libraries, whose pattern does not recurse.
_WIDE = re.compile(r"\s{500}")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible, else one above 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class ByteTokens:
    """Ids of a byte-level vocabulary file (JSON)."""

    def __init__(self, file: bytes):
        self._file = file
        letters = _byte_letters()
        model = json.loads(file)["model"]
        specials = {x["id"] for x in json.loads(file)["added_tokens"]}
        entries = sorted((i, word) for word, i in model["vocab"].items() if i not in specials)
        self.bytes = {i: bytes(letters[c] for c in word) for i, word in entries}
        import tiktoken

        ranks = {b: i for i, b in self.bytes.items()}
        # Merging by the smallest id is merging by the order of merges only where the two orders are one.
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        in_order = [i for i, _ in entries][-len(merged):] == [model["vocab"][m] for m in merged] if merged else True
        self._fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_order else None
        self._slow = None

    def _library(self):
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self._file.decode())
            self._slow.encode_special_tokens = True
        return self._slow

    def encode(self, text: str) -> list[int]:
        if self._fast is None or _WIDE.search(text):
            return self._library().encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)


class PieceTokens:
    """Ids of a merge vocabulary with byte pieces."""

    def __init__(self, file: bytes):
        import sentencepiece

        self._library = sentencepiece.SentencePieceProcessor(model_proto=file)
        own = Vocabulary(file)
        self.bytes: dict[int, bytes] = {}
        for i, (piece, kind) in enumerate(zip(own.pieces, own.kinds)):
            if kind == BYTE:
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif kind == NORMAL:
                self.bytes[i] = piece.replace(SPACE, " ").encode()

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return self._library.encode(texts, num_threads=1)


@dataclass
class Alignment:
    """Tokens of several texts end to end; ``a_first[d]`` is where text d's begin."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_first: np.ndarray
    b_first: np.ndarray
    a_group: np.ndarray  # numbered through all texts
    b_group: np.ndarray
    link_a: np.ndarray  # places of the linked tokens, in order
    link_b: np.ndarray

    def per_text(self, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many of the sorted places ``at`` lie in each text."""
        return np.diff(np.searchsorted(at, first, "left"))


def components(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of two tilings of the same bytes, given where their tokens end."""
    n, m = len(a_end), len(b_end)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    over = np.searchsorted(b_end, a_end, "left")
    back = np.searchsorted(a_end, b_end, "left")
    last = np.arange(n, n + m)
    succ = np.concatenate([over + n, np.where(a_end[back] > b_end, back, last)])
    while True:
        further = succ[succ]
        if np.array_equal(further, succ):
            break
        succ = further
    number = np.cumsum(succ[n:] == last) - 1
    return number[succ[:n] - n], number[succ[n:] - n]


class Aligner:
    """Both vocabularies of a worker."""

    def __init__(self, byte_file: bytes, piece_file: bytes):
        self.a, self.b = ByteTokens(byte_file), PieceTokens(piece_file)
        self._a_size, self._b_size = self._sizes(self.a.bytes), self._sizes(self.b.bytes)
        self._shown = (self._decimals(self._a_size, (b",", b"|")), self._decimals(self._b_size, (b",", b";", b"")))

    @staticmethod
    def _sizes(tokens: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(max(tokens, default=0) + 1, np.int64)
        out[list(tokens)] = [len(b) for b in tokens.values()]
        return out

    @staticmethod
    def _decimals(size: np.ndarray, ends: tuple[bytes, ...]) -> np.ndarray:
        return np.array([b"%d%s" % (i, end) for end in ends for i in range(len(size))], object)

    def align(self, texts: list[str | None]) -> Alignment:
        a_lists, b_lists = [], self.b.encode_all([t or "" for t in texts])
        get_a, get_b = self.a.bytes.get, self.b.bytes.get
        for d, t in enumerate(texts):
            a: list[int] = []
            if t:
                a, want = self.a.encode(" " + t), b" " + t.encode()
                if b"".join([get_a(i, b"") for i in a]) != want or b"".join([get_b(i, b"") for i in b_lists[d]]) != want:
                    a = []
            if not a:
                b_lists[d] = []
            a_lists.append(a)
        a_first = np.concatenate([[0], np.cumsum([len(x) for x in a_lists], dtype=np.int64)])
        b_first = np.concatenate([[0], np.cumsum([len(x) for x in b_lists], dtype=np.int64)])
        a_ids = np.fromiter(chain.from_iterable(a_lists), np.int64, int(a_first[-1]))
        b_ids = np.fromiter(chain.from_iterable(b_lists), np.int64, int(b_first[-1]))
        a_end, b_end = np.cumsum(self._a_size[a_ids]), np.cumsum(self._b_size[b_ids])
        a_group, b_group = components(a_end, b_end)
        # Each stretch between two neighbouring ends lies in one token of either side: the stretches are the links.
        ends = np.sort(np.concatenate([a_end, b_end]), kind="stable")
        ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
        link_a, link_b = np.searchsorted(a_end, ends, "left"), np.searchsorted(b_end, ends, "left")
        return Alignment(a_ids, b_ids, a_first, b_first, a_group, b_group, link_a, link_b)

    def digests(self, x: Alignment) -> list[str]:
        """SHA-256 of each text's groups written out; '' for a text without tokens."""
        n, m = len(x.a_ids), len(x.b_ids)
        out = np.empty(n + m, object)
        if n:
            a_last = np.append(x.a_group[1:] != x.a_group[:-1], True)
            b_last = np.append(x.b_group[1:] != x.b_group[:-1], True).astype(np.int64)
            ends = x.b_first[1:][np.diff(x.b_first) > 0] - 1
            b_last[ends] = 2
            shown_a, shown_b = self._shown
            out[np.arange(n) + np.searchsorted(x.b_group, x.a_group, "left")] = shown_a[a_last * len(self._a_size) + x.a_ids]
            out[np.arange(m) + np.searchsorted(x.a_group, x.b_group, "right")] = shown_b[b_last * len(self._b_size) + x.b_ids]
        first = (x.a_first + x.b_first).tolist()
        return [hashlib.sha256(b"".join(out[lo:hi].tolist())).hexdigest() if hi > lo else "" for lo, hi in zip(first, first[1:])]


_aligners: dict[bytes, Aligner] = {}


def _aligner(byte_file: bytes, piece_file: bytes) -> Aligner:
    """The aligner of this worker."""
    key = hashlib.sha256(byte_file + piece_file).digest()
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(byte_file, piece_file)
    return _aligners[key]


def read_file(path: str) -> bytes:
    """A vocabulary file, read on the driver and shipped to the tasks."""
    with open(path, "rb") as f:
        return f.read()


def _slices(batch: pa.RecordBatch, text: int, most: int) -> Iterator[tuple[int, list]]:
    """Runs of rows with about ``most`` characters of text; a longer text is a run of its own."""
    start, held, size = 0, [], 0
    for value in batch.column(text):
        t = value.as_py()
        if held and size + len(t or "") > most:
            yield start, held
            start, held, size = start + len(held), [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield start, held


def _tokens(byte_file: bytes, piece_file: bytes):
    """The function for ``mapInArrow`` over (key, text): ids and groups per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_file, piece_file)
        for batch in batches:
            for start, texts in _slices(batch, 1, SLICE):
                x = aligner.align(texts)
                # Groups are numbered through the slice; a text's own begin at 0.
                begun = np.append(x.a_group, 0)[np.minimum(x.a_first[:-1], len(x.a_group))] if len(x.a_ids) else np.zeros(len(texts), np.int64)
                a_own = x.a_group - np.repeat(begun, np.diff(x.a_first))
                b_own = x.b_group - np.repeat(begun, np.diff(x.b_first))
                arrays = [batch.column(0).slice(start, len(texts))]
                for first, values in ((x.a_first, x.a_ids), (x.b_first, x.b_ids), (x.a_first, a_own), (x.b_first, b_own)):
                    arrays.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "a_ids", "b_ids", "a_group", "b_group"])

    return run


def align_tokens(df: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ids of both vocabularies (``a_ids``, ``b_ids``) and each token's group, numbered from 0 per row."""
    kind = df.schema[key].dataType.simpleString()
    run = _tokens(read_file(byte_path), read_file(piece_path))
    found = df.select(F.col(key).alias("key"), text).mapInArrow(
        run, f"key {kind}, a_ids array<int>, b_ids array<int>, a_group array<int>, b_group array<int>"
    )
    return found.withColumnRenamed("key", key)


_CHUNK = (
    "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, first array<int>, at array<int>, times array<int>, pairs array<long>, n array<long>"
)


class _Pairs:
    """Distinct id pairs of a chunk, in places by first occurrence, and how often each is linked."""

    def __init__(self):
        self.n = np.zeros(0, np.int64)
        self._sorted, self._place = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, pairs: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Places of sorted distinct pairs that occur ``n`` times more."""
        at = np.searchsorted(self._sorted, pairs)
        known = np.zeros(len(pairs), bool)
        inside = at < len(self._sorted)
        known[inside] = self._sorted[at[inside]] == pairs[inside]
        place = np.empty(len(pairs), np.int64)
        place[known] = self._place[at[known]]
        place[~known] = np.arange(len(self.n), len(self.n) + len(pairs) - known.sum())
        self._sorted, self._place = np.insert(self._sorted, at[~known], pairs[~known]), np.insert(self._place, at[~known], place[~known])
        self.n = np.append(self.n, np.zeros(len(self._sorted) - len(self.n), np.int64))
        self.n[place] += n
        return place

    def listed(self) -> np.ndarray:
        out = np.empty_like(self._sorted)
        out[self._place] = self._sorted
        return out


def _chunks(byte_file: bytes, piece_file: bytes, most: int):
    """The function for ``mapInArrow`` over (doc_id, text): rows of a chunk's blocks of documents, then one of its pairs."""
    names, kinds = zip(*(c.split() for c in _CHUNK.split(", ")))
    to_arrow = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}

    def row(**own) -> pa.RecordBatch:
        arrays = [pa.array([own.get(name)], to_arrow[kind]) for name, kind in zip(names, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_file, piece_file)
        context = TaskContext.get()
        number = context.partitionId() << 32 if context else 0
        pairs, size, docs_held = _Pairs(), 0, 0
        for batch in batches:
            for start, texts in _slices(batch, 1, min(SLICE, most)):
                x = aligner.align(texts)
                n_a, n_b = np.diff(x.a_first), np.diff(x.b_first)
                n_links = x.per_text(x.link_a, x.a_first)
                groups = np.where(n_a > 0, n_a + n_b - n_links, 0)
                distinct, place, n = np.unique(x.a_ids[x.link_a] << 32 | x.b_ids[x.link_b], return_inverse=True, return_counts=True)
                # A document's links with the same pair are one entry.
                width = max(1, len(distinct))
                entry, times = np.unique(np.repeat(np.arange(len(texts)), n_links) * width + place.ravel(), return_counts=True)
                first = np.searchsorted(entry, np.arange(len(texts) + 1) * width)
                at = pairs.add(distinct, n)[entry % width]
                yield row(
                    chunk=number, doc_id=batch.column(0).slice(start, len(texts)).to_pylist(), n_a=n_a, n_b=n_b, n_groups=groups,
                    n_links=n_links, groups_sha256=aligner.digests(x), first=first, at=at, times=times,
                )
                docs_held += len(texts)
                size += sum(len(t or "") for t in texts)
                # Empty texts are rows as well.
                if size >= most or docs_held >= most // 100:
                    yield row(chunk=number, pairs=pairs.listed(), n=pairs.n)
                    pairs, size, docs_held, number = _Pairs(), 0, 0, number + 1
        if docs_held:
            yield row(chunk=number, pairs=pairs.listed(), n=pairs.n)

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each block, with the corpus counts of their pairs added up; a chunk's counts come before its blocks."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    total = best = np.zeros(0, np.int64)
    for batch in batches:
        for row in range(batch.num_rows):
            own = {name: batch.column(i)[row].values for i, name in enumerate(batch.schema.names) if name != "chunk"}
            if own["total"] is not None:
                total, best = own["total"].to_numpy().copy(), own["best"].to_numpy(zero_copy_only=False)
                continue
            first, at, times = (own[k].to_numpy() for k in ("first", "at", "times"))
            # Blocks of a chunk without pairs have no links.
            count = np.concatenate([[0], np.cumsum(total[at] * times)])
            chosen = np.concatenate([[0], np.cumsum(best[at] * times.astype(np.int64))])
            own["count_sum"] = pa.array(count[first[1:]] - count[first[:-1]], pa.int64())
            own["n_best"] = pa.array(chosen[first[1:]] - chosen[first[:-1]], pa.int64())
            yield pa.RecordBatch.from_arrays([own[n] for n in names], names=names)


def alignment_chunks(df: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Aligned documents in chunks, written once; see ``pair_counts`` and ``alignment_report``.

    A row is a block of documents, with no ``pairs`` and ``n``, or a chunk's pairs, with nothing else.
    """
    run = _chunks(read_file(byte_path), read_file(piece_path), chunk)
    return materialize(df.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(run, _CHUNK), "aligned")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``pair`` (A id above 32 bits of B id), ``total`` links of it in the corpus, and whether that is its B id's most."""
    each = chunks.select(F.inline(F.arrays_zip("pairs", "n")).alias("pair", "n"))
    totals = each.groupBy("pair").agg(F.sum("n").alias("total"))
    # A B id has as many rows here as vocabulary A has ids at most.
    most = F.max("total").over(W.partitionBy(F.col("pair").bitwiseAND((1 << 32) - 1)))
    return totals.select("pair", "total", (F.col("total") == most).alias("best"))


def alignment_report(df: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per row: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``.

    ``n_best`` counts links whose id pair is linked most often of all pairs with that B id in the whole
    corpus, ties included; ``count_sum`` adds up the corpus counts of the links' pairs.
    """
    chunks = alignment_chunks(df, byte_path, piece_path, key, text, chunk)
    each = chunks.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    told = each.join(pair_counts(chunks), "pair").groupBy("chunk").agg(
        F.array_sort(F.collect_list(F.struct("place", "total", "best"))).alias("told")
    )
    blocks = chunks.filter(F.col("doc_id").isNotNull()).drop("pairs", "n")
    # What is told to a chunk comes once, in front of its blocks.
    both = told.select("chunk", F.col("told.total").alias("total"), F.col("told.best").alias("best")).unionByName(
        blocks, allowMissingColumns=True
    )
    laid = both.repartition("chunk").sortWithinPartitions("chunk", F.col("total").isNull())
    return laid.mapInArrow(
        _sums, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
