"""Quality of a text by a convolutional network over its bytes, in numpy.

A byte is looked up in a learnt table; filters of ``WIDTH`` bytes, one every
``STRIDE`` bytes, run over the whole text. The places are taken in chunks that
overlap, each filter's largest answer in a chunk is kept, and the chunks' mean
and maximum go through one layer to a probability. Every byte of a text is
covered; a text of any length is scored in pieces of bounded size.

The network is fitted on a bounded sample of the labelled rows: the
``FIT_ROWS`` smallest by hash of each label, of each text at most
``FIT_CHUNKS`` chunks evenly spread over it. So the fit takes the same
memory and time at every size. It is the same on every run over the same rows.

Null and empty texts are scored like a text of padding only. If only one label
was learnt, every score is that label. Repeated rows and null ids give a row
each; conflicting labels of one id are all learnt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 8
WIDTH = 8
STRIDE = 4
FILTERS = 24
#: Places in a chunk, and from one chunk's start to the next one's.
CHUNK, HOP = 128, 112
FIT_ROWS = 1500
FIT_CHUNKS = 8
EPOCHS = 12
THRESHOLD = 0.3
#: Bytes scored at once.
PIECE = 1 << 20
PAD = 256


def _padded(data: np.ndarray) -> np.ndarray:
    """Bytes with padding to whole strides, and at least one filter's width."""
    n = max(WIDTH, -(-len(data) // STRIDE) * STRIDE + WIDTH - STRIDE)
    out = np.full(n, PAD, np.int16)
    out[: len(data)] = data
    return out


def _chunks(places: int) -> list[tuple[int, int]]:
    """First and end place of each chunk."""
    starts = range(0, max(1, places - (CHUNK - HOP)), HOP)
    return [(s, min(s + CHUNK, places)) for s in starts]


class Network:
    """Weights, and the answers of the filters."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.5, (PAD + 1, DIM)).astype(np.float32)
        self.filters = r.normal(0, 0.15, (WIDTH * DIM, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.constant: float | None = None

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.filters, self.bias, self.out, self.shift]

    def answers(self, data: np.ndarray) -> np.ndarray:
        """(places, filters) of padded bytes: a filter is two halves over neighbouring strides."""
        strides = self.table[data].reshape(-1, STRIDE * DIM)
        half = STRIDE * DIM
        return strides[:-1] @ self.filters[:half] + strides[1:] @ self.filters[half:] + self.bias

    def chunk_maxima(self, data: np.ndarray) -> np.ndarray:
        """(chunks, filters) of one text's bytes."""
        places = (len(_padded(data)) - WIDTH) // STRIDE + 1
        found = []
        chunks = _chunks(places)
        per_piece = max(1, PIECE // (HOP * STRIDE))
        for lo in range(0, len(chunks), per_piece):
            some = chunks[lo : lo + per_piece]
            first, end = some[0][0], some[-1][1]
            a = self.answers(_padded(data[first * STRIDE : (end - 1) * STRIDE + WIDTH])[: (end - 1 - first) * STRIDE + WIDTH])
            cuts = np.array(some).ravel() - first
            found.append(_maxima(a, cuts))
        return np.concatenate(found)

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(features @ self.out + self.shift[0]).astype(np.float64)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """A probability for each text; short texts go through the filters together."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        features = np.zeros((len(texts), 2 * FILTERS), np.float32)
        group: list[int] = []
        size = 0
        for n, text in enumerate(texts):
            if len(text) > PIECE:
                maxima = self.chunk_maxima(np.frombuffer(text, np.uint8))
                features[n] = np.concatenate([maxima.mean(axis=0, dtype=np.float64), maxima.max(axis=0)])
                continue
            group.append(n)
            size += len(text)
            if size > PIECE:
                self._score_group(texts, group, features)
                group, size = [], 0
        if group:
            self._score_group(texts, group, features)
        return self.probability(features)

    def _score_group(self, texts: list[bytes], group: list[int], features: np.ndarray) -> None:
        padded = [_padded(np.frombuffer(texts[n], np.uint8)) for n in group]
        a = self.answers(np.concatenate(padded))
        cuts, counts, start = [], [], 0
        for p in padded:
            chunks = _chunks((len(p) - WIDTH) // STRIDE + 1)
            cuts += [(start + x, start + y) for x, y in chunks]
            counts.append(len(chunks))
            start += len(p) // STRIDE
        maxima = _maxima(a, np.array(cuts).ravel())
        first = np.cumsum([0, *counts[:-1]])
        features[group, :FILTERS] = np.add.reduceat(maxima.astype(np.float64), first, axis=0) / np.array(counts)[:, None]
        features[group, FILTERS:] = np.maximum.reduceat(maxima, first, axis=0)


def _maxima(a: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Largest answers, never below 0, of the places between each pair of cuts."""
    a = np.concatenate([a, np.full((1, a.shape[1]), -np.inf, a.dtype)])
    return np.maximum(np.maximum.reduceat(a, cuts, axis=0)[::2], 0)


def fit(chunks: list[list[bytes]], labels: list[int], seed: int = 7, epochs: int = EPOCHS) -> Network:
    """A network from texts, each given as some of its chunks, and their labels 0 or 1."""
    net = Network(seed)
    if len(set(labels)) < 2:
        net.constant = float(labels[0]) if labels else 0.5
        return net
    size = (CHUNK - 1) * STRIDE + WIDTH
    data = np.full((sum(map(len, chunks)), size), PAD, np.int16)
    owner = np.repeat(np.arange(len(chunks)), list(map(len, chunks)))
    for n, c in enumerate(c for own in chunks for c in own):
        data[n, : len(c)] = np.frombuffer(c, np.uint8)
    first = np.cumsum([0, *map(len, chunks)])
    y = np.array(labels, np.float32)
    r = np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    step = 0
    half = STRIDE * DIM
    for _ in range(epochs):
        order = r.permutation(len(chunks))
        for lo in range(0, len(order), 32):
            docs = np.sort(order[lo : lo + 32])
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            own = np.searchsorted(docs, owner[rows])
            x = data[rows]
            strides = net.table[x].reshape(len(rows), -1, half)
            a = strides[:, :-1] @ net.filters[:half] + strides[:, 1:] @ net.filters[half:] + net.bias
            at = a.argmax(axis=1)
            top = np.take_along_axis(a, at[:, None], 1)[:, 0]
            maxima = np.maximum(top, 0)
            starts = np.searchsorted(own, np.arange(len(docs)))
            count = np.bincount(own, minlength=len(docs))[:, None].astype(np.float32)
            mean = np.add.reduceat(maxima, starts, axis=0) / count
            high = np.maximum.reduceat(maxima, starts, axis=0)
            features = np.concatenate([mean, high], axis=1)
            error = ((net.probability(features) - y[docs]) / len(docs)).astype(np.float32)
            back = error[:, None] * net.out
            is_high = maxima == high[own]
            ties = np.add.reduceat(is_high.astype(np.float32), starts, axis=0)
            grad_max = back[own, :FILTERS] / count[own] + back[own, FILTERS:] * is_high / ties[own]
            grad_max *= top > 0
            # Only the place of each maximum takes part.
            n, f = np.nonzero(grad_max)
            place = at[n, f]
            g = grad_max[n, f]
            seen = x[n[:, None], place[:, None] * STRIDE + np.arange(WIDTH)]
            grad_filters = np.zeros_like(net.filters)
            np.add.at(grad_filters.T, f, g[:, None] * net.table[seen].reshape(len(n), WIDTH * DIM))
            grad_table = np.zeros_like(net.table)
            np.add.at(grad_table, seen, g[:, None, None] * net.filters.T[f].reshape(len(n), WIDTH, DIM))
            grads = [
                grad_table, grad_filters, grad_max.sum(axis=0), features.T @ error + 1e-4 * net.out,
                error.sum(keepdims=True),
            ]
            step += 1
            for p, d, (m, v) in zip(net.parts(), grads, moments):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def spread_chunks(text: bytes, most: int = FIT_CHUNKS) -> list[bytes]:
    """At most ``most`` of a text's chunks, evenly spread."""
    places = (len(_padded(np.frombuffer(text, np.uint8))) - WIDTH) // STRIDE + 1
    chunks = _chunks(places)
    if len(chunks) > most:
        chunks = [chunks[i * (len(chunks) - 1) // (most - 1)] for i in range(most)]
    return [text[a * STRIDE : (b - 1) * STRIDE + WIDTH] for a, b in chunks]


def _sample_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chunks = [spread_chunks((t.as_py() or "").encode()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(chunks, pa.list_(pa.binary()))], names=["doc_id", "label", "chunks"]
        )


def learn(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    rows: int = FIT_ROWS,
) -> Network:
    """A network from ``docs`` and their ``labels`` (``key``, ``label``); takes ``rows`` ids of each label at most."""
    known = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label in (0, 1)")
    mixed = F.xxhash64(F.col("doc_id"))
    picked = None
    for value in (0, 1):
        some = known.filter(F.col("label") == value).distinct().orderBy(mixed, "doc_id").limit(rows)
        picked = some if picked is None else picked.union(some)
    # The picked ids have a fixed bound, so they may go to every task.
    found = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__text")).join(F.broadcast(picked), "doc_id")
    sample = (
        found.select("doc_id", "label", "__text").mapInArrow(_sample_chunks, "doc_id long, label int, chunks array<binary>")
        .withColumn("h", F.xxhash64("doc_id", "chunks")).orderBy("h").limit(2 * rows).drop("h")
    )
    taken = sample.collect()
    return fit([[bytes(c) for c in r["chunks"]] for r in taken], [r["label"] for r in taken])


def _score(net: Network, at: int, added: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = batch.slice(start, 512)
                texts = [b"" if t.as_py() is None else t.as_buffer().to_pybytes() for t in rows.column(at)]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(net.score(texts), pa.float64())], names=[*rows.schema.names, added]
                )

    return run


def score(df: DataFrame, net: Network, text: str = "text", name: str = "score") -> DataFrame:
    """``df`` with the column ``name``."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    return df.mapInArrow(_score(net, df.columns.index(text), name), schema)


def quality_report(docs: DataFrame, labels: DataFrame, parts: int = 5, left: int = 0) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` per row; learns from the ids not held out."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == left, F.lit(False))
    net = learn(docs, labels.filter(~out))
    rows = docs.select("doc_id", out.alias("held_out"), F.col("text").alias("__text"))
    return score(rows, net, "__text").select(
        "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
