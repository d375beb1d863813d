"""Ranked lexical search: exact inner products over sparse ball trees.

Terms are runs of letters, digits and bytes beyond ASCII, A-Z lower-cased. A
document is a sparse vector of saturated term counts, a query one of its terms'
weights times their number, and a score is their inner product in whole numbers.

Only terms that a query holds can score, so a document is cut down to these
in the first pass, which is written; weights come from counts over all documents.
In the second, each task packs documents into trees. A tree is split again and again along the
line through two vectors far apart; a node keeps its centroid and the radius that
holds all of its vectors. No vector of a node can score more than the centroid's
score plus radius times the query's length. Both are floating-point numbers, so the
bound is raised by more than their rounding can take away before it is used. A
query goes through a tree best bound first, scores the vectors of each leaf
exactly, and leaves the tree when the best bound left is below its k-th score so
far; that score is carried on to the next tree of the task. Equal vectors of a tree
are one, with its ``k`` smallest ids: no query can want more of them.

A task gives each query's ``k`` best, and the best of those are the result, so what
moves is ``k`` rows a query and task. Queries are taken in blocks of bounded size.

Null and empty texts have no terms; such documents aren't counted, and such queries have no
rows. Equal scores rank by ascending id, null last; repeated documents rank each for itself,
repeated queries are answered each for itself. Extra columns are left out.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skillgap.sources.scratch import materialize

TOP = 10
#: Documents of a tree, and of a leaf.
TREE, LEAF = 4096, 64
#: Bytes of query text taken together; the driver and each task hold that much.
QUERY_BYTES = 1 << 20
#: Weights and counts of terms are scaled to whole numbers (fixed values of the score).
WEIGHT, SCALE, STEP, SLOPE, LONG = 1000, 1_000_000_000, 1000, 8, 75

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms(text: str) -> list[bytes]:
    """Terms in text order, in UTF-8: every byte that is in no term is a space."""
    return text.encode().translate(_TABLE).split()


def weight(n: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2 * n + 2) / (2 * df + 1)))


class Queries:
    """A block of queries and the numbers of their terms."""

    def __init__(self, rows: list[tuple]):
        """``rows``: (query, id, text)."""
        self.counts = [(q, i, Counter(terms(t or ""))) for q, i, t in rows]
        self.counts = [x for x in self.counts if x[2]]
        self.vocabulary: dict[bytes, int] = {}
        for _, _, found in self.counts:
            for t in found:
                self.vocabulary.setdefault(t, len(self.vocabulary))


def _vectors(vocabulary: dict[bytes, int]):
    """The function for ``mapInArrow`` over (id, text): length and counts of query terms of documents with terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            at, lengths, sizes, numbers, times = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                found = terms(text.as_py() or "")
                if not found:
                    continue
                counted = Counter(map(get, found))
                counted.pop(None, None)
                at.append(i)
                lengths.append(len(found))
                sizes.append(len(counted))
                order = sorted(counted)
                numbers += order
                times += map(counted.__getitem__, order)
            first = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())), pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(first, pa.array(numbers, pa.int32())),
                    pa.ListArray.from_arrays(first, pa.array(times, pa.int64())),
                ],
                names=["id", "n", "terms", "times"],
            )

    return run


class BallTree:
    """A ball tree over sparse vectors of whole numbers in compressed rows, none of them empty."""

    def __init__(self, first: np.ndarray, term: np.ndarray, value: np.ndarray, leaf: int = LEAF):
        #: Numbers of the terms that the tree's vectors have; all else is told in their places here.
        self.terms, self._term = np.unique(term, return_inverse=True)
        self.leaf, self._first, self._value = leaf, first, value
        self._double = value.astype(np.float64)
        self._square = np.add.reduceat(self._double * self._double, first[:-1])
        #: What sums over terms can lose of their size.
        self._lost = 4 * np.finfo(np.float64).eps * (len(self.terms) + 16)
        self.centroids: list[np.ndarray] = []
        self.radii: list[float] = []
        self.children: list[tuple[int, int] | None] = []
        self.leaves: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self._grow(np.arange(len(first) - 1))
        self.matrix, self.radius = np.stack(self.centroids), np.array(self.radii)

    def _cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows' entries, and where each row's begin among these."""
        size = self._first[rows + 1] - self._first[rows]
        begin = np.cumsum(size) - size
        return np.arange(size.sum()) + np.repeat(self._first[rows] - begin, size), begin

    def _along(self, cells: np.ndarray, begin: np.ndarray, line: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self._double[cells] * line[self._term[cells]], begin)

    def _grow(self, rows: np.ndarray) -> int:
        node = len(self.centroids)
        cells, begin = self._cells(rows)
        centre = np.bincount(self._term[cells], self._double[cells], len(self.terms)) / len(rows)
        squares, square = self._square[rows], centre @ centre
        away = squares - 2 * self._along(cells, begin, centre) + square
        # The difference of large squares loses digits: as much as it can lose is put on top.
        slack = self._lost * (squares.max() + square)
        self.centroids.append(centre)
        self.radii.append(math.sqrt(max(0.0, float(away.max())) + 2 * slack) * (1 + self._lost))
        self.children.append(None)
        if len(rows) > self.leaf and away.max() > 2 * slack:
            one = self._dense(rows[int(away.argmax())])
            other = self._dense(rows[int((squares - 2 * self._along(cells, begin, one)).argmax())])
            order = np.argsort(self._along(cells, begin, other - one), kind="stable")
            half = len(rows) // 2
            left = self._grow(rows[order[:half]])
            self.children[node] = left, self._grow(rows[order[half:]])
        else:
            self.leaves[node] = rows, begin, self._term[cells], self._value[cells]
        return node

    def _dense(self, row: int) -> np.ndarray:
        out = np.zeros(len(self.terms))
        a, b = self._first[row], self._first[row + 1]
        out[self._term[a:b]] = self._double[a:b]
        return out

    def bounds(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """For each node a number that none of its scores is above; ``at`` are places of terms, ``query`` their weights."""
        w = query.astype(np.float64)
        raw = self.matrix[:, at] @ w + self.radius * math.sqrt(w @ w)
        # All products are positive, so their sums are right to a share of themselves.
        return np.floor(raw * (1 + self._lost) * (1 + 1e-9) + 1.0)

    def search(self, term: np.ndarray, weight: np.ndarray, space: np.ndarray, least, take) -> int:
        """Visit nodes best bound first; ``take(rows, scores)`` gets each leaf, ``least()`` is what a score has to reach.

        ``term`` (sorted) and ``weight`` are the query; ``space`` holds a 0 for each term of the tree, and does so
        again at the end. Gives the number of leaves visited.
        """
        at = np.searchsorted(self.terms, term)
        there = np.append(self.terms, -1)[at] == term
        at, weight = at[there], weight[there]
        if not len(at):
            return 0
        bound = self.bounds(at, weight)
        space[at] = weight
        heap = [(-bound[0], 0)]
        visited = 0
        while heap and -heap[0][0] >= least():
            _, node = heapq.heappop(heap)
            below = self.children[node]
            if below is None:
                rows, begin, terms_, values = self.leaves[node]
                take(rows, np.add.reduceat(space[terms_] * values, begin))
                visited += 1
            else:
                for child in below:
                    if bound[child] >= least():
                        heapq.heappush(heap, (-bound[child], child))
        space[at] = 0
        return visited


class _Best:
    """The best (score, id) of a query so far."""

    def __init__(self, top: int):
        self.top = top
        self.rows: list[tuple[int, bool, int]] = []  # (-score, id is null, id), best first

    def least(self) -> int:
        return -self.rows[-1][0] if len(self.rows) == self.top else 1

    def take(self, found: list[tuple[int, bool, int]]) -> None:
        self.rows = heapq.nsmallest(self.top, self.rows + found)


def _search(queries: Queries, weights: np.ndarray, n_docs: int, all_terms: int, top: int, tree: int, leaf: int):
    """The function for ``mapInArrow`` over (id, n, terms, times): the best of the task for each query."""

    def grown(batch: pa.Table) -> tuple[BallTree | None, list[list[tuple[bool, int]]]]:
        ids, lengths = batch.column(0).combine_chunks(), batch.column(1).to_numpy()
        lists = batch.column(2).combine_chunks()
        times = batch.column(3).combine_chunks().flatten().to_numpy()
        term, first = lists.flatten().to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
        first = first - first[0]
        m = 100 - LONG + (LONG * lengths * n_docs) // all_terms
        value = (SCALE * times) // (STEP * times + SLOPE * np.repeat(m, np.diff(first)))
        order = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)))
        kept: dict[bytes, int] = {}
        rows: list[int] = []
        held: list[list[tuple[bool, int]]] = []
        for i in order.tolist():
            a, b = first[i], first[i + 1]
            if a == b:
                continue
            key = term[a:b].tobytes() + value[a:b].tobytes()
            at = kept.setdefault(key, len(rows))
            if at == len(rows):
                rows.append(i)
                held.append([])
            if len(held[at]) < top:
                id_ = ids[i].as_py()
                held[at].append((id_ is None, id_ or 0))
        if not rows:
            return None, held
        some = np.array(rows)
        size = first[some + 1] - first[some]
        begin = np.concatenate([[0], np.cumsum(size)])
        cells = np.arange(begin[-1]) - np.repeat(begin[:-1], size) + np.repeat(first[some], size)
        return BallTree(begin, term[cells], value[cells], leaf), held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = []
        for _, _, counts in queries.counts:
            found = sorted((queries.vocabulary[t], times) for t, times in counts.items())
            at, times = (np.array(x, np.int64) for x in zip(*found))
            asked.append((at, times * weights[at]))
        best = [_Best(top) for _ in queries.counts]

        def through(batch: pa.Table) -> None:
            ball, held = grown(batch)
            if ball is None:
                return
            space = np.zeros(len(ball.terms), np.int64)
            for (at, own_weights), own in zip(asked, best):

                def take(rows: np.ndarray, scores: np.ndarray, own=own) -> None:
                    good = np.flatnonzero(scores >= own.least()).tolist()
                    if good:
                        own.take([(-int(scores[i]), none, id_) for i in good for none, id_ in held[rows[i]]])

                ball.search(at, own_weights, space, own.least, take)

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, tree):
                waiting.append(batch.slice(lo, tree))
                if sum(b.num_rows for b in waiting) >= tree:
                    through(pa.Table.from_batches(waiting))
                    waiting = []
        if waiting:
            through(pa.Table.from_batches(waiting))
        out = [(q, i, None if none else id_, -low) for (q, i, _), own in zip(queries.counts, best) for low, none, id_ in own.rows]
        columns = zip(*out) if out else ([],) * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "item_id", "doc_id", "score"])

    return run


def search(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    top: int = TOP, tree: int = TREE, leaf: int = LEAF, query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of each query's ``top`` best documents with a score above 0."""
    spark = docs.sparkSession
    asked = materialize(
        items.select(F.monotonically_increasing_id().alias("query"), F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text")),
        "queries",
    )
    size = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    blocks = -(-size // query_bytes)
    schema = "query long, item_id long, doc_id long, score long"
    found = spark.createDataFrame([], schema)
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).orderBy("query").collect()
        queries = Queries([(r["query"], r["item_id"], r["text"]) for r in own])
        if not queries.vocabulary:
            continue
        narrow = materialize(
            docs.select(F.col(key).cast("long").alias("id"), text)
            .mapInArrow(_vectors(queries.vocabulary), "id long, n long, terms array<int>, times array<long>"),
            "vectors",
        )
        n_docs, all_terms = narrow.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        # One row per term that a query of the block holds.
        df = np.zeros(len(queries.vocabulary), np.int64)
        for r in narrow.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[r["term"]] = r["count"]
        weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
        best = narrow.mapInArrow(_search(queries, weights, n_docs, all_terms, top, tree, leaf), schema)
        found = found.union(best)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rank = F.row_number().over(W.partitionBy("query").orderBy(*order))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
