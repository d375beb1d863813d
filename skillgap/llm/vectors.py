"""Embedding near-duplicates by a forest of random-projection trees.

A tree splits space again and again: each level has a random direction, each
node a split near the median of a sample along it, and vectors within a margin
of the split go to both sides (spill). Vectors are compared with all others in
their leaves, in double precision, and linked at the threshold; components are
all that links reach.

Splits come from a bounded sample (``SAMPLE`` vectors, smallest by hash); a node
with fewer than ``LEAST`` of them splits by those of the last node above that had
as many. Depth and number of trees are found on the sample as well. The depth
is the one at which leaves hold ``LEAF`` rows, copies by spill included; it need
not be a whole number, in that some nodes of the last level are split and the others
not, so that the work grows evenly. Then pairs at just the threshold are made up,
and there are as many trees as it takes for ``RECALL`` of these to meet. Every
vector is indexed, the sampled ones like the rest.

Equal vectors are one row from the start. A pair may share several leaves; it is
counted in the first of them only. For that, vectors found in a pair are routed
again where they are compared, so neither pairs nor lists of leaves leave a
task: it gives sums of links and a spanning forest. A leaf of more than ``BLOCK``
rows is dealt out in pairs of blocks; which leaves are is a table that the rows
are joined with, of any size.

Null and zero vectors and those with a null or non-finite component link with
nothing, and so do vectors of different lengths with each other. Repeated rows
are equal vectors; null ids sort last and make no component id unless all are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgap.llm.components import components, scatter, spanning
from skillgap.sources.scratch import materialize

THRESHOLD = 0.9
LEAF = 256
SAMPLE = 16_384
LEAST = 32
#: Margin on both sides of a split, in standard deviations of the difference of a pair at the threshold.
SPILL = 0.25
#: Share of pairs at the threshold that are to meet in a leaf.
RECALL = 0.99
MOST_TREES = 64
BLOCK = 4096
_SEED = 11


class Tree:
    """One tree over unit vectors: a direction a level, and splits by reference nodes.

    A reference node is one that has ``LEAST`` vectors of the sample; nodes below it
    that have fewer go on by it.
    """

    def __init__(self, sample: np.ndarray, number: int, depth: float, margin: float):
        self.number, self.margin = number, margin
        self.whole = int(depth)
        self.rest = depth - self.whole
        levels = self.whole + (self.rest > 0)
        r = np.random.default_rng([_SEED, number])
        directions = r.normal(size=(sample.shape[1], levels))
        self.directions = directions / np.linalg.norm(directions, axis=0, keepdims=True)
        along = sample @ self.directions
        self.splits: list[np.ndarray] = []
        self.below: list[np.ndarray] = []
        groups = [np.arange(len(sample))]
        for level in range(levels):
            # Not always the middle: a random place in the middle fifth.
            shares = r.uniform(0.4, 0.6, len(groups))
            split = np.zeros(len(groups))
            below = np.zeros((len(groups), 2), np.int64)
            after: list[np.ndarray] = []
            for g, rows in enumerate(groups):
                x = along[rows, level]
                split[g] = np.quantile(x, shares[g])
                kept = -1
                for side, some in enumerate((rows[x <= split[g]], rows[x > split[g]])):
                    if len(some) >= LEAST:
                        below[g, side] = len(after)
                        after.append(some)
                    else:
                        if kept < 0:
                            kept = len(after)
                            after.append(rows)
                        below[g, side] = kept
            self.splits.append(split)
            self.below.append(below)
            groups = after

    def _splits_on(self, path: np.ndarray) -> np.ndarray:
        """Which nodes of the last whole level are split once more."""
        mixed = scatter(path ^ (self.number << 44)).view(np.uint64) >> np.uint64(11)
        return mixed.astype(np.float64) < self.rest * 2.0**53

    def route(self, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, path) at each level from the root on; the last are the leaves. Paths start at 1 and go on with a 0 or 1."""
        along = unit @ self.directions
        row, path, at = np.arange(len(unit)), np.ones(len(unit), np.int64), np.zeros(len(unit), np.int64)
        yield row, path
        for level, (split, below) in enumerate(zip(self.splits, self.below)):
            done = None
            if level == self.whole:
                open_ = self._splits_on(path)
                done = row[~open_], path[~open_]
                row, path, at = row[open_], path[open_], at[open_]
            x = along[row, level] - split[at]
            left, right = x <= self.margin, x > -self.margin
            row = np.concatenate([row[left], row[right]])
            path = np.concatenate([path[left] << 1, path[right] << 1 | 1])
            at = np.concatenate([below[at[left], 0], below[at[right], 1]])
            if done is not None:
                row, path = np.concatenate([row, done[0]]), np.concatenate([path, done[1]])
            yield row, path

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for last in self.route(unit):
            pass
        return last


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls, all of ``dim`` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _by_length(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = np.diff(batch.column(at).offsets.to_numpy())
    for dim in np.unique(lengths).tolist():
        yield dim, batch if (lengths == dim).all() else batch.filter(pa.array(lengths == dim))


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _grown(sample: np.ndarray, total: int, threshold: float, leaf: int, recall: float) -> list[Tree]:
    """Trees over a sample of unit vectors, for ``total`` vectors."""
    margin = SPILL * math.sqrt(max(0.0, 2 - 2 * threshold) / sample.shape[1])
    deepest = max(0, 2 + math.ceil(2 * math.log2(max(1, total / leaf))))
    trial = [Tree(sample, n, min(deepest, 40), margin) for n in range(3)]
    # Rows of all leaves of a level, for each vector.
    spread = np.mean([[len(row) / len(sample) for row, _ in tree.route(sample)] for tree in trial], axis=0)
    size = np.log2(np.maximum(total * spread / 2.0 ** np.arange(len(spread)) / leaf, 1e-9))
    depth = 0.0
    if size[0] > 0:
        # Between the last level with more than LEAF rows a leaf and the next, in proportion.
        last = int(np.flatnonzero(size > 0)[-1])
        nxt = min(last + 1, len(size) - 1)
        depth = last + (size[last] / (size[last] - size[nxt]) if size[nxt] < size[last] else 0.0)
    r = np.random.default_rng(_SEED)
    one = sample[r.integers(0, len(sample), 2000)]
    off = r.normal(size=one.shape)
    off -= (off * one).sum(axis=1, keepdims=True) * one
    length = np.linalg.norm(off, axis=1, keepdims=True)
    other = threshold * one + math.sqrt(max(0.0, 1 - threshold * threshold)) * off / np.where(length > 0, length, 1)
    trees: list[Tree] = []
    apart = np.ones(len(one))
    while len(trees) < MOST_TREES:
        tree = Tree(sample, len(trees), depth, margin)
        trees.append(tree)
        pairs = [row << 44 | path for row, path in map(tree.leaves, (one, other))]
        apart[np.unique(np.intersect1d(*pairs) >> 44)] = 0
        if apart.mean() <= 1 - recall:
            break
    return trees


class Forest:
    """A list of trees per length of vectors in the sample; other lengths are one leaf."""

    def __init__(self, samples: dict[int, np.ndarray], total: int, threshold: float, leaf: int = LEAF, recall: float = RECALL):
        self.trees = {dim: _grown(_unit(x), total, threshold, leaf, recall) for dim, x in samples.items()}

    def route(self, dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf), sorted by row, then leaf; leaves are numbered by length, tree and path."""
        trees = self.trees.get(dim)
        if not trees:
            row, leaf = np.arange(len(x)), np.zeros(len(x), np.int64)
        else:
            unit = _unit(x)
            found = [(row, tree.number << 44 | path) for tree in trees for row, path in [tree.leaves(unit)]]
            row, leaf = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order]
        # Lengths that share a mark meet in one leaf and are told apart there.
        return row, leaf | dim % 2048 << 52


#: Vectors routed together.
_AT_ONCE = 4096


def _count_leaves(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, _AT_ONCE):
                for dim, some in _by_length(whole.slice(lo, _AT_ONCE), 0):
                    leaf, n = np.unique(forest.route(dim, _matrix(some.column(0), dim))[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(n)], names=["leaf", "n"])

    return run


def _route(forest: Forest):
    """The function for ``mapInArrow`` over (node, n, embedding): a row per vector and leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, _AT_ONCE):
                for dim, batch in _by_length(whole.slice(lo, _AT_ONCE), 2):
                    row, leaf = forest.route(dim, _matrix(batch.column(2), dim))
                    for a in range(0, len(row), _AT_ONCE):
                        taken = pa.array(row[a : a + _AT_ONCE])
                        arrays = [pa.array(leaf[a : a + _AT_ONCE]), *(c.take(taken) for c in batch.columns)]
                        yield pa.RecordBatch.from_arrays(arrays, names=["leaf", "node", "n", "embedding"])

    return run


def _dealt(routed: DataFrame, large: DataFrame) -> DataFrame:
    """Rows with ``part`` and ``side``: 0, or the number of a pair of blocks of a large leaf, and 1 in the second of the two.

    A part is odd if its blocks are two different ones.
    """
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("node"), blocks)
    each = routed.join(large, "leaf", "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    part = F.when(blocks > 1, (1 + low * blocks + high) * 2 + (low < high).cast("long")).otherwise(F.lit(0).cast("long"))
    return each.select("leaf", part.alias("part"), (F.col("own") > F.col("other")).cast("byte").alias("side"), "node", "n", "embedding")


#: Vectors on each side of a product of matrices, and leaves looked through at a time.
_TILE, _LEAVES = 1024, 512


def _met(row: np.ndarray, leaf: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) pairs with leaves below ``before``, which are numbered from 0 and in order."""
    early = leaf < before
    row, (_, number) = row[early], np.unique(leaf[early], return_inverse=True)
    order = np.argsort(number.ravel(), kind="stable")
    return row[order], number.ravel()[order]


def _shared(met: tuple[np.ndarray, np.ndarray], one: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
    """For each of the rows ``one`` and each of ``other`` (of ``n`` rows), whether they share a leaf of ``met``."""
    row, number = met
    found = np.zeros((len(one), len(other)), bool)
    where = np.full((2, n), -1)
    where[0, one], where[1, other] = np.arange(len(one)), np.arange(len(other))
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, _LEAVES):
        some = slice(*np.searchsorted(number, [lo, lo + _LEAVES]))
        in_one, in_other = np.zeros((len(one), _LEAVES), np.float32), np.zeros((len(other), _LEAVES), np.float32)
        for held, at in ((in_one, where[0, row[some]]), (in_other, where[1, row[some]])):
            held[at[at >= 0], number[some][at >= 0] - lo] = 1
        found |= in_one @ in_other.T > 0
    return found


def _compare(forest: Forest, threshold: float):
    """The function for ``mapInArrow`` over rows sorted by leaf and part.

    Gives (node, partner links, null) sums and (node, null, node) spanning links.
    """

    def group(batch: pa.Table, links: dict[int, int], edges: list) -> None:
        leaf, part = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
        batch = batch.combine_chunks()
        side, ids, counts = (batch.column(i).to_numpy() for i in (2, 3, 4))
        vectors = batch.column(5).chunk(0)
        lengths = np.diff(vectors.offsets.to_numpy())
        for dim in np.unique(lengths).tolist():
            pick = lengths == dim
            x = _matrix(vectors.filter(pa.array(pick)), dim)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            norm = np.sqrt((x * x).sum(axis=1))
            own, n, sides = ids[pick], counts[pick], side[pick]
            close: list[tuple[int, int, np.ndarray]] = []
            for a in range(0, len(x), _TILE):
                for b in range(a, len(x), _TILE):
                    near = x[a : a + _TILE] @ x[b : b + _TILE].T >= threshold * np.outer(norm[a : a + _TILE], norm[b : b + _TILE])
                    if a == b:
                        near = np.triu(near, 1)
                    if part & 1:
                        near &= sides[a : a + _TILE, None] != sides[None, b : b + _TILE]
                    if near.any():
                        close.append((a, b, near))
            if not close:
                continue
            # Only the vectors of pairs are routed again, to see in which leaves they have met before.
            paired = np.zeros(len(x), bool)
            for a, b, near in close:
                paired[a : a + _TILE] |= near.any(axis=1)
                paired[b : b + _TILE] |= near.any(axis=0)
            involved = np.flatnonzero(paired)
            met = _met(*forest.route(dim, x[involved]), leaf)
            total = np.zeros(len(x), np.int64)
            for a, b, near in close:
                one, other = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                near = near[np.ix_(one, other)]
                one, other = one + a, other + b
                i, j = np.nonzero(near)
                edges.append(spanning(own[one[i]], own[other[j]]))
                near &= ~_shared(met, np.searchsorted(involved, one), np.searchsorted(involved, other), len(involved))
                total[one] += near @ n[other]
                total[other] += n[one] @ near
            for c, v in zip(own[total > 0].tolist(), total[total > 0].tolist()):
                links[c] = links.get(c, 0) + v

    def out(links: dict[int, int], edges: list) -> pa.RecordBatch:
        a, b = spanning(*(np.concatenate(x) for x in zip(*edges))) if edges else (np.zeros(0, np.int64),) * 2
        first = pa.concat_arrays([pa.array(links.keys(), pa.int64()), pa.array(a)])
        sums = pa.concat_arrays([pa.array(links.values(), pa.int64()), pa.nulls(len(a), pa.int64())])
        ends = pa.concat_arrays([pa.nulls(len(links), pa.int64()), pa.array(b)])
        links.clear()
        edges.clear()
        return pa.RecordBatch.from_arrays([first, sums, ends], names=["a", "n", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        links: dict[int, int] = {}
        edges: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == 0 and held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) == (leaf[0], part[0]):
                    held.append(batch.slice(0, b))
                    continue
                if held:
                    group(pa.Table.from_batches(held), links, edges)
                held = [batch.slice(a, b - a)]
            if len(links) + sum(len(x[0]) for x in edges) > 200_000:
                yield out(links, edges)
        if held:
            group(pa.Table.from_batches(held), links, edges)
        yield out(links, edges)

    return run


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first column, a row number, as a number without order."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(scatter(batch.column(0).to_numpy())), *batch.columns[1:]], names=["node", *batch.schema.names[1:]])


def forest_of(classes: DataFrame, threshold: float = THRESHOLD, leaf: int = LEAF, recall: float = RECALL) -> Forest:
    """The forest for a table of different vectors (``embedding``)."""
    sampled = classes.select("embedding", F.xxhash64("embedding").alias("h")).orderBy("h").limit(SAMPLE)
    by_length: dict[int, list] = {}
    for batch in sampled.select("embedding").toArrow().to_batches():
        for dim, some in _by_length(batch, 0):
            by_length.setdefault(dim, []).append(_matrix(some.column(0), dim))
    return Forest({dim: np.concatenate(x) for dim, x in by_length.items()}, classes.count(), threshold, leaf, recall)


def near_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, leaf: int = LEAF,
    block: int = BLOCK, recall: float = RECALL,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` per row of ``df``; other columns are left out."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fit = F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding"), F.coalesce(fit, F.lit(False)).alias("fit"))
    low = F.struct(F.col("vec_id").isNull().alias("none"), "vec_id")
    grouped = rows.filter("fit").groupBy("embedding").agg(F.min(low).alias("low"), F.count("*").alias("n"))
    kind = grouped.schema["embedding"].dataType.simpleString()
    classes = materialize(
        grouped.select(F.monotonically_increasing_id().alias("node"), "low", "n", "embedding")
        .mapInArrow(_nodes, f"node long, low struct<none: boolean, vec_id: bigint>, n long, embedding {kind}"),
        "classes",
    )
    forest = forest_of(classes, threshold, leaf, recall)
    counted = classes.select("embedding").mapInArrow(_count_leaves(forest), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
    large = materialize(counted.filter(F.col("n") > block).select("leaf", F.ceil(F.col("n") / block).alias("blocks")), "large")
    routed = classes.select("node", "n", "embedding").mapInArrow(_route(forest), f"leaf long, node long, n long, embedding {kind}")
    found = materialize(
        _dealt(routed, large).repartition("leaf", "part").sortWithinPartitions("leaf", "part")
        .mapInArrow(_compare(forest, threshold), "a long, n long, b long"),
        "found",
    )
    linked = found.filter("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    roots = components(found.filter("b is not null").select("a", "b"))
    # Written, so that both sides of the join by root are plain tables: Spark then splits a large component.
    lowest = materialize(roots.join(classes.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("lowest")), "lowest")
    reached = roots.join(lowest, "root").select("node", "lowest")
    described = classes.join(reached, "node", "left").join(linked, "node", "left").select(
        "embedding", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("lowest", "low")["vec_id"].alias("component_id"),
    )
    good = rows.filter("fit").join(described, "embedding").select("vec_id", "n_links", "component_id")
    bad = rows.filter(~F.col("fit")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
