"""Connected components of an edge table, by repeated contraction.

Each round sends every node to the smallest node next to it, twice over, and
keeps the edges that still join different nodes. Nodes must be numbers in no
particular order along the links (``scatter`` makes such numbers), so that a
round removes a fixed share of the nodes however the links run; a star of any
size is gone after two rounds. Minima are taken per task before the shuffle,
and each round is written to the shared folder, so that lost executors redo one
round at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgap.sources.scratch import drop_scratch, materialize


def scatter(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit numbers that leaves no order in them."""
    z = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return z.view(np.int64)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few edges with the components of the edges given: each node with the smallest of its component."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = index[: len(a)], index[len(a):]
    root = np.arange(len(nodes))
    while len(u):
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[u] != root[v]
        u, v = u[open_], v[open_]
    apart = root != np.arange(len(nodes))
    return nodes[apart], nodes[root[apart]]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (``a``, ``b``; long): one root per component.

    Null ends and loops are left out. Without edges the result is empty.
    """
    spark = edges.sparkSession
    live = materialize(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    steps: list[DataFrame] = []
    for _ in range(rounds):
        if live.isEmpty():
            break
        ends = live.select(F.col("a").alias("node"), F.col("b").alias("next")).union(live.select("b", "a"))
        # Written, so that both sides are plain tables: all nodes of a star have the same ``up``, and Spark
        # splits such a key only where no aggregate ends in the join.
        up = materialize(ends.groupBy("node").agg(F.least(F.min("next"), F.col("node")).alias("up")), "up")
        top = up.select(F.col("node").alias("up"), F.col("up").alias("root"))
        step = materialize(up.join(top, "up").select("node", "root"), "step")
        drop_scratch(up)
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        after = live.join(left, "a").join(right, "b").filter("ra <> rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")
        )
        done, live = live, materialize(after.distinct(), "edges")
        drop_scratch(done)
        steps.append(step)
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    drop_scratch(live)
    if not steps:
        return spark.createDataFrame([], "node long, root long")
    # A node that a round left in place is in the next round's table, or settled.
    found = steps[-1]
    for step in reversed(steps[:-1]):
        later = found.select(F.col("node").alias("root"), F.col("root").alias("later"))
        found = step.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    found = materialize(found, "roots")
    for step in steps:
        drop_scratch(step)
    return found
