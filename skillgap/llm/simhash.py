"""SimHash near-duplicates, candidates pruned by the pigeonring principle.

Fingerprints. Words are runs of non-space characters, A-Z lower-cased. Each
4-word shingle (repeats included) is hashed by XXH64 with seed 42; a bit of the
fingerprint is 1 if it is set in more than half of the hashes. A text of fewer
words is one shingle; a text without words has fingerprint zero, and is linked
like any other. Null counts as empty.

Links. Two fingerprints that differ in at most ``distance`` bits are linked;
a component is all that links reach. The 64 bits stand in a ring of
``distance + 1`` segments. If two fingerprints differ in at most ``distance``
bits, some segment starts a chain in which the first l segments differ in at
most l * distance / (distance + 1) bits for every l: 0 in the first, at most 1
in the first two, and so on. So candidates must agree in one segment and differ
in at most one bit of the next. Each fingerprint is listed under those two
segments, for each start, and looked up under them and under each variant with
one set bit of the second cleared. Candidates then have to pass the rest of the
chain, and then the full count of bits.

Equal fingerprints are one row from the start. Rows of one key are compared in
one task, and only a spanning forest of the links leaves it. Listings and
look-ups of each key are counted; a key with more than ``block`` of either is dealt
out in pairs of blocks, so that no task holds more of it than two blocks. Such keys are
a table that the rows are joined with, of any size.

Repeated rows link with each other. Null ids sort after all others and are never
a component's id unless all of it is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgap.llm.components import components, scatter, spanning
from skillgap.llm.names import fresh
from skillgap.sources.scratch import materialize

SHINGLE = 4
SEED = 42
DISTANCE = 4
BLOCK = 8192
_SPACES = " \t\n\v\f\r"
_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str) -> list[str]:
    text = text.lower() if text.isascii() else text.translate(_LOWER)
    # str.split() also cuts at spaces beyond these six, and at four control characters.
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    for c in _SPACES[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


#: Shingles of a text held at once.
_AT_ONCE = 65_536


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint of a text."""
    found = words(text)
    if not found:
        return 0
    joined = " ".join(found).encode()
    n = len(found) - SHINGLE + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(joined, SEED)
    # A shingle is a stretch of the joined words: from one word's start to the fourth one's end.
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.append(0, spaces + 1)[:n], np.append(spaces, len(joined))[SHINGLE - 1 :]
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, _AT_ONCE):
        some = zip(starts[lo : lo + _AT_ONCE].tolist(), ends[lo : lo + _AT_ONCE].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in some], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py() or "") for t in batch.column(2)), np.uint64, batch.num_rows)
        arrays = [batch.column(0), batch.column(1), pa.array(prints.view(np.int64)), pa.array(scatter(prints))]
        yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "print", "node"])


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each of the ``distance + 1`` segments."""
    n = distance + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _segment(prints: np.ndarray, place: tuple[int, int]) -> np.ndarray:
    return (prints >> np.uint64(place[0])) & np.uint64((1 << place[1]) - 1)


def _key(start: int, first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    return ((np.uint64(start) << np.uint64(56)) | (first << np.uint64(bits)) | second).view(np.int64)


def _placed(distance: int):
    """The function for ``mapInArrow``: a row for each listing (``kind`` 0) and look-up (2) of a fingerprint."""
    ring = segments(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_prints = batch.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(all_prints), 20_000):
                prints = all_prints[lo : lo + 20_000]
                keys, found, kinds = [], [], []
                for s, place in enumerate(ring):
                    after = ring[(s + 1) % len(ring)]
                    first, second = _segment(prints, place), _segment(prints, after)
                    keys.append(_key(s, first, second, after[1]))
                    found.append(prints)
                    kinds.append(np.zeros(len(prints), np.int8))
                    for bit in range(after[1]):
                        has = (second >> np.uint64(bit)) & np.uint64(1) == 1
                        keys.append(_key(s, first[has], second[has] ^ np.uint64(1 << bit), after[1]))
                        found.append(prints[has])
                        kinds.append(np.full(int(has.sum()), 2, np.int8))
                arrays = [pa.array(np.concatenate(keys)), pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(kinds))]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "print", "kind"])

    return run


def busy_keys(placed: DataFrame, block: int) -> DataFrame:
    """Keys with more than ``block`` listings or look-ups, and how many blocks each of the two makes."""
    listed = F.sum((F.col("kind") == 0).cast("long")).alias("listed")
    asked = F.sum((F.col("kind") == 2).cast("long")).alias("asked")
    counted = placed.groupBy("key").agg(listed, asked).filter((F.col("listed") > block) | (F.col("asked") > block))
    return counted.select("key", F.ceil(F.col("listed") / block).alias("listed"), F.ceil(F.col("asked") / block).alias("asked"))


def dealt(placed: DataFrame, busy: DataFrame) -> DataFrame:
    """Rows with ``part``, so that no part of a key holds more than two blocks.

    ``part`` is 0, or numbers a pair of blocks of a busy key: above 0 of listings with each other, below 0 of
    listings with look-ups. ``kind`` is 1 for a listing in the second of two blocks. Look-ups of
    a busy key that has no listing go.
    """
    listed, asked = F.col("listed"), F.col("asked")
    none = F.array().cast("array<struct<part:bigint,kind:tinyint>>")
    at = lambda part, kind: F.struct(part.cast("long").alias("part"), F.lit(kind).cast("byte").alias("kind"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    own_listed, own_asked = F.pmod(F.xxhash64("print"), F.greatest(listed, F.lit(1))), F.pmod(F.xxhash64("print"), F.greatest(asked, F.lit(1)))
    low, high = lambda o: F.least(own_listed, o), lambda o: F.greatest(own_listed, o)
    with_listings = F.transform(upto(listed), lambda o: F.when(own_listed > o, at(1 + low(o) * listed + high(o), 1)).otherwise(at(1 + low(o) * listed + high(o), 0)))
    with_asked = F.transform(upto(asked), lambda m: at(-(1 + own_listed * asked + m), 0))
    parts = (
        F.when(listed.isNull(), F.array(F.struct(F.lit(0).cast("long").alias("part"), F.col("kind").alias("kind"))))
        .when(F.col("kind") == 0, F.concat(with_listings, with_asked))
        .when(listed > 0, F.transform(upto(listed), lambda o: at(-(1 + o * asked + own_asked), 2)))
        .otherwise(none)
    )
    each = placed.join(busy, "key", "left").select("key", "print", F.explode(parts).alias("at"))
    return each.select("key", "at.part", "print", "at.kind")


def near(a: np.ndarray, b: np.ndarray, start: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs keep every budget of the chain from ``start`` on, and are linked."""
    ring = segments(distance)
    n = len(ring)
    masks = np.array([((1 << bits) - 1) << low for low, bits in ring], np.uint64)
    differs = a ^ b
    alive = np.arange(len(a))
    total = np.zeros(len(a), np.int64)
    for length in range(1, n + 1):
        place = (start[alive] + length - 1) % n
        total[alive] += np.bitwise_count(differs[alive] & masks[place])
        alive = alive[total[alive] * n <= length * distance]
    ok = np.zeros(len(a), bool)
    ok[alive[np.bitwise_count(differs[alive]) <= distance]] = True
    return ok


#: Pairs held at once by a task.
_PAIRS = 2_000_000


def _links(distance: int):
    """The function for ``mapInArrow`` over rows sorted by key and part: spanning links of each."""

    def compare(key: np.ndarray, part: np.ndarray, group: np.ndarray, prints: np.ndarray, kind: np.ndarray) -> Iterator[tuple]:
        """Rows of whole groups, sorted by group, then kind."""
        _, first, size = np.unique(group, return_index=True, return_counts=True)
        ends = np.repeat(first + size, size)
        # Listings of one block, listings of the other, look-ups: a row meets the later listings
        # of its own kind in a plain group, and those of the first kind otherwise.
        zeros = np.add.reduceat((kind == 0).astype(np.int64), first) if len(first) else size
        paired = (np.repeat(np.add.reduceat((kind == 1).astype(np.int64), first) > 0, size) if len(first) else group > 0) | (part < 0)
        begin = np.repeat(first, size)
        zero_end = begin + np.repeat(zeros, size)
        at = np.arange(len(prints))
        lo = np.where(kind == 0, at + 1, begin)
        hi = np.where(kind == 0, np.where(paired, at + 1, zero_end), zero_end)
        n = np.maximum(hi - lo, 0)
        upto = np.cumsum(n)
        row = 0
        while row < len(n):
            done = upto[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(upto, done + _PAIRS, "right")))
            count = n[row:stop]
            left = np.repeat(at[row:stop], count)
            right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[row:stop], count)
            a, b = prints[left], prints[right]
            start = (key[left].view(np.uint64) >> np.uint64(56)).astype(np.int64)
            ok = near(a, b, start, distance) & (a != b)
            if ok.any():
                yield spanning(scatter(a[ok]), scatter(b[ok]))
            row = stop

    def whole(key: np.ndarray, part: np.ndarray, prints: np.ndarray, kind: np.ndarray) -> Iterator[tuple]:
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        group = np.cumsum(new)
        busy = np.bincount(group)[group] > 1
        if busy.any():
            yield from compare(key[busy], part[busy], group[busy], prints[busy].view(np.uint64), kind[busy])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        links: list[tuple] = []

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*links))
            a, b = spanning(a, b)
            links.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy() for i in range(4)]
            # The last group may go on in the next batch; what is held is copied once, when its end is seen.
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            cut = int(np.argmax(same))
            if cut or held and (held[-1][0][-1], held[-1][1][-1]) != (rows[0][0], rows[1][0]):
                links += whole(*(np.concatenate(x) for x in zip(*held, [x[:cut] for x in rows])))
                held = []
            held.append([x[cut:] for x in rows])
            if sum(len(x[0]) for x in links) > 500_000:
                yield out()
        if held:
            links += whole(*(np.concatenate(x) for x in zip(*held)))
        if links:
            yield out()

    return run


def links(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges (``a``, ``b``, of nodes) with the components that links make of distinct ``print`` rows."""
    placed = prints.select("print").mapInArrow(_placed(distance), "key long, print long, kind byte")
    busy = materialize(busy_keys(placed, block), "busy")
    rows = dealt(placed, busy)
    return (
        rows.repartition("key", "part").sortWithinPartitions("key", "part", "kind")
        .mapInArrow(_links(distance), "a long, b long")
    )


def near_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, block: int = BLOCK
) -> DataFrame:
    """``row``, ``doc_id``, ``print`` (64 bits), ``component_id`` and ``first`` per row of ``docs``.

    ``row`` numbers the rows of ``docs`` in reading order. ``component_id`` is the smallest id that
    links reach; ``first`` is true for exactly one row of each component, one with that id.
    """
    if not 2 <= distance <= 7:
        raise ValueError("distance is from 2 to 7 bits")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), text)
    rows = materialize(numbered.mapInArrow(_fingerprints, "row long, doc_id long, print long, node long"), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    distinct = materialize(rows.groupBy("print", "node").agg(F.min(order).alias("low")), "distinct")
    roots = components(links(distinct, distance, block))
    # Written, so that both sides of the join by root are plain tables: Spark then splits a large component.
    lowest = materialize(roots.join(distinct.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("lowest")), "lowest")
    reached = roots.join(lowest, "root").select("node", "lowest")
    named = distinct.join(reached, "node", "left").select("print", F.coalesce("lowest", "low").alias("lowest"))
    return rows.join(named, "print").select(
        "row", "doc_id", "print", F.col("lowest.doc_id").alias("component_id"),
        (F.col("row") == F.col("lowest.row")).alias("first"),
    )


def near_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` per row."""
    found = near_groups(docs, key, text)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One whole row of ``docs`` per component.

    ``docs`` must give the same rows in the same order when read twice (files, a written table).
    """
    (row,) = fresh(docs.columns, "row")
    kept = near_groups(docs, key, text).filter("first").select(F.col("row").alias(row))
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    return numbered.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
