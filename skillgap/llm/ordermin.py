"""Document fingerprints by order MinHash.

A text's k-mers are its runs of ``K`` code points, each numbered by how often
the same run came before it, so that repeats count. For each of ``SLOTS`` hash
functions the ``PICKED`` k-mers with the smallest hashes are selected; they are
put back in the order of the text, and their tuple is hashed to one slot of the
fingerprint. Two texts agree in a slot if the same k-mers were selected in the
same order: the share of agreeing slots falls with insertions, deletions and
moves alike, as edit distance does. A text of fewer than ``K`` code points is
one k-mer, and a text with fewer than ``PICKED`` k-mers gives tuples of what there
is. The empty text has the fingerprint 0 everywhere. Null is the empty text.

``edited_report`` also takes each text with its second half replaced by the
beginning of the next document. Documents are cut into ranges of ids; a range's
bounds come from ids alone, each text moves once to its range, and the first
document of a range is sent to the range before it as well, so every document
meets its successor in one pass. Rows are ordered by descending id, null last,
repeated ids by reading order; after the last row comes the first. The table
must give the same rows in the same order when read twice (files, a written
table). Extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgap.sources.scratch import drop_scratch, materialize

K = 6
PICKED = 2
SLOTS = 64
#: Bytes of text that a range of ids is meant to hold.
RANGE_BYTES = 64 << 20
_SEED = 20_190_707
#: K-mers hashed together.
_BLOCK = 1024
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits spread."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x *= _M2
        x ^= x >> np.uint64(29)
        x *= _M1
        x ^= x >> np.uint64(32)
        return x


def _functions(slots: int) -> np.ndarray:
    """A mask for each hash function: masked by it, random numbers are in a random order of their own."""
    return np.random.default_rng(_SEED).integers(0, 2**32, (slots, 1), dtype=np.uint32)


_MASKS = _functions(SLOTS)


def kmers(points: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of each run of ``k`` code points, in text order; one for a shorter text, none for the empty one."""
    n = len(points)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(k, n)
    # Hashes of longer and longer runs, each made of a run twice as short at two places.
    with np.errstate(over="ignore"):
        out, factor, width = (points + np.uint64(1)) * _M2, _M1, 1
        while width < size:
            step = min(width, size - width)
            out, factor = out[: len(out) - step] * factor + out[step:], factor * factor + np.uint64(2)
            width += step
    return _mixed(out + np.uint64(size))


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by hash, then place, and how many equal hashes stand before each."""
    n = len(hashes)
    if n < 1 << 24:
        # The place rides in the low bits, so that a plain sort of numbers does it.
        bits = np.uint64(24)
        both = np.sort((hashes >> bits << bits) | np.arange(n, dtype=np.uint64))
        place = (both & np.uint64((1 << 24) - 1)).astype(np.int64)
        key = both >> bits
    else:
        key = hashes >> np.uint64(24)
        place = np.argsort(key, kind="stable")
        key = key[place]
    same = key[1:] == key[:-1]
    times = np.zeros(n, np.int64)
    if same.any():
        began = np.where(np.append(False, same), 0, np.arange(n))
        times = np.arange(n) - np.maximum.accumulate(began)
    return place, times


def fingerprint(text: str) -> np.ndarray:
    """The slots of a text, 32 bits each."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    hashes = kmers(points.astype(np.uint64))
    n = len(hashes)
    if not n:
        return np.zeros(SLOTS, np.uint32)
    place, times = numbered(hashes)
    with np.errstate(over="ignore"):
        x = (_mixed((hashes[place] >> np.uint64(24)) + times.astype(np.uint64) * _M2) >> np.uint64(32)).astype(np.uint32)
    picked = min(PICKED, n)
    slot = np.arange(SLOTS)
    best_hash, best_at = [], []
    space = np.empty((SLOTS, min(n, _BLOCK)), np.uint32)
    for lo in range(0, n, _BLOCK):
        part = x[lo : lo + _BLOCK]
        some = np.bitwise_xor(part, _MASKS, out=space[:, : len(part)])
        for _ in range(min(PICKED, some.shape[1])):
            at = some.argmin(axis=1)
            best_hash.append(some[slot, at])
            best_at.append(at + lo)
            some[slot, at] = np.uint32(2**32 - 1)
    value, at = np.stack(best_hash), np.stack(best_at)
    if len(value) > picked:
        # Smallest first; equal ones by their place in the sorted k-mers.
        order = np.lexsort((at, value), axis=0)[:picked]
        at = np.take_along_axis(at, order, axis=0)
    chosen = np.sort(place[at], axis=0)
    out = np.full(SLOTS, np.uint64(picked))
    with np.errstate(over="ignore"):
        for row in chosen:
            out = _mixed(out * _M1 + (hashes[row] >> np.uint64(24)))
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of slots in which two fingerprints agree."""
    return float((a == b).mean())


def shown(slots: np.ndarray) -> str:
    """Lower-case hex, eight digits a slot."""
    return slots.astype(">u4").tobytes().hex()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t.as_py() or "") for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([shown(x) for x in found], pa.string())], names=["key", "fingerprint"]
        )


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fingerprint`` per row."""
    kind = df.schema[key].dataType.simpleString()
    found = df.select(F.col(key).alias("key"), text).mapInArrow(_fingerprints, f"key {kind}, fingerprint string")
    return found.withColumnRenamed("key", key)


def _ranges(df: DataFrame, key: str, text: str, parts: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Id and row number of the first row of each range, in order; null ids are the smallest of all."""
    ids = df.select(F.col(key).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.octet_length(text).alias("bytes"))
    spark = df.sparkSession
    ids = materialize(ids, "ids")
    if parts is None:
        total = ids.agg(F.sum("bytes")).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    by = [F.col("id").desc_nulls_last(), F.col("row")]
    dealt = ids.select("id", "row").repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id())
    low = F.min(F.struct(F.col("id").isNull().alias("none"), (-F.col("id")).alias("down"), "row")).alias("low")
    # A row per range comes to the driver.
    firsts = dealt.groupBy("part").agg(low).orderBy("low").collect()
    drop_scratch(ids)
    none = np.iinfo(np.int64).max
    down = np.array([none if r["low"]["none"] else r["low"]["down"] for r in firsts], np.int64)
    return down, np.array([r["low"]["row"] for r in firsts], np.int64)


def _deal(down: np.ndarray, rows: np.ndarray):
    """The function for ``mapInArrow`` over (id, row, text): each row in its range, the first of a range in the one before too."""
    none = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            key = np.where(ids.is_null().to_numpy(zero_copy_only=False), none, -ids.fill_null(0).to_numpy(zero_copy_only=False))
            row = batch.column(1).to_numpy()
            lo, hi = np.searchsorted(down, key, "left"), np.searchsorted(down, key, "right")
            part = hi - 1
            # Ranges that begin within one id are told apart by the row number.
            for i in np.flatnonzero(lo < hi).tolist():
                part[i] = lo[i] + np.searchsorted(rows[lo[i] : hi[i]], row[i], "right") - 1
            first = np.flatnonzero((down[part] == key) & (rows[part] == row))
            at = np.concatenate([np.arange(len(row)), first])
            where = np.concatenate([part, (part[first] - 1) % len(down)])
            tail = np.concatenate([np.zeros(len(row), bool), np.ones(len(first), bool)])
            taken = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(where, pa.int32()), pa.array(tail), *(c.take(taken) for c in batch.columns)],
                names=["part", "tail", "id", "row", "text"],
            )

    return run


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and order; each is told against the one after it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held: tuple | None = None
    out: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        parts, tails = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(batch.num_rows):
            text = batch.column(4)[i].as_py() or ""
            slots = fingerprint(text)
            if held is not None and held[0] == parts[i]:
                _, id_, own, own_slots = held
                half = len(own) // 2
                edited = own[: len(own) - half] + text[:half]
                edited_slots = fingerprint(edited) if edited != own else own_slots
                out.append((
                    id_, len(own), hashlib.sha256(edited.encode()).hexdigest(), shown(own_slots), shown(edited_slots),
                    likeness(own_slots, edited_slots), likeness(own_slots, slots),
                ))
            held = None if tails[i] else (parts[i], batch.column(2)[i].as_py(), text, slots)
        if len(out) >= 2000:
            yield batch_of(out)
            out = []
    if out:
        yield batch_of(out)


def edited_report(df: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Per row: ``doc_id``, ``n_chars``, the edited text's digest, both fingerprints and two likenesses.

    The edited text is the text with its last ``n_chars // 2`` code points replaced by the first as many (or all)
    of the next row's text. ``near_edited`` and ``near_next`` tell how like the text's fingerprint is to
    the edited text's and to the next row's, from 0 to 1.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    down, rows = _ranges(df, key, text, parts)
    if not len(down):
        return df.sparkSession.createDataFrame([], schema)
    wide = df.select(F.col(key).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    dealt = wide.mapInArrow(_deal(down, rows), "part int, tail boolean, id long, row long, text string")
    by = ["part", "tail", F.col("id").desc_nulls_last(), "row"]
    return dealt.repartitionById(len(down), "part").sortWithinPartitions(*by).mapInArrow(_report, schema)
