"""The merged postings table on shared storage.

Rows lie in buckets by a hash of their id, sorted by id, in Parquet files with
small pages and a bloom filter of the ids. A commit writes the buckets it changes
to a folder of its own and then one small pointer file, which says for every bucket
what folder holds it; so a small batch reads and writes few files, and readers see all of a
commit or nothing. Pointer files are numbered and never overwritten: of two
writers that start from the same version, the second fails. The pointer also
keeps the last batch number of each stream, so a batch that a stream repeats is
merged once, whatever other streams do.

A table made with ``keep`` also holds counts of its values (see ``operators.kept``), which each merge
brings up to date from the rows it changed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgap.operators.kept import KEPT, contributions, updated
from skillgap.operators.merge import merge_parts, named_ids
from skillgap.schema import POSTING, conform_schema
from skillgap.sources.scratch import materialize, remove, scratch_scope

#: Versions that stay readable behind the current one.
KEPT_VERSIONS = 2
#: Buckets of a new table; one for every million rows or so is a good number.
BUCKETS = 16
#: Rows of a page: what is read at least for one id.
PAGE_ROWS = 64


class Store:
    """A postings table at ``path``; ``buckets`` and ``keep`` count for a table that is not there yet."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, keep: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        self.version, self.buckets, self.keep, self.streams = 0, buckets, keep, {}
        #: Bucket to the folder that holds it; and the folder of the counts.
        self.folders: dict[int, str] = {}
        self.kept: str | None = None
        self._load()

    def _at(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _pointers(self) -> dict[int, str]:
        """Pointer files by version; none where the table was never written."""
        files, folder = self._at(f"{self.path}/pointer")
        if not files.exists(folder):
            return {}
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return {int(n.split(".")[0]): f"{self.path}/pointer/{n}" for n in names if n.endswith(".json")}

    def _read_pointer(self, path: str) -> dict:
        text = self.spark.read.text(path, wholetext=True).first()
        try:
            found = json.loads(text["value"])
            return {
                "version": found["version"], "buckets": found["buckets"], "streams": found["streams"],
                "folders": {int(k): v for k, v in found["folders"].items()}, "keep": found["keep"], "kept": found["kept"],
            }
        except (TypeError, ValueError, KeyError, AttributeError) as e:
            raise ValueError(f"the pointer {path} cannot be read; the table is left as it is") from e

    def _load(self) -> None:
        pointers = self._pointers()
        if pointers:
            for name, value in self._read_pointer(pointers[max(pointers)]).items():
                setattr(self, name, value)

    def bucket(self, job_id: Column | str) -> Column:
        """The bucket of an id."""
        return F.pmod(F.xxhash64(job_id), F.lit(self.buckets)).cast("int")

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The whole table, or some buckets of it."""
        wanted = self.folders if buckets is None else [b for b in buckets if b in self.folders]
        paths = [f"{self.path}/{self.folders[b]}/bucket={b}" for b in sorted(wanted)]
        if not paths:
            return self.spark.createDataFrame([], POSTING)
        return self.spark.read.schema(POSTING).parquet(*paths)

    def find(self, ids: Sequence[str]) -> DataFrame:
        """The rows with one of the ids, from their buckets only."""
        named = self.spark.createDataFrame([(i,) for i in ids], "job_id string")
        buckets = [r[0] for r in named.select(self.bucket("job_id")).distinct().collect()]
        return named_ids(self.read(buckets), ids)[0]

    def counts(self) -> DataFrame:
        """The counts of the table's values, as its last commit left them."""
        if not self.keep:
            raise ValueError(f"{self.path} does not keep counts")
        if self.kept is None:
            return self.spark.createDataFrame([], KEPT)
        return self.spark.read.schema(KEPT).parquet(f"{self.path}/{self.kept}")

    def _write(self, df: DataFrame, folder: str) -> set[int]:
        """Rows as bucket folders; the buckets that have rows."""
        path = f"{self.path}/{folder}"
        # Rebalanced, so that large buckets get several files; the files of a bucket are sorted by id.
        rows = conform_schema(df).withColumn("bucket", self.bucket("job_id")).hint("rebalance", F.col("bucket"))
        (
            rows.sortWithinPartitions("bucket", "job_id").write.partitionBy("bucket")
            .option("parquet.page.row.count.limit", PAGE_ROWS)
            .option("parquet.bloom.filter.enabled#job_id", "true")
            .option("parquet.bloom.filter.expected.ndv#job_id", 1_000_000)
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .parquet(path)
        )
        files, target = self._at(path)
        names = [s.getPath().getName() for s in files.listStatus(target)]
        return {int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")}

    def _commit(self, df: DataFrame, streams: dict[str, int], replaced: Iterable[int], counts: DataFrame | None) -> None:
        version, own = self.version + 1, f"{self.version + 1}-{uuid.uuid4().hex}"
        folder, kept = f"data/{own}", f"counts/{own}" if counts is not None else None
        self._check_alone()
        try:
            written = self._write(df, folder)
            if counts is not None:
                counts.write.parquet(f"{self.path}/{kept}")
            gone = set(replaced)
            folders = {b: f for b, f in self.folders.items() if b not in gone} | {b: folder for b in written}
            body = json.dumps({
                "version": version, "buckets": self.buckets, "folders": folders, "streams": streams, "keep": self.keep, "kept": kept,
            })
            self._check_alone()
            self._point(version, body)
        except Exception:
            remove(self.spark, f"{self.path}/{folder}")
            if kept:
                remove(self.spark, f"{self.path}/{kept}")
            raise
        self.version, self.folders, self.streams, self.kept = version, folders, streams, kept
        self._forget()

    def _point(self, version: int, body: str) -> None:
        """The pointer file itself, made only if it is not there: that is what decides between two writers."""
        files, final = self._at(f"{self.path}/pointer/{version:012d}.json")
        try:
            out = files.create(final, False)
        except Exception as e:
            raise RuntimeError(f"version {version} could not be committed; load the table and try again") from e
        out.write(bytearray(body.encode()))
        out.close()

    def _check_alone(self) -> None:
        newest = max(self._pointers(), default=0)
        if newest != self.version:
            raise RuntimeError(f"another writer has committed version {newest}; load the table and try again")

    def _forget(self) -> None:
        """Delete pointers that are too old to be read any more, and what only they name; data first."""
        found = {v: (path, self._read_pointer(path)) for v, path in self._pointers().items()}
        names = lambda p: {f"{f}/bucket={b}" for b, f in p["folders"].items()} | ({p["kept"]} if p["kept"] else set())
        live = set().union(*(names(p) for v, (_, p) in found.items() if v >= self.version - KEPT_VERSIONS))
        for v, (path, old) in sorted(found.items()):
            if v < self.version - KEPT_VERSIONS:
                for name in names(old) - live:
                    remove(self.spark, f"{self.path}/{name}")
                for folder in set(old["folders"].values()):
                    if not any(name.startswith(folder + "/") for name in live):
                        remove(self.spark, f"{self.path}/{folder}")
                remove(self.spark, path)

    def overwrite(self, df: DataFrame) -> None:
        """Replace the whole table; what streams have delivered so far stays known."""
        with scratch_scope(self.spark):
            if self.keep:
                df = materialize(conform_schema(df), "overwrite")
            counts = updated(self.spark.createDataFrame([], KEPT), contributions(df, 1)) if self.keep else None
            self._commit(df, self.streams, range(self.buckets), counts)

    def merge(self, batch: DataFrame, stream: str | None = None, batch_id: int | None = None) -> int:
        """Merge a prepared batch; returns the number of ids touched.

        Only the buckets of the batch's ids are read and written. ``batch_id`` counts the batches of
        ``stream``; one that the stream has committed already is skipped. Without a stream every batch is merged.
        """
        streams = dict(self.streams)
        if stream is not None:
            if batch_id is None:
                raise ValueError("a stream's batch needs its number")
            if batch_id <= streams.get(stream, -1):
                return 0
            streams[stream] = batch_id
        by_bucket = batch.groupBy(self.bucket("job_id").alias("bucket")).agg(F.count_distinct("job_id").alias("ids")).collect()
        touched = sum(r["ids"] for r in by_bucket)
        if touched or stream is not None:
            buckets = [r["bucket"] for r in by_bucket]
            with scratch_scope(self.spark):
                parts = merge_parts(self.read(buckets), batch)
                after, counts = parts.after, None
                if self.keep:
                    after = parts.lone.unionByName(materialize(parts.folded, "merged"))
                    changed = contributions(after, 1).unionByName(contributions(parts.before, -1))
                    counts = updated(self.counts(), changed)
                self._commit(parts.untouched.unionByName(after), streams, buckets, counts)
        return touched


def write_store(df: DataFrame, path: str, **options) -> Store:
    store = Store(df.sparkSession, path, **options)
    store.overwrite(df)
    return store


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return Store(spark, path).read()
