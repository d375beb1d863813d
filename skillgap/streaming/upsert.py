"""Snapshot files merged into the store as they arrive."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from skillgap.catalog import SKILLS, SkillCatalog
from skillgap.plans.ingest import incoming
from skillgap.sources.scratch import scratch_scope
from skillgap.sources.snapshots import stream_snapshots
from skillgap.sources.store import Store


def stream_upsert(
    spark: SparkSession,
    source: str,
    store_path: str,
    checkpoint: str,
    now: dt.datetime,
    skills: SkillCatalog = SKILLS,
    is_snapshot: bool = True,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Merge every new file under ``source``; stops when the files present are done.

    Each micro-batch is one commit of the store, made under the query's id (kept
    in its checkpoint) and the batch's number, so a batch that is repeated after a
    failure is not merged twice, and a fresh checkpoint starts anew.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        stream = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        store = Store(session, store_path)
        if batch_id > store.streams.get(stream, -1):
            with scratch_scope(session):
                store.merge(incoming(batch, now, is_snapshot, skills), stream, batch_id)

    return (
        stream_snapshots(spark, source, files_per_batch)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
