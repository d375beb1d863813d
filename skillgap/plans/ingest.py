"""From raw files to the merged table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgap.catalog import SKILLS, SkillCatalog
from skillgap.operators.market import snapshot_watermark
from skillgap.operators.merge import ARRIVAL, merge_postings
from skillgap.operators.prepare import normalize_postings, prepare_batch
from skillgap.schema import conform_schema
from skillgap.sources.scratch import materialize


def incoming(
    raw: DataFrame, now: dt.datetime, is_snapshot: bool, skills: SkillCatalog = SKILLS, stage: bool = True, **live
) -> DataFrame:
    """Raw postings as a prepared batch.

    The merge reads its batch several times; staging it means the texts are
    searched for skills once.
    """
    batch = prepare_batch(normalize_postings(raw, now, **live), now, is_snapshot=is_snapshot, skills=skills)
    return materialize(batch, "incoming") if stage else batch


def ingest(store: DataFrame, raw: DataFrame, now: dt.datetime, is_snapshot: bool = True, **options) -> DataFrame:
    return merge_postings(store, incoming(raw, now, is_snapshot, **options))


def refresh_snapshots(
    store: DataFrame,
    disk: DataFrame,
    now: dt.datetime,
    force: bool = False,
    skills: SkillCatalog = SKILLS,
    newest_by: str = "first_file",
) -> DataFrame:
    """The store after looking at the snapshot files: loaded if it has none, reloaded if they are newer.

    Newer means that the capture date of the first file (``newest_by="first_file"``)
    or of the newest one (``"any_file"``) is after the latest stored one. Otherwise
    the store is returned as it is.
    """
    if newest_by not in ("first_file", "any_file"):
        raise ValueError(f"newest_by is first_file or any_file, not {newest_by}")
    mark = snapshot_watermark(store).first()
    if mark["snapshot_rows"]:
        if not force:
            by = F.min_by("captured_at", ARRIVAL) if newest_by == "first_file" else F.max("captured_at")
            first = disk.agg(by.alias("captured_at")).first()["captured_at"]
            latest = mark["latest_capture"]
            force = bool(first and latest and first[:10] > str(latest)[:10])
        if not force:
            return conform_schema(store)
        store = store.where(~F.coalesce("is_snapshot", F.lit(False)))
    return ingest(store, disk, now, is_snapshot=True, skills=skills)
