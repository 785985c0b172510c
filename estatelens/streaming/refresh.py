"""Each micro-batch refreshes the projects whose files landed."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from estatelens.operators.snapshots import SnapshotStore
from estatelens.plans.refresh import analyze
from estatelens.session import stored
from estatelens.sources.landing import missing_branch
from estatelens.streaming.views import EstateViews

MIN_INTERVAL_SECONDS = 60
_SECONDS = {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}


def trigger(interval: str | None) -> dict:
    """Options of ``writeStream.trigger``; without an interval, one pass over what has landed."""
    if interval is None or not interval.strip():
        return {"availableNow": True}
    m = re.fullmatch(r"\s*(\d+)\s*([smhd]?)\s*", interval)
    if m is None:
        raise ValueError("must be a duration like '60s', '5m', '1h'")
    seconds = int(m[1]) * _SECONDS[m[2]]
    if seconds < MIN_INTERVAL_SECONDS:
        raise ValueError("must be at least 1 minute")
    return {"processingTime": f"{seconds} seconds"}


def publish(
    store: SnapshotStore,
    projects: DataFrame,
    files: DataFrame,
    batch_key: str | None = None,
    full: bool = False,
    views: EstateViews | None = None,
) -> int:
    """One refresh: analyse ``projects``, carry the rest forward, commit. Any error fails the snapshot.

    A ``full`` refresh replaces catalog and profiles: projects it does not name are gone.

    A batch that was committed before is not published again. ``views`` are kept
    up within the same snapshot.
    """
    if batch_key is not None and (done := store.completed_batch(batch_key)) is not None:
        return done
    parent = None if full else store.pointer()
    snapshot_id = store.begin_snapshot(
        "full" if parent is None else "single_project", parent, batch_key
    )
    try:
        profiles = analyze(projects, files)
        catalog = projects.select("project_id", "full_path")
        skips = missing_branch(projects)
        if parent is None:
            counts = {"profiles_written": store.write("profiles", snapshot_id, profiles), "skipped": store.write("skips", snapshot_id, skips)}
            store.write("catalog", snapshot_id, catalog)
        else:
            counts = store.copy_forward(parent, snapshot_id, profiles, catalog, skips)
        if views is not None:
            views.keep_up(snapshot_id, parent)
        store.commit(snapshot_id, counts)
    except Exception:
        store.abort(snapshot_id)
        raise
    return snapshot_id


def stream_refresh(
    landed: DataFrame,
    read_projects,
    read_files,
    store: SnapshotStore,
    checkpoint: str,
    interval: str | None = None,
    views: EstateViews | None = None,
) -> StreamingQuery:
    """R2: files in, snapshots out. ``read_projects()`` and ``read_files()`` give projects and landed files as they are now.

    A batch only tells which projects changed; all their landed files are read
    again, so it does not matter how batches cut a project. The query's own id
    and the batch id are the commit key: a replayed batch publishes nothing
    twice, and another query on the same store starts with keys of its own. One
    running batch per query takes the place of a job lock.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        ids = stored(batch.select("project_id").distinct())
        changed = read_projects().join(ids, "project_id", "left_semi")
        publish(store, changed, read_files().join(ids, "project_id", "left_semi"), f"{query_id}:{batch_id}", views=views)

    return (
        landed.writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(interval))
        .start()
    )
