"""Rows of the views lie on disk once: where the snapshot keeps them."""

from __future__ import annotations

import os

from estatelens.operators.snapshots import SnapshotStore
from estatelens.schemas import PROFILES
from estatelens.session import scratch_folder
from estatelens.streaming.views import KEPT, EstateViews


def test_kept_rows_are_not_copied_to_the_scratch_folder(spark, tmp_path):
    base = os.path.dirname(scratch_folder(spark)).removeprefix("file:")
    store = SnapshotStore(spark, str(tmp_path / "store"))
    place = [{"path": "a", "line": 1}]
    service, used = {"name": "redis", "kind": "cache", "source_locations": place}, {"table_name": "t", "access_mode": "read", "source_locations": place}
    rows = [(i, f"g/{i}", "main", "sha", None, "Pays all invoices of the estate", None, [], [], [service], [used], []) for i in (1, 2)]
    first = store.begin_snapshot()
    store.write("profiles", first, spark.createDataFrame(rows, PROFILES))
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    views = EstateViews(store)
    views.keep_up(first, None)
    store.commit(first)
    new = (set(os.listdir(base)) if os.path.isdir(base) else set()) - before
    copies = [spark.read.parquet(f"{base}/{name}").columns for name in new]
    assert not [c for c in copies if c in [schema.fieldNames() for schema in KEPT.values()]]
    assert {(r.project_id, r.name) for r in views.kept("services", first).collect()} == {(1, "redis"), (2, "redis")}
    assert {(r.table_name, r.n_projects, r.n_edges) for r in views.edge_classes(first).collect()} == {("t", 2, 1)}
