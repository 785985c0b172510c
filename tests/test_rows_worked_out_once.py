"""Costly rows of the store are worked out once."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatelens.operators import coalesce as co
from estatelens.operators.profiles import nest_things
from estatelens.operators.snapshots import SnapshotStore, in_ranges
from estatelens.schemas import PROFILES
from estatelens.streaming import views


def test_a_write_finds_its_ranges_without_its_rows(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def name(i):
        seen.add(1)
        return f"g/{i}"

    store = SnapshotStore(spark, str(tmp_path / "store"))
    rows = spark.range(2500).select(F.col("id").alias("project_id"), F.udf(name)("id").alias("full_path"))
    assert store.write("catalog", 1, rows) == 2500 and seen.value == 2500
    assert {tuple(r) for r in store.written("catalog", 1).collect()} == {(i, f"g/{i}") for i in range(2500)}


def test_ranges_do_not_overlap_and_keep_all_rows(spark):
    rows = spark.range(40_000).select((F.col("id") % 9000).alias("project_id"), "id").repartition(5)
    spans = in_ranges(rows, "project_id").groupBy(F.spark_partition_id()).agg(F.min("project_id"), F.max("project_id"), F.count(F.lit(1))).collect()
    ends = sorted(tuple(r)[1:] for r in spans)
    assert len(ends) == 4 and sum(n for _, _, n in ends) == 40_000
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    odd = spark.createDataFrame([(None, 1), (2, 2)], "project_id long, x int")
    assert sorted(r.x for r in in_ranges(odd, "project_id").collect()) == [1, 2] and in_ranges(odd.limit(0), "project_id").count() == 0


def test_overlaps_are_looked_for_once(spark, tmp_path, monkeypatch):
    """Sums and links are read whole, so nothing is run a second time to range them."""
    store = SnapshotStore(spark, str(tmp_path / "store"))
    sums = ["Pays all invoices of the estate", "Pays all invoices of the whole estate"]
    store.write("profiles", 1, spark.createDataFrame([(i, f"g/{i}", "main", "sha", None, s, None, [], [], [], [], []) for i, s in enumerate(sums)], PROFILES))
    ranged, write = [], store.write
    monkeypatch.setattr(store, "write", lambda table, *a, placed=False, **k: (placed or ranged.append(table), write(table, *a, placed=placed, **k)))
    views.EstateViews(store).keep_up(1, None)
    assert ranged == []
    links = store.written("view_links", 1, views.LINKS)
    assert links.count() == 4 and links.select("set_id").distinct().count() == 2


def test_profile_tables_are_shuffled_once_and_keep_their_modes(spark):
    modes = {1: (["read", "write"], "read_write"), 2: (["unknown"], "unknown"), 3: (["write", "unknown"], "write"), 4: (["read_write"], "read_write"), 5: (["read", None], "read")}
    rows = [(p, "t", m, "a.sql", 1, n) for p, (ms, _) in modes.items() for n, m in enumerate(ms)]
    hits = spark.createDataFrame(rows, "project_id long, table_name string, access_mode string, path string, line int, seq long")
    tables = co.tables_with_locations(co.by_project(hits))
    assert {r.project_id: r.access_mode for r in tables.collect()} == {p: m for p, (_, m) in modes.items()}
    assert {r.project_id: len(r.source_locations) for r in tables.collect()} == dict.fromkeys(modes, 1)
    nested = nest_things(tables.withColumn("order_key", F.col("table_name")), ["table_name", "access_mode"], "tables", F.col("order_key"))
    plan = nested._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
