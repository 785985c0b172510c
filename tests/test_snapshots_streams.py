import random

import pytest

from estatelens.operators import lookups as lk
from estatelens.operators.coalesce import group_report
from estatelens.operators.conflicts import conflict_counts
from estatelens.operators.graph import edge_classes
from estatelens.operators.snapshots import SnapshotStore, upsert_last
from estatelens.rules import ACCESS_MODES
from estatelens.schemas import CATALOG, PROFILES, SKIPS
from estatelens.sources.landing import read_projects, read_tree
from estatelens.streaming.hits import landing_stream, stream_service_hits
from estatelens.session import stored
from estatelens.streaming.refresh import publish, stream_refresh, trigger
from estatelens.streaming.views import KEPT, LINKS, SUMS, EstateViews, kept_rows


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"))


def _profiles(spark, *rows):
    base = [None, [], [], [], [], []]
    return spark.createDataFrame([(i, f"g/{i}", "main", sha, None, "s", *base) for i, sha in rows], PROFILES)


def _write(spark, store, snapshot_id, *rows):
    store.write("profiles", snapshot_id, _profiles(spark, *rows))
    store.write("catalog", snapshot_id, spark.createDataFrame([(i, f"g/{i}") for i, _ in rows], CATALOG))
    store.write("skips", snapshot_id, spark.createDataFrame([], SKIPS))


def test_nothing_is_current_before_the_first_commit(spark, store):
    assert store.pointer() is None and store.current("profiles").count() == 0
    sid = store.begin_snapshot()
    _write(spark, store, sid, (1, "a"))
    assert store.current("profiles").count() == 0
    store.abort(sid)
    assert store.pointer() is None


def test_the_last_commit_is_current_not_the_greatest_id(spark, store):
    first, second = store.begin_snapshot(), store.begin_snapshot()
    _write(spark, store, first, (1, "a"))
    _write(spark, store, second, (1, "b"))
    store.commit(second)
    store.commit(first)
    assert store.pointer() == first
    assert [r["commit_sha"] for r in store.current("profiles").collect()] == ["a"]
    with pytest.raises(ValueError, match="completed"):
        store.abort(second)


def test_parent_goes_with_single_project_only(store):
    with pytest.raises(ValueError, match="parent"):
        store.begin_snapshot("single_project")
    with pytest.raises(ValueError, match="parent"):
        store.begin_snapshot("full", parent=1)


def test_copy_forward_replaces_changed_rows_and_keeps_skipped_ones(spark, store):
    first = store.begin_snapshot()
    _write(spark, store, first, (1, "a"), (2, "b"))
    store.commit(first)
    second = store.begin_snapshot("single_project", first)
    changed = _profiles(spark, (2, "new"))
    skips = spark.createDataFrame([(1, "analysis_branch_missing", "d")], SKIPS)
    store.copy_forward(first, second, changed, spark.createDataFrame([(2, "g/2")], CATALOG), skips)
    store.commit(second)
    assert {r["project_id"]: r["commit_sha"] for r in store.current("profiles").collect()} == {1: "a", 2: "new"}
    assert store.current("skips").count() == 1 and store.snapshot("skips", first).count() == 0


def test_last_write_wins_whatever_the_order(spark):
    writes = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 5, None), (2, 4, "x"), (1, 2, "b")], "k int, n int, v string")
    assert {tuple(r) for r in upsert_last(writes.repartition(3), ["k"], "n").collect()} == {(1, "c"), (2, None)}


def test_lookups(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,), (1,)], "project_id long")
    catalog = spark.createDataFrame([(2, "g/2"), (1, "g/1")], CATALOG)
    profiles = _profiles(spark, (1, "a"), (9, "z"))
    assert [r[0] for r in lk.list_projects(catalog).collect()] == [1, 2]
    assert dict(map(tuple, lk.lookup_status(ids, catalog, profiles).collect())) == {1: "ok", 2: "not yet analyzed", 3: "not in scope"}
    assert [r["project_id"] for r in lk.not_analyzed(catalog, profiles).collect()] == [2]
    assert [r["project_id"] for r in lk.out_of_scope(ids, catalog).collect()] == [3]
    assert lk.out_of_scope(ids, catalog.limit(0)).count() == 3
    for question in (lk.project_purpose, lk.project_io, lk.project_dependencies, lk.project_profile):
        assert [r["project_id"] for r in question(profiles, ids).collect()] == [1]


def test_report_order_and_suffix(spark):
    items = spark.createDataFrame([(1, "b", "unknown"), (1, "z", "read"), (1, "a", "read")], "project_id long, table_name string, access_mode string")
    got = group_report(items, "tables", "access_mode", "table_name", ACCESS_MODES)
    assert [(r["group_name"], r["label"]) for r in got.collect()] == [("read", "a"), ("read", "z"), ("unknown", "b [access: unknown]")]


def test_triggers():
    assert trigger(None) == {"availableNow": True}
    assert trigger(" 5m ") == {"processingTime": "300 seconds"}
    for bad in ("30s", "x"):
        with pytest.raises(ValueError, match="must be"):
            trigger(bad)


def test_readers(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"project_id": 2, "full_path": "g/b", "description": ""}\n{"project_id": 1, "full_path": "g/a", "description": "d"}\n')
    assert [(r["project_id"], r["description"]) for r in read_projects(spark, str(tmp_path / "p.json"), "json").collect()] == [(1, "d"), (2, None)]
    tree = tmp_path / "tree"
    (tree / "src").mkdir(parents=True)
    (tree / "src" / "a.py").write_text("x = 1\n")
    (tree / "bad.py").write_bytes(b"\xff\xfe")
    (tree / "big.py").write_bytes(b"a" * (1048576 + 1))
    assert [tuple(r) for r in read_tree(spark, str(tree), 5, "s", limit=1 << 20).collect()] == [(5, "s", "src/a.py", "x = 1\n")]
    assert {r["path"] for r in read_tree(spark, str(tree), 5, "s").collect()} == {"src/a.py", "big.py"}


def test_stream_hits_equal_batch_hits(spark, make_files, tmp_path):
    files = make_files({"a.py": "u = 'https://api.io/x'\n", "README.md": "https://no.io"})
    landing = str(tmp_path / "landing")
    files.write.parquet(landing)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    query = (
        stream_service_hits(landing_stream(spark, landing))
        .select("name", "kind", "path", "line")
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [("api.io", "http_api", "a.py", 1)]


def test_stream_refresh_publishes_once_and_carries_forward(spark, make_files, make_projects, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "store")
    store = SnapshotStore(spark, root)
    projects = make_projects((1, "g/a", "main", "sha", "one"), (2, "g/b", "main", "sha", "two"), (3, "g/c", "main", None, None))

    def run():
        query = stream_refresh(landing_stream(spark, landing, 1), lambda: projects, lambda: spark.read.parquet(landing), store, str(tmp_path / "check"))
        query.awaitTermination()

    make_files({"a.py": "q = 'SELECT 1 FROM t1'"}, 1).unionByName(make_files({"c.py": "x"}, 3)).coalesce(1).write.parquet(landing)
    run()
    first = store.pointer()
    assert {r["project_id"] for r in store.current("profiles").collect()} == {1}
    assert store.current("skips").count() == 1
    make_files({"b.py": "q = 'SELECT 1 FROM t2'"}, 2).coalesce(1).write.mode("append").parquet(landing)
    run()
    got = {r["project_id"]: [t["table_name"] for t in r["tables"]] for r in store.current("profiles").collect()}
    assert got == {1: ["t1"], 2: ["t2"]} and store.pointer() > first
    # A replayed batch finds its key in the log and publishes nothing.
    before = store.commits().count()
    key = store.commits().filter("batch_key IS NOT NULL").orderBy("snapshot_id", ascending=False).first()["batch_key"]
    assert publish(store, projects, make_files({"z.py": "x"}, 1), key) == store.pointer()
    assert store.commits().count() == before
    # A project cut over two batches keeps both; another query on the store has keys of its own.
    make_files({"d.py": "q = 'SELECT 1 FROM t3'"}, 1).coalesce(1).write.mode("append").parquet(landing)
    stream_refresh(landing_stream(spark, landing, 1), lambda: projects, lambda: spark.read.parquet(landing), store, str(tmp_path / "other")).awaitTermination()
    got = {r["project_id"]: sorted(t["table_name"] for t in r["tables"]) for r in store.current("profiles").collect()}
    assert got == {1: ["t1", "t3"], 2: ["t2"]}


def test_a_full_refresh_replaces_the_scope(spark, make_files, make_projects, store):
    both = make_projects((1, "g/a", "main", "sha", "one"), (2, "g/b", "main", "sha", "two"))
    publish(store, both, make_files({"a.py": "x"}, 1).unionByName(make_files({"b.py": "x"}, 2)))
    publish(store, both.filter("project_id = 2"), make_files({"b.py": "x"}, 2), full=True)
    assert {r["project_id"] for r in store.current("catalog").collect()} == {2}
    assert {r["project_id"] for r in store.current("profiles").collect()} == {2}


def test_a_failed_refresh_leaves_the_old_snapshot_current(spark, make_files, make_projects, store):
    projects = make_projects((1, "g/a", "main", "sha", "one"))
    first = publish(store, projects, make_files({"a.py": "x"}))
    with pytest.raises(Exception):
        publish(store, projects, make_files({"a.py": "x"}).drop("content"))
    assert store.pointer() == first
    assert store.commits().filter("status = 'failed'").count() == 1


def _estate(rng, ids):
    """Random profiles: tables shared by many, summaries that overlap and contradict, and unknown ones."""
    texts = ["Is responsible for billing invoices and refunds", "must not billing invoices daily", "billing invoices", "billing invoices refunds x y", "delegates shipping labels", "is the owner of shipping labels", "shipping labels printing", "unknown"]
    rows = []
    for i in ids:
        names = ["hub", *rng.sample([f"t{n}" for n in range(8)], rng.randrange(4))]
        tables = [(t, rng.choice(["read", "write", "unknown"]), [("f", 1)]) for t in names if rng.random() < 0.8]
        rows.append((i, f"g/{i}", "main", str(rng.random()), None, rng.choice(texts), None, [], [], [("api", "other", [("f", 1)])], tables, []))
    return rows


@pytest.mark.parametrize("compact_after", [3])
def test_views_equal_a_rebuild_after_any_refreshes(spark, tmp_path, compact_after):
    rng = random.Random(compact_after)
    store = SnapshotStore(spark, str(tmp_path / "store"), compact_after)
    views = EstateViews(store)
    now, parent = {}, None
    for step in range(4):
        ids = range(24) if step == 0 else rng.sample(range(30), rng.choice([1, 4]))
        rows = _estate(rng, ids)
        now |= {r[0]: r for r in rows}
        sid = store.begin_snapshot("full" if parent is None else "single_project", parent)
        profiles = spark.createDataFrame(rows, PROFILES)
        catalog = profiles.select("project_id", "full_path")
        none = spark.createDataFrame([], SKIPS)
        if parent is None:
            store.write("profiles", sid, profiles)
            store.write("catalog", sid, catalog)
        else:
            store.copy_forward(parent, sid, profiles, catalog, none)
        views.keep_up(sid, parent)
        store.commit(sid)
        parent = sid
        assert len(store.chain(sid)) <= compact_after
    current = store.current("profiles")
    assert {r.project_id: r.commit_sha for r in current.collect()} == {i: r[3] for i, r in now.items()}
    whole = spark.createDataFrame(list(now.values()), PROFILES)
    rebuilt = kept_rows(whole)
    for name, rows in rebuilt.items():
        assert sorted(map(str, views.kept(name, sid).collect())) == sorted(map(str, rows.select(*KEPT[name].fieldNames()).collect()))
    assert sorted(map(tuple, views.edge_classes(sid).collect())) == sorted(map(tuple, edge_classes(rebuilt["tables"]).collect()))
    want = {(r.project_id, r.n_overlap, r.n_contradictory) for r in conflict_counts(stored(rebuilt["claims"])).collect()}
    assert {(r.project_id, r.n_overlap, r.n_contradictory) for r in views.conflict_counts(sid).collect()} == want and any(r[1] or r[2] for r in want)


def test_a_small_refresh_writes_only_what_changed(spark, store):
    first = store.begin_snapshot()
    rng = random.Random(1)
    store.write("profiles", first, spark.createDataFrame(_estate(rng, range(300)), PROFILES))
    views = EstateViews(store)
    views.keep_up(first, None)
    store.commit(first)
    second = store.begin_snapshot("single_project", first)
    one = spark.createDataFrame(_estate(rng, [7]), PROFILES)
    store.copy_forward(first, second, one, one.select("project_id", "full_path"), spark.createDataFrame([], SKIPS))
    views.keep_up(second, first)
    store.commit(second)
    assert store.written("profiles", second).count() == 1 and store.current("profiles").count() == 300
    assert store.written("view_table_counts", second, SUMS["table_counts"]).count() <= 8
    assert store.written("view_tables", second, KEPT["tables"]).count() <= 4


def test_lookups_of_a_snapshot_skip_files(spark, store):
    sid = store.begin_snapshot()
    store.write("profiles", sid, spark.createDataFrame(_estate(random.Random(2), range(2000)), PROFILES).repartition(4))
    store.commit(sid)
    ids = spark.createDataFrame([(7,), (1999,), (5000,), (None,)], "project_id long")
    found = lk.project_dependencies(store.current("profiles"), ids)
    assert sorted(r.project_id for r in found.collect()) == [7, 1999]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "In(project_id" in plan
    many = spark.range(1500).withColumnRenamed("id", "project_id")
    assert lk.project_profile(store.current("profiles"), many).count() == 1500


@pytest.mark.parametrize("interval", [None, "1m"])
@pytest.mark.parametrize("parts", [0, 1, 3])
def test_streamed_pages_in_a_file_or_a_folder_of_files(spark, tmp_path, parts, interval):
    from bindings.streams import streamed_page_urls

    pages = spark.createDataFrame([(n, f"https://h{n}.acme.io/x", "") for n in range(9)], "page_id long, url string, html string")
    folder = tmp_path / "pages.parquet"
    if parts == 1:
        pages.coalesce(1).write.parquet(str(tmp_path / "one"))
        next((tmp_path / "one").glob("*.parquet")).rename(folder)
    else:
        pages.limit(9 * min(parts, 1)).repartition(max(parts, 1)).write.parquet(str(folder))
    found = streamed_page_urls(spark, str(tmp_path), interval)
    assert {r["name"] for r in found.collect()} == ({f"h{n}.acme.io" for n in range(9)} if parts else set())


def test_a_refresh_without_new_summaries_writes_no_links(spark, store):
    views, parent = EstateViews(store), None
    for text in ("billing invoices and refunds", "billing invoices and refunds", "billing invoices and refunds daily"):
        new = store.begin_snapshot("full" if parent is None else "single_project", parent)
        ids = range(4) if parent is None else [1]
        said = {i: text if i == 1 else "billing invoices and refunds" for i in ids}
        rows = spark.createDataFrame([(i, f"g/{i}", "main", "sha", None, t, None, [], [], [], [], []) for i, t in said.items()], PROFILES)
        store.write("profiles", new, rows)
        store.write("catalog", new, rows.select("project_id", "full_path"))
        views.keep_up(new, parent)
        store.commit(new)
        parent = new
    first, second, third = (store.written("view_links", i, LINKS).count() for i in store.chain(parent))
    assert (first, second, third) == (1, 0, 3)
    assert {r.project_id: r.n_overlap for r in views.conflict_counts(parent).collect()} == dict.fromkeys(range(4), 3)
