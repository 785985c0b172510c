"""Long profiles, numbered without a task that holds a project; summaries and counts of snapshots."""

import random

from estatelens.operators.profiles import numbered
from estatelens.operators.snapshots import SnapshotStore, snapshot_summary
from estatelens.schemas import COMMITS
from estatelens.streaming.refresh import publish


def test_numbers_of_a_large_project_spread_over_tasks(spark):
    rows = spark.range(200_000).selectExpr("if(id % 10 = 0, id % 7, 99) AS project_id", "'x' AS section", "xxhash64(id) AS k")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    got = numbered(rows, ["project_id", "section"], ["k"])
    wrong = got.selectExpr("no", "row_number() OVER (PARTITION BY project_id ORDER BY k) AS want").filter("no != want").count()
    assert wrong == 0 and got.count() == 200_000
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert numbered(rows.limit(0), ["project_id", "section"], ["k"]).count() == 0


def test_summaries_add_up_in_any_order(spark):
    rng = random.Random(1)
    rows = [(s, p, rng.choice(["a", "b"])) for s in (1, 2) for p in range(50)]
    commits = spark.createDataFrame([(s, s, "completed", "full", None, None, None, None, None, None, None) for s in (1, 2, 3)], COMMITS)

    def digests(rows):
        df = spark.createDataFrame(rows, "snapshot_id long, project_id long, commit_sha string").repartition(5)
        return {r.snapshot_id: (r.n_projects, r.commits_digest) for r in snapshot_summary(commits, df).collect()}

    first = digests(rows)
    rng.shuffle(rows)
    assert digests(rows) == first and first[3] == (0, 0) and first[1][0] == 50
    same = [(s, p, "a") for s in (1, 2) for p in range(50)]
    assert digests(same)[1] == digests(same)[2] and digests([*same[:-1], (2, 49, "b")])[2] != digests(same)[2]


def test_counts_come_with_the_write(spark, make_files, make_projects, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"), 2)
    projects = make_projects((1, "g/a", "main", "sha", "one"), (2, "g/b", "main", "sha", "two"), (3, "g/c", "main", None, None))
    files = make_files({"a.py": "x"}, 1).unionByName(make_files({"b.py": "x"}, 2))
    publish(store, projects, files)
    publish(store, projects.filter("project_id <> 2"), files.filter("project_id = 1"))
    publish(store, projects.filter("project_id = 2"), files.filter("project_id = 2"))  # begins a chain
    got = [(r.profiles_written, r.skipped, len(r.chain)) for r in store.commits().filter("status = 'completed'").orderBy("snapshot_id").collect()]
    assert got == [(2, 1, 1), (1, 1, 2), (1, 0, 1)]
    assert {r.project_id for r in store.current("profiles").collect()} == {1, 2}
