"""The driver contract, on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "customer documents events lineitem orders pages part supplier".split()
CHECKED = [
    "shared_table_edges", "purpose_conflicts", "table_hits_general", "service_hits_general", "go_table_hits",
    "io_go_pruned", "purpose_picked", "text_content_tokens",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["project_id_a", "project_id_b", "table_name", "label"] and df.count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(tuple("" if v is None else str(v) for v in r) for r in df.select(*cols).collect())
    theirs = duck.sql(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert ours == sorted(tuple("" if v is None else str(v) for v in r) for r in theirs)


def test_root_readmes_of_their_own_query(spark, duck):
    cols = "project_id, source, priority, path, text"
    ours, every = (entry.queries()[name](spark, SF).select(*cols.split(", ")).collect() for name in ("purpose_readme", "purpose_candidates"))
    theirs = duck.sql(f"SELECT {cols} FROM ({entry.oracle_sql()['purpose_readme']})").fetchall()
    assert len(ours) > 0 and sorted(map(tuple, ours)) == sorted(theirs) == sorted(tuple(r) for r in every if r.source == "readme")
