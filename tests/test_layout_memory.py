"""Laying files out by folder: nothing is sorted, and paths and templates read as their rules say."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from estatelens import session
from estatelens.functions.patterns import file_ext
from estatelens.plans import corpus
from estatelens.sources.admission import _in_folder, admit_generic, with_shape


def test_folders_are_written_without_a_sort(spark, monkeypatch):
    plans = []
    rows = spark.range(100).selectExpr("id", "id % 3 AS a", "concat('f', id % 2) AS b")
    write = type(rows.write).parquet

    def watched(self, path, **options):
        plans.append(self._spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"))
        return write(self, path, **options)

    monkeypatch.setattr(type(rows.write), "parquet", watched)
    kept = session.stored(rows, ["a", "b"])
    assert int(plans[0]) >= 6 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    assert sorted(map(tuple, kept.select("id", "a", "b").collect())) == sorted(map(tuple, rows.collect()))


def test_templates_are_what_the_sql_says(spark):
    lines = spark.range(3000).selectExpr("id * 7 - 500 AS l_orderkey", "CAST(id % 9 AS INT) AS l_linenumber", "id * 13 AS l_partkey", "id % 11 AS l_suppkey")
    want = lines.selectExpr(*corpus._select(corpus._line_columns()))
    got = corpus._line_files(lines)
    assert got.schema == want.schema
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


PATHS = ["", "a", "vendor", "vendor/a.go", "x/vendor/a.py", "x\\vendor\\a.py", "x/vendor", "vendored/a.py", "a.", ".py", "x/.py", "a.b.PY", "a..py",
         "x.y/z", "README", "readme.d/x", "x/ReadMe.rst", "package.json", "a/b.java/", "/vendor/", "é.Go"]


def test_paths_read_as_before(spark):
    def segments(p):
        return p.replace("\\", "/").split("/")

    def ext(p):
        m = re.search(r"(?s).(\.[^.]+)\Z", p.split("/")[-1])
        return m[1].lower() if m else ""

    rows = spark.createDataFrame([(p,) for p in PATHS], "path string").select("path", _in_folder(F.col("path"), ["vendor", "b"]).alias("inside"), file_ext(F.col("path")).alias("ext"), admit_generic(F.col("path")).alias("kept"))
    for r in rows.collect():
        assert r.inside == any(s in ("vendor", "b") for s in segments(r.path)[:-1]), r.path
        assert r.ext == ext(r.path), r.path
    assert {r.path for r in rows.collect() if r.kept} >= {"a.b.PY", "x/.py", "README", "x/ReadMe.rst", "package.json"}


@pytest.mark.parametrize("paths, go", [(["go.mod", "a.py"], True), (["vendor/x.go", "a.py"], False), (["a.py"], False)])
def test_shape_is_told_on_every_file(spark, paths, go):
    files = spark.createDataFrame([(1, p) for p in paths] + [(2, "b.py")], "project_id long, path string")
    got = {(r.project_id, r.path): r.has_go for r in with_shape(files).collect()}
    assert got == {(1, p): go for p in paths} | {(2, "b.py"): False}
