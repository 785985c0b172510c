"""Long stages are split into methods that the JVM compiles."""

from __future__ import annotations

from bindings import source_code
from estatelens import session
from estatelens.plans import refresh

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def test_long_stages_are_split_in_queries_and_in_the_analysis(spark, make_files, make_projects, monkeypatch, tmp_path):
    seen = []
    monkeypatch.setattr(refresh, "_analyzed", lambda projects, files: seen.append(spark.conf.get(LIMIT)))
    before = spark.conf.get(LIMIT)
    refresh.analyze(make_projects((1, "p", "uat", "sha", None)), make_files({"a.py": ""}))
    assert seen == ["8000"] and spark.conf.get(LIMIT) == before
    key = (spark.sparkContext.applicationId, str(tmp_path))
    monkeypatch.setitem(source_code._SPLITS, key, "laid out")
    try:
        assert source_code.split(spark, str(tmp_path)) == "laid out" and spark.conf.get(LIMIT) == "8000"
    finally:
        spark.conf.set(LIMIT, before)
    assert session.COMPILED_METHODS == {LIMIT: "8000"}
