"""A scan for URLs: what a file costs stays small, and results stay those of the rules."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from estatelens import rules
from estatelens.operators import services
from estatelens.sources.admission import service_scannable


def test_hosts_are_not_searched_again_by_each_rule(make_files):
    files = make_files({"a.py": "x = 'https://u:pw@H.acme.io:8080/v?q' + \"kafka://k1:9092\"\ny = 'http://[::1]/' 'git://g.io/x' 'redis://r.io'\n"})
    hits = services.url_hits(files)
    assert sorted(map(tuple, hits.select("name", "kind", "line").collect())) == [("k1", "message_broker", 1), ("r.io", "cache", 2), ("u", "http_api", 1)]
    # One search per group; the rules for hosts read what it found.
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(" not in plan and plan.count("regexp_extract_all(") == 2


def test_paths_are_read_by_few_conditions(spark):
    def scannable(p):
        *folders, name = re.split(r"[/\\]", p)
        low = name.lower()
        return not (
            set(folders) & set(rules.NO_SERVICE_FOLDERS) or name in rules.NO_SERVICE_NAMES
            or low.endswith(tuple(rules.NO_SERVICE_EXTENSIONS)) or low.startswith(tuple(rules.NO_SERVICE_PREFIXES))
        )

    names = ["a.py", "License", "x.LICENSE", "a.MIN.JS", "amin.js", "a.md\n", "go.sum", "xgo.sum", "CHANGELOG.py", "a.mdx", "", "svg", ".svg"]
    paths = [f"{d}{s}{n}" for d in ["", "src", "env", "x/.git", "xenv", "envx", "a.git", "a\nb", "ENV", "/env"] for s in ["/", "\\"] for n in names]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", service_scannable(F.col("path")).alias("ok"))
    assert {r.path: r.ok for r in rows.collect()} == {p: scannable(p) for p in paths}
    shown = rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert shown.count("translate(") <= 2
