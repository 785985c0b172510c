"""Laid-out files reach the same readers as files that lie as they come."""

from estatelens.operators.io_regex import js_io, yaml_cron
from estatelens.operators.python_sites import python_call_sites
from estatelens.plans.refresh import by_shape, lay_out, purpose_candidates
from estatelens.sources.admission import family
from pyspark.sql import functions as F


def test_readme_paths_reach_prose_and_code_readers(spark, make_files, make_projects):
    files = make_files(
        {
            "readme-tools/app.js": "router.get('/a', h)",
            "readme/x.py": "import os\nos.system('x')",
            "README.yaml": "cron: '0 5 * * *'",
            "readme_gen.go": "package main",
            "README.md": "# T\n\nSome prose here.",
            "src/README": "not at the root",
        }
    )
    projects = make_projects((1, "g/a", "main", "sha", None))
    flat, laid = by_shape(files), lay_out(files)

    def rows(split):
        every = split.everything
        found = [
            js_io(split.of(every, "script")).select("path"),
            yaml_cron(split.of(every, "yaml")).select("path"),
            python_call_sites(split.of(every, "python")).select("path"),
            split.of(split.go, "go").filter(F.col("path").endswith(".go")).select("path"),
            purpose_candidates(projects, split).select(F.concat("source", F.lit(" "), "path").alias("path")),
        ]
        return sorted(r["path"] for df in found for r in df.collect())

    assert rows(flat) == rows(laid)
    assert {"readme-tools/app.js", "readme/x.py", "README.yaml", "readme_gen.go", "readme README.md"} <= set(rows(laid))
    kinds = {r["path"]: r["f"] for r in files.select("path", family(F.col("path")).alias("f")).collect()}
    assert kinds["README.yaml"] == "readme_yaml" and kinds["readme-tools/app.js"] == "script" and kinds["src/README"] == "other"


def test_a_project_of_many_and_large_files_is_read_whole(spark, make_files, make_projects):
    from estatelens.plans.refresh import admitted_files

    late = "x = 1\n" * 200_000 + "q = 'INSERT INTO t VALUES (1)'\n"
    files = make_files({f"f{i:05}.py": "x = 1" for i in range(6000)} | {"zz.py": late})
    kept = admitted_files(files, make_projects((1, "g/a", "main", "sha", None)))
    assert kept.count() == 6001
    sites = python_call_sites(make_files({"a.py": "q = '" + "-" * 5000 + " INSERT INTO t'"}))
    assert sites.filter(F.col("text").contains("INSERT")).count() == 1
