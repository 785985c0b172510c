import pytest
from pyspark.sql import functions as F

from estatelens.operators import go_sites as go
from estatelens.operators.io_regex import java_io, js_io, yaml_cron
from estatelens.operators.manifests import manifest_candidate, manifest_cli, manifest_facts
from estatelens.operators.profiles import check_profiles, degraded_sections
from estatelens.operators.purpose import docstring_candidate, pick_purpose, readme_prose
from estatelens.operators.python_sites import python_call_sites, python_io
from estatelens.plans.refresh import analyze

D = ["direction", "category", "description"]


def test_javascript(make_files, rows_of):
    files = make_files(
        {
            "a.ts": "router.POST( `/x`, h)\nserver.get('/y', h); fetch(\"it's\")\naxios . put('/z')\nfsPromises.writeFile('o')\n"
            "kafkaConsumer.run()\ncommander.command('c')\nproducer.send(1); producer.send(2)",
            "b.txt": "app.get('/no', h)",
        }
    )
    assert rows_of(js_io(files), *D) == [
        ("in", "http_request", "HTTP POST /x handler in a.ts"),
        ("out", "http_response", "HTTP POST response for /x in a.ts"),
        ("in", "http_request", "HTTP GET /y handler in a.ts"),
        ("out", "http_response", "HTTP GET response for /y in a.ts"),
        ("out", "external_call", "External HTTP call via fetch('it') in a.ts"),
        ("out", "external_call", "External HTTP PUT via axios('/z') in a.ts"),
        ("out", "file_written", "File write via fs.* ('o') in a.ts"),
        ("out", "message_published", "Message publisher detected in a.ts"),
        ("in", "message_consumed", "Message consumer detected in a.ts"),
        ("in", "cli_argument", "CLI command registered via commander in a.ts"),
    ]


def test_java_and_yaml(make_files, rows_of):
    files = make_files(
        {
            "A.java": '@PostMapping(value = "/a")\n@RequestMapping\n@Scheduled\n@JmsListener(d)\n@DeleteMapping("")',
            "s.yml": "on:\n  schedule: \"1 2 * * *\"   # c\n  cron: 5\nschedule:\n    - cron: x\nother: 1\n",
        }
    )
    assert rows_of(java_io(files), *D) == [
        ("in", "http_request", "HTTP POST /a via @PostMapping in A.java"),
        ("out", "http_response", "HTTP POST response from @PostMapping /a in A.java"),
        ("in", "http_request", "HTTP ANY <class-or-method-mapping> via @RequestMapping in A.java"),
        ("out", "http_response", "HTTP ANY response from @RequestMapping <class-or-method-mapping> in A.java"),
        ("in", "http_request", "HTTP DELETE <class-or-method-mapping> via @DeleteMapping in A.java"),
        ("out", "http_response", "HTTP DELETE response from @DeleteMapping <class-or-method-mapping> in A.java"),
        ("in", "scheduled_event", "Scheduled task via @Scheduled in A.java"),
        ("in", "message_consumed", "Message consumer via @JmsListener in A.java"),
    ]
    assert rows_of(yaml_cron(files), "description") == [
        ("Scheduled event (1 2 * * *) declared in s.yml",),
        ("Scheduled event (5) declared in s.yml",),
        ("Scheduled event (- cron: x) declared in s.yml",),
    ]


def test_python(make_files, rows_of):
    files = make_files(
        {
            "a.py": '@bp.route("")\n@bp.head("/h")\nasync def f(): pass\n@task\ndef g(): pass\n@cli.command\ndef c(): pass\n@periodic_task()\ndef p(): pass\n'
            "open(name)\nopen('x', mode='r+b')\nPath('a').write_bytes(b'')\nurllib.request.urlopen('u')\nch.basic_consume(queue='q')\n"
            "sqs.receive_message()\nch.basic_publish()\nsqs.send_message()\nself.publish('no')\nbroker.publish(t)\nrow.delete()\ndelete()\n"
            "s = 'replace into t values'\nif '__main__' == __name__: pass\n",
            "bad.py": "def (:\n open('x')\n",
        }
    )
    got = rows_of(python_io(python_call_sites(files)), *D)
    assert sorted(got) == sorted(
        [
            ("in", "http_request", "HTTP ANY f handled by f in a.py"),
            ("out", "http_response", "HTTP ANY response from f (f) in a.py"),
            ("in", "http_request", "HTTP HEAD /h handled by f in a.py"),
            ("out", "http_response", "HTTP HEAD response from f (/h) in a.py"),
            ("in", "cli_argument", "CLI command c defined in a.py"),
            ("in", "scheduled_event", "Scheduled task p (periodic_task) in a.py"),
            ("in", "file_read", "File read via open('<dynamic>', mode='r') in a.py"),
            ("in", "file_read", "File read via open('x', mode='r+b') in a.py"),
            ("out", "file_written", "File write via open('x', mode='r+b') in a.py"),
            ("out", "file_written", "File write via .write_bytes('<dynamic>') in a.py"),
            ("out", "external_call", "External HTTP call via urllib.request.urlopen('u') in a.py"),
            ("in", "message_consumed", "RabbitMQ basic_consume('q') in a.py"),
            ("in", "message_consumed", "AWS SQS receive_message in a.py"),
            ("out", "message_published", "RabbitMQ basic_publish in a.py"),
            ("out", "message_published", "AWS SQS send_message in a.py"),
            ("out", "message_published", "Message publish('<unknown>') in a.py"),
            ("out", "database_write", "Database write via .delete() in a.py"),
            ("out", "database_write", "SQL REPLACE statement detected in a.py"),
            ("in", "cli_argument", 'CLI entrypoint via `if __name__ == "__main__":` in a.py'),
        ]
    )


def test_manifests(make_files, rows_of):
    files = make_files(
        {
            "package.json": '{"bin": "./x.js", "description": 5}',
            "pyproject.toml": '[project]\ndescription = " "\n[project.gui-scripts]\nb = "x"\n[tool.poetry]\ndescription = "po  e"\n[tool.poetry.scripts]\nb = "y"\na = "z"\n',
            "pom.xml": '<p xmlns="u"><a/><description>\n pom </description></p>',
            "sub/package.json": '{"bin": "no"}',
        }
    )
    facts = manifest_facts(files)
    assert rows_of(manifest_cli(facts), "description") == [
        ("CLI entrypoint './x.js' declared in package.json",),
        ("CLI entrypoint 'b' declared in pyproject.toml",),
        ("CLI entrypoint 'a' declared in pyproject.toml",),
    ]
    assert rows_of(manifest_candidate(facts), "path", "text") == [("pyproject.toml", "po e")]
    broken = make_files({"package.json": "{", "pyproject.toml": "=", "pom.xml": "<a>"})
    assert manifest_facts(broken).count() == 0


GO = """package main

import "net/http"

func main() {
	r := http.NewServeMux()
	r.HandleFunc(`PUT /a`, func() { r.Handle("/hidden", h) })
	a.b.Handle("/two-names", h)
	fx.Handle("/fx", h)
	/* r.Handle("/c", h) */
	log("r.Handle(\\"/s\\", h)", '"')
	x := []T{r.Handle("/in-slice", h)}
	os.
		ReadFile("f")
	os.WriteFile(p, nil, 0)
	os.OpenFile("g", flags, 0)
}
"""


def test_go_call_sites_ignore_comments_literals_and_arguments(make_files, rows_of):
    sites = go.go_call_sites(make_files({"main.go": GO}))
    found = [(r["receiver"], r["method"], r["line"]) for r in sites.orderBy("start").collect() if r["kind"] == "call"]
    assert found == [
        ("http", "NewServeMux", 6),
        ("r", "HandleFunc", 7),
        ("a.b", "Handle", 8),
        ("fx", "Handle", 9),
        ("", "log", 11),
        ("r", "Handle", 12),
        ("os", "ReadFile", 13),
        ("os", "WriteFile", 15),
        ("os", "OpenFile", 16),
    ]
    assert rows_of(go.go_http_io(sites), "description") == [
        ("HTTP PUT /a via r.HandleFunc() at main.go:7",),
        ("HTTP PUT response for /a via r.HandleFunc() at main.go:7",),
        ("HTTP ANY /in-slice via r.Handle() at main.go:12",),
        ("HTTP ANY response for /in-slice via r.Handle() at main.go:12",),
    ]
    assert rows_of(go.go_file_io(sites), *D) == [
        ("in", "file_read", "file read f via os.ReadFile() at main.go:13"),
        ("out", "file_written", "file written <dynamic> via os.WriteFile() at main.go:15"),
        ("in", "file_read", "file read g via os.OpenFile() at main.go:16"),
        ("out", "file_written", "file written g via os.OpenFile() at main.go:16"),
    ]


def test_long_go_literals_do_not_overflow(make_files):
    text = 'package x\n\nvar s = "' + "a\\n" * 200000 + '"\n\nfunc F() { os.Open(`' + "z" * 300000 + "`) }\n"
    assert [r["method"] for r in go.go_call_sites(make_files({"x.go": text})).orderBy("start").collect()] == ["F", "Open"]


def test_go_skips_and_degraded_lines(make_files):
    files = make_files(
        {
            "a.go": "// +build linux\npackage a\n",
            "b.go": "//go:build !ignore\npackage a\n",
            "c.go": 'package a\nimport (\n\t"fmt"\n\t"C"\n)\n',
            "d.go": 'package a\nimport x "C"\n',
            "e.go": "package a\n//go:build linux\n",
            "pkg/f.go": "//go:build x\n\npackage a\n",
        }
    )
    skips = go.go_skips(files)
    assert {tuple(r) for r in skips.select("path", "reason").collect()} == {
        ("a.go", "build constraint requires toolchain"),
        ("c.go", "cgo directive requires toolchain"),
        ("pkg/f.go", "build constraint requires toolchain"),
    }
    lines = degraded_sections(skips).first()["degraded_sections"]
    assert lines[0] == "purpose: skipped a.go (build constraint requires toolchain)"
    assert [s.split(":")[0] for s in lines] == ["purpose"] * 2 + ["abstract_io"] * 3 + ["external_services"] * 3 + ["database_tables"] * 3


def test_go_commands_and_pruning(make_files, rows_of):
    main = "package main\nfunc main() {}\n"
    files = make_files(
        {
            "go.mod": "module github.com/acme/tools/svc\n",
            "main.go": main,
            "cmd/main.go": main,
            "cmd/w/main.go": "package main\nfunc (s S) main() {}\n",
            "cmd/v/main.go": main,
            "config/config.go": 'package c\nfunc L() { os.Open("x"); flag.BoolVar(&b, name) }\n',
        }
    )
    assert sorted(rows_of(go.go_io(files), "description")) == [
        ("binary svc via func main() at main.go:2",),
        ("binary v via func main() at cmd/v/main.go:2",),
        ("flag <dynamic> via flag.BoolVar() at config/config.go:2",),
    ]


@pytest.mark.parametrize(
    ("text", "prose"),
    [
        ("# T\n\nFirst\n line.\n\nSecond", "First line."),
        ("Title\n---\n\nBody", "Body"),
        ("# T\nsame paragraph", "same paragraph"),
        ("[![a](b)](c)\n[![d](e)](f) [![g](h)](i)\n\n   \n\n====\n", None),
        ("", None),
    ],
)
def test_readme_prose(spark, text, prose):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(readme_prose(F.col("t"))).first()[0] == prose


def test_purpose_sources(make_files, rows_of):
    files = make_files(
        {
            "b.py": '"""Doc  string.\n\nMore."""\n',
            "a.mjs": "/***\n * First\n *\n second\n ***/\n",
            "src/p/__init__.py": "'''no'''",
        }
    )
    assert rows_of(docstring_candidate(files, python_call_sites(files)), "path", "text") == [("a.mjs", "First second")]
    mod = make_files({"go.mod": "go 1.22\n// lead\n  module a.b/c/d/e // trail\n", "z.go": "/* A\n b */\n// c\npackage z\n", "y.go": "// far\n\npackage y\n"})
    assert rows_of(go.gomod_candidates(mod), "priority", "text") == [(3, "lead"), (4, "d/e")]
    assert rows_of(go.package_doc_candidate(mod), "path", "text") == [("z.go", "A b c")]


def test_unknown_purpose_has_a_reason(spark):
    projects = spark.createDataFrame([(1,), (2,)], "project_id long")
    cands = spark.createDataFrame([(1, "s", 2, "p", "two"), (1, "s", 1, "p", "one " * 400)], "project_id long, source string, priority int, path string, text string")
    got = {r["project_id"]: (r["purpose_summary"], r["purpose_summary_reason"]) for r in pick_purpose(projects, cands).collect()}
    assert len(got[1][0]) <= 1000 and got[1][0].startswith("one one") and got[1][1] is None
    assert got[2] == ("unknown", "insufficient source material")


def test_profile_of_a_small_estate(make_files, make_projects):
    files = make_files(
        {"README.md": "Pays bills.", "a.py": "x = 'SELECT 1 FROM bills'\nu = 'https://api.io'\n", "vendor/b.py": "SELECT 1 FROM no"}
    ).unionByName(
        make_files({"go.mod": "module svc\n", "x.go": "//go:build q\npackage x\n", "q.sql": "SELECT 1 FROM no", "internal/repository/a_repo.go": 'var a = "UPDATE LEDGER SET A=1"'}, 2)
    )
    projects = make_projects((1, "g/a", "main", "sha", None), (2, "g/b", "main", "sha", None), (3, "g/c", "main", None, None), (4, "g/d", "main", "sha", " d "))
    got = {r["project_id"]: r for r in analyze(projects, files.repartition(3)).collect()}
    assert set(got) == {1, 2, 4}
    assert got[1]["purpose_summary"] == "Pays bills." and [s["name"] for s in got[1]["services"]] == ["api.io"]
    assert [(t["table_name"], t["access_mode"], t["source_locations"][0]["line"]) for t in got[1]["tables"]] == [("bills", "read", 1)]
    assert [(t["table_name"], t["source_locations"][0]["line"]) for t in got[2]["tables"]] == [("LEDGER", None)]
    assert got[2]["purpose_summary"] == "svc" and len(got[2]["degraded_sections"]) == 4
    assert got[4]["purpose_summary"] == "d" and got[4]["tables"] == [] and got[4]["services"] == []
    assert check_profiles(analyze(projects, files)).count() == 0


def test_sections_of_inputs_and_outputs_read_the_go_tokens_once(spark, make_files):
    from estatelens.plans.refresh import io_hits, lay_out

    files = make_files({"go.mod": "module a/b\n", "main.go": 'package main\n\nfunc main() {\n\tos.Open("a")\n\tflag.Parse()\n\ttime.NewTicker(x)\n}\n'})
    found = io_hits(lay_out(files))
    assert sorted(r["category"] for r in found.collect()) == ["cli_argument", "cli_argument", "file_read", "scheduled_event"]
    # Tokens are dealt by file; what is left are those of struct literals.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [project_id") <= 1
