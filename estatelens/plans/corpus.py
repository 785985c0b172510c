"""A source-file corpus derived from order lines, for checks and benchmarks.

The given tables hold no source text. Each order line becomes one file of the
project of its supplier, in one of several languages, naming the line's part;
each supplier adds root files, and some a README with a document's text. Each
document also is the README of a project of its own. The same
SQL expressions run on Spark and on the checking engine, so the work grows with
the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.session import spread

_ID = "concat(l_orderkey, '_', l_linenumber, '_', l_partkey)"

# Placeholder to SQL over lineitem or supplier columns.
_SLOTS = {
    "id": _ID,
    "t": "concat('p', l_partkey)",
    "T": "concat('P', l_partkey, '_T')",
    "C": "concat('C', l_partkey % 200)",
    "h": "concat('h', l_partkey % 50)",
    "b": "l_partkey % 24",
    "s": "s_suppkey",
}

OTHER_FILES = [
    ("sql/q@id@.sql", "SELECT * FROM @t@;\n"),
    ("sql/j@id@.sql", "SELECT a.id FROM other_tbl a\nJOIN @t@ b ON a.id = b.id;\n"),
    ("sql/i@id@.sql", "INSERT INTO @t@ (id) VALUES (1);\n"),
    ("sql/u@id@.sql", "UPDATE @t@\n  SET status = 'x' WHERE id = 1;\nDELETE FROM\n  dbo.@t@ WHERE id = 2;\n"),
    (
        "sql/m@id@.sql",
        'MERGE INTO "app"."@t@" USING `stage` s;\nCREATE TABLE IF NOT EXISTS [dbo].[@t@] (id int);\n'
        "select 1 from @t@\n",
    ),
    ("app/a@id@.py", 'class @C@(Base):\n    __tablename__ = "@t@"\n'),
    ("app/d@id@.py", "class @C@(Model):\n    id = 1\n\n    class Meta:\n        db_table = '@t@'\n"),
    ("app/r@id@.rb", "class @C@ < Base\n  self.table_name = '@t@'\nend\n"),
    (
        "app/q@id@.py",
        "from app.models import @C@\nrows = session.query(@C@).all()\nsession.add(@C@(1))\n"
        "n = @C@.objects.filter(1)\nm = @C@.objects.create(2)\nz = @C@.objects.explode(3)\n",
    ),
    ("app/g@id@.py", "op.create_table(\n  '@t@')\nop.rename_table('@t@', \"n_@t@\")\n"),
    (
        "app/u@id@.py",
        "url = \"https://@h@.example.com/v1\"\nalt = 'amqp://user:pw@mq@h@.net'\nloc = 'http://localhost:80/'\n"
        "git = 'git://@h@.example.com/x'\n",
    ),
    (
        "app/c@id@.py",
        "import boto3\nc = boto3.client('sqs')\nd = boto3.resource(\n    \"lambda\")\np = KafkaProducer(x)\n"
        "r = redis.Redis()\n",
    ),
    ("web/r@id@.js", "router.get('/@t@', h);\nfetch('https://@h@.svc.io/a');\naxios.post(\"/b@b@\", d);\n"),
    (
        "web/f@id@.js",
        "fs.readFileSync('in@b@.csv');\nfs.writeFile(\"out@b@.csv\", d);\nproducer.send(m);\n"
        "consumer.subscribe(t);\nprogram.command('x');\n",
    ),
    (
        "web/J@id@.java",
        "@GetMapping(\"/@t@\")\npublic void a() {}\n@RequestMapping\n@Scheduled(cron = \"x\")\n"
        "@KafkaListener(topics = \"t\")\nclass A {}\n",
    ),
    ("ops/y@id@.yaml", "jobs:\n  - x\n  cron: '0 @b@ * * *' # nightly\nschedule:\n  every: 5m\n"),
    (
        "app/w@id@.py",
        "@app.get('/@t@')\ndef view(): pass\n@app.route('/r')\ndef r(): pass\n@app.task\ndef job(): pass\n"
        "@scheduler.scheduled_job('cron@b@')\ndef tick(): pass\n@click.command()\ndef main(): pass\n",
    ),
    (
        "app/k@id@.py",
        "import requests\ndef f(a):\n    requests.get('https://@h@.example.com')\n    open('d@b@.csv', 'w')\n"
        "    argparse.ArgumentParser()\n    consumer.subscribe('t@b@')\n    kafka_producer.send('t@b@')\n    a.save()\n"
        "    cur.execute(\"INSERT INTO @t@ VALUES (1)\")\nif __name__ == '__main__':\n    f(1)\n",
    ),
    ("docs/readme_@id@.md", "SELECT * FROM @t@ and see https://@h@.docs.io/x\n"),
    ("vendor/lib/v@id@.py", "SELECT * FROM @t@\n"),
    (
        "ops/s@id@.yaml",
        "store: https://@t@.s3.amazonaws.com/x\nauth: https://login.acme.com/\nbus: kafka://k@b@:9092\n",
    ),
    ("app/x@id@.py", "def broken(:\n    SELECT * FROM @t@\n"),
]



def _nested(depth: int, inner: str) -> str:
    return "w(" * depth + inner + ")" * depth


GO_FILES = [
    (
        "internal/repository/r@id@_repo.go",
        "package repository\n\nconst q = `SELECT A, B\n  FROM @T@ x JOIN APP.@T@ d`\n"
        'var w = "INSERT INTO @T@ (A) VALUES (1)"\n',
    ),
    (
        "internal/repository/s@id@_repos.go",
        'package repository\n\nvar p = fmt.Sprintf("BEGIN %v.SP_@T@(:1); END;", s)\nvar c = "CALL app.sp_@t@(1)"\n'
        'var d = "SELECT 1 FROM dual"\nvar u = fmt.Sprintf("UPDATE %s.@T@ SET A = 1", s)\n',
    ),
    (
        "internal/adapter/a@id@_adapter.go",
        'package adapter\n\nconst u = "tcp://mq@b@:61616/x"\nconst v = "http://@h@.acme.io?q=1"\n'
        'const w = "tcp://mq@b@:61616/y"\n',
    ),
    ("internal/adapter/b@id@_adapter.go", "package adapter\n"),
    (
        "internal/web/w@id@.go",
        'package web\n\nimport (\n\t"net/http"\n)\n\nfunc Routes(mux *http.ServeMux) {\n'
        '\thttp.HandleFunc("GET /@t@", get)\n\tmux.Handle("/h@b@", h)\n\tmux.Handle(path, h)\n'
        '\t// mux.Handle("/no", h)\n}\n',
    ),
    (
        "internal/jobs/j@id@.go",
        "package jobs\n\nfunc Run() {\n\tc := cron.New(cron.WithSeconds())\n"
        '\tc.AddFunc("0 @b@ * * * *", run)\n\tc.AddJob(cfg.Spec, job)\n\tt := time.NewTicker(5 * time.Second)\n}\n',
    ),
    (
        "internal/jobs/k@id@.go",
        'package jobs\n\nfunc Run() {\n\ts.AddFunc("@daily", run)\n\ttime.AfterFunc(wait, run)\n}\n',
    ),
    (
        "internal/mq/m@id@.go",
        "package mq\n\nfunc Run() {\n"
        '\tsub.Subscribe(ctx, a, domain.SubscriberConfig{Name: "n", Destination: "Q@b@.IN"}, h)\n'
        "\tq.SendMessage(ctx, a, b, &domain.Message{\n\t\tBody: body(1, 2),\n\t\tDestination: dest,\n\t})\n}\n",
    ),
    (
        "internal/io/f@id@.go",
        'package io\n\nfunc Run() {\n\tos.Open("in@b@.csv")\n\tioutil.WriteFile(name, data, 0644)\n'
        '\tos.OpenFile("a@b@.log", os.O_RDONLY, 0644)\n\tos.OpenFile("b@b@.log", os.O_WRONLY|os.O_CREATE, 0644)\n}\n',
    ),
    (
        "cmd/c@id@/main.go",
        "// Package main is tool @t@.\npackage main\n\nfunc main() {\n"
        '\tflag.String("f@b@", "", "u")\n\tflag.Parse()\n}\n',
    ),
    ("internal/tag/t@id@.go", '//go:build linux\n\npackage tag\n\nfunc X() { os.Open("no") }\n'),
    ("internal/c/c@id@.go", 'package c\n\nimport "C"\n\nfunc X() { os.Open("no") }\n'),
    ("vendor/x/v@id@.go", 'package x\n\nfunc X() { os.Open("no") }\n'),
    ("internal/x/y@id@_test.go", 'package x\n\nfunc X() { os.Open("no") }\n'),
    (
        "internal/adapter/z@id@_adapter.go",
        'package adapter\n\nimport (\n\t"go.elastic.co/apm/v2"\n)\n\nconst u = "http://apm@b@:8200"\n',
    ),
    ("ops/@id@.yaml", "cron: '1 1 * * *'\n"),
    (
        "internal/deep/d@id@.go",
        'package deep\n\nimport (\n\t"net/http"\n)\n\nfunc Run() {\n'
        f'\thttp.HandleFunc("/deep/@t@", {_nested(8, "get")})\n\tmux.Handle({_nested(30, "x, y")}, h)\n'
        f'\tsub.Subscribe(ctx, a, domain.SubscriberConfig{{Opts: []T{{{_nested(20, "y")}}}, Destination: "D@b@.IN"}}, h)\n'
        f'\tos.Open({_nested(12, "p[1:2]")})\n\tos.Open("d@b@.csv")\n}}\n',
    ),
]

GO_PROJECT = "s_suppkey % 4 = 0"

# (condition over supplier columns, path, content)
ROOT_FILES = [
    (
        f"NOT ({GO_PROJECT}) AND s_suppkey % 3 = 0",
        "package.json",
        '{"name": "svc-@s@", "description": "Service @s@  of the estate", "bin": {"run-@s@": "./r.js", "n": 3}}',
    ),
    (
        f"NOT ({GO_PROJECT}) AND s_suppkey % 3 = 1",
        "pyproject.toml",
        '[project]\nname = "p@s@"\ndescription = "Project @s@"\n\n[project.scripts]\ncli-@s@ = "a:b"\n',
    ),
    (
        f"NOT ({GO_PROJECT}) AND s_suppkey % 3 = 2",
        "pom.xml",
        "<project><name>n</name><description>Java @s@</description></project>",
    ),
    (f"NOT ({GO_PROJECT}) AND s_suppkey % 7 = 0", "app.py", '"""Doc of @s@.\n\nMore."""\n'),
    (f"NOT ({GO_PROJECT}) AND s_suppkey % 7 = 1", "index.js", "/**\n * Script of @s@.\n */\nrun();\n"),
    (
        f"{GO_PROJECT} AND s_suppkey % 8 = 0",
        "go.mod",
        "// ledger @s@\nmodule github.com/acme/svc@s@ // trail\n\ngo 1.22\n",
    ),
    (f"{GO_PROJECT} AND s_suppkey % 8 <> 0", "go.mod", "module github.com/acme/svc@s@\n\ngo 1.22\n"),
    (
        GO_PROJECT,
        "config/config.go",
        'package config\n\nconst (\n\tapiURL = "https://api@s@.acme.io:8080/v1?q=1"\n\tPOOL_URL = "pool"\n'
        '\tKAFKA_BROKER = "b1"\n\tInQueue = "Q.IN"\n\tOutTopic = "T.OUT"\n)\n',
    ),
    (
        f"{GO_PROJECT} AND s_suppkey % 8 = 4",
        "internal/helper.go",
        "package helper\n\nfunc New() { activemq.NewSubscriber() }\n",
    ),
]

README_IF = "s_suppkey % 5 <> 0"
SHA_OF = {"l": "md5(concat('sha', l_suppkey))", "s": "md5(concat('sha', s_suppkey))"}


def sql_text(template: str) -> str:
    """SQL that builds a text with its slots filled; newlines and quotes by character code."""
    codes = {"\n": "chr(10)", "\t": "chr(9)", "'": "chr(39)", '"': "chr(34)"}
    names = "|".join(_SLOTS)
    slots = re.findall(rf"@({names})@", template)
    texts = re.split(rf"@(?:{names})@", template)
    out = []
    for n, chunk in enumerate(texts):
        for piece in re.split(r"([\n\t'\"])", chunk):
            if piece:
                out.append(codes.get(piece) or f"'{piece}'")
        if n < len(slots):
            out.append(_SLOTS[slots[n]])
    return f"concat({', '.join(out)})"


def _case(templates: list[tuple[str, str]], part: int) -> str:
    arms = " ".join(f"WHEN {n} THEN {sql_text(t[part])}" for n, t in enumerate(templates))
    return f"CASE (l_orderkey + 3 * l_linenumber) % {len(templates)} {arms} END"


def _line_columns() -> dict[str, str]:
    def either(part: int) -> str:
        return f"CASE WHEN l_suppkey % 4 = 0 THEN {_case(GO_FILES, part)} ELSE {_case(OTHER_FILES, part)} END"

    return {
        "project_id": "l_suppkey",
        "commit_sha": f"CASE WHEN l_linenumber = 7 THEN 'stale' ELSE {SHA_OF['l']} END",
        "path": either(0),
        "content": either(1),
    }


#: Slots of the line templates, each with a character that no template holds.
_MARKS = {name: chr(n) for n, name in enumerate((n for n in _SLOTS if n != "s"), start=1)}


def _picked(part: int) -> Column:
    """The text of each line's template with its slots filled, as ``_line_columns`` says it in SQL.

    A template is looked up and its slots replaced: one concatenation per
    template, as in the SQL, makes a method too long for the JVM to compile.
    """

    def of(templates: list[tuple[str, str]]) -> Column:
        marked = [re.sub(rf"@({'|'.join(_MARKS)})@", lambda m: _MARKS[m[1]], t[part]) for t in templates]
        return F.get(F.array(*[F.lit(t) for t in marked]), F.expr(f"CAST((l_orderkey + 3 * l_linenumber) % {len(templates)} AS INT)"))

    out = F.when(F.expr("l_suppkey % 4 = 0"), of(GO_FILES)).otherwise(of(OTHER_FILES))
    used = {name for t in [*GO_FILES, *OTHER_FILES] for name in re.findall(rf"@({'|'.join(_MARKS)})@", t[part])}
    for name in sorted(used):
        out = F.replace(out, F.lit(_MARKS[name]), F.expr(f"CAST({_SLOTS[name]} AS STRING)"))
    return out


def _line_files(lines: DataFrame) -> DataFrame:
    """One file per order line."""
    texts = {"path": _picked(0), "content": _picked(1)}
    return lines.select(*[(texts[name] if name in texts else F.expr(sql)).alias(name) for name, sql in _line_columns().items()])


PROJECT_COLUMNS = {
    "project_id": "s_suppkey",
    "full_path": "concat('estate/', s_name)",
    "branch": "'uat'",
    "commit_sha": f"CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE {SHA_OF['s']} END",
    "description": "CASE WHEN s_suppkey % 6 = 5 THEN concat('  Desc   of ', s_name, ' ') WHEN s_suppkey % 6 = 4 THEN ''"
    " ELSE NULL END",
}


DOCUMENT_PROJECT = "1000000000 + doc_id"
DOCUMENT_SHA = f"md5(concat('sha', {DOCUMENT_PROJECT}))"
DOCUMENT_COLUMNS = {
    "project_id": DOCUMENT_PROJECT,
    "full_path": "concat('docs/', doc_id)",
    "branch": "'uat'",
    "commit_sha": DOCUMENT_SHA,
    "description": "CAST(NULL AS {text})",
}
DOCUMENT_README = {
    "project_id": DOCUMENT_PROJECT,
    "commit_sha": DOCUMENT_SHA,
    "path": "'README.md'",
    "content": "concat('# Document ', doc_id, chr(10), chr(10), text)",
}


def _root_columns(path: str, content: str) -> dict[str, str]:
    return {
        "project_id": "s_suppkey",
        "commit_sha": SHA_OF["s"],
        "path": f"'{path}'",
        "content": content,
    }


_README = "concat('# ', s_name, chr(10), chr(10), text)"


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in columns.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All landed files, stale commits, vendored and unwanted paths included."""
    supplier = table(spark, sf_dir, "supplier")
    out = _line_files(spread(table(spark, sf_dir, "lineitem")))
    for condition, path, content in ROOT_FILES:
        out = out.unionByName(
            supplier.filter(condition).selectExpr(*_select(_root_columns(path, sql_text(content))))
        )
    documents = table(spark, sf_dir, "documents")
    readme = supplier.filter(README_IF).join(documents, supplier["s_suppkey"] == documents["doc_id"])
    return out.unionByName(readme.selectExpr(*_select(_root_columns("README.md", _README)))).unionByName(documents.selectExpr(*_select(DOCUMENT_README)))


def corpus_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, and documents as projects of their own."""
    own = [x.replace("{text}", "STRING") for x in _select(DOCUMENT_COLUMNS)]
    return table(spark, sf_dir, "supplier").selectExpr(*_select(PROJECT_COLUMNS)).unionByName(table(spark, sf_dir, "documents").selectExpr(*own))


def projects_sql() -> str:
    """The projects for the checking engine."""
    own = ", ".join(_select(DOCUMENT_COLUMNS)).replace("{text}", "VARCHAR")
    return f"SELECT {', '.join(_select(PROJECT_COLUMNS))} FROM supplier UNION ALL SELECT {own} FROM documents"


def corpus_sql() -> str:
    """The same two tables as common table expressions for the checking engine."""
    parts = [f"SELECT {', '.join(_select(_line_columns()))} FROM lineitem"]
    for condition, path, content in ROOT_FILES:
        columns = ", ".join(_select(_root_columns(path, sql_text(content))))
        parts.append(f"SELECT {columns} FROM supplier WHERE {condition}")
    columns = ", ".join(_select(_root_columns("README.md", _README)))
    parts.append(f"SELECT {columns} FROM supplier JOIN documents ON s_suppkey = doc_id WHERE {README_IF}")
    parts.append(f"SELECT {', '.join(_select(DOCUMENT_README))} FROM documents")
    union = "\nUNION ALL\n".join(parts)
    return f"projects AS ({projects_sql()}),\nfiles AS ({union})"
