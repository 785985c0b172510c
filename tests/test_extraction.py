import re

import pytest
from pyspark.sql import functions as F

from estatelens.functions.patterns import needed_word
from estatelens.operators import coalesce as co
from estatelens.operators import services as sv
from estatelens.operators import tables as tb
from estatelens.operators.go_services import apm_only, go_service_hits
from estatelens.operators.go_tables import go_table_hits
from estatelens.sources.admission import admit, admit_generic, admit_go, cap_files, service_scannable

T = ["table_name", "access_mode", "path", "line"]
S = ["name", "kind", "path", "line"]


def test_sql_references_of_every_kind(make_files, rows_of):
    files = make_files(
        {
            "q.sql": "select * from `A` join \"s\".\"b\" x\nInsert Into [dbo].[c] values (1)\nDELETE FROM\n  d\nupdate e set x = 1\n"
            "CREATE TEMP TABLE IF NOT EXISTS f (i int)\nMERGE INTO g USING h\nupdate of prose\n",
        }
    )
    assert sorted(rows_of(tb.sql_hits(files), *T)) == sorted(
        [
            ("A", "read", "q.sql", 1),
            ("b", "read", "q.sql", 1),
            ("c", "write", "q.sql", 2),
            ("d", "write", "q.sql", 3),
            ("e", "write", "q.sql", 5),
            ("f", "write", "q.sql", 6),
            ("g", "write", "q.sql", 7),
        ]
    )


def test_import_lines_are_no_references(make_files, rows_of):
    files = make_files({"a.py": "from app.models import users\n  from x import y  # select 1 from z\nq = 'select 1 from real'\n"})
    assert rows_of(tb.sql_hits(files), *T) == [("real", "read", "a.py", 3)]


def test_docs_are_skipped_whatever_their_case(make_files, rows_of):
    files = make_files({n: "SELECT * FROM t" for n in ["a.MD", "b.rst", "c.Txt", "d.adoc", "e.markdown", "f.sql"]})
    assert rows_of(tb.table_hits(files), "path") == [("f.sql",)]


def test_models_migrations_and_queries(make_files, rows_of):
    files = make_files(
        {
            "m.py": 'class User(Base):\n    __tablename__ = "users"\n\nclass Order(Model):\n    class Meta:\n        db_table = \'orders\'\n',
            "m.rb": "class Pet\n  self.table_name = 'pets'\nend\n",
            "q.py": "User.query.all()\nsession.query( Order )\nselect(User)\nsession.add(User(1))\nOrder.objects.create()\n"
            "Order.objects.weird()\nOther.query\n",
            "v.py": "op.rename_table('old', \"new\")\nop.drop_table(\n  'gone')\n",
        }
    )
    assert rows_of(tb.table_hits(files), *T) == [
        ("users", "write", "m.py", 2),
        ("orders", "write", "m.py", 6),
        ("pets", "write", "m.rb", 2),
        ("gone", "write", "v.py", 2),
        ("old", "write", "v.py", 1),
        ("new", "write", "v.py", 1),
        ("users", "read", "q.py", 1),
        ("users", "read", "q.py", 3),
        ("users", "write", "q.py", 4),
        ("orders", "read", "q.py", 2),
        ("orders", "write", "q.py", 5),
    ]


def test_shared_pass_equals_own_passes(make_files, rows_of):
    files = make_files(
        {
            "a.py": "class U(B):\n  __tablename__='t'\nU.query\nop.create_table('c')\nx = \"SELECT 1 FROM s\"\nredis.Redis()\n",
            "b.md": "redis.Redis()\nSELECT 1 FROM doc\n",
        }
    )
    hits = tb.scan(files, [*sv.client_rules(), *tb.all_rules()])
    assert rows_of(tb.table_hits(files, hits), *T) == rows_of(tb.table_hits(files), *T)
    assert rows_of(sv.service_hits(files, hits), *S) == rows_of(sv.service_hits(files), *S)


@pytest.mark.parametrize(
    ("modes", "expected"),
    [
        (["unknown"], "unknown"),
        (["unknown", "read"], "read"),
        (["unknown", "write"], "write"),
        (["read", "write"], "read_write"),
        (["read_write", "unknown"], "read_write"),
    ],
)
def test_mode_lattice(spark, modes, expected):
    hits = spark.createDataFrame([(1, "t", m, "p", n, n) for n, m in enumerate(modes)], "project_id long, table_name string, access_mode string, path string, line int, seq int")
    assert co.coalesce_tables(hits).first()["access_mode"] == expected
    row = co.tables_with_locations(hits).first()
    assert row["access_mode"] == expected and len(row["source_locations"]) == len(modes)


def test_urls(make_files, rows_of):
    files = make_files(
        {
            "a.py": "x = 'HTTPS://Api.X.io/v1?q', y = \"http://localhost:8\"\nz = 'amqp://user:pw@host' ssh://no.io\n"
            "t = 'https://${HOST}/x' b = http://[2001:db8::1]:80/\n",
            "README.md": "https://doc.io",
            "node_modules/x.js": "https://dep.io",
        }
    )
    assert rows_of(sv.service_hits(files), *S) == [
        ("api.x.io", "http_api", "a.py", 1),
        ("user", "message_broker", "a.py", 2),
        ("2001:db8::1", "http_api", "a.py", 3),
    ]
    strict = rows_of(sv.url_hits(files.filter("path = 'a.py'"), strict_userinfo=True), "name")
    assert ("host",) in strict and ("user",) not in strict


def test_clients_and_kind_choice(make_files):
    files = make_files(
        {
            "a.py": "boto3.client(\n 'sqs')\nboto3 . resource(\"lambda\")\nKafkaProducer( )\nminio.Minio(x)\npika.BlockingConnection\n",
            "b.py": "KafkaConsumer(1)\ny = 'https://redis'\n",
        }
    )
    got = {r["name"]: (r["kind"], [tuple(s) for s in r["source_locations"]]) for r in co.services_with_locations(sv.service_hits(files)).collect()}
    assert got == {
        "aws-sqs": ("message_broker", [("a.py", 1)]),
        "aws-lambda": ("other", [("a.py", 3)]),
        "kafka": ("message_broker", [("a.py", 4), ("b.py", 1)]),
        "minio": ("object_store", [("a.py", 5)]),
        "rabbitmq": ("message_broker", [("a.py", 6)]),
        "redis": ("cache", [("b.py", 2)]),
    }


def test_go_tables_only_in_repository_files(make_files, rows_of):
    sql = 'package r\nvar q = `SELECT A FROM %v.LEDGER l JOIN app.low x`\nvar p = "BEGIN x.sp_do(1); END;"\nvar d = "DELETE FROM S.T"\n'
    files = make_files(
        {
            "internal/repository/a_repo.go": sql,
            "internal/repository/b_repos.go": 'var q = "Automatically close issues from merge requests"\nvar r = "SELECT 1 FROM DUAL, T1"\n',
            "internal/repository/sub/c_repo.go": sql,
            "internal/repository/d_repo_test.go": sql,
            "internal/other.go": sql,
            "vendor/internal/repository/e_repo.go": sql,
        }
    )
    assert rows_of(go_table_hits(files), *T) == [
        ("LEDGER", "read", "internal/repository/a_repo.go", None),
        ("x.sp_do", "unknown", "internal/repository/a_repo.go", None),
        ("S.T", "write", "internal/repository/a_repo.go", None),
    ]


def test_go_services(make_files, rows_of):
    files = make_files(
        {
            "config/config.go": 'const (\n A_URL = "https://u@api.io:1/v?q"\n POOL_HOST = "p"\n MQ_BROKER = "b"\n InQueue = "Q"\n)\n',
            "internal/adapter/mq_adapter.go": 'var a = "tcp://m1:1"\nvar b = "stomp://m2/x"\nvar c = "tcp://m1:1"\n',
            "internal/adapter/none_adapter.go": "package a\n",
            "internal/adapter/apm_adapter.go": 'import (\n\t"go.elastic.co/apm/v2"\n)\nvar a = "http://x"\n',
            "internal/helper/helper.go": "stomp.NewClient()\n",
        }
    )
    assert rows_of(go_service_hits(files), *S) == [
        ("api.io:1", "http_api", "config/config.go", 2),
        ("pool", "other", "config/config.go", 3),
        ("mq", "message_broker", "config/config.go", 4),
        ("mq (m1:1, m2)", "message_broker", "internal/adapter/mq_adapter.go", 1),
        ("none", "other", "internal/adapter/none_adapter.go", None),
        ("activemq", "message_broker", "internal/helper/helper.go", None),
        ("activemq", "message_broker", "config/config.go", 5),
    ]
    only = files.filter(apm_only(F.col("content"))).select("path").collect()
    assert [r[0] for r in only] == ["internal/adapter/apm_adapter.go"]


def test_admission(spark, make_files):
    paths = ["README", "a/readme.md", "vendor/x.py", "vendor.go", "Vendor/y.py", "Makefile", "x.PY", "go.sum", "third_party/z.go", "q_test.go", "b/go.mod"]
    df = make_files(dict.fromkeys(paths, ""))
    path = F.col("path")
    got = {r[0]: (r[1], r[2], r[3]) for r in df.select(path, admit_generic(path), admit_go(path), service_scannable(path)).collect()}
    assert got == {
        "README": (True, True, True),
        "a/readme.md": (True, True, False),
        "vendor/x.py": (False, False, False),
        "vendor.go": (True, True, True),
        "Vendor/y.py": (True, False, True),
        "Makefile": (False, False, True),
        "x.PY": (True, False, True),
        "go.sum": (False, False, False),
        "third_party/z.go": (True, False, True),
        "q_test.go": (True, False, True),
        "b/go.mod": (True, False, True),
    }
    plain = {r["path"] for r in admit(df).collect()}
    assert "x.PY" in plain and "third_party/z.go" in plain
    modular = admit(df.unionByName(make_files({"go.mod": "module x"})))
    assert {r["path"] for r in modular.collect()} == {"README", "a/readme.md", "vendor.go", "go.mod"}


def test_cap_keeps_the_first_paths_of_big_projects_only(make_files):
    big = make_files({f"f{n:03d}.py": "x" for n in range(50)}, 1)
    small = make_files({f"g{n}.py": "x" for n in range(5)}, 2)
    kept = {(r["project_id"], r["path"]) for r in cap_files(big.unionByName(small), 10, spread=4).collect()}
    assert kept == {(1, f"f{n:03d}.py") for n in range(10)} | {(2, f"g{n}.py") for n in range(5)}


@pytest.mark.parametrize(
    ("pattern", "word"),
    [
        (r"\bINSERT\s+INTO\s+(x|y)", "insert"),
        (r"(?iU)ab?cd*ef{2}ghh+i", "ghh"),
        (r"a|b", ""),
        (r"(?:abc)def", "def"),
        (r"[abc]+\.create_table\s*\(", ".create_table"),
        (r"\w+\d", ""),
        (r"x(?:a[)\]]|\))yz", "yz"),
        (r"longer\.*short", "longer"),
    ],
)
def test_needed_words(pattern, word):
    assert needed_word(pattern) == word
    body = re.sub(r"\A\(\?[A-Za-z]+\)", "", pattern)
    for text in ("INSERT INTO x", "acefghhi", "abcddeffghhhi", "a", "abcdef", "b.create_table (", "xa)yz", "x)yz", "longershort", "z9"):
        if re.search(body, text):
            assert word in text.lower()
