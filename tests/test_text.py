import pytest
from pyspark.sql import functions as F

from estatelens.functions import text as tx
from estatelens.functions.hosts import host_kind, is_local_host, scheme_kind
from estatelens.functions.identifiers import (
    accept_proc,
    accept_table,
    clean_ident,
    clean_ident_schema,
    module_tail,
    open_reads,
    open_writes,
    parse_duration,
    route_path,
    route_verb,
)


@pytest.fixture(scope="module")
def apply(spark):
    def run(function, *values):
        df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string")
        return [r[0] for r in df.orderBy("n").select(function(F.col("v"))).collect()]

    return run


def test_collapse_handles_unicode_blanks(apply):
    assert apply(tx.collapse_ws, " a \n b ", " \t", None, "x") == ["a b", None, None, "x"]


def test_truncate_backs_up_to_a_blank(apply):
    long_words = "word " * 300
    solid = "x" * 1200
    got = apply(tx.truncate_words, "short", long_words, solid, " " + solid)
    assert got[0] == "short"
    assert got[1] == ("word " * 200).rstrip() and len(got[1]) == 999
    assert got[2] == solid[:1000]
    assert got[3] == (" " + solid)[:1000]


def test_tokens_keep_order_and_singularise(apply):
    assert apply(tx.content_tokens, "The users' Orders is bus gas", "of the", "pay-as") == [
        ["user", "order", "bus", "gas"],
        [],
        ["pay"],
    ]


def test_keys_ignore_multi_word_markers_only(apply):
    keys = apply(
        lambda c: tx.responsibility_key(tx.key_tokens(c)),
        "Is responsible for billing invoices",
        "Does not own billing invoices",
        "Owns billing invoices",
        "the owner of",
    )
    assert keys == ["billing invoice", "billing invoice", "own billing", None]


def test_stance_negative_dominates(apply):
    assert apply(tx.ownership_stance, "Handles X", "delegates Y but owns Z", "plain", "is  the\nowner of q") == [
        "owner",
        "delegator",
        None,
        "owner",
    ]


def test_excerpt(apply):
    text = "a" * 78 + " bcd"
    assert apply(tx.excerpt, "x  y", "b" * 80, text) == ["x y", "b" * 80, "a" * 78 + "…"]


def test_quoted(apply):
    assert apply(tx.quoted, "a", "it's", "it's \"q\"", "back\\slash\n") == ["'a'", '"it\'s"', "'it\\'s \"q\"'", "'back\\\\slash\\n'"]


def test_jaccard(spark):
    df = spark.sql("SELECT array('a','b','b') AS a, array('b','c') AS b, array() AS e")
    row = df.select(tx.jaccard("a", "b"), tx.jaccard("e", "e")).first()
    assert row[0] == pytest.approx(1 / 3) and row[1] == 0.0


def test_hosts(apply):
    assert apply(host_kind, "X.auth0.com", "a.s3.amazonaws.com", "s3-eu-west-1.amazonaws.com", "sqs.eu.aws", "my-redis", "a.io") == [
        "auth_provider",
        "object_store",
        "object_store",
        "message_broker",
        "cache",
        "http_api",
    ]
    assert apply(is_local_host, "[::1]", "LOCALHOST", "a.local", "local.io") == [True, True, True, False]
    assert apply(lambda c: scheme_kind(c, F.lit("a.io")), "kafka", "S3", "ftp", "https", "grpc") == [
        "message_broker",
        "object_store",
        None,
        "http_api",
        "other",
    ]


def test_identifiers(apply):
    raw = ['"public"."users"', "[dbo].[t]", "`x`", "a.b"]
    assert apply(clean_ident, *raw) == ["users", "t", "x", "b"]
    assert apply(clean_ident_schema, *raw) == ["public.users", "dbo.t", "x", "a.b"]
    names = ["APP.T", "AB", "ABC", "DUAL", "App.T", "SELECT.T", "T_1.", ""]
    assert apply(accept_table, *names) == [True, False, True, False, False, False, False, False]
    assert apply(accept_proc, "app.sp_do", "sp", "x", "do_it") == [True, False, False, True]


def test_modes_routes_modules_durations(apply):
    modes = ["r", "rb+", "w", "a+", "xt", ""]
    assert apply(open_reads, *modes) == [True, True, False, True, False, True]
    assert apply(open_writes, *modes) == [False, True, True, True, True, False]
    routes = ["GET /a b", "get /a", "GET  /x", "/p", "GET "]
    assert apply(route_verb, *routes) == ["GET", "ANY", "GET", "ANY", "ANY"]
    assert apply(route_path, *routes) == ["/a b", "get /a", " /x", "/p", "GET "]
    assert apply(module_tail, "h/o/r/v2", "h/o", "svc") == ["r/v2", "h/o", "svc"]
    assert apply(parse_duration, " 5m ", "60", "2 h", "1d", "5w", "-1s", "") == [300, 60, 7200, 86400, None, None, None]
