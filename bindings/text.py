"""Text scalars on documents, pages, parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatelens import rules
from estatelens.functions import text as tx
from estatelens.functions.hosts import host_kind, is_local_host, scheme_kind
from estatelens.functions.identifiers import (
    accept_proc,
    accept_table,
    binary_name,
    clean_ident,
    clean_ident_schema,
    module_tail,
    open_reads,
    open_writes,
    parse_duration,
    route_path,
    route_verb,
)
from estatelens.operators.purpose import readme_prose
from estatelens.operators.services import url_columns
from estatelens.plans.corpus import table
from estatelens.sources.admission import admit_generic, admit_go, is_doc, service_scannable


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# --- SQL forms of the text functions, for any expression ----------------------


def sql_flat(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def sql_truncate(c: str) -> str:
    cut = f"substr({c}, 1, {rules.SUMMARY_MAX})"
    head = f"rtrim(regexp_extract({cut}, '(?s)^(.+)[ \\t\\n]', 1), ' ' || chr(9) || chr(10) || chr(13))"
    return f"CASE WHEN length({c}) <= {rules.SUMMARY_MAX} THEN {c} ELSE coalesce(nullif({head}, ''), {cut}) END"


def sql_tokens(c: str) -> str:
    return (
        f"list_transform(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: w NOT IN"
        f" ({sql_list(rules.STOP_WORDS)})), lambda w: CASE WHEN length(w) >= 4 AND right(w, 1) = 's' THEN"
        f" left(w, length(w) - 1) ELSE w END)"
    )


def sql_strip_markers(c: str) -> str:
    out = sql_flat(f"lower({c})")
    phrases = [p for p in rules.OWNER_PHRASES + rules.DELEGATE_PHRASES if " " in p]
    for p in sorted(phrases, key=lambda p: (-len(p), p)):
        out = f"replace({out}, '{p}', ' ')"
    return out


def sql_key_tokens(c: str) -> str:
    inner = sql_tokens(sql_strip_markers(c))
    return f"list_filter({inner}, lambda t: t NOT IN ({sql_list(rules.MARKER_WORDS)}))"


def sql_stance(c: str) -> str:
    flat = sql_flat(f"lower({c})")

    def says(words):
        return " OR ".join(f"contains({flat}, '{w}')" for w in words)

    return (
        f"CASE WHEN {says(rules.DELEGATE_PHRASES)} THEN 'delegator' WHEN {says(rules.OWNER_PHRASES)} THEN 'owner' END"
    )


def sql_excerpt(c: str) -> str:
    n = rules.EXCERPT_MAX
    flat = sql_flat(c)
    return f"CASE WHEN length({flat}) <= {n} THEN {flat} ELSE concat(rtrim(substr({flat}, 1, {n - 1})), '…') END"


# --- derived purpose texts, the same expression on both engines ---------------

SUMMARY = (
    "CASE WHEN doc_id % 17 = 0 THEN 'unknown'"
    " WHEN doc_id % 3 = 1 THEN concat('Is responsible for ', short)"
    " WHEN doc_id % 3 = 2 THEN concat('does not  own ', short) ELSE short END"
)
SUMMARIES_SQL = (
    "summaries AS (SELECT doc_id AS project_id, concat('estate/doc', doc_id) AS full_path, "
    f"{SUMMARY} AS purpose_summary FROM (SELECT doc_id, text AS short FROM documents))"
)


def summaries(spark, sf):
    short = table(spark, sf, "documents").selectExpr("doc_id", "text AS short")
    return short.selectExpr(
        "doc_id AS project_id", "concat('estate/doc', doc_id) AS full_path", f"{SUMMARY} AS purpose_summary"
    )


# --- hosts -------------------------------------------------------------------

_HOST_ENDS = [
    "example.com", "tenant.auth0.com", "login.microsoftonline.com", "s3.amazonaws.com", "blob.core.windows.net",
    "kafka.example.com", "q.servicebus.windows.net", "redis.example.com", "intra.local", "memcached.io",
]
_SCHEMES = ["http", "https", "kafka", "redis", "s3", "git", "grpc", "AMQP"]
_URL = (
    "concat(CASE page_id % 8 "
    + " ".join(f"WHEN {n} THEN '{s}'" for n, s in enumerate(_SCHEMES))
    + " END, '://', CASE WHEN page_id % 7 = 0 THEN 'user@' ELSE '' END, 'w', page_id % 100, '.', CASE page_id % 10 "
    + " ".join(f"WHEN {n} THEN '{h}'" for n, h in enumerate(_HOST_ENDS))
    + " END, '/', url)"
)
_HOST_KIND_SQL = """
CASE WHEN h IN ('accounts.google.com', 'login.microsoftonline.com')
       OR regexp_matches(h, '\\.(auth0|okta|oktapreview)\\.com$') OR contains(h, 'cognito-idp') OR contains(h, 'keycloak')
       OR regexp_matches(h, '^(oauth|auth|login)\\.') THEN 'auth_provider'
     WHEN h IN ('s3.amazonaws.com', 'storage.googleapis.com') OR regexp_matches(h, '\\.s3\\.amazonaws\\.com$')
       OR regexp_matches(h, '^s3[.-][a-z0-9-]+\\.amazonaws\\.com$') OR regexp_matches(h, '\\.storage\\.googleapis\\.com$')
       OR regexp_matches(h, '\\.blob\\.core\\.windows\\.net$') OR contains(h, 'minio') THEN 'object_store'
     WHEN contains(h, 'kafka') OR contains(h, 'rabbitmq') OR regexp_matches(h, '\\.servicebus\\.windows\\.net$')
       OR regexp_matches(h, '^(sqs|sns)\\.') OR regexp_matches(h, '\\.(sqs|sns)\\.amazonaws\\.com$') THEN 'message_broker'
     WHEN contains(h, 'redis') OR contains(h, 'memcached') THEN 'cache'
     ELSE 'http_api' END
"""
_LOCAL_SQL = f"(h IN ({sql_list(rules.LOCAL_HOSTS)}) OR regexp_matches(h, '\\.(localhost|local)$'))"


def sql_scheme_kind(host_kind_sql: str = _HOST_KIND_SQL) -> str:
    arms = " ".join(f"WHEN s = '{k}' THEN '{v}'" for k, v in rules.SCHEME_KINDS.items())
    return (
        f"CASE WHEN s IN ({sql_list(rules.DENIED_SCHEMES)}) THEN NULL {arms}"
        f" WHEN s IN ('http', 'https') THEN {host_kind_sql} ELSE 'other' END"
    )


URL_RE2 = rules.URL_PATTERN.replace("'", "''")


def url_facts(spark, sf):
    urls = table(spark, sf, "pages").selectExpr("page_id", f"{_URL} AS u")
    scheme, host, kind = url_columns(F.col("u"))
    return urls.select(
        "page_id",
        scheme.alias("scheme"),
        F.lower(host).alias("host"),
        host_kind(host).alias("host_kind"),
        is_local_host(host).alias("is_local"),
        scheme_kind(scheme, host).alias("scheme_kind"),
        kind.alias("kind"),
    )


URL_FACTS_SQL = f"""
WITH u AS (SELECT page_id, {_URL} AS u FROM pages),
p AS (SELECT page_id, lower(regexp_extract(u, '{URL_RE2}', 1)) AS s, lower(regexp_extract(u, '{URL_RE2}', 2)) AS h FROM u)
SELECT page_id, s AS scheme, h AS host, {_HOST_KIND_SQL} AS host_kind, {_LOCAL_SQL} AS is_local,
       {sql_scheme_kind()} AS scheme_kind, CASE WHEN NOT {_LOCAL_SQL} THEN {sql_scheme_kind()} END AS kind
FROM p
"""

# --- identifiers -------------------------------------------------------------

_RAW = (
    "CASE p_partkey % 8 WHEN 0 THEN concat('\"public\".\"', p_name, '\"') WHEN 1 THEN concat('[dbo].[t', p_partkey, ']')"
    " WHEN 2 THEN concat('`', p_type, '`') WHEN 3 THEN concat('APP.', p_type, '_', p_partkey) WHEN 4 THEN 'DUAL'"
    " WHEN 5 THEN concat('T', p_partkey % 20) WHEN 6 THEN concat('app.sp_', p_partkey) ELSE concat('db.x', p_partkey) END"
)


def identifiers(spark, sf):
    raw = table(spark, sf, "part").selectExpr("p_partkey", f"{_RAW} AS raw")
    kept = clean_ident_schema(F.col("raw"))
    return raw.select(
        "p_partkey",
        clean_ident(F.col("raw")).alias("bare_name"),
        kept.alias("schema_name"),
        accept_table(kept).alias("table_ok"),
        accept_proc(kept).alias("proc_ok"),
    )


_CLEAN = "trim(translate(raw, '\"`[]''', ''))"


def _accept_sql(shape: str) -> str:
    parts = f"string_split({_CLEAN}, '.')"
    good = (
        f"len(list_filter({parts}, lambda p: regexp_full_match(p, '{shape}') AND lower(p) NOT IN"
        f" ({sql_list(rules.TABLE_STOP_WORDS)}))) = len({parts})"
    )
    return f"({good} AND (len({parts}) > 1 OR length({_CLEAN}) >= 3))"


IDENTIFIERS_SQL = f"""
WITH r AS (SELECT p_partkey, {_RAW} AS raw FROM part)
SELECT p_partkey, trim(split_part({_CLEAN}, '.', -1)) AS bare_name, {_CLEAN} AS schema_name,
       {_accept_sql('[A-Z_][A-Z0-9_]*')} AS table_ok, {_accept_sql('[A-Za-z_][A-Za-z0-9_]*')} AS proc_ok
FROM r
"""

_MODE = (
    "CASE o_orderkey % 8 WHEN 0 THEN 'r' WHEN 1 THEN 'w' WHEN 2 THEN 'rb+' WHEN 3 THEN 'a' WHEN 4 THEN 'x+'"
    " WHEN 5 THEN 'rt' WHEN 6 THEN 'wb' ELSE '' END"
)
_SPAN = (
    "concat(CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE '' END, o_orderkey % 90, CASE o_custkey % 7 WHEN 0 THEN 's'"
    " WHEN 1 THEN 'm' WHEN 2 THEN ' h' WHEN 3 THEN 'd' WHEN 4 THEN '' WHEN 5 THEN 'w' ELSE '.5s' END)"
)


def modes_and_spans(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_MODE} AS m", f"{_SPAN} AS d")
    return o.select(
        "o_orderkey",
        open_reads(F.col("m")).alias("reads"),
        open_writes(F.col("m")).alias("writes"),
        parse_duration(F.col("d")).alias("seconds"),
    )


MODES_SQL = f"""
WITH o AS (SELECT o_orderkey, {_MODE} AS m, trim({_SPAN}) AS d FROM orders)
SELECT o_orderkey,
       CASE WHEN regexp_matches(m, '[wax]') THEN contains(m, '+') ELSE TRUE END AS reads,
       CASE WHEN regexp_matches(m, '[wax]') THEN TRUE ELSE contains(m, '+') END AS writes,
       CASE WHEN regexp_full_match(d, '[0-9]+ *[smhd]?') THEN CAST(regexp_extract(d, '[0-9]+') AS BIGINT)
         * CASE right(d, 1) WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 ELSE 1 END END AS seconds
FROM o
"""

_ROUTE = (
    "CASE page_id % 6 WHEN 0 THEN concat('GET /', page_id) WHEN 1 THEN url WHEN 2 THEN concat('POST  /x', page_id)"
    " WHEN 3 THEN concat('get /', page_id) WHEN 4 THEN 'DELETE' ELSE concat('PATCH ', url) END"
)
_MODULE = (
    "CASE page_id % 4 WHEN 0 THEN concat('github.com/acme/svc', page_id) WHEN 1 THEN concat('svc', page_id)"
    " WHEN 2 THEN concat('host/x', page_id) ELSE concat('git.io/acme/', page_id, '/v2') END"
)


def routes_and_modules(spark, sf):
    p = table(spark, sf, "pages").selectExpr("page_id", f"{_ROUTE} AS r", f"{_MODULE} AS m")
    return p.select(
        "page_id",
        route_verb(F.col("r")).alias("verb"),
        route_path(F.col("r")).alias("route"),
        module_tail(F.col("m")).alias("module_tail"),
        binary_name(F.col("m")).alias("binary_name"),
    )


ROUTES_SQL = f"""
WITH p AS (SELECT page_id, {_ROUTE} AS r, {_MODULE} AS m FROM pages),
q AS (SELECT *, split_part(r, ' ', 1) AS w, strpos(r, ' ') AS gap_at, string_split(m, '/') AS parts FROM p),
k AS (SELECT *, w IN ('GET','POST','PUT','PATCH','DELETE','HEAD','OPTIONS') AND gap_at > 0 AND length(r) > gap_at AS hit FROM q)
SELECT page_id, CASE WHEN hit THEN w ELSE 'ANY' END AS verb, CASE WHEN hit THEN substr(r, gap_at + 1) ELSE r END AS route,
       CASE WHEN len(parts) >= 3 THEN array_to_string(parts[3:], '/') ELSE m END AS module_tail,
       parts[len(parts)] AS binary_name
FROM k
"""

# --- paths -------------------------------------------------------------------

_FOLDERS = ["", "src/", "vendor/lib/", "third_party/x/", "Vendor/", "node_modules/a/", "a/b/dist/", "docs/"]
_NAMES = [
    "README", "readme.md", "go.mod", "main.go", "main_test.go", "package.json", "app.PY", "Makefile", "x.min.js",
    "yarn.lock", "LICENSE.txt", "vendor.go", "q.sql", "Dockerfile", "notes.MarkDown", "logo.svg", "Changelog.py",
]
_PATH = (
    "concat(CASE l_partkey % 8 " + " ".join(f"WHEN {n} THEN '{f}'" for n, f in enumerate(_FOLDERS)) + " END,"
    " CASE (l_orderkey + l_linenumber) % 17 " + " ".join(f"WHEN {n} THEN '{f}'" for n, f in enumerate(_NAMES)) + " END)"
)


def path_admission(spark, sf):
    """S4, S5, S11 and S12 over one path per order line."""
    p = table(spark, sf, "lineitem").selectExpr(f"{_PATH} AS path")
    path = F.col("path")
    return p.groupBy(
        "path",
        admit_generic(path).alias("generic"),
        admit_go(path).alias("go"),
        service_scannable(path).alias("scannable"),
        is_doc(path).alias("doc"),
    ).agg(F.count(F.lit(1)).alias("n"))


ADMIT_GENERIC_SQL = (
    "(NOT regexp_matches(path, '(^|/)vendor/') AND (regexp_matches(lower(base), '^readme') OR base IN"
    f" ({sql_list(rules.MANIFEST_NAMES)}) OR lower(regexp_extract(base, '\\.[^.]*$')) IN ({sql_list(rules.SOURCE_EXTENSIONS)})))"
)
ADMIT_GO_SQL = (
    "(NOT regexp_matches(path, '(^|/)(vendor|third_party)/') AND (regexp_matches(lower(base), '^readme')"
    " OR path = 'go.mod' OR (regexp_matches(base, '\\.go$') AND NOT regexp_matches(base, '_test\\.go$'))))"
)
_FOLDER_ALT = "|".join(f.replace(".", "\\.") for f in rules.NO_SERVICE_FOLDERS)
SCANNABLE_SQL = (
    f"(NOT (regexp_matches(concat('/', path), '/({_FOLDER_ALT})/') OR base IN ({sql_list(rules.NO_SERVICE_NAMES)})"
    f" OR regexp_matches(lower(base), '({'|'.join(e.replace('.', chr(92) + '.') for e in rules.NO_SERVICE_EXTENSIONS)})$')"
    f" OR regexp_matches(lower(base), '^({'|'.join(rules.NO_SERVICE_PREFIXES)})')))"
)
DOC_SQL = "regexp_matches(lower(path), '\\.(md|markdown|rst|txt|adoc)$')"
PATHS_SQL = f"""
WITH p AS (SELECT {_PATH} AS path FROM lineitem), b AS (SELECT path, split_part(path, '/', -1) AS base FROM p)
SELECT path, {ADMIT_GENERIC_SQL} AS generic, {ADMIT_GO_SQL} AS go, {SCANNABLE_SQL} AS scannable, {DOC_SQL} AS doc,
       count(*) AS n
FROM b GROUP BY ALL
"""

# --- README prose ------------------------------------------------------------

_README = (
    "concat(CASE doc_id % 4 WHEN 0 THEN '# Title' WHEN 1 THEN concat('Title', chr(10), '=====') WHEN 2 THEN"
    " '[![b](x)](y) [![c](x)](y)' ELSE '  ## Sub' END, chr(10), chr(10), replace(text, '. ', concat('.', chr(10), chr(10))))"
)


def readme_paragraphs(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", f"{_README} AS content")
    return d.select("doc_id", readme_prose(F.col("content")).alias("prose"))


README_SQL = f"""
WITH d AS (SELECT doc_id, {_README} AS content FROM documents),
p AS (SELECT doc_id, list_transform(regexp_split_to_array(content, '\\n\\s*\\n'),
        lambda p: list_filter(string_split(p, chr(10)), lambda s: trim(regexp_replace(s, '\\s', '', 'g')) <> '')) AS paras FROM d),
k AS (SELECT doc_id, list_filter(list_transform(list_filter(paras, lambda ls: len(ls) > 0 AND NOT (len(ls) >= 2
        AND regexp_matches(ls[len(ls)], '^\\s{{0,3}}(=+|-+)\\s*$'))),
        lambda ls: array_to_string(list_transform(list_filter(ls, lambda s: NOT (regexp_matches(s, '^\\s{{0,3}}#{{1,6}}\\s')
          OR regexp_matches(s, '^\\s{{0,3}}(=+|-+)\\s*$')
          OR regexp_matches(s, '^\\s*(?:\\[!\\[[^\\]]*\\]\\([^)]*\\)\\]\\([^)]*\\)\\s*)+$'))),
          lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), ' ')), lambda t: t <> '') AS texts FROM p)
SELECT doc_id, texts[1] AS prose FROM k
"""


def _documents(columns):
    def run(spark, sf):
        return table(spark, sf, "documents").select("doc_id", *columns())

    return run


def _summary_query(columns):
    def run(spark, sf):
        return summaries(spark, sf).select("project_id", *columns())

    return run


def neighbour_similarity(spark, sf):
    s = summaries(spark, sf).select("project_id", tx.key_tokens("purpose_summary").alias("tokens"))
    nxt = s.select((F.col("project_id") - 1).alias("project_id"), F.col("tokens").alias("next_tokens"))
    return s.join(nxt, "project_id").select("project_id", F.round(tx.jaccard("tokens", "next_tokens"), 6).alias("similarity"))


QUERIES = {
    "text_collapse_whitespace": _documents(lambda: [tx.collapse_ws("text").alias("flat")]),
    "text_truncate_words": _documents(lambda: [tx.truncate_words("text").alias("short")]),
    "text_excerpt": _documents(lambda: [tx.excerpt("text").alias("shown")]),
    "text_content_tokens": _documents(lambda: [F.array_join(tx.content_tokens("text"), " ").alias("tokens")]),
    "text_strip_markers": _summary_query(lambda: [tx.strip_markers("purpose_summary").alias("bare")]),
    "text_responsibility_key": _summary_query(
        lambda: [
            F.array_join(tx.key_tokens("purpose_summary"), " ").alias("tokens"),
            tx.responsibility_key(tx.key_tokens("purpose_summary")).alias("resp_key"),
        ]
    ),
    "text_ownership_stance": _summary_query(lambda: [tx.ownership_stance("purpose_summary").alias("stance")]),
    "text_jaccard_neighbours": neighbour_similarity,
    "url_scheme_host_kinds": url_facts,
    "identifier_cleaning_and_acceptance": identifiers,
    "open_modes_and_durations": modes_and_spans,
    "route_patterns_and_module_paths": routes_and_modules,
    "path_admission_rules": path_admission,
    "readme_prose": readme_paragraphs,
}

ORACLE = {
    "text_collapse_whitespace": f"SELECT doc_id, nullif({sql_flat('text')}, '') AS flat FROM documents",
    "text_truncate_words": f"SELECT doc_id, {sql_truncate('text')} AS short FROM documents",
    "text_excerpt": f"SELECT doc_id, {sql_excerpt('text')} AS shown FROM documents",
    "text_content_tokens": f"SELECT doc_id, array_to_string({sql_tokens('text')}, ' ') AS tokens FROM documents",
    "text_strip_markers": f"WITH {SUMMARIES_SQL} SELECT project_id, {sql_strip_markers('purpose_summary')} AS bare FROM summaries",
    "text_responsibility_key": f"""
WITH {SUMMARIES_SQL}, k AS (SELECT project_id, {sql_key_tokens('purpose_summary')} AS tk FROM summaries)
SELECT project_id, array_to_string(tk, ' ') AS tokens,
       CASE WHEN len(tk) > 0 THEN array_to_string(tk[1:2], ' ') END AS resp_key FROM k
""",
    "text_ownership_stance": f"WITH {SUMMARIES_SQL} SELECT project_id, {sql_stance('purpose_summary')} AS stance FROM summaries",
    "text_jaccard_neighbours": f"""
WITH {SUMMARIES_SQL}, k AS (SELECT project_id, list_distinct({sql_key_tokens('purpose_summary')}) AS t FROM summaries),
j AS (SELECT a.project_id, len(list_filter(a.t, lambda x: list_contains(b.t, x))) AS n_both, len(a.t) AS na, len(b.t) AS nb
      FROM k a JOIN k b ON b.project_id = a.project_id + 1)
SELECT project_id, round(CASE WHEN na + nb = 0 THEN 0.0 ELSE CAST(n_both AS DOUBLE) / (na + nb - n_both) END, 6) AS similarity FROM j
""",
    "url_scheme_host_kinds": URL_FACTS_SQL,
    "identifier_cleaning_and_acceptance": IDENTIFIERS_SQL,
    "open_modes_and_durations": MODES_SQL,
    "route_patterns_and_module_paths": ROUTES_SQL,
    "path_admission_rules": PATHS_SQL,
    "readme_prose": README_SQL,
}
