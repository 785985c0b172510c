"""Extraction operators on the corpus derived from order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindings.sql_hits import hits, lit, with_corpus
from bindings.text import URL_RE2, _HOST_KIND_SQL, _LOCAL_SQL, sql_list, sql_scheme_kind
from estatelens import rules
from estatelens.operators import coalesce as co
from estatelens.operators import go_services as gs
from estatelens.operators import go_sites as go
from estatelens.operators import go_tables as gt
from estatelens.operators import services as sv
from estatelens.operators import tables as tb
from estatelens.operators.graph import shared_table_edges
from estatelens.operators.io_regex import java_io, js_io, yaml_cron
from estatelens.operators.manifests import manifest_candidate, manifest_cli, manifest_facts
from estatelens.operators.profiles import check_profiles, degraded_sections
from estatelens.operators.purpose import docstring_candidate, pick_purpose, readme_candidate
from estatelens.operators.python_sites import (
    python_call_io,
    python_call_sites,
    python_decorator_io,
    python_main_io,
    python_sql_write,
)
from estatelens.plans import refresh as rf
from estatelens.plans.corpus import corpus_files, corpus_projects
from estatelens.session import compile_methods, stored
from estatelens.sources.admission import drop_vendored_go, project_shape, service_scannable
from estatelens.sources.landing import pin_files, with_branch

_SPLITS: dict[tuple[str, str], rf.Split] = {}


_LANDED: dict[tuple[str, str], DataFrame] = {}


def landed(spark, sf) -> DataFrame:
    """The whole corpus as a landed table, written once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LANDED:
        _LANDED[key] = stored(corpus_files(spark, sf))
    return _LANDED[key]


def split(spark, sf) -> rf.Split:
    """The whole admitted corpus, laid out by shape and family once per session."""
    compile_methods(spark)
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SPLITS:
        _SPLITS[key] = rf.lay_out(rf.admitted_files(landed(spark, sf), corpus_projects(spark, sf)))
    return _SPLITS[key]


SERVICE_COLS = ["project_id", "name", "kind", "path", "line"]
TABLE_COLS = ["project_id", "table_name", "access_mode", "path", "line"]
IO_COLS = ["project_id", "direction", "category", "description"]


def _files(op, cols, side="other", *families):
    def run(spark, sf):
        s = split(spark, sf)
        files = getattr(s, side)
        return op(s.of(files, *families) if families else files).select(*cols)

    return run


# --- services ----------------------------------------------------------------

URL_SQL = f"""
lines AS (SELECT project_id, path, unnest(string_split(content, chr(10))) AS s,
  unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM scannable WHERE contains(content, '://')),
urls AS (SELECT project_id, path, line, lower(unnest(regexp_extract_all(s, '{URL_RE2}', 1))) AS s,
  lower(unnest(regexp_extract_all(s, '{URL_RE2}', 2))) AS h FROM lines),
url_rows AS (SELECT project_id, trim(h, '[]') AS name, {sql_scheme_kind(_HOST_KIND_SQL)} AS kind, path, line
  FROM urls WHERE NOT {_LOCAL_SQL} AND s NOT IN ({sql_list(rules.DENIED_SCHEMES)}))"""
_CLOUD_KIND = "CASE g1 " + " ".join(f"WHEN '{s}' THEN '{k}'" for s, (k, _) in rules.CLOUD_SERVICES.items()) + " ELSE 'other' END"
_CLOUD_NAME = "CASE g1 " + " ".join(f"WHEN '{s}' THEN '{n}'" for s, (_, n) in rules.CLOUD_SERVICES.items()) + " ELSE concat('aws-', g1) END"
_SDK_KIND = "CASE rule " + " ".join(f"WHEN {n} THEN '{k}'" for n, (_, k, _) in enumerate(rules.CLIENT_PATTERNS)) + " END"
_SDK_NAME = "CASE rule " + " ".join(f"WHEN {n} THEN '{c}'" for n, (_, _, c) in enumerate(rules.CLIENT_PATTERNS)) + " END"
CLOUD_SQL = f"""cloud AS ({hits('scannable', [(0, rules.CLOUD_PATTERN, (1,))])}),
cloud_rows AS (SELECT project_id, {_CLOUD_NAME} AS name, {_CLOUD_KIND} AS kind, path, line FROM cloud)"""
SDK_SQL = f"""sdk AS ({hits('scannable', [(n, p, ()) for n, (p, _, _) in enumerate(rules.CLIENT_PATTERNS)])}),
sdk_rows AS (SELECT project_id, {_SDK_NAME} AS name, {_SDK_KIND} AS kind, path, line FROM sdk)"""
_RANKED = "CASE kind WHEN 'http_api' THEN 1 WHEN 'other' THEN 2 ELSE 0 END"


def scannable(op, cols):
    def run(spark, sf):
        return op(split(spark, sf).other.filter(service_scannable(F.col("path")))).select(*cols)

    return run


def project_services(spark, sf):
    return co.services_with_locations(sv.service_hits(split(spark, sf).other)).select(
        "project_id", "name", "kind", F.size("source_locations").cast("long").alias("n_places")
    )


# --- tables ------------------------------------------------------------------

_CLEAN = "trim(split_part(translate(g1, '\"`[]''', ''), '.', -1))"
SQL_HITS = f"""found AS ({hits('code', [(n, '(?i)' + p, (1,)) for n, p in enumerate(rules.SQL_WRITES + rules.SQL_READS)])}),
lined AS (SELECT found.*, string_split(content, chr(10))[line] AS text FROM found JOIN code USING (project_id, path)),
kept AS (SELECT * FROM lined WHERE NOT regexp_matches(text, '^\\s*from\\s+[\\w.]+\\s+import\\b')),
sql_rows AS (SELECT project_id, {_CLEAN} AS table_name, CASE WHEN rule < 5 THEN 'write' ELSE 'read' END AS access_mode, path, line, rule
  FROM kept r WHERE rule < 5 OR NOT EXISTS (SELECT 1 FROM kept w WHERE w.project_id = r.project_id AND w.path = r.path
    AND w.rule < 5 AND w.b <= r.b AND r.b < w.e))"""
MIGRATION_SQL = f"""moved AS ({hits('code', [(n, p, (1, 2) if n == 3 else (1,)) for n, p in enumerate(rules.MIGRATIONS)])}),
migration_rows AS (SELECT project_id, translate(unnest(CASE WHEN rule = 3 THEN [g1, g2] ELSE [g1] END), '\"''', '') AS table_name,
  'write' AS access_mode, path, line FROM moved)"""
_MODEL = [
    (1, r"\b__tablename__\s*=\s*(?:\"([^\"']+)\"|'[^\"']+')", (1,)),
    (2, r"\bdb_table\s*=\s*(?:'([^\"']+)'|\"[^\"']+\")", (1,)),
    (3, r"\bself\.table_name\s*=\s*(?:'([^\"']+)'|\"[^\"']+\")", (1,)),
]
MODEL_SQL = f"""named AS ({hits('code', _MODEL)}),
classes AS ({hits('code', [(0, '(?m)' + rules.CLASS_PATTERN, (1, 2))])}),
model_rows AS (SELECT n.project_id, n.path, n.g1 AS table_name, n.rule, n.b, n.line,
  CASE n.rule WHEN 1 THEN (SELECT arg_max(c.g2, c.b) FROM classes c WHERE c.project_id = n.project_id AND c.path = n.path AND c.b < n.b)
  WHEN 2 THEN (SELECT arg_min(c.g2, length(c.g1) * 10000000 - c.b) FROM classes c WHERE c.project_id = n.project_id AND c.path = n.path AND c.b < n.b) END AS owner
  FROM named n)"""
CLASS_SQL = """class_map AS (SELECT project_id, owner AS class_name, table_name FROM
  (SELECT *, row_number() OVER (PARTITION BY project_id, owner ORDER BY path DESC, rule DESC, b DESC) AS n
   FROM model_rows WHERE owner IS NOT NULL) WHERE n = 1)"""
_SHAPES = [(n, p, (1,)) for n, (p, _) in enumerate(rules.MODEL_QUERIES)] + [(4, rules.MODEL_OBJECTS, (1, 2))]
CALLS_SQL = f"""shapes AS ({hits('code', _SHAPES)}),
call_rows AS (SELECT project_id, table_name, CASE WHEN rule = 3 THEN 'write' WHEN rule < 3 THEN 'read'
  WHEN g2 IN ({sql_list(rules.OBJECT_WRITES)}) THEN 'write' WHEN g2 IN ({sql_list(rules.OBJECT_READS)}) THEN 'read' END AS access_mode,
  path, line FROM shapes JOIN class_map ON shapes.project_id = class_map.project_id AND shapes.g1 = class_map.class_name)"""
CALLS_SQL = CALLS_SQL.replace("SELECT project_id, table_name, CASE", "SELECT shapes.project_id, table_name, CASE")
GENERAL_TABLES_SQL = [
    SQL_HITS, MIGRATION_SQL, MODEL_SQL, CLASS_SQL, CALLS_SQL,
    """general AS (SELECT project_id, table_name, access_mode, path, line FROM sql_rows
UNION ALL SELECT project_id, table_name, access_mode, path, line FROM migration_rows
UNION ALL SELECT project_id, table_name, 'write', path, line FROM model_rows
UNION ALL SELECT project_id, table_name, access_mode, path, line FROM call_rows WHERE access_mode IS NOT NULL)""",
]
_LATTICE = (
    "CASE WHEN bool_or(access_mode = 'read') AND bool_or(access_mode = 'write') THEN 'read_write'"
    " WHEN bool_or(access_mode = 'write') THEN 'write' WHEN bool_or(access_mode = 'read') THEN 'read' ELSE 'unknown' END"
)


def class_map(spark, sf):
    return tb.orm_class_map(tb.model_rows(split(spark, sf).other)).select("project_id", "class_name", "table_name")


def query_hits(spark, sf):
    files = split(spark, sf).other
    return tb.orm_query_hits(files, tb.orm_class_map(tb.model_rows(files))).select(*TABLE_COLS)


def reads_or_writes(mode):
    def run(spark, sf):
        code = split(spark, sf).other.filter(~tb.is_doc(F.col("path")))
        return tb.sql_hits(code).filter(F.col("access_mode") == mode).select(*TABLE_COLS)

    return run


def project_tables(spark, sf):
    """One row per project and table of both branches."""
    s = split(spark, sf)
    both = co.tables_with_locations(tb.table_hits(s.other)).unionByName(co.tables_with_locations(gt.go_table_hits(s.go)))
    return both.select("project_id", "table_name", "access_mode", F.size("source_locations").cast("long").alias("n_places"))


def estate_edges(spark, sf):
    """Files to graph: which projects share a table of their sources."""
    s = split(spark, sf)
    cols = ["project_id", "table_name", "access_mode"]
    merged = tb.table_hits(s.other).select(*cols).unionByName(gt.go_table_hits(s.go).select(*cols))
    return shared_table_edges(co.coalesce_tables(merged), with_branch(corpus_projects(spark, sf)))


# --- Go ----------------------------------------------------------------------

GO_LITERALS_SQL = f"""repo_files AS (SELECT * FROM go_files WHERE regexp_matches(path, '^internal/repository/[^/]*_repos?\\.go$')),
literals AS (SELECT project_id, path, lit_no, regexp_replace(literal, '%[-+#0 ]?\\[?\\d*\\]?[a-zA-Z]+\\.([A-Za-z_])', '\\1', 'g') AS literal FROM
  (SELECT project_id, path, unnest(range(0, len(ms))) AS lit_no, substr(unnest(ms), 2, length(unnest(ms)) - 2) AS literal FROM
    (SELECT project_id, path, regexp_extract_all(content, '"(?:[^"\\\\\\n]|\\\\[\\s\\S])*"|`[^`]*`') AS ms FROM repo_files))
  WHERE NOT contains(literal, 'Automatically close issues from merge requests'))"""
_STOP = sql_list(rules.TABLE_STOP_WORDS)


def _accepted(name: str, shape: str) -> str:
    parts = f"string_split({name}, '.')"
    return (
        f"len(list_filter({parts}, lambda p: regexp_full_match(p, '{shape}') AND lower(p) NOT IN ({_STOP}))) = len({parts})"
        f" AND (len({parts}) > 1 OR length({name}) >= 3)"
    )


PROCS_SQL = f"""procs AS (SELECT project_id, path, unnest(list_concat(regexp_extract_all(literal, '(?i)\\bBEGIN{rules.GO_PROCEDURE}', 1),
  regexp_extract_all(literal, '(?i)\\bCALL{rules.GO_PROCEDURE}', 1))) AS name FROM literals),
proc_rows AS (SELECT project_id, name AS table_name, 'unknown' AS access_mode, path FROM procs WHERE {_accepted('name', '[A-Za-z_][A-Za-z0-9_]*')})"""
GO_REFS_SQL = f"""lit_found AS ({hits('literals', [(n, '(?i)' + p, (1,)) for n, p in enumerate(rules.SQL_WRITES + rules.SQL_READS)], 'literal', 'project_id, path, lit_no')}),
lit_rows AS (SELECT project_id, path, lit_no, trim(translate(g1, '"`[]''', '')) AS table_name, CASE WHEN rule < 5 THEN 'write' ELSE 'read' END AS access_mode
  FROM lit_found r WHERE rule < 5 OR NOT EXISTS (SELECT 1 FROM lit_found w WHERE w.project_id = r.project_id AND w.path = r.path AND w.lit_no = r.lit_no
    AND w.rule < 5 AND w.b <= r.b AND r.b < w.e)),
go_table_rows AS (SELECT project_id, table_name, access_mode, path FROM proc_rows UNION ALL
  SELECT project_id, table_name, access_mode, path FROM lit_rows WHERE {_accepted('table_name', '[A-Z_][A-Z0-9_]*')})"""

_GO_KIND = "CASE lower({s}) " + " ".join(f"WHEN '{s}' THEN '{k}'" for s, k in rules.GO_SCHEME_KINDS.items()) + " ELSE 'other' END"
_GO_HOST = "split_part(regexp_extract({r}, '^[^/?#]*'), '@', -1)"
_APM = """NOT (contains(content, '"go.elastic.co/apm/') AND NOT regexp_matches(content, '(?m)^\\s*"[^g][^"]*"\\s*$'))"""
GO_CONFIG_SQL = f"""config AS (SELECT * FROM go_files WHERE path = 'config/config.go'),
cfg AS ({hits('config', [(0, '(?i)' + rules.GO_URL, (1, 2)), (1, '(?i)' + rules.GO_NAMED_URL, (1, 2))])}),
config_rows AS (SELECT project_id, CASE WHEN rule = 0 THEN {_GO_HOST.format(r='g2')} ELSE lower(regexp_replace(g1, '(?i)(_URL|_ENDPOINT|_BROKER|_HOST|_URI)$', '')) END AS name,
  CASE WHEN rule = 0 THEN {_GO_KIND.format(s='g1')} WHEN contains(upper(g1), 'BROKER') THEN 'message_broker'
    WHEN regexp_matches(upper(g1), 'URL|ENDPOINT|URI') THEN 'http_api' ELSE 'other' END AS kind, path, line
  FROM cfg WHERE rule = 0 OR NOT regexp_matches(g2, {lit('(?i)' + rules.GO_URL)}))"""
GO_ADAPTER_SQL = f"""adapters AS (SELECT project_id, path, content, regexp_extract(path, '^internal/adapter/([^/]*)_adapter\\.go$', 1) AS name0 FROM go_files
  WHERE regexp_matches(path, '^internal/adapter/[^/]+_adapter\\.go$') AND {_APM}),
au AS ({hits('adapters', [(0, '(?i)' + rules.GO_URL, (1, 2))])}),
hosts AS (SELECT project_id, path, {_GO_HOST.format(r='g2')} AS host, arg_min({_GO_KIND.format(s='g1')}, b) AS kind, min(b) AS b, arg_min(line, b) AS line FROM au GROUP BY ALL),
joined AS (SELECT project_id, path, string_agg(host, ', ' ORDER BY b) AS hosts, arg_min(kind, b) AS kind, arg_min(line, b) AS line FROM hosts GROUP BY ALL),
adapter_rows AS (SELECT a.project_id, CASE WHEN hosts IS NULL THEN name0 ELSE concat(name0, ' (', hosts, ')') END AS name,
  coalesce(kind, 'other') AS kind, path, line FROM adapters a LEFT JOIN joined USING (project_id, path))"""
GO_ADAPTER_SQL = GO_ADAPTER_SQL.replace("SELECT a.project_id, CASE", "SELECT project_id, CASE")
GO_BROKER_SQL = f"""helper AS (SELECT * FROM go_files WHERE path IN ('internal/helper.go', 'internal/helper/helper.go')
  AND regexp_matches(content, 'NewSubscriber|NewSender|NewClient') AND regexp_matches(content, 'activemq|stomp')),
dest AS ({hits("(SELECT * FROM go_files WHERE path = 'config/config.go')", [(0, '(?i)' + rules.GO_DESTINATION, (1, 2))])}),
broker_rows AS (SELECT project_id, 'activemq' AS name, 'message_broker' AS kind, path, CAST(NULL AS BIGINT) AS line FROM helper
  UNION ALL SELECT DISTINCT dest.project_id, 'activemq', 'message_broker', dest.path, dest.line FROM dest JOIN helper USING (project_id))"""


def _go_sites(s):
    return go.go_call_sites(s.of(s.go, "go"))


def _go_io(op, keep=False):
    """An operator on call sites; kept where it reads them more than once."""

    def run(spark, sf):
        sites = _go_sites(split(spark, sf))
        return op(stored(sites) if keep else sites).select(*IO_COLS)

    return run


def go_cli(spark, sf):
    s = split(spark, sf)
    return go.go_cli_io(_go_sites(s), s.of(s.go, "manifest")).select(*IO_COLS)


def go_pruned(spark, sf):
    s = split(spark, sf)
    return go.go_io(s.of(s.go, "go", "manifest"), stored(_go_sites(s))).select(*IO_COLS)


def call_sites(spark, sf):
    sites = _go_sites(split(spark, sf))
    return sites.select(
        "project_id", "path", "line", "kind", "receiver", "method", F.size("args").cast("long").alias("n_args")
    )


_PART = "regexp_extract(path, '_(\\d+)(?:_|\\.|/)', 1)"
_NUM = "CAST(regexp_extract(path, '_([0-9]+)(_repos?|_adapter)?(\\.[a-z]+|/main\\.go)$', 1) AS BIGINT)"
# What each template of the corpus says, by the name of its file: an account of
# the facts that owes nothing to the lexer under test.
GO_FACTS_SQL = f"""gp AS (SELECT project_id, path, {_NUM} AS k FROM go_files WHERE regexp_matches(path, '^(internal/(web|jobs|mq|io|deep)|cmd)/')),
gq AS (SELECT *, k % 24 AS m, concat(' at ', path, ':') AS w FROM gp),
go_http AS (SELECT project_id, unnest(['in', 'out', 'in', 'out', 'in', 'out']) AS direction,
  unnest(['http_request', 'http_response', 'http_request', 'http_response', 'http_request', 'http_response']) AS category,
  unnest([concat('HTTP GET /p', k, ' via http.HandleFunc()', w, 8), concat('HTTP GET response for /p', k, ' via http.HandleFunc()', w, 8),
   concat('HTTP ANY /h', m, ' via mux.Handle()', w, 9), concat('HTTP ANY response for /h', m, ' via mux.Handle()', w, 9),
   concat('HTTP request <dynamic', w, '10 on mux>'), concat('HTTP response <dynamic', w, '10 on mux>')]) AS description
  FROM gq WHERE regexp_matches(path, '^internal/web/')
  UNION ALL SELECT project_id, unnest(['in', 'out', 'in', 'out']), unnest(['http_request', 'http_response', 'http_request', 'http_response']),
  unnest([concat('HTTP ANY /deep/p', k, ' via http.HandleFunc()', w, 8), concat('HTTP ANY response for /deep/p', k, ' via http.HandleFunc()', w, 8),
   concat('HTTP request <dynamic', w, '9 on mux>'), concat('HTTP response <dynamic', w, '9 on mux>')])
  FROM gq WHERE regexp_matches(path, '^internal/deep/')),
go_sched AS (SELECT project_id, 'in' AS direction, 'scheduled_event' AS category, unnest(
  CASE WHEN regexp_matches(path, '^internal/jobs/j') THEN
   [concat('scheduled (cron, seconds-precision) 0 ', m, ' * * * * via c.AddFunc()', w, 5), concat('scheduled (cron, seconds-precision) <dynamic> via c.AddJob()', w, 6),
    concat('scheduled (time, NewTicker) 5 via time.NewTicker()', w, 7)]
  ELSE [concat('scheduled <dynamic> (malformed or unsupported scheduler shape: AddFunc(s)', w, '4)'), concat('scheduled (time, AfterFunc) <dynamic> via time.AfterFunc()', w, 5)] END) AS description
  FROM gq WHERE regexp_matches(path, '^internal/jobs/')),
go_mq AS (SELECT project_id, unnest(['in', 'out']) AS direction, unnest(['message_consumed', 'message_published']) AS category,
  unnest([concat('activemq message consumed from Q', m, '.IN via sub.Subscribe()', w, 4), concat('activemq message published to <dynamic> via q.SendMessage()', w, 5)]) AS description
  FROM gq WHERE regexp_matches(path, '^internal/mq/')
  UNION ALL SELECT project_id, 'in', 'message_consumed', concat('activemq message consumed from D', m, '.IN via sub.Subscribe()', w, 10) FROM gq WHERE regexp_matches(path, '^internal/deep/')),
go_fio AS (SELECT project_id, unnest(['in', 'out', 'in', 'in', 'out']) AS direction, unnest(['file_read', 'file_written', 'file_read', 'file_read', 'file_written']) AS category,
  unnest([concat('file read in', m, '.csv via os.Open()', w, 4), concat('file written <dynamic> via ioutil.WriteFile()', w, 5), concat('file read a', m, '.log via os.OpenFile()', w, 6),
   concat('file read b', m, '.log via os.OpenFile()', w, 7), concat('file written b', m, '.log via os.OpenFile()', w, 7)]) AS description
  FROM gq WHERE regexp_matches(path, '^internal/io/')
  UNION ALL SELECT project_id, 'in', 'file_read', unnest([concat('file read <dynamic> via os.Open()', w, 11), concat('file read d', m, '.csv via os.Open()', w, 12)])
  FROM gq WHERE regexp_matches(path, '^internal/deep/')),
go_cli AS (SELECT project_id, 'in' AS direction, 'cli_argument' AS category, unnest([concat('binary ', split_part(path, '/', 2), ' via func main()', w, 4),
   concat('flag f', m, ' via flag.String()', w, 5), concat('flag parsing invoked via flag.Parse()', w, 6)]) AS description
  FROM gq WHERE regexp_matches(path, '^cmd/'))"""
CALL_SITES_SQL = f"""gs AS (SELECT project_id, path FROM go_files WHERE regexp_matches(path, '^(internal/(web|jobs|mq|io|deep|repository)/|cmd/|internal/helper)')),
facts AS (SELECT project_id, path, unnest(CASE
  WHEN regexp_matches(path, '^internal/web/') THEN ['7|func||Routes|-1', '8|call|http|HandleFunc|2', '9|call|mux|Handle|2', '10|call|mux|Handle|2']
  WHEN regexp_matches(path, '^internal/deep/') THEN ['7|func||Run|-1', '8|call|http|HandleFunc|2', '9|call|mux|Handle|2', '10|call|sub|Subscribe|4', '11|call|os|Open|1', '12|call|os|Open|1']
  WHEN regexp_matches(path, '^internal/jobs/j') THEN ['3|func||Run|-1', '4|call|cron|New|1', '5|call|c|AddFunc|2', '6|call|c|AddJob|2', '7|call|time|NewTicker|2']
  WHEN regexp_matches(path, '^internal/jobs/k') THEN ['3|func||Run|-1', '4|call|s|AddFunc|2', '5|call|time|AfterFunc|2']
  WHEN regexp_matches(path, '^internal/mq/') THEN ['3|func||Run|-1', '4|call|sub|Subscribe|4', '5|call|q|SendMessage|4']
  WHEN regexp_matches(path, '^internal/io/') THEN ['3|func||Run|-1', '4|call|os|Open|1', '5|call|ioutil|WriteFile|3', '6|call|os|OpenFile|3', '7|call|os|OpenFile|4']
  WHEN regexp_matches(path, '_repos\\.go$') THEN ['3|call|fmt|Sprintf|2', '6|call|fmt|Sprintf|2']
  WHEN regexp_matches(path, '^cmd/') THEN ['4|func||main|-1', '5|call|flag|String|3', '6|call|flag|Parse|0']
  WHEN regexp_matches(path, '^internal/helper') THEN ['3|func||New|-1', '3|call|activemq|NewSubscriber|0'] ELSE [] END) AS f FROM gs)"""

# --- inputs and outputs --------------------------------------------------------

JS_SQL = f"""js AS (SELECT * FROM adm WHERE regexp_matches(path, '\\.(js|ts|jsx|tsx|mjs|cjs)$')),
js_route AS (SELECT project_id, path, upper(unnest(regexp_extract_all(content, {lit('(?i)' + rules.JS_ROUTE)}, 1))) AS v, unnest(regexp_extract_all(content, {lit('(?i)' + rules.JS_ROUTE)}, 2)) AS r FROM js),
js_rows AS (SELECT project_id, 'in' AS direction, 'http_request' AS category, concat('HTTP ', v, ' ', r, ' handler in ', path) AS description FROM js_route
UNION ALL SELECT project_id, 'out', 'http_response', concat('HTTP ', v, ' response for ', r, ' in ', path) FROM js_route
UNION ALL SELECT project_id, 'out', 'external_call', concat('External HTTP call via fetch(''', unnest(regexp_extract_all(content, {lit(rules.JS_FETCH)}, 1)), ''') in ', path) FROM js
UNION ALL SELECT project_id, 'out', 'external_call', concat('External HTTP ', upper(unnest(regexp_extract_all(content, {lit('(?i)' + rules.JS_AXIOS)}, 1))), ' via axios(''', unnest(regexp_extract_all(content, {lit('(?i)' + rules.JS_AXIOS)}, 2)), ''') in ', path) FROM js
UNION ALL SELECT project_id, 'in', 'file_read', concat('File read via fs.* (''', unnest(regexp_extract_all(content, {lit(rules.JS_READ)}, 1)), ''') in ', path) FROM js
UNION ALL SELECT project_id, 'out', 'file_written', concat('File write via fs.* (''', unnest(regexp_extract_all(content, {lit(rules.JS_WRITE)}, 1)), ''') in ', path) FROM js
UNION ALL SELECT project_id, 'out', 'message_published', concat('Message publisher detected in ', path) FROM js WHERE regexp_matches(content, {lit(rules.JS_PUBLISH)})
UNION ALL SELECT project_id, 'in', 'message_consumed', concat('Message consumer detected in ', path) FROM js WHERE regexp_matches(content, {lit(rules.JS_CONSUME)})
UNION ALL SELECT project_id, 'in', 'cli_argument', concat('CLI command registered via commander in ', path) FROM js WHERE regexp_matches(content, {lit(rules.JS_COMMAND)}))"""
JAVA_SQL = f"""java AS (SELECT * FROM adm WHERE regexp_matches(path, '\\.java$')),
mapping AS (SELECT project_id, path, unnest(regexp_extract_all(content, {lit(rules.JAVA_MAPPING)}, 1)) AS ann, trim(unnest(regexp_extract_all(content, {lit(rules.JAVA_MAPPING)}, 2))) AS r FROM java),
verbs AS (SELECT *, CASE ann {' '.join(f"WHEN '{a}' THEN '{v}'" for a, v in rules.JAVA_VERBS.items())} END AS v, coalesce(nullif(r, ''), '<class-or-method-mapping>') AS l FROM mapping),
java_rows AS (SELECT project_id, 'in' AS direction, 'http_request' AS category, concat('HTTP ', v, ' ', l, ' via @', ann, ' in ', path) AS description FROM verbs
UNION ALL SELECT project_id, 'out', 'http_response', concat('HTTP ', v, ' response from @', ann, ' ', l, ' in ', path) FROM verbs
UNION ALL SELECT project_id, 'in', 'scheduled_event', concat('Scheduled task via @Scheduled in ', path) FROM java WHERE regexp_matches(content, '@Scheduled\\b')
UNION ALL SELECT project_id, 'in', 'message_consumed', concat('Message consumer via @', unnest(regexp_extract_all(content, {lit(rules.JAVA_LISTENER)}, 1)), ' in ', path) FROM java)"""
YAML_SQL = f"""yaml AS (SELECT * FROM adm WHERE regexp_matches(path, '\\.ya?ml$')),
yaml_rows AS (SELECT project_id, 'in' AS direction, 'scheduled_event' AS category,
  concat('Scheduled event (', trim(unnest(regexp_extract_all(content, {lit('(?m)' + rules.YAML_CRON)}, 3))), ') declared in ', path) AS description FROM yaml)"""
# Facts of the Python templates by file name; the tree parser has no SQL form.
PY_SQL = """py AS (SELECT project_id, path, CAST(regexp_extract(path, '_([0-9]+)\\.py$', 1) AS BIGINT) AS k FROM adm WHERE regexp_matches(path, '^app/[wk].*\\.py$')),
pq AS (SELECT *, k % 24 AS m, k % 50 AS h, concat(' in ', path) AS w FROM py),
py_deco AS (SELECT project_id, unnest(['in', 'out', 'in', 'out', 'in', 'in', 'in']) AS direction,
  unnest(['http_request', 'http_response', 'http_request', 'http_response', 'message_consumed', 'scheduled_event', 'cli_argument']) AS category,
  unnest([concat('HTTP GET /p', k, ' handled by view', w), concat('HTTP GET response from view (/p', k, ')', w), concat('HTTP ANY /r handled by r', w), concat('HTTP ANY response from r (/r)', w),
   concat('Async task job consumed from broker', w), concat('Scheduled task tick (cron', m, ')', w), concat('CLI command main defined', w)]) AS description
  FROM pq WHERE regexp_matches(path, '^app/w')),
py_call AS (SELECT project_id, unnest(['out', 'out', 'in', 'in', 'out', 'out']) AS direction,
  unnest(['external_call', 'file_written', 'cli_argument', 'message_consumed', 'message_published', 'database_write']) AS category,
  unnest([concat('External HTTP GET via requests.get(''https://h', h, '.example.com'')', w), concat('File write via open(''d', m, '.csv'', mode=''w'')', w), concat('CLI parser via argparse.ArgumentParser', w),
   concat('Message consumer subscribe(''t', m, ''')', w), concat('Kafka producer.send(''t', m, ''')', w), concat('Database write via .save()', w)]) AS description
  FROM pq WHERE regexp_matches(path, '^app/k')),
py_sql AS (SELECT project_id, 'out' AS direction, 'database_write' AS category, concat('SQL INSERT statement detected', w) AS description FROM pq WHERE regexp_matches(path, '^app/k')),
py_main AS (SELECT project_id, 'in' AS direction, 'cli_argument' AS category, concat('CLI entrypoint via `if __name__ == "__main__":`', w) AS description FROM pq WHERE regexp_matches(path, '^app/k'))"""
CLI_SQL = """cli_rows AS (SELECT project_id, 'in' AS direction, 'cli_argument' AS category,
  concat('CLI entrypoint ''', CASE path WHEN 'package.json' THEN 'run-' ELSE 'cli-' END, project_id, ''' declared in ', path) AS description
  FROM adm WHERE path IN ('package.json', 'pyproject.toml'))"""
_IO_TABLES = [
    "js_rows", "java_rows", "yaml_rows", "py_deco", "py_call", "py_sql", "py_main", "cli_rows", "go_http", "go_sched",
    "go_mq", "go_fio", "go_cli",
]
IO_SQL = [JS_SQL, JAVA_SQL, YAML_SQL, PY_SQL, CLI_SQL, GO_FACTS_SQL]
ALL_IO_SQL = "all_io AS (" + " UNION ".join(f"SELECT project_id, direction, category, description FROM {t}" for t in _IO_TABLES) + ")"


def _py(op):
    def run(spark, sf):
        s = split(spark, sf)
        return op(python_call_sites(s.of(s.everything, "python"))).select(*IO_COLS)

    return run


def sites_by_kind(spark, sf):
    s = split(spark, sf)
    sites = python_call_sites(s.of(s.everything, "python"))
    return sites.groupBy("project_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def all_io(spark, sf):
    return co.dedup_io(rf.io_hits(split(spark, sf))).select(*IO_COLS)


# --- purpose -----------------------------------------------------------------

_TAIL = "concat('svc', project_id)"
PURPOSE_SQL = """prose AS (SELECT project_id, array_to_string(list_filter(list_transform(string_split(list_filter(
   regexp_split_to_array(content, '\\n\\s*\\n'), lambda p: NOT regexp_matches(p, '^# '))[1], chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> ''), ' ') AS text
  FROM adm WHERE path = 'README.md'),
cands AS (SELECT project_id, 1 AS priority, 'readme' AS source, 'README.md' AS path, text FROM prose WHERE text <> ''
 UNION ALL SELECT project_id, 2, 'description', '', trim(regexp_replace(description, '\\s+', ' ', 'g')) FROM projects WHERE commit_sha IS NOT NULL AND description <> ''
 UNION ALL SELECT project_id, 3, 'gomod_comment', path, concat('ledger ', project_id) FROM adm WHERE path = 'go.mod' AND project_id % 8 = 0
 UNION ALL SELECT project_id, 4, 'gomod_module_path', path, concat('svc', project_id) FROM adm WHERE path = 'go.mod'
 UNION ALL SELECT project_id, 5, 'manifest', path, CASE path WHEN 'package.json' THEN concat('Service ', project_id, ' of the estate') WHEN 'pom.xml' THEN concat('Java ', project_id) ELSE concat('Project ', project_id) END
   FROM adm WHERE path IN ('package.json', 'pyproject.toml', 'pom.xml')
 UNION ALL SELECT project_id, 6, 'module_docstring', path, CASE path WHEN 'app.py' THEN concat('Doc of ', project_id, '. More.') ELSE concat('Script of ', project_id, '.') END FROM adm WHERE path IN ('app.py', 'index.js')
 UNION ALL SELECT project_id, 7, 'package_doc_comment', min(path), concat('Package main is tool p', arg_min(regexp_extract(path, '_([0-9]+)/main\\.go$', 1), path), '.') FROM adm WHERE regexp_matches(path, '^cmd/[^/]+/main\\.go$') GROUP BY project_id)"""
_CAND = ["project_id", "source", "priority", "path", "text"]


def candidates(spark, sf):
    ready = with_branch(corpus_projects(spark, sf))
    return rf.purpose_candidates(ready, split(spark, sf)).select(*_CAND)


def _one_candidate(op):
    def run(spark, sf):
        return op(split(spark, sf)).select(*_CAND)

    return run


def purposes(spark, sf):
    ready = with_branch(corpus_projects(spark, sf))
    return pick_purpose(ready, rf.purpose_candidates(ready, split(spark, sf)))


# --- profiles ----------------------------------------------------------------

_PROFILES: dict[tuple[str, str], object] = {}


def profiles(spark, sf):
    """A5 over the whole corpus."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PROFILES:
        _PROFILES[key] = stored(rf.analyze(corpus_projects(spark, sf), landed(spark, sf)))
    return _PROFILES[key]


def profile_summary(spark, sf):
    p = profiles(spark, sf)
    size = lambda c: F.size(c).cast("long")
    return p.select(
        "project_id", "full_path", "branch", "commit_sha", "purpose_summary", "purpose_summary_reason",
        size("abstract_inputs").alias("n_inputs"), size("abstract_outputs").alias("n_outputs"),
        size("services").alias("n_services"), size("tables").alias("n_tables"),
        size("degraded_sections").alias("n_degraded"),
        F.sha2(F.array_join(F.array_sort(F.transform("abstract_inputs", lambda x: F.concat_ws("|", x["category"], x["description"]))), chr(10)), 256).alias("inputs_hash"),
        F.sha2(F.array_join(F.transform("tables", lambda x: F.concat_ws("|", x["table_name"], x["access_mode"])), chr(10)), 256).alias("tables_hash"),
    )


def degraded(spark, sf):
    return degraded_sections(go.go_skips(split(spark, sf).go)).select(
        "project_id", F.array_join("degraded_sections", chr(10)).alias("lines")
    )


def profile_violations(spark, sf):
    """Q8 on profiles made faulty: services doubled, summaries unexplained, locations lost."""
    broken = (
        profiles(spark, sf)
        .withColumn("purpose_summary", F.when(F.col("project_id") % 2 == 0, "unknown").otherwise(F.col("purpose_summary")))
        .withColumn("services", F.when(F.col("project_id") % 4 == 0, F.concat("services", "services")).otherwise(F.col("services")))
        .withColumn(
            "tables",
            F.when(
                F.col("project_id") % 4 == 1,
                F.transform("tables", lambda t: t.withField("source_locations", F.slice(t["source_locations"], 1, 0))),
            ).otherwise(F.col("tables")),
        )
    )
    return check_profiles(broken)


_SKIPPED = """skipped AS (SELECT project_id, path, CASE WHEN regexp_matches(path, '^internal/tag/') THEN 'build constraint requires toolchain'
  ELSE 'cgo directive requires toolchain' END AS reason FROM go_files WHERE regexp_matches(path, '^internal/(tag|c)/'))"""
_GO_SERVICE = [
    GO_CONFIG_SQL, GO_ADAPTER_SQL, GO_BROKER_SQL,
    "go_service_rows AS (SELECT * FROM config_rows UNION ALL SELECT * FROM adapter_rows UNION ALL SELECT * FROM broker_rows)",
]
_ALL_TABLES = [
    *GENERAL_TABLES_SQL, GO_LITERALS_SQL, PROCS_SQL, GO_REFS_SQL,
    """every_table AS (SELECT project_id, table_name, access_mode, path, line FROM general
  UNION ALL SELECT project_id, table_name, access_mode, path, NULL FROM go_table_rows)""",
    f"""tabs AS (SELECT project_id, table_name, {_LATTICE} AS access_mode, count(DISTINCT concat(path, ':', coalesce(line, 0))) AS n_places FROM every_table GROUP BY 1, 2)""",
]
_ALL_SERVICES = [
    URL_SQL, CLOUD_SQL, SDK_SQL,
    "general_services AS (SELECT * FROM url_rows UNION ALL SELECT * FROM cloud_rows UNION ALL SELECT * FROM sdk_rows)",
]

QUERIES = {
    "files_pinned": lambda spark, sf: pin_files(landed(spark, sf), corpus_projects(spark, sf)).select("project_id", "path"),
    "files_admitted": lambda spark, sf: split(spark, sf).everything.select("project_id", "path"),
    "project_shape": lambda spark, sf: project_shape(split(spark, sf).everything),
    "files_without_vendored_go": lambda spark, sf: drop_vendored_go(landed(spark, sf)).select("project_id", "path"),
    "service_url_hits": scannable(sv.url_hits, SERVICE_COLS),
    "service_cloud_client_hits": scannable(sv.boto_hits, SERVICE_COLS),
    "service_named_client_hits": scannable(sv.sdk_hits, SERVICE_COLS),
    "service_hits_general": _files(sv.service_hits, SERVICE_COLS),
    "project_services_general": project_services,
    "table_sql_writes": reads_or_writes("write"),
    "table_sql_reads": reads_or_writes("read"),
    "table_migrations": _files(tb.migration_hits, TABLE_COLS),
    "table_models": _files(tb.orm_models, TABLE_COLS),
    "table_model_classes": class_map,
    "table_model_queries": query_hits,
    "table_hits_general": _files(tb.table_hits, TABLE_COLS),
    "go_sql_literals": _files(gt.go_sql_literals, ["project_id", "path", "lit_no", "literal"], "go"),
    "go_procedures": _files(lambda f: gt.proc_hits(gt.go_sql_literals(f)), ["project_id", "table_name", "access_mode", "path"], "go"),
    "go_sql_references": _files(
        lambda f: gt.sql_refs_schema(gt.go_sql_literals(f)), ["project_id", "path", "lit_no", "table_name", "access_mode"], "go"
    ),
    "go_table_hits": _files(gt.go_table_hits, ["project_id", "table_name", "access_mode", "path"], "go"),
    "go_config_services": _files(gs.go_config_hits, SERVICE_COLS, "go"),
    "go_adapter_services": _files(gs.go_adapter_hits, SERVICE_COLS, "go"),
    "go_broker_services": _files(gs.go_broker_hits, SERVICE_COLS, "go"),
    "go_tracing_only_files": lambda spark, sf: split(spark, sf).go.filter(gs.apm_only(F.col("content"))).select("project_id", "path"),
    "go_service_hits": _files(gs.go_service_hits, SERVICE_COLS, "go"),
    "project_tables": project_tables,
    "estate_shared_tables": estate_edges,
    "io_javascript": _files(js_io, IO_COLS, "everything", "script"),
    "io_java": _files(java_io, IO_COLS, "everything", "java"),
    "io_yaml_schedules": _files(yaml_cron, IO_COLS, "everything", "yaml"),
    "python_sites_by_kind": sites_by_kind,
    "io_python_decorators": _py(python_decorator_io),
    "io_python_calls": _py(python_call_io),
    "io_python_sql": _py(python_sql_write),
    "io_python_main": _py(python_main_io),
    "io_manifest_commands": _files(lambda f: manifest_cli(manifest_facts(f)), IO_COLS, "everything", "manifest"),
    "go_call_sites": call_sites,
    "io_go_http": _go_io(go.go_http_io),
    "io_go_schedules": _go_io(go.go_schedule_io, keep=True),
    "io_go_broker": _go_io(go.go_broker_io, keep=True),
    "io_go_files": _go_io(go.go_file_io),
    "io_go_commands": go_cli,
    "io_go_pruned": go_pruned,
    "io_all_distinct": all_io,
    "go_skipped_files": _files(go.go_skips, ["project_id", "path", "reason"], "go"),
    "degraded_sections": degraded,
    "purpose_readme": _one_candidate(lambda s: readme_candidate(s.readmes(s.everything))),
    "purpose_manifest": _one_candidate(lambda s: manifest_candidate(manifest_facts(s.of(s.everything, "manifest")))),
    "purpose_docstring": _one_candidate(lambda s: docstring_candidate(s.of(s.everything, "script"), python_call_sites(s.of(s.everything, "python")))),
    "purpose_go_module": _one_candidate(lambda s: go.gomod_candidates(s.of(s.go, "manifest"))),
    "purpose_go_package": _one_candidate(lambda s: go.package_doc_candidate(s.of(s.go, "go"))),
    "purpose_candidates": candidates,
    "purpose_picked": purposes,
    "profiles": profile_summary,
    "check_profiles": profile_violations,
}


def _candidate(source):
    return with_corpus(PURPOSE_SQL) + f" SELECT project_id, source, priority, path, text FROM cands WHERE source IN ({sql_list(source)})"


def _io(table, *ctes):
    return with_corpus(*ctes) + f" SELECT project_id, direction, category, description FROM {table}"


_SERVICE_SELECT = " SELECT project_id, name, kind, path, line FROM "
_TABLE_SELECT = " SELECT project_id, table_name, access_mode, path, line FROM "
_PICKED = """picked AS (SELECT p.project_id, coalesce(CASE WHEN length(text) <= 1000 THEN text ELSE coalesce(nullif(rtrim(regexp_extract(substr(text, 1, 1000), '(?s)^(.+)[ \\t\\n]', 1)), ''), substr(text, 1, 1000)) END, 'unknown') AS purpose_summary,
  CASE WHEN text IS NULL THEN 'insufficient source material' END AS purpose_summary_reason
  FROM projects p LEFT JOIN (SELECT project_id, arg_min(text, priority) AS text FROM cands GROUP BY 1) c USING (project_id) WHERE p.commit_sha IS NOT NULL)"""
_PICKED = _PICKED.replace("SELECT p.project_id, coalesce(CASE", "SELECT project_id, coalesce(CASE")
_PROFILE_SQL = [
    *_ALL_TABLES, *_ALL_SERVICES, *_GO_SERVICE, *IO_SQL, ALL_IO_SQL, PURPOSE_SQL, _PICKED, _SKIPPED,
    """svc AS (SELECT project_id, count(DISTINCT name) AS n FROM (SELECT project_id, name FROM general_services UNION ALL SELECT project_id, name FROM go_service_rows) GROUP BY 1)""",
    """ins AS (SELECT project_id, count(*) AS n, sha256(string_agg(concat(category, '|', description), chr(10) ORDER BY concat(category, '|', description))) AS h FROM all_io WHERE direction = 'in' GROUP BY 1)""",
    """outs AS (SELECT project_id, count(*) AS n FROM all_io WHERE direction = 'out' GROUP BY 1)""",
    """tbl AS (SELECT project_id, count(*) AS n, sha256(string_agg(concat(table_name, '|', access_mode), chr(10) ORDER BY table_name)) AS h FROM tabs GROUP BY 1)""",
    """deg AS (SELECT project_id, count(*) * 3 AS n FROM skipped GROUP BY 1)""",
]

# What each Python template holds: (kind, number) by the name of its file, read off the templates.
PY_SITES_SQL = """py_sites AS (SELECT project_id, unnest(CASE WHEN path = 'app.py' THEN ['docstring|1', 'string|1']
  WHEN regexp_matches(path, '^app/[ad].*\\.py$') THEN ['string|1'] WHEN regexp_matches(path, '^app/c.*\\.py$') THEN ['call|4', 'string|2']
  WHEN regexp_matches(path, '^app/g.*\\.py$') THEN ['call|2', 'string|3'] WHEN regexp_matches(path, '^app/k.*\\.py$') THEN ['call|8', 'main|1', 'string|7']
  WHEN regexp_matches(path, '^app/q.*\\.py$') THEN ['call|7'] WHEN regexp_matches(path, '^app/u.*\\.py$') THEN ['string|4']
  WHEN regexp_matches(path, '^app/w.*\\.py$') THEN ['call|4', 'decorator|5', 'string|3'] ELSE [] END) AS f FROM adm)"""

ORACLE = {
    "python_sites_by_kind": with_corpus(PY_SITES_SQL)
    + " SELECT project_id, split_part(f, '|', 1) AS kind, CAST(sum(CAST(split_part(f, '|', 2) AS BIGINT)) AS BIGINT) AS n FROM py_sites GROUP BY 1, 2",
    "files_pinned": with_corpus() + " SELECT project_id, path FROM live",
    "files_admitted": with_corpus() + " SELECT project_id, path FROM adm",
    "project_shape": with_corpus() + " SELECT * FROM shape",
    "files_without_vendored_go": with_corpus() + " SELECT project_id, path FROM files WHERE NOT (regexp_matches(path, '\\.go$') AND regexp_matches(path, '(^|/)vendor/'))",
    "service_url_hits": with_corpus(URL_SQL) + _SERVICE_SELECT + "url_rows",
    "service_cloud_client_hits": with_corpus(CLOUD_SQL) + _SERVICE_SELECT + "cloud_rows",
    "service_named_client_hits": with_corpus(SDK_SQL) + _SERVICE_SELECT + "sdk_rows",
    "service_hits_general": with_corpus(*_ALL_SERVICES) + _SERVICE_SELECT + "general_services",
    "project_services_general": with_corpus(*_ALL_SERVICES)
    + f" SELECT project_id, name, arg_min(kind, {_RANKED}) AS kind, count(DISTINCT concat(path, ':', line)) AS n_places FROM general_services GROUP BY 1, 2",
    "table_sql_writes": with_corpus(SQL_HITS) + _TABLE_SELECT + "sql_rows WHERE access_mode = 'write'",
    "table_sql_reads": with_corpus(SQL_HITS) + _TABLE_SELECT + "sql_rows WHERE access_mode = 'read'",
    "table_migrations": with_corpus(MIGRATION_SQL) + _TABLE_SELECT + "migration_rows",
    "table_models": with_corpus(MODEL_SQL) + " SELECT project_id, table_name, 'write' AS access_mode, path, line FROM model_rows",
    "table_model_classes": with_corpus(MODEL_SQL, CLASS_SQL) + " SELECT * FROM class_map",
    "table_model_queries": with_corpus(MODEL_SQL, CLASS_SQL, CALLS_SQL) + _TABLE_SELECT + "call_rows WHERE access_mode IS NOT NULL",
    "table_hits_general": with_corpus(*GENERAL_TABLES_SQL) + _TABLE_SELECT + "general",
    "go_sql_literals": with_corpus(GO_LITERALS_SQL) + " SELECT * FROM literals",
    "go_procedures": with_corpus(GO_LITERALS_SQL, PROCS_SQL) + " SELECT * FROM proc_rows",
    "go_sql_references": with_corpus(GO_LITERALS_SQL, PROCS_SQL, GO_REFS_SQL) + " SELECT * FROM lit_rows",
    "go_table_hits": with_corpus(GO_LITERALS_SQL, PROCS_SQL, GO_REFS_SQL) + " SELECT * FROM go_table_rows",
    "go_config_services": with_corpus(GO_CONFIG_SQL) + _SERVICE_SELECT + "config_rows",
    "go_adapter_services": with_corpus(GO_ADAPTER_SQL) + _SERVICE_SELECT + "adapter_rows",
    "go_broker_services": with_corpus(GO_BROKER_SQL) + _SERVICE_SELECT + "broker_rows",
    "go_tracing_only_files": with_corpus() + " SELECT project_id, path FROM go_files WHERE regexp_matches(path, '^internal/adapter/z')",
    "go_service_hits": with_corpus(*_GO_SERVICE) + _SERVICE_SELECT + "go_service_rows",
    "project_tables": with_corpus(*_ALL_TABLES) + " SELECT * FROM tabs",
    "estate_shared_tables": with_corpus(*_ALL_TABLES)
    + """ SELECT a.project_id AS project_id_a, b.project_id AS project_id_b, a.table_name, concat('shared table: ', a.table_name,
  CASE WHEN 'unknown' IN (a.access_mode, b.access_mode) THEN ' [access: unknown]' ELSE '' END) AS label
  FROM tabs a JOIN tabs b ON a.table_name = b.table_name AND a.project_id < b.project_id""",
    "io_javascript": _io("js_rows", JS_SQL),
    "io_java": _io("java_rows", JAVA_SQL),
    "io_yaml_schedules": _io("yaml_rows", YAML_SQL),
    "io_python_decorators": _io("py_deco", PY_SQL),
    "io_python_calls": _io("py_call", PY_SQL),
    "io_python_sql": _io("py_sql", PY_SQL),
    "io_python_main": _io("py_main", PY_SQL),
    "io_manifest_commands": _io("cli_rows", CLI_SQL),
    "go_call_sites": with_corpus(CALL_SITES_SQL)
    + """ SELECT project_id, path, CAST(split_part(f, '|', 1) AS BIGINT) AS line, split_part(f, '|', 2) AS kind, split_part(f, '|', 3) AS receiver,
  split_part(f, '|', 4) AS method, nullif(CAST(split_part(f, '|', 5) AS BIGINT), -1) AS n_args FROM facts""",
    "io_go_http": _io("go_http", GO_FACTS_SQL),
    "io_go_schedules": _io("go_sched", GO_FACTS_SQL),
    "io_go_broker": _io("go_mq", GO_FACTS_SQL),
    "io_go_files": _io("go_fio", GO_FACTS_SQL),
    "io_go_commands": _io("go_cli", GO_FACTS_SQL),
    "io_go_pruned": with_corpus(GO_FACTS_SQL)
    + " UNION ALL ".join(f" SELECT project_id, direction, category, description FROM {t}" for t in ["go_http", "go_sched", "go_mq", "go_fio", "go_cli"]),
    "io_all_distinct": with_corpus(*IO_SQL, ALL_IO_SQL) + " SELECT * FROM all_io",
    "go_skipped_files": with_corpus(_SKIPPED) + " SELECT * FROM skipped",
    "degraded_sections": with_corpus(_SKIPPED)
    + """, s AS (SELECT project_id, path, reason, unnest(['abstract_io', 'external_services', 'database_tables']) AS section, unnest([1, 2, 3]) AS n FROM skipped)
  SELECT project_id, string_agg(concat(section, ': skipped ', path, ' (', reason, ')'), chr(10) ORDER BY n, path) AS lines FROM s GROUP BY 1""",
    "purpose_readme": _candidate(["readme"]),
    "purpose_manifest": _candidate(["manifest"]),
    "purpose_docstring": _candidate(["module_docstring"]),
    "purpose_go_module": _candidate(["gomod_comment", "gomod_module_path"]),
    "purpose_go_package": _candidate(["package_doc_comment"]),
    "purpose_candidates": with_corpus(PURPOSE_SQL) + " SELECT project_id, source, priority, path, text FROM cands",
    "purpose_picked": with_corpus(PURPOSE_SQL, _PICKED) + " SELECT * FROM picked",
    "profiles": with_corpus(*_PROFILE_SQL)
    + """ SELECT p.project_id, p.full_path, p.branch, p.commit_sha, picked.purpose_summary, picked.purpose_summary_reason,
  coalesce(ins.n, 0) AS n_inputs, coalesce(outs.n, 0) AS n_outputs, coalesce(svc.n, 0) AS n_services, coalesce(tbl.n, 0) AS n_tables,
  coalesce(deg.n, 0) AS n_degraded, coalesce(ins.h, sha256('')) AS inputs_hash, coalesce(tbl.h, sha256('')) AS tables_hash
  FROM projects p JOIN picked USING (project_id) LEFT JOIN ins USING (project_id) LEFT JOIN outs USING (project_id)
  LEFT JOIN svc USING (project_id) LEFT JOIN tbl USING (project_id) LEFT JOIN deg USING (project_id)""",
    "check_profiles": with_corpus(*_PROFILE_SQL)
    + """ SELECT project_id, 'unknown_without_reason' AS violation, CAST(NULL AS VARCHAR) AS detail FROM picked WHERE project_id % 2 = 0 AND purpose_summary_reason IS NULL
  UNION ALL SELECT DISTINCT project_id, 'repeated_service', name FROM (SELECT project_id, name FROM general_services UNION ALL SELECT project_id, name FROM go_service_rows) WHERE project_id % 4 = 0
  UNION ALL SELECT project_id, 'dependency_without_location', table_name FROM tabs WHERE project_id % 4 = 1""",
}
