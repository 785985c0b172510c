"""Aggregates, joins, snapshots and lookups on order lines, orders, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.text import (
    SUMMARIES_SQL,
    sql_excerpt,
    sql_flat,
    sql_key_tokens,
    sql_stance,
    sql_truncate,
    summaries,
)
from estatelens import rules
from estatelens.operators import coalesce as co
from estatelens.operators import conflicts as cf
from estatelens.operators import graph as gr
from estatelens.operators import lookups as lk
from estatelens.operators import snapshots as sn
from estatelens.operators.profiles import check_flat, check_summaries
from estatelens.operators.purpose import description_candidate, pick_purpose
from estatelens.plans.corpus import corpus_projects, corpus_sql, projects_sql, table
from estatelens.session import scratch_folder
from estatelens.sources.landing import missing_branch, read_projects, text_only, with_branch

# --- table hits from order lines ----------------------------------------------

_MODE = "CASE l_returnflag WHEN 'R' THEN 'read' WHEN 'A' THEN 'write' ELSE 'unknown' END"
_HIT = (
    f"l_suppkey AS project_id, concat('p', l_partkey) AS table_name, {_MODE} AS access_mode,"
    " concat('src/o', l_orderkey % 7) AS path, CAST(l_linenumber AS INT) AS line,"
    " l_orderkey * 10 + l_linenumber AS seq"
)
HITS_SQL = f"hits AS (SELECT {_HIT} FROM lineitem)"
TABLES_SQL = f"""{HITS_SQL},
tabs AS (SELECT project_id, table_name,
  CASE WHEN bool_or(access_mode = 'read') AND bool_or(access_mode = 'write') THEN 'read_write'
       WHEN bool_or(access_mode = 'write') THEN 'write' WHEN bool_or(access_mode = 'read') THEN 'read'
       ELSE 'unknown' END AS access_mode FROM hits GROUP BY 1, 2)"""
# Nine of ten projects are in the catalog.
CATALOG_SQL = (
    "catalog AS (SELECT s_suppkey AS project_id, concat('estate/', s_name) AS full_path FROM supplier"
    " WHERE s_nationkey <> 7)"
)


def line_hits(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*_split(_HIT))


def _split(select: str) -> list[str]:
    """Top-level commas of a select list."""
    out, depth, last = [], 0, 0
    for n, ch in enumerate(select):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(select[last:n])
            last = n + 1
    return [*out, select[last:]]


def line_tables(spark, sf):
    return co.coalesce_tables(line_hits(spark, sf))


def catalog(spark, sf):
    return (
        table(spark, sf, "supplier")
        .filter("s_nationkey <> 7")
        .selectExpr("s_suppkey AS project_id", "concat('estate/', s_name) AS full_path")
    )


def edges(spark, sf):
    return gr.shared_table_edges(line_tables(spark, sf), catalog(spark, sf))


EDGES_SQL = f"""
WITH {TABLES_SQL}, {CATALOG_SQL}, scoped AS (SELECT tabs.* FROM tabs SEMI JOIN catalog USING (project_id))
SELECT a.project_id AS project_id_a, b.project_id AS project_id_b, a.table_name,
       concat('shared table: ', a.table_name,
              CASE WHEN 'unknown' IN (a.access_mode, b.access_mode) THEN ' [access: unknown]' ELSE '' END) AS label
FROM scoped a JOIN scoped b ON a.table_name = b.table_name AND a.project_id < b.project_id
"""

# --- service and I/O hits from events -------------------------------------------

_KINDS = (
    "CASE event_id % 5 WHEN 0 THEN 'other' WHEN 1 THEN 'http_api' WHEN 2 THEN 'cache' WHEN 3 THEN 'message_broker'"
    " ELSE 'other' END"
)
_SERVICE = (
    f"user_id AS project_id, concat(event_type, '.', event_id % 3) AS name, {_KINDS} AS kind,"
    " concat('src/', event_type) AS path, CAST(event_id % 40 AS INT) AS line, event_id AS seq"
)
_IO = (
    "user_id AS project_id, CASE WHEN event_id % 2 = 0 THEN 'in' ELSE 'out' END AS direction,"
    " CASE WHEN event_id % 2 = 0 THEN CASE event_type WHEN 'view' THEN 'http_request' WHEN 'click' THEN 'file_read'"
    " WHEN 'error' THEN 'other' ELSE 'scheduled_event' END ELSE CASE event_type WHEN 'view' THEN 'http_response'"
    " WHEN 'click' THEN 'external_call' WHEN 'error' THEN 'other' ELSE 'database_write' END END AS category,"
    " concat(event_type, ' ', event_id % 9) AS description, event_id AS seq"
)
SERVICE_SQL = f"hits AS (SELECT {_SERVICE} FROM events)"
IO_SQL = f"hits AS (SELECT {_IO} FROM events)"
_RANK = "CASE kind WHEN 'http_api' THEN 1 WHEN 'other' THEN 2 ELSE 0 END"


def event_services(spark, sf):
    return table(spark, sf, "events").selectExpr(*_split(_SERVICE))


def event_io(spark, sf):
    return table(spark, sf, "events").selectExpr(*_split(_IO))


def nested_services(spark, sf):
    """A1 with its location list: the nested form at its bound (forty lines per file)."""
    joined = co.services_with_locations(event_services(spark, sf))
    shown = F.array_join(
        F.transform("source_locations", lambda x: F.concat_ws(":", x["path"], x["line"].cast("string"))), ","
    )
    return joined.select("project_id", "name", "kind", shown.alias("places"))


def io_report(spark, sf):
    items = co.dedup_io(event_io(spark, sf))
    ins = co.report_rows(items.filter("direction = 'in'"), "inputs", "category", "description", rules.INPUT_CATEGORIES)
    outs = co.report_rows(
        items.filter("direction = 'out'"), "outputs", "category", "description", rules.OUTPUT_CATEGORIES
    )
    return co.ordered_report([ins, outs])


def table_report(spark, sf):
    return co.group_report(line_tables(spark, sf), "tables", "access_mode", "table_name", rules.ACCESS_MODES)


def _position(order: list[str], col: str) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN '{v}' THEN {n}" for n, v in enumerate(order)) + " END"


# --- conflicts ---------------------------------------------------------------

_JUST = (
    "concat(CASE WHEN basis = 'overlap' THEN 'both purpose summaries describe substantially the same primary"
    " responsibility ''' ELSE 'purpose summaries assert contradictory ownership of ''' END, resp_key, ''': \"', shown_a,"
    " '\" vs \"', shown_b, '\"')"
)
TOKENS_SQL = f"""{SUMMARIES_SQL},
toks AS (SELECT *, {sql_key_tokens('purpose_summary')} AS tk, {sql_stance('purpose_summary')} AS stance,
         {sql_excerpt('purpose_summary')} AS shown FROM summaries),
keyed AS (SELECT *, CASE WHEN len(tk) > 0 THEN array_to_string(tk[1:2], ' ') END AS resp_key, list_distinct(tk) AS ts FROM toks)"""
CONFLICTS_SQL = f"""
WITH {TOKENS_SQL}, known AS (SELECT * FROM keyed WHERE purpose_summary <> 'unknown'),
pairs AS (SELECT a.project_id AS project_id_a, b.project_id AS project_id_b, a.resp_key, a.shown AS shown_a, b.shown AS shown_b,
   len(list_filter(a.ts, lambda x: list_contains(b.ts, x))) AS n_both, len(a.ts) AS na, len(b.ts) AS nb,
   a.stance <> b.stance AS opposed
   FROM known a JOIN known b ON a.resp_key = b.resp_key AND a.project_id < b.project_id),
judged AS (SELECT *, CASE WHEN CAST(n_both AS DOUBLE) / (na + nb - n_both) >= 0.6 THEN 'overlap' WHEN opposed THEN 'contradictory_ownership' END AS basis FROM pairs)
SELECT project_id_a, project_id_b, basis, {_JUST} AS justification FROM judged WHERE basis IS NOT NULL
"""


def conflicts(spark, sf):
    return cf.find_conflicts(summaries(spark, sf))


def conflict_numbers(spark, sf):
    return cf.conflict_counts(cf.responsibility_members(summaries(spark, sf)))


def conflict_class_rows(spark, sf):
    return cf.conflict_classes(cf.responsibility_members(summaries(spark, sf))).drop("set_id")


def asked_conflicts(spark, sf):
    """J4 for the projects that suppliers ask about."""
    asked = table(spark, sf, "supplier").selectExpr("s_suppkey AS project_id")
    return cf.conflicts_of(cf.responsibility_members(summaries(spark, sf)), asked)


CONFLICT_COUNTS_SQL = f"""
WITH c AS ({CONFLICTS_SQL}), {TOKENS_SQL.removeprefix('WITH ')},
m AS (SELECT *, array_to_string(list_sort(ts), ' ') AS whole FROM keyed WHERE purpose_summary <> 'unknown' AND resp_key IS NOT NULL),
sides AS (SELECT project_id_a AS project_id, basis FROM c UNION ALL SELECT project_id_b, basis FROM c),
n AS (SELECT project_id, count(*) FILTER (basis = 'overlap') AS n_overlap, count(*) FILTER (basis <> 'overlap') AS n_contradictory FROM sides GROUP BY 1)
SELECT m.project_id, resp_key, min(m.project_id) OVER (PARTITION BY resp_key, whole) AS representative,
  coalesce(n_overlap, 0) AS n_overlap, coalesce(n_contradictory, 0) AS n_contradictory FROM m LEFT JOIN n USING (project_id)
"""
# The same for the projects that customers are.
CUSTOMER_CONFLICT_COUNTS_SQL = CONFLICT_COUNTS_SQL.replace("resp_key IS NOT NULL)", "resp_key IS NOT NULL AND project_id IN (SELECT c_custkey FROM customer))").replace(
    f"WITH c AS ({CONFLICTS_SQL})",
    f"WITH c AS (SELECT * FROM ({CONFLICTS_SQL}) WHERE project_id_a IN (SELECT c_custkey FROM customer) AND project_id_b IN (SELECT c_custkey FROM customer))",
)
CONFLICT_CLASSES_SQL = f"""
WITH {TOKENS_SQL}, m AS (SELECT *, array_to_string(list_sort(ts), ' ') AS whole FROM keyed WHERE purpose_summary <> 'unknown' AND resp_key IS NOT NULL)
SELECT resp_key, min(project_id) AS representative, count(*) AS n_projects, count(*) FILTER (stance = 'owner') AS n_owners,
  count(*) FILTER (stance = 'delegator') AS n_delegators FROM m GROUP BY resp_key, whole
"""


# Each project is asked about with its neighbour and with a far one.
_ASKED = "SELECT doc_id AS project_id_a, doc_id + {n} AS project_id_b FROM documents"


def classified(spark, sf):
    ids = table(spark, sf, "documents").select("doc_id")
    pairs = ids.select(F.col("doc_id").alias("project_id_a"), (F.col("doc_id") + 1).alias("project_id_b")).unionByName(
        ids.select(F.col("doc_id").alias("project_id_a"), (F.col("doc_id") + 30).alias("project_id_b"))
    )
    return cf.classify_pairs(pairs, summaries(spark, sf))


CLASSIFY_SQL = f"""
WITH {TOKENS_SQL}, asked AS ({_ASKED.format(n=1)} UNION ALL {_ASKED.format(n=30)}),
j AS (SELECT q.*, a.purpose_summary = 'unknown' AS ua, b.purpose_summary = 'unknown' AS ub, a.full_path AS pa, b.full_path AS pb,
   a.shown AS shown_a, b.shown AS shown_b, coalesce(a.resp_key, '(no content tokens)') AS ka, coalesce(b.resp_key, '(no content tokens)') AS kb,
   a.resp_key, coalesce(a.resp_key = b.resp_key, FALSE) AS same, coalesce(a.stance <> b.stance, FALSE) AS opposed,
   len(list_filter(a.ts, lambda x: list_contains(b.ts, x))) AS n_both, len(a.ts) AS na, len(b.ts) AS nb
   FROM asked q JOIN keyed a ON a.project_id = q.project_id_a JOIN keyed b ON b.project_id = q.project_id_b),
k AS (SELECT *, CASE WHEN same AND na + nb > 0 AND CAST(n_both AS DOUBLE) / (na + nb - n_both) >= 0.6 THEN 'overlap'
   WHEN same AND opposed THEN 'contradictory_ownership' END AS basis FROM j)
SELECT project_id_a, project_id_b,
  CASE WHEN ua OR ub THEN 'indeterminate' WHEN basis IS NOT NULL THEN 'conflict' ELSE 'no_conflict' END AS kind,
  CASE WHEN ua AND ub THEN concat('purpose summary is unknown for projects ''', pa, ''' and ''', pb, '''')
    WHEN ua OR ub THEN concat('purpose summary is unknown for project ''', CASE WHEN ua THEN pa ELSE pb END, '''')
    WHEN basis IS NOT NULL THEN {_JUST}
    ELSE concat('purpose summaries describe different primary responsibilities (''', ka, ''' vs ''', kb, '''): "', shown_a, '" vs "', shown_b, '"') END AS justification
FROM k
"""

# --- snapshots from orders ------------------------------------------------------

# A month is a snapshot, a customer a project, an order a write of its profile.
_MONTH = "(year(o_orderdate) * 12 + month(o_orderdate))"
_WRITE = (
    f"CAST({_MONTH} AS BIGINT) AS snapshot_id, o_custkey AS project_id, o_orderkey AS write_seq,"
    " concat('sha', o_orderkey) AS commit_sha, o_orderstatus AS status"
)
# Every seventh month failed, every ninth is still running; late months committed first.
COMMITS_SQL = f"""commits AS (SELECT DISTINCT CAST({_MONTH} AS BIGINT) AS snapshot_id,
  CAST(({_MONTH} * 37) % 1009 AS BIGINT) AS commit_seq,
  CASE WHEN {_MONTH} % 7 = 0 THEN 'failed' WHEN {_MONTH} % 9 = 0 THEN 'in_progress' ELSE 'completed' END AS status,
  'full' AS trigger, date_trunc('month', o_orderdate) AS started_at,
  CASE WHEN {_MONTH} % 9 = 0 AND {_MONTH} % 7 <> 0 THEN NULL ELSE date_trunc('month', o_orderdate) END AS completed_at FROM orders)"""
WRITES_SQL = f"writes AS (SELECT {_WRITE} FROM orders)"
LAST_SQL = """last_writes AS (SELECT snapshot_id, project_id, commit_sha, status FROM
  (SELECT *, row_number() OVER (PARTITION BY snapshot_id, project_id ORDER BY write_seq DESC) AS n FROM writes) WHERE n = 1)"""
_CURRENT = "(SELECT arg_max(snapshot_id, commit_seq) FROM commits WHERE status = 'completed')"


def writes(spark, sf):
    return table(spark, sf, "orders").selectExpr(*_split(_WRITE))


def last_writes(spark, sf):
    return sn.upsert_last(writes(spark, sf), ["snapshot_id", "project_id"], "write_seq")


def commits(spark, sf):
    done = f"CASE WHEN {_MONTH} % 9 = 0 AND {_MONTH} % 7 <> 0 THEN NULL ELSE date_trunc('month', o_orderdate) END"
    return (
        table(spark, sf, "orders")
        .selectExpr(
            f"CAST({_MONTH} AS BIGINT) AS snapshot_id",
            f"CAST(({_MONTH} * 37) % 1009 AS BIGINT) AS commit_seq",
            f"CASE WHEN {_MONTH} % 7 = 0 THEN 'failed' WHEN {_MONTH} % 9 = 0 THEN 'in_progress' ELSE 'completed' END AS status",
            "'full' AS trigger",
            "date_trunc('month', o_orderdate) AS started_at",
            f"{done} AS completed_at",
        )
        .distinct()
    )


def current_profiles(spark, sf):
    return sn.current_rows(last_writes(spark, sf), commits(spark, sf)).select("project_id", "commit_sha", "status")


def copied_forward(spark, sf):
    """Each month's profiles over those of the month before."""
    w = last_writes(spark, sf)
    changed = w.filter("snapshot_id % 2 = 0").drop("snapshot_id", "status")
    parent = w.filter("snapshot_id % 2 = 1").drop("snapshot_id", "status")
    latest = F.max_by("commit_sha", F.length("commit_sha") * 10000000 + F.substring("commit_sha", 4, 20).cast("long"))
    return sn.carry_forward(
        parent.groupBy("project_id").agg(latest.alias("commit_sha")),
        changed.groupBy("project_id").agg(latest.alias("commit_sha")),
    )


def metadata(spark, sf):
    meta = sn.snapshot_metadata(commits(spark, sf), last_writes(spark, sf))
    pairs = F.transform(F.map_entries("commit_sha_by_project"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"]))
    return meta.select(
        "snapshot_id",
        "status",
        "trigger",
        F.date_format("started_at", "yyyy-MM-dd").alias("started"),
        F.date_format("completed_at", "yyyy-MM-dd").alias("completed"),
        F.array_join(pairs, ",").alias("shas"),
    )


def summary_rows(spark, sf):
    """N6 of fixed size."""
    found = sn.snapshot_summary(commits(spark, sf), last_writes(spark, sf))
    return found.select("snapshot_id", "status", "trigger", F.date_format("started_at", "yyyy-MM-dd").alias("started"), "n_projects", "commits_digest")


def customers(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey AS project_id", "c_name AS full_path")


def asked_ids(spark, sf):
    """One id per order line's part: many are no customer at all."""
    return table(spark, sf, "lineitem").selectExpr("l_partkey AS project_id")


def statuses(spark, sf):
    return lk.lookup_status(asked_ids(spark, sf), customers(spark, sf), current_profiles(spark, sf))


def counts(spark, sf):
    projects = corpus_projects(spark, sf)
    files = table(spark, sf, "lineitem").selectExpr("l_suppkey AS project_id")
    return co.refresh_counts(projects, files)


_PROJECTS_SQL = f"projects AS ({projects_sql()})"


def purposes(spark, sf):
    """Project descriptions against the documents as READMEs (priority 1) or as package comments (7)."""
    projects = table(spark, sf, "documents").selectExpr(
        "doc_id AS project_id", "CASE WHEN doc_id % 4 = 0 THEN source WHEN doc_id % 4 = 1 THEN ' ' END AS description"
    )
    readme = table(spark, sf, "documents").selectExpr(
        "doc_id AS project_id", "if(doc_id % 3 = 0, 'readme', 'package_doc_comment') AS source", "if(doc_id % 3 = 0, 1, 7) AS priority",
        "if(doc_id % 3 = 0, 'README.md', 'main.go') AS path", "text",
    )
    return pick_purpose(projects, description_candidate(projects).unionByName(readme))


PURPOSE_SQL = f"""
WITH d AS (SELECT doc_id AS project_id, CASE WHEN doc_id % 4 = 0 THEN source WHEN doc_id % 4 = 1 THEN ' ' END AS description,
  CASE WHEN doc_id % 3 = 0 THEN text END AS readme, text FROM documents),
b AS (SELECT project_id, coalesce(readme, nullif({sql_flat('description')}, ''), text) AS t FROM d)
SELECT project_id, coalesce({sql_truncate('t')}, 'unknown') AS purpose_summary,
  CASE WHEN t IS NULL THEN 'insufficient source material' END AS purpose_summary_reason FROM b
"""


def flat_violations(spark, sf):
    """Q8 on raw rows that break the rules: repeats, long and unexplained summaries. Each document is a summary, each supplier one that is unknown."""
    docs = table(spark, sf, "documents").selectExpr("doc_id AS project_id", "text AS purpose_summary", "CAST(NULL AS STRING) AS purpose_summary_reason")
    docs = docs.unionByName(table(spark, sf, "supplier").selectExpr("s_suppkey AS project_id", "'unknown' AS purpose_summary", "CASE WHEN s_suppkey % 2 = 0 THEN 'why' END AS purpose_summary_reason"))
    return (
        check_summaries(docs)
        .unionByName(check_flat(line_hits(spark, sf), "table_name", "repeated_table"))
        .unionByName(check_flat(event_services(spark, sf), "name", "repeated_service"))
    )


VIOLATIONS_SQL = f"""
WITH d AS (SELECT doc_id AS project_id, text AS s, NULL AS r FROM documents
  UNION ALL SELECT s_suppkey, 'unknown', CASE WHEN s_suppkey % 2 = 0 THEN 'why' END FROM supplier)
SELECT project_id, 'summary_too_long' AS violation, CAST(length(s) AS VARCHAR) AS detail FROM d WHERE length(s) > 1000
UNION ALL SELECT project_id, 'unknown_without_reason', NULL FROM d WHERE s = 'unknown' AND coalesce(r, '') = ''
UNION ALL SELECT project_id, 'repeated_table', table_name FROM (SELECT {_HIT} FROM lineitem) GROUP BY project_id, table_name HAVING count(*) > 1
UNION ALL SELECT project_id, 'repeated_service', name FROM (SELECT {_SERVICE} FROM events) GROUP BY project_id, name HAVING count(*) > 1
"""


def landed_projects(spark, sf):
    """Projects landed as a table and read back."""
    path = scratch_folder(spark)
    corpus_projects(spark, sf).write.parquet(path)
    return read_projects(spark, path).select("project_id", "full_path", "branch", "description")


def text_bodies(spark, sf):
    """Documents as binary bodies, one in seven of them no UTF-8."""
    body = F.expr("CASE WHEN doc_id % 7 = 0 THEN concat(unhex('FF'), cast(text AS binary)) ELSE cast(text AS binary) END")
    bodies = table(spark, sf, "documents").select(F.col("doc_id").alias("project_id"), body.alias("content"))
    return text_only(bodies).select("project_id", F.length("content").cast("long").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("body"))


def capped(spark, sf):
    """The first files of each project by path, with the limit of the feature at 40."""
    from estatelens.sources.admission import cap_files

    files = table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS project_id", "concat('f', l_orderkey, '_', l_linenumber, '_', l_partkey) AS path"
    )
    return cap_files(files, 40)


QUERIES = {
    "coalesce_tables": line_tables,
    "table_locations": lambda spark, sf: co.locations(line_hits(spark, sf), "table_name"),
    "coalesce_services": lambda spark, sf: co.coalesce_services(event_services(spark, sf)),
    "coalesce_services_first": lambda spark, sf: co.coalesce_services_first(event_services(spark, sf)),
    "services_with_locations": nested_services,
    "dedup_inputs_outputs": lambda spark, sf: co.dedup_io(event_io(spark, sf)),
    "report_inputs_outputs": io_report,
    "report_tables_by_access": table_report,
    "refresh_counts": counts,
    "refresh_totals": lambda spark, sf: co.refresh_totals(counts(spark, sf)),
    "shared_table_edges": edges,
    "shared_table_edge_digest": lambda spark, sf: gr.shared_table_edge_digest(edges(spark, sf)),
    "landed_projects": landed_projects,
    "text_bodies": text_bodies,
    "hub_tables": lambda spark, sf: gr.hub_tables(line_tables(spark, sf)),
    "edge_classes": lambda spark, sf: gr.edge_classes(line_tables(spark, sf), catalog(spark, sf)),
    "project_edges": lambda spark, sf: gr.project_edges(line_tables(spark, sf), catalog(spark, sf)),
    "edges_of_projects": lambda spark, sf: gr.edges_of(
        line_tables(spark, sf), table(spark, sf, "nation").selectExpr("n_nationkey AS project_id"), catalog(spark, sf)
    ),
    "graph_nodes": lambda spark, sf: gr.graph_nodes(catalog(spark, sf), line_tables(spark, sf)),
    "graph_state": lambda spark, sf: gr.graph_state(catalog(spark, sf), line_tables(spark, sf)),
    "tables_in_scope": lambda spark, sf: gr.profiles_in_scope(line_tables(spark, sf), catalog(spark, sf)),
    "purpose_conflicts": conflicts,
    "conflict_counts": conflict_numbers,
    "conflict_classes": conflict_class_rows,
    "conflicts_of_projects": asked_conflicts,
    "classify_pairs": classified,
    "pick_purpose": purposes,
    "projects_missing_branch": lambda spark, sf: missing_branch(corpus_projects(spark, sf)),
    "projects_with_branch": lambda spark, sf: with_branch(corpus_projects(spark, sf)).select("project_id", "full_path"),
    "cap_files_per_project": capped,
    "snapshot_last_write": last_writes,
    "snapshot_current_profiles": current_profiles,
    "snapshot_copy_forward": copied_forward,
    "snapshot_metadata": metadata,
    "snapshot_summary": summary_rows,
    "list_projects": lambda spark, sf: lk.list_projects(customers(spark, sf)),
    "lookup_purpose": lambda spark, sf: lk.project_purpose(
        summaries(spark, sf).withColumn("purpose_summary_reason", F.lit(None).cast("string")),
        asked_ids(spark, sf),
    ),
    "lookup_dependencies": lambda spark, sf: line_tables(spark, sf).join(
        table(spark, sf, "orders").selectExpr("o_custkey AS project_id").distinct(), "project_id", "left_semi"
    ),
    "lookup_io": lambda spark, sf: co.dedup_io(event_io(spark, sf)).join(
        asked_ids(spark, sf).distinct(), "project_id", "left_semi"
    ).drop("seq"),
    "lookup_status": statuses,
    "projects_not_analyzed": lambda spark, sf: lk.not_analyzed(customers(spark, sf), current_profiles(spark, sf)),
    "ids_out_of_scope": lambda spark, sf: lk.out_of_scope(asked_ids(spark, sf), customers(spark, sf)),
    "check_profile_rules": flat_violations,
}

_NODES = "nodes_on AS (SELECT project_id FROM scoped GROUP BY table_name, project_id)"
_SCOPED = f"{TABLES_SQL}, {CATALOG_SQL}, scoped AS (SELECT tabs.* FROM tabs SEMI JOIN catalog USING (project_id))"
_STATUS_CURRENT = f"WITH {WRITES_SQL}, {LAST_SQL}, {COMMITS_SQL}, cur AS (SELECT * FROM last_writes WHERE snapshot_id = {_CURRENT})"

ORACLE = {
    "coalesce_tables": f"WITH {TABLES_SQL} SELECT * FROM tabs",
    "table_locations": f"WITH {HITS_SQL} SELECT project_id, table_name, path, line, min(seq) AS seq FROM hits GROUP BY ALL",
    "coalesce_services": f"WITH {SERVICE_SQL} SELECT project_id, name, arg_min(kind, {_RANK} * 1000000000 + seq) AS kind FROM hits GROUP BY ALL",
    "coalesce_services_first": f"WITH {SERVICE_SQL} SELECT project_id, name, arg_min(kind, seq) AS kind, min(seq) AS first_seq FROM hits GROUP BY ALL",
    "services_with_locations": f"""
WITH {SERVICE_SQL}, spots AS (SELECT DISTINCT project_id, name, path, line FROM hits),
k AS (SELECT project_id, name, arg_min(kind, {_RANK} * 1000000000 + seq) AS kind FROM hits GROUP BY ALL)
SELECT project_id, name, kind, string_agg(concat(path, ':', line), ',' ORDER BY path, line) AS places
FROM k JOIN spots USING (project_id, name) GROUP BY ALL
""",
    "dedup_inputs_outputs": f"WITH {IO_SQL} SELECT project_id, direction, category, description, min(seq) AS seq FROM hits GROUP BY ALL",
    "report_inputs_outputs": f"""
WITH {IO_SQL}, d AS (SELECT DISTINCT project_id, direction, category, description FROM hits)
SELECT project_id, CASE direction WHEN 'in' THEN 'inputs' ELSE 'outputs' END AS section,
  CASE direction WHEN 'in' THEN {_position(rules.INPUT_CATEGORIES, 'category')} ELSE {_position(rules.OUTPUT_CATEGORIES, 'category')} END AS group_no,
  category AS group_name, description AS item, description AS label FROM d
""",
    "report_tables_by_access": f"""
WITH {TABLES_SQL} SELECT project_id, 'tables' AS section, {_position(rules.ACCESS_MODES, 'access_mode')} AS group_no,
  access_mode AS group_name, table_name AS item,
  CASE WHEN access_mode = 'unknown' THEN concat(table_name, ' [access: unknown]') ELSE table_name END AS label FROM tabs
""",
    "refresh_counts": f"""
WITH {_PROJECTS_SQL}, n AS (SELECT l_suppkey AS project_id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT project_id, CASE WHEN commit_sha IS NULL THEN 'skipped' ELSE 'profiled' END AS outcome,
  CASE WHEN commit_sha IS NULL THEN 0 ELSE coalesce(n, 0) END AS n_files FROM projects LEFT JOIN n USING (project_id)
""",
    "refresh_totals": f"""
WITH {_PROJECTS_SQL}, n AS (SELECT l_suppkey AS project_id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT count(commit_sha) AS profiles_written, count(*) - count(commit_sha) AS skipped,
  CAST(sum(CASE WHEN commit_sha IS NULL THEN 0 ELSE coalesce(n, 0) END) AS BIGINT) AS files FROM projects LEFT JOIN n USING (project_id)
""",
    "shared_table_edges": EDGES_SQL,
    "shared_table_edge_digest": f"""
SELECT project_id_a, project_id_b, count(*) AS n_edges,
  CAST(sum(CAST('0x' || substr(md5(concat(table_name, '|', label)), 1, 8) AS BIGINT)) AS BIGINT) AS edges_hash FROM ({EDGES_SQL}) GROUP BY 1, 2
""",
    "landed_projects": f"WITH {corpus_sql()} SELECT project_id, full_path, branch, nullif(description, '') AS description FROM projects",
    "text_bodies": "SELECT doc_id AS project_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS body FROM documents WHERE doc_id % 7 <> 0",
    "hub_tables": f"""
WITH {TABLES_SQL} SELECT table_name, count(*) AS n_projects, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS n_edges
FROM tabs GROUP BY 1 HAVING count(*) > 1
""",
    "edge_classes": f"""
WITH {_SCOPED}, c AS (SELECT table_name, count(*) AS n_projects, count(*) FILTER (access_mode = 'unknown') AS n_unknown FROM scoped GROUP BY 1),
e AS (SELECT table_name, count(*) AS n_edges, count(*) FILTER (contains(label, '[access: unknown]')) AS n_unknown_edges FROM ({EDGES_SQL}) GROUP BY 1)
SELECT * FROM c JOIN e USING (table_name)
""",
    "project_edges": f"""
WITH e AS ({EDGES_SQL}), s AS (SELECT project_id_a AS project_id, table_name, label FROM e UNION ALL SELECT project_id_b, table_name, label FROM e)
SELECT project_id, count(DISTINCT table_name) AS n_tables, count(*) AS n_edges, count(*) FILTER (contains(label, '[access: unknown]')) AS n_unknown_edges,
  CAST(sum(CAST('0x' || substr(md5(concat(table_name, '|', label)), 1, 8) AS BIGINT)) % 1000000000000000 AS BIGINT) AS edges_hash FROM s GROUP BY 1
""",
    "edges_of_projects": f"""
SELECT * FROM ({EDGES_SQL}) WHERE project_id_a IN (SELECT n_nationkey FROM nation) OR project_id_b IN (SELECT n_nationkey FROM nation)
""",
    "graph_nodes": f"""
WITH {_SCOPED}, e AS (SELECT a.project_id AS x, b.project_id AS y FROM scoped a JOIN scoped b ON a.table_name = b.table_name AND a.project_id < b.project_id)
SELECT project_id, concat(project_id, ' ', full_path) AS label FROM catalog
WHERE project_id IN (SELECT x FROM e UNION SELECT y FROM e) ORDER BY project_id
""",
    "graph_state": f"""
WITH {_SCOPED}, e AS (SELECT count(*) AS n FROM scoped a JOIN scoped b ON a.table_name = b.table_name AND a.project_id < b.project_id),
c AS (SELECT count(*) AS n FROM catalog)
SELECT CASE WHEN c.n = 0 THEN 'empty_catalog' WHEN e.n = 0 THEN 'no_shared_dependencies' ELSE 'edges' END AS state,
  c.n AS n_projects, e.n AS n_edges FROM e, c
""",
    "tables_in_scope": f"WITH {_SCOPED} SELECT * FROM scoped",
    "purpose_conflicts": CONFLICTS_SQL,
    "conflict_counts": CONFLICT_COUNTS_SQL,
    "conflict_classes": CONFLICT_CLASSES_SQL,
    "conflicts_of_projects": f"""
SELECT * FROM ({CONFLICTS_SQL}) WHERE project_id_a IN (SELECT s_suppkey FROM supplier) OR project_id_b IN (SELECT s_suppkey FROM supplier)
""",
    "classify_pairs": CLASSIFY_SQL,
    "pick_purpose": PURPOSE_SQL,
    "projects_missing_branch": """
SELECT s_suppkey AS project_id, 'analysis_branch_missing' AS reason,
  concat('branch ''uat'' missing on project ', s_suppkey) AS detail FROM supplier WHERE s_suppkey % 10 = 9
""",
    "projects_with_branch": f"WITH {_PROJECTS_SQL} SELECT project_id, full_path FROM projects WHERE commit_sha IS NOT NULL",
    "cap_files_per_project": """
SELECT project_id, path FROM (SELECT l_suppkey AS project_id, concat('f', l_orderkey, '_', l_linenumber, '_', l_partkey) AS path FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY path) <= 40
""",
    "snapshot_last_write": f"WITH {WRITES_SQL}, {LAST_SQL} SELECT * FROM last_writes",
    "snapshot_current_profiles": f"{_STATUS_CURRENT} SELECT project_id, commit_sha, status FROM cur",
    "snapshot_copy_forward": f"""
WITH {WRITES_SQL}, {LAST_SQL},
changed AS (SELECT project_id, arg_max(commit_sha, CAST(substr(commit_sha, 4) AS BIGINT)) AS commit_sha FROM last_writes WHERE snapshot_id % 2 = 0 GROUP BY 1),
parent AS (SELECT project_id, arg_max(commit_sha, CAST(substr(commit_sha, 4) AS BIGINT)) AS commit_sha FROM last_writes WHERE snapshot_id % 2 = 1 GROUP BY 1)
SELECT project_id, coalesce(changed.commit_sha, parent.commit_sha) AS commit_sha FROM changed FULL JOIN parent USING (project_id)
""",
    "snapshot_metadata": f"""
WITH {WRITES_SQL}, {LAST_SQL}, {COMMITS_SQL},
m AS (SELECT snapshot_id, string_agg(concat(project_id, '=', commit_sha), ',' ORDER BY project_id) AS shas FROM last_writes GROUP BY 1)
SELECT snapshot_id, status, trigger, strftime(started_at, '%Y-%m-%d') AS started, strftime(completed_at, '%Y-%m-%d') AS completed, shas
FROM commits LEFT JOIN m USING (snapshot_id)
""",
    "snapshot_summary": f"""
WITH {WRITES_SQL}, {LAST_SQL}, {COMMITS_SQL},
m AS (SELECT snapshot_id, count(*) AS n, CAST(sum(CAST('0x' || substr(md5(concat(project_id, '=', commit_sha)), 1, 12) AS BIGINT)) % 1000000000000000 AS BIGINT) AS d FROM last_writes GROUP BY 1)
SELECT snapshot_id, status, trigger, strftime(started_at, '%Y-%m-%d') AS started, coalesce(n, 0) AS n_projects, coalesce(d, 0) AS commits_digest FROM commits LEFT JOIN m USING (snapshot_id)
""",
    "list_projects": "SELECT c_custkey AS project_id, c_name AS full_path FROM customer ORDER BY 1",
    "lookup_purpose": f"""
WITH {SUMMARIES_SQL} SELECT project_id, purpose_summary, CAST(NULL AS VARCHAR) AS purpose_summary_reason FROM summaries
WHERE project_id IN (SELECT l_partkey FROM lineitem)
""",
    "lookup_dependencies": f"WITH {TABLES_SQL} SELECT * FROM tabs WHERE project_id IN (SELECT o_custkey FROM orders)",
    "lookup_io": f"""
WITH {IO_SQL} SELECT DISTINCT project_id, direction, category, description FROM hits
WHERE project_id IN (SELECT l_partkey FROM lineitem)
""",
    "lookup_status": f"""
{_STATUS_CURRENT} SELECT DISTINCT l_partkey AS project_id, CASE WHEN l_partkey NOT IN (SELECT c_custkey FROM customer) THEN 'not in scope'
  WHEN l_partkey NOT IN (SELECT project_id FROM cur) THEN 'not yet analyzed' ELSE 'ok' END AS status FROM lineitem
""",
    "projects_not_analyzed": f"""
{_STATUS_CURRENT} SELECT c_custkey AS project_id, c_name AS full_path FROM customer WHERE c_custkey NOT IN (SELECT project_id FROM cur)
""",
    "ids_out_of_scope": "SELECT DISTINCT l_partkey AS project_id FROM lineitem WHERE l_partkey NOT IN (SELECT c_custkey FROM customer)",
    "check_profile_rules": VIOLATIONS_SQL,
}
