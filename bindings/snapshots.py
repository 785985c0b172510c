"""Stored snapshots of profiles made from events, order lines and documents: written, refreshed, and asked about.

Customers are the projects; events are their inputs, outputs and services,
order lines their tables, documents their summaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindings.estate import (
    CONFLICTS_SQL,
    CUSTOMER_CONFLICT_COUNTS_SQL,
    IO_SQL,
    SERVICE_SQL,
    TABLES_SQL,
    _RANK,
    event_io,
    event_services,
    line_hits,
    summaries,
)
from bindings.text import SUMMARIES_SQL
from estatelens.operators import coalesce as co
from estatelens.operators import lookups as lk
from estatelens.operators.conflicts import find_conflicts
from estatelens.operators.profiles import build_profiles, profile_sections
from estatelens.operators.snapshots import SnapshotStore
from estatelens.plans.corpus import table
from estatelens.schemas import SKIPS
from estatelens.session import scratch_folder, stored
from estatelens.streaming.views import EstateViews


def _projects(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS project_id", "c_name AS full_path", "'uat' AS branch", "concat('sha', c_custkey) AS commit_sha"
    )


def _profiles(spark, sf, hits: DataFrame) -> DataFrame:
    """A5 with the tables that ``hits`` tell of."""
    services = co.services_with_locations(co.by_project(event_services(spark, sf))).withColumn("order_key", F.col("name"))
    tables = co.tables_with_locations(co.by_project(hits)).withColumn("order_key", F.col("table_name"))
    purpose = summaries(spark, sf).select("project_id", "purpose_summary", F.lit(None).cast("string").alias("purpose_summary_reason"))
    degraded = spark.createDataFrame([], "project_id long, degraded_sections array<string>")
    return build_profiles(_projects(spark, sf), purpose, co.dedup_io(event_io(spark, sf)), services, tables, degraded)


_STORES: dict[tuple[str, str], tuple[SnapshotStore, EstateViews]] = {}


def refreshed(spark, sf) -> tuple[SnapshotStore, EstateViews]:
    """A store whose first snapshot knows a part of the order lines, and two refreshes that bring the others; made once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        store = SnapshotStore(spark, scratch_folder(spark))
        views = EstateViews(store)
        whole = stored(_profiles(spark, sf, line_hits(spark, sf)))
        early = _profiles(spark, sf, line_hits(spark, sf).filter("line <= 3"))
        parent = None
        for rows in (early, whole.filter("project_id % 2 = 0"), whole.filter("project_id % 2 = 1")):
            new = store.begin_snapshot("full" if parent is None else "single_project", parent)
            skips = spark.createDataFrame([], SKIPS)
            if parent is None:
                store.write("profiles", new, rows)
                store.write("catalog", new, store.written("profiles", new).select("project_id", "full_path"), placed=True)
                store.write("skips", new, skips)
            else:
                store.copy_forward(parent, new, rows, rows.select("project_id", "full_path"), skips)
            views.keep_up(new, parent)
            store.commit(new)
            parent = new
        _STORES[key] = store, views
    return _STORES[key]


def _asked(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").selectExpr("n_nationkey AS project_id")


def _current(spark, sf) -> DataFrame:
    return refreshed(spark, sf)[0].current("profiles")


def _sizes(profiles: DataFrame) -> DataFrame:
    sizes = [F.size(c).cast("long").alias(f"n_{c}") for c in ("abstract_inputs", "abstract_outputs", "services", "tables")]
    return profiles.select("project_id", "full_path", "commit_sha", "purpose_summary", *sizes)


def sections(spark, sf):
    """A5 in long form: every fact of every project as a numbered row."""
    services = co.coalesce_services(event_services(spark, sf)).withColumn("order_key", F.col("name"))
    tables = co.coalesce_tables(line_hits(spark, sf)).withColumn("order_key", F.col("table_name"))
    lost = table(spark, sf, "part").selectExpr("p_partkey % 50 AS project_id", "concat(if(p_partkey % 3 = 0, 'cmd/x/', 'pkg/'), if(p_partkey % 9 = 0, '', CAST(p_partkey AS STRING)), 'main.go') AS path", "p_brand AS reason")
    return profile_sections(co.dedup_io(event_io(spark, sf)), services, tables, lost)


def written(spark, sf):
    """A snapshot written and read back."""
    return _sizes(_current(spark, sf))


def asked_io(spark, sf):
    """Q3: inputs and outputs of given projects of the current snapshot."""
    found = lk.project_io(_current(spark, sf), _asked(spark, sf))
    sides = [found.select("project_id", F.lit(d).alias("direction"), F.explode(c).alias("x")) for d, c in (("in", "abstract_inputs"), ("out", "abstract_outputs"))]
    return sides[0].unionByName(sides[1]).select("project_id", "direction", "x.category", "x.description")


def asked_dependencies(spark, sf):
    """Q4: services and tables of given projects of the current snapshot."""
    found = lk.project_dependencies(_current(spark, sf), _asked(spark, sf))

    def side(column: str, name: str, kind: str) -> DataFrame:
        rows = found.select("project_id", F.explode(column).alias("x"))
        return rows.select("project_id", F.lit(column).alias("section"), F.col(f"x.{name}").alias("name"), F.col(f"x.{kind}").alias("kind"), F.size("x.source_locations").cast("long").alias("n_places"))

    return side("services", "name", "kind").unionByName(side("tables", "table_name", "access_mode"))


def asked_profiles(spark, sf):
    """Q5: whole profiles of given projects of the current snapshot."""
    return _sizes(lk.project_profile(_current(spark, sf), _asked(spark, sf)))


def current_conflicts(spark, sf):
    """Q6: conflicts of the current snapshot."""
    return find_conflicts(_current(spark, sf))


def view_edges(spark, sf):
    """R2: shared tables as the refreshes kept them up."""
    store, views = refreshed(spark, sf)
    return views.edge_classes(store.pointer())


def view_conflicts(spark, sf):
    """R2: conflicts per project as the refreshes kept them up."""
    store, views = refreshed(spark, sf)
    return views.conflict_counts(store.pointer()).drop("set_id")


def view_services(spark, sf):
    """R2: services as the refreshes kept them up."""
    store, views = refreshed(spark, sf)
    return views.kept("services", store.pointer())


QUERIES = {
    "profile_sections": sections,
    "snapshot_written": written,
    "snapshot_project_io": asked_io,
    "snapshot_project_dependencies": asked_dependencies,
    "snapshot_project_profiles": asked_profiles,
    "snapshot_conflicts": current_conflicts,
    "view_edge_classes": view_edges,
    "view_conflict_counts": view_conflicts,
    "view_services": view_services,
}

_HITS = SERVICE_SQL.replace("hits AS", "service_hits AS")
_OWN_IO = IO_SQL.replace("hits AS", "io_hits AS")
_PARTS = f"""{TABLES_SQL}, {_HITS}, {_OWN_IO}, {SUMMARIES_SQL},
io AS (SELECT DISTINCT project_id, direction, category, description FROM io_hits),
svc AS (SELECT project_id, name, arg_min(kind, {_RANK} * 1000000000 + seq) AS kind, count(DISTINCT concat(path, ':', line)) AS n FROM service_hits GROUP BY 1, 2),
tabs_n AS (SELECT tabs.*, n FROM tabs JOIN (SELECT project_id, table_name, count(DISTINCT concat(path, ':', line)) AS n FROM hits GROUP BY 1, 2) USING (project_id, table_name)),
known AS (SELECT c_custkey AS project_id, c_name AS full_path, concat('sha', c_custkey) AS commit_sha FROM customer)"""
_SIZES = f"""WITH {_PARTS} SELECT known.*, purpose_summary,
  (SELECT count(*) FROM io WHERE io.project_id = known.project_id AND direction = 'in') AS n_abstract_inputs,
  (SELECT count(*) FROM io WHERE io.project_id = known.project_id AND direction = 'out') AS n_abstract_outputs,
  (SELECT count(*) FROM svc WHERE svc.project_id = known.project_id) AS n_services,
  (SELECT count(*) FROM tabs WHERE tabs.project_id = known.project_id) AS n_tables
FROM known LEFT JOIN (SELECT project_id, purpose_summary FROM summaries) s USING (project_id)"""
_ASKED = "project_id IN (SELECT n_nationkey FROM nation) AND project_id IN (SELECT c_custkey FROM customer)"
_KNOWN_CONFLICTS = f"SELECT * FROM ({CONFLICTS_SQL}) WHERE project_id_a IN (SELECT c_custkey FROM customer) AND project_id_b IN (SELECT c_custkey FROM customer)"

ORACLE = {
    "profile_sections": f"""WITH {TABLES_SQL}, {_HITS}, {_OWN_IO},
lost AS (SELECT p_partkey % 50 AS project_id, concat(CASE WHEN p_partkey % 3 = 0 THEN 'cmd/x/' ELSE 'pkg/' END, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END, 'main.go') AS path,
  p_brand AS reason, unnest(['purpose', 'abstract_io', 'external_services', 'database_tables']) AS part, unnest([0, 1, 2, 3]) AS n FROM part),
every AS (SELECT project_id, CASE direction WHEN 'in' THEN 'inputs' ELSE 'outputs' END AS section, min(seq) AS a, '' AS b, category AS name, description AS detail FROM io_hits GROUP BY ALL
UNION ALL SELECT project_id, 'services', 0, name, name, arg_min(kind, {_RANK} * 1000000000 + seq) FROM service_hits GROUP BY project_id, name
UNION ALL SELECT project_id, 'tables', 0, table_name, table_name, access_mode FROM tabs
UNION ALL SELECT project_id, 'degraded', n, path, part, concat(path, ' (', reason, ')') FROM lost WHERE part <> 'purpose' OR regexp_matches(path, '^([^/]+\\.go|cmd/main\\.go|cmd/[^/]+/main\\.go)$'))
SELECT project_id, section, row_number() OVER (PARTITION BY project_id, section ORDER BY a, b, name, detail) AS no, name, detail FROM every""",
    "snapshot_written": _SIZES,
    "snapshot_project_io": f"WITH {_PARTS} SELECT * FROM io WHERE {_ASKED}",
    "snapshot_project_dependencies": f"""WITH {_PARTS} SELECT project_id, 'services' AS section, name, kind, n AS n_places FROM svc WHERE {_ASKED}
UNION ALL SELECT project_id, 'tables', table_name, access_mode, n FROM tabs_n WHERE {_ASKED}""",
    "snapshot_project_profiles": f"SELECT * FROM ({_SIZES}) WHERE {_ASKED}",
    "snapshot_conflicts": _KNOWN_CONFLICTS,
    "view_edge_classes": f"""WITH {_PARTS}, c AS (SELECT * FROM tabs WHERE project_id IN (SELECT c_custkey FROM customer)),
e AS (SELECT a.table_name, count(*) AS n_edges, count(*) FILTER ('unknown' IN (a.access_mode, b.access_mode)) AS n_unknown_edges
  FROM c a JOIN c b ON a.table_name = b.table_name AND a.project_id < b.project_id GROUP BY 1)
SELECT table_name, count(*) AS n_projects, count(*) FILTER (access_mode = 'unknown') AS n_unknown, n_edges, n_unknown_edges FROM c JOIN e USING (table_name) GROUP BY ALL""",
    "view_conflict_counts": f"SELECT * EXCLUDE (representative) FROM ({CUSTOMER_CONFLICT_COUNTS_SQL})",
    "view_services": f"WITH {_PARTS} SELECT project_id, name, kind FROM svc WHERE project_id IN (SELECT c_custkey FROM customer)",
}
