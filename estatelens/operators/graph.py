"""The dependency graph: projects joined by the tables they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens import rules
from estatelens.operators.pairs import BLOCK, shared_key_pairs


def profiles_in_scope(profiles: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows of projects outside the catalog are ignored."""
    return profiles.join(catalog.select("project_id"), "project_id", "left_semi")


def shared_table_edges(tables: DataFrame, catalog: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One edge per unordered project pair and table name both use.

    ``tables`` has one row per (project, table). A name used by very many
    projects is joined in blocks, see :mod:`estatelens.operators.pairs`.
    """
    if catalog is not None:
        tables = profiles_in_scope(tables, catalog)
    pairs = shared_key_pairs(tables, ["table_name"], "project_id", ["access_mode"], block)
    unknown = (F.col("a_access_mode") == "unknown") | (F.col("b_access_mode") == "unknown")
    return pairs.select(
        F.col("a_project_id").alias("project_id_a"),
        F.col("b_project_id").alias("project_id_b"),
        "table_name",
        F.when(unknown, _label(F.col("table_name"), True)).otherwise(_label(F.col("table_name"), False)).alias("label"),
    )


def shared_table_edge_digest(edges: DataFrame) -> DataFrame:
    """J1 per project pair: the number of its edges and a sum over hashes of all of them, whatever their order."""
    code = _edge_code(F.col("table_name"), F.col("label"))
    return edges.groupBy("project_id_a", "project_id_b").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(code).alias("edges_hash"))


def _label(table: Column, unknown: bool) -> Column:
    return F.concat(F.lit("shared table: "), table, F.lit(rules.UNKNOWN_ACCESS_SUFFIX if unknown else ""))


def _edge_code(table: Column, label: Column) -> Column:
    """A number for an edge's name and label, for sums that do not depend on order."""
    return F.conv(F.substring(F.md5(F.concat(table, F.lit("|"), label)), 1, 8), 16, 10).cast("long")


def edge_classes(tables: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """J1 factorised: each shared table as one row that stands for the edges between all its projects.

    n_projects, n_unknown of them with unknown access, n_edges and how many of
    these are labelled so. With the rows of ``tables`` it says all that
    :func:`shared_table_edges` lists; a hub of k projects is one row and k
    members, never k(k-1)/2 pairs.
    """
    if catalog is not None:
        tables = profiles_in_scope(tables, catalog)
    return classes_of_counts(table_counts(tables))


def table_counts(tables: DataFrame) -> DataFrame:
    """How many projects use a table, and how many of them with unknown access."""
    return tables.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_projects"), F.count(F.when(F.col("access_mode") == "unknown", 1)).alias("n_unknown")
    )


def classes_of_counts(counts: DataFrame) -> DataFrame:
    """The class rows of :func:`edge_classes` from :func:`table_counts`."""
    known = F.col("n_projects") - F.col("n_unknown")
    return (
        counts.filter(F.col("n_projects") > 1)
        .withColumn("n_edges", F.expr("n_projects * (n_projects - 1) div 2"))
        .withColumn("n_unknown_edges", F.col("n_edges") - (known * (known - 1) / 2).cast("long"))
    )


def project_edges(tables: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """J1 per project, without pairs: its shared tables, its edges, those of unknown access, and a digest of all their names and labels.

    A project's edges of one table are told by the table's class row alone: an
    unknown access marks all of them, another only those to unknown ones.
    """
    if catalog is not None:
        tables = profiles_in_scope(tables, catalog)
    own = tables.join(edge_classes(tables).select("table_name", "n_projects", "n_unknown"), "table_name")
    marked = F.when(F.col("access_mode") == "unknown", F.col("n_projects") - 1).otherwise(F.col("n_unknown"))
    plain = F.col("n_projects") - 1 - F.col("marked")
    name = F.col("table_name")
    code = sum(
        (n.cast("decimal(20,0)") * _edge_code(name, _label(name, unknown)).cast("decimal(10,0)") for n, unknown in ((plain, False), (F.col("marked"), True))),
        start=F.lit(0).cast("decimal(1,0)"),
    )
    return (
        own.withColumn("marked", marked)
        .groupBy("project_id")
        .agg(
            F.count(F.lit(1)).alias("n_tables"),
            F.sum(F.col("n_projects") - 1).alias("n_edges"),
            F.sum("marked").alias("n_unknown_edges"),
            (F.sum(code.cast("decimal(33,0)")) % F.lit(10**15)).cast("long").alias("edges_hash"),
        )
    )


def edges_of(tables: DataFrame, asked: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """J1 for the projects asked for (``project_id``): the edges that touch one of them, each once."""
    if catalog is not None:
        tables = profiles_in_scope(tables, catalog)
    flag = asked.select("project_id").distinct().withColumn("asked", F.lit(True))
    members = tables.select("table_name", "project_id", "access_mode").join(flag, "project_id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    mine = members.filter("asked").select("table_name", F.col("project_id").alias("p"), F.col("access_mode").alias("pm"))
    other = members.select("table_name", F.col("project_id").alias("q"), F.col("access_mode").alias("qm"), F.col("asked").alias("both"))
    met = mine.join(other, "table_name").filter(F.when(F.col("both"), F.col("p") < F.col("q")).otherwise(F.col("p") != F.col("q")))
    unknown = (F.col("pm") == "unknown") | (F.col("qm") == "unknown")
    name = F.col("table_name")
    return met.select(
        F.least("p", "q").alias("project_id_a"),
        F.greatest("p", "q").alias("project_id_b"),
        "table_name",
        F.when(unknown, _label(name, True)).otherwise(_label(name, False)).alias("label"),
    )


def hub_tables(tables: DataFrame) -> DataFrame:
    """J1 at a glance: projects and edges per shared table, without making the pairs."""
    n = F.count(F.lit(1))
    return (
        tables.groupBy("table_name")
        .agg(n.alias("n_projects"))
        .filter(F.col("n_projects") > 1)
        .withColumn("n_edges", (F.col("n_projects") * (F.col("n_projects") - 1) / 2).cast("long"))
    )


def connected_projects(tables: DataFrame) -> DataFrame:
    """Ids of projects with an edge: those on a table that two projects use.

    This needs the table sizes only, never the pairs.
    """
    shared = (
        tables.groupBy("table_name")
        .agg(F.min("project_id").alias("lo"), F.max("project_id").alias("hi"))
        .filter(F.col("lo") < F.col("hi"))
        .select("table_name")
    )
    return tables.join(shared, "table_name", "left_semi").select("project_id").distinct()


def graph_nodes(catalog: DataFrame, tables: DataFrame) -> DataFrame:
    """Catalog projects on at least one edge, labelled, by id."""
    on_edge = connected_projects(profiles_in_scope(tables, catalog))
    return (
        catalog.join(on_edge, "project_id", "left_semi")
        .select("project_id", F.concat_ws(" ", F.col("project_id").cast("string"), F.col("full_path")).alias("label"))
        .orderBy("project_id")
    )


def graph_state(catalog: DataFrame, tables: DataFrame) -> DataFrame:
    """One row saying whether the catalog is empty, nothing is shared, or there are edges."""
    scoped = profiles_in_scope(tables, catalog)
    projects = catalog.agg(F.count(F.lit(1)).alias("n_projects"))
    edges = hub_tables(scoped).agg(F.coalesce(F.sum("n_edges"), F.lit(0)).alias("n_edges"))
    state = (
        F.when(F.col("n_projects") == 0, "empty_catalog")
        .when(F.col("n_edges") == 0, "no_shared_dependencies")
        .otherwise("edges")
    )
    counts = projects.select("n_projects", F.lit(0).cast("long").alias("n_edges")).unionByName(
        edges.select(F.lit(0).cast("long").alias("n_projects"), "n_edges")
    )
    totals = counts.agg(F.sum("n_projects").alias("n_projects"), F.sum("n_edges").alias("n_edges"))
    return totals.select(state.alias("state"), "n_projects", "n_edges")
