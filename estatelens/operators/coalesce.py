"""Hits to one row per thing.

Every aggregate here merges partial results before its shuffle, so a project or
a thing that holds a large share of all hits costs one row per map task. The
flat location tables keep each location as a row of its own; the nested form is
only built for profiles, whose files are bounded by admission.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens import rules


def kind_rank(kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(99))
    for name, rank in rules.KIND_RANK.items():
        out = out.when(kind == name, F.lit(rank))
    return out.otherwise(F.lit(99))


def coalesce_services(hits: DataFrame) -> DataFrame:
    """A1: one row per (project, name) with the most specific kind, first seen among equals."""
    order = F.struct(kind_rank(F.col("kind")).alias("rank"), F.col("seq"))
    return hits.groupBy("project_id", "name").agg(F.min_by("kind", order).alias("kind"))


def coalesce_services_first(hits: DataFrame) -> DataFrame:
    """A2: one row per (project, name) with the first hit's kind and its place ``first_seq``."""
    return hits.groupBy("project_id", "name").agg(
        F.min_by("kind", "seq").alias("kind"), F.min("seq").alias("first_seq")
    )


def mode_lattice(mode: Column) -> Column:
    """A3: read_write if seen or both seen, else write, read, unknown."""

    def seen(m: str) -> Column:
        return F.coalesce(F.bool_or(mode == m), F.lit(False))

    return (
        F.when(seen("read_write") | (seen("read") & seen("write")), "read_write")
        .when(seen("write"), "write")
        .when(seen("read"), "read")
        .otherwise("unknown")
    )


def coalesce_tables(hits: DataFrame) -> DataFrame:
    """A3: one row per (project, table) with the joined access mode; empty names dropped."""
    return (
        hits.filter(F.col("table_name") != "")
        .groupBy("project_id", "table_name")
        .agg(mode_lattice(F.col("access_mode")).alias("access_mode"))
    )


def locations(hits: DataFrame, name: str) -> DataFrame:
    """Distinct (path, line) of each thing as rows, with the first place ``seq`` seen."""
    return hits.filter(F.col(name) != "").groupBy("project_id", name, "path", "line").agg(F.min("seq").alias("seq"))


def _nested(by_path: bool) -> Column:
    """Array of locations: by (path, line), or in discovery order."""
    place = F.struct("path", "line")
    if by_path:
        return F.sort_array(F.collect_list(place))
    ordered = F.sort_array(F.collect_list(F.struct(F.col("seq"), place.alias("at"))))
    return F.transform(ordered, lambda x: x["at"])


def nest_locations(flat: DataFrame, name: str, by_path: bool) -> DataFrame:
    """Array of locations per thing.

    For profile assembly only: one array per thing of a project.
    """
    return flat.groupBy("project_id", name).agg(_nested(by_path).alias("source_locations"))


def services_with_locations(hits: DataFrame, first_kind: bool = False) -> DataFrame:
    """A1 (or A2 with ``first_kind``) and the locations, from one pass over the hits.

    By path, a set of places is all that is needed; in discovery order (A2)
    locations are made distinct first, keeping the best (rank, place, kind) of each.
    """
    rank = F.lit(0) if first_kind else kind_rank(F.col("kind"))
    best = F.min(F.struct(rank.alias("rank"), F.col("seq").alias("seq"), F.col("kind").alias("kind")))
    if not first_kind:
        places = F.sort_array(F.collect_set(F.struct("path", "line")))
        return hits.groupBy("project_id", "name").agg(best["kind"].alias("kind"), F.min("seq").alias("first_seq"), places.alias("source_locations"))
    flat = hits.groupBy("project_id", "name", "path", "line").agg(F.min("seq").alias("seq"), best.alias("best"))
    return (
        flat.groupBy("project_id", "name")
        .agg(
            F.min("best")["kind"].alias("kind"),
            F.min("seq").alias("first_seq"),
            _nested(False).alias("source_locations"),
        )
    )


def tables_with_locations(hits: DataFrame) -> DataFrame:
    """A3 and the locations in discovery order, from one pass over the hits.

    Modes add up as bits (read 1, write 2), which a hash aggregate sums without a set per location.
    """
    mode = F.col("access_mode")
    bits = F.when(mode == "read_write", 3).when(mode == "write", 2).when(mode == "read", 1).otherwise(0)
    flat = (
        hits.filter(F.col("table_name") != "")
        .groupBy("project_id", "table_name", "path", "line")
        .agg(F.min("seq").alias("seq"), F.bit_or(bits).alias("modes"))
    )
    modes = F.bit_or("modes")
    return flat.groupBy("project_id", "table_name").agg(
        F.when(modes == 3, "read_write").when(modes == 2, "write").when(modes == 1, "read").otherwise("unknown").alias("access_mode"),
        _nested(False).alias("source_locations"),
    )


def by_project(hits: DataFrame) -> DataFrame:
    """Hits laid together by project, for profile assembly only.

    What follows groups them by more columns, by thing and by project without
    another shuffle; a profile is one row, so its hits meet in one task anyway.
    """
    return hits.repartition("project_id")


def dedup_io(hits: DataFrame) -> DataFrame:
    """A4: distinct (direction, category, description) with the first place seen."""
    return hits.groupBy("project_id", "direction", "category", "description").agg(F.min("seq").alias("seq"))


def ordinal(value: Column, order: list[str]) -> Column:
    """Position in a canonical order, from 0."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), value).cast("int") - 1


def group_report(items: DataFrame, section: str, group: str, label: str, order: list[str]) -> DataFrame:
    """Items under their group in canonical group order, empty groups left out.

    Tables of unknown access carry the suffix on their label. The result is
    ordered by project, group and label; the sort is a range shuffle.
    """
    return ordered_report([report_rows(items, section, group, label, order)])


def ordered_report(sections: list[DataFrame]) -> DataFrame:
    """A7 of several sections, sorted once: by project, section, group and label."""
    return reduce(DataFrame.unionByName, sections).orderBy("project_id", "section", "group_no", "item")


def report_rows(items: DataFrame, section: str, group: str, label: str, order: list[str]) -> DataFrame:
    """The rows of one section, in no order."""
    shown = F.col(label)
    if section == "tables":
        shown = F.when(F.col(group) == "unknown", F.concat(shown, F.lit(rules.UNKNOWN_ACCESS_SUFFIX))).otherwise(shown)
    return items.select(
        "project_id",
        F.lit(section).alias("section"),
        ordinal(F.col(group), order).alias("group_no"),
        F.col(group).alias("group_name"),
        F.col(label).alias("item"),
        shown.alias("label"),
    )


def refresh_counts(projects: DataFrame, files: DataFrame) -> DataFrame:
    """Per project, whether a profile is written or the project skipped, and its files."""
    n_files = files.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_files"))
    return projects.join(n_files, "project_id", "left").select(
        "project_id",
        F.when(F.col("commit_sha").isNull(), "skipped").otherwise("profiled").alias("outcome"),
        F.when(F.col("commit_sha").isNull(), F.lit(0)).otherwise(F.coalesce("n_files", F.lit(0))).cast("long").alias("n_files"),
    )


def refresh_totals(counts: DataFrame) -> DataFrame:
    """The totals of one refresh."""
    return counts.agg(
        F.sum(F.when(F.col("outcome") == "profiled", 1).otherwise(0)).alias("profiles_written"),
        F.sum(F.when(F.col("outcome") == "skipped", 1).otherwise(0)).alias("skipped"),
        F.sum("n_files").alias("files"),
    )


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
