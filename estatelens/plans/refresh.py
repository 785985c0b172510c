"""The whole analysis: landed projects and files to profiles, in one job graph."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.operators import coalesce as co
from estatelens.operators.go_services import go_service_hits
from estatelens.operators.go_sites import (
    go_call_sites,
    go_io,
    go_skips,
    gomod_candidates,
    package_doc_candidate,
)
from estatelens.operators.go_tables import go_table_hits
from estatelens.operators.io_regex import java_io, js_io, yaml_cron
from estatelens.operators.manifests import manifest_candidate, manifest_cli, manifest_facts
from estatelens.operators.profiles import build_profiles, degraded_sections
from estatelens.operators.purpose import description_candidate, docstring_candidate, pick_purpose, readme_candidate
from estatelens.operators.python_sites import python_call_sites, python_io
from estatelens.operators.services import client_rules, service_hits
from estatelens.operators.tables import all_rules, scan, table_hits
from estatelens.session import COMPILED_METHODS, settings, stored
from estatelens.sources.admission import admit, cap_files, drop_vendored_go, family, with_shape
from estatelens.sources.landing import pin_files, with_branch


@dataclass
class Split:
    """Admitted files by project shape; ``laid_out`` files carry a ``family`` partition."""

    everything: DataFrame
    go: DataFrame
    other: DataFrame
    laid_out: bool = False

    def of(self, files: DataFrame, *families: str) -> DataFrame:
        """The files of some families: partition pruning where they are laid out."""
        return files.filter(F.col("family").isin(*families, *(f"readme_{f}" for f in families))) if self.laid_out else files

    def readmes(self, files: DataFrame) -> DataFrame:
        """The files that may be root READMEs."""
        return files.filter(F.col("family").startswith("readme_")) if self.laid_out else files


def admitted_files(files: DataFrame, projects: DataFrame, cap: int | None = None) -> DataFrame:
    """S3, S6 and, where the caller sets a ``cap`` of files per project, S8: files at the analysed commit that are worth reading."""
    kept = admit(pin_files(files, projects))
    return kept if cap is None else cap_files(kept, cap)


def by_shape(files: DataFrame) -> Split:
    """Go projects and others apart."""
    shaped = with_shape(files)
    go = shaped.filter("has_go").drop("has_go")
    other = drop_vendored_go(shaped.filter("NOT has_go").drop("has_go"))
    return Split(files, go, other)


def lay_out(files: DataFrame) -> Split:
    """:func:`by_shape` on files written once, partitioned by shape and family.

    Each extraction then reads its own partitions and not the whole landing.
    """
    # The rules for paths make a method that the JVM runs uncompiled, unless Spark may split it.
    with settings(files.sparkSession, COMPILED_METHODS):
        kept = stored(with_shape(files).withColumn("family", family(F.col("path"))), ["has_go", "family"])
    go = kept.filter("has_go").drop("has_go")
    other = drop_vendored_go(kept.filter("NOT has_go").drop("has_go"))
    return Split(kept.drop("has_go"), go, other, True)


def text_hits(files: DataFrame) -> DataFrame:
    """All positional rules of the general branch in one pass over the texts, stored."""
    return stored(scan(files, [*client_rules(), *all_rules()]))


def profile_services(split: Split, hits: DataFrame | None = None) -> DataFrame:
    """E19 for services: (project, name, kind, locations, order_key)."""
    none = F.struct(F.lit(0).alias("step"), F.lit("").alias("path"), F.lit(0).alias("sub"), F.lit(0).alias("pos"))
    general = co.services_with_locations(co.by_project(service_hits(split.other, hits))).drop("first_seq").withColumn(
        "order_key", F.struct(none.alias("first"), F.col("name").alias("name"))
    )
    go = co.services_with_locations(co.by_project(go_service_hits(split.of(split.go, "go"))), first_kind=True).select(
        "project_id",
        "name",
        "kind",
        "source_locations",
        F.struct(F.col("first_seq").alias("first"), F.col("name").alias("name")).alias("order_key"),
    )
    return general.unionByName(go)


def profile_tables(split: Split, hits: DataFrame | None = None) -> DataFrame:
    """E19 for tables: (project, table, mode, locations, order_key)."""
    general = co.tables_with_locations(co.by_project(table_hits(split.other, hits)))
    go = co.tables_with_locations(co.by_project(go_table_hits(split.of(split.go, "go"))))
    return general.unionByName(go).withColumn("order_key", F.col("table_name"))


@dataclass
class Parsed:
    """Rows that more than one section reads."""

    python: DataFrame
    facts: DataFrame


def parse(split: Split, keep: bool = False) -> Parsed:
    """Python sites and manifest facts; kept in storage when several sections read them."""
    general = drop_vendored_go(split.everything)
    python = python_call_sites(split.of(general, "python"))
    facts = manifest_facts(split.of(general, "manifest"))
    return Parsed(stored(python), stored(facts)) if keep else Parsed(python, facts)


def io_hits(split: Split, parsed: Parsed | None = None, go_sites: DataFrame | None = None) -> DataFrame:
    """General rules over all files but vendored Go ones, Go rules over Go projects."""
    general = drop_vendored_go(split.everything)
    parsed = parsed or parse(split, keep=True)
    go_files = split.of(split.go, "go", "manifest")
    sites = stored(go_call_sites(split.of(split.go, "go"))) if go_sites is None else go_sites
    parts = [
        js_io(split.of(general, "script")),
        java_io(split.of(general, "java")),
        yaml_cron(split.of(general, "yaml")),
        python_io(parsed.python),
        manifest_cli(parsed.facts),
        go_io(go_files, sites),
    ]
    return reduce(DataFrame.unionByName, parts)


def purpose_candidates(projects: DataFrame, split: Split, parsed: Parsed | None = None) -> DataFrame:
    """P1 to P6."""
    general = drop_vendored_go(split.everything)
    parsed = parsed or parse(split)
    parts = [
        readme_candidate(split.readmes(general)),
        description_candidate(projects),
        manifest_candidate(parsed.facts),
        docstring_candidate(split.of(general, "script"), parsed.python),
        gomod_candidates(split.of(split.go, "manifest")),
        package_doc_candidate(split.of(split.go, "go")),
    ]
    return reduce(DataFrame.unionByName, parts)


def analyze(projects: DataFrame, files: DataFrame) -> DataFrame:
    """Profiles of all projects whose branch exists.

    Files are laid out once; the positional rules, the Python trees, the Go
    sites and the manifests are each read once and shared by the sections.
    """
    # Rules for hosts, paths and calls make methods that the JVM would run uncompiled.
    with settings(files.sparkSession, COMPILED_METHODS):
        return _analyzed(projects, files)


def _analyzed(projects: DataFrame, files: DataFrame) -> DataFrame:
    ready = with_branch(projects)
    split = lay_out(admitted_files(files, ready))
    hits = text_hits(split.other)
    parsed = parse(split, keep=True)
    sites = stored(go_call_sites(split.of(split.go, "go")))
    # Each section is a job of its own: small plans, and a lost stage repeats one section only.
    return build_profiles(
        ready,
        stored(pick_purpose(ready, purpose_candidates(ready, split, parsed))),
        stored(co.dedup_io(io_hits(split, parsed, sites))),
        stored(profile_services(split, hits)),
        stored(profile_tables(split, hits)),
        degraded_sections(go_skips(split.of(split.go, "go"))),
    )
