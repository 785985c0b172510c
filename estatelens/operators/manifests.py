"""Root manifests: command-line entries and descriptions."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.functions.text import collapse_ws, quoted
from estatelens.operators.io_rows import IO_COLS, hit, io_seq, text

FACTS = "project_id long, path string, fact string, pos int, value string"


def _table(data, *keys):
    for key in keys:
        data = data.get(key) if isinstance(data, dict) else None
    return data if isinstance(data, dict) else {}


def toml_facts(content: str) -> Iterator[tuple[str, int, str]]:
    """Script names in declaration order, and the two description fields."""
    try:
        data = tomllib.loads(content)
    except (tomllib.TOMLDecodeError, RecursionError):
        return
    places = [("project", "scripts"), ("project", "gui-scripts"), ("tool", "poetry", "scripts")]
    names = [n for p in places for n in _table(data, *p) if n]
    for pos, name in enumerate(dict.fromkeys(names)):
        yield "script", pos, name
    for pos, place in enumerate([("project",), ("tool", "poetry")]):
        value = _table(data, *place).get("description")
        if isinstance(value, str):
            yield "description", pos, value


def xml_facts(content: str) -> Iterator[tuple[str, int, str]]:
    """The first top-level description element."""
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError:
        return
    for child in root:
        if isinstance(child.tag, str) and child.tag.rsplit("}", 1)[-1] == "description":
            yield "description", 0, child.text or ""
            return


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for project_id, path, content in zip(batch["project_id"], batch["path"], batch["content"]):
            facts = toml_facts(content or "") if path == "pyproject.toml" else xml_facts(content or "")
            rows += [(project_id, path, *f) for f in facts]
        yield pd.DataFrame(rows, columns=["project_id", "path", "fact", "pos", "value"])


def toml_xml_facts(files: DataFrame) -> DataFrame:
    """Facts of the two manifests that need a parser Spark lacks: one small file per project each."""
    few = files.filter(F.col("path").isin("pyproject.toml", "pom.xml")).select("project_id", "path", "content")
    return few.mapInPandas(_scan, FACTS)


def package_facts(files: DataFrame) -> DataFrame:
    """Facts of ``package.json`` by Spark's JSON functions.

    The variant type tells strings from other values; key order comes from the text.
    """
    raw = F.from_json("content", "struct<name:variant,bin:variant,description:variant>")
    js = files.filter(F.col("path") == "package.json").select("project_id", "path", raw.alias("p"), "content")

    def string(c: str):
        v = F.col(f"p.{c}")
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

    bin_map = F.when(
        F.schema_of_variant("p.bin").startswith("OBJECT"), F.try_variant_get("p.bin", "$", "map<string,variant>")
    )
    single = F.nullif(string("bin"), F.lit(""))
    label = F.coalesce(F.nullif(string("name"), F.lit("")), single)
    declared = F.json_object_keys(F.get_json_object("content", "$.bin"))
    keys = F.filter(
        declared, lambda k: (k != "") & (F.schema_of_variant(F.try_element_at(F.col("bin_map"), k)) == "STRING")
    )
    js = js.withColumn("bin_map", bin_map)
    names = F.when(single.isNotNull(), F.array(label)).otherwise(keys)
    scripts = js.select("project_id", "path", F.lit("script").alias("fact"), F.posexplode(names).alias("pos", "value"))
    described = js.select(
        "project_id", "path", F.lit("description").alias("fact"), F.lit(0).alias("pos"), string("description").alias("value")
    ).filter(F.col("value").isNotNull())
    return scripts.unionByName(described)


def manifest_facts(files: DataFrame) -> DataFrame:
    return toml_xml_facts(files).unionByName(package_facts(files))


def manifest_cli(facts: DataFrame) -> DataFrame:
    """I8: declared command-line entries."""
    described = text("CLI entrypoint ", quoted("value"), " declared in ", F.col("path"))
    return (
        facts.filter(F.col("fact") == "script")
        .select("project_id", "path", hit("in", "cli_argument", described).alias("h"), io_seq(0, F.lit(0), F.col("pos")).alias("seq"))
        .select("project_id", "path", "h.*", "seq")
        .select(*IO_COLS)
    )


def manifest_candidate(facts: DataFrame) -> DataFrame:
    """The first non-empty manifest description, by manifest then field."""
    order = F.array(F.lit("package.json"), F.lit("pyproject.toml"), F.lit("pom.xml"))
    return (
        facts.filter(F.col("fact") == "description")
        .withColumn("text", collapse_ws("value"))
        .filter(F.col("text").isNotNull())
        .groupBy("project_id")
        .agg(F.min_by(F.struct("path", "text"), F.struct(F.array_position(order, F.col("path")), "pos")).alias("x"))
        .select("project_id", F.lit("manifest").alias("source"), F.lit(5).alias("priority"), "x.path", "x.text")
    )
