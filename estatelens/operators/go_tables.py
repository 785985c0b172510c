"""Tables and procedures named in the SQL literals of Go repository files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens import rules
from estatelens.functions.identifiers import accept_proc, accept_table, clean_ident_schema
from estatelens.functions.patterns import regex_hits
from estatelens.operators.tables import N_WRITES, SQL_AT, drop_covered_reads, sql_rules
from estatelens.sources.admission import is_go_source

LITERAL_KEY = ["project_id", "path", "lit_no"]


def is_repository_file(path: Column) -> Column:
    return is_go_source(path) & path.rlike(r"\Ainternal/repository/[^/]*_repos?\.go\z")


def go_sql_literals(files: DataFrame) -> DataFrame:
    """One row per string literal of a repository file, format schemas off."""
    return (
        files.filter(is_repository_file(F.col("path")))
        .select(
            "project_id",
            "path",
            F.posexplode(F.regexp_extract_all("content", F.lit(rules.GO_LITERAL), F.lit(0))).alias("lit_no", "literal"),
        )
        .withColumn("literal", F.substring(F.col("literal"), F.lit(2), F.length("literal") - 2))
        .filter(~F.col("literal").contains(rules.GO_SKIPPED_PHRASE))
        .withColumn("literal", F.regexp_replace("literal", rules.GO_FORMAT_SCHEMA, ""))
    )


def _rows(df: DataFrame, name: Column, mode: Column, step: int, sub: Column, pos: Column) -> DataFrame:
    seq = F.struct(
        F.col("path").alias("path"),
        F.col("lit_no").cast("int").alias("lit_no"),
        F.lit(step).alias("step"),
        sub.cast("int").alias("sub"),
        pos.cast("int").alias("pos"),
    )
    return df.select(
        "project_id", name.alias("table_name"), mode.alias("access_mode"), "path", F.lit(None).cast("int").alias("line"), seq.alias("seq")
    )


def proc_hits(literals: DataFrame) -> DataFrame:
    """Procedures called in a block or by CALL, access unknown."""

    def called(n: int, word: str) -> Column:
        names = F.regexp_extract_all("literal", F.lit(rf"(?iU)\b{word}{rules.GO_PROCEDURE}"), F.lit(1))
        return F.transform(names, lambda m, i: F.struct(F.lit(n).alias("sub"), i.alias("pos"), m.alias("name")))

    found = F.concat(called(0, "BEGIN"), called(1, "CALL"))
    return _rows(
        literals.withColumn("f", F.explode(found)).filter(accept_proc(F.col("f.name"))),
        F.col("f.name"),
        F.lit("unknown"),
        0,
        F.col("f.sub"),
        F.col("f.pos"),
    )


def sql_refs_schema(literals: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Table references of bare SQL texts, schema kept, no import rule."""
    key = key or LITERAL_KEY
    found = regex_hits(literals, sql_rules(), "literal", key).withColumn("rule", F.col("rule") - SQL_AT)
    hits = drop_covered_reads(found, key)
    return hits.select(
        *key,
        clean_ident_schema(F.col("g1")).alias("table_name"),
        F.when(F.col("rule") < N_WRITES, "write").otherwise("read").alias("access_mode"),
        "rule",
        "start",
    )


def go_table_hits(files: DataFrame) -> DataFrame:
    """Procedures and accepted tables; the location has no line."""
    literals = go_sql_literals(files)
    refs = sql_refs_schema(literals).filter(accept_table(F.col("table_name")))
    tables = _rows(refs, F.col("table_name"), F.col("access_mode"), 1, F.col("rule"), F.col("start"))
    return proc_hits(literals).unionByName(tables)
