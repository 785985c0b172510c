"""What a project is for: candidates by source, the best one wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens import rules
from estatelens.functions.text import WS, collapse_ws, strip_ws, truncate_words

BLANK = rf"\A{WS}*\z"
HEADING = r"(?U)\A\s{0,3}#{1,6}\s"
UNDERLINE = r"(?U)\A\s{0,3}(=+|-+)\s*\z"
BADGES = r"(?U)\A\s*(?:\[!\[[^\]]*\]\([^)]*\)\]\([^)]*\)\s*)+\z"
CANDIDATE = ["project_id", "source", "priority", "path", "text"]


def readme_prose(content: Column) -> Column:
    """First paragraph with prose, its lines joined; null without any."""
    paragraphs = F.split(content, r"(?U)\n\s*\n", -1)

    def lines_of(p: Column) -> Column:
        return F.filter(F.split(p, "\n", -1), lambda s: ~s.rlike(BLANK))

    def kept(lines: Column) -> Column:
        titled = (F.size(lines) >= 2) & F.element_at(lines, -1).rlike(UNDERLINE)
        prose = F.filter(lines, lambda s: ~(s.rlike(HEADING) | s.rlike(UNDERLINE) | s.rlike(BADGES)))
        return F.when((F.size(lines) > 0) & ~titled, F.array_join(F.transform(prose, strip_ws), " "))

    joined = F.transform(F.transform(paragraphs, lines_of), kept)
    return F.get(F.filter(joined, lambda p: p.isNotNull() & (p != "")), F.lit(0))


def _first_by_path(rows: DataFrame, source: str, priority: int) -> DataFrame:
    return (
        rows.filter(F.col("text").isNotNull() & (F.col("text") != ""))
        .groupBy("project_id")
        .agg(F.min_by(F.struct("path", "text"), "path").alias("x"))
        .select("project_id", F.lit(source).alias("source"), F.lit(priority).alias("priority"), "x.path", "x.text")
    )


def readme_candidate(files: DataFrame) -> DataFrame:
    """P1 over root READMEs, the first by path with prose (priority 1)."""
    root = files.filter(~F.col("path").rlike(r"[/\\]") & F.upper("path").startswith("README"))
    return _first_by_path(root.select("project_id", "path", readme_prose(F.col("content")).alias("text")), "readme", 1)


def description_candidate(projects: DataFrame) -> DataFrame:
    """The project's own description (priority 2)."""
    return projects.select(
        "project_id",
        F.lit("description").alias("source"),
        F.lit(2).alias("priority"),
        F.lit("").alias("path"),
        collapse_ws("description").alias("text"),
    ).filter(F.col("text").isNotNull())


def js_leading_comment(content: Column) -> Column:
    """The block comment a script starts with, stars off, as one line."""
    body = F.regexp_extract(content, r"(?sU)\A\s*/\*+(.*?)\*+/", 1)
    lines = F.transform(
        F.split(body, "\n", -1),
        lambda s: F.when(strip_ws(s).startswith("*"), strip_ws(F.substring(strip_ws(s), 2, 1 << 30))).otherwise(strip_ws(s)),
    )
    return F.nullif(F.array_join(F.filter(lines, lambda s: s != ""), " "), F.lit(""))


def is_docstring_path(path: Column) -> Column:
    return path.rlike(r"\A(?:[^/\\]+\.py|src/[^/]*/__init__\.py)\z")


def docstring_candidate(files: DataFrame, sites: DataFrame) -> DataFrame:
    """Module docstring or leading script comment, the first by path (priority 6)."""
    py = sites.filter((F.col("kind") == "docstring") & is_docstring_path(F.col("path"))).select(
        "project_id", "path", collapse_ws("text").alias("text")
    )
    js = files.filter(F.col("path").rlike(r"\A[^/\\]+\.(?:js|mjs|cjs|ts)\z")).select(
        "project_id", "path", js_leading_comment(F.col("content")).alias("text")
    )
    return _first_by_path(py.unionByName(js), "module_docstring", 6)


def pick_purpose(projects: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidate of lowest priority, cut to length; unknown with a reason otherwise."""
    best = candidates.groupBy("project_id").agg(F.min_by("text", F.struct("priority", "path")).alias("text"))
    return projects.select("project_id").join(best, "project_id", "left").select(
        "project_id",
        F.coalesce(truncate_words("text"), F.lit(rules.UNKNOWN_SUMMARY)).alias("purpose_summary"),
        F.when(F.col("text").isNull(), rules.NO_MATERIAL).alias("purpose_summary_reason"),
    )
