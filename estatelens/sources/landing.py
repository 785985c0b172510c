"""Readers for landed projects and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens import rules
from estatelens.schemas import FILES, PROJECTS
from estatelens.session import small_side


def clean_projects(projects: DataFrame) -> DataFrame:
    """An empty description counts as none."""
    return projects.withColumn("description", F.nullif(F.col("description"), F.lit("")))


def read_projects(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed projects, ordered by id."""
    return clean_projects(spark.read.schema(PROJECTS).format(fmt).load(path)).orderBy("project_id")


def read_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(FILES).format(fmt).load(path)


def missing_branch(projects: DataFrame) -> DataFrame:
    """One skip row for each project whose analysed branch is absent."""
    return projects.filter(F.col("commit_sha").isNull()).select(
        "project_id",
        F.lit(rules.BRANCH_MISSING).alias("reason"),
        F.format_string("branch '%s' missing on project %d", "branch", "project_id").alias("detail"),
    )


def with_branch(projects: DataFrame) -> DataFrame:
    """The projects that go on."""
    return projects.filter(F.col("commit_sha").isNotNull())


def pin_files(files: DataFrame, projects: DataFrame) -> DataFrame:
    """S3: only files at the analysed commit of their project.

    The project side is broadcast when its counted size allows it; otherwise
    adaptive execution splits a project that holds a large share of the files.
    """
    pins = small_side(with_branch(projects).select("project_id", "commit_sha"))
    return files.join(pins, ["project_id", "commit_sha"], "left_semi")


def text_only(binary_files: DataFrame, limit: int | None = None) -> DataFrame:
    """Bodies that are valid UTF-8, as text; only those up to ``limit`` bytes where the caller sets one."""
    small = binary_files if limit is None else binary_files.filter(F.length("content") <= limit)
    return (
        small.withColumn("content", F.try_validate_utf8(F.col("content").cast("string")))
        .filter(F.col("content").isNotNull())
    )


def read_tree(spark: SparkSession, path: str, project_id: int, commit_sha: str, glob: str = "*", limit: int | None = None) -> DataFrame:
    """A checked-out tree through Spark's binary file source."""
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
    )
    if limit is not None:
        raw = raw.filter(F.col("length") <= limit)
    inside = F.regexp_replace(F.col("path"), rf"\A(?:file:)?/*\Q{path.strip('/')}\E/+", "")
    return text_only(
        raw.select(
            F.lit(project_id).cast("long").alias("project_id"),
            F.lit(commit_sha).alias("commit_sha"),
            inside.alias("path"),
            "content",
        )
    )
