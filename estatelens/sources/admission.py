"""Which paths are read, and which of them each extraction looks at."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from estatelens import rules
from estatelens.functions.patterns import file_ext
from estatelens.session import small_side


def _slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def _in_folder(path: Column, names: list[str]) -> Column:
    """Whether a segment before the last is one of ``names``; one pattern, since a path is read anew by each condition of a filter."""
    return path.rlike(rf"(?:\A|[/\\])(?:{_any_of(names)})[/\\]")


def _any_of(texts: list[str]) -> str:
    return "|".join(rf"\Q{t}\E" for t in texts)


def _base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def admit_generic(path: Column) -> Column:
    """READMEs, manifests and source extensions outside ``vendor``."""
    name = _base(path)
    ext = F.when(name.contains("."), F.lower(F.concat(F.lit("."), F.substring_index(name, ".", -1)))).otherwise("")
    wanted = F.lower(name).startswith("readme") | name.isin(rules.MANIFEST_NAMES) | ext.isin(rules.SOURCE_EXTENSIONS)
    return (path != "") & wanted & ~_in_folder(path, ["vendor"])


def admit_go(path: Column) -> Column:
    """Go sources but tests, the root ``go.mod`` and READMEs."""
    name = _base(_slashed(path))
    source = name.endswith(".go") & ~name.endswith("_test.go")
    wanted = F.lower(name).startswith("readme") | (path == "go.mod") | source
    return (path != "") & wanted & ~_in_folder(path, ["vendor", "third_party"])


def with_go_mod(files: DataFrame) -> DataFrame:
    """Ids of projects with a root ``go.mod``; reads paths only."""
    return files.filter(F.col("path") == "go.mod").select("project_id").distinct()


def admit(files: DataFrame) -> DataFrame:
    """The Go rule for projects with a root ``go.mod``, else the generic one."""
    modules = small_side(with_go_mod(files).withColumn("_mod", F.lit(True)))
    rule = F.when(F.col("_mod"), admit_go(F.col("path"))).otherwise(admit_generic(F.col("path")))
    return files.join(modules, "project_id", "left").filter(rule).drop("_mod")


def cap_files(files: DataFrame, n: int, spread: int = 64) -> DataFrame:
    """The first ``n`` admitted paths of each project, by path.

    The limit is the caller's; no plan sets one by itself. Only projects over it need
    work: their ``n``-th path becomes a bound that the file table is filtered
    by, so file texts are never sorted or shuffled. A first pass per (project,
    slice of paths) keeps a huge project off a single task.
    """
    paths = files.select("project_id", "path")
    over = paths.groupBy("project_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > n).select("project_id")
    local = Window.partitionBy("project_id", "_slice").orderBy("path")
    whole = Window.partitionBy("project_id").orderBy("path")
    bounds = (
        paths.join(over, "project_id", "left_semi")
        .withColumn("_slice", F.pmod(F.xxhash64("path"), F.lit(spread)))
        .withColumn("_n", F.row_number().over(local))
        .filter(F.col("_n") <= n)
        .withColumn("_n", F.row_number().over(whole))
        .filter(F.col("_n") == n)
        .select("project_id", F.col("path").alias("_last"))
    )
    return (
        files.join(small_side(bounds), "project_id", "left")
        .filter(F.col("_last").isNull() | (F.col("path") <= F.col("_last")))
        .drop("_last")
    )


def is_go_source(path: Column) -> Column:
    return path.endswith(".go") & ~_in_folder(path, ["vendor"])


def _makes_go(path: Column) -> Column:
    return (path == "go.mod") | is_go_source(path)


def project_shape(files: DataFrame) -> DataFrame:
    """Per project, whether the loaded files make it a Go project."""
    return files.groupBy("project_id").agg(F.bool_or(_makes_go(F.col("path"))).alias("has_go"))


def with_shape(files: DataFrame) -> DataFrame:
    """S9 on each file: ``has_go`` of its project; only paths that can make a Go project are looked at."""
    go = files.filter(_makes_go(F.col("path"))).select("project_id").distinct().withColumn("has_go", F.lit(True))
    return files.filter(F.col("project_id").isNotNull()).join(small_side(go), "project_id", "left").withColumn("has_go", F.coalesce("has_go", F.lit(False)))


def drop_vendored_go(files: DataFrame) -> DataFrame:
    """Vendored Go sources go; other vendored files stay."""
    return files.filter(~F.col("path").endswith(".go") | is_go_source(F.col("path")))


def service_scannable(path: Column) -> Column:
    """Not a dependency, build or tool folder, lock file, document or asset."""
    name = _base(_slashed(path))
    bad = [
        _in_folder(path, rules.NO_SERVICE_FOLDERS),
        name.isin(rules.NO_SERVICE_NAMES),
        F.lower(name).rlike(rf"\A(?:{_any_of(rules.NO_SERVICE_PREFIXES)})|(?:{_any_of(rules.NO_SERVICE_EXTENSIONS)})\z"),
    ]
    return ~reduce(lambda a, b: a | b, bad)


def is_doc(path: Column) -> Column:
    """Documentation suffix in any case."""
    lower = F.lower(path)
    return reduce(lambda a, b: a | b, [lower.endswith(e) for e in rules.DOC_EXTENSIONS])


def family(path: Column) -> Column:
    """The kind of reader a path has, to lay files out for the extractions."""
    ext = file_ext(path)
    reader = (
        F.when(path.isin("package.json", "pyproject.toml", "pom.xml", "go.mod"), "manifest")
        .when(ext == ".py", "python")
        .when(ext.isin(rules.JS_EXTENSIONS), "script")
        .when(ext == ".java", "java")
        .when(ext.isin(".yml", ".yaml"), "yaml")
        .when(path.endswith(".go"), "go")
        .otherwise("other")
    )
    # A root README is read for its prose and by the reader of its extension.
    root_readme = F.upper(path).startswith("README") & ~path.rlike(r"[/\\\\]")
    return F.when(root_readme, F.concat(F.lit("readme_"), reader)).otherwise(reader)
