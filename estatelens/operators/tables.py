"""Database tables a project's files touch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from estatelens import rules
from estatelens.functions.identifiers import clean_ident
from estatelens.functions.patterns import FILE_KEY, Rule, regex_hits
from estatelens.sources.admission import is_doc

N_WRITES = len(rules.SQL_WRITES)
N_SQL = N_WRITES + len(rules.SQL_READS)
# Rule numbers of the families, so that one pass can serve them all.
SQL_AT, MIGRATIONS_AT, MODELS_AT, CALLS_AT = 100, 200, 300, 400
IMPORT_LINE = r"(?md)^[^\S\n]*from[^\S\n]+[\w.]+[^\S\n]+import\b"
# One character of an import line: its first, or the next one after the last match.
IMPORT_CHAR = r"(?md)(?:^(?=[^\S\n]*from[^\S\n]+[\w.]+[^\S\n]+import\b)|\G(?!^))[^\n]"


def sql_rules(view: str = "text") -> list[Rule]:
    """Write patterns then read patterns, in any case and any alphabet."""
    return [Rule(SQL_AT + n, "(?iU)" + p, view=view) for n, p in enumerate(rules.SQL_WRITES + rules.SQL_READS)]


def migration_rules() -> list[Rule]:
    """The last one, a rename, names two tables."""
    last = len(rules.MIGRATIONS) - 1
    return [
        Rule(MIGRATIONS_AT + n, "(?U)" + p, (1, 2) if n == last else (1,)) for n, p in enumerate(rules.MIGRATIONS)
    ]


def model_rules() -> list[Rule]:
    """Class lines, then the three ways to name a model's table."""
    named = [Rule(MODELS_AT + n, "(?U)" + p, (2,)) for n, p in enumerate(rules.MODEL_PATTERNS, start=1)]
    return [Rule(MODELS_AT, "(?mdU)" + rules.CLASS_PATTERN, (1, 2)), *named]


def call_rules() -> list[Rule]:
    """Query shapes with the class they name; the last one also names a method."""
    shapes = [Rule(CALLS_AT + n, "(?U)" + p, (1,)) for n, (p, _) in enumerate(rules.MODEL_QUERIES)]
    return [*shapes, Rule(CALLS_AT + len(shapes), "(?U)" + rules.MODEL_OBJECTS, (1, 2))]


def scan(files: DataFrame, rule_list: list[Rule]) -> DataFrame:
    """Matches with the view that SQL rules of source files read."""
    return regex_hits(files, rule_list, views={"sql": without_imports(F.col("content"))})


def _family(files: DataFrame, hits: DataFrame | None, rule_list: list[Rule]) -> DataFrame:
    """The family's matches numbered from 0: from a shared pass, or from a pass of its own."""
    base = rule_list[0].number
    if hits is None:
        hits = scan(files, rule_list)
    else:
        hits = hits.filter(F.col("rule").between(base, base + len(rule_list) - 1)).filter(~is_doc(F.col("path")))
    return hits.withColumn("rule", F.col("rule") - base)


def without_imports(content: Column) -> Column:
    """Import lines blanked in place, so offsets and lines stay as they are."""
    return F.when(content.rlike(IMPORT_LINE), F.regexp_replace(content, IMPORT_CHAR, "#")).otherwise(content)


def drop_covered_reads(hits: DataFrame, key: list[str]) -> DataFrame:
    """Reads that start inside a write of the same text go (interval anti join).

    A running maximum of write ends by start replaces the join: it needs the
    partitioning the hits already have.
    """
    before = (
        Window.partitionBy(*key)
        .orderBy("start", "rule")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    covered_to = F.max(F.when(F.col("rule") < N_WRITES, F.col("end"))).over(before)
    return (
        hits.withColumn("_covered_to", covered_to)
        .filter((F.col("rule") < N_WRITES) | F.col("_covered_to").isNull() | (F.col("_covered_to") <= F.col("start")))
        .drop("_covered_to")
    )


def sql_hits(files: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Statement targets (write) and FROM/JOIN sources (read)."""
    hits = _family(files, hits, sql_rules("sql"))
    return _table_rows(
        drop_covered_reads(hits, FILE_KEY),
        clean_ident(F.col("g1")),
        F.when(F.col("rule") < N_WRITES, "write").otherwise("read"),
        1,
        F.col("rule"),
        F.col("start"),
    )


def _table_rows(
    hits: DataFrame, name: Column, mode: Column, phase: int, sub: Column, pos: Column, ckey: Column | None = None
) -> DataFrame:
    seq = F.struct(
        F.lit(phase).alias("phase"),
        F.col("path").alias("path"),
        (F.lit("") if ckey is None else ckey).alias("owner"),
        sub.cast("int").alias("sub"),
        pos.cast("int").alias("pos"),
    )
    return hits.select(
        "project_id", name.alias("table_name"), mode.alias("access_mode"), "path", F.col("line").cast("int").alias("line"), seq.alias("seq")
    )


def migration_hits(files: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Migration calls; a rename writes the old and the new table."""
    hits = _family(files, hits, migration_rules())
    named = hits.withColumn(
        "n",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit(0).alias("k"), F.col("g1").alias("t")),
                    F.when(
                        F.col("rule") == len(rules.MIGRATIONS) - 1, F.struct(F.lit(1).alias("k"), F.col("g2").alias("t"))
                    ),
                ),
                lambda x: x.isNotNull(),
            )
        ),
    )
    return _table_rows(
        named, clean_ident(F.col("n.t")), F.lit("write"), 1, F.lit(N_SQL) + F.col("rule"), F.col("start") * 2 + F.col("n.k")
    )


def model_rows(files: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """E8 with owners: kind 0 nearest class before, 1 outermost class before, 2 none."""
    found = _family(files, hits, model_rules())
    before = Window.partitionBy(*FILE_KEY).orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    is_class = F.col("rule") == 0
    nearest = F.max(F.when(is_class, F.struct(F.col("start"), F.col("g2").alias("name")))).over(before)
    outermost = F.min(
        F.when(is_class, F.struct(F.length("g1").alias("indent"), (-F.col("start")).alias("back"), F.col("g2").alias("name")))
    ).over(before)
    owner = F.when(F.col("rule") == 1, F.col("_near.name")).when(F.col("rule") == 2, F.col("_outer.name"))
    return (
        found.withColumn("_near", nearest)
        .withColumn("_outer", outermost)
        .filter(~is_class)
        .select(
            *FILE_KEY,
            clean_ident(F.col("g1")).alias("table_name"),
            owner.alias("owner"),
            (F.col("rule") - 1).alias("kind_no"),
            "start",
            "line",
        )
    )


def orm_models(files: DataFrame) -> DataFrame:
    """Model declarations as writes."""
    return _table_rows(model_rows(files), F.col("table_name"), F.lit("write"), 0, F.col("kind_no"), F.col("start"))


def orm_class_map(models: DataFrame) -> DataFrame:
    """Class to table per project, last declaration wins; ``owner_key`` keeps first-seen order."""
    place = F.struct("path", "kind_no", "start")
    first = F.min(place)
    key = F.concat_ws(
        "\x00", first["path"], F.lpad(first["kind_no"].cast("string"), 2, "0"), F.lpad(first["start"].cast("string"), 10, "0")
    )
    return (
        models.filter(F.col("owner").isNotNull() & (F.col("table_name") != ""))
        .groupBy("project_id", F.col("owner").alias("class_name"))
        .agg(F.max_by("table_name", place).alias("table_name"), key.alias("owner_key"))
    )


def orm_call_shapes(files: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Every query shape once, with the class it names and the mode it implies."""
    found = _family(files, hits, call_rules())
    n = len(rules.MODEL_QUERIES)
    write = [i for i, (_, m) in enumerate(rules.MODEL_QUERIES) if m == "write"]
    mode = (
        F.when(F.col("rule") < n, F.when(F.col("rule").isin(write), "write").otherwise("read"))
        .when(F.col("g2").isin(rules.OBJECT_WRITES), "write")
        .when(F.col("g2").isin(rules.OBJECT_READS), "read")
    )
    return found.withColumn("access_mode", mode).filter(F.col("access_mode").isNotNull()).withColumnRenamed("g1", "class_name")


def orm_query_hits(files: DataFrame, class_map: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Call shapes joined to the classes the project declares."""
    calls = orm_call_shapes(files, hits).join(class_map, ["project_id", "class_name"])
    return _table_rows(
        calls, F.col("table_name"), F.col("access_mode"), 2, F.col("rule"), F.col("start"), F.col("owner_key")
    )


def all_rules() -> list[Rule]:
    return [*sql_rules("sql"), *migration_rules(), *model_rules(), *call_rules()]


def table_hits(files: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """E11, general branch: every table hit of the files that are not documentation."""
    code = files.filter(~is_doc(F.col("path")))
    models = model_rows(code, hits)
    parts = [
        _table_rows(models, F.col("table_name"), F.lit("write"), 0, F.col("kind_no"), F.col("start")),
        sql_hits(code, hits),
        migration_hits(code, hits),
        orm_query_hits(code, orm_class_map(models), hits),
    ]
    return reduce(DataFrame.unionByName, parts)
