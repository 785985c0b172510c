"""Services named in a Go project's configuration, adapters and helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens import rules
from estatelens.functions.patterns import Rule, regex_hits
from estatelens.sources.admission import is_go_source

ADAPTER = r"\Ainternal/adapter/([^/]*)_adapter\.go\z"
_IMPORT_PATH = r'\A\s*(?:\w+\s+)?"([^"]+)"\s*\z'


def is_adapter_file(path: Column) -> Column:
    return is_go_source(path) & path.rlike(ADAPTER)


def import_paths(content: Column) -> Column:
    """Import paths, one per line: single imports and the lines of import blocks."""
    singles = F.regexp_extract_all(content, F.lit(r'(?m)^[ \t]*import[ \t]+((?:\w+[ \t]+)?"[^"\n]+")[ \t]*\r?$'), F.lit(1))
    blocks = F.regexp_extract_all(content, F.lit(r"(?m)^[ \t]*import \(([^)]*)"), F.lit(1))
    lines = F.flatten(F.transform(blocks, lambda b: F.split(b, r"\r?\n", -1)))
    listed = F.filter(lines, lambda s: s.rlike(_IMPORT_PATH))
    return F.transform(F.concat(singles, listed), lambda s: F.regexp_extract(s, _IMPORT_PATH, 1))


def apm_only(content: Column) -> Column:
    """The file imports something, and only the tracing library."""
    paths = import_paths(content)
    return (F.size(paths) > 0) & F.forall(paths, lambda p: p.startswith(rules.GO_APM_PREFIX))


def go_url_host(rest: Column) -> Column:
    """Host of a URL tail: path, query, fragment and user part off."""
    return F.substring_index(F.regexp_extract(rest, r"\A[^/?#]*", 0), "@", -1)


def go_scheme_kind(scheme: Column) -> Column:
    s = F.lower(scheme)
    out = F.when(F.lit(False), F.lit(""))
    for name, kind in rules.GO_SCHEME_KINDS.items():
        out = out.when(s == name, F.lit(kind))
    return out.otherwise("other")


def _scoped(files: DataFrame) -> DataFrame:
    """The few files the Go rules read, without the tracing-only ones."""
    path = F.col("path")
    wanted = (path == rules.GO_CONFIG) | is_adapter_file(path) | path.isin(rules.GO_HELPERS)
    return files.filter(wanted).filter(~apm_only(F.col("content")))


def _seq(step: int, sub: Column, pos: Column) -> Column:
    return F.struct(
        F.lit(step).alias("step"), F.col("path").alias("path"), sub.cast("int").alias("sub"), pos.cast("int").alias("pos")
    )


def config_rules() -> list[Rule]:
    return [
        Rule(0, "(?iU)" + rules.GO_URL, (1, 2)),
        Rule(1, "(?iU)" + rules.GO_NAMED_URL, (1, 2)),
        Rule(2, "(?iU)" + rules.GO_DESTINATION, (1, 2)),
    ]


def go_config_hits(files: DataFrame) -> DataFrame:
    """URL hosts of the configuration, then named endpoints without a URL."""
    config = _scoped(files).filter(F.col("path") == rules.GO_CONFIG)
    hits = regex_hits(config, config_rules()[:2])
    url = F.col("rule") == 0
    upper = F.upper("g1")
    stem = F.lower(F.regexp_replace("g1", r"(?i)(_URL|_ENDPOINT|_BROKER|_HOST|_URI)\z", ""))
    hint = (
        F.when(upper.contains("BROKER"), "message_broker")
        .when(upper.contains("URL") | upper.contains("ENDPOINT") | upper.contains("URI"), "http_api")
        .otherwise("other")
    )
    return (
        hits.filter(url | ~F.col("g2").rlike("(?iU)" + rules.GO_URL))
        .select(
            "project_id",
            F.when(url, go_url_host(F.col("g2"))).otherwise(stem).alias("name"),
            F.when(url, go_scheme_kind(F.col("g1"))).otherwise(hint).alias("kind"),
            "path",
            "line",
            _seq(0, F.col("rule"), F.col("start")).alias("seq"),
        )
        .filter(F.col("name") != "")
    )


def go_adapter_hits(files: DataFrame) -> DataFrame:
    """One row per adapter file, named with its distinct hosts in first-seen order."""
    adapters = _scoped(files).filter(is_adapter_file(F.col("path")))
    urls = (
        regex_hits(adapters, config_rules()[:1])
        .withColumn("host", go_url_host(F.col("g2")))
        .filter(F.col("host") != "")
        .groupBy("project_id", "path")
        .agg(
            F.sort_array(F.collect_list(F.struct("start", "host"))).alias("hosts"),
            F.min_by(F.struct(go_scheme_kind(F.col("g1")).alias("kind"), "line"), "start").alias("first"),
        )
        .withColumn("shown", F.array_join(F.array_distinct(F.transform("hosts", lambda x: x["host"])), ", "))
    )
    base = F.regexp_extract("path", ADAPTER, 1)
    named = F.when(F.col("shown").isNotNull(), F.concat(base, F.lit(" ("), F.col("shown"), F.lit(")"))).otherwise(base)
    return (
        adapters.select("project_id", "path")
        .filter(base != "")
        .join(urls, ["project_id", "path"], "left")
        .select(
            "project_id",
            named.alias("name"),
            F.coalesce("first.kind", F.lit("other")).alias("kind"),
            "path",
            F.col("first.line").alias("line"),
            _seq(1, F.lit(0), F.lit(0)).alias("seq"),
        )
    )


def go_broker_hits(files: DataFrame) -> DataFrame:
    """The broker a helper file wraps, at the helper and at each configured destination."""
    scoped = _scoped(files)

    def has(words: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [F.col("content").contains(w) for w in words])

    helpers = scoped.filter(
        F.col("path").isin(rules.GO_HELPERS) & has(rules.BROKER_METHODS) & has(rules.BROKER_LIBRARIES)
    ).select("project_id", F.col("path").alias("helper"))
    config = scoped.filter(F.col("path") == rules.GO_CONFIG)
    lines = (
        regex_hits(config, config_rules()[2:])
        .groupBy("project_id", "path", "line")
        .agg(F.min("start").alias("start"))
    )
    order = F.array_position(F.array(*[F.lit(h) for h in rules.GO_HELPERS]), F.col("helper"))
    at_helper = helpers.select(
        "project_id", F.col("helper").alias("path"), F.lit(None).cast("int").alias("line"), order.alias("h"), F.lit(-1).alias("pos")
    )
    at_config = helpers.join(lines, "project_id").select(
        "project_id", "path", "line", order.alias("h"), F.col("start").alias("pos")
    )
    return at_helper.unionByName(at_config).select(
        "project_id",
        F.lit("activemq").alias("name"),
        F.lit("message_broker").alias("kind"),
        "path",
        "line",
        F.struct(
            F.lit(2).alias("step"), F.lit("").alias("path"), F.col("h").cast("int").alias("sub"), F.col("pos").cast("int").alias("pos")
        ).alias("seq"),
    )


def go_service_hits(files: DataFrame) -> DataFrame:
    """E15 to E17 in their order."""
    return go_config_hits(files).unionByName(go_adapter_hits(files)).unionByName(go_broker_hits(files))
