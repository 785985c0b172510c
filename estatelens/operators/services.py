"""External services a project's files point at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens import rules
from estatelens.functions.hosts import bare_host, is_local_host, scheme_kind
from estatelens.functions.patterns import Rule, line_hits, regex_hits
from estatelens.sources.admission import service_scannable

STRICT_URL = rules.URL_PATTERN.replace(r"[^@\s/?#:", r"[^@\s/?#")


def _seq(phase: int, rule: Column, pos: Column) -> Column:
    return F.struct(
        F.col("path").alias("path"),
        F.lit(phase).alias("phase"),
        rule.cast("int").alias("rule"),
        F.col("line").cast("int").alias("line"),
        pos.cast("int").alias("pos"),
    )


def url_columns(m: Column, strict_userinfo: bool = False) -> tuple[Column, Column, Column]:
    """(scheme, host, kind) of a matched URL text; kind is null when denied or local.

    By default ``user:secret@host`` yields ``user``, as the results to match
    do; ``strict_userinfo`` reads the host after the ``@`` instead.
    """
    pattern = STRICT_URL if strict_userinfo else rules.URL_PATTERN
    scheme = F.lower(F.regexp_extract(m, pattern, 1))
    host = F.regexp_extract(m, pattern, 2)
    return scheme, host, _url_kind(scheme, host)


def _url_kind(scheme: Column, host: Column) -> Column:
    return F.when(~is_local_host(host), scheme_kind(scheme, host))


def url_hits(files: DataFrame, strict_userinfo: bool = False) -> DataFrame:
    """Hosts of absolute URLs, line by line and without a shuffle."""
    pattern = STRICT_URL if strict_userinfo else rules.URL_PATTERN
    host = F.col("g2")
    kind = _url_kind(F.col("g1"), host)
    return (
        line_hits(files, pattern, "://", (1, 2))
        .select("project_id", bare_host(host).alias("name"), kind.alias("kind"), "path", "line", _seq(0, F.lit(0), F.col("i")).alias("seq"))
        .filter(F.col("kind").isNotNull())
    )


def cloud_columns(svc: Column) -> tuple[Column, Column]:
    """(kind, name) of a cloud client's service id."""
    kind, name = None, None
    for key, (k, n) in rules.CLOUD_SERVICES.items():
        kind = F.when(svc == key, k) if kind is None else kind.when(svc == key, k)
        name = F.when(svc == key, n) if name is None else name.when(svc == key, n)
    return kind.otherwise("other"), name.otherwise(F.concat(F.lit("aws-"), svc))


def client_rules() -> list[Rule]:
    """Rule 0 is the cloud client with its service id; the rest are named clients."""
    out = [Rule(0, rules.CLOUD_PATTERN, (1,))]
    out += [Rule(n, p, ()) for n, (p, _, _) in enumerate(rules.CLIENT_PATTERNS, start=1)]
    return out


def client_hits(files: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Client constructors, all rules in one pass over the files.

    ``hits`` may hold the matches of a pass made together with other rules.
    """
    rule_list = client_rules()
    if hits is None:
        hits = regex_hits(files, rule_list)
    else:
        hits = hits.filter(F.col("rule") < len(rule_list)).filter(service_scannable(F.col("path")))
    kind, name = cloud_columns(F.lower("g1"))
    for n, (_, k, client) in reversed(list(enumerate(rules.CLIENT_PATTERNS, start=1))):
        kind = F.when(F.col("rule") == n, F.lit(k)).otherwise(kind)
        name = F.when(F.col("rule") == n, F.lit(client)).otherwise(name)
    return hits.select(
        "project_id", name.alias("name"), kind.alias("kind"), "path", "line", _seq(1, F.col("rule"), F.col("start")).alias("seq"),
        "rule",
    )


def boto_hits(files: DataFrame) -> DataFrame:
    """Cloud clients by service id."""
    return client_hits(files).filter(F.col("rule") == 0).drop("rule")


def sdk_hits(files: DataFrame) -> DataFrame:
    """Named client constructors."""
    return client_hits(files).filter(F.col("rule") > 0).drop("rule")


def service_hits(files: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """E19, general branch: every service hit of the scannable files."""
    scanned = files.filter(service_scannable(F.col("path")))
    return url_hits(scanned).unionByName(client_hits(scanned, hits).drop("rule"))
