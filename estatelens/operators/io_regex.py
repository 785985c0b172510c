"""Inputs and outputs of JavaScript, Java and YAML files, by pattern.

Descriptions need no line numbers, so each file row explodes straight into its
hits: no window, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens import rules
from estatelens.functions.patterns import file_ext
from estatelens.functions.text import quoted, strip_ws
from estatelens.operators.io_rows import IO_COLS, hit, io_seq, text


def _each(step: int, pattern: str, build, guard: Column | None = None) -> Column:
    """Array of (step, pos, hits) for every match; ``build`` maps a group getter to hit structs."""
    found = F.regexp_extract_all("content", F.lit(pattern), F.lit(0))

    def pack(m: Column, i: Column) -> Column:
        hits = build(lambda g: F.regexp_extract(m, pattern, g))
        return F.struct(F.lit(step).alias("step"), i.alias("pos"), F.array(*hits).alias("hits"))

    return F.transform(found, pack)


def _once(step: int, pattern: str, hit_: Column) -> Column:
    one = F.array(F.struct(F.lit(step).alias("step"), F.lit(0).alias("pos"), F.array(hit_).alias("hits")))
    return F.when(F.col("content").rlike(pattern), one)


def _rows(files: DataFrame, scans: list[Column]) -> DataFrame:
    all_hits = F.flatten(F.filter(F.array(*scans), lambda a: a.isNotNull()))
    return (
        files.select("project_id", "path", F.explode(all_hits).alias("s"))
        .select("project_id", "path", "s.step", "s.pos", F.posexplode("s.hits").alias("sub", "h"))
        .select("project_id", "path", "h.*", io_seq(0, F.col("step"), F.col("pos"), F.col("sub")).alias("seq"))
        .select(*IO_COLS)
    )


def js_io(files: DataFrame) -> DataFrame:
    """Routes, fetch, axios, file access, publishers, consumers and commands."""
    path = F.col("path")
    at = text(" in ", path)

    def route(g):
        verb, where = F.upper(g(1)), g(2)
        return [
            hit("in", "http_request", text("HTTP ", verb, " ", where, " handler", at)),
            hit("out", "http_response", text("HTTP ", verb, " response for ", where, at)),
        ]

    def fetch(g):
        return [hit("out", "external_call", text("External HTTP call via fetch(", quoted(g(1)), ")", at))]

    def axios(g):
        return [
            hit("out", "external_call", text("External HTTP ", F.upper(g(1)), " via axios(", quoted(g(2)), ")", at))
        ]

    def read(g):
        return [hit("in", "file_read", text("File read via fs.* (", quoted(g(1)), ")", at))]

    def write(g):
        return [hit("out", "file_written", text("File write via fs.* (", quoted(g(1)), ")", at))]

    js = files.filter(file_ext(path).isin(rules.JS_EXTENSIONS))
    return _rows(
        js,
        [
            _each(0, "(?iU)" + rules.JS_ROUTE, route),
            _each(1, "(?U)" + rules.JS_FETCH, fetch),
            _each(2, "(?iU)" + rules.JS_AXIOS, axios),
            _each(3, "(?U)" + rules.JS_READ, read),
            _each(4, "(?U)" + rules.JS_WRITE, write),
            _once(5, "(?U)" + rules.JS_PUBLISH, hit("out", "message_published", text("Message publisher detected", at))),
            _once(6, "(?U)" + rules.JS_CONSUME, hit("in", "message_consumed", text("Message consumer detected", at))),
            _once(
                7, "(?U)" + rules.JS_COMMAND, hit("in", "cli_argument", text("CLI command registered via commander", at))
            ),
        ],
    )


def java_io(files: DataFrame) -> DataFrame:
    """Mapping annotations, one schedule mark per file, listeners."""
    path = F.col("path")

    def mapping(g):
        ann = g(1)
        verb = F.lit("ANY")
        for name, v in rules.JAVA_VERBS.items():
            verb = F.when(ann == name, F.lit(v)).otherwise(verb)
        label = F.coalesce(F.nullif(strip_ws(g(2)), F.lit("")), F.lit("<class-or-method-mapping>"))
        return [
            hit("in", "http_request", text("HTTP ", verb, " ", label, " via @", ann, " in ", path)),
            hit("out", "http_response", text("HTTP ", verb, " response from @", ann, " ", label, " in ", path)),
        ]

    def listener(g):
        return [hit("in", "message_consumed", text("Message consumer via @", g(1), " in ", path))]

    java = files.filter(file_ext(path) == ".java")
    return _rows(
        java,
        [
            _each(0, "(?U)" + rules.JAVA_MAPPING, mapping),
            _once(
                1, "(?U)" + rules.JAVA_SCHEDULED, hit("in", "scheduled_event", text("Scheduled task via @Scheduled in ", path))
            ),
            _each(2, "(?U)" + rules.JAVA_LISTENER, listener),
        ],
    )


def yaml_cron(files: DataFrame) -> DataFrame:
    """Cron and schedule keys; the blank after the colon may hold a newline."""
    path = F.col("path")

    def schedule(g):
        expr = strip_ws(g(3))
        return [
            F.when(
                expr != "",
                hit("in", "scheduled_event", text("Scheduled event (", expr, ") declared in ", path)),
            )
        ]

    yaml = files.filter(file_ext(path).isin(".yml", ".yaml"))
    return _rows(yaml, [_each(0, "(?mdU)" + rules.YAML_CRON, schedule)]).filter(F.col("description").isNotNull())
