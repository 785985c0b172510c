"""Go sources: call sites by their tokens, classified by columns.

The expression's first alternatives consume comments, string, raw and rune
literals, so nothing inside them is taken for code. Heads of calls and of struct
literals are paired with their closing bracket by depth, whatever the nesting
(:mod:`estatelens.operators.brackets`). A call is consumed with its whole
argument list, so a call in an argument is no site of its own; one whose bracket
is not closed by its own kind is no site, and what it holds is looked at alone.
Known gap: comments between a name and its bracket hide the call.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens import rules
from estatelens.functions.identifiers import binary_name, module_tail, route_path, route_verb
from estatelens.functions.patterns import FILE_KEY
from estatelens.functions.text import collapse_ws, strip_ws, truncate_words
from estatelens.operators.brackets import NAMED_MARK, PLAIN_MARK, constructs, filled
from estatelens.operators.io_rows import IO_COLS, hit, io_seq, text
from estatelens.sources.admission import is_go_source

# Go's lexical shapes. Possessive loops keep long literals off the JVM stack.
_LINE_COMMENT = r"//[^\n]*+"
_BLOCK_COMMENT = r"/\*(?:[^*]|\*(?!/))*+\*/"
_STRING = r'"(?:[^"\\\n]|\\.)*+"'
_RAW = r"`[^`]*+`"
_RUNE = r"'(?:[^'\\\n]|\\.)++'"
_ATOM = rf"{_LINE_COMMENT}|{_BLOCK_COMMENT}|{_STRING}|{_RAW}|{_RUNE}"
_NAME = r"[A-Za-z_]\w*+"
_CHAIN = rf"{_NAME}(?:\s*+\.\s*+{_NAME})*+"
_RESERVED = r"(?!(?:func|struct|interface|type|import|package|const|var)\b)"


_FUNC = rf"\bfunc\b\s*+(?:\(([^()]*+)\)\s*+)?+({_NAME})(?=\s*+[(\[])"
_STRUCT = rf"[&*]?(?<![\w]){_RESERVED}{_CHAIN}\s*+\{{(?=\s*+(?!default\b|case\b){_NAME}\s*+:(?!=))"
_CALL = rf"(?<!\w){_RESERVED}{_CHAIN}\s*+\("
_FUNC_HEAD = rf"\Afunc\b\s*+(?:\(([^()]*+)\)\s*+)?+({_NAME})\z"
TOKEN_PATTERN = rf"(?s){_ATOM}|{_FUNC}|{_STRUCT}|{_CALL}|[()\[\]{{}},]"

# Over direct texts, where a mark with a number stands for what a bracket holds.
_REST = rf"(?:{_STRING}|{_RAW}|{_RUNE}|[^,\"'`])"
_ARG_VALUE = (
    rf"{_STRING}|{_RAW}|\d[\w.]*+"
    rf"|{_RESERVED}{_CHAIN}\s*+\({PLAIN_MARK}\d++{PLAIN_MARK}\)"
    rf"|[&*]?{_RESERVED}{_CHAIN}\s*+\{{{NAMED_MARK}\d++{NAMED_MARK}\}}"
    rf"|{_RESERVED}{_CHAIN}"
    rf"|{_REST}++"
)
ARG_PATTERN = rf"(?s)(?![\s,])(?:{_ARG_VALUE})"
FIELD_PATTERN = rf"(?s){_NAME}\s*+:\s*+{_REST}*+"

_IS_LITERAL = r"(?s)\A(?:\".*\"|`.*`)\z"


# --- whole-file skips --------------------------------------------------------


def _head(content: Column) -> Column:
    """Everything before the package clause, or the whole file without one."""
    return F.regexp_extract(
        content, rf"(?s)\A((?:{_ATOM}|(?!\bpackage\b).)*+)", 1
    )


def skip_reason(content: Column) -> Column:
    """I16: why a file is left out, null when it is not."""
    lines = F.split(_head(content), r"\r?\n", -1)
    constraint = r"\A\s*//(?:go:build|[ \t]*\+build)(?:\z|[ \t](.*)\z)"
    exprs = F.transform(
        F.filter(lines, lambda s: s.rlike(constraint)), lambda s: strip_ws(F.regexp_extract(s, constraint, 1))
    )
    blocked = F.exists(exprs, lambda e: ~e.isin("", "!ignore"))
    code = content
    single = code.rlike(r'(?m)^[ \t]*import[ \t]+"C"')
    blocks = F.regexp_extract_all(code, F.lit(r"(?m)^[ \t]*import\s*\(([^)]*)\)"), F.lit(1))
    block = F.exists(blocks, lambda b: b.rlike(r'(?m)(?:^|;)[ \t]*"C"'))
    return F.when(blocked, rules.BUILD_SKIP).when(single | block, rules.CGO_SKIP)


def go_sources(files: DataFrame) -> DataFrame:
    return files.filter(is_go_source(F.col("path")))


def go_skips(files: DataFrame) -> DataFrame:
    """I16: (project_id, path, reason) of skipped Go files."""
    return (
        go_sources(files)
        .select("project_id", "path", skip_reason(F.col("content")).alias("reason"))
        .filter(F.col("reason").isNotNull())
    )


def parsed_sources(files: DataFrame) -> DataFrame:
    return go_sources(files).filter(skip_reason(F.col("content")).isNull())


# --- call sites --------------------------------------------------------------


def _imports(content: Column) -> Column:
    path = r'(?:[\w.]+[ \t]+)?"([^"\n]+)"'
    single = F.regexp_extract_all(content, F.lit(rf"(?m)^[ \t]*import[ \t]+{path}"), F.lit(1))
    blocks = F.regexp_extract_all(content, F.lit(r"(?m)^[ \t]*import\s*\(([^)]*)\)"), F.lit(1))
    listed = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(rf"(?m)^[ \t]*{path}"), F.lit(1))))
    return F.concat(single, listed)


def go_call_sites(files: DataFrame) -> DataFrame:
    """Calls and function declarations of every file that is not skipped.

    Columns: key, start, line, kind (call or func), receiver (dotted for a call,
    the receiver clause for a method, else empty), method, args (array of argument texts), and whether
    the file imports the web and wiring libraries.
    """
    src = parsed_sources(files)
    found = constructs(src, TOKEN_PATTERN, "content", FILE_KEY, ("call", "func"))
    is_func = F.col("kind") == "func"
    chain = F.regexp_replace(F.regexp_replace("head", r"\(\z", ""), r"\s+", "")
    args = F.transform(
        F.regexp_extract_all("direct", F.lit(ARG_PATTERN), F.lit(0)),
        lambda a: F.regexp_replace(filled(a, F.col("inner")), r"(?s)\s+\z", ""),
    )
    sites = found.select(
        *FILE_KEY,
        "start",
        "line",
        "kind",
        F.when(is_func, F.regexp_extract("head", _FUNC_HEAD, 1)).otherwise(F.regexp_extract(chain, r"\A(.*)\.[^.]*\z", 1)).alias("receiver"),
        F.when(is_func, F.regexp_extract("head", _FUNC_HEAD, 2)).otherwise(F.substring_index(chain, ".", -1)).alias("method"),
        F.when(~is_func, args).alias("args"),
    )
    flags = src.select(*FILE_KEY, _imports(F.col("content")).alias("im")).select(
        *FILE_KEY,
        F.array_contains("im", "net/http").alias("imports_http"),
        F.exists("im", lambda p: p.startswith("go.uber.org/fx")).alias("imports_fx"),
    )
    return sites.join(flags.filter(F.col("imports_http") | F.col("imports_fx")), FILE_KEY, "left").fillna(
        False, ["imports_http", "imports_fx"]
    )


def _calls(sites: DataFrame) -> DataFrame:
    """Calls whose receiver is neither the wiring nor the configuration library."""
    head = F.substring_index("receiver", ".", 1)
    return sites.filter((F.col("kind") == "call") & ~head.isin("fx", "viper"))


def _arg(n: int) -> Column:
    return F.get("args", F.lit(n))


def _literal(a: Column) -> Column:
    """Content of a string or raw literal, null for any other argument."""
    return F.when(a.rlike(_IS_LITERAL), F.substring(a, F.lit(2), F.length(a) - 2))


def _at() -> Column:
    return text(" at ", F.col("path"), ":", F.col("line").cast("string"))


def _via(receiver: Column | str) -> Column:
    return text(" via ", receiver, ".", F.col("method"), "()", _at())


def _emit(rows: DataFrame, step: int, hits: Column) -> DataFrame:
    return (
        rows.withColumn("_hits", F.filter(hits, lambda h: h.isNotNull()))
        .select("project_id", "path", "start", F.posexplode("_hits").alias("n", "h"))
        .select("project_id", "path", "h.*", io_seq(1, F.lit(step), F.col("start"), F.col("n")).alias("seq"))
        .select(*IO_COLS)
    )


def go_http_io(sites: DataFrame) -> DataFrame:
    """Route registrations on the web package, or on one name in a file importing it."""
    one_name = (F.col("receiver") != "") & ~F.col("receiver").contains(".")
    rows = _calls(sites).filter(
        F.col("method").isin("Handle", "HandleFunc")
        & ((F.col("receiver") == "http") | (one_name & F.col("imports_http")))
    )
    route = _literal(_arg(0))
    recv = F.col("receiver")
    dynamic = text("<dynamic", _at(), " on ", recv, ">")
    hits = F.when(
        route.isNotNull(),
        F.array(
            hit("in", "http_request", text("HTTP ", route_verb(route), " ", route_path(route), _via(recv))),
            hit("out", "http_response", text("HTTP ", route_verb(route), " response for ", route_path(route), _via(recv))),
        ),
    ).otherwise(
        F.array(
            hit("in", "http_request", text("HTTP request ", dynamic)),
            hit("out", "http_response", text("HTTP response ", dynamic)),
        )
    )
    return _emit(rows, 0, hits)


def go_schedule_io(sites: DataFrame) -> DataFrame:
    """Tickers and timers, and cron jobs with the precision their file sets."""
    is_new = (F.col("receiver") == "cron") & (F.col("method") == "New")
    with_seconds = F.exists("args", lambda a: a.rlike(r"(?s)\Acron\s*\.\s*WithSeconds\s*\("))
    precision = (
        sites.filter((F.col("kind") == "call") & is_new)
        .groupBy(*FILE_KEY)
        .agg(F.bool_or(with_seconds).alias("seconds"))
    )
    rows = (
        _calls(sites)
        .filter(
            F.col("method").isin("AddFunc", "AddJob")
            | ((F.col("receiver") == "time") & F.col("method").isin("NewTicker", "AfterFunc"))
        )
        .join(precision, FILE_KEY, "left")
    )
    recv = F.coalesce(F.nullif("receiver", F.lit("")), F.lit("<unqualified>"))
    first = _arg(0)
    literal = _literal(first)
    name = first.rlike(rf"\A{_CHAIN}\z")
    known = F.col("seconds").isNotNull() & (F.col("receiver") != "") & ~F.col("receiver").contains(".")
    fine = known & (literal.isNotNull() | F.coalesce(name, F.lit(False)))
    timed = text(
        "scheduled (time, ", F.col("method"), ") ",
        F.coalesce(literal, F.when(first.rlike(r"\A\d"), first), F.lit("<dynamic>")), _via("time"),
    )
    grade = F.when(F.col("seconds"), "seconds-precision").otherwise("minute-precision")
    cron = text("scheduled (cron, ", grade, ") ", F.coalesce(literal, F.lit("<dynamic>")), _via(recv))
    odd = text(
        "scheduled <dynamic> (malformed or unsupported scheduler shape: ", F.col("method"), "(", recv, ")", _at(), ")"
    )
    is_time = (F.col("receiver") == "time") & F.col("method").isin("NewTicker", "AfterFunc")
    described = F.when(is_time, timed).when(fine, cron).otherwise(odd)
    return _emit(rows, 1, F.array(hit("in", "scheduled_event", described)))


def go_broker_io(sites: DataFrame) -> DataFrame:
    """Subscriptions and messages with a ``domain`` struct literal at a fixed place."""

    def typed(a: Column, name: str) -> Column:
        return F.coalesce(a.rlike(rf"(?s)\A[&*]?domain\s*\.\s*{name}\s*\{{\s*{_NAME}\s*:"), F.lit(False))

    subscribe = (F.col("method") == "Subscribe") & typed(_arg(2), "SubscriberConfig")
    send = (F.col("method") == "SendMessage") & typed(_arg(3), "Message")
    rows = _calls(sites).filter(subscribe | send).withColumn(
        "literal", F.when(F.col("method") == "Subscribe", _arg(2)).otherwise(_arg(3))
    )
    place_key = [*FILE_KEY, "at"]
    literals = rows.select(*FILE_KEY, F.col("start").alias("at"), "literal")
    bodies = constructs(literals, TOKEN_PATTERN, "literal", place_key, ("struct",)).filter("start = 0")
    fields = F.regexp_extract_all("direct", F.lit(FIELD_PATTERN), F.lit(0))
    place = F.get(F.filter(fields, lambda f: f.rlike(r"\ADestination\s*:")), F.lit(0))
    value = F.regexp_extract(place, rf"(?s)\ADestination\s*:\s*({_STRING}|{_RAW})", 1)
    told = bodies.select(*FILE_KEY, F.col("at").alias("start"), value.alias("value"))
    rows = rows.join(told, [*FILE_KEY, "start"], "left")
    destination = F.when(F.length("value") >= 2, F.substring("value", F.lit(2), F.length("value") - 2)).otherwise("<dynamic>")
    recv = F.coalesce(F.nullif("receiver", F.lit("")), F.lit("<unqualified>"))
    took = hit("in", "message_consumed", text("activemq message consumed from ", destination, _via(recv)))
    gave = hit("out", "message_published", text("activemq message published to ", destination, _via(recv)))
    return _emit(rows, 2, F.array(F.when(F.col("method") == "Subscribe", took).otherwise(gave)))


def go_file_io(sites: DataFrame) -> DataFrame:
    """Files read and written through the system packages."""
    recv, method = F.col("receiver"), F.col("method")
    rows = _calls(sites).filter(
        ((recv == "os") & method.isin("Open", "ReadFile", "Create", "WriteFile", "OpenFile"))
        | ((recv == "ioutil") & method.isin("ReadFile", "WriteFile"))
    )
    flag = F.when(F.size("args") == 3, F.regexp_extract(_arg(1), r"\Aos\s*\.\s*(\w+)\z", 1))
    verdict = (
        F.when(method.isin("Open", "ReadFile"), "read")
        .when(method.isin("Create", "WriteFile"), "write")
        .when(flag == "O_RDONLY", "read")
        .when(flag.isin(rules.GO_OPEN_WRITES), "write")
        .otherwise("both")
    )
    target = F.coalesce(_literal(_arg(0)), F.lit("<dynamic>"))
    read = hit("in", "file_read", text("file read ", target, _via(recv)))
    write = hit("out", "file_written", text("file written ", target, _via(recv)))
    return _emit(rows, 3, F.array(F.when(verdict != "write", read), F.when(verdict != "read", write)))


def module_lines(files: DataFrame) -> DataFrame:
    """First well-formed module line of the root ``go.mod``: module path and both comments."""
    mods = files.filter(F.col("path") == "go.mod")
    lines = F.split("content", r"\r\n|\n|\r", -1)
    shape = r"(?U)\A\s*module\s+(\S+)\s*(?://(.*))?\z"
    paired = F.arrays_zip(lines.alias("s"), F.concat(F.array(F.lit("")), lines).alias("before"))
    picked = F.get(F.filter(paired, lambda x: x["s"].rlike(shape)), F.lit(0))
    before = strip_ws(F.col("m.before"))
    leading = F.when(before.startswith("//"), F.nullif(strip_ws(F.substring(before, 3, 1 << 30)), F.lit("")))
    return (
        mods.select("project_id", picked.alias("m"))
        .filter(F.col("m").isNotNull())
        .select(
            "project_id",
            F.regexp_extract("m.s", shape, 1).alias("module"),
            leading.alias("leading"),
            F.nullif(strip_ws(F.regexp_extract("m.s", shape, 2)), F.lit("")).alias("trailing"),
        )
    )


def go_cli_io(sites: DataFrame, files: DataFrame) -> DataFrame:
    """Main functions as binaries, and flags."""
    modules = module_lines(files).select("project_id", binary_name(F.col("module")).alias("module_binary"))
    named = F.regexp_extract("path", r"\Acmd/([^/]+)/main\.go\z", 1)
    first_main = (
        sites.filter(
            (F.col("kind") == "func")
            & (F.col("method") == "main")
            & (F.col("receiver") == "")
            & ((named != "") | F.col("path").isin("cmd/main.go", "main.go"))
        )
        .groupBy(*FILE_KEY)
        .agg(F.min("start").alias("start"), F.min("line").alias("line"))
    )
    mains = (
        first_main.join(modules, "project_id", "left")
        .withColumn("binary", F.coalesce(F.nullif(named, F.lit("")), F.col("module_binary")))
        .filter(F.col("binary").isNotNull())
        .withColumn("start", F.lit(-1))
    )
    binaries = _emit(
        mains, 4, F.array(hit("in", "cli_argument", text("binary ", F.col("binary"), " via func main()", _at())))
    )
    at = None
    for method, n in rules.GO_FLAG_NAME_AT.items():
        at = F.when(F.col("method") == method, F.lit(n)) if at is None else at.when(F.col("method") == method, F.lit(n))
    flags = _calls(sites).filter(
        (F.col("receiver") == "flag") & F.col("method").isin("Parse", *rules.GO_FLAG_NAME_AT)
    )
    flag_name = F.coalesce(_literal(F.get("args", at)), F.lit("<dynamic>"))
    described = F.when(F.col("method") == "Parse", text("flag parsing invoked", _via("flag"))).otherwise(
        text("flag ", flag_name, _via("flag"))
    )
    return binaries.unionByName(_emit(flags, 4, F.array(hit("in", "cli_argument", described))))


def go_io_prune(io: DataFrame) -> DataFrame:
    """No file access of the configuration, no binary of the plain command."""
    where = F.regexp_extract("description", r"\s+at\s+(\S+):\d+$", 1)
    file_io = F.col("category").isin("file_read", "file_written") & (where == "config/config.go")
    binary = (
        (F.col("category") == "cli_argument") & F.col("description").startswith("binary ") & (where == "cmd/main.go")
    )
    return io.filter(~(file_io | binary))


def go_io(files: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """I10 to I15 of one site table."""
    sites = go_call_sites(files) if sites is None else sites
    pruned = go_io_prune(go_file_io(sites).unionByName(go_cli_io(sites, files)))
    return reduce(DataFrame.unionByName, [go_http_io(sites), go_schedule_io(sites), go_broker_io(sites), pruned])


# --- purpose candidates ------------------------------------------------------


def gomod_candidates(files: DataFrame) -> DataFrame:
    """P5: the module line's comment (priority 3) and module path tail (priority 4)."""

    def one(source: str, priority: int, raw: Column) -> Column:
        return F.struct(
            F.lit(source).alias("source"),
            F.lit(priority).alias("priority"),
            F.lit("go.mod").alias("path"),
            truncate_words(collapse_ws(raw)).alias("text"),
        )

    both = F.array(
        one("gomod_comment", 3, F.coalesce("leading", "trailing")),
        one("gomod_module_path", 4, module_tail(F.col("module"))),
    )
    return module_lines(files).select("project_id", F.inline(both)).filter(F.col("text").isNotNull())


def is_main_path(path: Column) -> Column:
    return path.rlike(r"\A(?:[^/]+\.go|cmd/main\.go|cmd/[^/]+/main\.go)\z")


def package_doc(content: Column) -> Column:
    """Comments that touch the package clause, without marks, as one line."""
    gap = r"[ \t]*(?:\r?\n)?[ \t]*"
    block = F.regexp_extract(_head(content), rf"(?s)((?:(?:(?<![^\n])[ \t]*{_LINE_COMMENT}|{_BLOCK_COMMENT}){gap})+)\z", 1)
    comments = F.regexp_extract_all(block, F.lit(rf"(?s){_LINE_COMMENT}|{_BLOCK_COMMENT}"), F.lit(0))
    bare = F.transform(
        comments,
        lambda c: F.when(c.startswith("//"), strip_ws(F.substring(c, 3, 1 << 30))).otherwise(
            F.substring(c, F.lit(3), F.length(c) - 4)
        ),
    )
    return collapse_ws(F.array_join(bare, " "))


def package_doc_candidate(files: DataFrame) -> DataFrame:
    """The first package comment by path of root and command mains (priority 7)."""
    return (
        parsed_sources(files.filter(is_main_path(F.col("path"))))
        .select("project_id", "path", truncate_words(package_doc(F.col("content"))).alias("text"))
        .filter(F.col("text").isNotNull())
        .groupBy("project_id")
        .agg(F.min_by(F.struct("path", "text"), "path").alias("x"))
        .select("project_id", F.lit("package_doc_comment").alias("source"), F.lit(7).alias("priority"), "x.path", "x.text")
    )
