"""Regular-expression matches as rows, with offsets and line numbers, in the JVM.

Spark returns match texts but no positions. The text between matches
(``split`` by the same pattern) gives them back: the start of match *i* is the
length of everything before it. Lengths are summed by a window per file over
rows that carry no file text, so the shuffle moves only the matches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

FILE_KEY = ["project_id", "path"]


@dataclass(frozen=True)
class Rule:
    """A pattern, its number in the rule list, the capture groups kept and the view it reads."""

    number: int
    pattern: str
    groups: tuple[int, ...] = (1,)
    view: str = "text"


def sql_literal(text: str) -> str:
    """A Spark SQL string literal of any text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def needed_word(pattern: str) -> str:
    """A text, in lower case, without which the pattern cannot match: its longest run of plain characters outside groups and classes; empty if there is none."""
    body = re.sub(r"\A\(\?[A-Za-z]+\)", "", pattern)
    runs, run, i = [], "", 0
    while i < len(body):
        c = body[i]
        if c == "|":
            return ""
        size, plain = 1, c not in "^$.([{?*+"
        if c == "\\":
            size, plain = 2, not body[i + 1].isalnum()
            c = body[i + 1]
        elif c in "([":
            size = _closed(body, i) - i
        after = body[i + size : i + size + 1]
        if plain and after not in ("?", "*", "{"):
            run += c
        else:
            runs.append(run)
            run = ""
        i += size
        quantifier = re.match(r"(?:[?*+]|\{[\d,]*\})[?+]?", body[i:])
        if quantifier:
            runs.append(run)
            run = ""
            i += quantifier.end()
    return max([*runs, run], key=len).lower()


def _closed(body: str, i: int) -> int:
    """One past the end of the group or class that starts at ``i``."""
    if body[i] == "[":
        i += 2 if body[i + 1] in "^]" else 1
        while body[i] != "]":
            i += 2 if body[i] == "\\" else 1
        return i + 1
    i += 1
    while body[i] != ")":
        i = _closed(body, i) if body[i] in "([" else i + (2 if body[i] == "\\" else 1)
    return i + 1


def _newlines(c: str) -> str:
    return f"length({c}) - length(replace({c}, chr(10), ''))"


def _matches(rule: Rule, width: int, texts: bool) -> Column:
    """Array of match structs of one rule; null when the pattern does not occur."""
    text, pattern = f"_{rule.view}", sql_literal(rule.pattern)
    groups = "".join(f", regexp_extract_all({text}, {pattern}, {g})" for g in rule.groups)
    # Fields of the zipped arrays: 0 the match, 1 the text before it, 2.. the groups.
    kept = "".join(
        f", 'g{n + 1}', {f'x.`{n + 2}`' if n < len(rule.groups) else 'CAST(NULL AS STRING)'}" for n in range(width)
    )
    kept += ", 'm', x.`0`, 'gap', x.`1`" * texts
    word = needed_word(rule.pattern)
    may = f"contains(_low_{rule.view}, {sql_literal(word)}) AND " if word else ""
    return F.expr(
        f"CASE WHEN {may}{text} RLIKE {pattern} THEN transform(filter("
        f"arrays_zip(regexp_extract_all({text}, {pattern}, 0), split({text}, {pattern}, -1){groups}), x -> x.`0` IS NOT NULL),"
        f" (x, i) -> named_struct('rule', {rule.number}, 'i', i{kept}, 'm_len', length(x.`0`), 'm_nl', {_newlines('x.`0`')},"
        f" 'gap_len', length(x.`1`), 'gap_nl', {_newlines('x.`1`')})) END"
    )


def regex_hits(
    files: DataFrame,
    rules: list[Rule],
    content: str = "content",
    key: list[str] | None = None,
    views: dict[str, Column] | None = None,
    texts: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """One row per match: key, rule, g1.., start, end and line of the match.

    All rules share one pass over the texts, one exchange and one sort by file
    key; a window holds the matches of one file. A pattern is tried only on texts
    that hold its plain word (:func:`needed_word`). ``views`` are other renderings
    of the same text, of equal length. With ``texts`` the match (m) and the text
    before it since the last match (gap) come too. ``parts`` fixes the number of
    partitions of the exchange, where what follows needs more memory than its rows tell.
    """
    key = key or FILE_KEY
    views = {"text": F.col(content)} | (views or {})
    width = max(1, *(len(r.groups) for r in rules))
    per_rule = [_matches(r, width, texts) for r in rules]
    hits = F.flatten(F.filter(F.array(*per_rule), lambda a: a.isNotNull()))
    rows = (
        files.select(*key, *[v.alias(f"_{name}") for name, v in views.items()])
        .withColumns({f"_low_{name}": F.lower(f"_{name}") for name in views if any(r.view == name and needed_word(r.pattern) for r in rules)})
        .select(*key, F.explode(hits).alias("h"))
        .select(*key, "h.*")
        .repartition(*([] if parts is None else [parts]), *key)
    )
    so_far = Window.partitionBy(*key, "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap_len") + F.col("m_len")).over(so_far)
    line = F.sum(F.col("gap_nl") + F.col("m_nl")).over(so_far) - F.col("m_nl") + 1
    return rows.select(
        *key,
        "rule",
        *[f"g{n + 1}" for n in range(width)],
        (end - F.col("m_len")).cast("int").alias("start"),
        end.cast("int").alias("end"),
        line.cast("int").alias("line"),
        *["m", "gap"] * texts,
    )


def line_hits(files: DataFrame, pattern: str, must_contain: str, groups: tuple[int, ...], content: str = "content") -> DataFrame:
    """Matches of a pattern that cannot cross a newline: no shuffle at all.

    Returns key, line, i (match number in the line) and g1.. (the capture
    ``groups``), which are found with the match and not by a pattern of their own.
    """
    found = F.arrays_zip(*[F.regexp_extract_all(F.col("x.s"), F.lit(pattern), F.lit(g)).alias(f"g{n}") for n, g in enumerate(groups, start=1)])
    lines = F.filter(
        F.transform(F.split(F.col(content), "\n", -1), lambda s, n: F.struct((n + 1).alias("line"), s.alias("s"))),
        lambda x: x["s"].contains(must_contain),
    )
    return (
        files.filter(F.col(content).contains(must_contain))
        .select(*FILE_KEY, F.explode(lines).alias("x"))
        .select(
            *FILE_KEY,
            F.col("x.line").alias("line"),
            F.posexplode(found).alias("i", "m"),
        )
        .select(*FILE_KEY, "line", "i", *[F.col(f"m.g{n}").alias(f"g{n}") for n in range(1, len(groups) + 1)])
    )


def file_ext(path: Column) -> Column:
    """Lower-case extension of the last path segment, empty without one."""
    name = F.substring_index(path, "/", -1)
    last = F.substring_index(name, ".", -1)
    return F.when((last != "") & (F.length(name) > F.length(last) + 1), F.lower(F.concat(F.lit("."), last))).otherwise(F.substring(path, 1, 0))
