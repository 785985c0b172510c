"""Identifier, mode, route, module-path and duration columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelens import rules
from estatelens.functions.text import strip_ws


def clean_ident_schema(c: Column) -> Column:
    """Quotes and brackets off, schema kept."""
    return strip_ws(F.translate(c, "\"`[]'", ""))


def clean_ident(c: Column) -> Column:
    """Quotes and brackets off, only the part after the last dot."""
    return strip_ws(F.substring_index(F.translate(c, "\"`[]'", ""), ".", -1))


def open_reads(mode: Column) -> Column:
    """Whether an ``open`` mode reads."""
    return ~mode.rlike("[wax]") | mode.contains("+")


def open_writes(mode: Column) -> Column:
    """Whether an ``open`` mode writes."""
    return mode.rlike("[wax]") | mode.contains("+")


def _accept(name: Column, shape: str) -> Column:
    parts = F.split(name, r"\.", -1)
    fits = F.forall(parts, lambda p: p.rlike(shape) & ~F.lower(p).isin(rules.TABLE_STOP_WORDS))
    return fits & ((F.size(parts) > 1) | (F.length(name) >= 3))


def accept_table(name: Column) -> Column:
    """Upper-case dotted name without stop words, three characters when bare."""
    return _accept(name, r"\A[A-Z_][A-Z0-9_]*\z")


def accept_proc(name: Column) -> Column:
    """As :func:`accept_table`, in any case."""
    return _accept(name, r"\A[A-Za-z_][A-Za-z0-9_]*\z")


_VERB_ROUTE = r"\A(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS) (.+)\z"


def route_verb(literal: Column) -> Column:
    """The verb of ``VERB path``, else ``ANY``."""
    return F.when(literal.rlike(_VERB_ROUTE), F.regexp_extract(literal, _VERB_ROUTE, 1)).otherwise(F.lit("ANY"))


def route_path(literal: Column) -> Column:
    """The path of ``VERB path``, else the whole literal."""
    return F.when(literal.rlike(_VERB_ROUTE), F.regexp_extract(literal, _VERB_ROUTE, 2)).otherwise(literal)


def module_tail(module: Column) -> Column:
    """Module path without host and organisation when it has three segments."""
    parts = F.split(module, "/", -1)
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 3, 1000000), "/")).otherwise(module)


def binary_name(module: Column) -> Column:
    """Last segment of the module tail; null when empty."""
    return F.nullif(F.element_at(F.split(module_tail(module), "/", -1), -1), F.lit(""))


def parse_duration(c: Column) -> Column:
    """Seconds of ``<integer>[smhd]``; null when malformed."""
    shape = r"(?U)\A\s*(\d+)\s*([smhd]?)\s*\z"
    unit = F.regexp_extract(c, shape, 2)
    factor = (
        F.when(unit == "m", F.lit(60)).when(unit == "h", F.lit(3600)).when(unit == "d", F.lit(86400)).otherwise(F.lit(1))
    )
    return F.when(c.rlike(shape), F.regexp_extract(c, shape, 1).cast("long") * factor)
