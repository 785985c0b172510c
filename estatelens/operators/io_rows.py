"""The shape of input/output hits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(*parts) -> Column:
    """Concatenation of literals (str) and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def hit(direction: str, category: str, description: Column) -> Column:
    return F.struct(
        F.lit(direction).alias("direction"), F.lit(category).alias("category"), description.alias("description")
    )


def nothing() -> Column:
    return F.lit(None).cast("struct<direction:string,category:string,description:string>")


def io_seq(lang: int, step: Column, pos: Column, sub: Column | None = None) -> Column:
    """Discovery order: general rules (0) before Go rules (1), then path or step first."""
    path, step, pos = F.col("path"), step.cast("int"), pos.cast("int")
    sub = (F.lit(0) if sub is None else sub).cast("int")
    group = F.lit(0) if lang == 0 else step
    return F.struct(
        F.lit(lang).alias("lang"),
        group.alias("pass"),
        path.alias("path"),
        step.alias("step"),
        pos.alias("pos"),
        sub.alias("sub"),
    )


IO_COLS = ["project_id", "direction", "category", "description", "path", "seq"]
