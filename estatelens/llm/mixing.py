"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words. A document's expected copies are
target / source size: the whole part is taken for certain, the rest is a
fixed-size sample. Documents of a source are ranked by the odds of a random
number over their inclusion odds, and taken in that order up to the cut that
comes nearest to the words still wanted. Inclusion odds differ by source, and
by document where a ``favour`` column is given.

Defined cases: null text has size 0; a null source is a source of its own and
the last in order; sources without words and an empty table get target 0;
repeated rows are documents of their own with equal random numbers, ordered by
their text's hash. Extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from estatelens.session import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_COPIES = 2
BINS = 1 << 16


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_of(key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone, so reruns agree."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_COPIES) -> DataFrame:
    """``target`` for each row (source, source_size): one row per source, so one window over them all is small.

    Sources in order take the weights in turn and share ``share`` of all
    words. Targets stop at ``most`` times the source, and the excess is shared
    again by weight: sorted by cap over weight, the first source that its
    share does not reach fixes the common level.
    """
    every = W.partitionBy()
    turn = F.array(*map(F.lit, weights))
    ranked = sources.withColumn("_rank", F.row_number().over(every.orderBy(F.col("source").isNull(), "source")))
    ranked = ranked.withColumn("_weight", turn[F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int")])
    ranked = ranked.withColumn("_cap", most * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    order = every.orderBy("_ratio", "_rank")
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("_weight").over(order.rowsBetween(0, W.unboundedFollowing))
    level = (share * F.sum("source_size").over(every) - before) / left
    ranked = ranked.withColumn("_level", level)
    fixed = F.min_by(F.when(F.col("_ratio") >= F.col("_level"), F.col("_level")), F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_rank"))).over(every)
    return ranked.withColumn("target", F.least(F.col("_cap").cast("double"), fixed * F.col("_weight"))).select("source", "source_size", "target")


def drawn(docs: DataFrame, favour: str | None = None, seed: str = "") -> DataFrame:
    """Each document's place in the mix: ``row`` (all its columns), doc_id, size, source_size, target, copies, taken (copies times size) and tie (the hash of its text).

    The cut in Pareto order is found without sorting a source in one task:
    words are summed by source and fine bins of the rank, running sums over
    the bins find the bin of the cut, and only that bin is sorted. Where whole
    copies leave less than half a word nothing is drawn.
    """
    odds = F.lit(1.0) if favour is None else F.greatest(F.coalesce(F.col(favour).cast("double"), F.lit(0.0)), F.lit(1e-9))
    sized = stored(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", odds.alias("odds"), size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumnRenamed("source", "of")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = stored(targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    u = random_of(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["of"]), "left").drop("of")
    certain = rows.filter("rest < 0.5").withColumn("more", F.lit(False))
    rows = rows.filter("rest >= 0.5")
    f = F.least(F.greatest(F.coalesce(F.try_divide("rest", "source_size"), F.lit(0.0)), F.lit(1e-12)), F.lit(1 - 1e-12))
    rows = rows.withColumn("q", (u / (1 - u)) / (F.col("odds") * f / (1 - f)))
    rows = rows.withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS).cast("int"))

    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    run = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    # A source's cut lies in its first bin that passes the rest; all earlier bins are taken whole.
    cut = bins.filter(F.col("before") + F.col("words") > F.col("rest")).groupBy(F.col("source").alias("of")).agg(F.min_by(F.struct("bin", "before"), "bin").alias("cut"))
    rows = rows.join(cut, rows["source"].eqNullSafe(cut["of"]), "left").drop("of")
    at = F.col("cut.bin")
    sure = rows.filter(at.isNull() | (F.col("bin") != at)).withColumn("more", at.isNull() | (F.col("bin") < at))
    inside = W.partitionBy("source").orderBy("q", "doc_id", "tie").rowsBetween(W.unboundedPreceding, -1)
    near = rows.filter(F.col("bin") == at).withColumn("sum", F.col("cut.before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    near = near.withColumn("more", F.col("sum") + F.col("size") / 2 <= F.col("rest")).drop("sum")
    done = certain.unionByName(sure.unionByName(near).drop("q", "bin", "cut"))
    copies = F.col("whole") + F.col("more").cast("long")
    return done.select("row", "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "tie")


ADDED = ["size", "source_size", "target", "copies", "taken"]


def mix(docs: DataFrame, favour: str | None = None, seed: str = "") -> DataFrame:
    """``docs`` without text, with size, source_size, target, copies and taken (copies times size),
    and ``_tie``, the hash of the text, to find a row again. Columns of these names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("text", "_tie", *ADDED)]
    needed = [c for c in docs.columns if c in (*kept, "text", favour)]
    return drawn(docs.select(*needed), favour, seed).select(*[F.col("row")[c].alias(c) for c in kept], *ADDED, F.col("tie").alias("_tie"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
c AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w::DOUBLE, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(w) OVER (ORDER BY 2 * source_size / w::DOUBLE, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level,
    2 * source_size / w::DOUBLE AS ratio FROM r),
t AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), (SELECT level FROM c WHERE ratio >= level ORDER BY ratio, rk LIMIT 1) * w) AS target FROM c),
q AS (
  SELECT d.doc_id, d.size, t.source, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
    (CAST(('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (
  SELECT *, target - whole * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY u, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN before + size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM o
"""

QUERIES = {"op4_mix_sources": op4_mix_sources}
ORACLE = {"op4_mix_sources": ORACLE_SQL}
