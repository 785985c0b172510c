"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Vectors of unit length are centred, rotated into balanced binary codes
(alternating between codes and the rotation that fits them best), and each
code is cut into chunks. A table per chunk finds vectors whose chunk differs in
at most one bit; pairs within a Hamming radius are then compared as they are,
by cosine in double precision. The number of rotations follows from the chunk
width and from the cosine that a pair at the threshold has after centring, so that a pair at the threshold is met with a
probability of 0.999 if bits err independently.

The mean and rotations are learned from at most ``MOST_SAMPLED`` vectors, the
first in hash order, of each dimension; every vector is indexed and searched.

Vectors with equal numbers are one for the search, with their count, so large
groups of copies cost nothing. Defined cases: a null vector, one with a null,
infinite or not-a-number component, without components or of zero length links
with nothing; vectors of each dimension are searched by themselves; a null vec_id is a vector of its own that
others cannot name; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.components import components
from estatelens.session import stored

COSINE = 0.9
MOST_SAMPLED = 20_000
ROUNDS = 30
MISSED = 0.001
#: Members of a bucket that one task pairs with each other; larger buckets are dealt into blocks.
BLOCK = 1000


def rotation(sample: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """A projection to ``bits`` balanced signs: principal directions, turned to fit their own codes."""
    rng = np.random.default_rng(seed)
    _, vectors = np.linalg.eigh(sample.T @ sample)
    main = vectors[:, ::-1][:, :bits]
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    flat = sample @ main
    for _ in range(ROUNDS):
        codes = np.where(flat @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ flat)
        turn = (left @ right).T
    return main @ turn


class Codes:
    """Mean and rotations; codes of ``tables`` chunks of ``width`` bits from ``rotations`` rotations."""

    def __init__(self, sample: np.ndarray, vectors: int, cosine: float = COSINE) -> None:
        self.dim = sample.shape[1]
        self.bits = min(64, self.dim)
        self.width = max(1, min(self.bits, max(8, min(24, math.ceil(math.log2(max(2, vectors)))))))
        self.mean = sample.mean(axis=0)
        # A pair keeps its distance when the mean goes, but not its lengths: the shortest in a hundred count.
        left = max(1e-9, float(np.quantile(((sample - self.mean) ** 2).sum(axis=1), 0.01)))
        centred = min(cosine, 1 - (1 - cosine) / left)
        # Where vectors all lie near their mean, too little would be left: they are taken as they are.
        if centred < 0.5:
            centred, self.mean = cosine, np.zeros(self.dim)
        err = math.acos(centred) / math.pi
        met = (1 - err) ** self.width + self.width * err * (1 - err) ** (self.width - 1)
        self.chunks = max(1, self.bits // self.width)
        wanted = math.ceil(math.log(MISSED) / math.log(max(1e-9, 1 - met))) if met < 1 else 1
        self.rotations = max(1, math.ceil(wanted / self.chunks))
        #: Bits of a code that may differ: the mean at the threshold and four deviations.
        self.radius = min(self.bits, math.ceil(self.bits * err + 4 * math.sqrt(self.bits * err * (1 - err))))
        self.turns = np.concatenate([rotation(sample - self.mean, self.bits, s) for s in range(self.rotations)], axis=1)

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        """One signed 64-bit code per rotation."""
        signs = ((unit - self.mean) @ self.turns >= 0).reshape(len(unit), self.rotations, self.bits)
        weights = np.uint64(1) << np.arange(self.bits, dtype=np.uint64)
        return (signs * weights).sum(axis=2, dtype=np.uint64).view(np.int64)


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _norm_free(batch: pa.RecordBatch, at: int, dim: int) -> np.ndarray:
    flat = np.asarray(batch.column(at).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    # Scaled first, so that very large or small components keep their direction.
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def near_vectors(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = given.filter(_usable(F.col("v")))
    # -0.0 and 0.0 are one number.
    good = good.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    whole = stored(good.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}))
    kinds = stored(whole.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")).withColumn("key", F.xxhash64("h1", "h2")))
    dims = kinds.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").collect()
    whole_rows = whole.select("vec_id", "h1", "h2").join(kinds.select("h1", "h2", "rep", "copies", "key"), ["h1", "h2"]).select("vec_id", "rep", "copies", "key")
    searched = []
    for dim, rows in dims:
        alike = kinds.filter(F.size("v") == dim)
        sample = np.array(alike.select("v").orderBy("key").limit(MOST_SAMPLED).toArrow().column("v").to_pylist())
        searched.append(stored(_pairs(alike, sample, rows, dim, cosine)))
    found = reduce(DataFrame.unionByName, searched) if searched else None
    if found is None:
        ends = degree = None
    else:
        ends = found.select("a", "b", "cb").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("ca").alias("cb")))
        degree = ends.groupBy("a").agg(F.sum("cb").alias("others"))
    spread = whole_rows.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    if found is not None:
        at = kinds.select("key", "rep").filter("rep IS NOT NULL")
        spread = spread.unionByName(found.select("a", "b").join(at.toDF("a", "ra"), "a").join(at.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    groups = components(spread)
    links = whole_rows.select("vec_id", "copies", "key").join(degree, whole_rows["key"] == degree["a"], "left") if degree is not None else whole_rows.withColumn("others", F.lit(None).cast("long"))
    linked = links.select("vec_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    alone = given.filter(~_usable(F.col("v"))).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    every = linked.unionByName(alone)
    return every.join(groups, every["vec_id"] == groups["id"], "left").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _pairs(kinds: DataFrame, sample: np.ndarray, rows: int, dim: int, cosine: float) -> DataFrame:
    """Pairs (a, b, ca, cb) of distinct vectors' keys and copies with at least the cosine."""
    peak = np.abs(sample).max(axis=1, keepdims=True)
    unit = sample / peak
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    codes = Codes(unit, rows, cosine)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codes(_norm_free(batch, 1, dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(own), pa.list_(pa.int64()))], ["key", "codes"])

    coded = stored(kinds.select("key", "v").mapInArrow(encode, "key long, codes array<long>"))
    mask = (1 << codes.width) - 1
    tables = F.explode(F.array(*[F.struct(F.lit(r * codes.chunks + c).alias("t"), F.col("codes")[r].alias("code"), F.shiftrightunsigned(F.col("codes")[r], c * codes.width).bitwiseAND(F.lit(mask)).alias("chunk")) for r in range(codes.rotations) for c in range(codes.chunks)]))
    indexed = stored(coded.select("key", tables.alias("x")).select("key", "x.*"))
    # Buckets over a block are dealt into blocks; a probe meets every block of its bucket.
    big = indexed.groupBy("t", "chunk").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > BLOCK).select("t", "chunk", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    base = indexed.join(big, ["t", "chunk"], "left").withColumn("block", F.pmod(F.col("key"), F.coalesce("blocks", F.lit(1))).cast("int")).select("t", "chunk", "block", F.col("key").alias("b"), F.col("code").alias("cb"))
    flips = F.array(*map(F.lit, [0, *[1 << i for i in range(codes.width)]]))
    probes = indexed.select("t", F.col("key").alias("a"), F.col("code").alias("ca"), F.explode(F.transform(flips, lambda f: F.col("chunk").bitwiseXOR(f.cast("long")))).alias("chunk"))
    probes = probes.join(big, ["t", "chunk"], "left").select("t", "chunk", "a", "ca", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"))
    met = probes.join(base, ["t", "chunk", "block"]).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))) <= codes.radius))
    candidates = met.select("a", "b").distinct()
    left, right = kinds.select(F.col("key").alias("a"), F.col("copies").alias("ca"), F.col("v").alias("va")), kinds.select(F.col("key").alias("b"), F.col("copies").alias("cb"), F.col("v").alias("vb"))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dot = np.einsum("ij,ij->i", _norm_free(batch, 4, dim), _norm_free(batch, 5, dim))
            yield batch.filter(pa.array(dot >= cosine)).select(["a", "b", "ca", "cb"])

    return candidates.join(left, "a").join(right, "b").select("a", "b", "ca", "cb", "va", "vb").mapInArrow(rerank, "a long, b long, ca long, cb long")


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op1_near_vectors": op1_near_vectors}
ORACLE: dict[str, str] = {}
