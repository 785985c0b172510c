"""Bottom-k fingerprints of documents: the k smallest distinct hashes of their word shingles.

Sketches of parts merge to the sketch of the whole. Two sketches estimate
resemblance and containment, one the distinct shingle count; below k shingles
all three are exact.

Defined cases: null and empty texts, and texts without words, have the empty
fingerprint; two empty ones are alike (1.0), an empty and a full one are not
(0.0). A text with fewer words than a shingle has one shingle. Repeated rows
have equal fingerprints. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from estatelens.llm.words import WordHasher, pieces_of
from estatelens.session import stored

WIDTH = 5
K = 128


def encoded(sketch: np.ndarray) -> str:
    """A sketch as text."""
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    """The sorted hashes of a fingerprint."""
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u8")


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both parts together."""
    return np.union1d(a, b)[:k]


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Distinct shingles: exact below k, else from how dense the k smallest hashes lie."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: the share of the union's sketch that both hold."""
    both = merged(a, b, k)
    if not len(both):
        return 1.0
    return len(np.intersect1d(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True)) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    union = distinct_count(merged(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct_count(a, k))


def sketch_documents(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """doc_id and fingerprint of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for rows, texts in pieces_of(batches):
            prints = [encoded(s[:k]) for s in hasher.shingles(texts, width)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def merge_sketches(prints: DataFrame, key: str, k: int = K) -> DataFrame:
    """One fingerprint per ``key`` (cast to string) from the fingerprints of its parts.

    Each task first merges what it holds, so a key reaches the second step
    with at most one sketch per task and flush, whatever its size.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(map(encoded, held.values()), pa.string())], ["key", "fingerprint"])
            held.clear()
            return out

        for rows in batches:
            for key_, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                sketch = decoded(text or "")
                held[key_] = merged(held[key_], sketch, k) if key_ in held else sketch
            if len(held) > 20_000:
                yield flush()
        if held:
            yield flush()

    def total(group: pa.Table) -> pa.Table:
        sketch = decoded("")
        for text in group.column("fingerprint").to_pylist():
            sketch = merged(sketch, decoded(text), k)
        return pa.table({"key": group.column("key")[:1], "fingerprint": [encoded(sketch)]})

    schema = "key string, fingerprint string"
    keyed = prints.select(prints[key].cast("string").alias("key"), "fingerprint")
    return keyed.mapInArrow(partial, schema).groupBy("key").applyInArrow(total, schema)


def with_edits(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """The fingerprints of each text, of its edited form, and its likeness to that and to the next document.

    Documents run by descending doc_id. They are dealt into ranges of doc_id,
    each sorted by itself; the first document of the following range is added
    at a range's end, so neighbours meet without a global sort in one task.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    # Ranges count downwards: range 0 holds the largest ids.
    part = F.lit(len(cuts)) - F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    rows = rows.withColumn("part", F.coalesce(part, F.lit(len(cuts) + 1)).cast("int"))
    heads = stored(rows.groupBy("part").agg(F.max_by("text", F.struct("doc_id", F.xxhash64("text"))).alias("text"), F.max("doc_id").alias("doc_id")))
    # One row per range: what follows it, and the first of all after the last.
    line = W.partitionBy().orderBy("part")
    nexts = heads.select(
        "part",
        F.coalesce(F.lead("text").over(line), F.first("text").over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("text"),
    )
    mine = rows.select("part", F.lit(0).alias("last"), "doc_id", "text", F.xxhash64("text").alias("tie"))
    ends = nexts.select("part", F.lit(1).alias("last"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("tie"))
    line_up = mine.unionByName(ends).repartitionById(len(cuts) + 2, F.col("part")).sortWithinPartitions("part", "last", F.desc_nulls_last("doc_id"), F.desc("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        held: tuple | None = None
        for rows, texts in pieces_of(batches, limit=1 << 19):
            ids, last = rows.column(2).to_pylist(), rows.column(1).to_pylist()
            strings = [t.decode("utf-8", "surrogatepass") for t in texts]
            prints = [s[:k].copy() for s in hasher.shingles(texts, width)]
            now = list(zip(ids, last, strings, prints, strict=True))
            line = [held, *now] if held else now
            pairs = [(a, b) for a, b in zip(line, line[1:]) if not a[1]]
            held = line[-1]
            edits = []
            for (_, _, text, _), (_, _, follower, _) in pairs:
                half = len(text) // 2
                edits.append((text[: len(text) - half] + follower[:half]).encode("utf-8", "surrogatepass"))
            changed = [s[:k] for s in hasher.shingles(edits, width)] if edits else []
            out = [
                (a[0], len(a[2]), hashlib.sha256(e).hexdigest(), encoded(a[3]), encoded(c), resemblance(a[3], c, k), resemblance(a[3], b[3], k))
                for (a, b), e, c in zip(pairs, edits, changed, strict=True)
            ]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], SCHEMA)

    return line_up.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(SCHEMA, TYPES, strict=True)))


SCHEMA = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
TYPES = ["long", "long", "string", "string", "string", "double", "double"]


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_fingerprints": op8_fingerprints}
ORACLE: dict[str, str] = {}
