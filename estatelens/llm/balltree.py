"""Exact ranked lexical search by inner products over sparse ball trees.

A document is a sparse vector of whole-number term values, a query one of term
weights; a score is their inner product in 64-bit integers. Queries come in
blocks of bounded size: a block's distinct terms are broadcast, one pass counts
terms and documents, and a second pass builds a ball tree over every few
thousand documents of a task. A ball is a centroid and a radius; no document in
it scores above the query's product with the centroid plus radius times the
length of the query on the ball's terms, all rounded up. Trees are searched
best ball first, and a ball goes unread once its bound is below the query's
worst kept score; documents of the leaves are scored exactly. The scores kept by
a task serve as the bar for its next trees.

Equal vectors of one tree are one point with its least ids, as many as a query
can return. Each task returns that many rows per query at most; they are cut
down in two steps, so no task holds a query's rows of all tasks.

Defined cases: null and empty texts have no terms and are in no count; every row
is a document, or a query, of its own; equal scores go by ascending doc_id, null
last; empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatelens.llm.words import WordHasher, pieces_of
from estatelens.session import stored

TOP = 20
#: Term occurrences of one block of queries.
BLOCK_TERMS = 1 << 18
#: Documents, and values of them, of one tree; points of one leaf.
TREE_DOCS, TREE_VALUES, LEAF = 8192, 1 << 21, 32
#: Relative room for rounding in sums of doubles.
ROOM = 1e-9

Sparse = tuple[np.ndarray, np.ndarray]


class TermHasher(WordHasher):
    """Hashes terms: runs of ASCII letters and digits and of all characters above ASCII, A-Z lower-cased."""

    def __init__(self) -> None:
        super().__init__()
        self.space = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def query_terms(items: DataFrame) -> DataFrame:
    """item (a number for each row), item_id and the hashes of its terms, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, item = TermHasher(), TaskContext.get().partitionId() << 32
        for rows, texts in pieces_of(batches):
            terms, first = hasher.words(texts)
            own = [x.view(np.int64) for x in np.split(terms, first[1:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(range(item, item + len(texts)), pa.int64()), rows.column(0), pa.array(own, pa.list_(pa.int64()))], ["item", "item_id", "terms"])
            item += len(texts)

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item long, item_id long, terms array<long>")


def query_blocks(asked: DataFrame) -> Iterator[list[tuple[int, int | None, np.ndarray]]]:
    """The queries in blocks of at most ``BLOCK_TERMS`` term occurrences (at least one query), one block at a time."""
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    held: list[tuple[int, int | None, np.ndarray]] = []
    size = 0
    for r in asked.repartition(max(1, -(-total // BLOCK_TERMS)), "item").toLocalIterator():
        if held and size + len(r.terms) > BLOCK_TERMS:
            yield held
            held, size = [], 0
        held.append((r.item, r.item_id, np.array(r.terms, dtype=np.int64).view(np.uint64)))
        size += len(r.terms)
    if held:
        yield held


_HELD = "doc_id long, n long, terms binary, times binary, documents long, words long, seen array<int>, seen_in array<int>"
_HELD_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]


def term_counts(docs: DataFrame, vocabulary) -> DataFrame:
    """Documents that hold a term of the broadcast vocabulary, with these terms' places and counts; and rows (``documents`` not null) of sums over a stretch of documents."""
    names = [f.split()[0] for f in _HELD.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _HELD_KINDS, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = TermHasher(), vocabulary.value
        for rows, texts in pieces_of(batches):
            terms, first = hasher.words(texts)
            at = np.minimum(np.searchsorted(known, terms), max(0, len(known) - 1))
            found = known[at] == terms if len(known) else np.zeros(len(terms), dtype=bool)
            sizes = np.diff(first)
            out, all_seen = [], []
            for doc_id, lo, hi in zip(rows.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                own, times = np.unique(at[lo:hi][found[lo:hi]], return_counts=True)
                if len(own):
                    out.append((doc_id, hi - lo, own.astype("<u4").tobytes(), times.astype("<u4").tobytes(), None, None, None, None))
                    all_seen.append(own)
            seen, seen_in = np.unique(np.concatenate([*all_seen, np.zeros(0, dtype=np.int64)]), return_counts=True)
            out.append((None, None, None, None, int((sizes > 0).sum()), int(sizes.sum()), seen, seen_in))
            yield batch(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _HELD)


class Ball:
    """A set of points around a centroid: a leaf, or two balls."""

    def __init__(self, centroid: Sparse, radius: float, points: np.ndarray | None, parts: tuple[Ball, ...] = ()) -> None:
        self.centroid, self.radius, self.points, self.parts = centroid, radius, points, parts

    def bound(self, query: np.ndarray) -> float:
        """No point in the ball has a greater product with the (non-negative) query."""
        own = query[self.centroid[0]]
        return (own @ self.centroid[1] + math.sqrt(own @ own) * self.radius) * (1 + ROOM) + 1


class BallTree:
    """Ball tree over sparse points of non-negative whole numbers, none of them without a value."""

    def __init__(self, points: list[Sparse], dims: int, leaf: int = LEAF) -> None:
        self.dims, self.leaf = dims, leaf
        self.sizes = np.array([len(i) for i, _ in points])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.index = np.concatenate([i for i, _ in points])
        self.value = np.concatenate([v for _, v in points])
        self.double = self.value.astype(np.float64)
        self.square = np.add.reduceat(self.double * self.double, self.starts)
        self.root = self._ball(np.arange(len(points)))

    def _spread(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the points' values lie, and where each point starts among them."""
        size = self.sizes[points]
        first = np.cumsum(size) - size
        return np.repeat(self.starts[points] - first, size) + np.arange(size.sum()), first

    def _products(self, points: np.ndarray, with_: np.ndarray) -> np.ndarray:
        at, first = self._spread(points)
        return np.add.reduceat(with_[self.index[at]] * self.double[at], first)

    def _dense(self, point: int) -> np.ndarray:
        out = np.zeros(self.dims)
        own = slice(self.starts[point], self.starts[point] + self.sizes[point])
        out[self.index[own]] = self.double[own]
        return out

    def _ball(self, points: np.ndarray) -> Ball:
        at, _ = self._spread(points)
        mean = np.bincount(self.index[at], weights=self.double[at], minlength=self.dims) / len(points)
        length = mean @ mean
        square = self.square[points]
        far = square - 2 * self._products(points, mean) + length + ROOM * (square + length)
        radius = math.sqrt(max(0.0, far.max())) * (1 + ROOM)
        support = np.flatnonzero(mean)
        centroid = support, mean[support] * (1 + ROOM)
        if len(points) <= self.leaf:
            return Ball(centroid, radius, points)
        # Two points far apart; the halves nearer to one and to the other.
        one = points[far.argmax()]
        near_one = square - 2 * self._products(points, self._dense(one))
        other = points[near_one.argmax()]
        near_other = square - 2 * self._products(points, self._dense(other))
        order = points[np.argsort(near_one - near_other, kind="stable")]
        half = len(order) // 2
        return Ball(centroid, radius, None, (self._ball(order[:half]), self._ball(order[half:])))

    def scores(self, points: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact products with a query of whole numbers."""
        at, first = self._spread(points)
        return np.add.reduceat(query[self.index[at]] * self.value[at], first)

    def search(self, query: np.ndarray, best: list[tuple[int, int]], top: int, ids: list[list[int]]) -> int:
        """Puts the points' ids into the heap of the ``top`` (score, -id) so far; the number of points scored.

        ``query`` is dense. Equal scores of a lesser id still enter, so a ball
        is left only when its bound is below the worst kept score.
        """
        doubles, scored, n = query.astype(np.float64), 0, 0
        balls = [(-self.root.bound(doubles), 0, self.root)]
        while balls:
            bound, _, ball = heapq.heappop(balls)
            if len(best) == top and -bound < best[0][0]:
                break
            for part in ball.parts:
                n += 1
                heapq.heappush(balls, (-part.bound(doubles), n, part))
            if ball.points is not None:
                scored += len(ball.points)
                for p, score in zip(ball.points.tolist(), self.scores(ball.points, query).tolist(), strict=True):
                    if score <= 0 or (len(best) == top and score < best[0][0]):
                        continue
                    for i in ids[p]:
                        if len(best) < top:
                            heapq.heappush(best, (score, -i))
                        elif (score, -i) > best[0]:
                            heapq.heapreplace(best, (score, -i))
                        else:
                            break
        return scored


#: Stands for a null doc_id: after all others.
NO_ID = 1 << 63


def _searched(held: DataFrame, told, top: int) -> DataFrame:
    """item, item_id, doc_id and score of each task's best documents for every query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, documents, words, items = told.value
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        ids: dict[bytes, list[int]] = {}
        points: list[Sparse] = []
        seen = values = 0

        def search() -> None:
            if not points:
                return
            tree, own = BallTree(points, dims), [sorted(x)[:top] for x in ids.values()]
            query = np.zeros(dims, dtype=np.int64)
            for (_, _, at, weight), heap in zip(items, best, strict=True):
                query[at] = weight
                tree.search(query, heap, top, own)
                query[at] = 0

        for rows in batches:
            for doc_id, n, terms, times in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                index, tf = np.frombuffer(terms, dtype="<u4").astype(np.int64), np.frombuffer(times, dtype="<u4").astype(np.int64)
                m = 100 - 25 + (25 * n * documents) // words
                value = (1_000_000_000 * tf) // (1000 * tf + 12 * m)
                same = ids.setdefault(terms + value.tobytes(), [])
                same.append(NO_ID if doc_id is None else doc_id)
                if len(same) == 1:
                    points.append((index, value))
                    values += len(index)
                elif len(same) > 4 * top:
                    same[:] = sorted(same)[:top]
                seen += 1
                if seen >= TREE_DOCS or values >= TREE_VALUES:
                    search()
                    ids.clear()
                    points.clear()
                    seen = values = 0
        search()
        out = [(item, item_id, None if -i == NO_ID else -i, score) for (item, item_id, _, _), heap in zip(items, best, strict=True) for score, i in heap]
        for lo in range(0, len(out), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[lo : lo + (1 << 16)], strict=True)], ["item", "item_id", "doc_id", "score"])

    return held.select("doc_id", "n", "terms", "times").mapInArrow(run, "item long, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` documents (doc_id, text) for every query (item_id, text)."""
    spark = docs.sparkSession
    found = []
    for block in query_blocks(stored(query_terms(items))):
        known = np.unique(np.concatenate([t for _, _, t in block]))
        held = stored(term_counts(docs, spark.sparkContext.broadcast(known)))
        sums = held.filter("documents IS NOT NULL")
        all_ = sums.agg(F.sum("documents").alias("documents"), F.sum("words").alias("words")).first()
        if not all_["words"]:
            continue
        # One row per term of the block at most.
        holders = np.zeros(len(known), dtype=np.int64)
        for r in sums.select(F.inline(F.arrays_zip("seen", "seen_in"))).groupBy("seen").agg(F.sum("seen_in").alias("df")).toLocalIterator():
            holders[r.seen] = r.df
        weight = np.array([math.floor(1000 * math.log((2 * all_["documents"] + 2) / (2 * df + 1))) for df in holders.tolist()], dtype=np.int64)
        asked = []
        for item, item_id, terms in block:
            at, times = np.unique(np.searchsorted(known, terms), return_counts=True)
            asked.append((item, item_id, at, weight[at] * times))
        told = spark.sparkContext.broadcast((len(known), all_["documents"], all_["words"], asked))
        found.append(stored(_searched(held.filter("documents IS NULL"), told, top)))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    hits = reduce(DataFrame.unionByName, found)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for key in (["item", F.pmod(F.xxhash64("doc_id"), F.lit(64))], ["item"]):
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= top)
    return hits.select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

QUERIES = {"op11_ranked_search": op11_ranked_search}
ORACLE = {
    "op11_ranked_search": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n_all, CAST(sum(len(t)) AS BIGINT) AS l_all FROM d),
tf AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d),
c AS (SELECT r, doc_id, n, term, count(*) AS tf FROM tf GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * max(n_all) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM c, s GROUP BY term),
q AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
sc AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_all) // l_all)))) AS BIGINT) AS score
  FROM q JOIN c USING (term) JOIN w USING (term), s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM k WHERE rank <= 20
"""
}
