"""N-gram Jaccard join by vertical partitioning.

A document's set is its distinct word shingles, known by 64-bit hashes. The
global order of shingles is cut into ranges twice: every document's shingles
are counted range by range in tasks of their own and summed per document, and
the overlap of a candidate pair is counted in each of ``FRAGMENTS`` by itself
and summed per pair.

1. Shingles that no other document has are counted for every document (ranges
   of hashes, packed; a shingle repeated inside a batch is sent once, so a
   shingle of every document reaches a range at most once per batch). A linked
   document has at most a share of 100 - percent of them; all others are done.
2. Equal sets become one.
3. Prefix filter: of a linked pair, the first shingles in global order (as
   many as may be missing, plus one) share one. The sets of a prefix shingle
   hang on one of them; candidate pairs lie in the components of that graph.
4. A task compares the candidate pairs of some components, or of two blocks of
   a large one, and returns the links that connect them: pairs that other
   links connect need none, so a dense group gives no more links than members.

Defined cases: null text and text without words have the empty set and link
with nothing; a text with fewer words than a shingle is one shingle; rows of
one doc_id belong together, and a null doc_id is linked with nothing; an empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from estatelens.llm.components import components
from estatelens.llm.words import WordHasher, pieces_of, tidy
from estatelens.session import stored

WIDTH = 4
#: Linked where percent * union <= 100 * intersection; op10's width and percentage, which callers may set otherwise.
PERCENT = 85
FRAGMENTS = 8
#: Shingles of all sets that one side of a task compares.
BLOCK = 1 << 20
#: Bits of the filter that tells which documents to read again; a full filter only lets more through.
FILTER_BITS = 26

_PACKED = "part int, docs binary, sizes binary, grams binary, again binary, own_docs binary, own_sizes binary, own_again binary"


def _ranges(docs: DataFrame, width: int, parts: int) -> DataFrame:
    """Each batch's shingles by range of hashes: per document those that the batch holds once, and once each the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for rows, texts in pieces_of(batches, limit=1 << 21):
            sets = list(hasher.shingles(texts, width))
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            size = np.array([len(s) for s in sets], dtype=np.uint32)
            grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            order = np.argsort(grams, kind="stable")
            same = grams[order][1:] == grams[order][:-1]
            many = np.zeros(len(grams), dtype=bool)
            many[order] = np.concatenate([same, [False]])[: len(grams)] | np.concatenate([[False], same])[: len(grams)]
            repeated = grams[order][np.concatenate([same, [False]])[: len(grams)] & ~np.concatenate([[False], same])[: len(grams)]]
            known = np.bincount(owner[many], minlength=len(sets)).astype(np.uint32)
            grams, owner = grams[~many], owner[~many]

            def part_of(x: np.ndarray) -> np.ndarray:
                return ((x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)

            part = part_of(grams)
            order = np.argsort(part, kind="stable")
            part, grams, owner = part[order], grams[order].astype(np.uint32), owner[order]
            cut = np.searchsorted(part, np.arange(parts + 1))
            cut_again = np.searchsorted(part_of(repeated), np.arange(parts + 1))
            repeated = repeated.astype(np.uint32)
            home = ids % parts
            out = []
            for p in range(parts):
                mine = owner[cut[p] : cut[p + 1]]
                edge = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(mine) else mine
                count = np.diff(np.concatenate([edge, [len(mine)]])).astype(np.uint32) if len(mine) else np.empty(0, np.uint32)
                at_home = home == p
                own = ids[at_home], size[at_home], known[at_home]
                again = repeated[cut_again[p] : cut_again[p + 1]]
                if len(mine) or len(again) or len(own[0]):
                    out.append((p, *(np.ascontiguousarray(x).tobytes() for x in (ids[mine[edge]], count, grams[cut[p] : cut[p + 1]], again, *own))))
            kinds = [pa.int32()] + [pa.binary()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in _PACKED.split(", ")])

    return docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), _PACKED)


def _joined(group: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(group.column(name).to_pylist()), dtype=kind)


def set_sizes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n (the size of its set) and ``open``: whether few enough of its shingles are its own to have a link.

    A range's task counts how many of each document's shingles others have in
    that range; these partial counts go packed to the documents' tasks and are
    summed there. Rows of one doc_id are open together.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(group: pa.Table) -> pa.Table:
        grams, again = _joined(group, "grams", np.uint32), _joined(group, "again", np.uint32)
        docs_ = np.repeat(_joined(group, "docs", np.int64), _joined(group, "sizes", np.uint32))
        every = np.concatenate([grams, again, again])
        order = np.argsort(every, kind="stable")
        same = every[order][1:] == every[order][:-1]
        many = np.zeros(len(every), dtype=bool)
        if len(every):
            many[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        hit, number = np.unique(docs_[many[: len(grams)]], return_counts=True)
        home = hit % parts
        order = np.argsort(home, kind="stable")
        hit, number, home = hit[order], number[order].astype(np.uint32), home[order]
        cut = np.searchsorted(home, np.arange(parts + 1))
        rows = [(h, hit[cut[h] : cut[h + 1]].tobytes(), number[cut[h] : cut[h + 1]].tobytes(), b"", b"") for h in range(parts) if cut[h] < cut[h + 1]]
        own = _joined(group, "own_docs", np.int64)
        if len(own):
            rows.append((int(own[0] % parts), own.tobytes(), _joined(group, "own_again", np.uint32).tobytes(), own.tobytes(), _joined(group, "own_sizes", np.uint32).tobytes()))
        kinds = [pa.int32()] + [pa.binary()] * 4
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["home", "docs", "again", "own_docs", "own_sizes"])

    def total(group: pa.Table) -> pa.Table:
        own, size = _joined(group, "own_docs", np.int64), _joined(group, "own_sizes", np.uint32).astype(np.int64)
        ids, place, rows = np.unique(own, return_inverse=True, return_counts=True)
        again = np.bincount(np.searchsorted(ids, _joined(group, "docs", np.int64)), weights=_joined(group, "again", np.uint32), minlength=len(ids)).astype(np.int64)
        n = np.bincount(place, weights=size, minlength=len(ids)).astype(np.int64)
        few = (n > 0) & ((100 * (n - again) <= (100 - percent) * n) | (rows > 1))
        return pa.table({"doc_id": own, "n": size, "open": few[place]})

    counted = _ranges(docs, width, parts).groupBy("part").applyInArrow(count, "home int, docs binary, again binary, own_docs binary, own_sizes binary")
    return counted.groupBy("home").applyInArrow(total, "doc_id long, n long, open boolean")


def _places(key: str) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(key), F.lit(j)), F.lit(1 << FILTER_BITS)).cast("int") for j in range(3)]


def may_hold(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of ``doc_id``: 2**FILTER_BITS bits whatever the number of rows."""
    place = ids.select(F.explode(F.array(*_places("doc_id"))).alias("p"))
    words = place.groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, p & 31)")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 5), dtype=np.uint32)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out


def sets_of(docs: DataFrame, ids: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, a 128-bit name of the set, its size and its shingles in global order, for the documents of ``ids`` (and few others)."""
    shared = docs.sparkSession.sparkContext.broadcast(may_hold(ids))  # 8 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hasher, bits = WordHasher(), shared.value
        for batch in batches:
            held = np.ones(batch.num_rows, dtype=bool)
            for name in ("p0", "p1", "p2"):
                p = batch.column(name).to_numpy()
                held &= (bits[p >> 5] >> (p & 31).astype(np.uint32)) & np.uint32(1) > 0
            for rows, texts in pieces_of(iter([batch.filter(pa.array(held))])):
                sets = [np.sort(s.view(np.int64)) for s in hasher.shingles(texts, width)]
                names = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(names, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "name", "n", "grams"]
                )

    given = docs.filter("doc_id IS NOT NULL").withColumns({f"p{j}": p for j, p in enumerate(_places("doc_id"))})
    return given.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "p0", "p1", "p2").mapInArrow(tidy(run), "doc_id long, name binary, n int, grams array<long>").filter("n > 0")


def needed(na: int, nb: int | np.ndarray, percent: int = PERCENT) -> int | np.ndarray:
    """The least overlap of linked sets of these sizes."""
    return -(-percent * (na + nb) // (100 + percent))


class _Groups:
    """Union-find over a task's sets with a label for each, so that many are compared at once; the smaller group takes the other's label."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.members: dict[int, list[int]] = {}

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        a, b = int(self.label[x]), int(self.label[y])
        if a == b:
            return False
        one, other = self.members.pop(a, [a]), self.members.pop(b, [b])
        if len(one) < len(other):
            a, one, other = b, other, one
        self.label[other] = a
        one += other
        self.members[a] = one
        return True


class _Fragments:
    """A task's sets, each cut into ``FRAGMENTS`` of the global order, with small numbers for shingles."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        every = np.concatenate(sets)
        values, self.grams = np.unique(every, return_inverse=True)
        self.held = np.zeros(len(values), dtype=bool)
        edges = np.array([f * (1 << 64) // FRAGMENTS - (1 << 63) for f in range(1, FRAGMENTS)], dtype=np.int64)
        where = np.repeat(np.arange(len(sets)) * FRAGMENTS, self.size) + np.searchsorted(edges, every, "right")
        self.count = np.bincount(where, minlength=len(sets) * FRAGMENTS).reshape(len(sets), FRAGMENTS)
        self.first = (np.cumsum(self.count) - self.count.ravel()).reshape(len(sets), FRAGMENTS)

    def linked(self, x: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Those of ``others`` at or above the similarity to ``x``: a fragment's overlaps are counted for all, and those that can no longer reach theirs end."""
        need = needed(self.size[x], self.size[others], percent)
        total = np.zeros(len(others), dtype=np.int64)
        rest, mine = self.size[others], int(self.size[x])
        for f in range(FRAGMENTS):
            own = self.grams[self.first[x, f] : self.first[x, f] + self.count[x, f]]
            count = self.count[others, f]
            ends = np.cumsum(count)
            if len(own) and ends[-1]:
                self.held[own] = True
                at = np.repeat(self.first[others, f] - ends + count, count) + np.arange(ends[-1])
                hits = np.concatenate([[0], np.cumsum(self.held[self.grams[at]])])
                self.held[own] = False
                total += hits[ends] - hits[ends - count]
            rest, mine = rest - count, mine - len(own)
            on = total + np.minimum(rest, mine) >= need
            others, need, total, rest = others[on], need[on], total[on], rest[on]
            if not len(others):
                break
        return others


def links_among(sets: list[np.ndarray], side: list[int], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect all linked pairs of these sets; where there are two sides, only pairs across them are compared.

    A set is compared at once with all larger ones that share a prefix shingle
    and that no earlier link connects with it: overlaps are counted by
    fragments of the global order and summed per pair.
    """
    order = np.array(sorted(range(len(sets)), key=lambda i: len(sets[i])), dtype=np.int64)
    sets = [sets[i] for i in order]
    fragments, groups, found = _Fragments(sets), _Groups(len(sets)), []
    size, sides = fragments.size, np.asarray(side)[order]
    two_sides = len(set(side)) > 1
    # As the larger set of a pair a set misses at most n - ceil(P n / 100), as the smaller n - ceil(2P n / (100 + P)).
    large = size + (-percent * size // 100) + 1
    small = size + (-2 * percent * size // (100 + percent)) + 1
    grams = np.concatenate([s[:n] for s, n in zip(sets, large.tolist(), strict=True)])
    place = np.repeat(np.arange(len(sets)), large)
    at = np.arange(len(grams)) - np.repeat(np.cumsum(large) - large, large)
    by = np.lexsort((place, grams))
    grams, place, at = grams[by], place[by], at[by]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    ends = np.append(first[1:], len(grams))
    end = np.repeat(ends, ends - first)
    # Places of prefix shingles that a larger set also has in its prefix, by set.
    use = np.flatnonzero((at < small[place]) & (np.arange(len(grams)) + 1 < end))
    use = use[np.argsort(place[use], kind="stable")]
    cut = np.searchsorted(place[use], np.arange(len(sets) + 1))
    like = np.searchsorted(size, 100 * size // percent, "right")  # larger sets from there on are too large
    met = np.zeros(len(sets), dtype=bool)
    for x in np.flatnonzero(np.diff(cut)).tolist():
        for k in use[cut[x] : cut[x + 1]].tolist():
            met[place[k + 1 : end[k]]] = True
        others = np.flatnonzero(met[x + 1 : like[x]]) + x + 1
        met[x + 1 :] = False
        others = others[groups.label[others] != groups.label[x]]
        if two_sides:
            others = others[sides[others] != sides[x]]
        if len(others):
            found += [(int(order[x]), int(order[y])) for y in fragments.linked(x, others, percent).tolist() if groups.join(x, y)]
    return found


def task_of(*columns: str) -> Column:
    """A task's number from a component and two of its blocks."""
    return F.xxhash64(*columns).alias("task")


def linked_sets(sets: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between the keys of ``sets`` (key, doc_id, n, grams) that connect all pairs at or above the similarity.

    Equal sets share a key, and ``reps`` (key, rep, n) names the document whose
    row stands for them: the arrays move once to be picked and once to a task.

    All candidate pairs lie within components of the graph that hangs the sets
    of each prefix shingle on one of them. Small components share tasks. A
    component of more than ``BLOCK`` shingles is cut by set size into blocks,
    and each two blocks of like sizes are a task.
    """
    n = F.col("n").cast("long")
    prefix = stored(sets.select("key", F.explode(F.slice("grams", F.lit(1), (n - F.ceil(percent * n / 100) + 1).cast("int"))).alias("gram")))
    centre = prefix.groupBy("gram").agg(F.min("key").alias("m"), F.max("key").alias("other")).filter("m != other").select("gram", "m")
    joined = components(prefix.join(centre, "gram").filter("key != m").select(F.col("m").alias("a"), F.col("key").alias("b")))

    placed = stored(reps.select("key", "n").join(joined, reps["key"] == joined["id"]).select("key", "n", F.col("component_id").alias("c")))
    total = stored(placed.groupBy("c").agg(F.sum("n").alias("grams")))
    large, little = total.filter(F.col("grams") > BLOCK).select("c"), total.filter(F.col("grams") <= BLOCK).select("c", "grams")
    by_size = placed.join(large, "c").groupBy("c", "n").agg(F.count(F.lit(1)).alias("m"))
    run = W.partitionBy("c").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    by_size = by_size.withColumn("before", F.coalesce(F.sum(F.col("m") * F.col("n")).over(run), F.lit(0)))
    block = F.floor((F.col("before") + F.pmod(F.col("key"), F.col("m")) * F.col("n")) / BLOCK)
    blocks = stored(placed.join(by_size, ["c", "n"]).select("key", "n", "c", block.alias("block")))
    span = blocks.groupBy("c", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    near = span.join(span.toDF("c", "block2", "lo2", "hi2"), "c").filter((F.col("block") <= F.col("block2")) & (100 * F.col("hi") >= percent * F.col("lo2")))
    near = stored(near.select("c", "block", "block2"))
    low = blocks.join(near, ["c", "block"]).select("key", task_of("c", "block", "block2"), F.lit(0).alias("side"))
    high = blocks.join(near.filter("block < block2").toDF("c", "first", "block"), ["c", "block"]).select("key", task_of("c", "first", "block"), F.lit(1).alias("side"))
    few = max(1, -(-(little.agg(F.sum("grams")).first()[0] or 0) // BLOCK))
    alone = placed.join(little.select("c"), "c").select("key", F.pmod(F.xxhash64("c"), F.lit(few)).alias("task"), F.lit(0).alias("side"))

    def run_task(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_pylist()
        arrays = [np.asarray(x) for x in group.column("grams").combine_chunks().to_numpy(zero_copy_only=False)]
        pairs = links_among(arrays, group.column("side").to_pylist(), percent)
        return pa.table({"a": pa.array([keys[x] for x, _ in pairs], pa.int64()), "b": pa.array([keys[y] for _, y in pairs], pa.int64())})

    tasks = alone.unionByName(low).unionByName(high).join(reps.select("key", F.col("rep").alias("doc_id")), "key")
    met = sets.select("key", "doc_id", "grams").join(tasks, ["key", "doc_id"]).select("task", "key", "side", "grams")
    return met.groupBy("task").applyInArrow(run_task, "a long, b long")


def similar_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    counts = stored(set_sizes(docs, width, percent))
    sets = stored(sets_of(docs, counts.filter("open").select("doc_id"), width).withColumn("key", F.xxhash64("name")))
    keyed = stored(sets.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")))
    links = linked_sets(sets, keyed, percent)
    at = keyed.select("key", "rep")
    between = links.join(at.toDF("a", "ra"), "a").join(at.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    copies = sets.select("key", "doc_id").join(at, "key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(between.unionByName(copies))
    rows = counts.select("doc_id", F.col("n").alias("n_shingles"))
    known = rows.join(found, rows["doc_id"] == found["id"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for _, texts in pieces_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in hasher.shingles(texts, width)], pa.int64())], ["n_shingles"])

    none = F.lit(None).cast("long")
    nameless = docs.filter("doc_id IS NULL").select("text").mapInArrow(tidy(sizes), "n_shingles long").select(none.alias("doc_id"), "n_shingles", none.alias("component_id"))
    return known.unionByName(nameless)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 185 * count(*) >= 85 * (a.n + b.n)),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.m, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) m ON m.a = s.doc_id
"""

QUERIES = {"op10_jaccard_join": op10_jaccard_join}
ORACLE = {"op10_jaccard_join": ORACLE_SQL}
