"""Best-fit packing of tokenized documents by local search between underfull bins.

A document is cut only where it is longer than a sequence. Pieces are dealt by
hash into groups of bounded size, whose sizes are alike since the deal is
random. In each group, pieces go largest first to the bin they fit best; then
bins that are not full exchange pieces. The least filled bin gives: it moves a
piece, swaps one for one, two for one or one for two, always so that the other
bin grows and none overflows, which raises the sum of squared fills. Bins that
give all they hold vanish. The search ends when no packing could have fewer
bins, or when no bin can be emptied any more.

What a group leaves in poorly filled bins is dealt anew with that of all other
groups, until one group holds it or it no longer shrinks. Only places and sizes
of pieces move; token ids stay where they were made, unless ids are asked for.

Defined cases: null text is empty, so such a document is its end id alone; every
row is a document of its own, so repeated rows are packed repeatedly; a null
doc_id stays null; an empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.packing import LENGTH, WordTokenizer, default_tokenizer
from estatelens.llm.words import pieces_of
from estatelens.session import stored

END_ID = 0
#: Pieces packed together in one group.
GROUP = 4096
#: Bins filled to a smaller share are dealt anew.
POOR = 15 / 16
#: So many bins in a row that cannot be emptied end the search of a group.
PATIENCE = 64

_PIECE = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = _PIECE + ", sequence_id long, offset long, poor boolean"


def cut(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: row (its number), doc_id, piece, start, length and ids_crc32, with ``keep_ids`` the ids too."""
    path = tokenizer or default_tokenizer()
    names = [f.split()[0] for f in _PIECE.split(", ")] + ["ids"] * keep_ids
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordTokenizer(path, END_ID)
        row = TaskContext.get().partitionId() << 32
        for rows, texts in pieces_of(batches, limit=1 << 19):
            out = []
            for doc_id, ids in zip(rows.column(0).to_pylist(), encode(texts), strict=True):
                raw = ids.astype("<u4").tobytes()
                for n, start in enumerate(range(0, len(ids), length)):
                    own = raw[4 * start : 4 * (start + length)]
                    out.append((row, doc_id, n, start, len(own) // 4, zlib.crc32(own), own)[: len(names)])
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECE + ", ids binary" * keep_ids)


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Indices of pieces by bin: largest first, each into the fullest bin that has room for it."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0  # bit r is set while a bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = rooms >> sizes[i]
        if fits:
            room = sizes[i] + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(bins), length
            bins.append([])
        bins[b].append(i)
        if room := room - sizes[i]:
            with_room[room].append(b)
            rooms |= 1 << room
    return bins


def _pairs(own: list[int], sizes: list[int]) -> dict[int, tuple[int, int]]:
    """Two pieces for each sum that two of them make."""
    return {sizes[x] + sizes[y]: (x, y) for n, x in enumerate(own) for y in own[:n]}


def _exchange(giver: list[int], takers: list[list[int]], sizes: list[int], room: list[int]) -> tuple[int, tuple, tuple] | None:
    """The taker, what the giver gives and what it gets back, for the exchange by which a taker grows most; none if no taker can grow."""
    one = {sizes[x]: (x,) for x in giver}
    two = _pairs(giver, sizes)
    offers = np.array(sorted(one.keys() | two.keys()), dtype=np.int64)
    singles = np.array(sorted(one), dtype=np.int64)
    best = (0, -1, (), ())
    for against, given in ((one | two, offers), (one, singles)):
        # Back comes nothing or one piece for one or two; or two for one.
        back = [(0, t, ()) for t in range(len(takers))] + [(sizes[y], t, (y,)) for t, own in enumerate(takers) for y in own] if given is offers else [(s, t, p) for t, own in enumerate(takers) for s, p in _pairs(own, sizes).items()]
        if not back:
            continue
        worth, place = np.array([s for s, _, _ in back], dtype=np.int64), np.array([room[t] for _, t, _ in back], dtype=np.int64)
        at = np.searchsorted(given, worth + place, "right") - 1
        gain = np.where(at >= 0, given[at] - worth, 0)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = int(gain[k]), back[k][1], against[int(given[at[k]])], back[k][2]
    return best[1:] if best[0] else None


def improved(bins: list[list[int]], sizes: list[int], length: int, patience: int = PATIENCE) -> list[list[int]]:
    """The bins after exchanges between underfull ones; none is fuller than ``length`` and each piece is in one."""
    least = -(-sum(sizes) // length)
    bins = [list(b) for b in bins]
    fill = [sum(sizes[i] for i in b) for b in bins]
    n, stuck, failed = len(bins), set(), 0
    while n > least and failed < patience:
        giver = min((b for b in range(len(bins)) if 0 < fill[b] < length and b not in stuck), key=lambda b: (fill[b], b), default=None)
        if giver is None:
            break
        while fill[giver]:
            others = [b for b in range(len(bins)) if b != giver and fill[giver] <= fill[b] < length]
            found = _exchange(bins[giver], [bins[b] for b in others], sizes, [length - fill[b] for b in others])
            if found is None:
                stuck.add(giver)
                failed += 1
                break
            stuck.clear()  # a bin that could not give before may now
            taker, gives, gets = others[found[0]], *found[1:]
            bins[giver] = [i for i in bins[giver] if i not in gives] + list(gets)
            bins[taker] = [i for i in bins[taker] if i not in gets] + list(gives)
            fill[giver], fill[taker] = (sum(sizes[i] for i in bins[b]) for b in (giver, taker))
        else:
            n, failed = n - 1, 0
    return [b for b in bins if b]


def _solved(length: int, turn: int, last: bool):
    def solve(group: pa.Table) -> pa.Table:
        group = group.sort_by([("row", "ascending"), ("piece", "ascending")])
        sizes = group.column("length").to_pylist()
        part = group.column("part")[0].as_py()
        sequence, offset, poor = (np.zeros(len(sizes), dtype=np.int64) for _ in range(3))
        for b, own in enumerate(improved(best_fit(sizes, length), sizes, length)):
            at = 0
            for i in own:
                sequence[i], offset[i] = (turn << 56) + (part << 20) + b, at
                at += sizes[i]
            poor[own] = not last and at < POOR * length
        names = [n for n in group.column_names if n != "part"]
        out = group.select(names)
        for name, values in (("sequence_id", sequence), ("offset", offset), ("poor", poor.astype(bool))):
            out = out.append_column(name, pa.array(values))
        return out

    return solve


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """The pieces with sequence_id and offset, gapless in each sequence."""
    n, closed = pieces.count(), []
    rest, turn = pieces, 0
    while True:
        groups = max(1, -(-n // GROUP))
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("row", "piece", F.lit(turn)), F.lit(groups)))
        placed = stored(dealt.groupBy("part").applyInArrow(_solved(length, turn, groups == 1), _PLACED))
        left = placed.filter("poor").count() if groups > 1 else 0
        # What does not shrink by half would not by another deal.
        if not left or 2 * left > n:
            closed.append(placed)
            break
        closed.append(placed.filter("NOT poor"))
        rest, n, turn = placed.filter("poor").drop("sequence_id", "offset", "poor"), left, turn + 1
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out.drop("poor")


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stored(cut(spark.read.parquet(f"{sf_dir}/documents.parquet")))).drop("row")


QUERIES = {"op12_best_fit": op12_best_fit}
ORACLE: dict[str, str] = {}
