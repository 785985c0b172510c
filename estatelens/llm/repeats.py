"""Removal of long byte strings that occur more than once, by suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere
else, in the same text or another, goes. Equal strings are brought together
without comparing texts with each other:

1. Each window of ``LENGTH`` bytes is led by its least hashed k-gram (its
   anchor), so equal windows have equal anchors wherever they stand. Windows
   in a row with one anchor make a piece, and an anchor met once cannot repeat.
2. Equal pieces of an anchor become one with its number of copies; windows of
   a piece with copies repeat. If an anchor also has a piece without a copy,
   those of its pieces that share what stands left or right of the anchor with
   another (as far as half a window) go to shards, an anchor's together.
3. Of a shard's pieces stays what can repeat: windows around a string of the
   anchor that another piece has in the same place. This is one text: its
   suffix array is built by induced sorting, and a window repeats if its
   permuted common prefix with either neighbour in the array reaches ``LENGTH``.
4. An anchor with more than ``LARGEST_ANCHOR`` bytes of different pieces does
   not fit a shard; its windows are counted by 128-bit hash instead, spread
   over all tasks.

Results go back to every place of a piece. Where a number of words is given,
strings of so many whole words that occur more than once are found too, whatever
their bytes: windows of words meet by an anchor of words as in 1 and 2, and those of
an anchor's different pieces are counted by 128-bit hash as in 4. Defined cases: null text is empty
and stays null in the text column; texts shorter than ``LENGTH`` lose nothing;
repeated rows and equal texts count as copies of each other; a null doc_id is
an id like others; an empty table gives no rows. Extra columns are kept, those
named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatelens.llm.suffixes import repeated_starts
from estatelens.llm.words import BASE, BASE_INVERSE, WordHasher, byte_codes, mixed, pieces_of, powers, tidy
from estatelens.session import small_side, stored

LENGTH = 400
GRAM = 32
SHARD_BYTES = 1 << 19
LARGEST_ANCHOR = 1 << 20
#: A longer text is read in sections that share LENGTH - 1 bytes.
SECTION = 1 << 22
#: Text bytes searched for pieces at once: numbers of eight bytes each stay near the core.
AT_ONCE = 1 << 17
#: Strings around an anchor that tell which windows of a piece can repeat.
STEPS = 16
_PLACE_BITS = 24


class Anchors:
    """Pieces of texts: places of equal windows' anchors."""

    def __init__(self, length: int, gram: int, anchors_only: bool = False) -> None:
        self.length, self.gram, self.anchors_only = length, gram, anchors_only
        self.codes = byte_codes(21)
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def totals(self, data: np.ndarray) -> np.ndarray:
        """Running sums from which the hash of any stretch follows."""
        if len(self.up) <= len(data):
            self.up, self.down = powers(BASE, 2 * len(data) + 1), powers(BASE_INVERSE, 2 * len(data) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.codes[data] * self.up[: len(data)], dtype=np.uint64)])

    def gram_hashes(self, data: np.ndarray, gram: int) -> np.ndarray:
        total = self.totals(data)
        m = len(data) - gram + 1
        return mixed((total[gram:] - total[:m]) * self.down[:m])

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Text, first window, number of windows, anchor, content hash and both sides (see :func:`_side`) of each piece."""
        import xxhash

        sections = []  # text, first byte, bytes
        for i, t in enumerate(texts):
            sections += [(i, at, t[at : at + SECTION + self.length - 1]) for at in range(0, max(1, len(t) - self.length + 1), SECTION)] if len(t) >= self.length else []
        out = []
        at = 0
        while at < len(sections):
            size, to = len(sections[at][2]), at + 1
            while to < len(sections) and size + len(sections[to][2]) <= SECTION + self.length:
                size, to = size + len(sections[to][2]), to + 1
            out.append(self._pieces(sections[at:to], xxhash.xxh3_64_intdigest))
            at = to
        if not out:
            return tuple(np.empty(0, dtype=np.int64) for _ in range(7))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _pieces(self, sections: list[tuple[int, int, bytes]], digest) -> tuple[np.ndarray, ...]:
        buffer = b"".join(s[2] for s in sections)
        data = np.frombuffer(buffer, dtype=np.uint8)
        total = self.totals(data)
        m = len(data) - self.gram + 1
        hashes = mixed((total[self.gram :] - total[:m]) * self.down[:m])
        least = (hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(hashes), dtype=np.uint64)
        width, have = self.length - self.gram + 1, 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: have - width], least[width - have :])
        sizes = np.array([len(s[2]) for s in sections])
        begin = np.cumsum(sizes) - sizes
        windows = sizes - self.length + 1
        section = np.repeat(np.arange(len(sections)), windows)
        start = np.arange(len(section)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[section]
        anchor = (least[start] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (section[1:] != section[:-1])]))
        count = np.diff(np.append(new, len(start)))
        if self.anchors_only:
            return (hashes[anchor[new]].view(np.int64),) * 7
        first, own = start[new], section[new]
        view = memoryview(buffer)
        content = np.array([digest(view[a:b]) for a, b in zip(first.tolist(), (first + count + self.length - 1).tolist(), strict=True)], dtype=np.uint64)
        text = np.array([s[0] for s in sections])[own]
        at, half = anchor[new], (self.length - self.gram) // 2
        sides = []
        for lo, there in ((at - half, at - half >= first), (at + self.gram, at + self.gram + half <= first + count + self.length - 1)):
            lo = np.where(there, lo, 0)
            sides.append(_side((total[lo + half * there] - total[lo]) * self.down[lo], there))
        return text, first - begin[own] + np.array([s[1] for s in sections])[own], count, hashes[at].view(np.int64), content.view(np.int64), *sides


def _side(hashes: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Hashes of what stands next to each anchor, as far as half of what a window has besides it; 0 where the piece is shorter there.

    Equal windows have their anchor at the same place, and on one side of it at
    least half of the rest, so their pieces share that side.
    """
    return np.where(there, mixed(hashes) | np.uint64(1), np.uint64(0)).view(np.int64)


def pieces_in(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Every piece of every text: id and tie of its row, first window, number of windows, anchor, content hash and sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        for rows, texts in pieces_of(batches, limit=AT_ONCE):
            text, *numbers = anchors(texts)
            columns = [rows.column(0).take(pa.array(text)), rows.column(1).take(pa.array(text)), *map(pa.array, numbers)]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_tie", "first", "windows", "anchor", "content", "left", "right"])

    kinds = ", ".join(f"{n} long" for n in ("_id", "_tie", "first", "windows", "anchor", "content", "left", "right"))
    return docs.select(*_identity(docs), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), kinds)


def anchors_in(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The anchor of every piece of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram, True)
        for _, texts in pieces_of(batches, limit=AT_ONCE):
            yield pa.RecordBatch.from_arrays([pa.array(anchors(texts)[0])], ["anchor"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "anchor long")


def _meeting(pieces: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those pieces (stored) whose anchor is met more than once, and for each such anchor whether its pieces differ.

    Most anchors are met once, so their pieces are made again rather than kept.
    """
    again = small_side(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"))
    kept = stored(pieces.join(again, "anchor"))
    differ = kept.groupBy("anchor").agg((F.min("content") != F.max("content")).alias("differ"))
    return kept, differ


def _of_one(*columns: str) -> list[Column]:
    """Where one of equal pieces stands: firsts are of the same row, and unlike the least struct they are hashed, not sorted."""
    return [F.first(c).alias(c) for c in columns]


def _of_rows(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The documents (with ``_id`` and ``_tie``) that are, or are not, among ``rows``: by ids alone, so that no other text moves."""
    return docs.join(small_side(rows.select("_id", "_tie").distinct()), ["_id", "_tie"], how)


def _unsure(distinct: DataFrame) -> DataFrame:
    """The different pieces of each anchor that has one without a copy, as far as they share a side with another: only these can hold equal windows beyond copies."""
    differing = distinct.filter("differ")
    alone = differing.groupBy("anchor").agg(F.min("copies").alias("fewest")).filter("fewest = 1").select("anchor")
    open_ = stored(differing.join(alone, "anchor"))
    shared = None
    for side in ("left", "right"):
        many = open_.filter(F.col(side) != 0).groupBy("anchor", side).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor", side)
        own = open_.join(many, ["anchor", side], "left_semi").select("anchor", "content")
        shared = own if shared is None else shared.unionByName(own)
    return stored(open_.join(shared.distinct(), ["anchor", "content"], "left_semi"))


def _identity(docs: DataFrame) -> list[Column]:
    """A row by id and text; rows equal in both have the same result."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_tie")]


def _cut(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of pieces: ``wanted`` has one row per text with an array of (first, windows, anchor, content, copies)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces_of(batches):
            out = [(p["anchor"], p["content"], p["copies"], p["windows"], t[p["first"] : p["first"] + p["windows"] + length - 1]) for t, ps in zip(texts, rows.column(1).to_pylist(), strict=True) for p in ps]
            kinds = [pa.int64()] * 4 + [pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["anchor", "content", "copies", "windows", "bytes"])

    wanted = stored(wanted)
    met = _of_rows(docs.select(*_identity(docs), "text"), wanted, "left_semi").join(wanted, ["_id", "_tie"]).select("text", "pieces")
    return met.mapInArrow(tidy(run), "anchor long, content long, copies long, windows long, bytes binary")


_FOUND = "anchor long, content long, lo long, hi long"


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last place of each run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)


def _may_repeat(data: np.ndarray, begin: np.ndarray, size: np.ndarray, windows: np.ndarray, anchor: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last window of each piece (of ``data``) that another piece of its anchor can hold too.

    Equal windows have the same bytes on both sides of their anchor. They are
    told apart by how many stand left of it, in ``STEPS``: those of a step have
    a string around the anchor in common, so the piece's other windows stay out.
    """
    anchors = Anchors(length, gram)
    hashes, total = anchors.gram_hashes(data, gram).view(np.int64), anchors.totals(data)
    many = size - gram + 1
    own = np.repeat(np.arange(len(begin)), many)
    place = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + begin[own]
    hit = np.flatnonzero(hashes[place] == anchor[own])
    at = place[hit[np.unique(own[hit], return_index=True)[1]]]  # an anchor is the first of its kind in its piece
    steps = max(1, min(STEPS, length - gram))
    bounds = np.arange(steps + 1) * (length - gram) // steps
    lo, hi = at[:, None] - bounds[:-1], at[:, None] + length - bounds[1:]
    there = (lo >= begin[:, None]) & (hi <= (begin + size)[:, None])
    lo, hi = np.where(there, lo, 0), np.where(there, hi, 0)
    key = mixed((total[hi] - total[lo]) * anchors.down[lo]) ^ mixed(anchor.view(np.uint64)[:, None] + np.arange(steps, dtype=np.uint64))
    _, which, count = np.unique(key.ravel(), return_inverse=True, return_counts=True)
    shared = there & (count[which].reshape(key.shape) > 1)
    first = np.where(shared, (at - begin)[:, None] - bounds[1:], windows[:, None]).min(axis=1)
    last = np.where(shared, (at - begin)[:, None] - bounds[:-1], -1).max(axis=1)
    return np.maximum(first, 0), np.minimum(last + 1, windows)


def _in_shards(cut: DataFrame, shards: int, length: int, gram: int = GRAM) -> DataFrame:
    """Runs of repeated windows (lo..hi, exclusive) of each piece, from the suffix array of its shard."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.select(["anchor", "content", "windows", "bytes"]).to_pylist()
        rows = list({(r["anchor"], r["content"]): r for r in rows}.values())
        size = np.array([len(r["bytes"]) for r in rows])
        anchor, windows = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("anchor", "windows"))
        every = np.frombuffer(b"".join(r["bytes"] for r in rows), dtype=np.uint8)
        first, past = (x.tolist() for x in _may_repeat(every, np.cumsum(size) - size, size, windows, anchor, length, gram))
        met = [(r["anchor"], r["content"], a, b, r["bytes"][a : b + length - 1]) for r, a, b in zip(rows, first, past, strict=True) if a < b]
        again = repeated_starts(np.frombuffer(b"\0".join(m[4] for m in met), dtype=np.uint8), length) if met else None
        out, at = [], 0
        for anchor, content, a, b, part in met:
            lo, hi = _runs(again[at : at + b - a])
            out += [(anchor, content, a + x, a + y) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
            at += len(part) + 1
        return pa.Table.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], names=["anchor", "content", "lo", "hi"])

    return cut.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")).applyInArrow(run, _FOUND)


def _by_hash(cut: DataFrame, length: int) -> DataFrame:
    """The same for anchors with too many different pieces, by counting the hashes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, GRAM)
        other = byte_codes(77)
        for rows, texts in pieces_of(batches, "bytes", 1 << 18):
            for i, t in enumerate(texts):
                data = np.frombuffer(t, dtype=np.uint8)
                one = anchors.gram_hashes(data, length)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(other[data] * anchors.up[: len(data)], dtype=np.uint64)])
                two = mixed((total[length:] - total[: len(one)]) * anchors.down[: len(one)])
                n = len(one)
                columns = [np.full(n, rows.column(0)[i].as_py()), np.full(n, rows.column(1)[i].as_py()), np.arange(n), one.view(np.int64), two.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "content", "at", "h1", "h2"])

    windows = cut.select("anchor", "content", "bytes").mapInArrow(tidy(run), "anchor long, content long, at long, h1 long, h2 long")
    many = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h1", "h2")
    return windows.join(many, ["h1", "h2"]).select("anchor", "content", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """For each text with repeats its row's id and tie, and ``spans``: (lo, hi) byte ranges, which may overlap."""
    places, differ = _meeting(pieces_in(docs, length, gram), anchors_in(docs, length, gram))
    distinct = stored(
        places.groupBy("anchor", "content")
        .agg(F.count(F.lit(1)).alias("copies"), F.first("windows").alias("windows"), F.first("left").alias("left"), F.first("right").alias("right"), *_of_one("_id", "_tie", "first"))
        .join(differ, "anchor")
    )
    unsure = _unsure(distinct)
    size = F.col("windows") + length - 1
    large = unsure.groupBy("anchor").agg(F.sum(size).alias("bytes")).filter(F.col("bytes") > LARGEST_ANCHOR).select("anchor")
    total = unsure.join(large, "anchor", "left_anti").agg(F.sum(size)).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    piece = F.struct("first", "windows", "anchor", "content", "copies")

    def wanted(is_large: bool) -> DataFrame:
        chosen = unsure.join(large, "anchor", "left_semi" if is_large else "left_anti")
        return chosen.groupBy("_id", "_tie").agg(F.collect_list(piece).alias("pieces"))

    found = _in_shards(_cut(docs, wanted(False), length), shards, length, gram)
    if not large.isEmpty():
        found = found.unionByName(_by_hash(_cut(docs, wanted(True), length), length))
    copied = distinct.filter("copies > 1").select("anchor", "content", F.lit(0).cast("long").alias("lo"), F.col("windows").alias("hi"))
    spans = places.join(found.unionByName(copied), ["anchor", "content"]).select("_id", "_tie", F.struct((F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi") + length - 1).alias("hi")).alias("s"))
    return spans.groupBy("_id", "_tie").agg(F.collect_set("s").alias("spans"))


#: Passages are of over 50 words.
PASSAGE_WORDS, PASSAGE_GRAM = 51, 8


class Passages:
    """Windows of whole words and their pieces: as :class:`Anchors`, with words in place of bytes."""

    def __init__(self, words: int, gram: int = PASSAGE_GRAM, anchors_only: bool = False) -> None:
        self.words, self.gram, self.anchors_only = words, gram, anchors_only
        self.one, self.two = WordHasher(), WordHasher()
        self.one.codes, self.two.codes = byte_codes(21), byte_codes(77)  # letters keep their case

    def sections(self, texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
        """Batches of (text, first byte, bytes); the sections of a long text share all but one word of a window."""
        batch: list[tuple[int, int, bytes]] = []
        size = 0
        for i, t in enumerate(texts):
            if len(t) > SECTION:
                _, starts, ends, _ = self.one.spans([t])
                for at in range(0, max(0, len(starts) - self.words + 1), SECTION // 8):
                    lo, hi = starts[at] - 1, ends[min(at + SECTION // 8 + self.words - 2, len(ends) - 1)] - 1
                    yield [(i, int(lo), t[lo:hi])]
                continue
            if batch and size + len(t) > SECTION:
                yield batch
                batch, size = [], 0
            batch.append((i, 0, t))
            size += len(t)
        if batch:
            yield batch

    def windows(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """The joined texts, first and past-last byte of each word, and of each window its text and first word; where each text begins."""
        buffer, starts, ends, first = self.one.spans(texts)
        many = np.maximum(np.diff(first) - self.words + 1, 0)
        text = np.repeat(np.arange(len(texts)), many)
        word = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + first[:-1][text]
        begin = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1]
        return np.frombuffer(buffer, dtype=np.uint8), starts, ends, text, word, begin

    def pieces(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Text, first and past-last byte, anchor and content hash and sides of each piece."""
        import xxhash

        data, starts, ends, text, word, begin = self.windows(texts)
        if not len(word):
            return tuple(np.empty(0, dtype=np.int64) for _ in range(7))
        m = len(starts) - self.gram + 1
        hashes = self.one.hashes(data, starts[:m], ends[self.gram - 1 :])
        least = (hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(m, dtype=np.uint64)
        width, have = self.words - self.gram + 1, 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: have - width], least[width - have :])
        anchor = (least[word] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
        if self.anchors_only:
            return (hashes[anchor[new]].view(np.int64),) * 7
        last = np.append(new[1:], len(word)) - 1
        lo, hi, own = starts[word[new]], ends[word[last] + self.words - 1], text[new]
        view = memoryview(data)
        content = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], dtype=np.uint64)
        at, half = anchor[new], (self.words - self.gram) // 2
        lefts, rights = at - half >= word[new], at + self.gram + half <= word[last] + self.words
        one, other = np.where(lefts, at - half, 0), np.where(rights, at + self.gram, 0)
        next_to = self.one.hashes(data, starts[np.concatenate([one, other])], ends[np.minimum(np.concatenate([one, other]) + half - 1, len(ends) - 1)])
        sides = _side(next_to[: len(at)], lefts), _side(next_to[len(at) :], rights)
        return own, lo - begin[own], hi - begin[own], hashes[at].view(np.int64), content.view(np.int64), *sides

    def hashed(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Text, first and past-last byte and both hashes of each window."""
        data, starts, ends, text, word, begin = self.windows(texts)
        lo, hi = starts[word], ends[word + self.words - 1]
        return text, lo - begin[text], hi - begin[text], self.one.hashes(data, lo, hi).view(np.int64), self.two.hashes(data, lo, hi).view(np.int64)


def passage_spans(docs: DataFrame, words: int) -> DataFrame:
    """As :func:`repeated_spans`, of strings of ``words`` whole words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(words)
        for rows, texts in pieces_of(batches, limit=AT_ONCE):
            for batch in passages.sections(texts):
                own, lo, hi, *hashes = passages.pieces([b for _, _, b in batch])
                text, at = np.array([i for i, _, _ in batch])[own], np.array([a for _, a, _ in batch])[own]
                columns = [rows.column(0).take(pa.array(text)), rows.column(1).take(pa.array(text)), *map(pa.array, (lo + at, hi + at, *hashes))]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "_tie", "lo", "hi", "anchor", "content", "left", "right"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(words, anchors_only=True)
        for _, texts in pieces_of(batches, limit=AT_ONCE):
            for batch in passages.sections(texts):
                yield pa.RecordBatch.from_arrays([pa.array(passages.pieces([b for _, _, b in batch])[0])], ["anchor"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(words)
        for rows, texts in pieces_of(batches):
            given = [(p, t[p["lo"] : p["hi"]]) for t, ps in zip(texts, rows.column(1).to_pylist(), strict=True) for p in ps]
            own, lo, hi, one, two = passages.hashed([b for _, b in given])
            anchor, content, copies = (np.array([p[c] for p, _ in given], dtype=np.int64)[own] for c in ("anchor", "content", "copies"))
            yield pa.RecordBatch.from_arrays([*map(pa.array, (anchor, content, copies, lo, hi, one, two))], ["anchor", "content", "copies", "lo", "hi", "h1", "h2"])

    given = docs.select(*_identity(docs), F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{n} long" for n in ("_id", "_tie", "lo", "hi", "anchor", "content", "left", "right"))
    places, differ = _meeting(given.mapInArrow(tidy(cut), kinds), given.select("text").mapInArrow(tidy(meet), "anchor long"))
    distinct = stored(
        places.groupBy("anchor", "content")
        .agg(F.count(F.lit(1)).alias("copies"), F.first("left").alias("left"), F.first("right").alias("right"), *_of_one("_id", "_tie", "lo", "hi"))
        .join(differ, "anchor")
    )
    unsure = _unsure(distinct)
    piece = F.struct("lo", "hi", "anchor", "content", "copies")
    wanted = stored(unsure.groupBy("_id", "_tie").agg(F.collect_list(piece).alias("pieces")))
    windows = _of_rows(given, wanted, "left_semi").join(wanted, ["_id", "_tie"]).select("text", "pieces").mapInArrow(tidy(count), "anchor long, content long, copies long, lo long, hi long, h1 long, h2 long")
    windows = stored(windows.dropDuplicates(["anchor", "content", "lo"]))  # a repeated row meets its pieces again
    many = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h1", "h2")
    # Pieces with copies repeat whole; the others have one place each.
    found = windows.filter("copies = 1").join(many, ["h1", "h2"]).select("anchor", "content", F.col("lo").alias("a"), F.col("hi").alias("b"))
    copied = distinct.filter("copies > 1").select("anchor", "content", F.lit(0).cast("long").alias("a"), (F.col("hi") - F.col("lo")).alias("b"))
    spans = places.join(found.unionByName(copied), ["anchor", "content"]).select("_id", "_tie", F.struct((F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b")).alias("hi")).alias("s"))
    return spans.groupBy("_id", "_tie").agg(F.collect_set("s").alias("spans"))


ADDED = ["kept", "n_bytes", "n_removed", "n_spans", "kept_text"]
PASSAGES = ["n_passages", "n_passage_bytes"]


def _joined(spans: list[dict]) -> list[list[int]]:
    """Ranges as runs, in order and apart."""
    runs: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    return runs


def _without(text: bytes, runs: list[list[int]]) -> bytes:
    """The bytes outside the runs (in order and apart)."""
    edges = [0, *(x for r in runs for x in r), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _whole_characters(text: bytes, lo: int, hi: int) -> list[int]:
    """The part of a run that holds whole characters only."""
    while lo < hi and text[lo] & 0xC0 == 0x80:
        lo += 1
    while lo < hi < len(text) and text[hi] & 0xC0 == 0x80:
        hi -= 1
    return [lo, hi]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int | None = None, cut_passages: bool = True) -> DataFrame:
    """``docs`` with ``kept`` (the remaining bytes), n_bytes, n_removed, n_spans (maximal removed runs) and ``kept_text``.

    ``kept_text`` keeps a character unless all its bytes are removed. With
    ``words`` come n_passages and n_passage_bytes (maximal runs of strings of so
    many whole words that occur more than once), and unless ``cut_passages`` is
    false these strings go too.
    """
    added = [*ADDED, *PASSAGES * (words is not None)]
    docs = docs.drop(*[c for c in added if c in docs.columns])
    names = docs.columns
    # Own columns get names that the table does not have.
    by_id, by_tie, own_spans, own_passages = (next(n for n in (f"_{c}{i}" for i in range(len(names) + 1)) if n not in names) for c in ("id", "tie", "spans", "passages"))
    spans = repeated_spans(docs, length, gram).withColumn("passages", F.expr("CAST(NULL AS array<struct<lo: bigint, hi: bigint>>)"))
    if words is not None:
        found = passage_spans(docs, words).withColumnRenamed("spans", "passages")
        spans = spans.drop("passages").join(found, ["_id", "_tie"], "full")
    spans = stored(spans.select("_id", "_tie", "spans", "passages")).toDF(by_id, by_tie, own_spans, own_passages)
    known = docs.withColumns(dict(zip((by_id, by_tie), _identity(docs), strict=True)))
    # Texts without repeats stay where they are.
    ids = small_side(spans.select(by_id, by_tie))
    met = known.join(ids, [by_id, by_tie], "left_semi").join(spans, [by_id, by_tie])
    rest = known.join(ids, [by_id, by_tie], "left_anti").select(*names, *[F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in (own_spans, own_passages)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces_of(batches):
            out = []
            for t, own, of_words in zip(texts, *(rows.column(len(names) + i).to_pylist() for i in (0, 1)), strict=True):
                own, of_words = own or [], of_words or []
                runs, passages = _joined(own + of_words * cut_passages), _joined(of_words)
                left = _without(t, runs)
                kept_text = _without(t, [_whole_characters(t, *r) for r in runs]).decode("utf-8", "replace")
                out.append((left, len(t), len(t) - len(left), len(runs), kept_text, len(passages), sum(hi - lo for lo, hi in passages))[: len(added)])
            kinds = [pa.binary(), *[pa.int64()] * 3, pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*rows.columns[:-2], *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds[: len(added)], strict=True))], [*names, *added])

    fields = [T.StructField("kept", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ADDED[1:4]), T.StructField("kept_text", T.StringType()), *(T.StructField(c, T.LongType()) for c in PASSAGES)]
    return met.select(*names, own_spans, own_passages).unionByName(rest).mapInArrow(tidy(run), T.StructType([*docs.schema.fields, *fields[: len(added)]]))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Small batches of texts to Python: what batches take outside the heap is not given back.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = remove_repeats(docs, words=PASSAGE_WORDS, cut_passages=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), *PASSAGES)


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLE: dict[str, str] = {}
