"""Alignment of two tokenizers' tokens over the same bytes, and counts of the id pairs they link.

Both tokenizers cut the bytes of a space and the text; a document's tokens are
known by their byte ends. Groups lie between ends that both share. Most tokens
pair one to one, so the walk compares stretches of the two end arrays at the
current index shift, doubling the stretch while it agrees and halving it when
it does not; where ends differ it steps through one irregular group, which
gives the shift of the next stretch. Within a group every step links the two
tokens that overlap there.

Documents are handled in slices of bounded bytes. A slice sends each distinct
id pair once, with the number of its documents that link it; Spark sums these
over the corpus, finds each first id's greatest count, and sends the answers
back to the slice, where each document adds up its own links.

Defined cases: null and empty texts, and texts whose tokens do not spell a space
and the text, have no tokens: zeros and an empty digest. Every row is a document
of its own, so repeated rows count repeatedly; a null doc_id stays null. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatelens.llm.words import WordHasher, byte_codes, pieces_of
from estatelens.session import stored

#: Text bytes of one slice; a longer text is a slice of its own.
SLICE_BYTES = 1 << 21
#: Longer runs of white space go to the library that reads them without recursion.
LONG_SPACE = re.compile(r"\s{1000}")
#: Units and tokens that a task remembers, and units encoded in one call.
KNOWN_UNITS, KNOWN_TOKENS, ROW = 500_000, 1 << 22, 256


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself where printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


#: A text's ids by either tokenizer, and the ends of its tokens in bytes.
Tokens = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class TokenPair:
    """Tokens of both tokenizers for many texts, checked against their bytes; each distinct unit is encoded once and remembered.

    A unit starts at a space after a byte that is sure to end no white space.
    There both tokenizers start a token whatever stands around: the first cuts
    words before their space, and no piece of the second goes on past one.
    """

    def __init__(self, byte_path: str, piece_path: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(byte_path)
        self.library.encode_special_tokens = True
        alphabet = byte_alphabet()
        special = set(self.library.get_added_tokens_decoder())
        entries = {i: bytes(map(alphabet.__getitem__, t)) for t, i in self.library.get_vocab().items() if i not in special}
        self.fast = tiktoken.Encoding("entries", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in entries.items()}, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        n = self.pieces.get_piece_size()
        self.a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.b_bytes = [bytes([int(self.pieces.id_to_piece(i)[3:5], 16)]) if self.pieces.is_byte(i) else self.pieces.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.a_size, self.b_size = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        self.a_name, self.b_name = [str(i) for i in range(len(self.a_bytes))], [str(i) for i in range(n)]
        self.separable = not any("▁" in self.pieces.id_to_piece(i).lstrip("▁") for i in range(n))
        # The last bytes of wide white space are 80 to 8A, 9F, A0, A8, A9 and AF.
        self.solid = np.array([32 < i != 127 and not 0x7F < i < 0x8B and i not in (0x9F, 0xA0, 0xA8, 0xA9, 0xAF) for i in range(256)])
        self.hasher = WordHasher()
        self.hasher.codes = byte_codes()
        self._clear()

    def _clear(self) -> None:
        self.keys, self.rows = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)  # sorted hashes of known units, their numbers
        self.spelt = np.zeros(0, dtype=bool)
        self.ids = [np.zeros(0, dtype=np.int64)] * 2
        self.start, self.size = [np.zeros(0, dtype=np.int64)] * 2, [np.zeros(0, dtype=np.int64)] * 2

    def _alone(self, unit: str) -> tuple[list[int], list[int], bool]:
        """Ids of one unit, and whether they spell it."""
        if LONG_SPACE.search(unit):
            a = self.library.encode(unit, add_special_tokens=False).ids
        else:
            a = self.fast.encode_ordinary(unit)
        # The space before a text is added by the second tokenizer itself, but not to an empty one.
        b = self.pieces.encode(unit[1:], num_threads=1) if len(unit) > 1 else [self.pieces.piece_to_id("▁")]
        whole = unit.encode()
        return a, b, b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))

    def _in_rows(self, units: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]] | None:
        """Ids of all units one after the other, and how many each has, by either tokenizer; none if they do not spell the units."""
        texts = [b"".join(units[i : i + ROW]).decode("utf-8", "replace") for i in range(0, len(units), ROW)]
        ids = list(chain.from_iterable(map(self.fast.encode_ordinary, texts))), list(chain.from_iterable(self.pieces.encode([t[1:] for t in texts], num_threads=1)))
        whole, ends = b"".join(units), np.cumsum(list(map(len, units)))
        out, sizes = [], []
        for own, size, spelling in zip(ids, (self.a_size, self.b_size), (self.a_bytes, self.b_bytes), strict=True):
            if b"".join(map(spelling.__getitem__, own)) != whole:
                return None
            out.append(np.array(own, dtype=np.int64))
            last = np.searchsorted(np.cumsum(size[out[-1]]), ends)
            sizes.append(np.diff(np.concatenate([[-1], last])))
        return out, sizes

    def _learn(self, keys: np.ndarray, units: list[bytes]) -> np.ndarray:
        """Remembers new units, whose sorted hashes are ``keys``; their numbers."""
        row = np.array([self.separable and self.solid[u[-1]] and len(u) < 1000 for u in units], dtype=bool)
        told = self._in_rows([u for u, r in zip(units, row.tolist(), strict=True) if r]) if row.any() else None
        if told is None:
            row[:] = False
        rest = [self._alone(units[i].decode("utf-8", "replace")) for i in np.flatnonzero(~row).tolist()]
        order = np.concatenate([np.flatnonzero(row), np.flatnonzero(~row)])
        n = len(self.keys)
        for side in (0, 1):
            more = np.array([len(x[side]) for x in rest], dtype=np.int64)
            new = [*([told[0][side]] if told else []), np.array(list(chain.from_iterable(x[side] for x in rest)), dtype=np.int64)]
            size = np.concatenate([*([told[1][side]] if told else []), more])
            self.start[side] = np.concatenate([self.start[side], len(self.ids[side]) + np.cumsum(size) - size])
            self.size[side] = np.concatenate([self.size[side], size])
            self.ids[side] = np.concatenate([self.ids[side], *new])
        self.spelt = np.concatenate([self.spelt, np.ones(int(row.sum()), dtype=bool), np.array([x[2] for x in rest], dtype=bool)])
        number = np.empty(len(units), dtype=np.int64)
        number[order] = np.arange(n, n + len(units))
        place = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, place, keys), np.insert(self.rows, place, number)
        return number

    def __call__(self, texts: list[bytes]) -> Iterator[Tokens]:
        """The tokens of each text; none for texts that are empty or that a tokenizer does not spell."""
        if len(self.keys) > KNOWN_UNITS or max(map(len, self.ids)) > KNOWN_TOKENS:
            self._clear()
        buffer = b" " + b" ".join([b"", *texts])
        data = np.frombuffer(buffer, dtype=np.uint8)
        sizes = np.array([len(t) + 1 for t in texts])
        edges = 1 + np.concatenate([[0], np.cumsum(sizes)])
        begins = np.zeros(len(data), dtype=bool)
        begins[1:] = (data[1:] == 32) & self.solid[data[:-1]]
        begins[edges[:-1]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        first = np.searchsorted(starts, edges)
        kinds, example, kind = np.unique(self.hasher.hashes(data, starts, ends), return_index=True, return_inverse=True)
        row = np.full(len(kinds), -1, dtype=np.int64)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, kinds), len(self.keys) - 1)
            known = self.keys[place] == kinds
            row[known] = self.rows[place[known]]
        new = np.flatnonzero(row < 0)
        if len(new):
            row[new] = self._learn(kinds[new], [buffer[a:b] for a, b in zip(starts[example[new]].tolist(), ends[example[new]].tolist(), strict=True)])
        each = row[kind]
        wrong = np.concatenate([[0], np.cumsum(~self.spelt[each])])
        sides = []
        for side, bytes_of in ((0, self.a_size), (1, self.b_size)):
            size = self.size[side][each]
            stop = np.cumsum(size)
            ids = self.ids[side][np.repeat(self.start[side][each] - (stop - size), size) + np.arange(stop[-1])]
            sides.append((ids, np.cumsum(bytes_of[ids]), np.concatenate([[0], stop])[first]))
        (a, a_ends, a_at), (b, b_ends, b_at) = sides
        for n, text in enumerate(texts):
            if text and wrong[first[n]] == wrong[first[n + 1]]:
                own, other = slice(a_at[n], a_at[n + 1]), slice(b_at[n], b_at[n + 1])
                a_before, b_before = (x[s.start - 1] if s.start else 0 for x, s in ((a_ends, own), (b_ends, other)))
                yield a[own], b[other], a_ends[own] - a_before, b_ends[other] - b_before
            else:
                yield a[:0], b[:0], a_ends[:0], b_ends[:0]


#: (straight, first and end index in the first list, first and end index in the second).
Stretch = tuple[bool, int, int, int, int]


def stretches(a: list[int], b: list[int]) -> tuple[list[Stretch], list[int], list[int]]:
    """Consecutive stretches of two lists of increasing ends with the same last one, and the indices of all token pairs whose bytes overlap, in order.

    A straight stretch pairs its tokens one to one; any other is a single group.
    """
    out: list[Stretch] = []
    left: list[int] = []
    right: list[int] = []
    i = j = 0
    n = len(a)
    while i < n:
        x, y = i, j
        if a[i] == b[j]:
            shift, step = j - i, 1
            i += 1
            while a[i : i + step] == b[i + shift : i + shift + step] and i < n:
                i += step
                step *= 2
            while step > 1 and i < n:
                step //= 2
                if a[i : i + step] == b[i + shift : i + shift + step]:
                    i += step
            i = min(i, n)
            j = i + shift
            out.append((True, x, i, y, j))
            left.extend(range(x, i))
            right.extend(range(y, j))
        else:
            end, other = a[i], b[j]
            while end != other:
                left.append(i)
                right.append(j)
                if end < other:
                    i += 1
                    end = a[i]
                else:
                    j += 1
                    other = b[j]
            left.append(i)
            right.append(j)
            i += 1
            j += 1
            out.append((False, x, i, y, j))
    return out, left, right


def group_text(parts: list[Stretch], a: list[str], b: list[str]) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    out: list[str] = []
    for straight, i, i2, j, j2 in parts:
        if straight:
            out.extend(map("|".join, zip(a[i:i2], b[j:j2], strict=True)))
        else:
            out.append(f"{','.join(a[i:i2])}|{','.join(b[j:j2])}")
    return ";".join(out)


def _paths(byte_tokenizer: str | None, piece_tokenizer: str | None) -> tuple[str, str]:
    import public_tokenizers

    return byte_tokenizer or public_tokenizers.path("byte_bpe_50k.json"), piece_tokenizer or public_tokenizers.path("piece_bpe_32k.model")


def alignments(docs: DataFrame, byte_tokenizer: str | None = None, piece_tokenizer: str | None = None) -> DataFrame:
    """doc_id, both tokenizers' ids, and for each group the end of its ids in either list and its end in bytes."""
    paths = _paths(byte_tokenizer, piece_tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = TokenPair(*paths)
        for rows, texts in pieces_of(batches):
            out = []
            for a, b, a_ends, b_ends in pair(texts):
                a_list = a_ends.tolist()
                cuts = [(x, y) for straight, i, i2, j, j2 in stretches(a_list, b_ends.tolist())[0] for x, y in (zip(range(i + 1, i2 + 1), range(j + 1, j2 + 1), strict=True) if straight else [(i2, j2)])]
                out.append((a, b, [x for x, _ in cuts], [y for _, y in cuts], [a_list[x - 1] for x, _ in cuts]))
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, pa.list_(pa.int32())) for c in columns)], ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends", "byte_ends"])

    ints = ", ".join(f"{n} array<int>" for n in ("a_ids", "b_ids", "a_ends", "b_ends", "byte_ends"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {ints}")


_MADE = "slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, kinds binary, times binary, pairs array<long>, documents array<int>"
_NAMES = [f.split()[0] for f in _MADE.split(", ")]
_KINDS = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]


def _narrow(x: np.ndarray) -> bytes:
    """Numbers with their width in bytes before them."""
    kind = "<u2" if not len(x) or x.max() <= 0xFFFF else "<u4"
    return kind[2].encode() + x.astype(kind).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[:1].decode()}", offset=1).astype(np.int64)


def _repeats(times: np.ndarray) -> bytes:
    """Which kinds are linked more than once, and how often."""
    more = np.flatnonzero(times > 1)
    return np.array([len(more)], dtype="<u4").tobytes() + more.astype("<u4").tobytes() + times[more].astype("<u4").tobytes()


def _times(raw: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(raw, dtype="<u4").astype(np.int64)
    out = np.ones(n, dtype=np.int64)
    out[x[1 : 1 + x[0]]] = x[1 + x[0] :]
    return out


def aligned(docs: DataFrame, byte_tokenizer: str | None = None, piece_tokenizer: str | None = None) -> DataFrame:
    """A row per document with its digests and packed links, and a row per slice (``pairs`` not null) with its distinct id pairs."""
    paths = _paths(byte_tokenizer, piece_tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = TokenPair(*paths)
        number = TaskContext.get().partitionId() << 32
        for rows, texts in pieces_of(batches, limit=SLICE_BYTES):
            out, own = [], []
            for doc_id, (a, b, a_ends, b_ends) in zip(rows.column(0).to_pylist(), pair(texts), strict=True):
                parts, left, right = stretches(a_ends.tolist(), b_ends.tolist())
                linked = a[np.array(left, dtype=np.int64)] << 32 | b[np.array(right, dtype=np.int64)]
                kinds, times = np.unique(linked, return_counts=True)
                text = group_text(parts, list(map(pair.a_name.__getitem__, a.tolist())), list(map(pair.b_name.__getitem__, b.tolist())))
                groups = sum(i2 - i if straight else 1 for straight, i, i2, _, _ in parts)
                out.append((number, doc_id, len(a), len(b), groups, len(left), hashlib.sha256(text.encode()).hexdigest() if len(a) else ""))
                own.append((kinds, times))
            pairs, place = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
            held = np.split(place, np.cumsum([len(k) for k, _ in own])[:-1])
            columns = [*zip(*out, strict=True), [_narrow(x) for x in held], [_repeats(t) for _, t in own], [None] * len(own), [None] * len(own)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)
            if len(pairs):
                met = pa.array([pairs], _KINDS[-2]), pa.array([np.bincount(place).astype(np.int32)], _KINDS[-1])
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.nulls(1, k) for k in _KINDS[1:-2]), *met], _NAMES)
            number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _MADE)


def pair_counts(made: DataFrame) -> DataFrame:
    """pair (first id * 2**32 + second id), n (documents that link it) and best (n is the greatest of the first id)."""
    seen = made.filter("pairs IS NOT NULL").select(F.inline(F.arrays_zip("pairs", "documents")))
    counts = seen.groupBy(F.col("pairs").alias("pair")).agg(F.sum("documents").alias("n"))
    first = Window.partitionBy(F.shiftright("pair", 32))
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(first)).alias("best"))


def score_links(docs: DataFrame, byte_tokenizer: str | None = None, piece_tokenizer: str | None = None) -> DataFrame:
    """Per document its tokens, groups and links, how many links are their first id's most frequent, and the sum of their counts."""
    made = stored(aligned(docs, byte_tokenizer, piece_tokenizer))
    asked = made.filter("pairs IS NOT NULL").select(F.col("slice").alias("home"), F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(pair_counts(made), "pair").select("home", "at", "n", "best")
    rows = made.filter("pairs IS NULL").drop("pairs", "documents")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def total(own: pa.Table, answers: pa.Table) -> pa.Table:
        at = answers.column("at").to_numpy()
        n, best = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        n[at], best[at] = answers.column("n").to_numpy(), answers.column("best").to_numpy()
        sums, bests = [], []
        for kinds, times in zip(own.column("kinds").to_pylist(), own.column("times").to_pylist(), strict=True):
            k = _wide(kinds)
            t = _times(times, len(k))
            sums.append(int((n[k] * t).sum()))
            bests.append(int((best[k] * t).sum()))
        return own.select(kept).append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return rows.groupBy("slice").cogroup(answers.groupBy("home")).applyInArrow(total, schema)


def op13_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_links(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_align_tokens": op13_align_tokens}
ORACLE: dict[str, str] = {}
