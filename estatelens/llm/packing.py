"""Packing of tokenized documents into sequences along a space-filling curve.

A document's token ids make a hashed count vector of unit length, projected to
``DIMS`` dimensions; its place on the Hilbert curve through them is its key.
Documents are range-sorted by key, so neighbours along the curve share a
partition and mostly a sequence. Each partition is one token stream cut every
``LENGTH`` tokens; its last sequence is cut into powers of two, so nothing is
padded. Equal keys are split by doc_id, so many copies spread over tasks.

Defined cases: null text is empty, so such a document is its end id alone; a
null doc_id sorts first; repeated rows are documents of their own; an empty
table gives no pieces. Extra columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.words import WordHasher, byte_codes, pieces_of, tidy
from estatelens.session import stored

LENGTH = 2048
END_ID = 1
HASHED = 1024
DIMS, BITS = 3, 16
CACHED_WORDS = 500_000
#: One word to the tokenizer, lower-cased by Python as by it, and in normal form already.
LATIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


def default_tokenizer() -> str:
    """The public word tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Token ids of many texts, for tokenizers that drop white space and lower-case: each distinct unit is encoded once and cached.

    A unit is a word, cut where one of ``.,!?;:`` follows an ASCII letter or
    digit: the tokenizer ends a token in both places whatever stands around.
    New units are encoded as one text, with a special token between them. Units
    of Latin letters alone are one word whose case is all there is to normalize,
    so they go to the vocabulary's merges without the search for word ends; their
    last tokens carry the word end.
    """

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.end_id = end_id
        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.merges = Tokenizer.from_file(path) if suffix else None
        if suffix:
            self.merges.normalizer = None
            self.merges.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
            self.word_end = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
            self.word_end[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        special = self.tokenizer.get_added_tokens_decoder()
        self.mark_id = min(special)
        self.mark = special[self.mark_id].content
        self.special = [t.content.encode() for t in special.values()]
        self.hashers = WordHasher(), WordHasher()
        self.hashers[1].codes = byte_codes()  # case matters to special tokens
        ascii_ = [chr(i) if i < 128 else " " for i in range(256)]
        self.alnum = np.array([c.isalnum() for c in ascii_])
        self.punctuation = np.array([c in ".,!?;:" for c in ascii_])
        self._clear()

    def _clear(self) -> None:
        self.keys, self.rows = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)  # sorted hashes of known units, their numbers
        self.start, self.size = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.flat, self.used = np.zeros(1 << 18, dtype=np.uint32), 0

    def _encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and how many each has."""
        if not units:
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        if any(s.decode() in "".join(units) for s in self.special):
            each = [e.ids for e in self.tokenizer.encode_batch(units, add_special_tokens=False)]
            return np.array([i for ids in each for i in ids], dtype=np.uint32), np.array(list(map(len, each)))
        ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(units)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        marks = np.flatnonzero(ids == self.mark_id)
        return np.delete(ids, marks), np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """:func:`_encoded` of units of Latin letters."""
        if not words:
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        ids = np.array(self.merges.encode_batch_fast([" ".join(words).lower()], add_special_tokens=False)[0].ids, dtype=np.uint32)
        return ids, np.diff(np.concatenate([[-1], np.flatnonzero(self.word_end[ids])]))

    def _learn(self, keys: np.ndarray, units: list[str]) -> np.ndarray:
        """Keeps the ids of new units, whose sorted hashes are ``keys``; their numbers."""
        plain = np.array([bool(self.merges and LATIN_WORD(u)) for u in units], dtype=bool)
        letters, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        (ids, sizes), (rest, more) = self._merged([units[i] for i in letters.tolist()]), self._encoded([units[i] for i in others.tolist()])
        ids, sizes = np.concatenate([ids, rest]), np.concatenate([sizes, more])
        at, n = len(self.keys), len(keys)
        if at + n > len(self.start):
            self.start, self.size = (np.resize(x, 2 * (at + n)) for x in (self.start, self.size))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.size[at : at + n] = sizes
        self.start[at : at + n] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        number = np.empty(n, dtype=np.int64)
        number[np.concatenate([letters, others])] = np.arange(at, at + n)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, place, keys), np.insert(self.rows, place, number)
        return number

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        buffer = b" ".join([b"", *texts, b""])
        hasher = self.hashers[any(s.lower() in buffer.lower() for s in self.special)]
        data = np.frombuffer(buffer, dtype=np.uint8)
        word = ~hasher.space[data]
        cut = np.append(False, self.alnum[data[:-1]] & self.punctuation[data[1:]])
        starts = np.flatnonzero(word & np.append(False, cut[1:] | ~word[:-1]))
        ends = np.flatnonzero(word & np.append(cut[1:] | ~word[1:], True)) + 1
        first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        kinds, example, kind = np.unique(hasher.hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > CACHED_WORDS:
            self._clear()
        row = np.full(len(kinds), -1, dtype=np.int64)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, kinds), len(self.keys) - 1)
            known = self.keys[place] == kinds
            row[known] = self.rows[place[known]]
        new = np.flatnonzero(row < 0)
        if len(new):
            units = [buffer[a:b].decode("utf-8", "replace") for a, b in zip(starts[example[new]].tolist(), ends[example[new]].tolist(), strict=True)]
            row[new] = self._learn(kinds[new], units)
        each = row[kind]
        size = self.size[each]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.flat[np.repeat(self.start[each] - (stop - size), size) + np.arange(total)]
        at = np.concatenate([[0], stop])[first]
        return [np.append(ids[a:b], np.uint32(self.end_id)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The place of integer points (one row each) on the Hilbert curve, by the transpose form of the index."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    gray = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        gray ^= np.where((x[-1] & (1 << b)) != 0, (1 << b) - 1, 0)
    x ^= gray
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(documents: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents given by their token ids."""
    project = np.random.default_rng(11).normal(size=(HASHED, DIMS))
    counts = np.stack([np.bincount(ids * np.uint32(2654435761) >> np.uint32(22), minlength=HASHED) for ids in documents]).astype(np.float64)
    flat = np.tanh((counts / np.linalg.norm(counts, axis=1, keepdims=True)) @ project)
    return hilbert(((flat + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64), BITS)


def tokenize(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, curve key and token ids (little-endian 16 or 32 bits, as ``wide`` says) of every whole text."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordTokenizer(path)
        for rows, texts in pieces_of(batches, limit=1 << 19):
            ids = encode(texts)
            keys = np.concatenate([curve_keys(ids[i : i + 256]) for i in range(0, len(ids), 256)])
            wide = [bool(len(x) and x.max() > 0xFFFF) for x in ids]
            packed = [x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(ids, wide, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(keys), pa.array(packed, pa.binary()), pa.array(wide)], ["doc_id", "key", "ids", "wide"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, key long, ids binary, wide boolean")


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(tokens: DataFrame, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence; with ``keep_ids`` its ids too, as little-endian 32-bit numbers."""
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange(parts, "key", "doc_id", "tie").sortWithinPartitions("key", "doc_id", "tie").drop("tie", "key")
    names = [*NAMES, *["ids"] * keep_ids]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * len(NAMES) + [pa.binary()]
        columns = list(zip(*rows, strict=True))
        if not keep_ids:
            columns = columns[:-1]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds[: len(columns)], strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # pieces of the open sequence: doc_id, start, ids, tokens of the document
        filled = 0

        def closed(pieces: list[tuple]) -> Iterator[tuple]:
            nonlocal sequence
            offset = 0
            for doc_id, start, ids, total in pieces:
                raw = ids.astype("<u4").tobytes()
                yield doc_id, start, len(ids), zlib.crc32(raw), total, sequence, offset, raw if keep_ids else None
                offset += len(ids)
            sequence += 1

        for rows in batches:
            out: list[tuple] = []
            for doc_id, raw, wide in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                ids = np.frombuffer(raw, dtype="<u4" if wide else "<u2")
                at = 0
                while at < len(ids):
                    take = min(length - filled, len(ids) - at)
                    held.append((doc_id, at, ids[at : at + take], len(ids)))
                    at, filled = at + take, filled + take
                    if filled == length:
                        out += closed(held)
                        held, filled = [], 0
            if out:
                yield batch(out)
        # The rest falls into sequences of powers of two: its binary digits, largest first.
        out = []
        while filled:
            room = 1 << (filled.bit_length() - 1)
            filled -= room
            own = []
            while room:
                doc_id, start, ids, total = held.pop(0)
                own.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    held.insert(0, (doc_id, start + room, ids[room:], total))
                room -= len(own[-1][2])
            out += closed(own)
        if out:
            yield batch(out)

    schema = ", ".join(f"{n} long" for n in NAMES) + ", ids binary" * keep_ids
    return line.mapInArrow(tidy(run), schema)


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Stored: the range exchange reads its input twice, and tokens are dear to make.
    return pack(stored(tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


QUERIES = {"op6_pack_sequences": op6_pack_sequences}
ORACLE: dict[str, str] = {}
