"""Language-model scores of documents by stupid backoff.

The model is the corpus itself: counts of all n-grams of up to ``order`` words
over all documents, less the document's own. A word scores by its longest
n-gram that other documents have: that n-gram's count over the count of the
n-gram without its last word, times ``BACKOFF`` for each order given up; a
single word scores its count over all words, with one half for a word no other
document has. A document's score is the sum of logarithms over its words; its
first words have shorter n-grams only.

Relationally: documents are dealt into homes of bounded bytes by hash, each
home is exploded to its distinct n-grams with their counts, these are dealt by
range of their hash to count tables, and the sums come back to the home, where
each document takes off its own counts and adds up. N-grams travel packed: per
home and range their hashes in order, so that sums return in the same order
without the hashes. A frequent n-gram reaches its range once per home.

Defined cases: null and empty texts, and texts without words, have no words
and score 0; rows of one doc_id and text are documents of their own with equal
scores; a null doc_id is an id like others; an empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.mixing import size_of
from estatelens.llm.words import BASE, WordHasher, as_bytes, mixed

BACKOFF = 0.4
ORDER = 3
#: Bytes of an n-gram's hash that travel; the range tells the rest. Ranges grow in number with the corpus, so about three n-grams in a million share them with another at any size.
HASH_BYTES = 5
#: Text bytes of a home, and n-grams of a range before those of a home are merged, about.
HOME_BYTES, RANGE_GRAMS = 12 << 20, 6 << 20
#: Text bytes hashed at once.
CHUNK_BYTES = 1 << 18


def _word_hashes(texts: list[bytes], hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts, and the number of words of each text."""
    hashes, sizes = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    lo = size = 0
    for hi, t in enumerate([*texts, b""], 1):
        size += len(t) + 1
        if size > CHUNK_BYTES or hi > len(texts):
            word, first = hasher.words(texts[lo:hi])
            hashes.append(word)
            sizes.append(np.diff(first))
            lo, size = hi, 0
    return np.concatenate(hashes), np.concatenate(sizes)


class Home:
    """The words of a home's documents (fewer than 2**31 with all their n-grams), and the n-grams that end at them."""

    def __init__(self, texts: list[bytes]) -> None:
        self.words, self.sizes = _word_hashes(texts, WordHasher())
        self.document = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes

    def ends(self, n: int) -> np.ndarray:
        """Whether each word ends an n-gram of its document."""
        out = np.ones(len(self.words), dtype=bool)
        for k in range(min(n - 1, int(self.sizes.max(initial=0)))):
            out[(self.first + k)[self.sizes > k]] = False
        return out

    def orders(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order the words that end an n-gram of it, and the n-grams' hashes."""
        joined = self.words
        for n in range(1, order + 1):
            if n > 1:
                joined = mixed(joined[:-1] * np.uint64(BASE) + self.words[n - 1 :])
            last = np.flatnonzero(self.ends(n)).astype(np.int32)
            yield last, joined[last - (n - 1)]

    def distinct(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """All distinct n-grams in order of their hash, and where each begins among all of them in order (one more at the end)."""
        every = np.concatenate([h for _, h in self.orders(order)])
        every.sort()
        new = np.flatnonzero(np.concatenate([[True] * bool(len(every)), every[1:] != every[:-1]]))
        return every[new], np.append(new, len(every)).astype(np.int32)

    def others(self, last: np.ndarray, hashes: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each word how often other documents have the n-gram that it ends; 0 where it ends none."""
        by_hash = np.argsort(hashes, kind="stable")  # equal n-grams stay in the order of documents
        h, last = hashes[by_hash], last[by_hash]
        d = self.document[last]
        first = np.flatnonzero(np.concatenate([[True] * bool(len(h)), (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
        own = np.diff(np.append(first, len(h)))
        left = counts[np.searchsorted(kinds, h[first])] - own
        out = np.zeros(len(self.words), dtype=np.int64)
        out[last] = np.repeat(left, own)
        return out

    def scores(self, order: int, words: int, kinds: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The score of each document; ``counts`` are those of the whole corpus, which has ``words`` words."""
        rest = np.maximum(1, words - self.sizes)[self.document]
        logs = shorter = None
        for n, (last, hashes) in enumerate(self.orders(order), 1):
            here = self.others(last, hashes, kinds, counts)
            if logs is None:
                logs = np.log(np.where(here > 0, here, 0.5) / rest)
            else:
                logs[self.ends(n)] += np.log(BACKOFF)
                met = np.flatnonzero(here)
                logs[met] = np.log(here[met] / shorter[met - 1])
            shorter = here
        return np.bincount(self.document, weights=logs, minlength=len(self.sizes))


def _cuts(kinds: np.ndarray, parts: int) -> np.ndarray:
    """Where each range of hashes begins in sorted hashes (one more at the end)."""
    part = (kinds >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


def _short(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // HASH_BYTES, 8), dtype=np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8").ravel()


def _small(x: np.ndarray) -> bytes:
    """Counts as bytes, with larger ones after them: 255 stands for the next of those."""
    big = x >= 255
    return np.uint64(len(x)).tobytes() + np.where(big, 255, x).astype(np.uint8).tobytes() + x[big].astype("<i8").tobytes()


def _counts(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw[:8], dtype=np.uint64)[0])
    out = np.frombuffer(raw[8 : 8 + n], dtype=np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[8 + n :], dtype="<i8")
    return out


def _row() -> Column:
    """A row by id and text; rows equal in both have equal scores."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))


_SENT = "part long, home long, grams binary, counts binary"
_BACK = "home long, part long, counts binary"


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_score (natural logarithm, summed) and mean_log_score (by word; 0 without words) of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    stats = texts.agg(F.sum(size_of(F.col("text"))).alias("words"), F.sum(F.octet_length("text")).alias("bytes")).first()
    words, homes = int(stats["words"] or 0), max(1, -(-int(stats["bytes"] or 0) // HOME_BYTES))
    parts = max(1, -(-words * order // RANGE_GRAMS))
    texts = texts.select(F.pmod(F.col("row"), F.lit(homes)).alias("home"), "doc_id", "text")

    def send(group: pa.Table) -> pa.Table:
        kinds, bounds = Home(as_bytes(group.column("text"))).distinct(order)
        counts = np.diff(bounds)
        cut = _cuts(kinds, parts)
        held = np.flatnonzero(np.diff(cut)).tolist()
        grams, many = ([pack(x[cut[p] : cut[p + 1]]) for p in held] for pack, x in ((_short, kinds), (_small, counts)))
        home = pa.array([group.column("home")[0].as_py()] * len(held), pa.int64())
        return pa.table({"part": pa.array(held, pa.int64()), "home": home, "grams": pa.array(grams, pa.binary()), "counts": pa.array(many, pa.binary())})

    def count(group: pa.Table) -> pa.Table:
        grams = [_long(x) for x in group.column("grams").to_pylist()]
        ends = np.cumsum([len(g) for g in grams])
        every = np.concatenate(grams)
        by_hash = np.argsort(every)
        every = every[by_hash]
        new = np.concatenate([[True], every[1:] != every[:-1]])
        sums = np.add.reduceat(np.concatenate([_counts(x) for x in group.column("counts").to_pylist()])[by_hash], np.flatnonzero(new))
        back = np.empty(len(every), dtype=np.int64)
        back[by_hash] = sums[np.cumsum(new) - 1]
        packed = [_small(x) for x in np.split(back, ends[:-1])]
        return pa.table({"home": group.column("home"), "part": group.column("part"), "counts": pa.array(packed, pa.binary())})

    def total(own: pa.Table, back: pa.Table) -> pa.Table:
        home = Home(as_bytes(own.column("text")))
        kinds, _ = home.distinct(order)
        replies = sorted(zip(back.column("part").to_pylist(), back.column("counts").to_pylist(), strict=True))
        counts = np.concatenate([np.empty(0, dtype=np.int64), *(_counts(x) for _, x in replies)])
        scores = home.scores(order, words, kinds, counts)
        return pa.table({"doc_id": own.column("doc_id"), "n_words": pa.array(home.sizes, pa.int64()), "log_score": scores, "mean_log_score": scores / np.maximum(1, home.sizes)})

    back = texts.groupBy("home").applyInArrow(send, _SENT).groupBy("part").applyInArrow(count, _BACK)
    return texts.groupBy("home").cogroup(back.groupBy("home")).applyInArrow(total, "doc_id long, n_words long, log_score double, mean_log_score double")


def op9_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_backoff_scores": op9_backoff_scores}
ORACLE: dict[str, str] = {}
