"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its hashed character n-grams (with word
ends), a segment of ``SEGMENT`` words the mean of its words, and a linear
softmax over the segment says how toxic it is; vectors and softmax are trained
jointly in numpy. A document scores as its most toxic segment, so a few words
count as much in a long text as in a short one. Misspellings share n-grams
with known words.

Training uses at most ``MOST_LABELLED`` documents of each label, the first in
hash order, each as the mean of its distinct words.

Defined cases: null and empty texts, and texts without words, score the share
that a segment without evidence gets; without labels of both kinds every text
scores 0. Ties do not matter; repeated rows score alike. Extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.language import fold
from estatelens.llm.words import BASE, BASE_INVERSE, WordHasher, mixed, pieces_of, powers

MOST_LABELLED = 1000
SEGMENT = 16
BUCKETS = 1 << 17
SHORTEST, LONGEST = 3, 5
WIDTH = 4
STEPS, RATE, CHANCE = 25, 0.003, 6.0



class Subwords:
    """N-gram buckets of the words of many texts at once."""

    def __init__(self) -> None:
        self.hasher = WordHasher()
        # Here punctuation ends a word too.
        self.hasher.space = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket and word of each n-gram (whole words are n-grams too), and the first word of each text (one more at the end)."""
        buffer, starts, ends, first = self.hasher.spans(texts)
        data = np.frombuffer(buffer, dtype=np.uint8)
        if len(self.up) < len(data):
            self.up, self.down = powers(BASE, 2 * len(data)), powers(BASE_INVERSE, 2 * len(data))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hasher.codes[data] * self.up[: len(data)], dtype=np.uint64)])
        size = ends - starts + 2  # with the space before and after as word ends
        buckets, owners = [], []
        for n in range(SHORTEST, LONGEST + 1):
            count = np.maximum(0, size - n + 1)
            owner = np.repeat(np.arange(len(starts)), count)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + starts[owner] - 1
            # White space of any kind is one word end: its code is taken out of the sum.
            buckets.append(self._hash(total, at, n, data))
            owners.append(owner)
        whole = (total[ends] - total[starts]) * self.down[starts]
        buckets.append(mixed(whole + np.uint64(99)) % np.uint64(BUCKETS))
        owners.append(np.arange(len(starts)))
        return np.concatenate(buckets).astype(np.int64), np.concatenate(owners), first

    def _hash(self, total: np.ndarray, at: np.ndarray, n: int, data: np.ndarray) -> np.ndarray:
        raw = total[at + n] - total[at]
        space = self.hasher.space
        for edge in (at, at + n - 1):
            end = space[data[edge]]
            raw = raw - np.where(end, (self.hasher.codes[data[edge]] - np.uint64(1)) * self.up[edge], np.uint64(0))
        return mixed(raw * self.down[at] + np.uint64(n)) % np.uint64(BUCKETS)


def segments_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each segment (one more at the end) and the text it belongs to."""
    count = -(-np.diff(first) // SEGMENT)
    text = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return np.concatenate([first[:-1][text] + within * SEGMENT, first[-1:]]), text


class _Bag:
    """A sparse mean: rows of a result are weighted sums of rows of a table."""

    def __init__(self, row: np.ndarray, column: np.ndarray, size: np.ndarray, columns: int) -> None:
        self.rows, self.columns = len(size), columns
        weight = (1.0 / np.maximum(1, size))[row].astype(np.float32)[:, None]
        by_row, by_column = np.argsort(row, kind="stable"), np.argsort(column, kind="stable")
        self.forward_ = self._sorted(row[by_row], column[by_row], weight[by_row])
        self.back_ = self._sorted(column[by_column], row[by_column], weight[by_column])

    @staticmethod
    def _sorted(key: np.ndarray, source: np.ndarray, weight: np.ndarray) -> tuple:
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
        return key[edge], edge, source, weight

    @staticmethod
    def _sum(key: np.ndarray, edge: np.ndarray, source: np.ndarray, weight: np.ndarray, table: np.ndarray, rows: int) -> np.ndarray:
        out = np.zeros((rows, table.shape[1]), dtype=np.float32)
        if len(key):
            out[key] = np.add.reduceat(table[source] * weight, edge, axis=0)
        return out

    def forward(self, table: np.ndarray) -> np.ndarray:
        return self._sum(*self.forward_, table, self.rows)

    def back(self, grad: np.ndarray) -> np.ndarray:
        return self._sum(*self.back_, grad, self.columns)


def worst_segments(table: np.ndarray, parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The toxic logit of each text's worst segment, without bias; 0 for a text without words.

    Repeated words of a segment count once, and a segment of fewer words as
    filled up with words of logit 0, so that one odd word does not stand out.
    """
    bucket, word, first = parts
    worst = np.full(len(first) - 1, -np.inf)
    if len(word):
        mean = np.bincount(word, weights=table[bucket], minlength=first[-1]) / np.bincount(word, minlength=first[-1])
        starts, owner = segments_of(first)
        segment = np.repeat(np.arange(len(owner)), np.diff(starts))
        # Words of one segment with the same logit are one word said again.
        order = np.lexsort((mean, segment))
        again = np.concatenate([[False], (mean[order][1:] == mean[order][:-1]) & (segment[order][1:] == segment[order][:-1])])
        mean[order[again]] = 0
        np.maximum.at(worst, owner, np.add.reduceat(mean, starts[:-1]) / SEGMENT)
    return np.where(np.isfinite(worst), worst, 0.0)


def fit(texts: list[bytes], toxic: np.ndarray, steps: int = STEPS, seed: int = 5) -> tuple[np.ndarray, float, float]:
    """One number per n-gram bucket (its vector's part of the toxic logit), and scale and threshold of a text's worst segment.

    A training text is the mean of its distinct words. Vectors and softmax
    move together by proximal gradient steps: an n-gram's gradient is divided
    by the norm of its column, so chance moves all alike, and a shrinkage
    below ``CHANCE`` such deviations keeps chance out of the vectors. Every
    fourth text is kept for the threshold.
    """
    tune = np.arange(len(texts)) % 4 == 3 if len(texts) >= 40 else np.zeros(len(texts), dtype=bool)
    learned, label = [t for t, k in zip(texts, tune, strict=True) if not k], toxic[~tune].astype(np.float32)
    # Equal words are computed once: each distinct word is taken apart as a text of its own.
    subwords = Subwords()
    buffer, starts, ends, first = subwords.hasher.spans(learned)
    _, example, kind = np.unique(subwords.hasher.hashes(np.frombuffer(buffer, dtype=np.uint8), starts, ends), return_index=True, return_inverse=True)
    bucket, word, _ = subwords([buffer[starts[i] : ends[i]] for i in example.tolist()])
    used, column = np.unique(bucket, return_inverse=True)
    size = np.bincount(word, minlength=len(example))
    to_words = _Bag(word, column, size, len(used))
    held = np.unique(np.repeat(np.arange(len(learned)), np.diff(first)) * np.int64(len(example)) + kind)
    text_of, kind_of = held // len(example), held % len(example)
    distinct = np.bincount(text_of, minlength=len(learned))
    to_texts = _Bag(text_of, kind_of, distinct, len(example))
    # The norm of an n-gram's column, as if its words never met in a text.
    per_word = np.bincount(kind_of, weights=1.0 / distinct[text_of] ** 2, minlength=len(example))
    norm = np.sqrt(np.bincount(column, weights=(per_word / size**2)[word], minlength=len(used))).astype(np.float32)[:, None]
    out = np.random.default_rng(seed).normal(0, 1, (WIDTH, 2)).astype(np.float32)
    out /= np.linalg.norm(out[:, 1] - out[:, 0])
    vectors, bias = np.zeros((len(used), WIDTH), dtype=np.float32), np.zeros(2, dtype=np.float32)
    balance = np.where(label > 0, 0.5 / max(1.0, label.sum()), 0.5 / max(1.0, (1 - label).sum())) * len(label)
    for _ in range(steps):
        hidden = to_texts.forward(to_words.forward(vectors / norm))
        logits = hidden @ out + bias
        p = 1 / (1 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -30, 30)))
        off = ((p - label) * balance).astype(np.float32)
        both = np.stack([-off, off], axis=1)
        grad = to_words.back(to_texts.back(both @ out.T)) / norm
        size_of = np.linalg.norm(grad, axis=1)
        chance = min(CHANCE * 0.5, 0.5 * float(size_of.max()))
        out -= 0.001 * (hidden.T @ both) / max(1.0, float(np.abs(hidden).max()))
        bias -= both.sum(axis=0) / len(label)
        vectors -= RATE * grad
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors *= np.maximum(0, 1 - RATE * chance / np.maximum(length, 1e-12))
    table = np.zeros(BUCKETS, dtype=np.float32)
    table[used] = (vectors / norm) @ (out[:, 1] - out[:, 0])
    checked = [x for x, k in zip(texts, tune, strict=True) if k] if tune.any() else texts
    marks = toxic[tune] if tune.any() else toxic
    worst = np.concatenate([worst_segments(table, subwords(checked[i : i + 50])) for i in range(0, len(checked), 50)])
    return table, *threshold(worst, marks)


def threshold(worst: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Scale and threshold: the cut with the fewest errors by kind (in the middle of the widest best gap) scores 0.5."""
    order = np.argsort(worst, kind="stable")
    value, mark = worst[order], toxic[order] > 0
    missed = np.concatenate([[0], np.cumsum(mark)]) / max(1, mark.sum())
    alarm = np.concatenate([[0], np.cumsum(~mark)])
    alarm = (alarm[-1] - alarm) / max(1, (~mark).sum())
    edge = np.concatenate([[value[0] - 1], value, [value[-1] + 1]])
    gap = np.diff(edge)
    cost = missed + 4 * alarm
    best = np.flatnonzero((cost <= cost.min() + 1e-12) & (gap > 0))
    cut = best[np.argmax(gap[best])]
    middle = (edge[cut] + edge[cut + 1]) / 2
    spread = float(np.median(np.abs(worst - middle))) or 1.0
    return 4.0 / spread, float(middle)


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[np.ndarray, float, float] | None:
    """A model from at most ``most`` labelled documents of each kind; None if a kind is missing."""
    marked = labels.filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("_id"), "toxic").groupBy("_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("_id"), "_id")
    chosen = marked.filter("toxic = 1").orderBy(*order).limit(most).unionByName(marked.filter("toxic = 0").orderBy(*order).limit(most))
    # At most 2 * most rows of an id and a label.
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["_id"]).select(F.col("text").cast("binary").alias("text"), "toxic", "_id").collect()
    rows.sort(key=lambda r: (r["_id"], bytes(r["text"] or b"")))
    toxic = np.array([r["toxic"] for r in rows])
    if not (toxic == 1).any() or not (toxic == 0).any():
        return None
    return fit([bytes(r["text"] or b"") for r in rows], toxic)


def score(docs: DataFrame, model: tuple[np.ndarray, float, float] | None) -> DataFrame:
    """doc_id and score of every whole text."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    table, scale, middle = model
    shared = docs.sparkSession.sparkContext.broadcast(table)  # one float per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords()
        for rows, texts in pieces_of(batches, limit=1 << 19):
            z = scale * (worst_segments(shared.value, subwords(texts)) - middle)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold() != 0)
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE: dict[str, str] = {}
