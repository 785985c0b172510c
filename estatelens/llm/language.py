"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over
hashed byte n-grams (log ratio of the n-gram's share in languages whose bit is
one and zero) predicts a margin; the predicted language is the one whose
codeword has the least summed logistic loss under the margins. Documents whose
nearest two codewords are about equally near are flagged as ambiguous.

N-gram counts per language cover all training documents. They are summed in
the tasks and by language, so the driver sees one row of ``FEATURES`` counts
per language.

Defined cases: null text, and text without letters, gives ``und`` with score
0; so does every text when there is nothing to learn from. One learned
language is predicted for every text with letters. Ties go to the first
language in order. Repeated rows have equal results. Extra columns are kept
by ``identify`` unless they bear the names it adds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatelens.llm.words import pieces_of, tidy

FEATURES = 1 << 15
ORDERS = (2, 3, 4)
#: Exhaustive codes have 2**(K-1) - 1 bits; beyond this many languages, random ones are drawn.
EXHAUSTIVE = 7
AMBIGUOUS_BELOW = 0.5


def codewords(languages: int) -> np.ndarray:
    """One row of -1/+1 per language; columns split the languages in two."""
    if languages <= 1:
        return np.ones((languages, 1), dtype=np.int8)
    if languages <= EXHAUSTIVE:
        bits = np.arange(1, 1 << (languages - 1))
        return np.stack([np.ones(len(bits), dtype=np.int8)] + [1 - 2 * ((bits >> k) & 1).astype(np.int8) for k in range(languages - 1)])
    rng, best, found = np.random.default_rng(3), None, -1
    length = math.ceil(15 * math.log2(languages))
    for _ in range(100):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(languages, length))
        gram = code.astype(np.int32) @ code.T.astype(np.int32)
        apart = int((length - np.max(gram - 2 * length * np.eye(languages, dtype=np.int32))) // 2)
        if apart > found and (np.abs(code.sum(axis=0, dtype=np.int32)) < languages).all():
            best, found = code, apart
    return best


def grams(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature index at each position of the joined texts for each order, and where each text starts (one more at the end)."""
    pad = b" " * max(ORDERS)
    data = np.frombuffer(pad.join([b"", *texts, b""]).lower(), dtype=np.uint8).astype(np.uint32)
    sizes = np.fromiter((len(t) + len(pad) for t in texts), dtype=np.int64, count=len(texts))
    out, joined = [], data.copy()
    for n in range(2, max(ORDERS) + 1):
        joined[: len(data) - n + 1] = (joined[: len(data) - n + 1] << np.uint32(8)) | data[n - 1 :]
        if n in ORDERS:
            out.append(((joined + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(17))
    return out, np.concatenate([[0], np.cumsum(sizes)])


def learn(docs: DataFrame, text: str = "text", language: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages in order and, per feature and codeword bit, the classifier's weight."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for rows, texts in pieces_of(batches, limit=1 << 19):
            names = rows.column(1).to_pylist()
            for name in set(names):
                total = sums.setdefault(name, np.zeros(FEATURES, dtype=np.int64))
                own = [t for t, n in zip(texts, names, strict=True) if n == name]
                for index in grams(own)[0]:
                    total += np.bincount(index, minlength=FEATURES)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()])], ["lang", "counts"])

    def total(group: pa.Table) -> pa.Table:
        summed = np.zeros(FEATURES, dtype=np.int64)
        for x in group.column("counts").to_pylist():
            summed += np.frombuffer(x, dtype=np.int64)
        return pa.table({"lang": group.column("lang")[:1], "counts": pa.array([summed.tobytes()], pa.binary())})

    schema = "lang string, counts binary"
    known = docs.filter(F.col(language).isNotNull()).select(F.col(text).alias("text"), F.col(language).alias("lang"))
    learned = sorted(known.mapInArrow(tidy(count), schema).groupBy("lang").applyInArrow(total, schema).collect())
    languages = [r["lang"] for r in learned]
    code = codewords(len(languages))
    counts = np.array([np.frombuffer(r["counts"], dtype=np.int64) for r in learned]).reshape(len(languages), FEATURES)
    share = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    weights = np.zeros((FEATURES, code.shape[1]), dtype=np.float32)
    for b in range(code.shape[1]) if len(languages) > 1 else ():
        one, zero = share[code[:, b] > 0].mean(axis=0), share[code[:, b] < 0].mean(axis=0)
        weights[:, b] = np.log((one + 1e-6) / (zero + 1e-6))
    return languages, weights


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row of margins, and its weight among all codewords (0 to 1)."""
    loss = np.logaddexp(0.0, -margins[:, None, :] * code[None, :, :]).sum(axis=2)
    near = np.exp(loss.min(axis=1, keepdims=True) - loss)
    return loss.argmin(axis=1), 1.0 / near.sum(axis=1)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous, from the whole text alone."""
    languages, weights = model
    code = codewords(len(languages))
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # features times bits, whatever the corpus
    letter = r"[^\W\d_]"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finds = re.compile(letter).search
        for rows, texts in pieces_of(batches, text, 1 << 18):
            table = shared.value
            indexes, starts = grams(texts)
            sums = np.zeros((len(texts), table.shape[1]), dtype=np.float64)
            for index in indexes:
                sums += np.add.reduceat(table[index], starts[:-1], axis=0, dtype=np.float64)
            margins = np.clip(sums / np.sqrt(np.maximum(1, np.diff(starts)))[:, None], -8, 8)
            lettered = np.array([bool(finds(t.decode("utf-8", "replace"))) for t in texts]) & bool(languages)
            if languages:
                best, score = decode(margins, code)
                names = [languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
            else:
                names, score = ["und"] * len(texts), np.zeros(len(texts))
            score = np.where(lettered, score, 0.0)
            added = [pa.array(names, pa.string()), pa.array(score), pa.array(lettered & (score < AMBIGUOUS_BELOW))]
            yield pa.RecordBatch.from_arrays([*rows.columns, *added], [*rows.schema.names, "lang_pred", "score", "ambiguous"])

    kept = docs.drop(*[c for c in ("lang_pred", "score", "ambiguous") if c in docs.columns])
    schema = T.StructType(list(kept.schema.fields)).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return kept.mapInArrow(tidy(run), schema)


def fold(doc_id: str = "doc_id"):
    """The fold of a document; fold 0 is held out of learning."""
    return F.crc32(F.col(doc_id).cast("string")) % 5


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.filter(fold() != 0))
    named = identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op3_language_id": op3_language_id}
ORACLE: dict[str, str] = {}
