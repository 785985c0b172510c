"""Small tables and plain words for the brute-force checks."""

import random
import re

from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text, width):
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def prose(rng, n):
    return " ".join("".join(rng.choice(["ba", "re", "Ti", "ün", "lo", "ça", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with exact copies, near copies, shared passages, periodic and very long ones, empty and null ones."""
    rng = random.Random(seed)
    passage = prose(rng, 120)
    texts = [prose(rng, rng.choice([1, 2, 3, 4, 5, 30, 120, 300])) for _ in range(n)]
    texts += [texts[3], texts[7], texts[7], passage, prose(rng, 20) + passage + prose(rng, 20), passage[:500] + " x " + passage[480:]]
    base = prose(rng, 200).split()
    for _ in range(12):
        edited = list(base)
        for _ in range(rng.randint(1, 9)):
            edited[rng.randrange(len(edited))] = "edit%d" % rng.randrange(1000)
        texts.append(" ".join(edited))
    texts += ["a" * 1500, "ab" * 700, "", None, None, " \t\n", "ünï " * 600, prose(rng, 6000)]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s2", "s2", None]), len(t or "")) for i, t in enumerate(texts)]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, DOCUMENTS).repartition(3)


def odd(spark):
    """Repeated rows, null ids, and columns that bear names the operators use."""
    rows = corpus(2, 8)[:12]
    rows += [rows[0], rows[1], (None, rows[2][1], None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    for name in ("size", "key", "part", "kept", "score", "target", "component_id", "spans", "_id", "row", "n", "id"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df
