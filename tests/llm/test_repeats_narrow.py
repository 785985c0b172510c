"""What goes to the suffix arrays: the windows that can repeat, and little else."""

import random

import numpy as np
from pyspark.sql import functions as F

from estatelens.llm import repeats


def _pieces(texts, length, gram):
    """Different pieces: bytes, number of windows, anchor."""
    seen = {}
    text, first, count, anchor, content, *_ = repeats.Anchors(length, gram)(texts)
    for i, f, c, a, h in zip(*(x.tolist() for x in (text, first, count, anchor, content))):
        seen[a, h] = (texts[i][f : f + c + length - 1], c, a)
    return list(seen.values())


def _ranges(pieces, length, gram):
    parts, windows, anchors = zip(*pieces)
    size = np.array([len(p) for p in parts])
    found = repeats._may_repeat(np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(size) - size, size, np.array(windows), np.array(anchors, dtype=np.int64), length, gram)
    return list(zip(*(x.tolist() for x in found)))


def test_no_window_that_repeats_is_left_out():
    rng = random.Random(5)
    met = 0
    for length, gram in [(20, 8), (12, 12), (30, 5), (13, 12)] * 15:
        bases = [bytes(rng.choice(b"abcd") for _ in range(60)) for _ in range(3)] + [b"ab" * 30, b"a" * 50]
        texts = [rng.choice(bases)[rng.randrange(40) :] + rng.choice(bases)[: rng.randrange(50)] for _ in range(6)]
        pieces = _pieces(texts, length, gram)
        for (part, n, anchor), (lo, hi) in zip(pieces, _ranges(pieces, length, gram) if pieces else []):
            for s in range(n):
                again = any(part[s : s + length] == p[u : u + length] for p, m, a in pieces if a == anchor and p != part for u in range(m))
                met += again
                assert not again or lo <= s < hi
    assert met > 100


def test_pieces_alike_on_one_side_stay_out():
    rng = random.Random(6)
    noise = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    shared = noise(300)  # with its anchor at least 184 bytes on one side, and less than a window
    pieces = _pieces([noise(500) + shared + noise(500) for _ in range(40)], repeats.LENGTH, repeats.GRAM)
    whole = sum(len(p) for p, _, _ in pieces)
    left = sum(hi - lo + repeats.LENGTH - 1 for lo, hi in _ranges(pieces, repeats.LENGTH, repeats.GRAM) if lo < hi)
    assert left < whole / 20


def test_equal_pieces_become_one_without_a_sort(spark):
    rows = spark.createDataFrame([(1, 10, 5), (1, 11, 6), (2, 12, 7)], "anchor long, _id long, first long")
    one = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("copies"), *repeats._of_one("_id", "first"))
    assert "SortAggregate" not in one._jdf.queryExecution().executedPlan().toString()
    assert {r[0] - r[1] for r in one.select("_id", "first").collect()} == {5}
