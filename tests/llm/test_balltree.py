"""Ranked search against scores of every document, in plain Python."""

import collections
import math
import random
import re

import numpy as np
from fixtures_llm import corpus, frame, odd, prose

from estatelens.llm import balltree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top):
    counts = [collections.Counter(terms(t)) for _, t in docs]
    n, words = sum(bool(c) for c in counts), sum(sum(c.values()) for c in counts)
    df = collections.Counter(t for c in counts for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for (doc_id, _), c in zip(docs, counts):
            size = sum(c.values())
            m = 100 - 25 + (25 * size * n) // max(1, words)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item_id, k + 1, d, -s) for k, (s, _, d) in enumerate(scored[:top])]
    return collections.Counter(out)


def items_of(rng, docs, n=30):
    texts = [t for _, t in docs if t and terms(t)]
    items = [(i, " ".join(rng.sample(terms(t), min(len(terms(t)), 12)))) for i, t in enumerate(rng.choice(texts) for _ in range(n))]
    return items + [(100, None), (101, ""), (102, "!!! ..."), (103, "unknownword"), (0, "ba ba BA Re"), (None, "tist ün"), (104, texts[0] * 3)]


def test_ranks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(balltree, "TREE_DOCS", 40)
    monkeypatch.setattr(balltree, "LEAF", 4)
    monkeypatch.setattr(balltree, "BLOCK_TERMS", 150)
    rng = random.Random(8)
    rows = corpus(9, 120) + [(500 + i, "ba re Tist ün ba", None, None, 0) for i in range(60)] + [(None, "ba re tist ün ba", None, None, 0), (500, "ba re", None, None, 0), (500, "ba re", None, None, 0)]
    docs = [(r[0], r[1]) for r in rows]
    items = items_of(rng, docs)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    for top in (20, 3):
        got = collections.Counter((r.item_id, r.rank, r.doc_id, r.score) for r in balltree.search(frame(spark, rows), asked, top).collect())
        assert got == brute(docs, items, top)


def test_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    topics = [rng.choice(400, 30, replace=False) for _ in range(12)]
    points = []
    for k in range(3000):
        own = np.unique(np.concatenate([rng.choice(topics[k % 12], 15), rng.choice(400, 3)]))
        points.append((own, rng.integers(1, 10**6, len(own))))
    dense = np.zeros((len(points), 400), dtype=np.int64)
    for row, (i, v) in zip(dense, points):
        row[i] = v
    tree = balltree.BallTree(points, 400)

    def walk(ball):
        if ball.points is not None:
            return ball.points.tolist()
        return walk(ball.parts[0]) + walk(ball.parts[1])

    assert sorted(walk(tree.root)) == list(range(len(points)))
    few = 0
    for k in range(40):
        query = np.zeros(400, dtype=np.int64)
        query[rng.choice(topics[k % 12], 6, replace=False)] = rng.integers(1, 10**4, 6)
        scores = dense @ query
        balls = [tree.root]
        while balls:
            ball = balls.pop()
            assert ball.bound(query.astype(float)) >= scores[walk(ball)].max()
            balls += ball.parts
        best = []
        few += tree.search(query, best, 20, [[i] for i in range(len(points))]) < len(points)
        want = sorted(((int(s), -i) for i, s in enumerate(scores) if s > 0), reverse=True)[:20]
        assert sorted(best, reverse=True) == want
    assert few > 30


def test_search_of_odd_rows(spark):
    rows = odd(spark)
    items = spark.createDataFrame([(1, "ba re ün"), (1, None)], "item_id long, text string")
    assert balltree.search(rows, items).count() <= 20
    assert balltree.search(rows.limit(0), items).count() == 0
    assert balltree.search(rows, items.limit(0)).count() == 0
    assert balltree.search(rows, items.filter("text IS NULL")).count() == 0
    long = prose(random.Random(1), 30000)
    one = balltree.search(frame(spark, [(1, long, None, None, 0), (2, "", None, None, 0)]), spark.createDataFrame([(7, long[:50])], "item_id long, text string"))
    assert [(r.doc_id, r["rank"]) for r in one.collect()] == [(1, 1)]
