"""Repeats and passages of short windows over texts full of near repeats, against all windows."""

import collections
import random
import re

import pytest
from fixtures_llm import frame

from estatelens.llm import repeats


def runs(covered):
    out, n = [], 0
    for i, c in enumerate([*covered, False]):
        if c:
            n += 1
        elif n:
            out.append(n)
            n = 0
    return out


def by_bytes(texts, length):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        covered = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                covered[i : i + length] = [True] * length
        yield runs(covered)


def by_words(texts, words):
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]

    def windows(t, s):
        return [(s[i][0], s[i + words - 1][1]) for i in range(len(s) - words + 1)]

    count = collections.Counter(t[a:b] for t, s in zip(texts, spans) for a, b in windows(t, s))
    for t, s in zip(texts, spans):
        covered = [False] * len(t)
        for a, b in windows(t, s):
            if count[t[a:b]] > 1:
                covered[a:b] = [True] * (b - a)
        yield runs(covered)


def shuffled(rng, n, unit):
    """Texts of pieces of a few bases, cut and joined at random places, so that anchors have many different pieces."""
    bases = [unit(rng, 60) for _ in range(5)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            base = rng.choice(bases)
            a = rng.randrange(len(base))
            parts.append(base[a : a + rng.randrange(1, 45)] if rng.random() < 0.7 else unit(rng, rng.randrange(1, 30)))
        out.append(parts)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_short_windows(spark, seed, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 4000)
    monkeypatch.setattr(repeats, "LARGEST_ANCHOR", 3000)
    rng = random.Random(seed)
    letters = shuffled(rng, 150, lambda r, n: "".join(r.choice("abcdefghijklmnop") for _ in range(n)))
    texts = ["".join(p) for p in letters] + ["", "abc", "".join(letters[0]), "".join(letters[0])]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.remove_repeats(frame(spark, rows), 24, 6).collect()}
    want = {i: (sum(x), len(x)) for i, x in enumerate(by_bytes([t.encode() for t in texts], 24))}
    assert got == want and sum(n for n, _ in want.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_short_passages(spark, seed):
    rng = random.Random(seed)
    words = shuffled(rng, 150, lambda r, n: [r.choice(["ba", "Re", "tí", "lo", "ne", "su", "x"]) + r.choice("abcdefgh") for _ in range(n)])
    texts = [" ".join(w for part in p for w in part) for p in words] + ["", "a b", "  " + " ".join(words[0][0]) + " \n"]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    raw = [t.encode() for t in texts]
    want = {i: (len(x), sum(x)) for i, x in enumerate(by_words(raw, 16))}
    kept = {r.doc_id: r for r in repeats.remove_repeats(frame(spark, rows), words=16, cut_passages=False).collect()}
    assert {i: (r.n_passages, r.n_passage_bytes) for i, r in kept.items()} == want and sum(n for n, _ in want.values())
    assert all(r.n_removed == 0 and r.kept == raw[i] for i, r in kept.items() if len(raw[i]) < repeats.LENGTH)
    cut = {r.doc_id: r.n_removed for r in repeats.remove_repeats(frame(spark, rows), words=16).collect()}
    assert all(cut[i] >= n for i, (_, n) in want.items()) and all(cut[i] == n for i, (_, n) in want.items() if len(raw[i]) < repeats.LENGTH)
