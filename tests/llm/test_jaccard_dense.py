"""Sets that share prefix shingles and hardly link: all their pairs are compared, many at once."""

import time

import numpy as np

from estatelens.llm.jaccard import links_among


def _sets(rng, n, grams=200, share=0.88):
    """Sets that have most of one base, so that their prefixes meet but few pairs reach the similarity."""
    every = np.iinfo(np.int64)
    base = rng.integers(every.min, every.max, grams)
    return [np.unique(np.concatenate([base[rng.random(grams) < share], rng.integers(every.min, every.max, grams - int(share * grams))])) for _ in range(n)]


def _groups(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    return label


def test_many_pairs_without_links_take_seconds():
    sets = _sets(np.random.default_rng(3), 1200)
    sets += [sets[5][1:], sets[9][2:]]
    began = time.process_time()
    found = links_among(sets, [0] * len(sets))
    # Its 720,000 pairs, one after the other, took 35 s.
    assert time.process_time() - began < 8
    assert {tuple(sorted(p)) for p in found} == {(5, 1200), (9, 1201)}


def test_links_equal_all_pairs_on_one_and_two_sides():
    rng = np.random.default_rng(4)
    for share, percent in ((0.9, 70), (0.95, 85), (0.97, 90), (0.99, 100), (0.7, 50)):
        sets = _sets(rng, 40, 60, share) + [np.arange(3), np.arange(4)]
        for side in ([0] * 42, [i % 2 for i in range(42)]):
            whole = [set(s.tolist()) for s in sets]
            want = {(i, j) for j in range(42) for i in range(j) if (len(set(side)) < 2 or side[i] != side[j]) and 100 * len(whole[i] & whole[j]) >= percent * len(whole[i] | whole[j])}
            found = links_among(sets, side, percent)
            assert {tuple(sorted(p)) for p in found} <= want
            assert _groups(42, found) == _groups(42, want)
