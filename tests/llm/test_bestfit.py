"""Best-fit packing against the tokenizer, exact bounds and exhaustive search; odd texts of the word tokenizer."""

import collections
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from fixtures_llm import corpus, frame, odd
from tokenizers import Tokenizer

from estatelens.llm import bestfit
from estatelens.llm.packing import WordTokenizer, default_tokenizer


def test_pieces_round_trip(spark, monkeypatch):
    monkeypatch.setattr(bestfit, "GROUP", 40)
    rows = corpus(6, 60) + [(900, "one two", None, None, 0)] * 2
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = bestfit.pack(bestfit.cut(frame(spark, rows), keep_ids=False)).collect()
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        for n, start in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[start : start + 2048], dtype="<u4")
            want[doc_id, n, start, len(own), zlib.crc32(own.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == list(itertools.accumulate([0, *(n for _, n in own[:-1])])) and sum(n for _, n in own) <= 2048
    total = sum(r.length for r in got)
    assert len(by_sequence) <= -(-total // 2048) + 1


def fewest(sizes, length):
    """The least number of bins, by trying all ways."""
    best = [len(sizes)]

    def place(i, fills):
        if len(fills) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(fills)
            return
        for k in range(len(fills)):
            if fills[k] + sizes[i] <= length and fills[k] not in fills[:k]:
                place(i + 1, fills[:k] + [fills[k] + sizes[i]] + fills[k + 1 :])
        place(i + 1, [*fills, sizes[i]])

    place(0, [])
    return best[0]


def test_exchanges_near_the_least_number_of_bins():
    rng = random.Random(4)
    over = gained = 0
    for _ in range(150):
        length = 60
        sizes = [rng.randrange(8, 32) for _ in range(rng.randrange(1, 12))]
        first = bestfit.best_fit(sizes, length)
        bins = bestfit.improved(first, sizes, length)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= length for b in bins)
        over += len(bins) - fewest(sizes, length)
        # From a poor start the exchanges do the work.
        alone = bestfit.improved([[i] for i in range(len(sizes))], sizes, length)
        assert sorted(i for b in alone for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= length for b in alone)
        gained += len(sizes) - len(alone)
        assert len(alone) <= fewest(sizes, length) + 1
    assert over <= 8 and gained > 400


def test_exchanges_empty_bins_that_best_fit_leaves():
    # One for one between the first two makes room for the last piece.
    sizes, length = [5, 4, 4, 3, 2, 2], 10
    assert len(bestfit.improved([[0, 1], [2, 3, 4], [5]], sizes, length)) == 2
    # Two for one, and one for two.
    assert sorted(map(len, bestfit.improved([[0], [1, 2]], [7, 4, 5], 10))) == [1, 2]
    assert len(bestfit.improved([[0, 1], [2, 3], [4]], [6, 3, 5, 4, 2], 10)) == 2


def test_packing_of_odd_rows(spark):
    rows = odd(spark)
    got = bestfit.pack(bestfit.cut(rows)).collect()
    assert len({r.row for r in got}) == rows.count() and {None, 0, 1} <= {r.doc_id for r in got}
    assert bestfit.pack(bestfit.cut(rows.limit(0))).count() == 0
    ids = bestfit.cut(frame(spark, [(1, "a b", None, None, 0)]), keep_ids=True).first().ids
    assert np.frombuffer(ids, dtype="<u4")[-1] == 0


def test_word_tokenizer_equals_library_on_odd_texts():
    rng = random.Random(9)
    bits = ["a", "Zz", "ß", "ÿ", "À", "é", "é", "ñ", "İ", "ſ", "K", "ﬁ", "µ", "ª", "×", "'s", "'", "don't", "1", "½", "Ⅷ", ".", ",x", "!", " ", "\t", "\n", "　", "\xa0", "漢", "👩‍🚀", "<|endoftext|>", "<|startoftext|>", "x.y", "9;", "_", "-", "ǅ", "Σ", "ς", "̈", "word", "Word"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(4000)]
    plain = Tokenizer.from_file(default_tokenizer())
    words = WordTokenizer(default_tokenizer())
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        assert [x.tolist() for x in words([t.encode() for t in part])] == [[*e.ids, 1] for e in plain.encode_batch(part, add_special_tokens=False)]
