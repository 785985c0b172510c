"""Operators on documents against brute force, and their defined cases."""

import collections
import hashlib
import math

import numpy as np
import pytest
from fixtures_llm import DOCUMENTS, corpus, frame, odd, shingles, words

from estatelens.llm import backoff, fingerprints, jaccard, language, mixing, packing, repeats, toxicity
from estatelens.llm.suffixes import permuted_lcp, suffix_array


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(4)
    for n in range(120):
        t = rng.integers(0, rng.integers(1, 5), n).astype(np.uint8)
        t = np.tile(t[: n // 5 + 1], 5)[:n] if n % 3 == 0 else t
        raw = t.tobytes()
        order = sorted(range(n), key=lambda i, raw=raw: raw[i:])
        sa = suffix_array(t, 256)
        assert sa.tolist() == order
        if n:
            plcp = permuted_lcp(t, sa)
            for a, b in zip(order, order[1:], strict=False):
                same = 0
                while max(a, b) + same < n and raw[a + same] == raw[b + same]:
                    same += 1
                assert plcp[b] == same


def brute_repeats(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), bytes(gone).count(b"\0\1") + (gone[:1] == b"\1"), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("largest", [1 << 20, 1])
def test_repeats_equal_brute_force(monkeypatch, docs, rows, largest):
    monkeypatch.setattr(repeats, "LARGEST_ANCHOR", largest)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 1 << 12)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in repeats.remove_repeats(docs).collect()}
    expected = brute_repeats([(t or "").encode() for _, t, *_ in rows], repeats.LENGTH)
    assert got == {r[0]: e for r, e in zip(rows, expected, strict=True)}


def test_repeats_keep_whole_characters_and_columns(spark, empty):
    text = "é" * 300 + "abc"
    df = spark.createDataFrame([(1, "x" + text, "a"), (2, text, "b"), (3, None, "c")], "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in repeats.remove_repeats(df).collect()}
    assert got[1].kept_text == "x" and got[2].kept_text == "" and (got[3].text, got[3].n_bytes) == (None, 0)
    assert repeats.remove_repeats(empty).count() == 0
    assert repeats.remove_repeats(odd(spark)).count() == 16
    assert repeats._without(b"abcdef", [[1, 3], [4, 6]]) == b"ad"


def brute_components(rows):
    sets = {r[0]: shingles(r[1], 4) for r in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_jaccard_equals_all_pairs(spark, monkeypatch, docs, rows, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    none = spark.createDataFrame([(None, "a b c d e a b c d", None, None, 0), (None, None, None, None, 0)], DOCUMENTS)
    assert sorted((r.n_shingles, r.doc_id, r.component_id) for r in jaccard.similar_documents(none).collect()) == [(0, None, None), (5, None, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs).collect()}
    assert got == brute_components(rows)


def test_jaccard_defined_cases(spark, empty):
    assert jaccard.similar_documents(empty).count() == 0
    got = jaccard.similar_documents(odd(spark)).collect()
    assert len(got) == 16 and sum(r.doc_id is None and r.component_id is None for r in got) == 2


def test_fingerprints(spark, docs, rows, empty):
    got = {r.doc_id: r for r in fingerprints.with_edits(docs).collect()}
    line = sorted(rows, reverse=True, key=lambda r: r[0])
    for mine, after in zip(line, line[1:] + line[:1], strict=True):
        text, follower, r = mine[1] or "", after[1] or "", got[mine[0]]
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = shingles(text, 5), shingles(edited, 5), shingles(follower, 5)
        for near, other in ((r.near_edited, b), (r.near_next, c)):
            exact = len(a & other) / len(a | other) if a | other else 1.0
            assert abs(near - exact) <= (0.2 if len(a | other) > fingerprints.K else 1e-12)
    by_text = collections.defaultdict(set)
    for i, t, *_ in rows:
        by_text[t].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert fingerprints.with_edits(empty).count() == 0 and fingerprints.with_edits(odd(spark)).count() == 16


def test_fingerprints_merge_and_estimate(spark):
    a, b = (" ".join(f"w{i}" for i in range(lo, hi)) for lo, hi in ((0, 3000), (1000, 3000)))
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    x, y = (fingerprints.decoded(r.fingerprint) for r in fingerprints.sketch_documents(df).orderBy("doc_id").collect())
    assert abs(fingerprints.distinct_count(x) / 2996 - 1) < 0.3
    assert abs(fingerprints.resemblance(x, y) - 2 / 3) < 0.15 and fingerprints.containment(y, x) > 0.8
    parts = fingerprints.sketch_documents(df).selectExpr("'k' AS g", "fingerprint")
    assert fingerprints.decoded(fingerprints.merge_sketches(parts, "g").first().fingerprint).tolist() == fingerprints.merged(x, y).tolist()


def test_language(spark, empty):
    texts = {"en": "the house is over there and the dog that", "de": "das haus ist dort und der hund über die straße", "fr": "la maison est là et le chien qui été"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(t.split())), lang, "s", 0) for lang, t in texts.items() for i in range(20)]
    model = language.learn(frame(spark, rows))
    assert model[0] == ["de", "en", "fr"]
    got = language.identify(frame(spark, rows), model).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)
    blank = frame(spark, [(1, None, "en", None, 0), (2, "", None, None, 0), (3, "123 !?", None, None, 0), (4, "the dog " * 50_000, None, None, 0)])
    assert {r.doc_id: r.lang_pred for r in language.identify(blank, model).collect()} == {1: "und", 2: "und", 3: "und", 4: "en"}
    nothing = language.learn(empty)
    assert {r.lang_pred for r in language.identify(frame(spark, rows), nothing).collect()} == {"und"}
    assert {r.lang_pred for r in language.identify(frame(spark, rows), language.learn(frame(spark, rows[:20]))).collect()} == {"en"}
    named = language.identify(odd(spark), model)
    assert named.count() == 16 and "size" in named.columns


def test_codewords_differ_in_many_bits():
    for k in (2, 3, 4, 7, 12, 40):
        code = language.codewords(k).astype(int)
        apart = [(code[a] != code[b]).sum() for a in range(k) for b in range(a)]
        assert len(code) == k and min(apart) >= (code.shape[1] // 4 if k > 2 else 1)


def test_mix(spark, docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert {r.doc_id: r["size"] for r in got} == {r[0]: len(words(r[1])) for r in rows}
    size = {s: sum(len(words(r[1])) for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    weight = dict(zip(["s1", "s2", None], [3, 1, 2], strict=True))
    left, target = dict(size), {}
    total = 1.5 * sum(size.values())
    while left:
        share = {s: (total - sum(target.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 2 * size[s]]
        target |= {s: 2 * size[s] for s in over} if over else share
        left = {s: left[s] for s in left if s not in over} if over else {}
    largest = max(len(words(r[1])) for r in rows)
    for s in size:
        mine = [r for r in got if r.source == s]
        assert all(math.isclose(r.target, target[s], rel_tol=1e-9) and r.source_size == size[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= largest and all(r.taken <= 2 * r["size"] for r in mine)
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix(docs).collect())
    assert mixing.mix(empty).count() == 0 and mixing.mix(odd(spark)).count() == 16
    # A capped source takes whole copies only, its empty texts too.
    capped = [(i, "a b c" if i % 3 else "", None, "big" if i > 5 else "small", 0) for i in range(40)] + [(50, None, None, "small", 0)]
    taken = mixing.mix(frame(spark, capped)).collect()
    assert {r.copies for r in taken if r.source == "small"} == {2} and all(r.copies <= 2 for r in taken)


def test_packing(spark, docs, rows, empty):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    plain = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    extra = [(1000, "don't STOP<|endoftext|>x it's 12ab́  Ä", None, None, 0)]
    pieces = packing.pack(packing.tokenize(frame(spark, rows + extra)), keep_ids=True).collect()
    of, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        of[p.doc_id].append((p.start, np.frombuffer(p.ids, dtype="<u4").tolist()))
        sequences[p.sequence_id].append((p.offset, p.length))
    for i, t, *_ in rows + extra:
        assert [x for _, ids in sorted(of[i]) for x in ids] == [*plain.encode(t or "", add_special_tokens=False).ids, 1]
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    assert packing.pack(packing.tokenize(empty)).count() == 0
    assert {p.doc_id for p in packing.pack(packing.tokenize(odd(spark))).collect()} >= {None, 0, 1}


def test_hilbert_curve_moves_one_step():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = packing.hilbert(grid, 3)
    line = grid[np.argsort(keys)]
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(line, axis=0)).sum(axis=1) == 1).all()


def test_toxicity(spark, empty):
    rng = np.random.default_rng(2)
    plain = [f"{a}{b}" for a in ("bal", "tor", "min", "sul") for b in ("en", "ar", "is", "ob", "ulk")]
    rows, labels = [], []
    for i in range(300):
        w = rng.choice(plain, 60).tolist()
        if i % 3 == 0:
            w[int(rng.integers(60))] = w[5] = str(rng.choice(["idiot", "stupid", "moron"]))
        rows.append((i, " ".join(w), None, None, 0))
        labels.append((i, 0, int(i % 3 == 0)))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(frame(spark, rows), marks.filter("doc_id < 240"))
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, rows), model).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(240, 300))
    new = [(1, "balen toris idiots minar " * 3, None, None, 0), (2, "minar sulob " * 3000 + "stuppid moronn idiott", None, None, 0), (3, None, None, None, 0), (4, "", None, None, 0), (5, "balen toris minar", None, None, 0)]
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, new), model).collect()}
    assert got[1] > 0.5 and got[2] > 0.5 and got[3] == got[4] < 0.5 and got[5] < 0.5
    assert toxicity.learn(empty, marks) is None and {r.score for r in toxicity.score(frame(spark, new), None).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0 and toxicity.score(odd(spark), model).count() == 16


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff_scores(spark, docs, rows, empty, order):
    def grams(w):
        return collections.Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))

    every, said = collections.Counter(), {r[0]: words(r[1]) for r in rows}
    for w in said.values():
        every.update(grams(w))
    total = sum(map(len, said.values()))
    got = backoff.score_documents(docs, order).collect()
    assert len(got) == len(rows)
    for r in got:
        w = said[r.doc_id]
        own, score = grams(w), 0.0
        for i in range(len(w)):
            longest = min(order, i + 1)
            for n in range(longest, 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                others = every[gram] - own[gram]
                if n == 1:
                    score += math.log(backoff.BACKOFF ** (longest - 1) * (others or 0.5) / (total - len(w)))
                elif others:
                    score += math.log(backoff.BACKOFF ** (longest - n) * others / (every[gram[:-1]] - own[gram[:-1]]))
                    break
        assert r.n_words == len(w) and math.isclose(r.log_score, score, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.mean_log_score, score / max(1, len(w)), rel_tol=1e-9, abs_tol=1e-9)
    assert backoff.score_documents(empty, order).count() == 0 and backoff.score_documents(odd(spark), order).count() == 16


def test_backoff_scores_do_not_depend_on_homes_and_ranges(spark, docs, monkeypatch):
    whole = {r.doc_id: r.log_score for r in backoff.score_documents(docs).collect()}
    monkeypatch.setattr(backoff, "HOME_BYTES", 1 << 12)
    monkeypatch.setattr(backoff, "RANGE_GRAMS", 1 << 10)
    dealt = {r.doc_id: r.log_score for r in backoff.score_documents(docs).collect()}
    assert dealt.keys() == whole.keys() and all(math.isclose(dealt[i], whole[i], rel_tol=1e-9, abs_tol=1e-9) for i in whole)
