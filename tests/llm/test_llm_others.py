"""Vectors, conversations and the pipeline."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from fixtures_llm import DOCUMENTS, corpus, frame, odd, prose, shingles

import corpus_pipeline
from estatelens.llm import chat, jaccard, mixing, repeats, vectors
from estatelens.llm.components import components


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, i) for i in range(2000, 2100)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 32))
    near = base[:40] + rng.normal(size=(40, 32)) * 0.2
    chain = [base[60]]
    for _ in range(6):
        chain.append(chain[-1] + rng.normal(size=32) * 0.25)
    v = np.concatenate([base, near, base[:10] * 3, np.tile(base[20], (30, 1)), chain])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    component = np.arange(len(v))
    for _ in range(20):
        component = np.array([component[row].min() for row in linked])
    bad = [None, [0.0] * 32, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [float("inf")] + [1.0] * 31, [], [1.0, 2.0], [1.0, 2.0]]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(1000 + i, x, None) for i, x in enumerate(bad)]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(got) == len(rows)
    missed = [i for i in range(len(v)) if got[i].n_links != linked[i].sum() - 1]
    assert len(missed) <= len(v) // 50 and all(got[i].n_links <= linked[i].sum() - 1 for i in missed)
    assert np.mean([got[i].component_id == component[i] for i in range(len(v))]) > 0.97
    assert all((got[1000 + i].n_links, got[1000 + i].component_id) == (0, 1000 + i) for i in range(6)) and got[1007].component_id == 1006
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_vectors_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, v int, key string")
    assert vectors.near_vectors(none).count() == 0
    one = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id or -1, r.n_links) for r in vectors.near_vectors(one).collect()) == [(-1, 2), (3, 2), (3, 2)]


def test_chat_round_trip_of_hostile_texts():
    rng = random.Random(1)
    bits = ["\\", "#", "### Assistant:", "### User:", "</turn>", "\n", " ", "x", '### "a":', "<", "\n</turn>\n", "é", "  \n", '"', "😀"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
        role = rng.choice(["user", "assistant", "tool", 'a"b\n', "", "Über\\"])
        piece, start, end = chat.checked(role, text)
        assert chat.parsed(piece * 2) == [(role, text)] * 2
        assert chat.unescaped(chat.escaped(text, chat.ALL), chat.ALL) == text
    assert chat.parsed("no turn") is None


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (1, 1, "assistant", "b"), (3, 0, "assistant", "</turn>" * 3000), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS piece", "2 AS loss_start")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(df)).collect()}
    assert set(got) == {1, 2, 3, None}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\nassistant\nb\n").hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, 2, hashlib.sha256(b"bb").hexdigest())
    assert (got[2].n_turns, got[2].loss_chars, got[3].loss_chars) == (1, 0, 21000)
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_pipeline_stages_on_odd_rows(spark):
    docs = odd(spark).drop("size")
    for name in ("_times", "_tie", "_copy", "_source", "_q", "col", "copies", "taken", "rest", "of", "cut", "passages", "_spans0"):
        docs = docs.withColumn(name, F.col("doc_id"))
    rows = collections.Counter(map(str, docs.collect()))
    mixed = collections.Counter(map(str, corpus_pipeline.mix_sources(spark, docs, "").collect()))
    assert set(mixed) <= set(rows) and all(mixed[r] <= 2 * n for r, n in rows.items())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0


def test_pipeline_keeps_clean_documents(spark):
    rows = [r for r in corpus() if r[1] and len(r[1]) < 3000]
    docs = frame(spark, [(i, t, "en" if i % 2 else "de", s, n) for i, t, _, s, n in rows])
    lettered = {r[0] for r in rows if any(c.isalpha() for c in r[1])}
    assert {r.doc_id for r in corpus_pipeline.keep_languages(spark, docs, "").collect()} == lettered
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()}
    texts = [r[1] for r in rows if r[0] in kept]
    assert len(set(texts)) == len(texts)
    empty = spark.createDataFrame([], DOCUMENTS)
    assert [s(spark, empty, "").count() for _, s in corpus_pipeline.STAGES] == [0] * 5


@pytest.mark.parametrize("name", ["op4_mix_sources", "op5_chat_format", "op10_jaccard_join"])
def test_queries_equal_their_sql(spark, name):
    import __spark_entry__ as entry

    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    ours = sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    theirs = con.sql(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert ours == sorted(tuple(map(str, r)) for r in theirs)


def test_pipeline_equals_brute_force(spark):
    from test_llm_documents import brute_components

    rows = [r for r in corpus(4, 20) if r[1] is None or len(r[1]) < 4000]
    docs = frame(spark, rows)
    groups = brute_components(rows)
    near = corpus_pipeline.keep_one_of_each(spark, docs, "")
    kept = sorted((r for r in rows if groups[r[0]][1] == r[0]), key=lambda r: r[0])
    assert sorted(r.doc_id for r in near.collect()) == [r[0] for r in kept]

    texts = [(r[1] or "").encode() for r in kept]
    seen = collections.Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    left = {}
    for r, t in zip(kept, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        out, at = [], 0
        for c in t.decode():
            size = len(c.encode())
            if not all(gone[at : at + size]):
                out.append(c)
            at += size
        left[r[0]] = None if r[1] is None else "".join(out)
    cut = spark.createDataFrame(corpus_pipeline.cut_repeats(spark, frame(spark, kept), "").collect(), DOCUMENTS)
    assert {r.doc_id: r.text for r in cut.collect()} == left
    assert all(r.n_chars == len(r.text) for r in cut.collect() if r.text is not None)

    copies = {r.doc_id: r.copies for r in mixing.mix(cut).collect()}
    mixed = spark.createDataFrame(corpus_pipeline.mix_sources(spark, cut, "").collect(), DOCUMENTS)
    assert collections.Counter(r.doc_id for r in mixed.collect()) == {i: n for i, n in copies.items() if n}
    tokens = collections.Counter()
    for p in corpus_pipeline.pack_sequences(spark, mixed, "").collect():
        tokens[p.doc_id] += p.length
        assert len(p.ids) == 4 * p.length
    assert set(tokens) == {i for i, n in copies.items() if n} and all(tokens[i] % copies[i] == 0 for i in tokens)


def test_near_duplicates_stage_at_five_words_and_four_fifths(spark):
    rng = random.Random(8)
    base = prose(rng, 1000).split()

    def edited(n, step):
        return " ".join(f"edit{n}x{i}" if i % step == step // 2 and i // step < n else w for i, w in enumerate(base))

    texts = [" ".join(base), edited(21, 45), edited(25, 40), prose(rng, 300), prose(rng, 30)]
    rows = [(i, t, "en", "s1", len(t)) for i, t in enumerate(texts)]
    sets = [shingles(t, 5) for t in texts]
    linked = [(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert linked == [(0, 1)] and 0.80 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) <= 0.82
    four = [shingles(t, 4) for t in texts]
    assert 100 * len(four[0] & four[1]) < 85 * len(four[0] | four[1])
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, frame(spark, rows), "").collect()} == {0, 2, 3, 4}


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_near_duplicates_stage_equals_all_pairs(monkeypatch, spark, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus()
    sets = {r[0]: shingles(r[1], 5) for r in rows}
    near = {a: [b for b in sets if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])] for a in sets}
    component = {a: a for a in sets}
    for _ in sets:
        component = {a: min([component[a], *(component[b] for b in near[a])]) for a in sets}
    got = {r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, frame(spark, rows), "").collect()}
    assert got == {a for a in sets if component[a] == a}


def brute_gone(texts, words=51, length=400):
    """Flags of the bytes in strings of so many bytes or whole words that occur more than once."""
    at = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    spans = [[(i, i + length) for i in range(len(t) - length + 1)] + [(w[i][0], w[i + words - 1][1]) for i in range(len(w) - words + 1)] for t, w in zip(texts, at, strict=True)]
    kinds = [[len(t) - length + 1 > k for k in range(len(s))] for t, s in zip(texts, spans, strict=True)]
    seen = collections.Counter((k, t[a:b]) for t, s, ks in zip(texts, spans, kinds, strict=True) for (a, b), k in zip(s, ks, strict=True))
    gone = [bytearray(len(t)) for t in texts]
    for t, s, ks, g in zip(texts, spans, kinds, gone, strict=True):
        for (a, b), k in zip(s, ks, strict=True):
            if seen[k, t[a:b]] > 1:
                g[a:b] = b"\1" * (b - a)
    return gone


def test_sections_of_a_long_text_hold_all_its_passages(monkeypatch):
    monkeypatch.setattr(repeats, "SECTION", 1 << 10)
    passages, text = repeats.Passages(51), prose(random.Random(9), 2000).encode()
    found = set()
    for batch in passages.sections([b"short", text, b""]):
        own, lo, hi, *_ = passages.hashed([b for _, _, b in batch])
        found |= {(batch[o][0], batch[o][1] + a, batch[o][1] + b) for o, a, b in zip(own.tolist(), lo.tolist(), hi.tolist(), strict=True)}
    at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    assert found == {(1, at[i][0], at[i + 50][1]) for i in range(len(at) - 50)}


def test_repeats_stage_removes_passages_of_over_fifty_words(spark):
    rng = random.Random(6)
    short, fifty, case = (" ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(n)) for n in (51, 50, 60))
    texts = [f"{prose(rng, 30)} {p} {prose(rng, 30)}" for p in (short, short, fifty, fifty, case, case.upper())]
    # Two neighbouring repeats of under 51 words each are no repeat of over 50.
    texts += [fifty + " " + short[:120] + " end"]
    rows = [(i, t, "en", "s1", len(t)) for i, t in enumerate(texts)] + [(100 + i, t, "en", "s1", n) for i, t, _, _, n in corpus(4, 20)]
    rows.append(rows[0])
    every = [(t or "").encode() for _, t, *_ in rows]
    gone = brute_gone(every)
    assert 102 <= sum(gone[1]) < 400 and not any(gone[2]) and not any(gone[4])
    left = {}
    for r, own in zip(rows, gone, strict=True):
        ends = np.cumsum([len(c.encode()) for c in r[1] or ""]).tolist()
        left[r[0]] = None if r[1] is None else "".join(c for c, a, b in zip(r[1], [0, *ends], ends, strict=False) if not all(own[a:b]))
    stage = dict(corpus_pipeline.STAGES)["repeats"]
    got = stage(spark, spark.createDataFrame(rows, DOCUMENTS).repartition(3), "").collect()
    assert len(got) == len(rows) and {r.doc_id: r.text for r in got} == left


def test_codes_meet_pairs_of_vectors_with_a_strong_mean():
    rng = np.random.default_rng(3)
    v = 0.8 * np.eye(64)[0] + 0.6 * rng.normal(size=(3500, 64)) / 8
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    x, cosine = v[2000:], rng.uniform(0.9, 0.95, (1500, 1))
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    y = cosine * x + np.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    codes = vectors.Codes(v[:2000], 20_000)
    differ = (codes(x) ^ codes(y)).view(np.uint64)
    chunks = np.stack([differ >> np.uint64(c * codes.width) & np.uint64((1 << codes.width) - 1) for c in range(codes.chunks)])
    met = (np.bitwise_count(chunks) <= 1) & (np.bitwise_count(differ) <= codes.radius)
    assert met.any(axis=(0, 2)).mean() >= 0.99


def test_vectors_of_every_dimension_are_searched(spark):
    rng = np.random.default_rng(7)
    rows = [(100 * k + i, x.tolist()) for k, dim in enumerate((32, 16)) for i, x in enumerate(rng.normal(size=(40 - 10 * k, dim)))]
    rows += [(1000 + i, [c * 1.01 if n % 2 else c for n, c in enumerate(rows[i][1])]) for i in (0, 45)]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[1000].component_id == 0 and got[1045].component_id == 105 and got[105].n_links == 1
