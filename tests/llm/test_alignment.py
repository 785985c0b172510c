"""Alignment of two tokenizers against all pairs of byte ranges."""

import collections
import hashlib
import random

import public_tokenizers
import sentencepiece
from fixtures_llm import corpus, frame, odd
from tokenizers import Tokenizer

from estatelens.llm import alignment

ODD = ["<s> </s><unk> <0x41> <|endoftext|>", "a▁b", "\x00x\x7f", "é é ﬁ ½", "  two  spaces\n\n\tx ", "�", " " * 5000 + "end", "漢字かな 👩‍🚀", "a" * 3000, "　\xa0x", "'s 'LL don't 12345 +-*/", " ", "   ", "a ", "a  ", "\nx", "x \n y", "x\n  y  \n", "x\x1c y", "é ó ñ", "x　 y\xa0 z\u2028 w", "a. b, c", "▁", "ab cd" * 400]


def brute(texts):
    a_tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = alignment.byte_alphabet()
    docs = []
    for text in texts:
        whole = (" " + text).encode() if text else b""
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        a_bytes = [bytes(alphabet[c] for c in a_tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            a, b, a_bytes, b_bytes = [], [], [], []

        def spans(parts):
            at = 0
            for p in parts:
                yield at, at + len(p)
                at += len(p)

        a_span, b_span = list(spans(a_bytes)), list(spans(b_bytes))
        links = [(i, j) for i, (s, e) in enumerate(a_span) for j, (x, y) in enumerate(b_span) if s < y and x < e] if len(a) < 3000 else None
        if links is None:
            links, j0 = [], 0
            for i, (s, e) in enumerate(a_span):
                while b_span[j0][1] <= s:
                    j0 += 1
                j = j0
                while j < len(b) and b_span[j][0] < e:
                    links.append((i, j))
                    j += 1
        common = sorted({e for _, e in a_span} & {e for _, e in b_span})
        groups, lo = [], 0
        for hi in common:
            groups.append((",".join(str(t) for t, (s, e) in zip(a, a_span) if lo < e <= hi) if len(a) < 3000 else None, lo, hi))
            lo = hi
        docs.append((a, b, a_span, b_span, links, common))
    holds = collections.Counter(p for a, b, _, _, links, _ in docs for p in {(a[i], b[j]) for i, j in links})
    best = collections.defaultdict(int)
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    out = []
    for a, b, a_span, b_span, links, common in docs:
        text, i, j = [], 0, 0
        for hi in common:
            i0, j0 = i, j
            while i < len(a) and a_span[i][1] <= hi:
                i += 1
            while j < len(b) and b_span[j][1] <= hi:
                j += 1
            text.append(",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])))
        pairs = [(a[i], b[j]) for i, j in links]
        digest = hashlib.sha256(";".join(text).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(common), len(links), digest, sum(holds[p] == best[p[0]] for p in pairs), sum(holds[p] for p in pairs)))
    return out


def test_links_equal_all_overlaps(spark):
    rows = corpus(4, 30)
    rows += [(1000 + n, t, None, None, 0) for n, t in enumerate(ODD)] + [(5000, "x y z", None, None, 0)] * 2
    got = collections.defaultdict(list)
    for r in alignment.score_links(frame(spark, rows)).collect():
        got[r.doc_id].append((r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum))
    want = collections.defaultdict(list)
    for row, x in zip(rows, brute([r[1] for r in rows])):
        want[row[0]].append(x)
    assert got == want
    assert want[1001][0][:2] == (0, 0) and want[1000][0][0] > 0


def test_stretches_of_random_cuts():
    rng = random.Random(2)
    for _ in range(2000):
        total = rng.randrange(1, 60)
        a, b = (sorted({*rng.sample(range(1, total + 1), rng.randrange(0, total + 1)), total}) for _ in range(2))
        if rng.random() < 0.3:
            b = a[:]
        parts, left, right = alignment.stretches(a, b)
        ends = [e for straight, i, i2, j, j2 in parts for e in (a[i:i2] if straight else [a[i2 - 1]])]
        assert ends == sorted(set(a) & set(b))
        assert [p[1] for p in parts] == [0, *[p[2] for p in parts[:-1]]] and parts[-1][2] == len(a) and parts[-1][4] == len(b)
        assert all(a[i:i2] == b[j:j2] for straight, i, i2, j, j2 in parts if straight)
        assert [min(a[i], b[j]) for i, j in zip(left, right)] == sorted(set(a) | set(b))


def test_alignments_spell_the_text(spark):
    r = alignment.alignments(frame(spark, [(1, "hello wörld, hello", None, None, 0), (2, None, None, None, 0)])).orderBy("doc_id").collect()
    assert r[0].byte_ends[-1] == len(" hello wörld, hello".encode()) and r[0].a_ends[-1] == len(r[0].a_ids) and r[0].b_ends[-1] == len(r[0].b_ids)
    assert r[1].a_ids == [] and r[1].byte_ends == []


def test_alignment_of_odd_rows(spark):
    rows = odd(spark)
    assert alignment.score_links(rows).count() == rows.count()
    assert alignment.score_links(rows.limit(0)).count() == 0
