import math
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from codeloom.llm import context_tree as C


def brute(texts, depth=C.DEPTH):
    """log10 probability of every text by the recursive definition, over plain dictionaries."""
    counts = defaultdict(lambda: [0, 0])
    for t in texts:
        raw = b"\n" * depth + C.canonical(t)
        for i in range(depth, len(raw)):
            for b in range(8):
                for d in range(depth + 1):
                    counts[raw[i - d : i], (1 << b) | (raw[i] >> (8 - b))][(raw[i] >> (7 - b)) & 1] += 1
    below = defaultdict(set)
    for ctx, node in counts:
        if ctx:
            below[ctx[1:], node].add(ctx)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @lru_cache(None)
    def weighted(ctx, node):
        own = kt(*counts[ctx, node])
        if len(ctx) == depth:
            return own
        return np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(weighted(c, node) for c in below[ctx, node]))

    def p(ctx_full, d, node, bit):
        ctx = ctx_full[len(ctx_full) - d :]
        if (ctx, node) not in counts:
            return None
        n = counts[ctx, node]
        own = (n[bit] + 0.5) / (sum(n) + 1)
        deeper = p(ctx_full, d + 1, node, bit) if d < depth else None
        if deeper is None:
            return own
        w = math.exp(math.log(0.5) + kt(*n) - weighted(ctx, node))
        return w * own + (1 - w) * deeper

    def score(t):
        raw, total = b"\n" * depth + C.canonical(t), 0.0
        for i in range(depth, len(raw)):
            for b in range(8):
                total += math.log10(p(raw[i - depth : i], 0, (1 << b) | (raw[i] >> (8 - b)), (raw[i] >> (7 - b)) & 1) or 0.5)
        return total

    return score


@pytest.mark.parametrize(("chunk_bytes", "limits"), [(60, {}), (10**7, {}), (9, {"part_bytes": 30, "split_bytes": 50, "bucket_bytes": 20})])
def test_against_the_definition(spark, chunk_bytes, limits):
    texts = ["the cat sat", "The cat  ran\tfar", "a dog sat", None, "", "zebra ÄÖ", "the the the the", "cat", "on the mat the cat", "unseen QXJ words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as chunk", "2 as key")
    got = {r.doc_id: r for r in C.score(docs, chunk_bytes, **limits).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    assert {i: r.held_out for i, r in got.items()} == held
    train = [t for i, t in enumerate(texts) if not held[i]]
    score = brute(train)
    words = Counter(w for t in train for w in [*C.canonical(t).split(), b"\n"])
    total, types = sum(words.values()), len(words)
    for i, t in enumerate(texts):
        tokens = [*C.canonical(t).split(), b"\n"]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(words[w] > 0 for w in tokens), total)
        assert abs(r.base_score - sum(math.log10((words[w] + 0.5) / (total + 0.5 * (types + 1))) for w in tokens)) < 1e-9
        assert r.n_bytes == len(C.canonical(t))
        assert abs(r.score - score(t)) < 1e-6 * max(1, r.n_bytes)


def test_probabilities_of_a_context_add_up_to_one(spark):
    grams = np.sort(C.gram_keys(b"abcabcabd\n", np.array([10])))
    keys, n = C.grouped(grams, np.ones(len(grams), np.int64))
    trees = C.subtrees(keys, n)
    import pandas as pd

    node, zeros, ones, logs, _ = trees[2]
    first = C.grouped(((node >> 16) << 8) | (node & 255), zeros, ones, logs)
    tops = C.tops(pd.DataFrame(dict(zip(("node", "zeros", "ones", "below"), first, strict=True))))
    context = (int(keys[0]) >> 8) << 8
    assert abs((10 ** C.log10_bytes(np.arange(context, context + 256), trees, *tops)).sum() - 1) < 1e-9


def test_blobs_come_back(spark):
    keys = np.sort(np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 1000))
    assert (C.unpack_keys(C.pack_keys(keys)) == keys).all()
    assert (C.unpack(C.pack(keys), "<i8") == keys).all()
    assert len(C.unpack(C.pack(np.zeros(0, np.int64)), "<i8")) == 0


def test_keys_against_plain_slices():
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 100, rng.integers(1, 20))) + b"\n" for _ in range(50)]
    pad = b"\n" * C.DEPTH
    want = [int.from_bytes((pad + t)[i : i + C.DEPTH][::-1] + t[i : i + 1], "big") for t in texts for i in range(len(t))]
    assert C.gram_keys(b"".join(texts), np.array([len(t) for t in texts])).tolist() == want
    given = [C.DEPTH if i % 3 == 1 and len(t) > C.DEPTH else 0 for i, t in enumerate(texts)]
    want = [int.from_bytes(((b"" if g else pad) + t)[i : i + C.DEPTH][::-1] + ((b"" if g else pad) + t)[i + C.DEPTH : i + C.DEPTH + 1], "big") for g, t in zip(given, texts) for i in range(len(t) - g)]
    assert C.gram_keys(b"".join(texts), np.array([len(t) for t in texts]), given=np.array(given)).tolist() == want


def test_words_of_texts():
    words = C.Words()
    hashed, codes, n = words.hashes([b"a b a\n", b"\n", b"b c ", b""])
    assert n.tolist() == [3, 0, 2, 0] and len({hashed[c] for c in codes}) == 3
    assert codes.tolist()[0] == codes.tolist()[2] and codes.tolist()[1] == codes.tolist()[3]


def test_segments_are_whole_words():
    text = C.canonical("one two three four five six seven" * 3)
    for most in (1, 5, 12, 1000):
        parts = list(C.segments(text, most))
        assert b"".join(t[g:] for g, t, _ in parts) == text
        assert [w for g, t, _ in parts for w in t[g:].split()] == text.split()
        assert [last for *_, last in parts] == [False] * (len(parts) - 1) + [True]


def test_a_very_long_text_is_scored_as_a_whole(spark):
    rng = np.random.default_rng(1)
    text = " ".join(f"w{i}" for i in rng.integers(0, 300, 40_000))
    docs = spark.createDataFrame([(1, text), (2, "w1 w2"), (3, text[:5000])], "doc_id long, text string")
    whole, cut = ({r.doc_id: r for r in C.score(docs, n).collect()} for n in (10**7, 10_000))
    assert len(cut) == 3
    for d, r in whole.items():
        assert (r.n_tokens, r.n_known, r.train_tokens, r.n_bytes) == (cut[d].n_tokens, cut[d].n_known, cut[d].train_tokens, cut[d].n_bytes)
        assert abs(r.score - cut[d].score) < 1e-6 * r.n_bytes


def test_the_sixth_byte_before_conditions_a_byte(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    other = next(i for i in range(held + 1, 100) if zlib.crc32(str(i).encode()) % 5 == 1)
    train = [(i, "q12345a r12345b " * 20) for i in range(100, 130)]
    docs = spark.createDataFrame([*train, (held, "q12345a"), (other, "q12345b")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in C.score(docs).collect()}
    assert got[held] > got[other] + 1


def test_odd_rows(odd_docs, no_docs):
    assert C.score(odd_docs).count() == odd_docs.count()
    assert C.score(no_docs).count() == 0
