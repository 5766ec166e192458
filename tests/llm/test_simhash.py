import hashlib
import random
from collections import Counter

import pytest
import xxhash

from codeloom.llm import simhash as H


def edited(docs):
    out = []
    for i, (d, t) in enumerate(docs):
        t = t or ""
        m = len(t) // 3
        out.append((d, len(t), t[: len(t) - m] + (docs[(i + 1) % len(docs)][1] or "")[:m]))
    return out


def test_edited_texts_and_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in H.edited_fingerprints(docs).collect()}
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    prints = {r.doc_id: r.fingerprint for r in H.simhash(docs).collect()}
    changed = spark.createDataFrame([(d, t) for d, _, t in edited(rows)], "doc_id long, text string")
    after = {r.doc_id: r.fingerprint for r in H.simhash(changed).collect()}
    like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / H.BITS
    for i, (d, n, t) in enumerate(edited(rows)):
        g = got[d]
        assert (g.n_chars, g.edited_sha256) == (n, hashlib.sha256(t.encode()).hexdigest())
        assert (g.fingerprint, g.edited_fingerprint) == (prints[d], after[d])
        assert abs(g.near_edited - like(prints[d], after[d])) < 1e-9
        assert abs(g.near_next - like(prints[d], prints[rows[(i + 1) % len(rows)][0]])) < 1e-9


def test_likeness_tells_edits_from_other_texts(spark, sf):
    got = H.edited_fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sum(r.near_edited > r.near_next for r in got) > 0.93 * len(got)


@pytest.mark.parametrize(("radius", "blocks"), [(3, None), (3, 1), (3, 3), (6, 2)])
def test_near_pairs_against_all_pairs(spark, radius, blocks):
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in list(values):
        for n in (1, 3, 6, 7, 9):
            w = v
            for b in rng.sample(range(64), n):
                w ^= 1 << b
            values.append(w)
    every = spark.createDataFrame([(f"{v:016X}",) for v in values + values[:5]], "fingerprint string")
    asked = spark.createDataFrame([*((f"{v:016X}",) for v in values[::3]), (None,)], "fingerprint string")
    want = {(f"{a:016X}", f"{b:016X}", (a ^ b).bit_count()) for a in values[::3] for b in values if (a ^ b).bit_count() <= radius}
    got = H.find_near(asked, every, radius, blocks).collect()
    assert len(got) == len(want) and {(r.a, r.b, r.distance) for r in got} == want


def test_keys_grow_with_the_corpus():
    assert [H.table_blocks(n) for n in (10, 10**6, 10**9, 10**11)] == [1, 2, 3, 5]


def by_hand(text):
    """Each term's hash by the public algorithm, each bit's votes counted by themselves."""
    words = (text or "").encode().lower().split()
    terms = [(a, b) for a, b in zip(words, [*words[1:], None])]
    votes = [0] * 64
    for term in terms:
        h = 42
        for w in term:
            h = h if w is None else xxhash.xxh64_intdigest(w, seed=h)
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    return f"{sum(1 << i for i in range(64) if votes[i] > 0):016X}"


def test_fingerprints_against_votes_counted_by_hand(spark, sf, odd_docs):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs):
        texts = Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
        assert Counter((r.doc_id, r.fingerprint) for r in H.simhash(docs).collect()) == sum((Counter({(d, by_hand(t)): n}) for (d, t), n in texts.items()), Counter())


def test_near_documents_of_the_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = H.report(docs).collect()
    assert len(got) == docs.count()
    prints = [int(r.fingerprint, 16) for r in got]
    for r in got:
        want = sum((int(r.fingerprint, 16) ^ x).bit_count() <= H.RADIUS for x in prints) if r.doc_id % 100 == 0 else None
        assert r.near_docs == want


def test_many_buckets_and_repeated_ids(spark, monkeypatch):
    """Every document's next one, over buckets of a few rows, ties, gaps and null ids."""
    rng = random.Random(9)
    ids = sorted((rng.randrange(-(10**12), 10**12) for _ in range(400)), reverse=True)
    docs = [(d, f"text of {d} " + "x" * rng.randrange(30)) for d in ids]
    monkeypatch.setattr(H, "BUCKET_ROWS", 5)
    got = {r.doc_id: r for r in H.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, n, t in edited(docs):
        assert (got[d].n_chars, got[d].edited_sha256) == (n, hashlib.sha256(t.encode()).hexdigest())
    again = [*docs, *docs[:50], (None, "a b"), (None, "c d")]
    assert H.edited_fingerprints(spark.createDataFrame(again, "doc_id long, text string")).count() == 452


def test_odd_rows(odd_docs, no_docs):
    got = H.edited_fingerprints(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r.fingerprint for r in got if r.doc_id in (2, 3, 4)} == {"0" * 16}
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert H.edited_fingerprints(no_docs).count() == 0
    assert H.report(odd_docs).count() == odd_docs.count() and H.report(no_docs).count() == 0


def test_single_document_follows_itself(spark):
    g = H.edited_fingerprints(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert g.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and g.near_next == 1.0
