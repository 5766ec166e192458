import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import near_dedup as N
from codeloom.llm.common import Scratch


def brute(docs, k, percent=80):
    """doc_id -> (size, component, kept) by all pairs."""
    sets = []
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    at = list(range(len(docs)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    at[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i), d), d == least.get(find(i), d)) for i, (d, _) in enumerate(docs)]


def rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


@pytest.mark.parametrize("k", [2, 5])
def test_against_all_pairs(spark, sf, k):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], k)
    assert rows(N.near_duplicates(docs, k)) == sorted(want, key=repr)


def test_large_group_of_near_copies(spark):
    """More members than a region holds, at all distances up to the threshold."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for d in range(300):
        w = list(base)
        for i in rng.choice(120, d % 14, replace=False):
            w[i] = f"x{rng.integers(10**6)}"
        docs.append((d, " ".join(w)))
    got = rows(N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2))
    assert got == sorted(brute(docs, 2), key=repr)


def test_odd_rows(odd_docs):
    want = brute([(r.doc_id, r.text) for r in odd_docs.collect()], 2)
    assert rows(N.near_duplicates(odd_docs, 2)) == sorted(want, key=repr)
    left = N.deduplicate(odd_docs, 2)
    assert left.columns == odd_docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == [1, 2, 3, 4, 6, 7, 8, None]


def test_empty(no_docs):
    assert N.near_duplicates(no_docs, 2).count() == 0


def test_signatures_of_very_large_sets_differ():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**63, 600_000).astype(np.uint64)) for _ in range(2))
    assert (N.signature(a) == N.signature(b)).mean() < 0.05


def test_members_of_a_crowded_region_that_misfit_its_first(spark):
    """Fourteen sets of one signature; the least class fits none by size, and two are near copies."""
    members = {1: list(range(5)), 2: list(range(1000, 1100)), 3: list(range(1000, 1095))}
    members |= {c: list(range(10_000 * c, 10_000 * c + 20 * c)) for c in range(4, 15)}
    sig = bytes(2 * N.TREES * N.DEPTH)
    sets = spark.createDataFrame([(c, len(m), sig, m) for c, m in members.items()], "cls long, n long, sig binary, members array<long>")
    labels = N.link(sets.select("cls", "n", "sig"), lambda wanted: sets.select("cls", "n", "members").join(wanted, "cls"), 80, Scratch(spark))
    assert {r.cls: r.label for r in labels.collect() if r.cls != r.label} == {3: 2}


def test_a_large_family_makes_few_pairs(spark):
    """2,000 near copies: the rounds compare a bounded number of pairs a class, and all end in one component."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(400)]
    docs = []
    for d in range(2000):
        w = list(base)
        for i in rng.choice(400, 3, replace=False):
            w[i] = f"x{rng.integers(10**9)}"
        docs.append((d, " ".join(w)))
    docs = spark.createDataFrame(docs, "doc_id long, text string").cache()
    scratch = Scratch(spark)
    rows = scratch.keep(N.signatures(docs, 5), "signatures")
    classes = rows.select("cls", F.col("n_shingles").alias("n"), "sig")
    regions = N.forest(classes, scratch)
    first = N.deepest(regions)
    assert first.count() <= 2000
    sets = scratch.keep(N.whole_sets(docs, rows, 5), "sets")
    links = scratch.keep(N.confirm(first, sets, 80), "links")
    labels = N.components(classes.select("cls"), links, scratch)
    assert N.apart(regions, labels, 80, scratch).count() <= 20 * 2000
    assert {r.component_id for r in N.near_duplicates(docs, 5).collect()} == {0}
