import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import mixing as M


def test_rates_and_counts(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "'t' as text", "case when id % 3 = 0 then 'hot' else concat('s', id % 4) end as source")
    got = M.mix(docs, {"hot": 1.0, "s0": 1.0, "s1": 2.0}).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert set(n) == {"hot", "s0", "s1"}
    for s, share in (("hot", 0.25), ("s0", 0.25), ("s1", 0.5)):
        assert abs(n[s] - 6000 * share) < 5 * math.sqrt(6000 * share)


def test_same_copies_whatever_the_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    key = lambda df: sorted((r.doc_id, r["copy"], r.n_copies) for r in df.select("doc_id", "copy", "n_copies").collect())
    assert key(M.mix(docs)) == key(M.mix(docs.repartition(7)))
    old = M.BROADCAST_SOURCES
    try:
        M.BROADCAST_SOURCES = 0
        assert key(M.mix(docs)) == key(M.mix(docs.repartition(3)))
    finally:
        M.BROADCAST_SOURCES = old
    order = [r.doc_id for r in M.mix(docs).collect()]
    assert order != sorted(order)


def test_odd_rows(odd_docs, no_docs):
    got = M.mix(odd_docs, total=5.0)
    assert got.columns == [c for c in odd_docs.columns if c != "copy"] + ["copy", "n_copies"]
    assert got.filter("source is null").count() > 0
    assert M.mix(no_docs).count() == 0


def naive_count(rate, u):
    """Sums the distribution from 0 in exact fractions of its logs."""
    k, total = 0, 0.0
    while rate > 0:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if total > u or k > rate + 40 * math.sqrt(rate) + 60:
            return k
        k += 1
    return 0


def counts(spark, pairs):
    df = spark.createDataFrame([(i, float(r), float(u)) for i, (r, u) in enumerate(pairs)], "i int, rate double, u double")
    return [r.n for r in df.select("i", M.poisson_count(F.col("rate"), F.col("u")).alias("n")).orderBy("i").collect()]


def test_inverse_against_the_sum_from_zero(spark):
    rng = np.random.default_rng(5)
    pairs = [(rate, u) for rate in (0.0, 1e-9, 0.03, 0.7, 1.0, 3.5, 40.0, 239.0, 241.0, 600.0, 5000.0) for u in [*([0.0] if rate < 100 else []), *rng.random(40)]]
    assert counts(spark, pairs) == [naive_count(r, u) for r, u in pairs]
    big = np.array(counts(spark, [(1e6, u) for u in rng.random(300)]))
    assert abs(big.mean() - 1e6) < 300 and 700 < big.std() < 1300
    assert 21 <= counts(spark, [(2.0, 1 - 2.0**-53)])[0] <= 25  # the sum's last digit


def test_log_factorial(spark):
    got = spark.range(0, 400).select("id", M.log_factorial(F.col("id").cast("double")).alias("x")).collect()
    assert all(abs(r.x - math.lgamma(r.id + 1)) < 1e-11 * max(1, r.x) for r in got)


@pytest.mark.parametrize("broadcast", [True, False])
def test_every_documents_count(spark, sf, monkeypatch, broadcast):
    """Both ways of joining, against counts summed in Python."""
    if not broadcast:
        monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rates = {r.source: r.rate for r in M.source_rates(docs).collect()}
    by_hand = {r.doc_id: naive_count(rates[r.source], r.u) for r in docs.select("doc_id", "source", M.uniform(20240229, F.xxhash64(F.col("doc_id").cast("string"))).alias("u")).collect()}
    got = Counter(r.doc_id for r in M.mix(docs).collect())
    assert {d: got[d] for d in by_hand} == by_hand
