"""Mixing sources to target weights by Poisson replication.

The target repetition rate of a source is weight * total / documents, its weight being a share of all weights. Each
document's count inverts the Poisson distribution with that mean at a uniform number drawn from a hash of its doc_id
and the seed, so that every run, on any number of machines, gives the same copies. Only the rate, one number, travels
with a row, and the distribution is summed around its mean where the row is. Copies are dealt out by a hash in random
order: rows come in that order, partition after partition.

Nulls: a null source is a source of its own; a null doc_id draws by its text. Sources without a weight get none of the
total (rate 0). Repeated rows with one doc_id draw the same count. An empty table stays empty. Texts are never read,
except for null ids. The columns ``copy`` and ``n_copies`` are added; input columns with these names are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import materialise

#: The table of rates (source, rate) is broadcast up to so many sources and bytes of their names, and joined salted beyond.
BROADCAST_SOURCES, BROADCAST_BYTES = 10_000, 1_000_000
SALTS = 64
#: The distribution is summed over so many standard deviations on both sides of the mean, and so many counts more: what
#: lies outside is below 1e-17. The work for a row is a small multiple of the copies that its rate stands for.
SPREAD, MORE = 12, 40


def log_factorial(n: Column) -> Column:
    """ln(n!) of a whole number by Stirling's series at n + 9, 1e-11 off at most."""
    y = n + 9.0
    up = reduce(lambda a, b: a * b, [n + float(i) for i in range(1, 9)])
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - 1 / (1680 * y * y * y * y * y * y * y)
    return F.when(n <= 1, 0.0).otherwise(series - F.log(up))


def poisson_count(rate: Column, uniform: Column) -> Column:
    """The least k whose P(count <= k) is above the uniform number; 0 for rates that aren't above 0.

    Terms follow one another from the first count of the window on, P(k + 1) = P(k) * rate / (k + 1).
    """
    spread = SPREAD * F.sqrt(rate) + MORE
    first = F.greatest(F.lit(0.0), F.floor(rate - spread).cast("double"))
    steps = F.sequence(F.lit(1), (F.ceil(rate + spread).cast("double") - first).cast("int"))
    term = F.exp(first * F.log(rate) - rate - log_factorial(first))

    def counted(x: Column) -> Column:
        start = F.struct(x["term"].alias("term"), x["term"].alias("sum"), F.lit(0).alias("n"))

        def add(acc: Column, i: Column) -> Column:
            next_term = acc["term"] * x["rate"] / (x["first"] + i)
            return F.struct(next_term.alias("term"), (acc["sum"] + next_term).alias("sum"), (acc["n"] + F.when((acc["sum"] <= x["u"]) & ((x["first"] + i <= x["rate"]) | (acc["term"] > 1e-17)), 1).otherwise(0)).alias("n"))

        return (F.aggregate(x["steps"], start, add, lambda acc: acc["n"]) + x["first"]).cast("int")

    given = F.struct(rate.alias("rate"), uniform.alias("u"), first.alias("first"), term.alias("term"), steps.alias("steps"))
    return F.when(rate > 0, F.transform(F.array(given), counted)[0]).otherwise(F.lit(0))


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, exponent: float = 0.5, total: float = 1.0) -> DataFrame:
    """(source, n_docs, rate); weights default to n_docs ** exponent; total is the output's size over the input's."""
    counts = materialise(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs")), "mix-counts")
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(float(exponent))))
    else:
        given = docs.sparkSession.createDataFrame([(str(k), float(v)) for k, v in weights.items()] or [("", 0.0)], "source string, weight double")
        counts = counts.join(given, "source", "left").fillna(0.0, ["weight"])
    sums = counts.agg(F.sum("weight").alias("w"), F.sum("n_docs").alias("n")).first()
    scale = total * (sums.n or 0) / sums.w if sums.w else 0.0
    return counts.withColumn("rate", F.col("weight") * F.lit(scale) / F.col("n_docs")).select("source", "n_docs", "rate")


def uniform(seed: int, *columns) -> Column:
    """In [0, 1), from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") * F.lit(2.0**-53)


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, exponent: float = 0.5, total: float = 1.0, seed: int = 20240229) -> DataFrame:
    """docs, each as often as its count says, in a global random order, with copy (from 0) and n_copies."""
    columns = [c for c in docs.columns if c not in ("copy", "n_copies")]
    rates = materialise(source_rates(docs, weights, exponent, total).withColumnRenamed("source", "__source").select("__source", F.col("rate").alias("__rate")), "mix-rates")
    ident = F.xxhash64(F.when(F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.col("doc_id").cast("string")))
    rows = docs.select(*columns, ident.alias("__ident"))
    size = rates.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("__source")).alias("bytes")).first()
    if size.n <= BROADCAST_SOURCES and (size.bytes or 0) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(rates), F.col("source").eqNullSafe(F.col("__source")))
    else:
        salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("__salt_of", F.pmod("__ident", F.lit(SALTS)).cast("int")).join(salted, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__salt_of") == F.col("__salt")))
    u = uniform(seed, "__ident")
    counted = joined.select(*columns, "__ident", poisson_count(F.col("__rate"), u).alias("n_copies"))
    copies = counted.filter("n_copies > 0").select(*columns, "__ident", "n_copies", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"))
    order = copies.withColumn("__order", F.xxhash64(F.lit(seed + 1), "__ident", "copy"))
    return order.repartitionByRange("__order").sortWithinPartitions("__order").select(*columns, "copy", "n_copies")
