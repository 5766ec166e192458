"""SimHash fingerprints with DataFrame functions only.

The terms of a text are its pairs of neighbouring words (runs of non-white-space, A-Z lowered); a text of one word has
that word. Each term's 64-bit hash votes on the signed bits, as often as the term occurs. The votes are counted after
exploding the terms, as sums with partial aggregation: two counters of 32 bits share a long, so that 32 sums count 64
bits and no array is built for a bit. A fingerprint is 16 hexadecimal digits.

find_near gives all fingerprints within a Hamming radius of those asked for by permuted block tables: the bits are cut
into radius + m blocks; two fingerprints within the radius agree in m of them at least, so that each choice of m blocks
is a table keyed by their bits. m grows with the number of fingerprints, so that a key has some KEY_ROWS of unrelated
ones at most. Equal fingerprints are one entry, so copies make no pairs, and a pair counts in the first table that has it.

Nulls: a null text is an empty one; texts without words have no votes and the fingerprint of zeros. Equal texts have
equal fingerprints. Rows with equal or null doc_id are kept apart. Extra columns are left alone. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import Scratch, ascii_lower

BITS = 64
RADIUS = 3
#: Unrelated fingerprints that a key of a block table has on average, at most.
KEY_ROWS = 0.25
#: Rows whose id is divisible by this are the queries of the search.
QUERY_STEP = 100
#: Buckets of doc_id ranges in which the next document is looked up: one for so many rows, and the most of them. Their
#: bounds are quantiles of a hashed sample of SAMPLE_IDS ids a bucket; a larger bucket is a longer sort, which spills.
BUCKET_ROWS, BUCKETS, SAMPLE_IDS = 64, 20_000, 20
_LOW = 0x0000000100000001
_BLANK = " \t\n\x0b\f\r"
_SPACE = r"[\x20\x09-\x0D]+"


def terms_of(text: Column) -> Column:
    """Array of structs: each word with the next one (null after the last); null for a text without words."""
    bare = F.btrim(ascii_lower(text), F.lit(_BLANK))
    # as a lambda's argument, the words are split once for all three uses
    zipped = F.transform(F.array(F.split(bare, _SPACE)), lambda w: F.arrays_zip(w, F.slice(w, F.lit(2), F.size(w))))
    return F.when(F.length(bare) > 0, zipped[0])


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and fingerprint of rows; together, keys must be unique. No exchange where rows are dealt out by some keys."""
    terms = rows.select(*keys, F.explode_outer(terms_of(F.col(text))).alias("term"))
    pair = terms.select(*keys, F.col("term").isNotNull().cast("int").alias("one"), F.xxhash64("term").alias("h"))
    votes = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_LOW))).alias(f"v{i}") for i in range(32)]
    counted = pair.groupBy(*keys).agg(F.sum("one").alias("n"), *votes)
    return counted.select(*keys, F.lpad(F.hex(F.when(F.col("n") > 0, _signs()).otherwise(F.lit(0))), 16, "0").alias("fingerprint"))


def _signs() -> Column:
    """Bit i is set where over half of the terms set it; ties give 0."""
    votes = ", ".join(f"v{i}" for i in range(32))
    low, high = f"if(2 * (v & {0xFFFFFFFF}L) > n, shiftleft(1L, i), 0L)", "if(2 * shiftrightunsigned(v, 32) > n, shiftleft(1L, i + 32), 0L)"
    return F.expr(f"aggregate(transform(array({votes}), (v, i) -> {low} | {high}), 0L, (a, x) -> a | x)")


def as_long(fingerprint: Column) -> Column:
    top = F.conv(F.substring(fingerprint, 1, 8), 16, 10).cast("long")
    return F.shiftleft(top, 32).bitwiseOR(F.conv(F.substring(fingerprint, 9, 8), 16, 10).cast("long"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(as_long(a).bitwiseXOR(as_long(b)))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return (1 - distance(a, b) / F.lit(float(BITS))).cast("double")


def bounds_of(docs: DataFrame) -> list[int]:
    """Ids that cut docs into ranges of about BUCKET_ROWS rows, BUCKETS ranges at most."""
    n = docs.count()
    wanted = max(1, min(BUCKETS, n // BUCKET_ROWS))
    share = min(1.0, SAMPLE_IDS * wanted / max(n, 1))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    ids = np.sort(docs.filter(F.col("doc_id").isNotNull() & drawn).select("doc_id").distinct().toArrow()["doc_id"].to_numpy())
    return sorted({int(ids[len(ids) * i // wanted]) for i in range(1, wanted)}) if len(ids) else []


def bucketed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with bucket, ghost: buckets are ranges of doc_id, and each also has the first row of the
    range that follows in descending order (after the last range: the first one), marked as ghost.

    Only the bounds reach the driver; a table of one row a bucket is broadcast.
    """
    bounds = bounds_of(docs)
    n_bounds = len(bounds)
    limits = F.broadcast(docs.sparkSession.createDataFrame([(bounds,)], "limits array<long>"))
    # the number of bounds from the id upwards, by halving: buckets ascend as ids descend, and null ids come last
    steps = ", ".join(str(1 << i) for i in reversed(range(max(1, n_bounds.bit_length()))))
    smaller = f"aggregate(array({steps}), 0, (at, step) -> if(at + step <= {n_bounds} and limits[at + step - 1] < doc_id, at + step, at))"
    below = F.expr(f"if(doc_id is null, {n_bounds + 1}, {n_bounds} - {smaller})")
    rows = docs.join(limits).select("doc_id", "text", below.cast("int").alias("bucket"))
    tops = rows.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    # at most BUCKETS + 1 rows, so one task orders them
    circle = Window.partitionBy(F.lit(0)).orderBy("bucket")
    last = F.max("bucket").over(Window.partitionBy(F.lit(0)))
    before = F.broadcast(tops.select("top", F.coalesce(F.lag("bucket").over(circle), last).alias("before"), F.lit(1).alias("ghost")))
    first = rows.select("doc_id", "text").join(before, F.col("doc_id").eqNullSafe(F.col("top")))
    ghosts = first.groupBy("before", "doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", F.col("before").alias("bucket"), F.lit(1).alias("ghost"))
    return rows.withColumn("ghost", F.lit(0)).unionByName(ghosts)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text is the text with its last third (rounded down) of code points replaced by as many first ones (or
    all) of the next document in descending doc_id order. Texts are shuffled once, by bucket; all that follows keeps
    that partitioning.
    """
    rows = bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    placed = rows.select("*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text"))
    placed = placed.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, int(n_chars) - int(floor(n_chars / 3)))"), F.substring(F.col("next_text"), F.lit(1), cut))
    placed = placed.select("bucket", "place", "ghost", "doc_id", "n_chars", "text", F.when(F.col("ghost") == 0, edited).alias("edited"))
    placed = placed.withColumn("sha", F.sha2(F.col("edited"), 256))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text"), F.lit(None).cast("string").alias("sha")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text"), F.col("sha")))
    both = placed.select("bucket", "place", "ghost", "doc_id", "n_chars", F.explode(kinds).alias("x")).select("bucket", "place", "ghost", "doc_id", "n_chars", "x.kind", "x.sha", "x.text")
    prints = fingerprints(both, ["bucket", "place", "kind", "ghost", "doc_id", "n_chars", "sha"], "text")
    # the rows of a bucket: each document's text, its edited text, then the next document's text
    by_place = Window.partitionBy("bucket").orderBy("place", "kind")
    beside = prints.select("*", F.lead("sha").over(by_place).alias("edited_sha256"), F.lead("fingerprint").over(by_place).alias("edited_fingerprint"), F.lead("fingerprint", 2).over(by_place).alias("next_fingerprint"))
    out = beside.filter("kind = 0 and ghost = 0")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def simhash(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("uid", F.monotonically_increasing_id())
    return fingerprints(rows, ["uid", "doc_id"], "text").select("doc_id", "fingerprint")


def table_blocks(n: float, radius: int = RADIUS) -> int:
    """Blocks that a key is made of for n fingerprints: the fewest whose bits leave KEY_ROWS of them to a key."""
    wanted = math.log2(max(n, 1) / KEY_ROWS)
    return next((m for m in range(1, 12) if BITS * m / (radius + m) >= wanted), 12)


def find_near(asked: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(a, b, distance) of all fingerprints b (column fingerprint of prints) within the radius of a (of asked)."""
    entries, queries = (x.select("fingerprint").dropna().distinct() for x in (prints, asked))
    m = blocks or table_blocks(entries.count(), radius)
    cuts = [BITS * i // (radius + m) for i in range(radius + m + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(parts, m)]
    masks = [x - (1 << 64) if x >> 63 else x for x in masks]

    def tables(rows: DataFrame, name: str) -> DataFrame:
        keyed = rows.select(as_long(F.col("fingerprint")).alias(name), F.posexplode(F.array(*[F.lit(x) for x in masks])).alias(f"{name}_table", "mask"))
        return keyed.select(name, f"{name}_table", F.col(name).bitwiseAND(F.col("mask")).alias(f"{name}_key"))

    x = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(mask)) == 0, F.lit(t)) for t, mask in enumerate(masks)])
    same = (F.col("a_table") == F.col("b_table")) & (F.col("a_key") == F.col("b_key")) & (F.bit_count(x) <= radius) & (first == F.col("a_table"))
    near = tables(queries, "a").join(tables(entries, "b"), same)
    text = [F.lpad(F.hex(c), 16, "0").alias(c) for c in ("a", "b")]
    return near.select(*text, F.bit_count(x).alias("distance"))


def with_near(prints: DataFrame, radius: int = RADIUS, step: int = QUERY_STEP) -> DataFrame:
    """prints (doc_id, fingerprint, ...) with near_docs, for rows whose id is divisible by step: how many rows, itself
    among them, have a fingerprint within the radius. Null for the others."""
    is_query = F.coalesce(F.col("doc_id") % step == 0, F.lit(False))
    counts = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).select(F.col("fingerprint").alias("b"), "n")
    queries = prints.filter(is_query)
    near = find_near(queries, prints, radius).join(counts, "b").groupBy("a").agg(F.sum("n").alias("near_docs"))
    found = queries.join(near, F.col("fingerprint") == F.col("a"), "left").drop("a")
    return found.unionByName(prints.filter(~is_query).withColumn("near_docs", F.lit(None).cast("long")))


def report(docs: DataFrame) -> DataFrame:
    """edited_fingerprints of docs, with near_docs."""
    scratch = Scratch(docs.sparkSession)
    return with_near(scratch.keep(edited_fingerprints(docs), "fingerprints"))
