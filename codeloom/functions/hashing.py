"""FNV-1a hashes and the MinHash signature of bodies."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
BASIS, PRIME, MIX = 0xCBF29CE484222325, 0x100000001B3, 0x9E3779B97F4A7C15
TOKENS, HASHES, BANDS = 5, 16, 4
#: Shingles that advance together.
STEP = 8192
_MASK = (1 << 64) - 1


def fnv1a(data: bytes, start: int = BASIS) -> int:
    h = start
    for b in data:
        h = (h ^ b) * PRIME & _MASK
    return h


def fnv1a_hex(data: bytes) -> str:
    return f"{fnv1a(data):016x}"


def fnv1a_column(text: Column) -> Column:
    """FNV-1a of a text's UTF-8 bytes, or of binary ones, as a long on the JVM; the product is taken in 32-bit halves,
    since longs don't wrap."""
    pairs = F.regexp_extract_all(F.hex(text.cast("binary")), F.lit("(..)"), F.lit(1))

    def step(h: Column, pair: Column) -> Column:
        x = h.bitwiseXOR(F.conv(pair, 16, 10).cast("long"))
        low = x.bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(0x1B3)
        high = F.shiftrightunsigned(x, 32) * F.lit(0x1B3) + F.shiftrightunsigned(low, 32) + F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.shiftleft(high.bitwiseAND(F.lit(0xFFFFFFFF)), 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))

    return F.aggregate(pairs, F.lit(BASIS - (1 << 64)), step)


_TOKEN = re.compile(r"[^\W_]+")


def tokens_of(text: str) -> list[bytes]:
    """Runs of alphanumeric characters, A-Z lowered."""
    return " ".join(_TOKEN.findall(text)).encode().lower().split()


def body_minhash(text: str | None) -> list[int] | None:
    """The four band values: minima over four seeded hashes and all five-token shingles; None below five tokens."""
    return minhashes([text])[0]


def minhashes(texts: list[str | None]) -> list[list[int] | None]:
    """body_minhash of each text. Shingles lie in one buffer as they stand, token, blank, token; those of many texts
    advance together by a byte, the longest first, so that the ones that have ended drop off the end."""
    tokens = [tokens_of(t or "") for t in texts]
    out: list[list[int] | None] = [None] * len(texts)
    seeds = np.array([BASIS ^ ((i + 1) * MIX & _MASK) for i in range(HASHES)], np.uint64)[:, None]
    kept = [i for i, t in enumerate(tokens) if len(t) >= TOKENS]
    if not kept:
        return out
    raw = np.frombuffer(b" ".join(b" ".join(tokens[i]) for i in kept), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) for i in kept for t in tokens[i]])
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    counts = np.array([len(tokens[i]) - TOKENS + 1 for i in kept])
    first = np.cumsum(counts + TOKENS - 1) - (counts + TOKENS - 1)
    at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    begin, length = starts[at], starts[at + TOKENS - 1] + sizes[at + TOKENS - 1] - starts[at]
    owner = np.repeat(np.arange(len(kept)), counts)
    least = np.full((HASHES, len(kept)), _MASK, np.uint64)
    for i in range(0, len(at), STEP):
        some = np.argsort(-length[i : i + STEP], kind="stable") + i
        ends, h = length[some], np.repeat(seeds, len(some), axis=1)
        alive = len(some)
        for j in range(int(ends[0])):
            while alive and ends[alive - 1] <= j:
                alive -= 1
            h[:, :alive] = (h[:, :alive] ^ raw[begin[some[:alive]] + j]) * np.uint64(PRIME)
        back = np.empty_like(h)
        back[:, some - i] = h
        own = owner[i : i + STEP]
        edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        least[:, own[edges]] = np.minimum(least[:, own[edges]], np.minimum.reduceat(back, edges, axis=1))
    bands = least.reshape(BANDS, -1, len(kept)).min(axis=1)
    for n, i in enumerate(kept):
        out[i] = [int(x) for x in bands[:, n]]
    return out


#: Characters that are hashed together: tokens and shingles of so many take some 20 MB.
SLICE_CHARS = 250_000
#: Most rows and bytes of text that go to a Python worker at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4_000_000}


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold no more than BATCH from now on: a worker's memory then follows neither rows nor input."""
    for name, most in BATCH.items():
        size = re.fullmatch(r"(\d+)b?", spark.conf.get(name))  # other units are larger
        if not (size and 0 < int(size[1]) <= most):
            spark.conf.set(name, str(most))


def _give_back() -> None:
    """Return freed memory to the system: workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def _slices(texts: list[str | None], most: int = SLICE_CHARS) -> Iterator[list[str | None]]:
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def with_minhash(df: DataFrame, text: str, column: str = "body_minhash") -> DataFrame:
    """df with the signature as array<long>: bit patterns of the unsigned values."""
    small_batches(df.sparkSession)

    @F.pandas_udf("array<long>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            found = [m for some in _slices(s.tolist()) for m in minhashes(some)]
            yield pd.Series([m and [x - (1 << 64) if x >> 63 else x for x in m] for m in found], dtype=object)
        _give_back()

    return df.withColumn(column, sign(F.col(text)))
