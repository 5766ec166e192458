"""Toxicity by a classifier chain of linear models.

Categories are predicted in a fixed order. The model of each is a logistic regression over hashed word features (the
word without outer punctuation, and its first 3 to 6 letters; the count over different words, by the square root of their number)
and over the probabilities of all earlier categories. While training, those come from models that have not seen the
document (out-of-fold predictions), so that later models don't trust them more than they deserve; afterwards each
category is fitted once more on all training rows.

Training takes a bounded sample of the labelled rows: about SAMPLE_DOCS, chosen by a hash of doc_id and text (repeats are
one row). Features that fewer than LEAST_SEEN of them have are dropped before the driver gets the rest, and of those that
differ between the classes each model keeps the KEPT strongest. Scoring covers every whole text.

Nulls: a null or blank text has no features and gets the base rates; rows with a null label are not trained on;
without training rows, or with one class only, a category's probability is the base rate (0 without any row). Repeated
rows get the same scores; a document with several label rows counts with each. Extra columns are left alone, and
columns with the names of the results are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, give_back, row_key, slices, text_batches

SAMPLE_DOCS = 6_000
FOLDS = 3
#: Hash space of the features, and how many of them a category's model keeps.
FEATURES = 1 << 20
KEPT = 400
#: Features whose means differ by fewer standard errors are chance.
LEAST_Z = 3.5
LEAST_SEEN = 6
#: Features that are summed at once while training.
PART = 500_000
#: Words whose scores a worker keeps.
CACHE_WORDS = 250_000
THRESHOLD = 0.5
_OUTER = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: str | None) -> list[bytes]:
    """Each word once, so that a line that is repeated over and over weighs no more than one."""
    return list(set((text or "").lower().encode().split()))


def features_of(word: bytes) -> list[int]:
    bare = word.strip(_OUTER)
    if not bare:
        return [zlib.crc32(b"o" + word[:3]) % FEATURES]
    letters = bare.decode(errors="replace")
    return [zlib.crc32(b"w" + bare) % FEATURES, *(zlib.crc32(b"%d" % n + letters[:n].encode()) % FEATURES for n in range(3, 7) if len(letters) > n)]


@dataclass
class Linear:
    """weights: of the kept features; chained: of the earlier categories' probabilities."""

    bias: float
    weights: dict[int, float] = field(default_factory=dict)
    chained: list[float] = field(default_factory=list)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def summed(at: np.ndarray, weights, width: int) -> np.ndarray:
    """Sums of weights(from, to) by at, a part of it at a time: the driver has little memory to spare."""
    out = np.zeros(width)
    for i in range(0, len(at), PART):
        out += np.bincount(at[i : i + PART], weights(i, i + PART), width)
    return out


def fit(docs: np.ndarray, feats: np.ndarray, values: np.ndarray, n: int, y: np.ndarray, earlier: np.ndarray, l2: float = 1e-3, rounds: int = 150) -> Linear:
    """docs, feats, values: parallel arrays of the non-zero features of n documents; earlier: n x earlier categories."""
    if not n or y.min() == y.max():
        rate = float(y.mean()) if n else 0.0
        return Linear(float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9))), {}, [0.0] * earlier.shape[1])
    # Keep the features whose mean differs most between the classes, in standard errors.
    width = int(feats.max()) + 1 if len(feats) else 1
    both = summed(feats, lambda i, j: values[i:j], width)
    ones = summed(feats, lambda i, j: values[i:j] * y[docs[i:j]], width)
    square = summed(feats, lambda i, j: values[i:j].astype(float) ** 2, width)
    seen = summed(feats, lambda i, j: None, width)
    n1 = y.sum()
    z = np.abs(ones / n1 - (both - ones) / (n - n1)) / np.sqrt(square / n / min(n1, n - n1) + 1e-6)
    z[seen < LEAST_SEEN] = 0
    kept = np.sort(np.argsort(-z, kind="stable")[:KEPT])
    kept = kept[z[kept] >= LEAST_Z]
    place = np.full(width, -1)
    place[kept] = np.arange(len(kept))
    on = place[feats] >= 0 if len(feats) else np.zeros(0, bool)
    d, f, v = docs[on], place[feats[on]], values[on]
    w, c, b = np.zeros(len(kept)), np.zeros(earlier.shape[1]), float(np.log(n1 / (n - n1)))
    scale = np.sqrt(np.bincount(f, v**2, len(kept)) / n) + 1e-3  # all features on one scale
    v = v / scale[f]
    m, s = np.zeros(len(kept) + len(c) + 1), np.zeros(len(kept) + len(c) + 1)
    for t in range(1, rounds + 1):
        p = sigmoid(np.bincount(d, v * w[f], n) + earlier @ c + b)
        g = (p - y) / n
        grad = np.concatenate([np.bincount(f, v * g[d], len(kept)) + l2 * w, earlier.T @ g + l2 * c, [g.sum()]])
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        step = 0.1 * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        w, c, b = w - step[: len(kept)], c - step[len(kept) : -1], b - step[-1]
    return Linear(float(b), dict(zip(kept.tolist(), (w / scale).tolist(), strict=True)), c.tolist())


def predict(model: Linear, docs: np.ndarray, feats: np.ndarray, values: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
    table = np.zeros(FEATURES)
    table[list(model.weights)] = list(model.weights.values())
    return sigmoid(np.bincount(docs, values * table[feats], n) + earlier @ np.array(model.chained) + model.bias) if n else np.zeros(0)


@dataclass
class Chain:
    names: list[str]
    models: list[Linear]


def train_arrays(rows: list[tuple[np.ndarray, np.ndarray, list[float]]], names: list[str], folds: int = FOLDS) -> Chain:
    """rows: feature hashes, their values and the labels of each document."""
    n = len(rows)
    docs = np.repeat(np.arange(n, dtype=np.int32), [len(r[0]) for r in rows])
    feats = np.concatenate([r[0] for r in rows], dtype=np.int32, casting="same_kind") if n else np.zeros(0, np.int32)
    values = np.concatenate([r[1] for r in rows], dtype=np.float32, casting="same_kind") if n else np.zeros(0, np.float32)
    often = summed(feats, lambda i, j: None, FEATURES) >= LEAST_SEEN  # the rest could not be kept anyway
    if not often[feats].all():
        docs, feats, values = (x[often[feats]] for x in (docs, feats, values))
    # only features that occur have a place in the sums
    present = np.flatnonzero(often)
    place = np.zeros(FEATURES, np.int32)
    place[present] = np.arange(len(present), dtype=np.int32)
    feats = place[feats]
    labels = np.array([r[2] for r in rows], float).reshape(n, len(names))
    earlier, models = np.zeros((n, 0)), []
    fold = np.arange(n) % folds
    for k in range(len(names)):
        y = labels[:, k]
        models.append(fit(docs, feats, values, n, y, earlier))
        if k + 1 < len(names):
            out = np.zeros(n)
            for q in range(folds):
                held = fold == q
                if not held.any():
                    continue
                where = np.cumsum(~held) - 1
                on = ~held[docs]
                part = fit(where[docs[on]], feats[on], values[on], int((~held).sum()), y[~held], earlier[~held])
                where, on = np.cumsum(held) - 1, held[docs]
                out[held] = predict(part, where[docs[on]], feats[on], values[on], int(held.sum()), earlier[held])
            earlier = np.column_stack([earlier, out])
    for m in models:
        m.weights = {int(present[f]): w for f, w in m.weights.items()}
    return Chain(names, models)


def doc_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    words = words_of(text)
    hashed = [f for w in words for f in features_of(w)]
    feats, counts = np.unique(np.array(hashed, np.int64), return_counts=True)
    return feats, counts / np.sqrt(max(1, len(words)))


FEATURE_ROWS = "labels array<double>, feats array<int>, vals array<float>"


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample_docs: int = SAMPLE_DOCS, folds: int = FOLDS) -> Chain:
    """categories: 0/1 columns over labels, in the order of the chain."""
    spark, scratch, names = docs.sparkSession, Scratch(docs.sparkSession), list(categories)
    text_batches(spark)
    wanted = labels.select(F.col("doc_id").alias("__labelled"), F.array(*[c.cast("double") for c in categories.values()]).alias("labels")).filter(~F.exists("labels", lambda x: x.isNull()))
    n = wanted.count()
    rows = docs.select("doc_id", "text", row_key().alias("key")).join(wanted, F.col("doc_id") == F.col("__labelled")).select("key", "doc_id", "labels", "text")
    rows = rows.filter(_drawn(0, sample_docs, n))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [doc_features(t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([x.astype(np.int32) for x, _ in got], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in got], pa.list_(pa.float32()))], names=["key", "doc_id", "labels", "feats", "vals"])

    rows = scratch.keep(rows.mapInArrow(extract, f"key binary, doc_id long, {FEATURE_ROWS}").dropDuplicates(["key", "labels"]), "features")
    if (drawn := rows.count()) > 2 * sample_docs:  # ids with many texts
        rows = scratch.keep(rows.filter(_drawn(1, sample_docs, drawn)), "features")
    # one bit a feature: which are seen often enough to be kept at all
    often = rows.select(F.explode("feats").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_SEEN)
    bits = np.zeros(FEATURES, bool)
    bits[[r.f for r in often.select("f").toLocalIterator()]] = True
    held = spark.sparkContext.broadcast(np.packbits(bits))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.unpackbits(held.value).astype(bool)
        for b in batches:
            if b.num_rows:
                feats, vals = b.column(2), b.column(3)
                flat = on[feats.flatten().to_numpy()]
                ends = np.concatenate([[0], np.cumsum(flat)])[feats.offsets.to_numpy() - feats.offsets[0].as_py()].astype(np.int32)
                kept = [pa.ListArray.from_arrays(pa.array(ends), x.flatten().filter(pa.array(flat))) for x in (feats, vals)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *kept], names=["key", "labels", "feats", "vals"])

    table = rows.select("key", "labels", "feats", "vals").mapInArrow(frequent, f"key binary, {FEATURE_ROWS}").toArrow().sort_by("key")
    scratch.clear()
    chain = train_arrays([(f.values.to_numpy(), v.values.to_numpy(), lab) for f, v, lab in zip(table["feats"], table["vals"], table["labels"].to_pylist(), strict=True)], names, folds)
    del table
    give_back()
    return chain


def _drawn(seed: int, wanted: int, of: int) -> Column:
    """True for about wanted of so many rows, by their key."""
    share = min(1.0, wanted / max(of, 1))
    return F.pmod(F.xxhash64(F.lit(seed), F.col("key")), F.lit(1_000_000)) < int(share * 1_000_000)


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, decide: str = "toxic") -> DataFrame:
    """docs with p_<category> for each category, and the decision on the one named."""
    names = [f"p_{n}" for n in chain.names]
    kept = [c for c in docs.columns if c not in (*names, decide)]
    held = docs.sparkSession.sparkContext.broadcast(chain)
    source = docs.select(*kept)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in source.schema.fields)}, {', '.join(f'{n} double' for n in names)}, `{decide}` boolean"
    at, of = kept.index("text"), chain.names.index(decide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = held.value
        tables = []
        for m in chain.models:
            t = np.zeros(FEATURES)
            t[list(m.weights)] = list(m.weights.values())
            tables.append(t)
        tables = np.column_stack(tables)
        known: dict[bytes, complex] = {}
        scores: list[np.ndarray] = []

        def learn(words: set[bytes]) -> None:
            new = [w for w in words if w not in known]
            fs = [features_of(w) for w in new]
            if new:
                flat = tables[np.fromiter((x for f in fs for x in f), np.int64)]
                starts = np.concatenate([[0], np.cumsum([len(f) for f in fs])[:-1]])
                first = len(scores) and sum(len(x) for x in scores)
                scores.append(np.add.reduceat(flat, starts))
                known.update(zip(new, range(first, first + len(new)), strict=True))

        for b in batches:
            texts = b.column(at).to_pylist()
            ps = []
            for i, j in slices(len(t or "") for t in texts):
                if len(known) > CACHE_WORDS:
                    known.clear(), scores.clear()
                split = [words_of(t) for t in texts[i:j]]
                learn(set().union(*split))
                u = np.concatenate(scores) if scores else np.zeros((0, len(chain.models)))
                if len(scores) > 1:
                    scores[:] = [u]
                sizes = np.array([len(s) for s in split])
                ids = np.fromiter((x for s in split for x in map(known.__getitem__, s)), np.int64, int(sizes.sum()))
                owner = np.repeat(np.arange(len(split)), sizes)
                root = np.sqrt(np.maximum(sizes, 1))
                p = np.zeros((len(split), 0))
                for k, m in enumerate(chain.models):
                    x = np.bincount(owner, u[ids, k], len(split)) / root + p @ np.array(m.chained) + m.bias
                    p = np.column_stack([p, sigmoid(x)])
                ps.append(p)
            p = np.concatenate(ps) if ps else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, k]) for k in range(len(names))), pa.array(p[:, of] >= threshold)], names=[*kept, *names, decide])
        known.clear(), scores.clear()
        give_back()

    return source.mapInArrow(run, schema)


def categories_of(labels: DataFrame) -> dict[str, Column]:
    """The chain over the two labels: low quality first, since abuse often comes in junk."""
    del labels
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, train(docs, labels, categories_of(labels)), threshold)
