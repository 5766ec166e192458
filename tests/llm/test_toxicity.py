import numpy as np

from codeloom.llm import toxicity as X
from codeloom.llm.queries import op1_toxicity


def corpus(n=400, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for d in range(n):
        w = list(rng.choice(words, rng.integers(10, 80)))
        junk, bad = int(rng.random() < 0.3), int(rng.random() < 0.25)
        w += ["click###"] * 3 * junk + list(rng.choice(["vile", "scumbag"], 3)) * bad
        docs.append((d, " ".join(rng.permutation(w)), "x"))
        labels.append((d, 1 - junk, bad))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic string")
    lab = spark.createDataFrame(labels[:250], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in X.classify(d, lab).collect()}
    held = labels[250:]
    assert np.mean([got[i].toxic == bool(t) for i, _, t in held]) > 0.97
    assert np.mean([(got[i].p_low_quality >= 0.5) == (not q) for i, q, _ in held]) > 0.97


def test_chain_feeds_earlier_probabilities(spark):
    """The second category is the first one: its model leans on the first's out-of-fold probability."""
    docs, labels = corpus()
    rows = [(*X.doc_features(t), [float(1 - q), float(1 - q)]) for (_, t, _), (_, q, _) in zip(docs, labels, strict=True)]
    chain = X.train_arrays(rows, ["a", "b"])
    assert chain.models[1].chained[0] > 0.5 and chain.models[0].chained == []


def test_own_tables_on_rows_that_were_not_trained_on(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = {r.doc_id: r.toxic for r in labels.filter("doc_id % 3 = 0").collect()}
    got = [r for r in X.classify(docs, labels.filter("doc_id % 3 <> 0")).collect() if r.doc_id in held]
    assert len(got) > 100 and np.mean([r.toxic == bool(held[r.doc_id]) for r in got]) > 0.9
    assert op1_toxicity(spark, "/root/testdata/sf0.01").count() == docs.count()


def test_scores_against_a_plain_chain(spark):
    """Every probability again, from single features and Python floats."""
    docs, labels = corpus(150)
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "vile", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = X.train(d, lab, X.categories_of(lab))
    for r in X.score(d, chain).collect():
        feats, vals = X.doc_features(r.text)
        before = []
        for m in chain.models:
            x = m.bias + sum(m.weights.get(int(f), 0.0) * v for f, v in zip(feats, vals, strict=True)) + sum(c * p for c, p in zip(m.chained, before, strict=True))
            before.append(1 / (1 + np.exp(-x)))
        assert np.allclose([r.p_low_quality, r.p_toxic], before, atol=1e-6) and r.toxic == (before[1] >= 0.5)


def test_out_of_fold_predictions_against_plain_folds():
    """The chain's first column: each fold predicted by a model of the others."""
    docs, labels = corpus(90)
    rows = [(*X.doc_features(t), [float(1 - q), float(b)]) for (_, t, _), (_, q, b) in zip(docs, labels, strict=True)]
    seen = np.bincount(np.concatenate([r[0] for r in rows]), minlength=X.FEATURES)
    rows = [(f[seen[f] >= X.LEAST_SEEN], v[seen[f] >= X.LEAST_SEEN], y) for f, v, y in rows]

    def flat(some):
        return np.repeat(np.arange(len(some)), [len(r[0]) for r in some]), np.concatenate([r[0] for r in some]), np.concatenate([r[1] for r in some]).astype(np.float32)

    out = np.zeros(90)
    for q in range(3):
        train, held = ([r for i, r in enumerate(rows) if (i % 3 == q) == side] for side in (False, True))
        m = X.fit(*flat(train), len(train), np.array([r[2][0] for r in train]), np.zeros((len(train), 0)))
        out[q::3] = X.predict(m, *flat(held), len(held), np.zeros((len(held), 0)))
    last = X.fit(*flat(rows), 90, np.array([r[2][1] for r in rows]), out[:, None])
    chain = X.train_arrays(rows, ["a", "b"])
    assert np.allclose(chain.models[1].chained, last.chained) and chain.models[1].weights.keys() == last.weights.keys()


def test_repeats_and_ids_with_many_texts_keep_the_sample_bounded(spark):
    docs = spark.range(3000).selectExpr("if(id < 1000, 7, id) as doc_id", "concat('word', id % 50, ' other', if(id < 500, 0, id)) as text")
    labels = spark.range(3000).selectExpr("id as doc_id", "1 as quality", "cast(id % 2 as int) as toxic")
    seen = []
    old = X.train_arrays
    X.train_arrays = lambda rows, *more: seen.append(len(rows)) or old(rows, *more)
    try:
        X.train(docs, labels, X.categories_of(labels), sample_docs=200)
    finally:
        X.train_arrays = old
    assert 50 < seen[0] <= 400


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (6, 0, 1), (8, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = X.classify(odd_docs, labels)
    assert got.count() == odd_docs.count()
    blank = {r.doc_id: r.p_toxic for r in got.collect() if r.doc_id in (2, 3, 4)}
    assert len(set(blank.values())) == 1 and 0 <= blank[2] <= 1  # without features, the base rate
    assert X.classify(no_docs, labels).count() == 0
    none = X.classify(odd_docs, labels.limit(0))
    assert none.columns[-1] == "toxic" and none.filter("toxic").count() == 0
