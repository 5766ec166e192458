import random

from codeloom.llm import decontaminate as D


def edit_distance_anywhere(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = row[0], 0
        for i, x in enumerate(item, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != c))
        best = min(best, row[-1])
    return best


def mutated(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        rng.choice([lambda: s.pop(i), lambda: s.insert(i, "q"), lambda: s.__setitem__(i, "z")])()
    return "".join(s)


def test_against_dynamic_programming(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "omega", "zeta", "eta"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(14)) for i in range(8)]
    docs = []
    for d in range(60):
        t = text(30)
        if d % 2:
            item = D.normalise(rng.choice(items)[1])
            t += " " + mutated(rng, item, rng.randrange(0, 2 * len(item) // D.BUDGET_CHARS)) + " " + text(10)
        docs.append((d, t.upper() if d % 3 == 0 else t))
    want = {(d, i) for d, t in docs for i, x in items if edit_distance_anywhere(D.normalise(x), D.normalise(t)) <= len(D.normalise(x)) // D.BUDGET_CHARS}
    df = lambda rows, n: spark.createDataFrame(rows, f"{n} long, text string")
    found = D.contamination(df(docs, "doc_id"), df(items, "item_id")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and want
    texts = dict(docs)
    for r in found:
        assert r.distance == edit_distance_anywhere(D.normalise(dict(items)[r.item_id]), D.normalise(texts[r.doc_id])[r.start : r.end])
    # the same in blocks
    blocks = D.contamination(df(docs, "doc_id"), df(items, "item_id"), block_chars=100)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == want


def test_myers_long_patterns():
    rng = random.Random(4)
    for _ in range(30):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 150))) for _ in range(2))
        assert D.myers(a, b)[0] == edit_distance_anywhere(a, b)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, None), (2, " "), (3, "The  CAT sat on the mat"), (3, "The  CAT sat on the mat")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contamination(odd_docs, items).collect()} == {(1, 3)}
    left = D.decontaminate(odd_docs, items)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count() - 2
    assert D.contamination(no_docs, items).count() == 0
    assert D.decontaminate(odd_docs, items.limit(0)).count() == odd_docs.count()


def test_very_short_items_and_very_long_texts(spark):
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    docs = spark.createDataFrame([(1, "a b c d e"), (2, long + " the quick brown fox jumps over it"), (3, long)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, "b c"), (3, "the quick brwn fox jumps over it"), (4, None), (5, "  ")], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.distance) for r in D.contamination(docs, items).collect()]
    assert got == [(2, 3, 1)]
