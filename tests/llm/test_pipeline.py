import corpus_pipeline
from codeloom.llm import decontaminate, near_dedup, toxicity
from codeloom.llm.common import materialise


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, sf), "t")
        assert out.columns == start.columns
        seen[name] = (docs, out)
        docs = out
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen["toxicity"]
    assert ids(before) - ids(after) == ids(toxicity.classify(before, spark.read.parquet(f"{sf}/labels.parquet")).filter("toxic"))
    before, after = seen["near_dedup"]
    assert ids(after) == ids(near_dedup.near_duplicates(before, 5).filter("kept"))
    before, after = seen["decontamination"]
    assert ids(before) - ids(after) == ids(decontaminate.contamination(before, spark.read.parquet(f"{sf}/benchmark.parquet")))
    before, after = seen["mixing"]
    assert ids(after) <= ids(before)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count()


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]


def test_rows_with_null_or_repeated_ids_are_judged_by_their_own_text(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"}
    near = text["a"] + " more"
    rows = [(1, text["a"]), (5, near), (5, text["b"]), (None, text["c"]), (None, text["c"] + " more"), (None, text["d"]), (None, near), (7, text["e"]), (7, text["f"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [(r.doc_id, r.text) for r in near_dedup.deduplicate(docs).collect()]
    assert sorted(left, key=repr) == sorted([(1, text["a"]), (5, text["b"]), (None, text["c"]), (None, text["d"]), (7, text["e"]), (7, text["f"])], key=repr)
    items = spark.createDataFrame([(1, text["d"]), (2, text["e"])], "item_id long, text string")
    left = [(r.doc_id, r.text) for r in decontaminate.decontaminate(docs, items).collect()]
    assert sorted(left, key=repr) == sorted([r for r in rows if r[1] not in (text["d"], text["e"])], key=repr)


def test_the_chain_on_odd_and_empty_tables(spark, sf, odd_docs, no_docs):
    """Nulls, blanks, repeats, a very long text and clashing columns through all stages, and no row at all."""
    for docs, least in ((odd_docs, 5), (no_docs, 0)):
        columns, rows = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = materialise(stage(spark, docs, sf), "t")
            assert out.columns == columns, name
            assert name == "mixing" or out.count() <= docs.count(), name
            docs = out
        last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        got = last.orderBy("start").collect()
        assert least <= len(got) == docs.count() and (rows or not got)
        assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]


def test_very_long_near_copies(spark):
    """Two texts of 200,000 words that differ in a few, among short ones."""
    words = [f"w{i}" for i in range(200_000)]
    other = list(words)
    for i in range(0, 200_000, 5000):
        other[i] = f"x{i}"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "short text of its own"), (4, " ".join(words[:100_000]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got[1] == (199_996, 1) and got[2][1] == 1 and got[3][1] == 3 and got[4][1] == 4


def test_run_leaves_the_stages_tables_deleted(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    import os

    assert not [x for x in os.listdir(folder) if x.startswith(("toxicity-", "near_dedup-", "decontamination-", "mixing-"))]
    rows = out.orderBy("start").collect()
    assert rows and [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
