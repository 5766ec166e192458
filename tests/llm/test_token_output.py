import zlib

import numpy as np
from tokenizers import Tokenizer

from codeloom.llm import token_output as T
from codeloom.llm.common import new_path
from codeloom.llm.queries import op2_token_output, tokenizer_path


def expected(texts, end=1):
    t = Tokenizer.from_file(tokenizer_path())
    return [[*x.ids, end] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD = [None, "", "  \n\t ", "It's <|endoftext|> and <|ENDOFTEXT|>, 'S 's. don't.", "É́ Ünïcode é, ΑΣ ΣΑΣ. İx a b c\x1cd", "x" * 5000, "a, b., c.. d.,", "日本語 テキスト。", "1234.5,6 a1.b2", "'s. 't, 'll x'. x',"]


def test_pieces_give_the_ids_of_whole_texts():
    got = T.PieceEncoder(tokenizer_path()).encode(ODD)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x[:-1] for x in expected(ODD)]


def test_round_trip_against_whole_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id")
    got = op2_token_output(spark, sf).toPandas().sort_values("doc_id")
    ids = expected(docs.text)
    assert got.doc_id.tolist() == docs.doc_id.tolist()
    assert got.n_tokens.tolist() == [len(x) for x in ids]
    assert got.start.tolist() == np.concatenate([[0], np.cumsum(got.n_tokens)[:-1]]).tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]


def test_odd_rows_shards_and_single_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, "twice", "x"), (None, "no id", "x")]
    path = new_path(spark, "t")
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    T.write(docs, path, tokenizer_path(), shard_bytes=40)
    got = T.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9]
    assert T.read_document(spark, path, 5) == expected(["x" * 5000])
    assert sorted(T.read_document(spark, path, 3)) == sorted(expected([ODD[3], "twice"]))
    assert T.read_document(spark, path, 99) == []


def test_empty_table(spark):
    path = new_path(spark, "t")
    T.write(spark.createDataFrame([], "doc_id long, text string"), path, tokenizer_path())
    assert T.read(spark, path).count() == 0


def test_a_tokenizer_that_keeps_white_space_is_given_whole_texts(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    texts = ["Hello World, it's here.", "  two  spaces\n\n", "", "a <|endoftext|> b", "É\t日本"]
    assert not T.PieceEncoder(path).by_piece
    t = Tokenizer.from_file(path)
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in T.PieceEncoder(path).encode(texts)] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = T.round_trip(docs, path, end_id=50256).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(x) + 1 for x in want]


def test_hostile_texts_against_whole_texts():
    rng = np.random.default_rng(11)
    parts = [" ", "\t", "\n", "\x0b", "\x85", " ", "a", "Z", "é", "é", "İ", "ß", "'s", "'LL", "'", ".", ",", "..", "7", "٣", "日", "<|", "|>", "_", "​", "ﬁ", "Σ", "x."]
    texts = ["".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(1500)]
    encoder = T.PieceEncoder(tokenizer_path())
    assert encoder.by_piece
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == [x[:-1] for x in expected(texts)]
