"""Token-ID output: shards of separately compressed documents with a shared zstandard dictionary.

Format, written by Spark's own committed Parquet writer so that it works on any store and survives lost tasks:

* ``<path>/dictionary``: one row (dict_sha256, dictionary, tokenizer_sha256, id_width).
* ``<path>/shards``: a row is a shard of at most SHARD_BYTES of payload (one document at least). ``payload`` is the
  concatenation of one zstandard frame a document; document i lies at ``offsets[i]:offsets[i + 1]``, so that one short
  document is read without touching the others. Ids are little-endian, id_width bytes each. ``part`` and ``shard``
  order the shards; inside, documents ascend by doc_id (null ids come first, equal ids in any order).
  ``tokens_before`` counts the ids of earlier shards of the part.

Nulls: a null text is an empty one; every document gets the end id, so that none is without ids. Extra columns of the
input are left alone. An empty table writes no shard, with an empty dictionary.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import batch, give_back, new_path, slices, text_batches

SHARD_BYTES = 4_000_000
DICT_BYTES = 64 * 1024
#: The dictionary is trained on about so many documents, chosen by a hash of doc_id.
SAMPLE_DOCS = 2_000
#: Pieces whose ids a Python worker keeps, in Arrow and numpy arrays of some 40 bytes a piece.
CACHE_PIECES = 1_500_000
#: Pieces encoded in one call, and bytes of text whose pieces are told apart at once.
CALL_PIECES, CALL_WORDS, SLICE_CHARS = 256, 4_096, 8_000_000
#: Words of small letters of Latin-1 alone: composed, lowered, and letters for any pattern.
LETTERS = re.compile("[a-zß-öø-ÿ]+")


#: What the probes of a tokenizer put beside white space, and the steps of a normalizer that act within pieces.
PROBES = ["a", "Z", "ab", "é", "ß", "日", "й", "7", "42", ".", ",", "it's", "'", "--", "(x", "y)", "_", "é.", "a1b"]
INNER_STEPS = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents", "Replace"}


def parts_at_space(tokenizer, spec: dict) -> bool:
    """Whether the ids of a text are those of its ASCII white-space pieces, one after the other.

    True only for tokenizers whose pre-tokenizer keeps what a pattern matches and removes all else, white space with it,
    and whose normalizer acts within pieces; probes across every white-space character must agree.
    """
    normalizer = spec.get("normalizer") or {}
    steps = normalizer.get("normalizers", [normalizer] if normalizer else [])
    first = spec.get("pre_tokenizer") or {}
    first = (first.get("pretokenizers") or [{}])[0] if first.get("type") == "Sequence" else first
    removes = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    if not removes or any(x.get("type") not in INNER_STEPS for x in steps) or (spec["model"].get("continuing_subword_prefix") or ""):
        return False

    def ids(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    own = {p: ids(p) for p in PROBES}
    return all(ids(f"{p}{gap}{q}") == own[p] + own[q] for gap in (" ", "\t", "\n", "\x0b", "\f", "\r", " \n ") for p in PROBES for q in PROBES)


class PieceEncoder:
    """Ids of whole texts through the tokenizers library, each distinct white-space piece encoded once.

    For tokenizers that split at white space and drop it (by_piece; None: found out by parts_at_space), the ids of a text
    are the ids of its pieces one after the other, and upper-case ASCII letters are lowered first when the normalizer
    lowers them. Pieces to encode are joined by a special token, whose id parts the result again. Texts that hold the
    start of a special token's string are encoded whole, and so are all texts with other tokenizers.
    """

    def __init__(self, path: str, by_piece: bool | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = sorted((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special)
        plain = len(special) == len(self.tokenizer.get_added_tokens_decoder())
        self.by_piece = bool(special) and plain and (parts_at_space(self.tokenizer, spec) if by_piece is None else by_piece)
        self.mark, self.mark_text = special[0] if special else (-1, "")
        self.marks = sorted({t[:2] for _, t in special})
        self.lower = self.by_piece and self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("AbZ") == "abz"
        # A stop or comma after an ASCII letter may be a piece of its own for the pattern.
        self.tails = tuple(c for c in ".," if self.by_piece and len(self._ids(c)) == 1 and all(self._ids(p + c) == self._ids(p) + self._ids(c) for p in ("a", "zq", "it's", "é-k", "7b")))
        self.most = CACHE_PIECES
        self._forget()
        self.letters = self._of_letters(spec["model"]) if self.by_piece else None

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _whole(self, text: str) -> bytes:
        return np.array(self._ids(text), "<u4").tobytes()

    def _of_letters(self, model: dict):
        """(tokenizer, which ids end a word) for words of small Latin letters only, which nothing before the model
        changes or cuts: the same model behind a plain cut at blanks. None unless it gives the probes' ids."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        suffix = model.get("end_of_word_suffix")
        if model.get("type") != "BPE" or not suffix or model.get("dropout"):
            return None
        plain = Tokenizer(self.tokenizer.model)
        plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        letters = [chr(c) for c in range(256) if LETTERS.fullmatch(chr(c))]
        words = [*letters, *(a + b for a in letters for b in letters), "grünüberall", "élan", "naïveté", "thequickbrownfox"]
        found = np.array(plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids)
        whole = np.array(self._ids(" ".join(words)))
        same = len(found) == len(whole) and (found == whole).all() and ends[found].sum() == len(words)
        return (plain, ends) if same else None

    def _forget(self) -> None:
        """The vocabulary: pieces, and where the ids of each lie; the first one is the empty piece, which has none."""
        self.pieces = pa.array([""], pa.string())
        self.starts, self.lengths, self.ids = np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(0, np.uint32)

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each word's end) of words of small letters."""
        plain, is_end = self.letters
        calls = [np.array(plain.encode_batch_fast([" ".join(words[i : i + CALL_WORDS])], add_special_tokens=False)[0].ids, np.uint32) for i in range(0, len(words), CALL_WORDS)]
        ids = np.concatenate([np.zeros(0, np.uint32), *calls])
        ends = np.flatnonzero(is_end[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("a word's ids don't end in one that ends words")
        return ids, ends

    def _by_marks(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each piece's end) of any pieces, by calls in which a special token stands between them."""
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(pieces), CALL_PIECES):
            some = pieces[at : at + CALL_PIECES]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {self.mark_text} ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            flat.append(np.delete(ids, marks))
            sizes.append(np.diff([-1, *marks, len(ids)]) - 1)
        return np.concatenate(flat), np.cumsum(np.concatenate(sizes))

    def _add(self, missing: list[str]) -> pa.Array:
        """Take pieces that aren't in the vocabulary into it; the pieces that were added, in their order.

        Words of small letters go the short way, and so do those with a stop or comma behind, whose id follows.
        """
        words: list[str] = []
        tailed: dict[str, list[str]] = {c: [] for c in self.tails}
        others: list[str] = []
        for p in missing:
            if self.letters is None:
                others.append(p)
            elif LETTERS.fullmatch(p):
                words.append(p)
            elif p[-1:] in self.tails and LETTERS.fullmatch(p, 0, len(p) - 1):
                tailed[p[-1]].append(p)
            else:
                others.append(p)
        added, flat, ends = [*words], [], []
        if words:
            found = self._of_words(words)
            flat, ends = [found[0]], [found[1]]
        for tail, some in tailed.items():
            if some:
                ids, at = self._of_words([p[:-1] for p in some])
                added += some
                flat.append(np.insert(ids, at, self._ids(tail)[0]))
                ends.append(at + np.arange(1, len(at) + 1))
        if others:
            found = self._by_marks(others)
            added += others
            flat.append(found[0]), ends.append(found[1])
        sizes = np.concatenate([np.diff(e, prepend=0) for e in ends]).astype(np.int32)
        self.starts = np.concatenate([self.starts, (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int32)])
        self.lengths = np.concatenate([self.lengths, sizes])
        self.ids = np.concatenate([self.ids, *flat])
        new = pa.array(added, pa.string())
        self.pieces = pa.concat_arrays([self.pieces, new])
        return new

    def _places(self, distinct: pa.Array) -> np.ndarray:
        """Where each of different pieces is in the vocabulary; one that has grown too large starts again."""
        if len(self.pieces) > self.most:
            self._forget()
        found = pc.index_in(distinct, value_set=self.pieces)
        if not found.null_count:
            return found.to_numpy()
        unknown = pc.is_null(found)
        missing, before = distinct.filter(unknown), len(self.pieces)
        added = self._add(missing.to_pylist())
        out = pc.fill_null(found, 0).to_numpy().copy()
        out[unknown.to_numpy(zero_copy_only=False)] = before + pc.index_in(missing, value_set=added).to_numpy()
        return out

    def encode(self, texts: pa.Array | list) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts) or not self.by_piece:
            return [self._whole(t) for t in texts.to_pylist()]
        whole = reduce(pc.or_, [pc.match_substring(texts, m) for m in self.marks])
        out: list[bytes] = []
        plain = pc.if_else(whole, "", texts)
        for i, j in slices(pc.binary_length(plain).to_pylist(), SLICE_CHARS):
            part = plain.slice(i, j - i)
            split = pc.ascii_split_whitespace(pc.ascii_lower(part) if self.lower else part)
            coded = split.flatten().dictionary_encode()
            places = self._places(coded.dictionary)[coded.indices.to_numpy()]
            n = self.lengths[places]
            ends = np.cumsum(n, dtype=np.int32 if part.nbytes < 1 << 30 else np.int64)  # a text has fewer ids than bytes
            at = np.repeat(self.starts[places] - (ends - n), n)
            at += np.arange(len(at), dtype=at.dtype)
            found = self.ids[at].astype("<u4", copy=False)
            edges = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
            out += [found[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._whole(texts[i].as_py())
        return out


_encoders: dict[tuple[str, bool | None], PieceEncoder] = {}


def encoder(path: str, by_piece: bool | None = None) -> PieceEncoder:
    """One encoder a worker process, so that what it has learnt serves later tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, by_piece) not in _encoders:
        _encoders[path, by_piece] = PieceEncoder(path, by_piece)
    return _encoders[path, by_piece]


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, pa.Array]]:
    """(ids, texts) of batches that follow one another, until they hold most bytes: a vocabulary is asked less often."""
    ids: list = []
    texts: list[pa.Array] = []
    for b in batches:
        ids += b.column(0).to_pylist()
        texts.append(b.column(1))
        if sum(t.nbytes for t in texts) >= most:
            yield ids, pa.concat_arrays(texts)
            ids, texts = [], []
    if ids:
        yield ids, pa.concat_arrays(texts)


def serialize(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def deserialize(raw: bytes, width: int) -> bytes:
    return raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """Bytes of a dictionary; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


SHARDS = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("tokens_before", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()),
    ("dict_sha256", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary()),
])
SHARDS_DDL = "part int, shard int, tokens_before long, n_docs int, n_tokens long, dict_sha256 string, doc_ids array<long>, lengths array<long>, offsets array<long>, payload binary"


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, by_piece: bool | None = None, sample_docs: int = SAMPLE_DOCS, shard_bytes: int = SHARD_BYTES, cache_pieces: int = CACHE_PIECES) -> None:
    """Write the ids of docs (doc_id, text) below path, in ascending doc_id order."""
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    end = np.array([end_id], "<u4").tobytes()
    width = 2 if max(encoder(tokenizer_path, by_piece).tokenizer.get_vocab_size(), end_id) < 65536 else 4

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([serialize(x + end, width) for x in encoder(tokenizer_path, by_piece).encode(b.column(0))], pa.binary())], names=["ids"])

    n = max(1, docs.count())
    share = min(1.0, sample_docs / n)
    # pmod keeps the choice the same on every run
    chosen = docs.filter(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("text").limit(2 * sample_docs)
    dictionary = train_dictionary([bytes(r.ids) for r in chosen.mapInArrow(sample, "ids binary").collect()])
    sha = hashlib.sha256(dictionary).hexdigest()
    with open(tokenizer_path, "rb") as f:
        tokenizer_sha = hashlib.sha256(f.read()).hexdigest()
    spark.createDataFrame([(sha, bytearray(dictionary), tokenizer_sha, width)], "dict_sha256 string, dictionary binary, tokenizer_sha256 string, id_width int").coalesce(1).write.parquet(f"{path}/dictionary")
    held = spark.sparkContext.broadcast(dictionary)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path, by_piece)
        encode, own.most = own.encode, cache_pieces
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(held.value) if held.value else None, write_content_size=True)
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        lengths: list[int] = []
        frames: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, before, size
            ends = np.concatenate([[0], np.cumsum([len(x) for x in frames])]).tolist()
            out = batch(SHARDS, {"part": [part], "shard": [shard], "tokens_before": [before], "n_docs": [len(ids)], "n_tokens": [sum(lengths)], "dict_sha256": [sha], "doc_ids": [list(ids)], "lengths": [list(lengths)], "offsets": [ends], "payload": [b"".join(frames)]})
            shard, before, size = shard + 1, before + sum(lengths), 0
            ids.clear(), lengths.clear(), frames.clear()
            return out

        for docs_, texts in gathered(batches, SLICE_CHARS):
            for i, j in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE_CHARS):
                for doc, x in zip(docs_[i:j], encode(texts.slice(i, j - i)), strict=True):
                    x += end
                    ids.append(doc)
                    lengths.append(len(x) // 4)
                    frames.append(press.compress(serialize(x, width)))
                    size += len(frames[-1])
                    if size >= shard_bytes:
                        yield flush()
        if ids:
            yield flush()
        give_back()

    docs.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first()).mapInArrow(pack, SHARDS_DDL).write.option("compression", "none").parquet(f"{path}/shards")


def _dictionary(spark: SparkSession, path: str) -> tuple[bytes, str, int]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row.dictionary)
    if hashlib.sha256(dictionary).hexdigest() != row.dict_sha256:
        raise ValueError("the dictionary doesn't have the hash written beside it")
    return dictionary, row.dict_sha256, row.id_width


def _decompressor(dictionary: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document; start counts the ids of all documents before it."""
    dictionary, sha, width = _dictionary(spark, path)
    held = spark.sparkContext.broadcast(dictionary)
    schema = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = _decompressor(held.value)
        for b in batches:
            for r in b.to_pylist():
                if r["dict_sha256"] != sha:
                    raise ValueError(f"shard {r['part']}/{r['shard']} needs dictionary {r['dict_sha256']}")
                got = [deserialize(open_.decompress(r["payload"][i:j]), width) for i, j in zip(r["offsets"], r["offsets"][1:], strict=False)]
                starts = r["tokens_before"] + np.concatenate([[0], np.cumsum(r["lengths"][:-1])]).astype(np.int64)
                yield batch(schema, {"part": [r["part"]] * len(got), "at": starts, "doc_id": r["doc_ids"], "n_tokens": [len(x) // 4 for x in got], "ids_crc32": [zlib.crc32(x) for x in got], "ids": got if with_ids else [None] * len(got)})

    shards = spark.read.schema(SHARDS_DDL).parquet(f"{path}/shards")
    rows = shards.mapInArrow(unpack, "part int, at long, doc_id long, n_tokens long, ids_crc32 long, ids binary")
    # One number a part: their running sums are the driver's, as many as there were tasks.
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    offsets, total = [], 0
    for part, n in totals:
        offsets.append((part, total))
        total += n
    before = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "part int, part_start long"))
    return rows.join(before, "part").select("doc_id", (F.col("part_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of each document with this doc_id: only its own frames are decompressed."""
    dictionary, _, width = _dictionary(spark, path)
    open_, out = _decompressor(dictionary), []
    at = F.posexplode("doc_ids").alias("i", "id")
    hits = spark.read.schema(SHARDS_DDL).parquet(f"{path}/shards").filter(F.array_contains("doc_ids", F.lit(doc_id))).select("offsets", "payload", at).filter(F.col("id") == doc_id)
    frame = F.expr("substring(payload, int(offsets[i]) + 1, int(offsets[i + 1] - offsets[i]))")
    for r in hits.select(frame.alias("frame")).collect():
        out.append(np.frombuffer(deserialize(open_.decompress(bytes(r.frame)), width), "<u4").tolist())
    return out


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """Write docs into the shared folder and read them back."""
    path = new_path(docs.sparkSession, "token-ids")
    write(docs, path, tokenizer_path, end_id, cache_pieces=cache_pieces)
    return read(docs.sparkSession, path, with_ids=False)
