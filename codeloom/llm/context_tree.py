"""Language-model scoring by context-tree weighting over bytes.

A text is the byte string of its tokens (A-Z lowered, joined by one space) with a newline as its end. Each byte is
eight binary decisions; each decision has a context tree over the DEPTH bytes before, whose nodes keep a
Krichevsky-Trofimov estimate. A node's weighted probability is half its own block probability and half the product of
its children's; once all counts are in, that gives each node's weight in the mixture over all depths, and with it the
probability of a byte after DEPTH bytes: a number for each (context, byte). Depths whose context never occurred in the
training texts have no say. A text's score is the sum of log10 probabilities, minus its code length.

The corpus's strings of DEPTH + 1 bytes and its words travel as blobs: sorted keys as differences, byte planes and
zstandard, about a byte a string. Scan tasks cut the texts into chunks of CHUNK_BYTES and give a blob of each chunk's
strings for each bucket; a bucket has the strings that share their two nearest bytes (in a large corpus, a share of the
third nearest byte as well). Counts of a bucket are merged over the chunks, in parts first where there are many; the
trees below each pair of bytes are built by themselves; pairs, single bytes and the root follow from their sums; a
bucket's probabilities go back to the chunks that have its strings, and each chunk's texts are scored. Nothing of the
model passes through the driver but depths 0 and 1 (at most 256 * 255 + 255 nodes), and no task holds more than a
bucket's strings or a chunk. A text longer than a chunk is cut behind a word into several.

Words are told apart by 64-bit hashes. Nulls: a null text is an empty one (its end only); a null doc_id counts as
text "" in the split and trains. Repeated rows count as often as they stand. Without training texts every byte has
probability 1/256. Extra columns are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, give_back, shuffle_partitions, slices, text_batches

DEPTH = 6
CHUNK_BYTES = 12_000_000
#: Bytes of text for one bucket, for one part of the chunks, and for one share of the third nearest byte.
BUCKET_BYTES, PART_BYTES, SPLIT_BYTES = 8_000_000, 2_000_000_000, 64_000_000_000
MOST_BUCKETS = 65_536
CACHE_WORDS = 200_000
GRAM, WORD = 0, 1
END = b"\n"


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0) - math.log(math.pi)


def lgamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    low = np.ones_like(x)
    for i in range(8):
        low = low * (x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


def grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and sums of values."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[first], *(np.add.reduceat(v[order], first) for v in values))


def nodes(grams: np.ndarray, counts: np.ndarray, depth: int, full: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, zeros, ones) of the contexts of that depth; node: the context's bytes, then 1 and the bits before."""
    context, byte = grams >> (8 + 8 * (full - depth)), grams & 255
    key, n = grouped((context << 8) | byte, counts)
    context, byte = key >> 8, key & 255
    parts = []
    for b in range(8):
        one = (byte >> (7 - b)) & 1
        parts.append(((context << 8) | (1 << b) | (byte >> (8 - b)), n * (1 - one), n * one))
    return grouped(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def weigh(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(log weighted probability, weight of the node's own estimate); below: sums of its children's logs."""
    own = log_kt(zeros, ones)
    if below is None:
        return own, np.ones(len(own))
    half = math.log(0.5)
    both = np.logaddexp(half + own, half + below)
    return both, np.exp(half + own - both)


def subtrees(grams: np.ndarray, counts: np.ndarray, full: int = DEPTH, top: int = 2) -> dict[int, tuple[np.ndarray, ...]]:
    """depth: (node, zeros, ones, log weighted, own weight), for depths top to full, of grams that have counts."""
    out, below = {}, None
    for depth in range(full, top - 1, -1):
        key, zeros, ones = nodes(grams, counts, depth, full)
        logs, own = weigh(zeros, ones, below)
        out[depth] = (key, zeros, ones, logs, own)
        below = grouped(parents(key), logs)[1]
    return out


def parents(key: np.ndarray) -> np.ndarray:
    """The nodes one byte of context up."""
    return ((key >> 16) << 8) | (key & 255)


def tops(first: pd.DataFrame) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Depth 1 and depth 0 as (node, zeros, ones, own weight), from depth 1's node, zeros, ones, below."""
    first = first.sort_values("node")
    key, zeros, ones = (first[c].to_numpy() for c in ("node", "zeros", "ones"))
    logs, own = weigh(zeros, ones, first["below"].to_numpy())
    root, z0, o0, below = grouped(key & 255, zeros, ones, logs)
    return (key, zeros, ones, own), (root, z0, o0, weigh(z0, o0, below)[1])


def log10_bytes(grams: np.ndarray, trees: dict, depth1: tuple, depth0: tuple, full: int = DEPTH) -> np.ndarray:
    """log10 of the mixture's probability of each gram's last byte after the bytes before."""
    levels = {d: (t[0], t[1], t[2], t[4]) for d, t in trees.items()} | {1: depth1, 0: depth0}
    total = np.zeros(len(grams))
    byte = grams & 255
    for b in range(8):
        one = (byte >> (7 - b)) & 1
        node = (1 << b) | (byte >> (8 - b))
        p = np.full(len(grams), 0.5)
        seen = np.zeros(len(grams), bool)
        for depth in range(full, -1, -1):
            keys, zeros, ones, own = levels[depth]
            if not len(keys):
                continue
            wanted = ((grams >> (8 + 8 * (full - depth))) << 8) | node
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            here = keys[at] == wanted
            kt = (np.where(one == 1, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1.0)
            mix = np.where(seen, own[at] * kt + (1 - own[at]) * p, kt)
            p = np.where(here, mix, p)
            seen |= here
        total += np.log10(p)
    return total


def gram_keys(joined: bytes, lengths: np.ndarray, full: int = DEPTH, given: np.ndarray | None = None) -> np.ndarray:
    """For each byte of the texts (one after the other, of these lengths) the bytes before, nearest first, then it.

    Before a text stand ends. given: how many bytes of each text are only there as context (full of them, or none) and
    get no key.
    """
    given = np.zeros(len(lengths), np.int64) if given is None else given
    raw = np.frombuffer(joined, np.uint8)
    # all texts with full bytes of context before them
    spans = lengths - given + full
    own = np.ones(int(spans.sum()), bool)
    starts = np.cumsum(spans) - spans
    own[(starts[:, None] + np.arange(full)).ravel()] = False
    bare = given == 0
    held = own.copy()
    held[(starts[~bare, None] + np.arange(full)).ravel()] = True
    row = np.full(len(own), END[0], np.uint8)
    row[held] = raw
    # read backwards, the eight bytes from there on are those before a byte, nearest first
    back = np.concatenate([row[::-1], np.full(8, END[0], np.uint8)])
    eight = np.ndarray((len(own),), ">u8", buffer=back.data, offset=1, strides=(1,)).astype(np.uint64)[::-1][own]
    return ((eight >> np.uint64(64 - 8 * full)) << np.uint64(8) | row[own]).view(np.int64)


class Words:
    """64-bit hashes of words, each distinct one hashed once."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes of distinct words, which of them each word is, how many words each text has)."""
        split = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(pa.array(texts, pa.binary()).view(pa.string())))
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.view(pa.binary()).to_pylist()
        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in distinct:
            if w not in known:
                h = digest(w)
                known[w] = h - (1 << 64) if h >> 63 else h
        hashed = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        codes, n = coded.indices.to_numpy(), np.diff(split.offsets.to_numpy())
        # a text without words is split into one empty word
        blank = np.fromiter((not w for w in distinct), bool, len(distinct))
        if blank.any():
            on = ~blank[codes]
            n = np.add.reduceat(np.append(on, 0), np.cumsum(n) - n).astype(np.int64) * (n > 0)
            codes = codes[on]
        return hashed, codes, n.astype(np.int64)


def canonical(text: str | bytes | None) -> bytes:
    raw = text.encode() if isinstance(text, str) else text or b""
    return b" ".join(raw.lower().split()) + END


def pack(values: np.ndarray) -> bytes:
    """Byte planes of the values, compressed."""
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Of keys in order; differences wrap around."""
    return pack(np.diff(keys, prepend=np.int64(0)))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, "<i8"))


def dealt(codes: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each code."""
    x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


class Plan:
    """How the strings are dealt out: buckets of grams, as many of words behind them, shares of the third byte, parts."""

    def __init__(self, size: int, least: int, bucket_bytes: int = BUCKET_BYTES, part_bytes: int = PART_BYTES, split_bytes: int = SPLIT_BYTES):
        self.buckets = min(MOST_BUCKETS, max(least, -(-size // bucket_bytes), 1))
        self.split = min(256, max(1, -(-size // split_bytes)))
        self.parts = max(1, -(-size // part_bytes))

    def of_grams(self, keys: np.ndarray) -> np.ndarray:
        near, third = keys >> (8 * (DEPTH - 1)), (keys >> (8 * (DEPTH - 2))) & 255
        return dealt(near * 256 + third % self.split, self.buckets)

    def of_words(self, keys: np.ndarray) -> np.ndarray:
        """By ranges of the hashes: those of a bucket lie close together, which makes their differences short."""
        return self.buckets + (((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)).astype(np.int64)

    def of_pair_nodes(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which node, bucket): every bucket that has strings below the pair."""
        at = np.repeat(np.arange(len(nodes)), self.split)
        share = np.tile(np.arange(self.split), len(nodes))
        found = np.unique(np.column_stack([at, dealt((nodes[at] >> 8) * 256 + share, self.buckets)]), axis=0)
        return found[:, 0], found[:, 1]


BLOBS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary())])
BLOBS_DDL = "chunk long, bucket int, part int, keys binary, counts binary, docs binary"
#: A chunk's texts: the row they are of, bytes that are context only, whether the text ends here.
LINES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("given", pa.int32()), ("last", pa.bool_()), ("text", pa.binary())])


def tallied(keys: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each is one of the training texts'."""
    both = np.sort((keys << 1) | training)
    keys = both >> 1
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(both & 1, first)


def _held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def segments(text: bytes, most: int) -> Iterator[tuple[int, bytes, bool]]:
    """(bytes that are context only, bytes, whether the text ends here) of runs of whole words, of about most bytes."""
    start, most = 0, max(most, DEPTH)
    while len(text) - start > most and (at := text.find(b" ", start + most)) >= 0:
        given = min(start, DEPTH)
        yield given, text[start - given : at + 1], False
        start = at + 1
    given = min(start, DEPTH)
    yield given, text[start - given :], True


def chunked(docs: DataFrame, plan: Plan, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Blobs of each chunk's distinct strings and how often its training texts have them, for each bucket; one row a
    chunk (bucket -1) has its texts instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, row, words = TaskContext.get().partitionId(), 0, 0, Words()
        press = zstandard.ZstdCompressor(level=3)
        lines: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq, size
            chunk, totals = (task << 32) + seq, {GRAM: [], WORD: []}
            for i, j in slices(len(x[-1]) for x in lines):
                some = [x[-1] for x in lines[i:j]]
                given, lengths = np.array([x[3] for x in lines[i:j]]), np.array([len(t) for t in some])
                training = ~np.array([x[2] for x in lines[i:j]], bool)
                totals[GRAM].append(tallied(gram_keys(b"".join(some), lengths, given=given), np.repeat(training, lengths - given)))
                hashed, codes, n = words.hashes([t[g:] for t, g in zip(some, given.tolist(), strict=True)])
                totals[WORD].append((hashed, np.bincount(codes[np.repeat(training, n)], minlength=len(hashed))))
            part = int(dealt(np.array([chunk]), plan.parts)[0])
            out: list[tuple] = []
            for kind, t in totals.items():
                keys, n = grouped(*(np.concatenate(x) for x in zip(*t, strict=True)))
                bucket = (plan.of_grams if kind == GRAM else plan.of_words)(keys)
                order = np.argsort((bucket % plan.buckets).astype(np.uint16), kind="stable")  # below MOST_BUCKETS
                keys, n, bucket = keys[order], n[order], bucket[order]
                ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket)) if len(bucket) else []
                start = 0
                for end in ends:
                    out.append((chunk, int(bucket[start]), part, pack_keys(keys[start:end]), pack(n[start:end]), None))
                    start = end
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, LINES) as w:
                w.write_table(pa.table(list(map(list, zip(*lines, strict=True))), schema=LINES))
            out.append((chunk, -1, part, None, None, press.compress(sink.getvalue().to_pybytes())))
            for i in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 1000], strict=True), BLOBS, strict=True)], schema=BLOBS)
            lines.clear()
            seq, size = seq + 1, 0
            pa.default_memory_pool().release_unused()

        for b in batches:
            for doc, held, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for given, part, last in segments(canonical(text), chunk_bytes):
                    lines.append(((task << 40) + row, doc, held, given, last, part))
                    size += len(part)
                    if size >= chunk_bytes:
                        yield from flush()
                row += 1
        if lines:
            yield from flush()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), F.col("text").cast("binary").alias("text")).mapInArrow(run, BLOBS_DDL)


MERGED_DDL = "bucket int, part int, keys binary, counts binary, tokens long, types long"


def merged(blobs: DataFrame, by: list[str]) -> DataFrame:
    """Blobs with equal by as one each: distinct keys and the sums of their counts."""

    def run(t: pa.Table) -> pa.Table:
        keys, n = grouped(np.concatenate([unpack_keys(x) for x in t["keys"].to_pylist()]), np.concatenate([unpack(x, "<i8") for x in t["counts"].to_pylist()]))
        give_back()
        return pa.table({"bucket": pa.array([t["bucket"][0].as_py()], pa.int32()), "part": pa.array([t["part"][0].as_py()], pa.int32()), "keys": [pack_keys(keys)], "counts": [pack(n)], "tokens": [int(n.sum())], "types": [int((n > 0).sum())]})

    return blobs.select("bucket", "part", "keys", "counts").groupBy(*by).applyInArrow(run, MERGED_DDL)


def _sums(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])


def model(strings: DataFrame, plan: Plan, scratch: Scratch) -> DataFrame:
    """(bucket, keys, numbers): log10 probability of the last byte of every gram of strings (bucket, keys, counts)."""

    def below_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, n in zip(*(b.column(c).to_pylist() for c in ("keys", "counts")), strict=True):
                keys, n = unpack_keys(keys), unpack(n, "<i8")
                if (n > 0).any():
                    node, zeros, ones, logs, _ = subtrees(keys[n > 0], n[n > 0], top=3)[3]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, grouped(parents(node), zeros, ones, logs))), names=["node", "zeros", "ones", "below"])
        give_back()

    nodes_ddl = "node long, zeros long, ones long, below double"
    pairs = scratch.keep(_sums(strings.mapInArrow(below_pairs, nodes_ddl)), "pairs")

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For the level above: the nodes with the logs of the level below in the place of its sums."""
        for b in batches:
            node, zeros, ones, below = (c.to_numpy() for c in b.columns)
            logs, _ = weigh(zeros, ones, below)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, (parents(node), zeros, ones, logs))), names=["node", "zeros", "ones", "below"])

    # at most 256 * 255 rows
    held = strings.sparkSession.sparkContext.broadcast(tops(_sums(pairs.mapInArrow(weighed, nodes_ddl)).toPandas()))

    def to_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, zeros, ones, below = (c.to_numpy() for c in b.columns)
            own = weigh(zeros, ones, below)[1]
            at, bucket = plan.of_pair_nodes(node)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *(pa.array(x[at]) for x in (node, zeros, ones, own))], names=["of", "node", "zeros", "ones", "own"])

    near = pairs.mapInArrow(to_buckets, "of int, node long, zeros long, ones long, own double")

    def numbers(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"bucket": [], "keys": [], "numbers": []}
        if left.num_rows:
            keys, n = unpack_keys(left["keys"][0].as_py()), unpack(left["counts"][0].as_py(), "<i8")
            empty = np.zeros(0, np.int64)
            trees = subtrees(keys[n > 0], n[n > 0], top=3) if (n > 0).any() else {d: (empty,) * 5 for d in range(3, DEPTH + 1)}
            node, zeros, ones, own = (right[c].to_numpy() for c in ("node", "zeros", "ones", "own"))
            order = np.argsort(node)
            trees[2] = (node[order], zeros[order], ones[order], None, own[order])
            logs = [log10_bytes(keys[i : i + 200_000], trees, *held.value) for i in range(0, len(keys), 200_000)]
            out = {"bucket": [left["bucket"][0].as_py()], "keys": [left["keys"][0].as_py()], "numbers": [pack(np.concatenate(logs).astype("<f4"))]}
        give_back()
        return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "keys": pa.array(out["keys"], pa.binary()), "numbers": pa.array(out["numbers"], pa.binary())})

    return strings.select("bucket", "keys", "counts").groupBy("bucket").cogroup(near.groupBy("of")).applyInArrow(numbers, "bucket int, keys binary, numbers binary")


def _kind(bucket: int, plan: Plan) -> str:
    return "<f4" if bucket < plan.buckets else "<i8"


def looked_up(blobs: DataFrame, found: DataFrame, plan: Plan) -> DataFrame:
    """(of_chunk, bucket, keys, numbers) for the strings of each chunk."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(plan.parts - 1))).alias("part2")
    found = found.select(F.col("bucket").alias("bucket2"), F.col("keys").alias("keys2"), "numbers", parts)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunks, buckets, keys, out = (left[c].to_pylist() for c in ("chunk", "bucket", "keys")), [], [], []
        chunks, buckets, keys = chunks
        if chunks:
            kind = _kind(buckets[0], plan)
            every, numbers = unpack_keys(right["keys2"][0].as_py()), unpack(right["numbers"][0].as_py(), kind)
            out = [pack(numbers[np.searchsorted(every, unpack_keys(k))]) for k in keys]
        return pa.table({"of_chunk": pa.array(chunks, pa.int64()), "bucket": pa.array(buckets, pa.int32()), "keys": pa.array(keys, pa.binary()), "numbers": pa.array(out, pa.binary())})

    return blobs.select("chunk", "bucket", "part", "keys").groupBy("bucket", "part").cogroup(found.groupBy("bucket2", "part2")).applyInArrow(run, "of_chunk long, bucket int, keys binary, numbers binary")


def found_in(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The numbers of keys in a table (keys in order, numbers) that has them all; looked up in order, which is faster."""
    if not len(keys):
        return np.zeros(0)
    order = np.argsort(keys)
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    out = np.empty(len(keys))
    out[order] = np.repeat(table[1][np.searchsorted(table[0], ranked[first])], np.diff(np.append(first, len(ranked))))
    return out


SCORES = ["row", "doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base_score", "score"]
SCORES_DDL = "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base_score double, score double"


def score(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, **limits: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every row.

    limits: bucket_bytes, part_bytes, split_bytes of Plan.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    text_batches(spark)
    first = docs.agg(F.sum((~_held_out()).cast("long")).alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    train_docs = first.n or 0
    plan = Plan(first.size or 0, shuffle_partitions(spark), **limits)
    chunks = scratch.keep(chunked(docs, plan, chunk_bytes), "chunks")
    blobs = chunks.filter("bucket >= 0")
    totals = merged(blobs, ["bucket", "part"])
    if plan.parts > 1:
        totals = merged(scratch.keep(totals, "parts"), ["bucket"])
    totals = scratch.keep(totals, "totals")
    is_gram = F.col("bucket") < plan.buckets
    sums = totals.filter(~is_gram).agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    tokens, types = (sums.tokens or 0) + train_docs, (sums.types or 0) + (train_docs > 0)
    grams = model(totals.filter(is_gram), plan, scratch)
    found = scratch.keep(grams.unionByName(totals.filter(~is_gram).select("bucket", "keys", F.col("counts").alias("numbers"))), "numbers")
    looked = looked_up(blobs, found, plan)
    whole = tokens + 0.5 * (types + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = {}
        every = list(zip(*(right[c].to_pylist() for c in ("bucket", "keys", "numbers")), strict=True))
        for kind, some in ((GRAM, [x for x in every if x[0] < plan.buckets]), (WORD, [x for x in every if x[0] >= plan.buckets])):
            keys = np.concatenate([unpack_keys(k) for _, k, _ in some]) if some else np.zeros(0, np.int64)
            numbers = np.concatenate([unpack(v, _kind(b, plan)) for b, _, v in some]).astype(float) if some else np.zeros(0)
            order = np.argsort(keys)
            tables[kind] = keys[order], numbers[order]
        words, out = Words(), []
        for packed in left["docs"].to_pylist():
            lines = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed)).read_all()
            texts, givens, lasts = (lines[c].to_pylist() for c in ("text", "given", "last"))
            for i, j in slices(map(len, texts)):
                some, given, last = texts[i:j], np.array(givens[i:j]), np.array(lasts[i:j], bool)
                lengths = np.array([len(t) for t in some])
                own = lengths - given
                scores = np.add.reduceat(found_in(tables[GRAM], gram_keys(b"".join(some), lengths, given=given)), np.cumsum(own) - own)
                hashed, codes, n = words.hashes([t[g:] for t, g in zip(some, given.tolist(), strict=True)])
                counts = found_in(tables[WORD], hashed)[codes]
                owner = np.repeat(np.arange(len(some)), n)
                base = np.bincount(owner, np.log10((counts + 0.5) / whole), len(some)) + last * math.log10((train_docs + 0.5) / whole)
                known = np.bincount(owner, counts > 0, len(some)).astype(np.int64) + last * (train_docs > 0)
                head = [lines[c].slice(i, j - i) for c in SCORES[:3]]
                out.append(pa.table([*head, pa.array(n + last, pa.int64()), pa.array(own, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64())], names=SCORES))
        give_back()
        return pa.concat_tables(out)

    texts = chunks.filter("bucket < 0").select("chunk", "docs")
    scored = texts.groupBy("chunk").cogroup(looked.groupBy("of_chunk")).applyInArrow(run, SCORES_DDL)
    # the segments of a long text
    scored = scored.groupBy("row", "doc_id", "held_out").agg(*[F.sum(c).alias(c) for c in SCORES[3:]])
    scored = scratch.keep(scored, "scores")
    scratch.clear("scores")
    bits = -F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", bits.alias("bits_per_byte"))
