"""MinHash near-duplicates by an LSH forest.

A document is its set of distinct k-word shingles (words are runs of non-white-space, A-Z lowered). Equal sets make one
class, so that copies never pair up. TREES sorted signature orders of DEPTH MinHash values give candidates:

* In each order, classes that share a prefix of START values form a region; its depth adapts: a region of more than
  REGION members is cut by the next value, until it is small or the signature ends. So a class's longest-common-prefix
  neighbours in an order are the other members of the deepest region that has REGION members at most.
* The first round takes one candidate a class, the first member of the deepest region that it is in, over all orders.
  What the full sets confirm is contracted: a dense family becomes a star and not a clique.
* The second round takes what is still apart: in small regions all members of different components, in large ones
  each member and the region's first. A pair inside one component can't change it, so nothing is lost by leaving it out.
* Classes that meet in a region of FAMILY_DEPTH values and still too large to be all neighbours form families. In
  each, the members outside its largest component are compared with all members of fitting size, block by block: a task
  gets at most two blocks and gives one link for a member and component, so that a family's pairs are never rows.

A pair of similarity 0.8 shares a prefix of 3 in one of 20 orders with probability 1 - (1 - 0.8 ** 3) ** 20, over
0.999999. The scan over all texts keeps 320 bytes of signature a document; whole sets, of 64-bit hashes, are made for one
document of each class that has a neighbour, and each link is confirmed on them. Counts are aggregated by key with
partial aggregation, sides that grow are merged so that Spark splits hot keys, and no group is gathered.

Nulls: a document without words (or text) has an empty set and links to nothing; one with fewer than k words has its
whole sequence as its only shingle. Rows with equal sets link even if their doc_id is the same or null; a component's id
is its least doc_id that isn't null. Extra columns are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import Scratch, give_back, row_key, slices, text_batches

TREES, DEPTH, START = 20, 8, 3
REGION = 12
FAMILY_DEPTH = 5
#: Members and shingles of a block, and shingles that one step of a block's comparison takes.
BLOCK, BLOCK_SHINGLES, STEP = 1024, 500_000, 4096
CACHE_WORDS = 250_000
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SEEDS = mixed(np.arange(1, 2 * TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(_P))
_A, _B = _SEEDS[: TREES * DEPTH] | np.uint64(1), _SEEDS[TREES * DEPTH :]


class Shingler:
    """Hashed shingle sets of texts; each word is hashed once."""

    def __init__(self, k: int):
        self.k = k
        self.powers = np.array([pow(_P, i, 1 << 64) for i in range(k)], np.uint64)
        self.known: dict[bytes, int] = {}

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        split = [(t or b"").lower().split() for t in texts]
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        digest = xxhash.xxh3_64_intdigest
        for w in set().union(*split).difference(known) if split else ():
            known[w] = digest(w)
        out = []
        for words in split:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            k = min(self.k, len(h))
            if not k:
                out.append(h)
                continue
            n = len(h) - k + 1
            x = h[:n] * self.powers[0]
            for i in range(1, k):
                x = x * np.uint64(3) + h[i : i + n] * self.powers[i]
            out.append(np.unique(mixed(x + np.uint64(k))))
        return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES * DEPTH MinHash values, each as 16 bits of a hash of the whole minimum: the minimum's own top bits are zeros
    for sets that are large enough."""
    x = shingles[:, None] if len(shingles) else np.zeros((1, 1), np.uint64)
    least = None
    for i in range(0, len(x), 2048):
        part = (x[i : i + 2048] * _A + _B).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return (mixed(least) >> np.uint64(48)).astype("<u2")


SIGNATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64()), ("sig", pa.binary()), ("key", pa.binary())])
SIGNATURES_DDL = "doc_id long, n_shingles long, cls long, sig binary, key binary"


def _signed(values: list[int]) -> list[int]:
    return [v - (1 << 64) if v >> 63 else v for v in values]


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, cls, sig, key): cls is a hash of the whole set, null for the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for i, j in slices(len(t or b"") for t in texts):
                sets = shingler.sets(texts[i:j])
                cls = _signed([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets])
                yield pa.RecordBatch.from_arrays([
                    ids.slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(cls, pa.int64(), mask=np.array([len(s) == 0 for s in sets])),
                    pa.array([signature(s).tobytes() for s in sets], pa.binary()), b.column(2).slice(i, j - i),
                ], schema=SIGNATURES)
        shingler.known.clear()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), row_key().alias("key")).mapInArrow(run, SIGNATURES_DDL)


def whole_sets(docs: DataFrame, picked: DataFrame, k: int) -> DataFrame:
    """(cls, n, members) of the documents whose row key is in picked (key, cls), members being hashes in order."""
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("members", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(len(t or b"") for t in texts):
                sets = shingler.sets(texts[i:j])
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                members = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(ends), pa.int64()), members], schema=schema)
        shingler.known.clear()
        give_back()

    rows = docs.select(row_key().alias("key"), F.col("text").cast("binary").alias("text")).hint("merge").join(picked.select("key", "cls"), "key")
    # rows with the same key are repeats of one another; they meet in the join already
    return rows.dropDuplicates(["key"]).select("cls", "text").mapInArrow(run, "cls long, n long, members array<long>")


def fits(a: str, b: str, percent: int = 80) -> Column:
    """Sets of these sizes can be that similar."""
    return 100 * F.least(F.col(a), F.col(b)) >= percent * F.greatest(F.col(a), F.col(b))


def forest(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(cls, n, key, size, first, depth): every region of several classes (cls, n, sig) that each class is in."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = classes.select("cls", "n", "sig", tree).select("cls", "n", "tree", F.expr(f"substring(sig, tree * {2 * DEPTH} + 1, {2 * DEPTH})").alias("order"))
    rows = rows.select("cls", "n", "order", F.xxhash64("tree", F.substring("order", 1, 2 * START)).alias("key"))
    levels = []
    for depth in range(START, DEPTH + 1):
        regions = scratch.keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("cls").alias("first")).filter("size > 1"), "regions")
        rows = scratch.keep(rows.hint("merge").join(regions.hint("merge"), "key"), "forest")
        levels.append(rows.select("cls", "n", "key", "size", "first", F.lit(depth).alias("depth")))
        if depth == DEPTH:
            break
        rows = rows.filter(F.col("size") > REGION).select("cls", "n", "order", F.xxhash64("key", F.expr(f"substring(order, {2 * depth + 1}, 2)")).alias("key"))
        if not rows.limit(1).count():
            break
    return reduce(DataFrame.unionByName, levels)


def _paired(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def deepest(regions: DataFrame) -> DataFrame:
    """(a, b): each class with the first of the deepest region that it is in and not the first of."""
    best = regions.filter("cls <> first").groupBy("cls").agg(F.max(F.struct("depth", "first")).alias("best"))
    return best.select(*_paired(F.col("cls"), F.col("best.first"))).distinct()


def apart(regions: DataFrame, labels: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b) in different components: neighbours in small regions, members of large ones and the region's first."""
    named = regions.join(labels, "cls", "left").select("cls", "n", "key", "size", F.coalesce("label", "cls").alias("label"))
    named = scratch.keep(named, "named")
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct("cls", "n", "label")).alias("first")).filter("low <> high")
    rows = scratch.keep(named.hint("merge").join(scratch.keep(mixed.select("key", "first"), "mixed").hint("merge"), "key"), "mixed-rows")
    far = rows.filter(F.col("size") > REGION).select("cls", "n", "label", F.col("first.cls").alias("cls2"), F.col("first.n").alias("n2"), F.col("first.label").alias("label2"))
    far = far.filter((F.col("label") != F.col("label2")) & fits("n", "n2", percent)).select("cls", "cls2")
    small = rows.filter(F.col("size") <= REGION).select("key", "cls", "n", "label")
    other = small.select(F.col("key").alias("key2"), F.col("cls").alias("cls2"), F.col("n").alias("n2"), F.col("label").alias("label2"))
    near = small.join(other, (F.col("key") == F.col("key2")) & (F.col("cls") < F.col("cls2")) & (F.col("label") != F.col("label2")) & fits("n", "n2", percent))
    return far.union(near.select("cls", "cls2")).select(*_paired(F.col("cls"), F.col("cls2"))).distinct()


def within_families(regions: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """Links (a, b) between members of a family that are in different components, one for a member and component."""
    edges = regions.filter((F.col("depth") == FAMILY_DEPTH) & (F.col("size") > REGION) & (F.col("cls") != F.col("first"))).select(F.col("cls").alias("a"), F.col("first").alias("b")).distinct()
    edges = scratch.keep(edges, "families")
    if not edges.limit(1).count():
        return None
    nodes = edges.select(F.col("a").alias("cls")).union(edges.select("b")).distinct()
    named = components(nodes, edges, scratch).withColumnRenamed("label", "family").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    named = scratch.keep(named, "families")
    sizes = named.groupBy("family", "label").agg(F.count(F.lit(1)).alias("size"))
    whole = sizes.groupBy("family").agg(F.sum("size").alias("all"), F.max(F.struct("size", "label")).alias("most"))
    whole = whole.filter(F.col("most.size") < F.col("all")).select("family", F.col("most.label").alias("main"))
    # sizes in bands: a set fits none beyond the bands beside its own
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent))).cast("int")
    rows = scratch.keep(named.join(whole, "family").join(sets.select("cls", "n"), "cls").withColumn("band", band), "families")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    every_blocks = rows.groupBy("family", "band").agg(blocks.alias("blocks"))
    odd_blocks = rows.filter("label <> main").groupBy("family", "band").agg(blocks.alias("odd_blocks"))
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    # (band of the odd one, band of the other) that both have members
    meet = odd_blocks.select("family", F.col("band").alias("odd_band"), "odd_blocks", near.alias("band")).join(every_blocks, ["family", "band"])
    meet = scratch.keep(meet, "families")
    odd = rows.filter("label <> main").select("family", "cls", "label", F.col("band").alias("odd_band")).join(meet, ["family", "odd_band"])
    odd = odd.select("family", "odd_band", "band", "cls", "label", F.pmod(F.xxhash64("cls"), F.col("odd_blocks")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j")).join(sets, "cls")
    every = rows.select("family", "cls", "label", "band").join(meet, ["family", "band"])
    every = every.select("family", "odd_band", "band", "cls", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("odd_blocks") - 1)).alias("i"), F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("j")).join(sets, "cls")
    every = every.select(*[F.col(c).alias(f"{c}2") for c in ("family", "odd_band", "band", "i", "j", "cls", "label", "n", "members")])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: tuple[list, list] = [], []
        if left.num_rows and right.num_rows:
            sides = []
            for t, end in ((left, ""), (right, "2")):
                members = t.column(f"members{end}").combine_chunks()
                sides.append((members.flatten().to_numpy(), np.diff(members.offsets.to_numpy()), *(t.column(f"{c}{end}").to_numpy() for c in ("n", "label", "cls"))))
            (va, la, na, ga, ca), (vb, lb, nb, gb, cb) = sides
            common = np.intersect1d(va, vb)
            ia, ib = np.searchsorted(common, va), np.searchsorted(common, vb)
            ia, ib = np.minimum(ia, max(len(common) - 1, 0)), np.minimum(ib, max(len(common) - 1, 0))
            ra, rb = np.repeat(np.arange(len(la)), la), np.repeat(np.arange(len(lb)), lb)
            ka, kb = (common[ia] == va, common[ib] == vb) if len(common) else (np.zeros(len(va), bool), np.zeros(len(vb), bool))
            both = np.zeros((len(la), len(lb)), np.float32)
            for s in range(0, len(common), STEP):
                x, y = np.zeros((len(la), STEP), np.float32), np.zeros((len(lb), STEP), np.float32)
                on = ka & (ia >= s) & (ia < s + STEP)
                x[ra[on], ia[on] - s] = 1
                on = kb & (ib >= s) & (ib < s + STEP)
                y[rb[on], ib[on] - s] = 1
                both += x @ y.T
            both = both.astype(np.int64)
            linked = (100 * both >= percent * (na[:, None] + nb[None, :] - both)) & (ga[:, None] != gb[None, :])
            for r in np.flatnonzero(linked.any(axis=1)):
                at = np.flatnonzero(linked[r])
                for q in at[np.unique(gb[at], return_index=True)[1]]:
                    found[0].append(ca[r]), found[1].append(cb[q])
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return odd.groupBy("family", "odd_band", "band", "i", "j").cogroup(every.groupBy("family2", "odd_band2", "band2", "i2", "j2")).applyInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets (cls, n, members) are similar enough. Both sides grow with the corpus, and are
    merged at every size."""
    left = sets.select(F.col("cls").alias("a"), F.col("members").alias("sa"), F.col("n").alias("na"))
    right = sets.select(F.col("cls").alias("b"), F.col("members").alias("sb"), F.col("n").alias("nb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    joined = pairs.select("a", "b").hint("merge").join(left, "a").hint("merge").join(right, "b").filter(fits("na", "nb", percent))
    return joined.select("a", "b", "na", "nb", both.alias("both")).filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def components(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(cls, label): the least node that each is linked with, by least labels of neighbours and pointer jumping."""
    both = scratch.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = scratch.keep(nodes.select("cls", F.col("cls").alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("cls").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        step = labels.join(heard, labels.cls == heard.a, "left").select("cls", "label", F.least("label", F.coalesce("heard", "label")).alias("new"))
        step = scratch.keep(step, "labels")
        above = step.select(F.col("cls").alias("at"), F.col("new").alias("above"))
        jumped = scratch.keep(step.join(above, step.new == above.at).select("cls", "label", F.least("new", "above").alias("new")), "labels")
        labels = jumped.select("cls", F.col("new").alias("label"))
        if not jumped.filter("label <> new").limit(1).count():
            return labels


def relabel(labels: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """labels after more edges: components of components. A class without a label has its own."""
    ends = edges
    for end in ("a", "b"):
        ends = ends.join(labels.select(F.col("cls").alias(end), F.col("label").alias(f"l{end}")), end, "left").withColumn(f"l{end}", F.coalesce(f"l{end}", end))
    ends = scratch.keep(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")).filter("a <> b").distinct(), "edges")
    nodes = ends.select(F.col("a").alias("cls")).union(ends.select("b")).distinct()
    over = components(nodes, ends, scratch).select(F.col("cls").alias("label"), F.col("label").alias("over"))
    known = labels.unionByName(over.select(F.col("label").alias("cls"), "label").join(labels, "cls", "left_anti"))
    return scratch.keep(known.join(over, "label", "left").select("cls", F.coalesce("over", "label").alias("label")), "labels")


def link(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, scratch: Scratch) -> DataFrame:
    """(cls, label) of all classes (cls, n, sig) that are linked with others; a class that isn't there is alone.

    sets_of gives (cls, n, members) of the classes of its argument (cls).
    """
    regions = forest(classes, scratch)
    sets = scratch.keep(sets_of(regions.select("cls").distinct()), "whole-sets")
    links = scratch.keep(confirm(deepest(regions), sets, percent), "links")
    nodes = links.select(F.col("a").alias("cls")).union(links.select("b")).distinct()
    labels = components(nodes, links, scratch)
    pairs = scratch.keep(apart(regions, labels, percent, scratch), "apart")
    labels = relabel(labels, scratch.keep(confirm(pairs, sets, percent), "links"), scratch)
    more = within_families(regions, labels, sets, percent, scratch)
    return labels if more is None else relabel(labels, scratch.keep(more, "links"), scratch)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, cls, n_shingles, component_id, kept) of every row of docs; kept: doc_id = component_id."""
    return _grouped(docs, k, percent).drop("key", "label")


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """near_duplicates with the key of each row and the label of its component, which is null without words."""
    scratch = Scratch(docs.sparkSession)
    text_batches(docs.sparkSession)
    rows = scratch.keep(signatures(docs, k), "signatures")
    best = F.min(F.struct("key", F.col("n_shingles").alias("n"), "sig")).alias("best")
    classes = scratch.keep(rows.filter("cls is not null").groupBy("cls").agg(best).select("cls", "best.*"), "classes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return whole_sets(docs, scratch.keep(classes.select("cls", "key").join(wanted, "cls", "left_semi"), "picked"), k)

    labels = link(classes.select("cls", "n", "sig"), sets_of, percent, scratch)
    least = rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = least.join(labels, "cls", "left").select("cls", F.coalesce("label", "cls").alias("label"), "least")
    heads = scratch.keep(named.groupBy("label").agg(F.min("least").alias("component")), "heads")
    # merged, so that a component of very many classes is split
    by_class = scratch.keep(named.hint("merge").join(heads.hint("merge"), "label").select("cls", "label", "component"), "by-class")
    scratch.clear("signatures", "by-class")
    out = rows.drop("sig").join(by_class, "cls", "left").select("doc_id", "cls", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "key", "label")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: that of the least doc_id (null where all are), of several texts with
    it the least. Rows without words are components of their own; repeats of a doc_id and text are one document."""
    scratch = Scratch(docs.sparkSession)
    kept = _grouped(docs, k, percent).filter("kept")
    kept = scratch.keep(kept.select("key", F.coalesce(F.col("label").cast("string"), F.hex("key")).alias("of")).distinct(), "kept")
    keyed = docs.withColumn("__of", row_key()).hint("merge")
    keys = kept.select(F.col("key").alias("__key"))
    several = scratch.keep(kept.groupBy("of").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1"), "several")
    if several.limit(1).count():
        ties = scratch.keep(kept.join(several, "of").select("key", "of"), "ties")
        least = keyed.select("__of", "text").join(ties.hint("merge"), F.col("__of") == F.col("key")).groupBy("of").agg(F.min(F.struct("text", "key")).alias("least"))
        lost = scratch.keep(ties.join(least, "of").filter(F.col("key") != F.col("least.key")).select(F.col("key").alias("__key")), "lost")
        keys = keys.join(lost, "__key", "left_anti")
    rows = keyed.join(keys.hint("merge"), F.col("__of") == F.col("__key"))
    again = Window.partitionBy("__of").orderBy(F.xxhash64(*docs.columns))
    return rows.withColumn("__again", F.row_number().over(again)).filter("__again = 1").select(*docs.columns)
