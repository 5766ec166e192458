"""Reachability, paths, hierarchies and communities.

Small edge lists (LOCAL_EDGES at most, checked) are walked on the driver in one job; larger ones by a frontier that is
joined level by level, so that the number of jobs depends on the depth and never on the number of nodes.
"""

from __future__ import annotations

from collections import Counter, defaultdict, deque
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.operators.lineage import cut

LOCAL_EDGES = 200_000
PASSES, EPSILON = 50, 1e-9
SPREAD_ROUNDS = 24


def adjacency(edges: DataFrame, reverse: bool = False, kinds: list[int] | None = None) -> DataFrame:
    """(src, dst) of resolved edges, each pair once."""
    kept = edges.filter("resolved and to_file_id is not null")
    if kinds is not None:
        kept = kept.filter(F.col("kind").isin(kinds))
    a, b = ("to_file_id", "from_file_id") if reverse else ("from_file_id", "to_file_id")
    return kept.select(F.col(a).alias("src"), F.col(b).alias("dst")).distinct()


def reachable(pairs: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, depth) of what can be reached over (src, dst) from seeds (id), without the seeds themselves.

    Pairs and seeds are written once. They are counted there before any come to the driver, and each level reads the
    pairs as they lie: a small frontier is broadcast to them. What it meets and what has been seen are told apart by one
    aggregation of ids; an anti join would be pushed down to the pairs and exchange them.
    """
    spark = pairs.sparkSession
    pairs, frontier = cut(pairs.select("src", "dst"), "pairs"), cut(seeds.select("id").distinct(), "frontier")
    if pairs.count() <= LOCAL_EDGES and frontier.count() <= LOCAL_EDGES:
        out_of = defaultdict(list)
        some = pairs.toPandas()
        for a, b in zip(some.src.tolist(), some.dst.tolist(), strict=True):
            out_of[a].append(b)
        start = {r.id for r in frontier.collect()}
        seen, queue, found = set(start), deque((s, 0) for s in start), []
        while queue:
            at, depth = queue.popleft()
            if max_depth is not None and depth >= max_depth:
                continue
            for b in out_of[at]:
                if b not in seen:
                    seen.add(b)
                    found.append((b, depth + 1))
                    queue.append((b, depth + 1))
        return spark.createDataFrame(sorted(found), "id long, depth int")
    seen, depth = frontier.select("id", F.lit(0).alias("depth")), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        met = frontier.join(pairs, frontier.id == pairs.src).select(F.col("dst").alias("id"), F.lit(False).alias("old")).unionByName(seen.select("id", F.lit(True).alias("old")))
        frontier = cut(met.groupBy("id").agg(F.bool_or("old").alias("old")).filter("not old").select("id"), "frontier")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier.select("id", F.lit(depth).alias("depth")))
        if depth % 8 == 0:
            seen = cut(seen, "seen")
    return seen.filter("depth > 0")


def shortest_path(edges: DataFrame, source: int, target: int, max_depth: int | None = None) -> list[int]:
    """Node ids from source to target over fewest edges, [] if there is none; ties go to the smallest parent."""
    pairs = adjacency(edges)
    spark = edges.sparkSession
    levels = reachable(pairs, spark.createDataFrame([(source,)], "id long"), max_depth).unionByName(spark.createDataFrame([(source, 0)], "id long, depth int"))
    levels = cut(levels, "levels")
    at = levels.filter(F.col("id") == target).first()
    if at is None or source == target:
        return [source] if source == target else []
    path = [target]
    for depth in range(at.depth - 1, -1, -1):  # as many lookups as the path is long
        parent = pairs.filter(F.col("dst") == path[-1]).join(levels.filter(F.col("depth") == depth), F.col("src") == F.col("id")).agg(F.min("src").alias("p")).first()
        path.append(parent.p)
    return path[::-1]


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id) one edge from a seed in either direction, seeds excluded."""
    both = adjacency(edges).unionByName(adjacency(edges, reverse=True))
    return both.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seeds.select("id"), "id", "left_anti")


def ancestry_depth(entities: DataFrame) -> DataFrame:
    """(name, depth): how many types a class has above it by extends, over names, on the longest way up without a type
    twice.

    Types are settled from the top: one whose supertypes are all settled is one deeper than the deepest of them, so that
    rounds follow the depth and diamonds cost nothing. What is left has a cycle above it; only there ways are spelt out.
    """
    ext = cut(entities.filter("kind = 15 and name <> enclosing_function").select(F.col("enclosing_function").alias("sub"), F.col("name").alias("super")).distinct(), "extends")
    classes = cut(entities.filter("kind = 1").select("name").distinct(), "classes")
    names = classes.union(ext.select("sub")).union(ext.select("super")).distinct()
    settled = cut(names.join(ext.select(F.col("sub").alias("name")), "name", "left_anti").select("name", F.lit(0).alias("depth")), "settled")
    open_ = ext
    while open_.limit(1).count():
        above = settled.select(F.col("name").alias("super"), "depth")
        ready = open_.join(above, "super", "left").groupBy("sub").agg(F.max("depth").alias("depth"), F.bool_and(F.col("depth").isNotNull()).alias("all")).filter("all")
        ready = cut(ready.select(F.col("sub").alias("name"), (F.col("depth") + 1).alias("depth")), "ready")
        if not ready.limit(1).count():
            break
        settled = cut(settled.unionByName(ready), "settled")
        open_ = cut(open_.join(ready.select(F.col("name").alias("sub")), "sub", "left_anti"), "open")
    else:
        return classes.join(settled, "name")
    cyclic = open_.select(F.col("sub").alias("name")).distinct()
    walk = cut(classes.join(cyclic, "name", "left_semi").select("name", F.col("name").alias("cur"), F.array("name").alias("way")), "walk")
    found = [classes.join(settled, "name"), walk.select("name", F.lit(0).alias("depth"))]
    while walk.limit(1).count():
        steps = cut(walk.join(open_, walk.cur == open_["sub"]).filter(~F.array_contains("way", F.col("super"))).select("name", "way", "super"), "steps")
        ends = steps.join(settled.select(F.col("name").alias("super"), "depth"), "super").select("name", (F.size("way") + F.col("depth")).alias("depth"))
        found += [ends, steps.select("name", F.size("way").alias("depth"))]
        walk = cut(steps.join(cyclic.select(F.col("name").alias("super")), "super", "left_semi").select("name", F.col("super").alias("cur"), F.array_append("way", F.col("super")).alias("way")), "walk")
    return reduce(DataFrame.unionByName, found).groupBy("name").agg(F.max("depth").alias("depth"))


def hierarchy(entities: DataFrame, name: str, up: bool = True) -> DataFrame:
    """(name, depth) of super- or subtypes of a type name."""
    rows = entities.filter(F.col("kind").isin(15, 16))
    a, b = ("enclosing_function", "name") if up else ("name", "enclosing_function")
    pairs = rows.select(F.col(a).alias("src"), F.col(b).alias("dst")).filter("src is not null and dst is not null").distinct()
    out_of = defaultdict(list)
    some = pairs.limit(LOCAL_EDGES + 1).collect()
    if len(some) > LOCAL_EDGES:
        ids = cut(pairs.select(F.col("src").alias("n")).union(pairs.select("dst")).distinct().select("n", F.xxhash64("n").alias("id")), "names")
        keyed = pairs.select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst"))
        found = reachable(keyed, ids.filter(F.col("n") == name).select("id"))
        return found.join(ids, "id").select(F.col("n").alias("name"), "depth")
    for r in some:
        out_of[r.src].append(r.dst)
    seen, queue = {name: 0}, deque([name])
    while queue:
        at = queue.popleft()
        for b_ in out_of[at]:
            if b_ not in seen:
                seen[b_] = seen[at] + 1
                queue.append(b_)
    del seen[name]
    return entities.sparkSession.createDataFrame(sorted(seen.items()), "name string, depth int")


def modularity_choice(links: dict[int, int], total: dict[int, int], own: int, degree: int, m: int) -> int:
    """The community that a node of this degree best joins, by the textbook gain: its links there, less the links that a
    random graph of the same degrees would give it. links and total leave the node itself out; within EPSILON the
    smaller number wins."""
    gains = {c: links.get(c, 0) / m - degree * total[c] / (2 * m * m) for c in {own, *links}}
    enough = max(gains.values()) - EPSILON
    return min(c for c, g in gains.items() if g >= enough)


def louvain(nodes: list[int], edges: list[tuple[int, int]]) -> dict[int, int]:
    """Single-level local moving: node -> community (its smallest starting member's place in nodes).

    Nodes take their turns in the given order until a pass moves none, PASSES times at most; parallel edges add weight,
    edges from a node to itself don't count.
    """
    label = {n: i for i, n in enumerate(nodes)}
    around: dict[int, Counter] = {n: Counter() for n in nodes}
    for a, b in edges:
        if a != b and a in around and b in around:
            around[a][b] += 1
            around[b][a] += 1
    degree = {n: sum(c.values()) for n, c in around.items()}
    m = sum(degree.values()) // 2
    total = Counter({label[n]: d for n, d in degree.items()})
    for _ in range(PASSES if m else 0):
        before = dict(label)
        for n in nodes:
            total[label[n]] -= degree[n]
            links = Counter()
            for b, w in around[n].items():
                links[label[b]] += w
            label[n] = modularity_choice(links, total, label[n], degree[n], m)
            total[label[n]] += degree[n]
        if label == before:
            break
    return label


def spread_communities(files: DataFrame, edges: DataFrame, rounds: int = SPREAD_ROUNDS) -> DataFrame:
    """(file_id, label) by local moving without a driver: in each round a hashed half of the files moves at once to the
    neighbouring community of greatest modularity gain (ties: the smallest), by joins and sums. For graphs that are too
    large to be walked in order; its communities needn't equal louvain's. Only links of files whose turn it is are
    exchanged, once a round, with the sums of their communities."""
    pairs = edges.filter("resolved and to_file_id is not null and from_file_id <> to_file_id").select(F.least("from_file_id", "to_file_id").alias("a"), F.greatest("from_file_id", "to_file_id").alias("b"))
    links = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    both = links.select(F.inline(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w"))))
    both = cut(both, "weights")
    labels = cut(files.select("id", F.col("id").alias("label")).join(both.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("degree")), "id", "left").fillna(0, ["degree"]), "labels")
    twice = both.agg(F.sum("w").alias("m")).first().m or 0
    for i in range(rounds if twice else 0):
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == i % 2
        sums = labels.join(labels.groupBy("label").agg(F.sum("degree").alias("total")), "label")
        near = both.withColumnRenamed("a", "id").filter(turn).join(sums.select(F.col("id").alias("b"), "label", "total"), "b").select("id", "label", "total", F.col("w").alias("links"))
        own = labels.filter(turn).select("id", F.col("label").alias("own"), "degree")
        stay = sums.filter(turn).select("id", "label", "total", F.lit(0).cast("long").alias("links"))
        tried = near.unionByName(stay).repartition("id").groupBy("id", "label").agg(F.sum("links").alias("links"), F.max("total").alias("total")).join(own, "id")
        rest = F.col("total") - F.when(F.col("label") == F.col("own"), F.col("degree")).otherwise(0)
        gain = F.col("links") * F.lit(float(twice)) - F.col("degree") * rest
        best = tried.groupBy("id").agg(F.max_by(F.col("label"), F.struct(gain, -F.col("label"))).alias("best"))
        moved = cut(labels.join(best, "id", "left").select("id", F.when(turn, F.coalesce("best", "label")).otherwise(F.col("label")).alias("label"), "degree", F.col("label").alias("was")), "labels")
        changed = moved.filter("label <> was").limit(1).count()
        labels = moved.drop("was")
        if not changed and i:
            break
    return labels.select(F.col("id").alias("file_id"), "label")


def communities(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_id, community_id): Louvain over all resolved edges; communities are numbered by their least path.

    Local moving in order is sequential by definition; graphs of LOCAL_EDGES edges and files at most (checked) are
    walked on the driver, larger ones by spread_communities.
    """
    pairs = edges.filter("resolved and to_file_id is not null").select("from_file_id", "to_file_id")
    if max(pairs.count(), files.count()) <= LOCAL_EDGES:
        local, rows = pairs.toPandas(), files.select("id", "path").toPandas().sort_values("path")
        label = louvain(rows.id.tolist(), list(zip(local.from_file_id.tolist(), local.to_file_id.tolist(), strict=True)))
        labels = files.sparkSession.createDataFrame(list(label.items()), "file_id long, label long")
    else:
        labels = spread_communities(files, edges)
    named = cut(labels.join(files.select(F.col("id").alias("file_id"), "path"), "file_id"), "labels")
    least = named.groupBy("label").agg(F.min("path").alias("least"))
    number = least.select("label", (F.row_number().over(Window.orderBy("least")) - 1).cast("long").alias("community_id"))  # one row a community
    return named.join(number, "label").select("file_id", "community_id")


def module_cycles(edges: list[tuple[str, str]]) -> list[list[str]]:
    """Cycles of the module graph that a depth-first walk in name order meets, one for each set of modules."""
    out_of: dict[str, list[str]] = defaultdict(list)
    for a, b in sorted(edges):
        out_of[a].append(b)
    state: dict[str, int] = {}
    seen, cycles = set(), []
    for root in sorted(out_of):
        if state.get(root):
            continue
        path, stack = [], [(root, iter(out_of[root]))]
        state[root] = 1
        path.append(root)
        while stack:
            at, it = stack[-1]
            for b in it:
                if state.get(b) == 1:
                    cycle = path[path.index(b) :]
                    if (key := tuple(sorted(cycle))) not in seen:
                        seen.add(key)
                        cycles.append(cycle)
                elif not state.get(b):
                    state[b] = 1
                    path.append(b)
                    stack.append((b, iter(out_of[b])))
                    break
            else:
                state[at] = 2
                path.pop()
                stack.pop()
    return cycles
