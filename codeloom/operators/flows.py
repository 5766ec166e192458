"""Call trees from entry points over resolved calls."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import predicates as P
from codeloom.operators.graph import reachable
from codeloom.schema import ENTITY

DEPTH = 1000


def call_pairs(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(caller, callee) of functions: a call site belongs to the function of its file with its enclosing name and owner,
    where no owner equals no owner; the first such function counts."""
    sites = entities.filter(F.col("kind") == ENTITY["call"]).select(F.col("id").alias("site"), "file_id", F.col("enclosing_function").alias("fn"), F.col("owner_type").alias("owner"))
    fns = entities.filter(F.col("kind") == ENTITY["function"]).groupBy("file_id", F.col("name").alias("fn"), F.col("owner_type").alias("owner2")).agg(F.min("id").alias("caller"))
    inside = sites.join(fns, ["file_id", "fn"]).filter(F.col("owner").eqNullSafe(F.col("owner2"))).select("site", "caller")
    calls = edges.filter("kind = 0 and resolved and to_entity_id is not null").select(F.col("from_entity_id").alias("site"), F.col("to_entity_id").alias("callee"), "id")
    return inside.join(calls, "site").groupBy("caller", "callee").agg(F.min("id").alias("first"))


def tree(root: int, callees: dict[int, list[int]], skipped: set[int] = frozenset(), depth: int = DEPTH) -> dict:
    """The calls below root in order: {id, calls}; a function that stands elsewhere in the tree is {ref} only, one on
    the way to itself is left out."""
    top: dict = {"id": root, "calls": []}
    shown, path = {root}, [root]
    stack = [(top, iter(callees.get(root, ())))]
    while stack:
        node, it = stack[-1]
        for c in it:
            if c in path or c in skipped:
                continue
            if c in shown:
                node["calls"].append({"ref": c})
                continue
            child: dict = {"id": c, "calls": []}
            node["calls"].append(child)
            if len(path) < depth:
                shown.add(c)
                path.append(c)
                stack.append((child, iter(callees.get(c, ()))))
                break
        else:
            stack.pop()
            path.pop()
    return top


def size(node: dict) -> int:
    n, stack = 0, [node]
    while stack:
        at = stack.pop()
        n += 1
        stack += at.get("calls", ())
    return n


def flow_trees(files: DataFrame, entities: DataFrame, edges: DataFrame, roots: DataFrame) -> list[dict]:
    """Trees of roots (id), the largest first. Only calls that the roots reach come to the driver."""
    pairs = call_pairs(entities, edges)
    starts = sorted(r.id for r in roots.select("id").distinct().collect())
    found = reachable(pairs.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), roots.select("id"))
    within = found.select("id").union(roots.select("id")).distinct()
    callees: dict[int, list[int]] = defaultdict(list)
    for r in pairs.join(within, pairs.caller == within.id, "left_semi").orderBy("caller", "first").collect():
        callees[r.caller].append(r.callee)
    generated = {r.id for r in entities.join(within, "id", "left_semi").join(files.filter(P.is_generated_path(F.col("path"))).select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id").collect()}
    return sorted((tree(s, callees, generated) for s in starts), key=lambda t: (-size(t), t["id"]))
