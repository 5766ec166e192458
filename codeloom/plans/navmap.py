"""The orientation map: ranked sections of an index, trimmed to an estimate of tokens."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import predicates as P
from codeloom.functions.roles import MAINS, is_bootstrap, role_of
from codeloom.operators import graph as G
from codeloom.operators import metrics as M
from codeloom.operators.flows import flow_trees, size
from codeloom.operators.lineage import cut
from codeloom.operators.lookups import with_path
from codeloom.schema import ENTITY, Tables

#: (section, rows that it has at most), in order of importance; tokens that each may have before that order counts.
RESERVE = 200
PRIORITY = [("entrypoints", 40), ("foundational", 25), ("subsystems", 20), ("flows", 5), ("symbols", 40), ("hotspots", 25), ("module_edges", 50), ("cycles", 20)]
#: Entry points that a map looks at, at most.
ENTRYPOINTS = 1000


def estimate(value) -> int:
    return len(json.dumps(value)) // 4


CONSTRUCTORS = ["constructor", "__init__", "__new__", "init", "initialize"]
#: Calls out, without one in, from which a declaration is taken for a process's start.
FAN_OUT = 2
#: A flow's summary: how deep it goes, and how many nodes it has at most.
SUMMARY_DEPTH, SUMMARY_NODES = 4, 30


def signals(entities: DataFrame, kinds: list[int], column: str) -> DataFrame:
    """(file_id, name, column): names of rows of these kinds for the declaration that they stand at, in order."""
    rows = entities.filter(F.col("kind").isin(kinds) & F.col("enclosing_function").isNotNull())
    listed = rows.groupBy("file_id", F.col("enclosing_function").alias("name")).agg(F.sort_array(F.collect_set(F.struct("id", F.col("name").alias("n")))).alias("all"))
    return listed.select("file_id", "name", F.transform("all", lambda x: x["n"]).alias(column))


def roles(t: Tables) -> DataFrame:
    """(id, file_id, file, name, kind, owner_type, role) of functions and classes outside tests with a role tag."""
    shown = t.files.filter("not is_test_path").filter(~P.is_noise_path(F.col("path"))).select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    rows = t.entities.filter("kind in (0, 1)").select("id", "file_id", "name", "kind", "owner_type").join(shown, "file_id")
    none = F.array().cast("array<string>")
    rows = rows.join(signals(t.entities, [17], "decorators"), ["file_id", "name"], "left").join(signals(t.entities, [15, 16], "bases"), ["file_id", "name"], "left")
    bases = F.when(F.col("kind") == 1, F.coalesce("bases", none)).otherwise(none)
    return rows.withColumn("role", role_of(F.coalesce("decorators", none), bases, F.col("file"))).filter("role is not null").drop("decorators", "bases")


def call_fans(edges: DataFrame) -> DataFrame:
    """(entity, out, in) over resolved calls, both ends in one aggregation."""
    calls = edges.filter("kind = 0 and resolved and from_entity_id is not null and to_entity_id is not null")
    ends = calls.select(F.explode(F.array(F.struct(F.col("from_entity_id").alias("entity"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_entity_id").alias("entity"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    return ends.groupBy("entity").agg(F.sum("o").alias("out"), F.sum("i").alias("in"))


def routes(t: Tables) -> DataFrame:
    """(file, symbol, role, id) of routes that calls register: the handler in the same file, else the only function of
    its name; one row a file and symbol."""
    rows = t.entities.filter((F.col("kind") == ENTITY["route"]) & F.col("path").isNotNull()).select(F.col("id").alias("route"), "file_id", F.when(F.col("status") == "handler", F.col("name")).alias("handler"), F.concat_ws(" ", "method", "path").alias("symbol"))
    shown = t.files.filter("not is_test_path").filter(~P.is_noise_path(F.col("path"))).select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    fns = t.entities.filter("kind = 0").select(F.col("name").alias("handler"), F.col("file_id").alias("at"), F.col("id").alias("fn"))
    near = rows.join(fns, (rows.handler == fns.handler) & (rows.file_id == fns["at"])).groupBy("route").agg(F.min("fn").alias("near"))
    only = fns.groupBy("handler").agg(F.countDistinct("fn").alias("n"), F.min("fn").alias("far")).filter("n = 1").select("handler", "far")
    found = rows.join(shown, "file_id").join(near, "route", "left").join(only, "handler", "left").withColumn("id", F.coalesce("near", "far"))
    return found.groupBy("file", "symbol").agg(F.min("id").alias("id")).select("file", "symbol", F.lit("route_handler").alias("role"), "id")


def entry_rows(t: Tables) -> DataFrame:
    """(file, symbol, role, id): process mains, declarations with a role tag, and routes that calls register.

    Left out: constructors, classes without methods, files that start a process and declarations that call FAN_OUT
    others and are called by none, unless a decorator makes them routes; a route's symbol is its verb and path, with
    what its class puts before.
    """
    files = t.files.filter("not is_test_path").filter(~P.is_noise_path(F.col("path"))).select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    mains = t.entities.filter(F.col("name").isin(MAINS) & F.col("owner_type").isNull() & (F.col("kind") == 0)).join(files, "file_id").select("file", F.col("name").alias("symbol"), F.lit("process_main").alias("role"), "id")
    tagged = roles(t).filter(~F.col("name").isin(CONSTRUCTORS) & ~F.col("name").eqNullSafe(F.col("owner_type")) & ~is_bootstrap(F.col("file")))
    owners = t.entities.filter("kind = 0 and owner_type is not null").select("file_id", F.col("owner_type").alias("name"), F.lit(True).alias("has_methods")).distinct()
    tagged = tagged.join(owners, ["file_id", "name"], "left").filter("kind = 0 or has_methods")
    if "method" in t.entities.columns:
        marks = t.entities.filter("kind = 17 and path is not null").groupBy("file_id", F.col("enclosing_function").alias("name")).agg(F.min(F.struct("id", "method", "path")).alias("m"))
        first = marks.select("file_id", "name", F.col("m.method").alias("verb"), F.col("m.path").alias("route"))
        prefix = marks.select("file_id", F.col("name").alias("owner_type"), F.col("m.path").alias("prefix"))
        tagged = tagged.join(first, ["file_id", "name"], "left").join(prefix, ["file_id", "owner_type"], "left")
        whole = F.regexp_replace(F.concat_ws("/", F.when(F.col("prefix").isNotNull(), F.regexp_replace("prefix", "/+$", "")), F.when(F.col("route").isNotNull(), F.regexp_replace("route", "^/+", ""))), "^(?!/)", "/")
        symbol = F.when(F.col("verb").isNotNull(), F.concat_ws(" ", "verb", whole)).otherwise(F.concat_ws(".", "owner_type", "name"))
    else:
        tagged, symbol = tagged.withColumn("verb", F.lit(None).cast("string")), F.concat_ws(".", "owner_type", "name")
    fans = call_fans(t.resolved_edges)
    tagged = tagged.join(fans, tagged.id == fans.entity, "left").filter(F.col("verb").isNotNull() | ~((F.coalesce("out", F.lit(0)) >= FAN_OUT) & (F.coalesce("in", F.lit(0)) == 0)))
    out = mains.unionByName(tagged.select("file", symbol.alias("symbol"), "role", "id"))
    if "method" in t.entities.columns:
        out = out.unionByName(routes(t))
    return out.groupBy("file", "symbol").agg(F.min(F.struct("role", "id")).alias("x")).select("file", "symbol", "x.role", "x.id")


def entrypoints(t: Tables) -> list[dict]:
    return [r.asDict() for r in entry_rows(t).orderBy("file", "symbol").collect()]


def subsystem_names(t: Tables, tags: DataFrame | None = None) -> DataFrame:
    """(community_id, name, size) of communities of two files or more, generated ones apart: the folder that holds two
    thirds of them, else the role tag that as many carry, else the folder that holds most, else cluster. Names that
    several have get the stem of their first file, then their number."""
    paths = t.files.filter(~P.is_generated_path(F.col("path"))).select(F.col("id").alias("file_id"), "path", F.regexp_extract("path", "^(.*)/", 1).alias("folder"))
    rows = t.community_members.join(paths, "file_id")
    if tags is not None:
        per_file = tags.groupBy("file_id", "role").agg(F.count(F.lit(1)).alias("n")).groupBy("file_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "role")).alias("r")).select("file_id", "r.role")
        rows = rows.join(per_file, "file_id", "left")
    else:
        rows = rows.withColumn("role", F.lit(None).cast("string"))

    def most(column: str) -> DataFrame:
        counted = rows.filter(F.col(column).isNotNull()).groupBy("community_id", column).agg(F.count(F.lit(1)).alias("n"))
        return counted.groupBy("community_id").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(column).alias("name"))).alias(f"top_{column}"))

    sizes = rows.groupBy("community_id").agg(F.count(F.lit(1)).alias("size"), F.min("path").alias("first"))
    named = sizes.filter("size > 1").join(most("folder"), "community_id", "left").join(most("role"), "community_id", "left")
    share = lambda c: -F.col(f"top_{c}.n") * 3 >= F.col("size") * 2
    tail = F.element_at(F.split("top_folder.name", "/"), -1)
    folder = F.when(F.col("top_folder.name") != "", tail)
    name = F.coalesce(F.when(share("folder"), folder), F.when(share("role"), F.concat("top_role.name", F.lit("s"))), folder, F.lit("cluster"))
    stem = F.element_at(F.split(F.element_at(F.split("first", "/"), -1), r"\."), 1)
    named = named.select("community_id", "size", name.alias("name"), stem.alias("stem"))
    for qualified in (F.when((F.col("stem") != "") & (F.col("stem") != F.col("name")), F.concat_ws("/", "name", "stem")).otherwise(F.col("name")), F.concat(F.col("name"), F.lit(" #"), F.col("community_id").cast("string"))):
        shared = named.groupBy("name").agg((F.count(F.lit(1)) > 1).alias("shared"))
        named = named.join(shared, "name").withColumn("name", F.when(F.col("shared"), qualified).otherwise(F.col("name"))).drop("shared")
    return named.select("community_id", "name", "size").orderBy(F.desc("size"), "name", "community_id")


def summary(node: dict, names: dict[int, tuple[str, str]], depth: int = 0, left: list[int] | None = None) -> dict:
    """A call tree as far as SUMMARY_DEPTH and SUMMARY_NODES go; repeated references to one function are one node."""
    left = [SUMMARY_NODES - 1] if left is None else left
    name, file = names.get(node.get("id", node.get("ref")), ("", ""))
    out: dict = {"symbol": name, "file": file}
    if "ref" in node:
        return out | {"recurses": True}
    distinct: list[list] = []
    where: dict[int, list] = {}
    for c in node["calls"]:
        if "ref" in c and c["ref"] in where:
            where[c["ref"]][1] += 1
            continue
        distinct.append([c, 1])
        if "ref" in c:
            where[c["ref"]] = distinct[-1]
    if not distinct:
        return out
    if depth + 1 >= SUMMARY_DEPTH:
        return out | {"childrenOmitted": len(distinct)}
    shown = []
    for c, times in distinct:
        if not left[0]:
            break
        left[0] -= 1
        shown.append(summary(c, names, depth + 1, left) | ({"recursesCount": times} if times > 1 else {}))
    return out | ({"childrenOmitted": len(distinct) - len(shown)} if len(shown) < len(distinct) else {}) | {"children": shown}


def flows(t: Tables, found: DataFrame, most: int = 25) -> list[dict]:
    """Summaries of the call trees of entry points (file, symbol, id), the largest first, each file and symbol once."""
    starts = found.filter("id is not null").select("id", "file", "symbol")
    named = {r.id: (r.file, r.symbol) for r in starts.orderBy("id").collect()}
    trees = flow_trees(t.files, t.entities, t.resolved_edges, starts.select("id"))
    once: dict[tuple[str, str], dict] = {}
    for tree in trees:
        if tree["calls"]:
            once.setdefault(named[tree["id"]], tree)
    shown = list(once.items())[:most]
    wanted, stack = set(), [tree for _, tree in shown]
    while stack:
        node = stack.pop()
        wanted.add(node.get("id", node.get("ref")))
        stack += node.get("calls", [])
    names = {r.id: (r.name, r.file) for r in with_path(t.entities.join(F.broadcast(t.entities.sparkSession.createDataFrame([(i,) for i in sorted(wanted)], "id long")), "id", "left_semi"), t.files).select("id", "name", "file").collect()} if wanted else {}
    return [{"entrypoint": symbol, "file": file, "nodeCount": size(tree), "root": summary(tree, names)} for (file, symbol), tree in shown]


def trim(sections: dict[str, list], budget: int) -> tuple[dict[str, list], dict]:
    """Rows from the beginning of each section: first what RESERVE tokens (or an even share of a small budget) hold of
    each, then, in order of importance, more of them up to the section's number, while the budget lasts."""
    share = min(RESERVE, budget // max(1, len(PRIORITY)))
    sizes = {name: [estimate(x) + 1 for x in sections.get(name, [])] for name, _ in PRIORITY}
    taken, cost = dict.fromkeys(sizes, 0), 0
    for name, most in PRIORITY:
        left = share
        while taken[name] < min(most, len(sizes[name])) and sizes[name][taken[name]] <= left:
            left -= sizes[name][taken[name]]
            cost += sizes[name][taken[name]]
            taken[name] += 1
    for name, most in PRIORITY:
        while taken[name] < min(most, len(sizes[name])) and cost + sizes[name][taken[name]] <= budget:
            cost += sizes[name][taken[name]]
            taken[name] += 1
    dropped = {name: len(sizes[name]) - n for name, n in taken.items() if n < len(sizes[name])}
    return {name: sections.get(name, [])[:n] for name, n in taken.items()}, {"truncated": bool(dropped), "dropped": dropped, "estimate": cost}


def nav_map(t: Tables, budget: int = 8000) -> dict:
    edges = [r.asDict() for r in M.module_edges(t.files, t.resolved_edges).orderBy(F.desc("crossings"), "from_module", "to_module").collect()]
    found = cut(entry_rows(t), "entrypoints")
    tags = cut(roles(t), "roles")
    sections = {
        "entrypoints": [r.asDict() for r in found.drop("id").orderBy("file", "symbol").limit(ENTRYPOINTS).collect()],
        "foundational": [r.asDict() for r in M.foundational_files(t.files, t.entities, t.resolved_edges).collect()],
        "subsystems": [r.asDict() for r in subsystem_names(t, tags).collect()],
        "flows": flows(t, found),
        "symbols": [r.asDict() for r in M.symbol_breadth(t.files, t.entities, t.resolved_edges).collect()],
        "hotspots": [r.asDict() for r in M.hotspots(t.files, 50).collect()],
        "module_edges": edges,
        "cycles": G.module_cycles([(e["from_module"], e["to_module"]) for e in edges]),
    }
    out, guide = trim(sections, budget)
    return {**out, "guide": guide}


def as_text(data: dict) -> str:
    """The map as plain lines, a section after the other."""

    def tree(node: dict, depth: int) -> list[str]:
        more = " (again)" if node.get("recurses") else ""
        times = f" x{node['recursesCount']}" if "recursesCount" in node else ""
        lines = [f"{'  ' * depth}{node['symbol']}{more}{times}"]
        for c in node.get("children", []):
            lines += tree(c, depth + 1)
        return lines + ([f"{'  ' * (depth + 1)}... {node['childrenOmitted']} more"] if "childrenOmitted" in node else [])

    shapes = {
        "entrypoints": lambda x: [f"{x['role']}: {x['symbol']} ({x['file']})"], "foundational": lambda x: [f"{x['file']}: {x['dependents']} dependents"], "subsystems": lambda x: [f"{x['name']}: {x['size']} files"],
        "flows": lambda x: [f"{x['entrypoint']} ({x['file']}), {x['nodeCount']} calls", *tree(x["root"], 1)], "symbols": lambda x: [f"{x['name']} ({x['file']}): called from {x['breadth']} files, {x['total']} times"],
        "hotspots": lambda x: [f"{x['file']}: complexity {x['complexity']}, churn {x['churn']}"], "module_edges": lambda x: [f"{x['from_module']} -> {x['to_module']}: {x['crossings']}"], "cycles": lambda x: [" -> ".join([*x, x[0]])],
    }
    out = []
    for name, _ in PRIORITY:
        if data.get(name):
            out += [name.replace("_", " ").upper(), *(f"  {line}" for x in data[name] for line in shapes[name](x)), ""]
    if (guide := data.get("guide", {})).get("truncated"):
        out.append("Left out: " + ", ".join(f"{n} of {k.replace('_', ' ')}" for k, n in guide["dropped"].items()))
    return "\n".join(out).rstrip()
