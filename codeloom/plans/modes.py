"""The query modes: one JSON-like request in, one envelope out."""

from __future__ import annotations

import ast
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import predicates as P
from codeloom.operators import graph as G
from codeloom.operators import lookups as L
from codeloom.operators import metrics as M
from codeloom.operators import patterns
from codeloom.operators.lineage import cut
from codeloom.plans import index, navmap, scan
from codeloom.schema import DECLARATIONS, ENTITY, Tables


class QueryError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def envelope(data, ok: bool = True, truncated: bool = False) -> dict:
    return {"ok": ok, "data": data, "meta": {"compact": False, "truncated": truncated}}


def failure(code: str, message: str) -> dict:
    return envelope({"error": {"code": code, "message": message}}, ok=False)


def need(q: dict, key: str):
    if key not in q:
        raise QueryError("invalid_input", f"missing {key}")
    return q[key]


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def names(df: DataFrame, column: str = "file") -> list:
    return [r[column] for r in df.collect()]


def file_of(t: Tables, path: str) -> DataFrame:
    hit = L.resolve_file(t.files, path)
    if hit.first() is None:
        raise QueryError("not_found", f"no file {path}")
    return hit


_SHOWN = ["id", "kind", "name", "file", "start_byte", "end_byte", "start_line", "start_col", "end_line", "end_col", "enclosing_function", "owner_type"]


def _files_of(t: Tables, paths: list[str]) -> dict[str, int | None]:
    """The id of the file that each path names, in one pass: itself, else the first in path order that ends in it."""
    asked = t.files.sparkSession.createDataFrame([(p,) for p in dict.fromkeys(paths)], "asked string")
    hit = (F.col("path") == F.col("asked")) | F.col("path").endswith(F.concat(F.lit("/"), "asked")) | F.col("path").endswith(F.concat(F.lit("\\"), "asked"))
    best = t.files.select("id", "path").join(F.broadcast(asked), hit).groupBy("asked").agg(F.min(F.struct((F.col("path") != F.col("asked")).alias("other"), "path", "id")).alias("x"))
    return dict.fromkeys(paths) | {r.asked: r.x.id for r in best.collect()}


def _symbols(t: Tables, ids: list[int], q: dict) -> dict[int, list[dict]]:
    """Declarations of files, then their symbols, by file."""
    at = F.broadcast(t.files.sparkSession.createDataFrame([(i,) for i in ids], "file_id long"))
    files = t.files.join(at.select(F.col("file_id").alias("id")), "id", "left_semi")
    entities = t.entities.filter(F.col("kind").isin(DECLARATIONS)).join(at, "file_id", "left_semi")
    out: dict[int, list[dict]] = {i: [] for i in ids}
    for r in L.with_path(entities, files).orderBy("id").select("file_id", *_SHOWN).collect():
        out[r.file_id].append({k: v for k, v in r.asDict().items() if k != "file_id"})
    if t.symbols is not None:
        kinds = [0, 1] if q.get("includeReferences") else [0]
        for r in L.with_path(t.symbols.filter(F.col("kind").isin(kinds)).join(at, "file_id", "left_semi"), files).orderBy("id").collect():
            out[r.file_id].append(r.asDict())
    if q.get("includeBody") and q.get("repoRoot"):
        for file_rows in out.values():
            for r in file_rows:
                with open(os.path.join(q["repoRoot"], r["file"]), "rb") as f:
                    r["body"] = f.read()[r["start_byte"] : r["end_byte"]].decode(errors="replace")
    return out


def _symbols_in_file(t: Tables, q: dict) -> list[dict]:
    at = file_of(t, need(q, "filePath")).first().id
    return _symbols(t, [at], q)[at]


def _symbols_in_files(t: Tables, q: dict) -> dict:
    """Rows of each path, or an error for it; as many jobs for many paths as for one."""
    found = _files_of(t, need(q, "filePaths"))
    by_file = _symbols(t, sorted({i for i in found.values() if i is not None}), q)
    return {p: by_file[i] if i is not None else {"error": {"code": "not_found", "message": f"no file {p}"}} for p, i in found.items()}


def _get_symbol(t: Tables, q: dict) -> dict:
    """A declaration, else a symbol: bindings before references."""
    at = file_of(t, q["filePath"]).first().id if q.get("filePath") else None
    found = rows(L.get_symbol(t.entities, t.files, need(q, "name"), at).select(*_SHOWN))
    if not found and t.symbols is not None:
        some = t.symbols.filter(F.col("name") == q["name"])
        found = rows(L.with_path(some if at is None else some.filter(F.col("file_id") == at), t.files).orderBy("kind", "id").limit(1))
    if not found:
        raise QueryError("not_found", f"no symbol {q['name']}")
    return found[0]


def _filter_symbols(t: Tables, q: dict) -> list[dict]:
    kind = ENTITY.get(q["kind"]) if q.get("kind") else None
    return rows(L.filter_symbols(t.entities, t.files, kind, q.get("file"), q.get("language"), q.get("minCyclomaticComplexity", 0), q.get("maxSymbols")).select(*_SHOWN))


def _first_named(t: Tables, name: str):
    hit = L.with_path(t.entities.filter(F.col("name") == name), t.files).orderBy("id").limit(1).first()
    if hit is None:
        raise QueryError("not_found", f"no symbol {name}")
    return hit


def _reach(t: Tables, q: dict, reverse: bool) -> list[str]:
    return names(L.paths_of(G.reachable(G.adjacency(t.resolved_edges, reverse), file_of(t, need(q, "filePath")), q.get("maxDepth")), t.files))


def _symbol_blast(t: Tables, q: dict) -> dict:
    hit = _first_named(t, need(q, "name"))
    at = t.files.filter(F.col("id") == hit.file_id).select("id")
    return {"declaring_file": hit.file, "blast_radius": names(L.paths_of(L.blast_radius(t.resolved_edges, at), t.files))}


def _hierarchy(t: Tables, q: dict) -> dict:
    """Super- and subtypes of a name; with filePath, among files of that file's language."""
    name, entities = need(q, "name"), t.entities
    if q.get("filePath"):
        lang = t.files.join(file_of(t, q["filePath"]).select("id"), "id", "left_semi").first().lang
        entities = entities.join(t.files.filter(F.col("lang").eqNullSafe(F.lit(lang))).select(F.col("id").alias("file_id")), "file_id", "left_semi")
    up, down = (rows(G.hierarchy(entities, name, w).orderBy("depth", "name")) for w in (True, False))
    return {"symbol": name, "supertypes": [r["name"] for r in up], "subtypes": [r["name"] for r in down], "hierarchy": {"up": up, "down": down}}


def _explore(t: Tables, q: dict) -> dict:
    p = q.get("query", {}).get("params", q)
    text, most = need(p, "input"), p.get("maxItems", 50)
    tiers = [("file", L.resolve_file(t.files, text).select("id")), ("symbol", t.entities.filter(F.col("name") == text).select(F.col("file_id").alias("id")).distinct())]
    if t.symbols is not None:
        tiers.append(("substring", t.symbols.filter(F.lower("name").like(f"%{text.lower()}%")).select(F.col("file_id").alias("id")).distinct()))
    for via, seeds in tiers:
        if seeds.limit(1).count():
            way = p.get("direction", "both")
            hit = L.blast_radius(t.resolved_edges, seeds) if way == "both" else G.reachable(G.adjacency(t.resolved_edges, way == "incoming"), seeds).select("id")
            return {"input": text, "resolvedVia": via, "seedFiles": names(L.paths_of(seeds, t.files)), "reachable": names(L.paths_of(hit, t.files))[:most]}
    raise QueryError("not_found", f"nothing matches {text}")


def _map_file(t: Tables, q: dict) -> dict:
    at = file_of(t, need(q, "filePath"))
    return rows(t.files.join(at.select("id"), "id", "left_semi").join(M.distinct_dependents(t.resolved_edges), "id", "left").fillna(0, ["dependents", "dependencies"]))[0]


def _map_path(t: Tables, q: dict) -> list[str]:
    a, b = (file_of(t, need(q, k)).first().id for k in ("sourceFile", "targetFile"))
    ids = G.shortest_path(t.resolved_edges, a, b, q.get("maxDepth"))
    at = dict((r.id, r.path) for r in t.files.filter(F.col("id").isin(ids)).select("id", "path").collect())
    return [at[i] for i in ids]


def _detect_changes(t: Tables, q: dict) -> list[dict]:
    """Symbols of changed files now against those stored. The files of a difference are parsed by the driver; what is
    stored of them comes in one job."""
    from codeloom.frontends import extract
    from codeloom.functions.predicates import EXTENSIONS
    from codeloom.sources.files import changed_files

    root, out = need(q, "repoRoot"), []
    changed = changed_files(root, q.get("diffMode", "working"), q.get("range"))
    asked = F.broadcast(t.files.sparkSession.createDataFrame([(p,) for _, p in changed], "path string"))
    stored: dict[str, dict] = {}
    for r in L.with_path(t.entities.filter("kind in (0, 1, 2)"), t.files.join(asked, "path", "left_semi")).orderBy("id").select("file", "name", "start_line", "end_line").collect():
        stored.setdefault(r.file, {}).setdefault(r.name, (r.start_line, r.end_line))
    for status, path in changed:
        lang, now = EXTENSIONS.get(path.rpartition(".")[2].lower()), {}
        full = os.path.join(root, path)
        if lang and os.path.isfile(full):
            with open(full, errors="replace") as f:
                for s in extract(lang, f.read())[0]:
                    if s["kind"] in (0, 1, 2):
                        now.setdefault(s["name"], (s["start_line"], s["end_line"]))
        was = stored.get(path, {})
        changes = [{"name": n, "change": "added" if n not in was else "removed" if n not in now else "modified"} for n in sorted(was.keys() | now.keys()) if was.get(n) != now.get(n)]
        out.append({"file": path, "status": status, "symbols": changes})
    return out


def _clusters(t: Tables, q: dict) -> list[dict]:
    """Communities by cohesion; with seedPath, the one of that file, with its members."""
    if q.get("seedPath"):
        seed = file_of(t, q["seedPath"]).select(F.col("id").alias("file_id"))
        own = t.community_members.join(t.community_members.join(seed, "file_id", "left_semi").select("community_id"), "community_id", "left_semi")
        found = rows(M.cluster_cohesion(t.community_members, t.resolved_edges, 1).join(own.select("community_id").distinct(), "community_id"))
        members = names(L.paths_of(own.select(F.col("file_id").alias("id")), t.files))
        return [r | {"members": members} for r in found]
    out = M.cluster_cohesion(t.community_members, t.resolved_edges, q.get("minSize", 2), q.get("minCohesion", 0.0))
    return rows(out.limit(q["maxClusters"]) if "maxClusters" in q else out)


def _context_pack(t: Tables, q: dict) -> dict:
    pack = rows(L.context_pack(t.files, t.entities, t.resolved_edges, need(q, "query")))
    asked = F.broadcast(t.files.sparkSession.createDataFrame([(r["file"],) for r in pack if not r["tier"]], "path string"))
    seeds = t.files.join(asked, "path", "left_semi").select("id")
    symbols = rows(L.named_symbols(t.entities, t.files, q["query"].split()).select("id", "kind", "name", "file", "start_line"))
    return {"files": pack, "symbols": symbols, "tests": names(L.tests_for_file(t.resolved_edges, t.files, seeds)), "readingOrder": [r["file"] for r in pack]}


def _find_pattern(t: Tables | None, q: dict) -> dict:
    """Files are read and searched by the executors; the shown matches come back, and how many there are."""
    from codeloom.sources.files import listing, with_contents

    spark = SparkSession.active()
    path = q.get("filePath") or q.get("file") or need(q, "path")
    if not os.path.exists(path):
        raise QueryError("not_found", f"no file {path}")
    listed = listing(spark, path)
    if os.path.isfile(path):
        listed = listed.withColumn("path", F.lit(os.path.abspath(path)))
    sources = with_contents(spark, path, listed).select("path", F.decode("content", "UTF-8").alias("text"))
    langs = F.udf(P.search_language, "string")  # a dictionary of endings, one call a file
    try:
        found = cut(patterns.search_all(sources.withColumn("lang", langs("path")), need(q, "pattern"), {k: q[k] for k in patterns.RELATIONS if k in q}, q.get("language")), "matches")
    except patterns.InvalidPattern as e:
        raise QueryError("invalid_pattern", str(e)) from e
    if found.filter("problem is not null").limit(1).count():
        raise QueryError("pattern_too_complex", f"more than {patterns.STEPS} steps")
    total = found.count()
    shown = rows(found.drop("problem").orderBy("file", "start_line", "start_col", F.desc("end_byte")).limit(patterns.SHOWN))
    return {"matches": shown, **({"guide": {"total": total, "shown": len(shown)}} if total > len(shown) else {})}


MODES: dict[str, Callable] = {
    "symbols_in_file": _symbols_in_file, "symbols_in_files": _symbols_in_files, "get_symbol": _get_symbol, "filter_symbols": _filter_symbols,
    "tests_for_file": lambda t, q: names(L.tests_for_file(t.resolved_edges, t.files, file_of(t, need(q, "filePath")))),
    "find_imports": lambda t, q: rows(L.find_imports(t.resolved_edges, t.files, file_of(t, need(q, "filePath")).first().id)),
    "dependencies": lambda t, q: _reach(t, q, q.get("direction") == "incoming"), "dependents": lambda t, q: _reach(t, q, True),
    "blast_radius": lambda t, q: names(L.paths_of(L.blast_radius(t.resolved_edges, file_of(t, need(q, "filePath"))), t.files)),
    "symbol_blast_radius": _symbol_blast, "type_hierarchy": _hierarchy, "explore": _explore, "map_file": _map_file,
    "map_symbol": lambda t, q: _first_named(t, need(q, "name")).asDict(recursive=True), "map_path": _map_path, "detect_changes": _detect_changes,
    "hotspots": lambda t, q: rows(M.hotspots(t.files)), "clusters": _clusters, "context_pack": _context_pack, "find_pattern": _find_pattern,
    "nav_map": lambda t, q: navmap.nav_map(t, q.get("maxTokensEstimate", 8000)),
}


def run_query(spark: SparkSession, q: dict, tables: Tables | None = None, memo: set | None = None) -> dict:
    """One request: mode, dbPath (the index folder) or tables, and the mode's own fields. With ensureFresh the index of
    repoRoot is brought up to date first, as far as the mode needs it; a batch does that once for each need."""
    mode = q.get("mode")
    try:
        if mode == "batch":
            shared = {k: v for k, v in q.items() if k in ("repoRoot", "dbPath", "ensureFresh")}
            calls, memo = need(q, "calls"), set()
            return envelope([failure("invalid_input", "batches don't nest") if c.get("mode") == "batch" else run_query(spark, shared | c, tables, memo) for c in calls])
        if q.get("ensureFresh") and tables is None and mode in MODES:
            index.ensure_fresh(spark, need(q, "repoRoot"), need(q, "dbPath"), index.NEEDS.get(mode, ()), memo)
        if mode == "index_counts":
            return envelope(index.counts(tables or index.load(spark, need(q, "dbPath"))))
        if mode == "slice_state":
            state = index.ledger(need(q, "dbPath"))
            return envelope(state) if state else failure("db_error", "no index there")
        if mode == "scan":
            t = tables or index.load(spark, need(q, "dbPath"))
            root = q.get("repoRoot")
            sources = index.sources_of(spark, root, t.files) if root else None
            packs = scan.load_packs(root, [q["rules"]] if "rules" in q else [])
            findings, payload = scan.scan(spark, t, sources, root, packs, q.get("apply", False), q.get("force", False))
            if "severityThreshold" in q:
                payload["exceeded"] = scan.reaches(findings, q["severityThreshold"])
            return envelope(payload)
        if mode == "rules":
            return envelope({"list": lambda: scan.list_packs(q.get("repoRoot")), "seed": lambda: scan.seed_packs(need(q, "repoRoot"), q.get("force", False)), "remove": lambda: scan.remove_packs(need(q, "repoRoot")), "test": lambda: scan.self_tests(spark, scan.load_packs(q.get("repoRoot")), q.get("limit", 100))}[q.get("do", "list")]())
        if mode not in MODES:
            return failure("unknown_mode", f"no mode {mode}")
        t = tables if tables is not None or mode == "find_pattern" else index.load(spark, need(q, "dbPath"))
        return envelope(MODES[mode](t, q))
    except QueryError as e:
        return failure(e.code, str(e))
    except (OSError, ast.ParseError if hasattr(ast, "ParseError") else SyntaxError) as e:
        return failure("file_error", str(e))
