"""The registered queries of the code-graph engine over the projection, and the SQL that DuckDB checks them with."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import predicates as P
from codeloom.functions.hashing import fnv1a_column, with_minhash
from codeloom.operators import flows as W
from codeloom.operators import graph as G
from codeloom.operators import lookups as L
from codeloom.operators import metrics as M
from codeloom.operators import resolve as S
from codeloom.operators import rules as R
from codeloom.operators.lineage import cut
from codeloom.plans.projection import like_sql, oracle_prefix, tables
from codeloom.schema import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The file with most outgoing references, which the traversals start from.
_SEED = "seed AS (SELECT from_file_id AS id FROM resolved_edges WHERE resolved GROUP BY from_file_id ORDER BY count(*) DESC, from_file_id LIMIT 1)"
_SINK = "sink AS (SELECT to_file_id AS id FROM resolved_edges WHERE resolved GROUP BY to_file_id ORDER BY count(*) DESC, to_file_id LIMIT 1)"


def query(name: str, ctes: str = "", sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(tables(spark, sf_dir))
        if sql:
            ORACLE[name] = oracle_prefix() + (f", {ctes} " if ctes else "") + sql
        return f

    return register


def seed(t: Tables, column: str = "from_file_id") -> DataFrame:
    return t.resolved_edges.filter("resolved").groupBy(F.col(column).alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")


_GENERATED = (
    "(len(list_intersect(string_split(path, '/'), ['" + "', '".join(P.EXCLUDED_DIRS) + "'])) > 0 OR "
    + " OR ".join([f"contains('/' || path, '/{x}/')" for x in P.EXCLUDED_SEQUENCES] + [f"suffix(path, '{x}')" for x in P.GENERATED_SUFFIXES]) + ")"
)
_NOISE = (
    f"({_GENERATED} OR (list_contains(string_split(path, '/'), 'assets') "
    f"AND lower(regexp_extract(path, '[.]([^./]+)$', 1)) IN ('{"', '".join(P.ASSET_EXTENSIONS)}')) OR len(list_intersect(string_split(path, '/'), ['templates', 'template'])) > 0 OR lang IS NULL)"
)
_SHOWN = f"(NOT is_test_path AND NOT {_GENERATED} AND lang IS NOT NULL)"


@query("hotspots", f"kept AS (SELECT * FROM files WHERE {_SHOWN})", "SELECT path AS file, complexity, churn, CASE WHEN (SELECT count(DISTINCT churn) FROM kept) > 1 THEN complexity * churn ELSE complexity END AS score FROM kept")
def hotspots(t: Tables) -> DataFrame:
    return M.hotspots(t.files)


@query("fan_metrics", "", "SELECT id, fan_in, fan_out FROM files")
def fan_metrics(t: Tables) -> DataFrame:
    return M.fan_metrics(t.files, t.resolved_edges)


_PAIRS = "pairs AS (SELECT DISTINCT from_file_id AS a, to_file_id AS b FROM resolved_edges WHERE resolved)"
_DD = _PAIRS + (
    ", dd AS (SELECT id, CAST(sum(i) AS BIGINT) AS dependents, CAST(sum(o) AS BIGINT) AS dependencies "
    "FROM (SELECT b AS id, 1 AS i, 0 AS o FROM pairs WHERE a <> b UNION ALL SELECT a, 0, 1 FROM pairs WHERE a <> b) GROUP BY id)"
)


@query("distinct_dependents", _DD, "SELECT * FROM dd")
def distinct_dependents(t: Tables) -> DataFrame:
    return M.distinct_dependents(t.resolved_edges)


@query(
    "foundational_files",
    _DD + ", trivial AS (SELECT file_id AS id, bool_and(regexp_matches(name, '^(get|set|is|has)($|_|[A-Z])')) AS t FROM entities WHERE kind = 0 GROUP BY file_id)",
    (
        f"SELECT path AS file, dependents, fan_in, coalesce(t, false) AS data_class FROM files JOIN dd USING (id) LEFT "
        f"JOIN trivial USING (id) WHERE NOT is_test_path AND NOT {_NOISE} AND dependents > 0 "
        f"ORDER BY data_class, dependents DESC, fan_in DESC, file LIMIT 50"
    ),
)
def foundational_files(t: Tables) -> DataFrame:
    return M.foundational_files(t.files, t.entities, t.resolved_edges)


@query("symbol_breadth", "c AS (SELECT to_entity_id AS id, count(DISTINCT from_file_id) AS breadth, count(*) AS total FROM resolved_edges WHERE resolved AND kind = 0 GROUP BY to_entity_id)", (
    "SELECT id, e.name, f.path AS file, breadth, total FROM c JOIN entities e USING (id) JOIN files f ON f.id = e.file_id "
    "WHERE NOT is_test_path AND NOT regexp_matches(e.name, '^(get|set|is|has)($|_|[A-Z])') "
    "ORDER BY breadth DESC, total DESC, file, name, id LIMIT 100"
))
def symbol_breadth(t: Tables) -> DataFrame:
    return M.symbol_breadth(t.files, t.entities, t.resolved_edges)


def _reach(way: str, depth: int | None = None, kinds: str = "") -> str:
    a, b = ("a", "b") if way == "out" else ("b", "a")
    most = depth or 100
    return f"reach_{way} AS (SELECT id, 0 AS depth FROM seed UNION SELECT p.{b}, r.depth + 1 FROM reach_{way} r JOIN pairs p ON p.{a} = r.id WHERE r.depth < {most})"


@query("dependencies_depth2", f"{_PAIRS}, {_SEED}, {_reach('out', 2)}", "SELECT r.id, min(r.depth) AS depth FROM reach_out r WHERE r.id NOT IN (SELECT id FROM seed) GROUP BY r.id")
def dependencies_depth2(t: Tables) -> DataFrame:
    return G.reachable(G.adjacency(t.resolved_edges), seed(t), 2)


# Distinct ids only, so that cycles end.
_CLOSURE = "{n} AS (SELECT id FROM {s} UNION SELECT p.{b} FROM {n} r JOIN {p} p ON p.{a} = r.id)"
_OUT, _IN = _CLOSURE.format(n="outs", s="seed", p="pairs", a="a", b="b"), _CLOSURE.format(n="ins", s="sink", p="pairs", a="b", b="a")


@query("dependencies", f"{_PAIRS}, {_SEED}, {_OUT}", "SELECT path AS file FROM outs JOIN files USING (id) WHERE id NOT IN (SELECT id FROM seed)")
def dependencies(t: Tables) -> DataFrame:
    return L.paths_of(G.reachable(G.adjacency(t.resolved_edges), seed(t)), t.files)


@query("dependents", f"{_PAIRS}, {_SINK}, {_IN}", "SELECT path AS file FROM ins JOIN files USING (id) WHERE id NOT IN (SELECT id FROM sink)")
def dependents(t: Tables) -> DataFrame:
    return L.paths_of(G.reachable(G.adjacency(t.resolved_edges, reverse=True), seed(t, "to_file_id")), t.files)


@query("blast_radius", f"{_PAIRS}, {_SINK}, {_IN}, {_CLOSURE.format(n='outs', s='sink', p='pairs', a='a', b='b')}", "SELECT path AS file FROM (SELECT id FROM ins UNION SELECT id FROM outs) JOIN files USING (id) WHERE id NOT IN (SELECT id FROM sink)")
def blast_radius(t: Tables) -> DataFrame:
    return L.paths_of(L.blast_radius(t.resolved_edges, seed(t, "to_file_id")), t.files)


_NAMED = "named AS (SELECT e.id, e.file_id FROM entities e WHERE e.name = 'fn3' ORDER BY e.id LIMIT 1), sink AS (SELECT file_id AS id FROM named)"


@query("symbol_blast_radius", f"{_PAIRS}, {_NAMED}, {_IN}, {_CLOSURE.format(n='outs', s='sink', p='pairs', a='a', b='b')}", "SELECT path AS file FROM (SELECT id FROM ins UNION SELECT id FROM outs) JOIN files USING (id) WHERE id NOT IN (SELECT id FROM sink)")
def symbol_blast_radius(t: Tables) -> DataFrame:
    at = t.entities.filter("name = 'fn3'").orderBy("id").limit(1).select(F.col("file_id").alias("id"))
    return L.paths_of(L.blast_radius(t.resolved_edges, at), t.files)


@query("tests_for_file", f"pairs AS (SELECT DISTINCT from_file_id AS a, to_file_id AS b FROM resolved_edges WHERE resolved AND kind = 1), {_SINK}, {_IN}", "SELECT path AS file FROM ins JOIN files USING (id) WHERE is_test_path AND id NOT IN (SELECT id FROM sink)")
def tests_for_file(t: Tables) -> DataFrame:
    return L.tests_for_file(t.resolved_edges, t.files, seed(t, "to_file_id"))


@query("explore_both", f"{_PAIRS}, sink AS (SELECT DISTINCT file_id AS id FROM entities WHERE kind IN (0, 1, 2) AND name = 'T5'), {_IN}, {_CLOSURE.format(n='outs', s='sink', p='pairs', a='a', b='b')}", "SELECT path AS file FROM (SELECT id FROM ins UNION SELECT id FROM outs) JOIN files USING (id) WHERE id NOT IN (SELECT id FROM sink) ORDER BY file LIMIT 100")
def explore_both(t: Tables) -> DataFrame:
    seeds = t.entities.filter("kind in (0, 1, 2) and name = 'T5'").select(F.col("file_id").alias("id")).distinct()
    return L.paths_of(L.blast_radius(t.resolved_edges, seeds).join(seeds, "id", "left_anti"), t.files).limit(100)


@query("map_path_length", f"{_PAIRS}, {_SEED}, {_reach('out', 12)}", "SELECT CAST(max(d) AS INT) AS longest, count(*) AS reached FROM (SELECT id, min(depth) AS d FROM reach_out GROUP BY id) WHERE id NOT IN (SELECT id FROM seed)")
def map_path_length(t: Tables) -> DataFrame:
    return G.reachable(G.adjacency(t.resolved_edges), seed(t), 12).agg(F.max("depth").alias("longest"), F.count(F.lit(1)).alias("reached"))


def _types(a: str, b: str, start: str) -> str:
    return f"ext AS (SELECT DISTINCT {a} AS x, {b} AS y FROM entities WHERE kind IN (15, 16)), up AS (SELECT '{start}' AS name UNION SELECT y FROM up JOIN ext ON x = up.name)"


@query("type_hierarchy_up", _types("enclosing_function", "name", "T9"), "SELECT name FROM up WHERE name <> 'T9' AND name IS NOT NULL")
def type_hierarchy_up(t: Tables) -> DataFrame:
    return G.hierarchy(t.entities, "T9").select("name")


@query("type_hierarchy_down", _types("name", "enclosing_function", "T9"), "SELECT name FROM up WHERE name <> 'T9' AND name IS NOT NULL")
def type_hierarchy_down(t: Tables) -> DataFrame:
    return G.hierarchy(t.entities, "T9", up=False).select("name")


@query("find_imports", f"{_SEED}", "SELECT e.id, coalesce(f.path, '') AS \"to\", resolved, to_file_id FROM resolved_edges e LEFT JOIN files f ON f.id = e.to_file_id WHERE kind = 1 AND from_file_id IN (SELECT id FROM seed)")
def find_imports(t: Tables) -> DataFrame:
    return L.find_imports(t.resolved_edges, t.files, seed(t).first().id)


@query("filter_symbols", "", "SELECT e.id, e.kind, e.name, f.path AS file FROM entities e JOIN files f ON f.id = e.file_id WHERE e.kind = 0 AND f.lang = 'typescript' AND f.complexity >= 8")
def filter_symbols(t: Tables) -> DataFrame:
    return L.filter_symbols(t.entities, t.files, kind=0, lang="typescript", min_complexity=8).select("id", "kind", "name", "file")


@query("get_symbol", "", (
    "SELECT e.id, e.kind, e.name, f.path AS file FROM entities e JOIN files f ON f.id = e.file_id WHERE e.name = 'T7' "
    "AND e.kind IN (0, 1, 2, 3, 4) ORDER BY CASE WHEN e.kind IN (1, 2) THEN 0 ELSE 1 END, e.id LIMIT 1"
))
def get_symbol(t: Tables) -> DataFrame:
    return L.get_symbol(t.entities, t.files, "T7").select("id", "kind", "name", "file")


@query("map_symbol", "", "SELECT e.id, e.kind, e.name, f.path AS file FROM entities e JOIN files f ON f.id = e.file_id WHERE e.name = 'T7' ORDER BY e.id LIMIT 1")
def map_symbol(t: Tables) -> DataFrame:
    return L.with_path(t.entities.filter("name = 'T7'").orderBy("id").limit(1), t.files).select("id", "kind", "name", "file")


@query("symbols_in_files", "chosen AS (SELECT id FROM files WHERE path LIKE '%/brand2%' OR path LIKE '%1.py')", "SELECT e.id, e.kind, e.name, f.path AS file FROM entities e JOIN files f ON f.id = e.file_id WHERE e.kind IN (0, 1, 2, 3, 4) AND f.id IN (SELECT id FROM chosen)")
def symbols_in_files(t: Tables) -> DataFrame:
    some = t.files.filter("path like '%/brand2%' or path like '%1.py'").select("id")
    return L.symbols_in_files(t.entities, t.files, some).select("id", "kind", "name", "file")


@query("map_file", f"{_DD}", "SELECT f.path AS file, complexity, churn, community_id, coalesce(dependents, 0) AS dependents, coalesce(dependencies, 0) AS dependencies FROM files f LEFT JOIN dd USING (id)")
def map_file(t: Tables) -> DataFrame:
    return t.files.join(M.distinct_dependents(t.resolved_edges), "id", "left").fillna(0, ["dependents", "dependencies"]).select(F.col("path").alias("file"), "complexity", "churn", "community_id", "dependents", "dependencies")


@query("context_pack", (
    f"{_PAIRS}, seeds AS (SELECT id FROM files WHERE path ILIKE '%part_77%' UNION SELECT file_id FROM entities "
    f"WHERE kind IN (0, 1, 2, 3, 4) AND name ILIKE '%T63%'), near AS (SELECT DISTINCT x AS id FROM (SELECT b AS x, a AS y FROM pairs "
    f"UNION ALL SELECT a, b FROM pairs) WHERE y IN (SELECT id FROM seeds) AND x NOT IN (SELECT id FROM seeds))"
), "SELECT path AS file, tier, complexity + churn AS weight FROM (SELECT id, 0 AS tier FROM seeds UNION ALL SELECT id, 1 FROM near) JOIN files USING (id)")
def context_pack(t: Tables) -> DataFrame:
    return L.context_pack(t.files, t.entities, t.resolved_edges, "part_77 T63")


@query("module_layers", f"{_PAIRS}, m AS (SELECT id, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS module FROM files)", "SELECT x.module AS from_module, y.module AS to_module, count(*) AS crossings FROM pairs JOIN m x ON x.id = a JOIN m y ON y.id = b WHERE x.module <> y.module GROUP BY 1, 2 HAVING count(*) >= 3")
def module_layers(t: Tables) -> DataFrame:
    return M.module_edges(t.files, t.resolved_edges)


@query(
    "cluster_cohesion",
    (
        "side AS (SELECT x.community_id AS a, y.community_id AS b FROM resolved_edges e JOIN files x ON x.id = e.from_file_id "
        "JOIN files y ON y.id = e.to_file_id WHERE resolved), n AS (SELECT community_id, count(*) AS size FROM files GROUP BY 1), "
        "t AS (SELECT n.community_id, CAST(sum(CASE WHEN a = n.community_id AND b = n.community_id THEN 1 "
        "ELSE 0 END) AS BIGINT) AS i, CAST(sum(CASE WHEN a = n.community_id AND b = n.community_id THEN 0 ELSE 1 END) AS BIGINT) AS e "
        "FROM n JOIN side ON a = n.community_id OR b = n.community_id GROUP BY 1)"
    ),
    (
        "SELECT community_id, size, coalesce(i, 0) AS internal, coalesce(e, 0) AS external, CASE WHEN i + e > 0 THEN i / (i + e) "
        "ELSE 0.0 END AS cohesion FROM n LEFT JOIN t USING (community_id) WHERE size >= 2"
    ),
)
def cluster_cohesion(t: Tables) -> DataFrame:
    return M.cluster_cohesion(t.community_members, t.resolved_edges)


@query("path_predicates", "", f"SELECT path, is_test_path, is_tooling_path, lang, {_NOISE} AS is_noise FROM files")
def path_predicates(t: Tables) -> DataFrame:
    return t.files.select("path", "is_test_path", "is_tooling_path", "lang", P.is_noise_path(F.col("path")).alias("is_noise"))


@query("narrowest_enclosing", (
    "c AS (SELECT s.id AS span_id, f.id AS fn_id, f.name AS fn_name, f.end_byte - f.start_byte AS len FROM entities s "
    "JOIN entities f ON f.kind = 0 AND f.file_id = s.file_id AND f.start_byte <= s.start_byte AND f.end_byte >= s.end_byte "
    "WHERE s.kind = 6)"
), "SELECT span_id, fn_id, fn_name FROM (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY len, fn_id) AS n FROM c) WHERE n = 1")
def narrowest_enclosing(t: Tables) -> DataFrame:
    return L.narrowest_enclosing(t.entities.filter("kind = 6").select(F.col("id").alias("span_id"), "file_id", "start_byte", "end_byte"), t.entities)


@query("detect_changes", (
    "a AS (SELECT file_id, name, min((start_line, end_line)) AS s FROM entities WHERE kind = 0 AND id % 10 <> 3 GROUP BY 1, 2), "
    "b AS (SELECT file_id, name, min((start_line, end_line)) AS s FROM entities WHERE kind = 0 AND id % 10 <> 5 GROUP BY 1, 2)"
), "SELECT file_id, name, CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b USING (file_id, name) WHERE a.s IS DISTINCT FROM b.s")
def detect_changes(t: Tables) -> DataFrame:
    fns = t.entities.filter("kind = 0")
    return L.symbol_changes(fns.filter("id % 10 <> 3"), fns.filter("id % 10 <> 5"))


@query("classify_files", "", "SELECT path, CASE WHEN id % 7 = 0 THEN 'new' WHEN id % 11 = 0 THEN 'deleted' WHEN churn > 1 THEN 'changed' ELSE 'unchanged' END AS status FROM files WHERE NOT (id % 7 = 0 AND id % 11 = 0)")
def classify_files(t: Tables) -> DataFrame:
    old = t.files.filter("id % 7 <> 0").select("path", F.lit(1).cast("long").alias("mtime"), F.col("id").alias("size"))
    new = t.files.filter("id % 11 <> 0").select("path", F.when(F.col("churn") > 1, 2).otherwise(1).cast("long").alias("mtime"), F.col("id").alias("size"))
    return L.classify_files(old, new)


@query("deep_types", (
    "ext AS (SELECT DISTINCT enclosing_function AS sub, name AS sup FROM entities WHERE kind = 15 AND name <> enclosing_function), "
    "anc AS (SELECT DISTINCT name, name AS cur, 0 AS depth FROM entities WHERE kind = 1 UNION SELECT a.name, e.sup, a.depth + 1 "
    "FROM anc a JOIN ext e ON e.sub = a.cur)"
), "SELECT name, max(depth) AS depth FROM anc GROUP BY name")
def deep_types(t: Tables) -> DataFrame:
    return G.ancestry_depth(t.entities)


@query(
    "call_pairs",
    "fns AS (SELECT file_id, name, owner_type, min(id) AS caller FROM entities WHERE kind = 0 GROUP BY ALL)",
    (
        "SELECT caller, to_entity_id AS callee, min(e.id) AS first FROM resolved_edges e JOIN entities s ON s.id = e.from_entity_id "
        "AND s.kind = 6 JOIN fns ON fns.file_id = s.file_id AND fns.name = s.enclosing_function AND fns.owner_type IS NOT DISTINCT "
        "FROM s.owner_type WHERE e.kind = 0 AND resolved GROUP BY ALL"
    ),
)
def call_pairs(t: Tables) -> DataFrame:
    return W.call_pairs(t.entities, t.resolved_edges)


@query("churn_varies", "", "SELECT count(DISTINCT churn) > 1 AS varies, count(*) AS files FROM files")
def churn_varies(t: Tables) -> DataFrame:
    return t.files.agg((F.min("churn") < F.max("churn")).alias("varies"), F.count(F.lit(1)).alias("files"))


@query("data_class_files", "", "SELECT file_id AS id FROM entities WHERE kind = 0 GROUP BY file_id HAVING bool_and(regexp_matches(name, '^(get|set|is|has)($|_|[A-Z])'))")
def data_class_files(t: Tables) -> DataFrame:
    return M.data_class_files(t.entities)


@query("neighbours", f"{_PAIRS}, {_SINK}", "SELECT DISTINCT x AS id FROM (SELECT b AS x, a AS y FROM pairs UNION ALL SELECT a, b FROM pairs) WHERE y IN (SELECT id FROM sink) AND x NOT IN (SELECT id FROM sink)")
def neighbours(t: Tables) -> DataFrame:
    return G.neighbours(t.resolved_edges, seed(t, "to_file_id"))


@query("type_edges", "types AS (SELECT name, min(id) AS id, min((id, file_id))[2] AS file_id FROM entities WHERE kind IN (1, 2) GROUP BY name HAVING count(*) = 1)", (
    "SELECT e.id AS from_entity_id, e.file_id AS from_file_id, t.file_id AS to_file_id, t.id AS to_entity_id, CASE "
    "WHEN e.kind = 15 THEN 2 ELSE 3 END AS kind FROM entities e LEFT JOIN types t USING (name) WHERE e.kind IN (15, 16)"
))
def type_edges(t: Tables) -> DataFrame:
    return S.resolve_types(t.entities)


@query(
    "call_edges",
    "call AS (SELECT e.id, e.file_id, e.name, f.lang, f.is_test_path FROM entities e JOIN files f ON f.id = e.file_id "
    "WHERE e.kind = 6), fn AS (SELECT e.id, e.file_id, e.name, f.lang, f.is_test_path FROM entities e JOIN files f ON f.id = e.file_id "
    "WHERE e.kind IN (0, 1)), "
    "same AS (SELECT call.id, min(fn.id) AS t FROM call JOIN fn USING (file_id, name) GROUP BY call.id), "
    "imp AS (SELECT DISTINCT from_file_id AS file_id, to_file_id FROM resolved_edges WHERE kind = 1 AND resolved), "
    "across AS (SELECT call.id, list_distinct(list(fn.id)) AS ts FROM call JOIN imp USING (file_id) JOIN fn ON fn.file_id = imp.to_file_id AND fn.name = call.name GROUP BY call.id), "
    f"wide AS (SELECT name, list(id) AS ts FROM fn WHERE lang IN ('{"', '".join(S.REPO_WIDE)}') AND NOT is_test_path AND name NOT IN ('{"', '".join(P.OBJECT_METHODS)}') GROUP BY name), "
    f"pick AS (SELECT call.*, coalesce(same.t, CASE WHEN len(across.ts) = 1 THEN across.ts[1] END, CASE "
    f"WHEN call.lang IN ('{"', '".join(S.REPO_WIDE)}') AND len(wide.ts) = 1 THEN wide.ts[1] END) AS t FROM call LEFT "
    f"JOIN same USING (id) LEFT JOIN across USING (id) LEFT JOIN wide USING (name))",
    "SELECT p.id AS from_entity_id, fn.id AS to_entity_id, fn.file_id AS to_file_id FROM pick p LEFT JOIN fn ON fn.id = p.t AND NOT (fn.is_test_path AND NOT p.is_test_path)",
)
def call_edges(t: Tables) -> DataFrame:
    imports = t.resolved_edges.filter("kind = 1 and resolved")
    entities = t.entities.withColumns({c: F.lit(None).cast("string") for c in ("owner_type",)})
    return S.resolve_calls(t.files, entities, imports).select("from_entity_id", "to_entity_id", "to_file_id")


@query(
    "subsystems",
    f"g AS (SELECT community_id, path, regexp_extract(path, '^(.*)/', 1) AS folder FROM files WHERE NOT {_GENERATED}), c AS (SELECT community_id, folder, count(*) AS n FROM g GROUP BY ALL), "
    "top AS (SELECT community_id, arg_min(folder, (-n, folder)) AS folder, CAST(sum(n) AS BIGINT) AS size FROM c GROUP BY community_id "
    "HAVING sum(n) > 1), first AS (SELECT community_id, min(path) AS path FROM g GROUP BY community_id), "
    "one AS (SELECT community_id, size, list_last(string_split(folder, '/')) AS name, string_split(list_last(string_split(path, '/')), '.')[1] AS stem FROM top JOIN first USING (community_id)), "
    "two AS (SELECT community_id, size, CASE WHEN count(*) OVER (PARTITION BY name) > 1 AND stem <> name THEN name || '/' || stem ELSE name END AS name FROM one)",
    "SELECT community_id, size, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' #' || community_id ELSE name END AS name FROM two",
)
def subsystems(t: Tables) -> DataFrame:
    from codeloom.plans.navmap import subsystem_names

    return subsystem_names(t)


#: Thresholds at which the projection has findings; production ones are each rule's own.
_LOWER = {
    "file-complexity-hotspot": {"max_complexity": 8.0}, "churn-complexity-hotspot": {"max_complexity": 6.0, "min_churn": 1.0}, "function-complexity-hotspot": {"max_function_complexity": 1.0}, "low-fan-in-high-fan-out-file": {"max_fan_in": 2.0, "min_fan_out": 2.0},
    "vertical-slice-sprawl": {"min_foreign_slices": 1.0}, "solid-isp": {"method_threshold": 3.0, "empty_body_threshold": 0.05}, "fat-interface": {"max_members": 0.0}, "too-many-interfaces": {"max_interfaces": 1.0}, "duplicate-code-clone": {"min_band_size": 3.0, "min_span_lines": 2.0},
}
_CLONES = "clone_band_members AS (SELECT s * 50 + q AS band_id, id AS entity_id FROM p_kinded WHERE kind = 0)"
#: What each rule asks for, said a second time: subqueries for each row, lists and windows where the rule joins and groups.
_AT = "f.path AS file, e.start_line AS line, e.start_byte, e.end_byte, e.end_line, e.id"
_RULE_SQL = {
    "file-complexity-hotspot": "SELECT path AS file, 1 AS line, n AS complexity FROM (SELECT f.path, 1 + (SELECT count(*) FROM entities e WHERE e.file_id = f.id AND e.kind = 12) AS n FROM files f) WHERE n >= 9",
    "churn-complexity-hotspot": "SELECT path AS file, 1 AS line, complexity, churn FROM files WHERE least(complexity - 7, churn - 2) >= 0",
    "function-complexity-hotspot": (
        f"SELECT {_AT}, e.name, 1 + len(list_filter(b.all, lambda x: x.n = e.name AND x.o IS NOT DISTINCT FROM e.owner_type)) AS complexity "
        f"FROM entities e JOIN files f ON f.id = e.file_id JOIN (SELECT file_id, list({{'n': enclosing_function, 'o': owner_type}}) AS all "
        f"FROM entities WHERE kind = 12 GROUP BY file_id) b ON b.file_id = e.file_id WHERE e.kind = 0 "
        f"AND len(list_filter(b.all, lambda x: x.n = e.name AND x.o IS NOT DISTINCT FROM e.owner_type)) > 0"
    ),
    "duplicate-code-clone": (
        f"SELECT {_AT}, band_id "
        f"FROM (SELECT m.band_id, m.entity_id, count(*) OVER w AS n, count(o.owner_type) OVER w AS owned, len(list_distinct(list(o.owner_type) OVER w)) AS owners "
        f"FROM clone_band_members m JOIN entities o ON o.id = m.entity_id JOIN files g ON g.id = o.file_id "
        f"WHERE NOT (g.is_test_path OR g.is_tooling_path) AND o.end_line - o.start_line >= 2 WINDOW w AS (PARTITION BY m.band_id)) x "
        f"JOIN entities e ON e.id = x.entity_id JOIN files f ON f.id = e.file_id WHERE n >= 3 AND (owned = 0 OR owners < n)"
    ),
    "low-fan-in-high-fan-out-file": (
        "SELECT path AS file, 1 AS line, fan_in, fan_out FROM (SELECT f.path, f.is_test_path, (SELECT count(*) FROM resolved_edges r "
        "WHERE r.resolved AND r.to_file_id = f.id) AS fan_in, (SELECT count(*) FROM resolved_edges r WHERE r.resolved "
        "AND r.from_file_id = f.id) AS fan_out FROM files f) WHERE NOT (is_test_path OR fan_in > 2 OR fan_out < 2)"
    ),
    "circular-import": (
        "SELECT f.path AS file, coalesce(e.start_line, 1) AS line, x.id, y.id AS other_id, g.path AS other FROM (SELECT * "
        "FROM resolved_edges WHERE kind = 1 AND resolved) x JOIN (SELECT * FROM resolved_edges WHERE kind = 1 "
        "AND resolved) y ON (x.from_file_id, x.to_file_id) = (y.to_file_id, y.from_file_id) JOIN files f ON f.id = x.from_file_id "
        "JOIN files g ON g.id = x.to_file_id LEFT JOIN entities e ON e.id = x.from_entity_id WHERE x.from_file_id < x.to_file_id "
        "AND NOT (f.is_test_path OR g.is_test_path OR suffix(f.path, '.java') OR suffix(g.path, '.java'))"
    ),
    "vertical-slice-sprawl": (
        f"SELECT {_AT}, e.name, len(list_distinct(list(t.community_id))) AS slices "
        f"FROM (SELECT c.id AS call_id, list({{'id': n.id, 'kind': n.kind, 'a': n.start_byte, 'b': n.end_byte}}) AS around FROM entities c "
        f"JOIN entities n ON n.file_id = c.file_id AND n.kind IN (0, 19) AND n.start_byte <= c.start_byte AND n.end_byte >= c.end_byte "
        f"WHERE c.kind = 6 GROUP BY c.id) y, unnest(list_filter(y.around, lambda p: p.kind = 0 "
        f"AND len(list_filter(y.around, lambda q: q.id <> p.id AND q.a >= p.a AND q.b <= p.b)) = 0)) AS u(p) "
        f"JOIN entities e ON e.id = u.p.id JOIN files f ON f.id = e.file_id JOIN resolved_edges r ON r.from_entity_id = y.call_id "
        f"AND r.kind = 0 AND r.resolved JOIN files t ON t.id = r.to_file_id WHERE t.community_id <> f.community_id GROUP BY ALL"
    ),
    "solid-lsp": (
        f"SELECT {_AT}, e.enclosing_function AS class_name, e.name AS interface_name, CAST(len(list_filter(q.names, lambda n: list_contains(coalesce(h.names, []), n))) AS BIGINT) AS class_methods, CAST(len(q.names) AS BIGINT) AS iface_methods "
        f"FROM entities e JOIN files f ON f.id = e.file_id JOIN (SELECT owner_type, list(name) AS names FROM entities WHERE kind = 0 "
        f"AND owner_type IS NOT NULL AND end_line = start_line GROUP BY owner_type) q ON q.owner_type = e.name LEFT "
        f"JOIN (SELECT file_id, owner_type, list(name) AS names FROM entities WHERE kind = 0 AND owner_type IS NOT NULL "
        f"GROUP BY ALL) h ON h.file_id = e.file_id AND h.owner_type = e.enclosing_function WHERE e.kind = 16 AND NOT f.is_test_path "
        f"AND NOT suffix(f.path, '.rb') AND EXISTS (SELECT 1 FROM entities i WHERE i.kind = 2 AND i.name = e.name) "
        f"AND len(list_filter(q.names, lambda n: list_contains(coalesce(h.names, []), n))) < 0.7 * len(q.names)"
    ),
    "solid-isp": (
        f"SELECT {_AT}, e.enclosing_function AS class_name, e.name AS interface_name, (SELECT count(*) FROM entities m WHERE m.kind = 0 "
        f"AND m.owner_type = e.name) AS iface_method_count, CAST(len(c.stubs) AS BIGINT) AS class_methods, CAST(len(list_filter(c.stubs, lambda x: x)) AS BIGINT) AS empty_stubs "
        f"FROM entities e JOIN files f ON f.id = e.file_id JOIN (SELECT m.file_id, m.owner_type, list(m.end_line - m.start_line <= 1 "
        f"AND NOT EXISTS (SELECT 1 FROM entities k WHERE k.kind = 6 AND k.file_id = m.file_id AND k.start_byte >= m.start_byte "
        f"AND k.end_byte <= m.end_byte)) AS stubs FROM entities m WHERE m.kind = 0 AND m.owner_type IS NOT NULL "
        f"GROUP BY ALL) c ON c.file_id = e.file_id AND c.owner_type = e.enclosing_function WHERE e.kind = 16 AND NOT f.is_test_path "
        f"AND NOT suffix(f.path, '.rb') AND (SELECT count(*) FROM entities m WHERE m.kind = 0 AND m.owner_type = e.name) > 3 "
        f"AND len(list_filter(c.stubs, lambda x: x)) > 0.05 * len(c.stubs)"
    ),
    "fat-interface": (
        f"SELECT {_AT}, e.name AS class_name, CAST(len(list_filter(m.all, lambda x: x.o = e.name AND x.a >= e.start_byte "
        f"AND x.b <= e.end_byte)) AS BIGINT) AS member_count FROM entities e JOIN files f ON f.id = e.file_id "
        f"JOIN (SELECT file_id, list({{'o': owner_type, 'a': start_byte, 'b': end_byte}}) AS all FROM entities WHERE kind = 0 "
        f"AND owner_type IS NOT NULL GROUP BY file_id) m ON m.file_id = e.file_id WHERE e.kind IN (1, 2) AND NOT f.is_test_path "
        f"AND NOT regexp_matches(e.name, '(Builder|Facade|Extensions|Installer|Registrar)$') "
        f"AND len(list_filter(m.all, lambda x: x.o = e.name AND x.a >= e.start_byte AND x.b <= e.end_byte)) > 0"
    ),
    "too-many-interfaces": (
        "SELECT path AS file, list_min(lines) AS line, cls AS class_name, CAST(len(lines) AS BIGINT) AS implements_count "
        "FROM (SELECT f.path, e.file_id, e.enclosing_function AS cls, list(e.start_line) AS lines FROM entities e "
        "JOIN files f ON f.id = e.file_id WHERE e.kind = 16 AND NOT f.is_test_path AND e.name NOT IN ('Clone', 'Debug', 'Comparable') "
        "GROUP BY ALL) WHERE len(lines) >= 2"
    ),
    "deep-inheritance": (
        f"SELECT {_AT}, e.name AS class_name, up.n AS chain_depth FROM entities e JOIN files f ON f.id = e.file_id "
        f"JOIN (SELECT name, max(len(way)) - 1 AS n FROM ways GROUP BY name) up ON up.name = e.name WHERE e.kind = 1 AND NOT f.is_test_path "
        f"AND up.n >= 4"
    ),
}
_WAYS = (
    "ways AS (SELECT DISTINCT name, [name] AS way FROM entities WHERE kind = 1 UNION SELECT w.name, list_append(w.way, x.sup) "
    "FROM ways w JOIN (SELECT DISTINCT enclosing_function AS sub, name AS sup FROM entities "
    "WHERE kind = 15) x ON x.sub = w.way[len(w.way)] AND NOT list_contains(w.way, x.sup))"
)


def _rule(rule: R.Rule) -> None:
    name = "rule_" + rule.id.replace("-", "_")
    given = {**rule.thresholds, **_LOWER.get(rule.id, {})}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = tables(spark, sf_dir)
        t.clone_band_members = spark.table("p_kinded").filter("kind = 0").select((F.col("s") * 50 + F.col("q")).alias("band_id"), F.col("id").alias("entity_id"))
        t.register(spark)
        if "type_depth" in rule.body:
            G.ancestry_depth(t.entities).createOrReplaceTempView("type_depth")
        return R.run_rule(spark, rule, given)

    QUERIES[name] = run
    ORACLE[name] = f"{oracle_prefix()}, {_CLONES}, {_WAYS} {_RULE_SQL[rule.id]}"


for _r in R.BUILTIN:
    _rule(_r)


def _documents(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        if sql:
            ORACLE[name] = sql
        return f

    return register


@_documents("minhash_signatures")
def minhash_signatures(docs: DataFrame) -> DataFrame:
    return with_minhash(docs.select("doc_id", "text"), "text").select("doc_id", "body_minhash")


@_documents("clone_bands")
def clone_bands(docs: DataFrame) -> DataFrame:
    return M.clone_bands(with_minhash(docs.select(F.col("doc_id").alias("id"), "text"), "text").select("id", "body_minhash"))


@_documents("clone_band_members")
def clone_band_members(docs: DataFrame) -> DataFrame:
    return M.clone_band_members(with_minhash(docs.select(F.col("doc_id").alias("id"), "text"), "text").select("id", "body_minhash"))


@_documents("content_hash", (
    "SELECT doc_id, lpad(lower(to_hex(CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: CAST('0x' || p AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS UBIGINT))), 16, '0') AS content_hash "
    "FROM documents"
))
def content_hash(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.lpad(F.lower(F.hex(fnv1a_column(F.col("text")))), 16, "0").alias("content_hash"))


@_documents("pattern_atoms", "SELECT doc_id FROM documents WHERE contains(text, 'token') AND contains(text, '=')")
def pattern_atoms(docs: DataFrame) -> DataFrame:
    """Prefilter of the pattern search: a text that lacks a word of the pattern can't match. The sign is no word."""
    from codeloom.operators.patterns import literal_atoms

    for word in literal_atoms("token = $V", "go"):
        docs = docs.filter(F.col("text").contains(word))
    return docs.filter(F.col("text").contains("=")).select("doc_id")


@_documents("pattern_search")
def pattern_search(docs: DataFrame) -> DataFrame:
    """What follows the word token and a sign, in every text read as tokens."""
    from codeloom.operators.patterns import search

    hits = search(docs.select(F.col("doc_id").cast("string").alias("path"), "text"), "token=$V", lang="go")
    return hits.select(F.col("file").cast("long").alias("doc_id"), "start_byte", "text")


@query("shortest_path_length", f"{_PAIRS}, {_SEED}, {_reach('out', 12)}, far AS (SELECT id, min(depth) AS d FROM reach_out GROUP BY id), last AS (SELECT id, d FROM far ORDER BY d DESC, id LIMIT 1)", "SELECT (SELECT id FROM seed) AS source, id AS target, d AS edges, true AS linked FROM last")
def shortest_path_length(t: Tables) -> DataFrame:
    """The path to the file farthest from the seed: its ends and length, and whether each step is an edge."""
    pairs = cut(G.adjacency(t.resolved_edges), "pairs")
    start = seed(t).first().id
    far = G.reachable(pairs, seed(t), 12).orderBy(F.desc("depth"), "id").first()
    path = G.shortest_path(t.resolved_edges, start, far.id)
    steps = t.files.sparkSession.createDataFrame(list(zip(path, path[1:], strict=False)), "src long, dst long")
    missing = steps.join(pairs, ["src", "dst"], "left_anti")
    return steps.agg(F.lit(path[0]).alias("source"), F.lit(path[-1]).alias("target"), F.count(F.lit(1)).cast("int").alias("edges")).join(missing.agg((F.count(F.lit(1)) == 0).alias("linked")))


@query("entity_fans", "ends AS (SELECT from_entity_id AS f, to_entity_id AS t FROM resolved_edges WHERE kind = 0 AND resolved)", 'SELECT id AS entity, (SELECT count(*) FROM ends WHERE f = id) AS "out", (SELECT count(*) FROM ends WHERE t = id) AS "in" FROM (SELECT f AS id FROM ends UNION SELECT t FROM ends)')
def entity_fans(t: Tables) -> DataFrame:
    from codeloom.plans.navmap import call_fans

    return call_fans(t.resolved_edges)


@query("edge_scope", "changed AS (SELECT id FROM files WHERE id % 400 = 7)", "SELECT id FROM changed UNION SELECT from_file_id FROM resolved_edges WHERE resolved AND to_file_id IN (SELECT id FROM changed)")
def edge_scope(t: Tables) -> DataFrame:
    return S.scope_of(t.files.filter("id % 400 = 7").select("id"), t.resolved_edges)


@query("index_counts", "", "SELECT 'files' AS name, count(*) AS n FROM files UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'resolved_edges', count(*) FROM resolved_edges")
def index_counts(t: Tables) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, df in (("files", t.files), ("entities", t.entities), ("resolved_edges", t.resolved_edges))])


@query("severe_findings", "", (
    "SELECT severity, count(*) AS n FROM (SELECT 'warning' AS severity FROM files WHERE complexity > 8 UNION ALL SELECT 'info' "
    "FROM files WHERE NOT is_test_path AND fan_in <= 2 AND fan_out >= 2) GROUP BY severity"
))
def severe_findings(t: Tables) -> DataFrame:
    """Findings of two rules by severity, through the scan's own tables."""
    from dataclasses import replace

    from codeloom.plans.scan import sql_findings

    t.register(t.files.sparkSession)
    rules = [replace(R.BY_ID[i], thresholds={**R.BY_ID[i].thresholds, **_LOWER[i]}) for i in ("file-complexity-hotspot", "low-fan-in-high-fan-out-file")]
    findings, _ = sql_findings(t.files.sparkSession, rules)
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


#: Imports over the parts: a part imports the one before it, by path, by dotted path, by name or from nowhere.
_IMPORTS = """SELECT p.id, p.id AS file_id, 9 AS kind, CASE p.id % 4 WHEN 0 THEN './' || regexp_extract(q.path, '([^/]*)$', 1) WHEN 1 THEN replace(regexp_replace(q.path, '[.][^./]{1,4}$', ''), '/', '.')
  WHEN 2 THEN regexp_replace(regexp_extract(q.path, '([^/]*)$', 1), '[.][^./]{1,4}$', '') ELSE 'no.such.thing' END AS name FROM p_paths p JOIN p_paths q ON q.id = p.id - 5"""


@query(
    "import_edges",
    f"imp AS ({_IMPORTS}), me AS (SELECT i.id, i.name, f.lang, f.path FROM imp i JOIN files f ON f.id = i.file_id), "
    f"bare AS (SELECT id AS to_id, lang, path, regexp_replace(path, '[.][^./]{{1,4}}$', '') AS b FROM files), "
    # by path from the importer's folder, whatever the language
    "near AS (SELECT me.id, to_id, 0 AS step FROM me JOIN bare ON bare.path = regexp_extract(me.path, '^(.*)/', 1) || substr(me.name, 2) WHERE me.name LIKE './%' AND to_id <> me.id), "
    # by the last 6 to 2 parts of a dotted path, the longest first
    "parts AS (SELECT id, lang, list_filter(string_split_regex(regexp_replace(regexp_replace(name, '^([.]/)+', ''), '(/[^/]{1,60})[.](js|jsx|ts|tsx|mjs|py|rb|php|h|hpp|lua|sol)$', '\\1'), '[./:]+'), lambda x: x <> '') AS ps "
    "FROM me), "
    "tails AS (SELECT id, lang, k, array_to_string(ps[len(ps) - k + 1:], '/') AS t FROM parts, (SELECT unnest([2, 3, 4, 5, 6]) AS k) WHERE k <= len(ps)), "
    "by_tail AS (SELECT id, k, list_distinct(list(to_id)) AS found FROM tails JOIN bare ON (b = t OR suffix(b, '/' || t)) AND tails.lang IS NOT DISTINCT FROM bare.lang AND to_id <> id GROUP BY id, k), "
    "tail AS (SELECT id, arg_max(found[1], k) AS to_id, 1 AS step FROM by_tail WHERE len(found) = 1 GROUP BY id), "
    # by the name of a file, from the last part backwards; several end the search
    "stems AS (SELECT id, lang, i, ps[len(ps) - i] AS s FROM parts, (SELECT unnest(range(0, 8)) AS i) WHERE i < len(ps)), "
    "by_stem AS (SELECT id, i, list_distinct(list(to_id)) AS found FROM stems JOIN bare ON regexp_extract(b, '([^/]*)$', 1) = s "
    "AND stems.lang IS NOT DISTINCT FROM bare.lang AND to_id <> id GROUP BY id, i), "
    "stem AS (SELECT id, arg_min(CASE WHEN len(found) = 1 THEN found[1] END, i) AS to_id, 2 AS step FROM by_stem GROUP BY id), "
    "best AS (SELECT id, arg_min(to_id, step) AS to_id FROM (SELECT * FROM near UNION ALL SELECT * FROM tail UNION ALL SELECT * FROM stem) GROUP BY id)",
    "SELECT me.id AS from_entity_id, me.id AS from_file_id, best.to_id AS to_file_id FROM me LEFT JOIN best USING (id) WHERE me.lang IS NOT NULL",
)
def import_edges(t: Tables) -> DataFrame:
    known = t.files.filter("lang is not null")
    entities = t.files.sparkSession.sql(_IMPORTS).join(known.select("id"), "id", "left_semi")
    return S.resolve_imports(t.files, entities).select("from_entity_id", "from_file_id", "to_file_id")


#: Calls of methods by receivers whose type the file declares, over the classes of the projection.
_CALLS = """SELECT id, 6 AS kind, 'v' || CAST(s % 5 AS STRING) || '.m' || CAST(q % 30 AS STRING) AS name, p AS file_id, CAST(NULL AS STRING) AS enclosing_function, CAST(NULL AS STRING) AS owner_type FROM (SELECT o * 10 + n AS id, * FROM p_lines WHERE n = 1) x
  UNION ALL SELECT id, 18, 'K' || CAST(s % 40 AS STRING), p, 'v' || CAST(s % 5 AS STRING), NULL FROM (SELECT o * 10 + n AS id, * FROM p_lines WHERE n = 2) x
  UNION ALL SELECT id, 0, 'm' || CAST(q % 30 AS STRING), p, NULL, 'K' || CAST(s % 40 AS STRING) FROM (SELECT o * 10 + n AS id, * FROM p_lines WHERE n = 3 AND o % 97 = 0) x
  UNION ALL SELECT id, CASE WHEN s % 4 = 0 THEN 2 ELSE 1 END, 'K' || CAST(s % 40 AS STRING), p, NULL, NULL FROM (SELECT o * 10 + n AS id, * FROM p_lines WHERE n = 4) x
  UNION ALL SELECT id, 16, 'K' || CAST(4 * (s % 10) AS STRING), p, 'K' || CAST(s % 40 AS STRING), NULL FROM (SELECT o * 10 + n AS id, * FROM p_lines WHERE n = 5 AND o % 31 = 0) x"""


@query(
    "typed_calls",
    f"ents AS ({_CALLS}), call AS (SELECT e.id, e.file_id, split_part(e.name, '.', 1) AS recv, split_part(e.name, '.', 2) AS key "
    f"FROM ents e JOIN files f ON f.id = e.file_id WHERE e.kind = 6 AND f.lang = 'java'), "
    "ty AS (SELECT c.id, c.key, (SELECT arg_max(v.name, v.id) FROM ents v WHERE v.kind = 18 AND v.file_id = c.file_id AND v.enclosing_function = c.recv) AS type FROM call c), "
    "owners AS (SELECT DISTINCT name AS type, name AS owner FROM ents WHERE kind IN (1, 2) UNION SELECT name, enclosing_function FROM ents WHERE kind = 16), "
    "hits AS (SELECT ty.id, list_distinct(list(m.id)) AS found FROM ty JOIN owners USING (type) JOIN ents m ON m.kind = 0 "
    "AND m.owner_type = owners.owner AND m.name = ty.key WHERE owners.owner NOT IN (SELECT name FROM ents WHERE kind = 2) "
    "GROUP BY ty.id)",
    "SELECT id, found[1] AS found FROM hits WHERE len(found) = 1",
)
def typed_calls(t: Tables) -> DataFrame:
    """Calls bound by the type of their receiver."""
    entities = cut(t.files.sparkSession.sql(_CALLS), "calls")
    calls = S.receivers(entities).join(t.files.filter("lang = 'java'").select(F.col("id").alias("file_id"), "lang"), "file_id")
    return S.type_calls(calls, S.typed_receivers(calls, entities), entities)


@query("louvain_communities")
def louvain_communities(t: Tables) -> DataFrame:
    return G.communities(t.files, t.resolved_edges)


__all__ = ["ORACLE", "QUERIES", "like_sql"]
