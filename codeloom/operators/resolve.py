"""Resolution of imports, calls and supertypes to targets, as joins with uniqueness aggregation.

Each specifier gives ranked keys, each file the keys under which it can be found. A key with one target binds; with
none or (while the step allows) several, the next key is tried. Same language only, but for exact relative paths.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codeloom.functions import predicates as P
from codeloom.operators.lineage import cut
from codeloom.schema import EDGE, ENTITY

EXACT, BARE, MODULE, SUFFIX, STEM, PACKAGE = range(6)
#: Steps at which several targets end the search.
STOPS = [STEM, PACKAGE]
MOST_SEGMENTS = 6
REPO_WIDE = ["csharp", "java", "kotlin", "scala", "swift"]
_NO_EXT = r"\.[^./]{1,4}$"


def relative(folder: str | None, spec: str) -> str | None:
    """A specifier that begins with a stop, from a folder on; .. at the top leads nowhere. None for any other."""
    if not spec.startswith("."):
        return None
    parts: list[str] = []
    for part in [*(folder or "").split("/"), *spec.split("/")]:
        if part == "..":
            del parts[-1:]
        elif part not in ("", "."):
            parts.append(part)
    return "/".join(parts)


@F.pandas_udf(T.StringType())
def _joined(folder: pd.Series, spec: pd.Series) -> pd.Series:
    return pd.Series([relative(d, s) for d, s in zip(folder, spec, strict=True)])


def _tails(parts, most: int = MOST_SEGMENTS):
    """array<struct<k, key>>: the last 2 to most parts joined, the longest first."""
    ks = F.filter(F.sequence(F.lit(most), F.lit(2), F.lit(-1)), lambda k: k <= F.size(parts))
    return F.transform(ks, lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "/").alias("key")))


def _keys(step: int, tails):
    return F.transform(tails, lambda t: F.struct(F.lit(step).alias("step"), (F.lit(MOST_SEGMENTS) - t["k"]).cast("int").alias("rank"), t["key"].alias("key")))


def _one(step: int, key):
    return F.array(F.struct(F.lit(step).alias("step"), F.lit(0).alias("rank"), key.alias("key")))


def file_keys(files: DataFrame, entities: DataFrame) -> DataFrame:
    """(step, key, target, lang)."""
    bare = F.regexp_replace("path", _NO_EXT, "")
    parts = F.split(bare, "/")
    folder = F.slice(parts, 1, F.size(parts) - 1)
    stem = F.element_at(parts, -1)
    package = F.when(stem.isin("__init__", "index", "mod"), F.concat(_keys(PACKAGE, _tails(folder)), _one(PACKAGE, F.element_at(F.concat(F.array(F.lit("")), folder), -1)))).otherwise(F.expr("array()"))
    keys = F.concat(_one(EXACT, F.col("path")), _one(BARE, bare), _keys(SUFFIX, _tails(parts)), _one(STEM, stem), package)
    own = files.select(F.col("id").alias("target"), "lang", F.explode(keys).alias("k")).select("k.step", "k.key", "target", "lang")
    modules = entities.filter(F.col("kind").isin(1, 2) & F.col("name").contains(".")).join(files.select(F.col("id").alias("file_id"), "lang"), "file_id")
    return own.unionByName(modules.select(F.lit(MODULE).alias("step"), F.col("name").alias("key"), F.col("file_id").alias("target"), "lang"))


def package_folder(spec, modules: list[tuple[str, str]]):
    """The folder of a Go package below one of the modules (path, folder), the longest path first; null for others."""
    tests = [F.when((spec == path) | spec.startswith(path + "/"), F.concat(F.lit(f"{root}/" if root else ""), F.substring(spec, len(path) + 2, 100_000))) for path, root in sorted(modules, key=lambda m: -len(m[0]))]
    return F.regexp_replace(F.coalesce(*tests), "/+$", "") if tests else F.lit(None).cast("string")


def resolve_packages(files: DataFrame, entities: DataFrame, modules: list[tuple[str, str]]) -> DataFrame:
    """(id, to_file_id) of Go imports of packages of the modules: one row for each file of the package's folder, without
    tests and the importer; null where there is none. They aren't looked for in other ways."""
    go = files.filter("lang = 'go'").select(F.col("id").alias("file_id"))
    rows = entities.filter(F.col("kind") == ENTITY["import"]).join(go, "file_id").select("id", "file_id", package_folder(F.regexp_replace("name", "^[\"`]|[\"`]$", ""), modules).alias("folder")).filter("folder is not null")
    homes = files.filter("lang = 'go'").filter(~F.col("path").endswith("_test.go")).select(F.col("id").alias("to_file_id"), F.regexp_extract("path", "^(?:(.*)/)?[^/]*$", 1).alias("folder"))
    hits = rows.join(homes, "folder").filter("to_file_id <> file_id").select("id", "to_file_id")
    return rows.select("id", "file_id").join(hits, "id", "left")


def resolve_imports(files: DataFrame, entities: DataFrame, modules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Import edges: (from_entity_id, from_file_id, to_file_id, resolved)."""
    packages = None
    if modules:
        packages = cut(resolve_packages(files, entities, modules), "packages")
        edges = packages.select(F.col("id").alias("from_entity_id"), F.col("file_id").alias("from_file_id"), "to_file_id", F.lit(None).cast("long").alias("to_entity_id"), F.lit(EDGE["import"]).alias("kind"))
        others = entities.join(packages.select("id").distinct(), "id", "left_anti")
        return resolve_imports(files, others).unionByName(edges)
    spec = F.regexp_replace(F.regexp_replace(F.col("name"), "^[\"']|[\"';]+$", ""), r"^(?:\./|\.\./|crate::|self::|super::)+", "")
    parts = F.filter(F.split(F.regexp_replace(spec, r"(?<=/[^/]{1,60})\.(?:js|jsx|ts|tsx|mjs|py|rb|php|h|hpp|lua|sol)$", ""), r"[./:\\]+"), lambda p: p != "")
    rows = entities.filter(F.col("kind") == ENTITY["import"]).join(files.select(F.col("id").alias("file_id"), "path", F.col("lang").alias("from_lang")).withColumnRenamed("path", "from_path"), "file_id")
    rows = rows.select("id", "file_id", "from_lang", F.regexp_replace("from_path", "/?[^/]*$", "").alias("folder"), F.regexp_replace("name", "^[\"']|[\"';]+$", "").alias("raw"), parts.alias("parts")).withColumn("near", _joined("folder", "raw"))
    stems = F.transform(F.sequence(F.lit(0), F.greatest(F.size("parts") - 1, F.lit(0))), lambda j: F.struct(F.lit(STEM).alias("step"), j.cast("int").alias("rank"), F.try_element_at(F.col("parts"), F.size("parts") - j).alias("key")))
    keys = F.concat(_one(EXACT, F.col("near")), _one(BARE, F.regexp_replace("near", _NO_EXT, "")), _one(BARE, F.col("near")), _one(MODULE, F.col("raw")), _keys(SUFFIX, _tails(F.col("parts"))), stems, _keys(PACKAGE, _tails(F.col("parts"))), _one(PACKAGE, F.try_element_at(F.col("parts"), F.lit(-1))))
    wanted = rows.select("id", "file_id", "from_lang", F.explode(keys).alias("k")).select("id", "file_id", "from_lang", "k.step", "k.rank", "k.key").filter("key is not null and key <> ''")
    # a key's targets are counted before they meet the imports: common names (index, utils) are a row for each language
    targets = file_keys(files, entities).groupBy("step", "key", "lang").agg(F.countDistinct("target").alias("all"), F.min("target").alias("low"), F.max("target").alias("high"))
    hits = wanted.join(targets, ["step", "key"]).filter((F.col("step") == EXACT) | F.col("from_lang").isNull() | F.col("from_lang").eqNullSafe(F.col("lang")))
    # of one or two targets the importer itself is told apart; of three, two others are left anyway
    own = ((F.col("low") == F.col("file_id")) | (F.col("high") == F.col("file_id"))).cast("int")
    hits = hits.withColumn("others", F.col("all") - own).filter("others > 0").withColumn("other", F.when(F.col("low") == F.col("file_id"), F.col("high")).otherwise(F.col("low")))
    found = hits.groupBy("id", "step", "rank").agg(F.sum("others").alias("n"), F.min("other").alias("target"))
    decided = found.filter((F.col("n") == 1) | F.col("step").isin(STOPS)).groupBy("id").agg(F.min(F.struct("step", "rank", "n", "target")).alias("best"))
    to = decided.select("id", F.when(F.col("best.n") == 1, F.col("best.target")).alias("to_file_id"))
    return rows.select("id", "file_id").join(to, "id", "left").select(F.col("id").alias("from_entity_id"), F.col("file_id").alias("from_file_id"), "to_file_id", F.lit(None).cast("long").alias("to_entity_id"), F.lit(EDGE["import"]).alias("kind"))


def receivers(entities: DataFrame) -> DataFrame:
    """(id, file_id, key, recv) of calls: the name that is called, and the last part of what stands before it."""
    bare = F.regexp_replace(F.trim("name"), r"(\(\))+$", "")
    before = F.regexp_extract(bare, r"^(.*)(?:\.|::|->)[^.: >]*$", 1)
    recv = F.regexp_extract(before, r"([^.:>]*)$", 1)
    return entities.filter(F.col("kind") == ENTITY["call"]).select("id", "file_id", F.regexp_extract(bare, r"([^.: >]*)$", 1).alias("key"), F.when(recv != "", recv).alias("recv"))


def module_calls(calls: DataFrame, files: DataFrame, entities: DataFrame, fns: DataFrame) -> DataFrame:
    """(id, target) of Python calls of a name that an import of the file binds: the only function of that name in the
    files whose stem is the receiver."""
    bound = entities.filter((F.col("kind") == ENTITY["import"]) & F.col("owner_type").isNotNull()).select("file_id", F.explode(F.split("owner_type", ",")).alias("recv")).select("file_id", F.trim("recv").alias("recv")).distinct()
    stems = files.select(F.col("id").alias("in_file"), F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("recv"))
    only = fns.join(stems, "in_file").groupBy("recv", "key").agg(F.countDistinct("target").alias("n"), F.min("target").alias("found")).filter("n = 1").select("recv", "key", "found")
    return calls.filter("lang = 'python' and recv is not null").join(bound, ["file_id", "recv"], "left_semi").join(only, ["recv", "key"]).select("id", "found")


def typed_receivers(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, type): the type that the file's declarations give a call's receiver, or the receiver itself if it is a type."""
    declared = entities.filter((F.col("kind") == ENTITY["type_ref"]) & F.col("enclosing_function").isNotNull()).groupBy("file_id", F.col("enclosing_function").alias("recv")).agg(F.max(F.struct("id", F.col("name").alias("type"))).alias("t")).select("file_id", "recv", "t.type")
    types = entities.filter(F.col("kind").isin(1, 2)).select(F.col("name").alias("recv")).distinct().withColumn("own", F.col("recv"))
    rows = calls.filter("recv is not null").join(declared, ["file_id", "recv"], "left").join(types, "recv", "left")
    return rows.select("id", F.coalesce("type", "own").alias("type")).filter("type is not null")


def type_calls(calls: DataFrame, typed: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, target): the only method of that name of the receiver's type or of the types right below it, interfaces'
    own methods apart."""
    methods = entities.filter((F.col("kind") == ENTITY["function"]) & F.col("owner_type").isNotNull()).select(F.col("owner_type").alias("owner"), F.col("name").alias("key"), F.col("id").alias("target"))
    faces = entities.filter(F.col("kind") == ENTITY["interface"]).select(F.col("name").alias("owner")).distinct()
    methods = methods.join(faces, "owner", "left_anti")
    below = entities.filter(F.col("kind").isin(15, 16)).select(F.col("name").alias("type"), F.col("enclosing_function").alias("owner")).filter("owner is not null")
    own = entities.filter(F.col("kind").isin(1, 2)).select(F.col("name").alias("type"), F.col("name").alias("owner"))
    # a type's methods by name are counted before the calls come in
    table = own.union(below).distinct().join(methods, "owner").groupBy("type", "key").agg(F.countDistinct("target").alias("n"), F.min("target").alias("found")).filter("n = 1").select("type", "key", "found")
    return calls.join(typed, "id").join(table, ["type", "key"]).select("id", "found")


def resolve_calls(files: DataFrame, entities: DataFrame, imports: DataFrame) -> DataFrame:
    """Call edges, by the first of: the first function of the name in the file; the only one in imported files; the
    only one in the module that the receiver names (Python); in languages with namespaces, the only one of the
    repository outside tests, unless the receiver's type is known and not of the repository; the only method of the
    receiver's type. Production code never binds to a test file."""
    info = files.select(F.col("id").alias("file_id"), "lang", "is_test_path")
    calls = cut(receivers(entities).join(info, "file_id"), "calls")
    fns = entities.filter(F.col("kind").isin(ENTITY["function"], ENTITY["class"])).select(F.col("id").alias("target"), F.col("file_id").alias("in_file"), F.col("name").alias("key"))
    same = calls.join(fns, (calls.key == fns.key) & (calls.file_id == fns.in_file)).groupBy("id").agg(F.min("target").alias("t1"))
    reach = imports.filter("to_file_id is not null").select(F.col("from_file_id").alias("file_id"), F.col("to_file_id").alias("in_file")).distinct()
    across = calls.join(reach, "file_id").join(fns, ["in_file", "key"]).groupBy("id").agg(F.countDistinct("target").alias("n"), F.min("target").alias("t")).filter("n = 1").select("id", F.col("t").alias("t2"))
    module = module_calls(calls, files, entities, fns).withColumnRenamed("found", "t3")
    spaced = calls.filter(F.col("lang").isin(REPO_WIDE))
    typed = cut(typed_receivers(spaced, entities), "typed")
    inside = entities.filter(F.col("kind").isin(1, 2)).select(F.col("name").alias("type")).distinct()
    foreign = typed.join(inside, "type", "left_anti").select("id")
    plain = files.filter(~F.col("is_test_path") & F.col("lang").isin(REPO_WIDE)).select(F.col("id").alias("in_file"))
    only = fns.filter(~F.col("key").isin(P.OBJECT_METHODS)).join(plain, "in_file").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("t4")).filter("n = 1").select("key", "t4")
    wide = spaced.join(foreign, "id", "left_anti").join(only, "key").select("id", "t4")
    by_type = type_calls(spaced, typed, entities).withColumnRenamed("found", "t5")
    best = calls
    for found in (same, across, module, wide, by_type):
        best = best.join(found, "id", "left")
    best = best.withColumn("to_entity_id", F.coalesce("t1", "t2", "t3", "t4", "t5"))
    homes = fns.select(F.col("target").alias("to_entity_id"), F.col("in_file").alias("to_file_id")).join(files.select(F.col("id").alias("to_file_id"), F.col("is_test_path").alias("to_test")), "to_file_id")
    out = best.join(homes, "to_entity_id", "left").withColumn("ok", F.col("to_entity_id").isNotNull() & ~(~F.col("is_test_path") & F.coalesce("to_test", F.lit(False))))
    keep = lambda c: F.when(F.col("ok"), F.col(c)).alias(c)
    return out.select(F.col("id").alias("from_entity_id"), F.col("file_id").alias("from_file_id"), keep("to_file_id"), keep("to_entity_id"), F.lit(EDGE["call"]).alias("kind"))


def resolve_types(entities: DataFrame) -> DataFrame:
    """Extends and implements edges to the only class or interface of the name."""
    types = entities.filter(F.col("kind").isin(1, 2)).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "file_id")).alias("t")).filter("n = 1")
    rows = entities.filter(F.col("kind").isin(15, 16)).select("id", "file_id", "name", F.when(F.col("kind") == 15, EDGE["extends"]).otherwise(EDGE["implements"]).alias("kind"))
    return rows.join(types, "name", "left").select(F.col("id").alias("from_entity_id"), F.col("file_id").alias("from_file_id"), F.col("t.file_id").alias("to_file_id"), F.col("t.id").alias("to_entity_id"), "kind")


def resolve(files: DataFrame, entities: DataFrame, modules: list[tuple[str, str]] | None = None, scope: DataFrame | None = None) -> DataFrame:
    """resolved_edges with ids in (from entity, kind) order within each file. modules: Go's (path, folder); scope: ids
    of files, if only their outgoing edges are wanted: targets are looked for in all files."""
    sources = entities if scope is None else entities.join(scope.select(F.col("id").alias("file_id")), "file_id", "left_semi").filter(F.col("kind").isin(ENTITY["import"], ENTITY["call"], 15, 16)).unionByName(entities.filter(~F.col("kind").isin(ENTITY["import"], ENTITY["call"], 15, 16)))
    imports = cut(resolve_imports(files, sources, modules), "imports")
    types = entities.filter(F.col("kind").isin(1, 2)).unionByName(sources.filter(F.col("kind").isin(15, 16)))
    above = sources if scope is None else sources.unionByName(entities.join(scope.select(F.col("id").alias("file_id")), "file_id", "left_anti").filter(F.col("kind").isin(15, 16)))
    edges = imports.unionByName(resolve_calls(files, above, imports)).unionByName(resolve_types(types))
    place = F.row_number().over(Window.partitionBy("from_file_id").orderBy("from_entity_id", "kind", "to_file_id"))
    return edges.withColumn("resolved", F.col("to_file_id").isNotNull()).withColumn("id", F.col("from_file_id") * (1 << 24) + place).select("id", "from_file_id", "to_file_id", "kind", "resolved", "from_entity_id", "to_entity_id")


def scope_of(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): changed files (id) and those that an edge leads from to them."""
    users = edges.filter("resolved and to_file_id is not null").join(changed.select(F.col("id").alias("to_file_id")), "to_file_id", "left_semi").select(F.col("from_file_id").alias("id"))
    return changed.select("id").union(users).distinct()
