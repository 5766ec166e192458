"""Lookups on symbols, edges and paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions import predicates as P
from codeloom.operators.graph import adjacency, neighbours, reachable
from codeloom.schema import DECLARATIONS, ENTITY


def resolve_file(files: DataFrame, query: str) -> DataFrame:
    """(id, path) of the file with this path, else of the first one in path order that ends in it."""
    hit = (F.col("path") == query) | F.col("path").endswith("/" + query) | F.col("path").endswith("\\" + query)
    return files.filter(hit).select("id", "path").orderBy((F.col("path") != query).cast("int"), "path").limit(1)


def with_path(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file")), "file_id")


def get_symbol(entities: DataFrame, files: DataFrame, name: str, file_id: int | None = None) -> DataFrame:
    """One row: classes and interfaces before functions, variables, parameters, others; then the smallest id."""
    rank = F.when(F.col("kind").isin(1, 2), 0).when(F.col("kind") == 0, 1).when(F.col("kind") == 3, 2).when(F.col("kind") == 4, 3).otherwise(4)
    rows = entities.filter((F.col("name") == name) & F.col("kind").isin(DECLARATIONS))
    if file_id is not None:
        rows = rows.filter(F.col("file_id") == file_id)
    return with_path(rows.withColumn("rank", rank).orderBy("rank", "id").limit(1), files).drop("rank")


def symbols_in_files(entities: DataFrame, files: DataFrame, ids: DataFrame) -> DataFrame:
    """Declarations of the files of ids (id), by file and entity id."""
    return with_path(entities.filter(F.col("kind").isin(DECLARATIONS)).join(ids.select(F.col("id").alias("file_id")), "file_id", "left_semi"), files)


def language_filter(lang: Column, name: str | None) -> Column:
    """typescript takes tsx too; an unknown name admits everything."""
    known = (name or "").lower()
    if known not in P.LANGUAGES:
        return F.lit(True)
    return lang.isin("typescript", "tsx") if known == "typescript" else lang == known


def filter_symbols(entities: DataFrame, files: DataFrame, kind: int | None = None, file: str | None = None, lang: str | None = None, min_complexity: int = 0, limit: int | None = None) -> DataFrame:
    rows = entities.filter(F.col("kind").isin(DECLARATIONS) if kind is None else F.col("kind") == kind)
    kept = files.filter(language_filter(F.col("lang"), lang) & (F.coalesce("complexity", F.lit(0)) >= min_complexity))
    if file:
        kept = kept.filter(F.col("path").endswith(file))
    out = with_path(rows, kept).orderBy("file", "id")
    return out.limit(max(limit, 1)) if limit is not None else out


def find_imports(edges: DataFrame, files: DataFrame, file_id: int) -> DataFrame:
    """(id, to, resolved, to_file_id) in edge order; an unresolved target is ''."""
    rows = edges.filter((F.col("kind") == 1) & (F.col("from_file_id") == file_id))
    paths = files.select(F.col("id").alias("to_file_id"), F.col("path").alias("to"))
    return rows.join(paths, "to_file_id", "left").select("id", F.coalesce("to", F.lit("")).alias("to"), "resolved", "to_file_id").orderBy("id")


def tests_for_file(edges: DataFrame, files: DataFrame, seeds: DataFrame) -> DataFrame:
    """(file): test files that import a seed, directly or not."""
    hit = reachable(adjacency(edges, reverse=True, kinds=[1]), seeds)
    return hit.join(files.filter("is_test_path"), "id").select(F.col("path").alias("file")).orderBy("file")


def blast_radius(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id): reached forwards or backwards."""
    ways = [reachable(adjacency(edges, reverse=r), seeds, max_depth).select("id") for r in (False, True)]
    return ways[0].union(ways[1]).distinct()


def paths_of(ids: DataFrame, files: DataFrame) -> DataFrame:
    return ids.join(files.select("id", "path"), "id").select(F.col("path").alias("file")).orderBy("file")


def context_pack(files: DataFrame, entities: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """(file, tier, weight): files whose path or a symbol matches a word of the query, then their neighbours, in
    reading order."""
    words = [w for w in query.split() if w]
    hit = lambda c: F.lit(False) if not words else reduce(lambda a, b: a | b, [F.lower(c).like(f"%{w.lower()}%") for w in words])
    by_path = files.filter(hit(F.col("path"))).select("id")
    by_name = entities.filter(F.col("kind").isin(DECLARATIONS) & hit(F.col("name"))).select(F.col("file_id").alias("id"))
    seeds = by_path.union(by_name).distinct()
    tiers = seeds.withColumn("tier", F.lit(0)).unionByName(neighbours(edges, seeds).withColumn("tier", F.lit(1)))
    weight = F.coalesce("complexity", F.lit(0)) + F.coalesce("churn", F.lit(0))
    return tiers.join(files, "id").select(F.col("path").alias("file"), "tier", weight.alias("weight")).orderBy("tier", F.desc("weight"), "file")


def named_symbols(entities: DataFrame, files: DataFrame, words: list[str], most: int = 200) -> DataFrame:
    """Declarations whose name is one of the words; for a word without any, most of those whose name holds it."""
    rows = with_path(entities.filter(F.col("kind").isin(DECLARATIONS)), files)
    if not words:
        return rows.limit(0)
    asked = F.broadcast(entities.sparkSession.createDataFrame([(w, w.lower()) for w in dict.fromkeys(words)], "word string, low string"))
    exact = rows.join(asked, F.col("name") == F.col("word"))
    missing = asked.join(exact.select("word").distinct(), "word", "left_anti")
    holding = rows.join(F.broadcast(missing), F.contains(F.lower("name"), F.col("low")))
    some = holding.withColumn("n", F.row_number().over(Window.partitionBy("word").orderBy("id"))).filter(F.col("n") <= most).drop("n")
    return exact.unionByName(some).drop("word", "low").dropDuplicates(["id"]).orderBy("file", "id")


def narrowest_enclosing(spans: DataFrame, entities: DataFrame) -> DataFrame:
    """(span_id, fn_id, fn_name): for each span (span_id, file_id, start_byte, end_byte) the shortest function around it.

    The file is an equality, so spans and functions meet by hash; the pair with least length is kept while aggregating,
    without a sort of all pairs.
    """
    fns = entities.filter(F.col("kind") == ENTITY["function"]).select("file_id", F.col("id").alias("fn_id"), F.col("name").alias("fn_name"), F.col("start_byte").alias("a"), F.col("end_byte").alias("b"))
    around = spans.join(fns, "file_id").filter("a <= start_byte and b >= end_byte")
    return around.groupBy("span_id").agg(F.min(F.struct((F.col("b") - F.col("a")).alias("length"), "fn_id", "fn_name")).alias("x")).select("span_id", "x.fn_id", "x.fn_name")


def symbol_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_id, name, change) of two sets of (file_id, name, start_line): added, removed or modified.

    The first span of a name counts. Both sets are exchanged together and meet in one aggregation by sorted keys; rows
    without a file or a name match none of the other set.
    """
    rows = lambda df, old: df.select("file_id", "name", F.struct("start_line", "end_line").alias("span"), F.lit(old).alias("old"))
    both = rows(old, True).unionByName(rows(new, False)).repartition("file_id", "name")
    lone = F.when(F.col("file_id").isNull() | F.col("name").isNull(), F.col("old"))
    ends = both.groupBy("file_id", "name", lone.alias("lone")).agg(F.min(F.when(F.col("old"), F.col("span"))).alias("was"), F.min(F.when(~F.col("old"), F.col("span"))).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    return ends.select("file_id", "name", change.alias("change")).filter("change is not null")


def classify_files(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status) of two listings (path, mtime, size): unchanged, changed, new or deleted; -1 is never unchanged."""
    a = stored.select("path", F.col("mtime").alias("m0"), F.col("size").alias("s0"))
    b = current.select("path", F.col("mtime").alias("m1"), F.col("size").alias("s1"))
    status = F.when(F.col("s0").isNull(), "new").when(F.col("s1").isNull(), "deleted").when((F.col("m0") == F.col("m1")) & (F.col("s0") == F.col("s1")) & (F.col("m1") != -1), "unchanged").otherwise("changed")
    return a.join(b, "path", "full").select("path", status.alias("status"))


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
