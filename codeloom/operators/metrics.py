"""Aggregations over the code graph: fans, complexity, rankings, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import predicates as P
from codeloom.schema import ENTITY


def complexity(files: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, complexity): one and the number of control-flow entities of the file."""
    hits = entities.filter(F.col("kind") == ENTITY["control_flow"]).groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("hits"))
    return files.select("id").join(hits, "id", "left").select("id", (1 + F.coalesce("hits", F.lit(0))).alias("complexity"))


def fan_metrics(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out): resolved references from and to a file, its own included.

    Both ends of an edge are counted in one aggregation, so that there is one exchange of counts and one of files.
    """
    ends = edges.filter("resolved").select(F.explode(F.array(F.struct(F.col("to_file_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("from_file_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x")).select("x.*")
    sums = ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return files.select("id").join(sums, "id", "left").fillna(0, ["fan_in", "fan_out"])


def file_counts(entities: DataFrame, edges: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, hits, churn, fan_in, fan_out) of the files that have any: control-flow entities, changes (one row each, by
    file_id) and resolved references, as complexity and fan_metrics count them.

    All are counted in one aggregation of numbers, so that there is one exchange of counts and a task holds one row a file.
    """
    names = ("hits", "churn", "fan_in", "fan_out")
    one = lambda end, name: F.struct(F.col(end).alias("id"), *[F.lit(int(n == name)).alias(n) for n in names])
    ends = edges.filter("resolved").select(F.explode(F.array(one("to_file_id", "fan_in"), one("from_file_id", "fan_out"))).alias("x"))
    hits = entities.filter(F.col("kind") == ENTITY["control_flow"]).select(one("file_id", "hits").alias("x"))
    rows = ends.union(hits).union(changes.select(one("file_id", "churn").alias("x"))).select("x.*")
    return rows.groupBy("id").agg(*[F.sum(n).alias(n) for n in names])


def distinct_dependents(edges: DataFrame) -> DataFrame:
    """(id, dependents, dependencies): different other files on either side."""
    pairs = edges.filter("resolved and from_file_id <> to_file_id").select("from_file_id", "to_file_id").distinct()
    ends = pairs.select(F.explode(F.array(F.struct(F.col("to_file_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("from_file_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x")).select("x.*")
    return ends.groupBy("id").agg(F.sum("i").alias("dependents"), F.sum("o").alias("dependencies"))


def hotspots(files: DataFrame, limit: int | None = None) -> DataFrame:
    """(file, complexity, churn, score): complexity times churn, or complexity alone where churn is the same everywhere
    among the files that remain without tests, generated and unknown ones."""
    kept = files.filter(~F.col("is_test_path") & ~P.is_generated_path(F.col("path")) & F.col("lang").isNotNull())
    spread = kept.agg((F.min("churn") < F.max("churn")).alias("varies"))
    score = F.when(F.col("varies"), F.col("complexity") * F.col("churn")).otherwise(F.col("complexity"))
    out = kept.crossJoin(F.broadcast(spread)).select(F.col("path").alias("file"), "complexity", "churn", score.alias("score")).orderBy(F.desc("score"), "file")
    return out.limit(limit) if limit else out


def data_class_files(entities: DataFrame) -> DataFrame:
    """(id) of files with functions, all of them trivial."""
    return entities.filter(F.col("kind") == ENTITY["function"]).groupBy(F.col("file_id").alias("id")).agg(F.bool_and(P.is_trivial_method(F.col("name"))).alias("t")).filter("t").select("id")


def foundational_files(files: DataFrame, entities: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    """The files that most others depend on; data classes come last."""
    data = data_class_files(entities).withColumn("data_class", F.lit(True))
    ranked = files.filter(~F.col("is_test_path") & ~P.is_noise_path(F.col("path"))).join(distinct_dependents(edges), "id").join(data, "id", "left").fillna(False, ["data_class"])
    return ranked.filter("dependents > 0").select(F.col("path").alias("file"), "dependents", "fan_in", "data_class").orderBy("data_class", F.desc("dependents"), F.desc("fan_in"), "file").limit(limit)


def symbol_breadth(files: DataFrame, entities: DataFrame, edges: DataFrame, limit: int = 100) -> DataFrame:
    """(name, file, breadth, total) of the entities called from most files."""
    calls = edges.filter("resolved and kind = 0 and to_entity_id is not null").groupBy(F.col("to_entity_id").alias("id")).agg(F.countDistinct("from_file_id").alias("breadth"), F.count(F.lit(1)).alias("total"))
    named = entities.join(calls, "id").filter(~P.is_low_orientation(F.col("name")))
    shown = files.filter("not is_test_path").select(F.col("id").alias("file_id"), F.col("path").alias("file"))
    return named.join(shown, "file_id").select("id", "name", "file", "breadth", "total").orderBy(F.desc("breadth"), F.desc("total"), "file", "name", "id").limit(limit)


def cluster_cohesion(members: DataFrame, edges: DataFrame, min_size: int = 2, min_cohesion: float = 0.0) -> DataFrame:
    """(community_id, size, internal, external, cohesion): edges inside over edges that touch the community."""
    sizes = members.groupBy("community_id").agg(F.count(F.lit(1)).alias("size"))
    side = lambda end: members.select(F.col("file_id").alias(f"{end}_file_id"), F.col("community_id").alias(end))
    both = edges.filter("resolved").join(side("from"), "from_file_id").join(side("to"), "to_file_id").groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"))
    touched = both.select(F.explode(F.when(F.col("from") == F.col("to"), F.array("from")).otherwise(F.array("from", "to"))).alias("community_id"), F.when(F.col("from") == F.col("to"), F.col("n")).otherwise(0).alias("i"), F.when(F.col("from") != F.col("to"), F.col("n")).otherwise(0).alias("e"))
    sums = touched.groupBy("community_id").agg(F.sum("i").alias("internal"), F.sum("e").alias("external"))
    out = sizes.join(sums, "community_id", "left").fillna(0, ["internal", "external"])
    out = out.withColumn("cohesion", F.when(F.col("internal") + F.col("external") > 0, F.col("internal") / (F.col("internal") + F.col("external"))).otherwise(F.lit(0.0)))
    return out.filter((F.col("size") >= min_size) & (F.col("cohesion") >= min_cohesion)).orderBy(F.desc("cohesion"), F.desc("size"), "community_id")


def module_edges(files: DataFrame, edges: DataFrame, least: int = 3, depth: int = 2) -> DataFrame:
    """(from_module, to_module, crossings): different file pairs between two directories, three at least."""
    module = lambda end: files.select(F.col("id").alias(f"{end}_file_id"), F.substring_index("path", "/", depth).alias(f"{end}_module"))
    pairs = edges.filter("resolved").select("from_file_id", "to_file_id").distinct()
    return pairs.join(module("from"), "from_file_id").join(module("to"), "to_file_id").filter("from_module <> to_module").groupBy("from_module", "to_module").agg(F.count(F.lit(1)).alias("crossings")).filter(F.col("crossings") >= least)


def clone_bands(signatures: DataFrame, least: int = 2) -> DataFrame:
    """(band, value, size, label) of (id, body_minhash): band values that entities share, and the least of their ids."""
    rows = signatures.filter("body_minhash is not null").select("id", F.posexplode("body_minhash").alias("band", "value"))
    return rows.groupBy("band", "value").agg(F.countDistinct("id").alias("size"), F.min("id").alias("label")).filter(F.col("size") >= least)


def clone_band_members(signatures: DataFrame, least: int = 2) -> DataFrame:
    """(band, value, id): each entity of each of the clone bands."""
    rows = signatures.filter("body_minhash is not null").select("id", F.posexplode("body_minhash").alias("band", "value")).distinct()
    return rows.join(clone_bands(signatures, least).select("band", "value"), ["band", "value"]).select("band", "value", "id")
