"""The stored index: Parquet tables below one folder, replaced as a whole, with a ledger beside them."""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import predicates as P
from codeloom.operators import extract as E
from codeloom.operators import graph as G
from codeloom.operators import metrics as M
from codeloom.operators.lineage import cut
from codeloom.operators.lookups import classify_files
from codeloom.operators.resolve import resolve
from codeloom.schema import Tables
from codeloom.sources import files as S

VERSION = 1
TABLES = ["files", "entities", "symbols", "diagnostics", "resolved_edges", "community_members", "clone_bands", "clone_band_members"]


def clone_tables(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clone_bands, clone_band_members): entities that share a band value of their signature."""
    rows = entities.filter("body_minhash is not null").select("id", F.posexplode("body_minhash").alias("band", "value"))
    bands = rows.groupBy("band", "value").agg(F.countDistinct("id").alias("n"), F.min("id").alias("first")).filter("n > 1").withColumn("id", F.xxhash64("band", "value"))
    members = rows.join(bands.select("band", "value", F.col("id").alias("band_id")), ["band", "value"]).select("band_id", F.col("id").alias("entity_id"))
    return bands.select("id", F.concat(F.lit("clone-band-"), F.col("first").cast("string"), F.lit("-"), F.col("band").cast("string")).alias("label")), members


def derive(files: DataFrame, entities: DataFrame, symbols: DataFrame, diagnostics: DataFrame, churn: DataFrame, modules: list[tuple[str, str]] | None = None) -> Tables:
    """All tables from the raw ones; files: id, path, mtime, size, content_hash, lang."""
    files = files.withColumns({"is_test_path": P.is_test_path(F.col("path")), "is_tooling_path": P.is_tooling_path(F.col("path"))})
    edges = cut(resolve(files, entities, modules), "edges")
    members = G.communities(files, edges)
    full = files.join(M.complexity(files, entities), "id").join(M.fan_metrics(files, edges), "id").join(churn, "path", "left").fillna(0, ["churn"]).join(members.withColumnRenamed("file_id", "id"), "id", "left")
    bands, band_members = clone_tables(entities)
    return Tables(full, entities, edges, members, symbols, diagnostics, bands, band_members)


def write(tables: Tables, path: str, rev: int) -> None:
    """Beside the old index, then in its place: a reader sees one or the other."""
    fresh = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    for name in TABLES:
        getattr(tables, name).write.parquet(f"file://{fresh}/{name}")
    with open(f"{fresh}/ledger.json", "w") as f:
        json.dump({"version": VERSION, "rev": rev, "slices": {s: rev for s in ("raw", "imports", "edges", "global", "churn")}}, f)
    old = f"{path}.{uuid.uuid4().hex[:8]}.old"
    if os.path.isdir(path):
        os.rename(path, old)
    os.rename(fresh, path)
    shutil.rmtree(old, ignore_errors=True)


def ledger(path: str) -> dict | None:
    try:
        with open(f"{path}/ledger.json") as f:
            return json.load(f)
    except (OSError, ValueError):
        return None


def load(spark: SparkSession, path: str) -> Tables:
    return Tables(**{name: spark.read.parquet(f"file://{os.path.abspath(path)}/{name}") for name in TABLES})


#: What each layer is made from, and what each mode needs: the lowest layers first.
SLICES = {"raw": (), "imports": ("raw",), "edges": ("raw", "imports"), "global": ("raw", "imports", "edges"), "churn": ()}
_EDGES = ("dependencies", "dependents", "blast_radius", "symbol_blast_radius", "tests_for_file", "explore", "map_file", "map_path", "type_hierarchy")
NEEDS = {m: ("raw",) for m in ("symbols_in_file", "symbols_in_files", "get_symbol", "filter_symbols", "map_symbol")} | {"find_imports": ("imports",)} | {m: ("edges",) for m in _EDGES} | {"clusters": ("global",), "hotspots": ("raw", "churn"), "context_pack": ("edges", "churn"), "nav_map": ("raw", "edges", "global", "churn"), "detect_changes": ()}
LOCK_WAIT, LOCK_FIRST = 60.0, 0.05


@contextlib.contextmanager
def locked(path: str, wait: float = LOCK_WAIT):
    """One writer of an index at a time on this host: others ask again, ever less often, and give up after wait seconds."""
    import fcntl

    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.lock", "w") as f:
        pause, end = LOCK_FIRST, time.monotonic() + wait
        while True:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if time.monotonic() >= end:
                    raise TimeoutError(f"another build holds {path}") from None
                time.sleep(pause)
                pause = min(pause * 2, 1.0)
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


def ensure_fresh(spark: SparkSession, root: str, path: str, slices: tuple[str, ...], memo: set | None = None) -> dict | None:
    """Bring what slices are made from up to date; nothing where a batch has done the same already (memo). All layers of
    one index carry one revision, so that no query sees layers of different ones."""
    plan = (root, path, tuple(sorted({x for s in slices for x in (s, *SLICES[s])})))
    if not slices or memo is not None and plan in memo:
        return None
    done = build(spark, root, path)
    if memo is not None:
        memo.add(plan)
    return done


def sources_of(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """(path, text) of indexed files with a language, read by the executors; undecodable ones have no text."""
    read = S.with_contents(spark, root, files.filter("lang is not null").select("path", "mtime", "size"))
    return cut(read.select("path", F.try_validate_utf8(F.decode("content", "UTF-8")).alias("text")), "sources")


def extract_counts(spark: SparkSession, path: str) -> dict:
    """Extraction of a tree without an index: rows of each table, and what went wrong."""
    entities, symbols, diagnostics = E.split(E.parse(S.with_contents(spark, path)))
    said = [r.asDict() for r in diagnostics.orderBy("id").limit(1000).collect()]
    return {"entities": entities.count(), "symbols": symbols.count(), "diagnostics": said}


def counts(tables: Tables) -> dict:
    return {name: getattr(tables, name).count() for name in ("files", "entities", "symbols", "diagnostics")}


def build(spark: SparkSession, root: str, path: str, force: bool = False, only: list[str] | None = None) -> dict:
    """Bring the index up to date. Unchanged files keep their parsed rows; nothing happens where nothing changed. only:
    the paths that are looked at, whatever has become of the others."""
    path = os.path.abspath(path)
    with locked(path):
        return _build(spark, root, path, force, only)


def _build(spark: SparkSession, root: str, path: str, force: bool, only: list[str] | None) -> dict:
    now, state = S.listing(spark, root), ledger(path)
    if only is not None and state is not None:
        asked = F.broadcast(spark.createDataFrame([(p,) for p in only], "path string"))
        rest = load(spark, path).files.select("path", "mtime", "size").join(asked, "path", "left_anti")
        now = cut(now.join(asked, "path", "left_semi").select("path", "mtime", "size").unionByName(rest), "listing")
    fresh = force or state is None or state.get("version") != VERSION
    counts = {"new": 0, "changed": 0, "deleted": 0, "unchanged": 0}
    listed = S.with_contents(spark, root, now)
    if fresh:
        parse_of, old = listed, None
        counts["new"] = now.count()
    else:
        stored = load(spark, path)
        status = cut(classify_files(stored.files, now), "status")
        counts |= {r.status: r["count"] for r in status.groupBy("status").count().collect()}
        if counts["unchanged"] == sum(counts.values()):
            return counts | {"rev": state["rev"], "written": False}
        parse_of = listed.join(status.filter("status in ('new', 'changed')").select("path"), "path", "left_semi")
        kept = stored.files.join(status.filter("status = 'unchanged'").select("path"), "path", "left_semi").select(F.col("id").alias("old_id"), "path")
        old = stored, kept.join(listed.select("path", "id"), "path").select("old_id", "id")
    tagged = E.parse(parse_of)
    if old is not None:
        stored, moved = old
        for tag, df in (("e", stored.entities), ("s", stored.symbols), ("d", stored.diagnostics)):
            same = df.withColumnRenamed("file_id", "old_id").withColumnRenamed("id", "seq").join(moved.withColumnRenamed("id", "file_id"), "old_id")
            missing = [f for f in tagged.schema if f.name not in same.columns]
            tagged = tagged.unionByName(same.withColumn("tag", F.lit(tag)).withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing if f.name != "tag"}).select([F.col(f.name).cast(f.dataType) for f in tagged.schema]))
    entities, symbols, diagnostics = E.split(tagged)
    raw = cut(listed.select("id", "path", "mtime", "size", "content_hash", "lang"), "files")
    rev = (state or {}).get("rev", 0) + 1
    write(derive(raw, cut(entities, "entities"), symbols, diagnostics, S.churn(spark, root), S.go_modules(root)), path, rev)
    return counts | {"rev": rev, "written": True}
