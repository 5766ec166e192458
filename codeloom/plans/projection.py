"""Code-graph views over the benchmark tables, so that every operator runs on them and DuckDB can check it.

DuckDB takes all views as SQL text, Spark those of paths, kinds and entities; lines and edges it makes by one exchange
(_lines), and what it counts of files by another (file_counts). Only constructs that mean the same in both are used. A part
is a file, a line item an entity, and parts on neighbouring lines of an order are linked. Spark writes lines and files once
a session and input, as an index would be, and later queries read them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions import predicates as P
from codeloom.operators.lineage import exists, shared_folder
from codeloom.schema import Tables

PATHS = """SELECT p_partkey AS id, 'src/' || lower(replace(p_brand, '#', '')) || '/' ||
  CASE WHEN p_size % 10 = 0 THEN 'tests' WHEN p_size % 17 = 0 THEN 'vendor' WHEN p_size % 17 = 3 THEN 'scripts' WHEN p_size % 17 = 5 THEN 'assets' WHEN p_size % 17 = 7 THEN 'templates'
       WHEN p_size % 17 = 9 THEN 'db/migrations/versions' ELSE lower(replace(p_type, ' ', '_')) END || '/part_' || CAST(p_partkey AS STRING) ||
  CASE WHEN p_partkey % 5 = 1 AND p_size % 6 = 0 THEN '.gen.ts' WHEN p_partkey % 5 = 2 AND p_size % 6 = 0 THEN '_test.go' WHEN p_partkey % 5 = 2 AND p_size % 6 = 1 THEN '.pb.go'
       WHEN p_partkey % 5 = 0 THEN '.py' WHEN p_partkey % 5 = 1 THEN '.ts' WHEN p_partkey % 5 = 2 THEN '.go' WHEN p_partkey % 5 = 3 THEN '.java' ELSE '.txt' END AS path,
  p_partkey % 25 AS community_id FROM part"""

#: One row for each order line: duplicates of the key are folded.
LINES = """SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s, CAST(min(l_quantity) AS BIGINT) AS q,
  min(l_returnflag) AS rf, min(l_linestatus) AS ls FROM lineitem GROUP BY l_orderkey, l_linenumber"""

KINDED = """SELECT o * 10 + n AS id, p AS file_id, o, n, s, q,
  CASE WHEN (o + n) % 16 < 5 THEN 0 WHEN (o + n) % 16 < 9 THEN 6 WHEN (o + n) % 16 < 12 THEN 12 WHEN (o + n) % 16 = 12 THEN 1 WHEN (o + n) % 16 = 13 THEN 2 WHEN (o + n) % 16 = 14 THEN 16 ELSE 15 END AS kind FROM p_lines"""

#: Type k extends type k / 2 (rounded down), so that the hierarchy is a tree seven deep. Every other interface has a name
#: of its own, and half of the implements entities name the one on the line before, if there is one; so it is with some
#: functions and calls.
ENTITIES = """SELECT id, kind, file_id,
  CASE WHEN kind = 0 AND (o + n) % 16 = 4 AND q % 2 = 1 THEN 'fu' || CAST(id AS STRING) WHEN kind = 6 AND (o + n) % 16 = 5 THEN 'fu' || CAST(id - 1 AS STRING)
       WHEN kind IN (0, 6) THEN CASE WHEN s % 7 = 0 THEN 'getItem' ELSE 'fn' || CAST(s % 40 AS STRING) END WHEN kind = 12 THEN 'if'
       WHEN kind = 2 AND q % 2 = 0 THEN 'I' || CAST(id AS STRING) WHEN kind = 16 AND q % 2 = 0 THEN 'I' || CAST(id - 1 AS STRING)
       WHEN kind IN (1, 2) THEN 'T' || CAST(s % 64 AS STRING) WHEN kind = 15 THEN 'T' || CAST(CAST((s % 64 - s % 2) / 2 AS BIGINT) AS STRING) ELSE 'T' || CAST(o % 64 AS STRING) END AS name,
  n * 1000 + 10 * q AS start_byte, n * 1000 + 10 * q + CASE WHEN kind = 0 THEN 400 WHEN kind IN (1, 2) THEN 3000 ELSE 5 END AS end_byte,
  n * 20 + q AS start_line, n * 20 + q + CASE WHEN kind = 0 THEN q % 12 ELSE 0 END AS end_line,
  CASE WHEN kind IN (6, 12) THEN 'fn' || CAST(o % 40 AS STRING) WHEN kind = 15 THEN 'T' || CAST(s % 64 AS STRING) WHEN kind = 16 THEN 'T' || CAST(s % 8 AS STRING) END AS enclosing_function,
  CASE WHEN n % 3 = 0 THEN NULL ELSE 'T' || CAST(s % 8 AS STRING) END AS owner_type FROM p_kinded"""

#: Neighbouring lines of an order are linked; in every seventh order in both directions.
EDGES = """SELECT o * 100 + n * 10 + m AS id, p AS from_file_id, CASE WHEN ok THEN p2 END AS to_file_id, kind, ok AS resolved, o * 10 + n AS from_entity_id, CASE WHEN ok THEN o * 10 + m END AS to_entity_id FROM (
  SELECT a.o, a.n, b.n AS m, a.p, b.p AS p2, CASE WHEN a.rf = 'R' THEN 1 ELSE 0 END AS kind, b.ls = 'F' AS ok FROM p_lines a JOIN p_lines b ON b.o = a.o AND b.n = a.n + 1 WHERE a.p <> b.p
  UNION ALL SELECT a.o, b.n, a.n, b.p, a.p, CASE WHEN a.rf = 'R' THEN 1 ELSE 0 END, b.ls = 'F' FROM p_lines a JOIN p_lines b ON b.o = a.o AND b.n = a.n + 1 WHERE a.p <> b.p AND a.o % 7 = 0) x"""

CHURN = """SELECT l_partkey AS file_id, count(*) AS churn FROM lineitem WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 90 DAY GROUP BY l_partkey"""


def like_sql(patterns: list[str]) -> str:
    """The patterns as DuckDB takes them."""
    return "(" + " OR ".join("path ILIKE '{}'{}".format(p, " ESCAPE '\\'" if "\\" in p else "") for p in patterns) + ")"


def oracle_prefix() -> str:
    """CTEs of all views, for DuckDB."""
    langs = " ".join(f"WHEN '{e}' THEN '{P.EXTENSIONS[e]}'" for e in ("py", "ts", "go", "java"))
    return f"""WITH RECURSIVE p_paths AS ({PATHS}), p_lines AS ({LINES}), p_kinded AS ({KINDED}), entities AS ({ENTITIES}), resolved_edges AS ({EDGES}), p_churn AS ({CHURN}),
p_cx AS (SELECT file_id, count(*) AS c FROM entities WHERE kind = 12 GROUP BY file_id),
p_in AS (SELECT to_file_id AS id, count(*) AS c FROM resolved_edges WHERE resolved GROUP BY to_file_id), p_out AS (SELECT from_file_id AS id, count(*) AS c FROM resolved_edges WHERE resolved GROUP BY from_file_id),
files AS (SELECT p.id, p.path, p.community_id, {like_sql(P.TEST_PATHS)} AS is_test_path, {like_sql(P.TOOLING_PATHS)} AS is_tooling_path, CASE regexp_extract(p.path, '\\.([a-z]+)$', 1) {langs} END AS lang,
  1 + coalesce(x.c, 0) AS complexity, coalesce(h.churn, 0) AS churn, coalesce(i.c, 0) AS fan_in, coalesce(o.c, 0) AS fan_out
  FROM p_paths p LEFT JOIN p_cx x ON x.file_id = p.id LEFT JOIN p_churn h ON h.file_id = p.id LEFT JOIN p_in i ON i.id = p.id LEFT JOIN p_out o ON o.id = p.id)
"""


#: EDGES as Spark takes them from lines that know the next one of their order, so that lines meet without a join.
_LINKS = """SELECT o * 100 + n * 10 + m AS id, p AS from_file_id, CASE WHEN ok THEN p2 END AS to_file_id, kind, ok AS resolved, o * 10 + n AS from_entity_id, CASE WHEN ok THEN o * 10 + m END AS to_entity_id FROM (
  SELECT o, n, n2 AS m, p, p2, CASE WHEN rf = 'R' THEN 1 ELSE 0 END AS kind, ls2 = 'F' AS ok FROM p_links
  UNION ALL SELECT o, n2, n, p2, p, CASE WHEN rf = 'R' THEN 1 ELSE 0 END, ls2 = 'F' FROM p_links WHERE o % 7 = 0) x"""

#: The order lines that CHURN counts, before they are counted.
_CHANGES = "SELECT l_partkey AS file_id FROM lineitem WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 90 DAY"

#: (application, input, shared folder): the tables that this session has written.
_WRITTEN: dict[tuple[str, str, str], dict[str, str]] = {}

#: Files up to which their paths may be broadcast. Spark goes by the size of the table's file, and in memory paths take some
#: thirty times that; more are merged by exchange.
BROADCAST_FILES = 100_000
_PARTS: dict[tuple[str, str, str], int] = {}


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LINES, each with the next line of its order: n2, p2, ls2. Order lines are exchanged once, by their order; folding
    and the look ahead share that exchange and one sort."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls")
    )
    lines = rows.repartition("o").groupBy("o", "n").agg(F.min("p").alias("p"), F.min("s").alias("s"), F.min("q").cast("long").alias("q"), F.min("rf").alias("rf"), F.min("ls").alias("ls"))
    order = Window.partitionBy("o").orderBy("n")
    return lines.select("*", F.lead("n").over(order).alias("n2"), F.lead("p").over(order).alias("p2"), F.lead("ls").over(order).alias("ls2"))


class Projection(Tables):
    """The tables of an input. Lines are written once a session, and files when a query first asks for them; entities and
    edges are columns of lines, and each query reads the ones it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._sf_dir = spark, sf_dir
        self._key = (spark.sparkContext.applicationId, sf_dir, shared_folder(spark))
        lines = self._written("lines", lambda: _lines(spark, sf_dir))
        lines.select("o", "n", "p", "s", "q", "rf", "ls").createOrReplaceTempView("p_lines")
        lines.filter("n2 = n + 1 and p <> p2 and o is not null").createOrReplaceTempView("p_links")
        spark.sql(KINDED).createOrReplaceTempView("p_kinded")
        spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("part")
        self._paths = self._merged(spark.sql(PATHS))
        self._paths.createOrReplaceTempView("p_paths")
        self.entities, self.resolved_edges = spark.sql(ENTITIES), spark.sql(_LINKS)
        self.community_members = self._paths.select("community_id", F.col("id").alias("file_id"))
        for name in ("entities", "resolved_edges", "community_members"):
            getattr(self, name).createOrReplaceTempView(name)

    @property
    def files(self) -> DataFrame:
        out = self._merged(self._written("files", self._files))
        out.createOrReplaceTempView("files")
        return out

    def _files(self) -> DataFrame:
        from codeloom.operators.metrics import file_counts

        self._spark.read.parquet(f"{self._sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
        counts = file_counts(self.entities, self.resolved_edges, self._spark.sql(_CHANGES))
        n = lambda name: F.coalesce(name, F.lit(0))
        files = self._paths.join(counts, "id", "left").select("id", "path", "community_id", (1 + n("hits")).alias("complexity"), *[n(x).alias(x) for x in ("churn", "fan_in", "fan_out")])
        return files.withColumns({"is_test_path": P.is_test_path(F.col("path")), "is_tooling_path": P.is_tooling_path(F.col("path")), "lang": P.language(F.col("path"))})

    def _merged(self, paths: DataFrame) -> DataFrame:
        """A table of one row a file, never broadcast if it has more than BROADCAST_FILES."""
        if self._key not in _PARTS:
            _PARTS[self._key] = self._spark.table("part").count()
        return paths.hint("merge") if _PARTS[self._key] > BROADCAST_FILES else paths

    def _written(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        known = _WRITTEN.setdefault(self._key, {})
        if not (name in known and exists(self._spark, f"{known[name]}/_SUCCESS")):
            path = f"{shared_folder(self._spark)}/projection-{name}-{uuid.uuid4().hex}"
            make().write.parquet(path)
            known[name] = path
        return self._spark.read.parquet(known[name])


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Projection(spark, sf_dir)
