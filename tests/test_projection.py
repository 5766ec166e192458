"""The views of the benchmark tables: what queries write and exchange, and odd order lines."""

import datetime
from collections import Counter

from codeloom.operators import lookups as L
from codeloom.plans import projection as P

DAY = datetime.datetime(1997, 1, 1)


def made(spark, folder, lines):
    """A folder of tables with these (order, line, part, quantity, status) and ten parts."""
    rows = [(o, n, p, 1, q, "R" if q and q > 5 else "N", s, DAY) for o, n, p, q, s in lines]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(i, "Brand#1", "SMALL TIN", 3) for i in range(10)], "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_lines_and_edges_are_those_of_the_sql(spark, tmp_path):
    lines = [(1, 1, 1, 3.0, "F"), (1, 1, 1, 9.0, "F"), (1, 2, 2, 7.0, "F"), (1, 4, 3, 1.0, "F"), (7, 1, 1, 1.0, "F"), (7, 2, 4, 8.0, "F"), (7, 3, 4, 8.0, "F"), (7, 4, 5, 6.0, "O"), (14, 1, 6, None, "F"), (14, 2, 7, 8.0, None)]
    lines += [(None, 1, 1, 1.0, "F"), (None, 2, 2, 1.0, "F"), (2, None, 3, 1.0, "F"), (2, 1, 4, 1.0, "F"), (3, 1, None, 1.0, "F"), (3, 2, 5, 1.0, "F")]
    t = P.tables(spark, made(spark, tmp_path, lines))
    edges = Counter(map(tuple, t.resolved_edges.collect()))
    assert Counter(map(tuple, spark.sql(P.EDGES).collect())) == edges and len(edges) == 7
    spark.read.parquet(f"{tmp_path}/lineitem.parquet").createOrReplaceTempView("lineitem")
    assert Counter(map(tuple, spark.sql(P.LINES).collect())) == Counter(map(tuple, spark.table("p_lines").collect()))


def test_queries_write_only_the_tables_they_read(spark, sf):
    from codeloom.plans.queries import QUERIES

    P._WRITTEN.clear()
    QUERIES["detect_changes"](spark, sf).count()
    assert [list(x) for x in P._WRITTEN.values()] == [["lines"]]
    QUERIES["hotspots"](spark, sf).count()
    assert [list(x) for x in P._WRITTEN.values()] == [["lines", "files"]]


def test_changes_meet_in_one_exchange(spark):
    schema = "file_id long, name string, start_line int, end_line int"
    old = spark.createDataFrame([(1, "a", 1, 2), (1, "a", 5, 6), (1, "b", 1, 2), (2, "c", 3, None), (None, "d", 1, 1), (3, None, 1, 1)], schema)
    new = spark.createDataFrame([(1, "a", 5, 6), (1, "b", 1, 2), (2, "c", 3, 4), (4, "e", 1, 1), (None, "d", 1, 1), (3, None, 1, 1)], schema)
    assert exchanges(out := L.symbol_changes(old, new)) == 1
    want = [(1, "a", "modified"), (2, "c", "modified"), (4, "e", "added"), (None, "d", "added"), (None, "d", "removed"), (3, None, "added"), (3, None, "removed")]
    assert Counter(map(tuple, out.collect())) == Counter(want)


def test_paths_of_many_files_are_merged_and_not_broadcast(spark, tmp_path):
    folder = made(spark, tmp_path, [(1, 1, 1, 3.0, "F"), (1, 2, 2, 9.0, "F"), (1, 3, 3, 1.0, "F")])
    spark.range(100_001).selectExpr("id as p_partkey", "'Brand#1' as p_brand", "'SMALL TIN' as p_type", "10 as p_size").write.mode("overwrite").parquet(f"{folder}/part.parquet")
    t = P.tables(spark, folder)
    joined = [t._files(), L.with_path(t.entities, t.files), L.tests_for_file(t.resolved_edges, t.files, spark.createDataFrame([(3,)], "id long")), spark.sql("select * from entities e join files f on f.id = e.file_id"), t.community_members.join(t.entities, "file_id")]
    for df in joined:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert t.files.count() == 100_001 and [r.file for r in joined[2].collect()] == ["src/brand1/tests/part_2.go"]


def test_numbers_of_files_are_counted_in_one_exchange(spark, tmp_path):
    lines = [(1, 9, 1, 9.0, "F"), (1, 10, 2, 9.0, "F"), (1, 11, 1, 9.0, "F"), (2, 8, 1, 1.0, "F"), (3, 1, None, 1.0, "F"), (3, 2, 4, 1.0, "F"), (4, 1, 77, 1.0, "F"), (5, 1, 2, 1.0, "O")]
    folder = made(spark, tmp_path, lines)
    parts = [(1, "Brand#1", "SMALL TIN", 3), (1, "Brand#2", "SMALL TIN", 3), (2, "Brand#1", "SMALL TIN", 3), (3, "Brand#1", "SMALL TIN", 3), (4, "Brand#1", "SMALL TIN", 3), (None, "Brand#1", "SMALL TIN", 3)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int").write.mode("overwrite").parquet(f"{folder}/part.parquet")
    t = P.tables(spark, folder)
    assert exchanges(t._files()) == 1
    got = Counter((r.id, r.complexity, r.churn, r.fan_in, r.fan_out) for r in t.files.collect())
    assert got == Counter({(1, 3, 3, 1, 1): 2, (2, 2, 2, 1, 1): 1, (3, 1, 0, 0, 0): 1, (4, 1, 1, 0, 0): 1, (None, 1, 0, 0, 0): 1})
