import os
import random
import subprocess

import pytest

from codeloom.functions import hashing as H
from codeloom.functions import predicates as P
from codeloom.operators import graph as G
from codeloom.operators import patterns, rules
from codeloom.plans import index, modes, navmap, scan
from codeloom.schema import ENTITY


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    files = {
        "app/main.py": "from app.core import run\nimport app.util as u\n\ndef main():\n    if u.ready():\n        return run()\n",
        "app/core.py": "from .util import ready\n\nclass Base:\n    pass\n\nclass Job(Base):\n    def go(self, n):\n        for i in range(n):\n            if i:\n                ready()\n        return n\n\ndef run():\n    return Job().go(3)\n",
        "app/util.py": "def ready():\n    return True\n",
        "tests/test_core.py": "from app.core import run\n\ndef test_run():\n    assert run() == 3\n",
        "web/a.ts": "import { b } from './b';\nexport class A extends B implements I {\n  go(): void {\n    if (b()) { this.x(); }\n  }\n}\n",
        "web/b.ts": "export function b(): boolean {\n  return true; // if (x) {\n}\n",
        "bad.py": "def broken(:\n",
        ".gitignore": "skipped/\n*.log\n",
        "skipped/x.py": "x = 1\n",
        "a.log": "no",
    }
    for p, t in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    git("init", "-q"), git("add", "."), git("commit", "-qm", "one")
    return root


@pytest.fixture(scope="module")
def built(spark, repo, tmp_path_factory):
    db = str(tmp_path_factory.mktemp("db") / "index")
    first = index.build(spark, str(repo), db)
    assert first["written"] and first["new"] == 8
    return db


def test_index_and_modes(spark, repo, built):
    ask = lambda mode, **q: modes.run_query(spark, {"mode": mode, "dbPath": built, "repoRoot": str(repo), **q})
    t = index.load(spark, built)
    assert {r.path for r in t.files.collect()} == {".gitignore", "app/core.py", "app/main.py", "app/util.py", "bad.py", "tests/test_core.py", "web/a.ts", "web/b.ts"}
    assert [d.severity for d in t.diagnostics.join(t.files.selectExpr("id as file_id", "path"), "file_id").filter("path = 'bad.py'").collect()] == ["warning"]
    assert ask("dependencies", filePath="app/main.py")["data"] == ["app/core.py", "app/util.py"]
    assert ask("dependents", filePath="app/util.py")["data"] == ["app/core.py", "app/main.py", "tests/test_core.py"]
    assert ask("tests_for_file", filePath="util.py")["data"] == ["tests/test_core.py"]
    assert ask("dependencies", filePath="web/a.ts")["data"] == ["web/b.ts"]
    assert ask("map_path", sourceFile="tests/test_core.py", targetFile="app/util.py")["data"] == ["tests/test_core.py", "app/core.py", "app/util.py"]
    assert ask("type_hierarchy", name="Job")["data"]["supertypes"] == ["Base"]
    assert ask("get_symbol", name="Job")["data"]["file"] == "app/core.py"
    assert [r["name"] for r in ask("symbols_in_file", filePath="app/util.py")["data"] if "owner_type" in r] == ["ready"]
    body = ask("symbols_in_file", filePath="app/util.py", includeBody=True)["data"][0]["body"]
    assert body == "def ready():\n    return True"
    spots = {r["file"]: r for r in ask("hotspots")["data"]}
    # for, if and two returns
    assert spots["app/core.py"]["complexity"] == 5 and spots["app/core.py"]["churn"] == 1 and "tests/test_core.py" not in spots
    assert ask("find_imports", filePath="app/core.py")["data"][0]["to"] == "app/util.py"
    assert ask("get_symbol", name="nope")["data"]["error"]["code"] == "not_found"
    assert ask("what")["data"]["error"]["code"] == "unknown_mode"
    both = ask("batch", calls=[{"mode": "map_file", "filePath": "app/core.py"}, {"mode": "explore", "input": "ready"}, {"mode": "context_pack", "query": "core"}, {"mode": "slice_state"}, {"mode": "clusters"}, {"mode": "map_symbol", "name": "run"}])["data"]
    assert [x["ok"] for x in both] == [True] * 6 and both[0]["data"]["dependents"] == 2
    assert ask("nav_map", maxTokensEstimate=300)["data"]["guide"]["estimate"] <= 300
    found = ask("find_pattern", pattern="$X().go($$$A)", path=str(repo))["data"]["matches"]
    assert [(m["file"], m["captures"]) for m in found] == [("app/core.py", {"X": "Job", "A": "3"})]
    assert ask("scan")["ok"]


def test_incremental_equals_full(spark, repo, built, tmp_path):
    assert not index.build(spark, str(repo), built)["written"]
    # exceptions and literals are rows that no table keeps: they must not move the ids of what comes after them
    (repo / "app/util.py").write_text("import os\n\ndef ready():\n    try:\n        return os.sep == '/'\n    except OSError:\n        raise ValueError('x')\n\ndef more():\n    return 1\n")
    (repo / "web/b.ts").unlink()
    got = index.build(spark, str(repo), built)
    assert (got["changed"], got["deleted"], got["written"]) == (1, 1, True)
    changes = modes.run_query(spark, {"mode": "detect_changes", "dbPath": built, "repoRoot": str(repo)})["data"]
    assert {c["file"] for c in changes} == {"app/util.py", "web/b.ts"}
    full = str(tmp_path / "full")
    index.build(spark, str(repo), full)
    a, b = index.load(spark, built), index.load(spark, full)
    for name in ("entities", "resolved_edges", "symbols"):
        key = lambda df: sorted(map(repr, df.collect()))
        assert key(getattr(a, name)) == key(getattr(b, name).select(*getattr(a, name).columns)), name
    os.utime(repo / "app/core.py")


def graph(spark, n, edges):
    return spark.createDataFrame([(i, a, b, 1, True, None, None) for i, (a, b) in enumerate(edges)], "id long, from_file_id long, to_file_id long, kind int, resolved boolean, from_entity_id long, to_entity_id long")


@pytest.mark.parametrize("local", [True, False])
def test_traversals(spark, local):
    old = G.LOCAL_EDGES
    G.LOCAL_EDGES = old if local else 1
    try:
        ids = lambda df: sorted(r.id for r in df.collect())
        one = lambda i: spark.createDataFrame([(i,)], "id long")
        cycle = graph(spark, 3, [(0, 1), (1, 2), (2, 0)])
        assert ids(G.reachable(G.adjacency(cycle), one(0))) == [1, 2]
        fan = graph(spark, 3, [(0, 1), (0, 2), (1, 2)])
        assert ids(G.reachable(G.adjacency(fan), one(0), 1)) == [1, 2]
        assert ids(G.reachable(G.adjacency(fan, reverse=True), one(2))) == [0, 1]
        assert ids(G.reachable(G.adjacency(fan, reverse=True), one(0))) == []
        chain = graph(spark, 7, [(i, i + 1) for i in range(6)] + [(0, 3)])
        assert G.shortest_path(chain, 0, 6) == [0, 3, 4, 5, 6]
        assert G.shortest_path(chain, 6, 0) == []
    finally:
        G.LOCAL_EDGES = old


def test_spread_communities(spark):
    """The distributed moves find two cliques and leave lone files alone; communities are numbered by their least path."""
    two = [(a, b) for c in (range(0, 6), range(6, 12)) for a in c for b in c if a < b] + [(0, 6)]
    edges = graph(spark, 14, two)
    files = spark.createDataFrame([(i, f"f{i:02}.py") for i in range(14)], "id long, path string")
    old = G.LOCAL_EDGES
    try:
        G.LOCAL_EDGES = 3
        got = {r.file_id: r.community_id for r in G.communities(files, edges).collect()}
    finally:
        G.LOCAL_EDGES = old
    assert len({got[i] for i in range(6)}) == 1 and len({got[i] for i in range(6, 12)}) == 1 and len(set(got.values())) == 4
    assert [got[0], got[6], got[12], got[13]] == [0, 1, 2, 3]


def test_ancestry_depth(spark):
    """Diamonds, a deep chain and cycles, against all ways without a repeat."""
    pairs = [(f"d{i}", f"d{i + 1}{s}") for i in range(0, 12, 2) for s in "ab"] + [(f"d{i + 1}{s}", f"d{i + 2}") for i in range(0, 12, 2) for s in "ab"] + [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("z", "d4")]
    names = {n for p in pairs for n in p}
    rows = [(15, b, a) for a, b in pairs] + [(1, n, None) for n in names]
    got = {r.name: r.depth for r in G.ancestry_depth(spark.createDataFrame(rows, "kind int, name string, enclosing_function string")).collect()}
    above = {}
    for a, b in pairs:
        above.setdefault(a, []).append(b)

    def deepest(way):
        return max([0] + [1 + deepest([*way, b]) for b in above.get(way[-1], []) if b not in way])

    assert got == {n: deepest([n]) for n in names}


def test_locks_scopes_and_freshness(spark, repo, tmp_path):
    db = str(tmp_path / "i")
    assert index.ensure_fresh(spark, str(repo), db, ("edges",))["written"]
    memo = set()
    assert not index.ensure_fresh(spark, str(repo), db, ("edges",), memo)["written"] and index.ensure_fresh(spark, str(repo), db, ("imports", "edges"), memo) is None
    assert index.ensure_fresh(spark, str(repo), db, ()) is None
    with index.locked(db), pytest.raises(TimeoutError), index.locked(db, 0.2):
        pass
    (repo / "one.py").write_text("def one(): pass\n")
    (repo / "two.py").write_text("def two(): pass\n")
    got = index.build(spark, str(repo), db, only=["one.py"])
    assert (got["new"], got["written"]) == (1, True) and "two.py" not in {r.path for r in index.load(spark, db).files.collect()}
    from codeloom.sources.files import git_status

    changed, deleted, moved = git_status(str(repo))
    assert {"one.py", "two.py"} <= set(changed) and moved and git_status(str(tmp_path)) is None
    (repo / "one.py").unlink(), (repo / "two.py").unlink()
    out = modes.run_query(spark, {"mode": "batch", "dbPath": db, "repoRoot": str(repo), "ensureFresh": True, "calls": [{"mode": "get_symbol", "name": "run"}, {"mode": "get_symbol", "name": "one"}, {"mode": "index_counts"}, {"mode": "clusters", "seedPath": "app/core.py"}, {"mode": "type_hierarchy", "name": "Job", "filePath": "app/core.py"}, {"mode": "symbols_in_files", "filePaths": ["app/core.py", "nope.py"]}, {"mode": "context_pack", "query": "run Jo"}]})["data"]
    assert [x["ok"] for x in out] == [True, False, True, True, True, True, True]
    assert out[2]["data"]["files"] == out[2]["data"]["files"] and "app/core.py" in out[3]["data"][0]["members"]
    assert out[5]["data"]["nope.py"]["error"]["code"] == "not_found" and [r["name"] for r in out[5]["data"]["app/core.py"]][:2] == ["Base", "Job"]
    assert [s["name"] for s in out[6]["data"]["symbols"]] == ["Job", "run"]


def test_louvain():
    two = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)]
    label = G.louvain(list(range(6)), two)
    assert len(set(label.values())) == 2 and label[0] == label[1] == label[2] and label[3] == label[4] == label[5]
    assert len(set(G.louvain(list(range(4)), []).values())) == 4


def test_module_cycles():
    assert G.module_cycles([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]) == [["a", "b", "c"]]


def test_hashes(spark):
    texts = ["", "a", "foobar", "grün 日本"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(H.fnv1a_column(__import__("pyspark").sql.functions.col("t")).alias("h")).collect()
    assert [r.h % (1 << 64) for r in got] == [H.fnv1a(t.encode()) for t in texts] and H.fnv1a_hex(b"a") == "af63dc4c8601ec8c"


def slow_minhash(text):
    import re

    tokens = [t.lower() for t in re.findall("[A-Za-z0-9]+", text)]
    if len(tokens) < 5:
        return None
    shingles = [" ".join(tokens[i : i + 5]).encode() for i in range(len(tokens) - 4)]
    rows = [min(H.fnv1a(s, H.BASIS ^ ((i + 1) * H.MIX & (1 << 64) - 1)) for s in shingles) for i in range(16)]
    return [min(rows[i : i + 4]) for i in range(0, 16, 4)]


def test_minhash():
    rng = random.Random(1)
    for n in (0, 4, 5, 30):
        text = " ".join(rng.choice(["Alpha", "be-ta", "g(x)", "1", "zz"]) for _ in range(n))
        assert H.body_minhash(text) == slow_minhash(text)
    assert H.body_minhash("a B c, d e f") == H.body_minhash("A b C d;E(f)")


def test_paths(spark):
    import pyspark.sql.functions as F

    tests = ["src/tests/a.py", "x/foo_test.go", "test_a.py", "a/FooTests.cs", "My.UnitTests/a.cs", "a/b.t.sol", "x/tests.rs", "SRC/TEST/a.py"]
    plain = ["latest.rb", "contest.rs", "src/attest/a.py", "Contests/a.cs", "x/test_utils.rs"]
    df = spark.createDataFrame([(p,) for p in tests + plain], "path string")
    assert {r.path for r in df.filter(P.is_test_path(F.col("path"))).collect()} == set(tests)
    noise = {"vendor/a.js": True, "a/priv/static/x.py": True, "x.min.js": True, "assets/a.ts": True, "templates/a.py": True, "README": True, "src/a.py": False}
    got = spark.createDataFrame([(p,) for p in noise], "path string").select("path", P.is_noise_path(F.col("path")).alias("n")).collect()
    assert {r.path: r.n for r in got} == noise


def test_patterns():
    text = "print('a', 1)\nfoo(bar(2), x)\ntry:\n    pass\nexcept Exception:\n    pass\n"
    assert [m["captures"] for m in patterns.search_text("print($A, $$$R)", text)] == [{"A": "'a'", "R": "1"}]
    assert [m["text"] for m in patterns.search_text("bar($X)", text, {"inside": "Call"})] == ["bar(2)"]
    assert patterns.search_text("bar($X)", text, {"inside": "Try"}) == []
    assert patterns.constrained({"A": "abc"}, {"A": "b"}) and not patterns.constrained({"A": "abc"}, {"A": "!b"})
    m = patterns.search_text("bar($X)", text)
    assert patterns.plan_rewrites(text, m, "baz($X, 0)") == (text.replace("bar(2)", "baz(2, 0)"), 1)
    with pytest.raises((SyntaxError, ValueError)):
        patterns.compile_pattern("a b")


def test_rules_suppressions_and_packs(spark, tmp_path):
    (tmp_path / "p.toml").write_text('[[rule]]\nid="mine"\nkind="sql"\nseverity="error"\nmessage="{path} is big"\nquery="SELECT path AS file, 1 AS line, path FROM files WHERE size > :most"\nthresholds={most=5}\n[[rule]]\nid="half"\n')
    got, problems = rules.load_pack(tmp_path)
    assert [r.id for r in got] == ["mine"] and len(problems) == 1
    spark.createDataFrame([("a", 9), ("b", 1)], "path string, size int").createOrReplaceTempView("files")
    found, failed = scan.sql_findings(spark, [*got, rules.Rule("broken", "info", "", "SELECT nope FROM files")])
    findings = [r.asDict() for r in found.collect()]
    assert [(f["file"], f["message"], f["severity"]) for f in findings] == [("a", "a is big", "error")] and [f["rule_id"] for f in failed] == ["broken"]
    assert findings[0]["id"] == rules.finding_id("mine", "a", 0, 0)
    marks = rules.suppressions("a", "# loom-ignore-file mine -- known\n") + rules.suppressions("z", "x\n// loom-ignore other\n")
    left, stale = rules.suppress(findings, marks)
    assert left == [] and [m["file"] for m in stale] == ["z"]


def test_pattern_rules(spark):
    from codeloom.operators import pattern_rules as R

    text = "def f(x):\n    try:\n        print(x)\n    except ValueError:\n        pass\n    return eval('x')\n"
    src = spark.createDataFrame([("a.py", text), ("tests/a.py", text)], "path string, text string")
    hits = R.scan_patterns(src, R.BUILTIN)
    got = {(r.rule_id, r.file, r.start_line) for r in hits.collect()}
    assert got == {("empty-except-block", p, 2) for p in ("a.py", "tests/a.py")} | {("eval-usage", p, 6) for p in ("a.py", "tests/a.py")} | {("debug-statement-strict", "a.py", 3)}
    files = spark.createDataFrame([(1, "a.py")], "id long, path string")
    fns = spark.createDataFrame([(0, 9, "f", 1, 1, 6)], "kind int, id long, name string, file_id long, start_line int, end_line int")
    assert {r.enclosing for r in R.with_enclosing(hits, files, fns).collect()} == {"f"}
    assert R.PatternRule("x", "info", "", ["a b"]).problems()


def test_trim_keeps_the_most_important():
    sections = {n: [{"x": "y" * 40}] * 30 for n, _ in navmap.PRIORITY}
    out, guide = navmap.trim(sections, 600)
    assert guide["truncated"] and len(out["entrypoints"]) >= len(out["cycles"]) > 0 and guide["estimate"] <= 600
    out, guide = navmap.trim(sections, 100_000)
    assert {n: len(v) for n, v in out.items()} == {n: min(most, 30) for n, most in navmap.PRIORITY} and guide["dropped"] == {"foundational": 5, "subsystems": 10, "flows": 25, "hotspots": 5, "cycles": 10}


def test_ignore_patterns(tmp_path):
    from codeloom.sources.files import list_sources

    (tmp_path / ".gitignore").write_text("*.log\n!keep.log\nbuild/\n/top.txt\ndocs/**/draft.md\na/*/z\n**/tmp\nx[0-9].py\nq?.py\n# no\nout/\n!out/in.py\n")
    for p in ("a.log", "keep.log", "d/b.log", "build/x.py", "d/build/y.py", "top.txt", "d/top.txt", "docs/draft.md", "docs/a/b/draft.md", "docs/a/other.md", "a/b/z", "a/b/c/z", "tmp/f.py", "d/tmp/g.py", "x1.py", "xa.py", "qq.py", "q/q.py", "out/in.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("")
    assert [p for p, _, _ in list_sources(str(tmp_path))] == [".gitignore", "a/b/c/z", "d/top.txt", "docs/a/other.md", "keep.log", "q/q.py", "xa.py"]


def test_streaming_bursts(spark, tmp_path):
    import datetime as dt

    from codeloom.streaming import watch as W

    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0), ("b", t0 + dt.timedelta(milliseconds=200)), ("c", t0 + dt.timedelta(seconds=5)), ("z", t0 + dt.timedelta(seconds=60))]
    spark.createDataFrame(rows, W.CHANGES).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(W.CHANGES).parquet(str(tmp_path / "in"))
    q = W.bursts(stream).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.changes for r in spark.table("bursts").collect()) == [1, 2]


def test_flow_trees():
    from codeloom.operators import flows

    calls = {1: [2, 3], 2: [3, 1], 3: [4], 4: [2]}
    want = {"id": 1, "calls": [{"id": 2, "calls": [{"id": 3, "calls": [{"id": 4, "calls": []}]}]}, {"ref": 3}]}
    assert flows.tree(1, calls) == want and flows.size(want) == 5
    assert flows.tree(1, calls, {3}) == {"id": 1, "calls": [{"id": 2, "calls": []}]}


def test_entity_codes():
    assert ENTITY["call"] == 6 and ENTITY["control_flow"] == 12 and ENTITY["callable_boundary"] == 19


def test_clone_bands_have_their_members(spark, sf):
    from codeloom.plans.queries import QUERIES

    bands = {(r.band, r.value): (r.size, r.label) for r in QUERIES["clone_bands"](spark, sf).collect()}
    members = {}
    for r in QUERIES["clone_band_members"](spark, sf).collect():
        members.setdefault((r.band, r.value), []).append(r.id)
    assert bands and {k: (len(v), min(v)) for k, v in members.items()} == bands
    assert all(len(v) == len(set(v)) for v in members.values())


def test_watches(spark, repo, tmp_path):
    import datetime as dt

    from codeloom.streaming import watch as W

    db = str(tmp_path / "db")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(W.CHANGES).parquet(str(tmp_path / "in"))
    spark.createDataFrame([("app/core.py", dt.datetime(2024, 1, 1))], W.CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    watches = W.Watches()
    assert watches.start(spark, stream, str(repo), db, str(tmp_path / "ck")) and not watches.start(spark, stream, str(repo), db, str(tmp_path / "ck"))
    watches.running[str(repo)].processAllAvailable()
    assert index.ledger(db)["rev"] == 1 and [(x["repo"], x["active"], x["problem"]) for x in watches.list()] == [(str(repo), True, None)]
    assert watches.stop() == [{"repo": str(repo), "outcome": "stopped"}] and watches.stop("x") == [{"repo": "x", "outcome": "not running"}] and watches.list() == []


def test_pattern_search_against_plain_tokens(spark, sf):
    """The registered search, against a walk over each text's tokens."""
    from codeloom.frontends.tokens import tokenize
    from codeloom.plans.queries import QUERIES

    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        tokens, _ = tokenize("go", r.text or "")
        for i, t in enumerate(tokens[:-2]):
            if t.text == "token" and tokens[i + 1].text == "=" and (i == 0 or tokens[i - 1].text not in (".", "::", "?.", "->")):
                want.add((r.doc_id, len(r.text[: t.start].encode())))
    assert {(r.doc_id, r.start_byte) for r in QUERIES["pattern_search"](spark, sf).collect()} == want


def test_minhash_takes_texts_in_small_batches(spark):
    from pyspark.sql import functions as F

    from codeloom.functions.hashing import BATCH, body_minhash, with_minhash

    for name in BATCH:
        spark.conf.unset(name)
    texts = spark.range(3000, numPartitions=1).select("id", F.concat_ws(" ", F.lit("one two three four five"), F.col("id"), F.repeat(F.lit("word "), 400)).alias("text"))
    signed = with_minhash(texts, "text")
    assert all(int(spark.conf.get(name).rstrip("b")) <= most for name, most in BATCH.items())
    rows = signed.collect()
    assert len(rows) == 3000 and all([x % (1 << 64) for x in r.body_minhash] == body_minhash(r.text) for r in rows[::500])


def test_large_graphs_are_written_once_and_stay_off_the_driver(spark, monkeypatch):
    """Pairs are written once, each level joins them as they lie, and none are fetched once there are too many."""
    edges = [(i, i + 1) for i in range(12)] + [(0, 5), (12, 0), (3, 3)]
    pairs, one = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,)], "id long")
    near = {tuple(r) for r in G.reachable(pairs, one).collect()}
    names, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df, name="step": names.append(name) or cut(df, name))
    monkeypatch.setattr(G, "LOCAL_EDGES", 5)
    monkeypatch.setattr(type(pairs), "toPandas", lambda self: 1 / 0)
    assert {tuple(r) for r in G.reachable(pairs, one).collect()} == near and len(near) == 12
    assert names.count("pairs") == 1


def test_communities_of_large_graphs_fetch_no_edges(spark, monkeypatch):
    files = spark.createDataFrame([(i, f"f{i}") for i in range(8)], "id long, path string")
    links = [(a, b, True) for g in (0, 4) for a in range(g, g + 4) for b in range(g, g + 4) if a < b] + [(4, 0, True)]
    edges = spark.createDataFrame(links, "from_file_id long, to_file_id long, resolved boolean")
    monkeypatch.setattr(G, "LOCAL_EDGES", 5)
    monkeypatch.setattr(G, "SPREAD_ROUNDS", 2)
    monkeypatch.setattr(type(files), "toPandas", lambda self: 1 / 0)
    assert sorted(r.file_id for r in G.communities(files, edges).collect()) == list(range(8))
