"""The scan from rules to rewrites, and what resolution and the map make of a small repository in several languages."""

import json
import subprocess

import pytest

from codeloom.operators import pattern_rules as PR
from codeloom.operators import resolve as S
from codeloom.operators import rules as R
from codeloom.plans import index, modes, navmap, scan
from codeloom.schema import Tables

FILES = {
    "go.mod": "module example.org/shop\n",
    "cmd/main.go": 'package main\n\nimport "example.org/shop/store"\n\nfunc main() {\n\tstore.Open()\n}\n',
    "store/a.go": "package store\n\nfunc Open() { load() }\n\nfunc load() {}\n",
    "store/b.go": "package store\n\nfunc more() {}\n",
    "store/a_test.go": "package store\n\nfunc TestOpen() { Open() }\n",
    "app/crud.py": "def get_user(i):\n    return i\n",
    "app/main.py": "from app import crud\n\ndef show(i):\n    return crud.get_user(i)\n",
    "api/UserService.java": "class UserService implements Finder {\n  User find(int id) { return null; }\n  void save() { }\n}\ninterface Finder { User find(int id); }\nclass Other { void save() { } }\n",
    "api/UserController.java": '@RestController\n@RequestMapping("/users")\nclass UserController {\n  private Finder finder;\n  private Gson gson;\n  @GetMapping("/{id}")\n  User one(int id) { gson.unique(id); return finder.find(id); }\n}\n',
    "api/Helper.java": "class Helper { void unique(int x) { } }\n",
    "web/server.ts": "import { show } from './show';\nrouter.get('/items/:id', show);\nconst api_key = 'abcdefgh1234';\nconsole.log('x');\n",
    "web/show.ts": "export function show(req) { if (req) { try { render(req); } catch (e) { } } }\nfunction render(r) { console.log(r); } // loom-ignore console-log-strict -- wanted\n// loom-ignore console-log-strict -- known\nconsole.log('again');\n",
    "vendor/lib.ts": "eval('x');\n",
    "web/old.ts": "// loom-ignore-file eval-usage -- legacy\neval('1');\n// loom-ignore empty-catch-block\nlet x = 1;\n",
}


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    root, db = tmp_path_factory.mktemp("shop"), str(tmp_path_factory.mktemp("shopdb") / "index")
    for p, t in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    git("init", "-q"), git("add", "."), git("commit", "-qm", "one")
    index.build(spark, str(root), db)
    return root, db, git


def calls(t):
    names = {r.id: (r.name, r.owner_type) for r in t.entities.collect()}
    return {(names[r.from_entity_id][0], names[r.to_entity_id]) for r in t.resolved_edges.filter("kind = 0 and resolved").collect()}


def test_resolution_passes(spark, shop):
    root, db, _ = shop
    t = index.load(spark, db)
    paths = {r.id: r.path for r in t.files.collect()}
    imports = {(paths[r.from_file_id], paths.get(r.to_file_id)) for r in t.resolved_edges.filter("kind = 1").collect()}
    # a package gives an edge to each of its files, without tests
    assert {b for a, b in imports if a == "cmd/main.go"} == {"store/a.go", "store/b.go"}
    got = calls(t)
    assert ("store.Open", ("Open", None)) in got  # by imported files
    assert ("crud.get_user", ("get_user", None)) in got  # by the module that the receiver names
    assert ("finder.find", ("find", "UserService")) in got  # by the receiver's type, through its only implementation
    assert not any(n == "gson.unique" for n, _ in got)  # a type from elsewhere


def test_relative_specifiers():
    assert S.relative("a/b", "./c") == "a/b/c" and S.relative("a", "../../../x") == "x" and S.relative("", "./.hidden/y") == ".hidden/y" and S.relative("a", "lib") is None


def test_scoped_edges_equal_full_ones(spark, shop):
    root, db, _ = shop
    t = index.load(spark, db)
    changed = t.files.filter("path = 'store/a.go'").select("id")
    scope = S.scope_of(changed, t.resolved_edges)
    paths = {r.id: r.path for r in t.files.collect()}
    assert {paths[r.id] for r in scope.collect()} == {"store/a.go", "cmd/main.go"}
    modules = [("example.org/shop", "")]
    key = lambda df: sorted((r.from_file_id, r.to_file_id or 0, r.kind, r.from_entity_id, r.to_entity_id or 0) for r in df.collect())
    whole = t.resolved_edges.join(scope.withColumnRenamed("id", "from_file_id"), "from_file_id", "left_semi")
    assert key(S.resolve(t.files, t.entities, modules, scope)) == key(whole)


def test_entry_points_and_map(spark, shop):
    root, db, _ = shop
    t = index.load(spark, db)
    got = {(r["file"], r["symbol"], r["role"]) for r in navmap.entrypoints(t)}
    assert ("cmd/main.go", "main", "process_main") in got
    assert ("api/UserController.java", "GET /users/{id}", "route_handler") in got and ("api/UserController.java", "UserController", "route_handler") in got
    assert ("web/server.ts", "GET /items/:id", "route_handler") in got
    assert not any(f.startswith(("vendor", "store/a_test")) for f, _, _ in got)
    data = navmap.nav_map(t, 8000)
    flow = next(f for f in data["flows"] if f["entrypoint"] == "main")
    assert flow["nodeCount"] == 3 and flow["root"]["children"][0]["symbol"] == "Open" and flow["root"]["children"][0]["children"][0]["symbol"] == "load"
    text = navmap.as_text(data)
    assert "process_main: main (cmd/main.go)" in text and "FLOWS" in text
    names = [s["name"] for s in data["subsystems"]]
    assert len(names) == len(set(names))


def test_flow_summaries_are_bounded():
    deep = {"id": 0, "calls": []}
    node = deep
    for i in range(1, 2000):
        node["calls"] = [{"id": i, "calls": []}]
        node = node["calls"][0]
    names = {i: (f"f{i}", "x.py") for i in range(3000)}
    from codeloom.operators.flows import size

    assert size(deep) == 2000
    got = navmap.summary(deep, names)
    assert got["children"][0]["children"][0]["children"][0] == {"symbol": "f3", "file": "x.py", "childrenOmitted": 1}
    wide = {"id": 0, "calls": [{"id": i, "calls": []} for i in range(1, 100)]}
    assert len(navmap.summary(wide, names)["children"]) == 29 and navmap.summary(wide, names)["childrenOmitted"] == 70
    again = {"id": 0, "calls": [{"id": 1, "calls": []}, {"ref": 0}, {"ref": 0}, {"ref": 0}]}
    assert navmap.summary(again, names)["children"][1] == {"symbol": "f0", "file": "x.py", "recurses": True, "recursesCount": 3}


def test_scan(spark, shop):
    root, db, _ = shop
    out = modes.run_query(spark, {"mode": "scan", "dbPath": db, "repoRoot": str(root), "severityThreshold": "error"})
    assert out["ok"]
    data = out["data"]
    got = {(f["rule_id"], f["file"], f["line"]) for f in data["findings"]}
    want = {("hardcoded-credential-literal", "web/server.ts", 3), ("hardcoded-credential-declaration", "web/server.ts", 3), ("console-log-strict", "web/server.ts", 4), ("empty-catch-block", "web/show.ts", 1), ("console-log-strict", "web/show.ts", 2)}
    assert got == want  # without vendor/ and what comments silence
    assert [(m["file"], m["rules"]) for m in data["stale_suppressions"]] == [("web/old.ts", ["empty-catch-block"]), ("web/show.ts", ["console-log-strict"])]  # the second stands behind code and points at a comment
    assert {x["rule_id"]: x["findings"] for x in data["legend"]}["console-log-strict"] == 2 and data["exceeded"]
    found = next(f for f in data["findings"] if f["rule_id"] == "empty-catch-block")
    assert json.loads(found["evidence"])["enclosing"] == "show" and found["id"] == R.finding_id("empty-catch-block", "web/show.ts", found["start_byte"], found["end_byte"])


def test_rewrites(spark, shop, tmp_path):
    root, db, git = shop
    rule = PR.PatternRule("log", "info", "m", ["console.log($$$A)"], languages=("typescript",), rewrite="logger.info($$$A)")
    packs = scan.Packs([], [rule])
    t = index.load(spark, db)
    sources = index.sources_of(spark, str(root), t.files)
    (root / "dirty.txt").write_text("x")
    _, payload = scan.scan(spark, t, sources, str(root), packs, apply=True)
    assert set(payload["rewrites"].values()) == {"refused"} and "console.log" in (root / "web/server.ts").read_text()
    (root / "dirty.txt").unlink()
    _, payload = scan.scan(spark, t, sources, str(root), packs, apply=True)
    assert payload["rewrite_counts"] == [{"status": "applied", "count": 3}]
    assert "logger.info('x')" in (root / "web/server.ts").read_text() and "logger.info('again')" in (root / "web/show.ts").read_text()
    git("checkout", "-q", ".")


def test_clone_bands_are_one_finding(spark):
    rows = [(f"i{n}", "duplicate-code-clone", "warning", "m", f"f{n}.py", n, 0, 9, json.dumps({"band_id": n % 2}), "", None, None) for n in range(6)] + [("x", "other", "info", "m", "f.py", 1, 0, 9, "{}", "", None, None)]
    got = scan.collapsed(spark.createDataFrame(rows, scan.FINDINGS)).collect()
    bands = {json.loads(r.evidence)["band_id"]: json.loads(r.evidence) for r in got if r.rule_id == "duplicate-code-clone"}
    assert len(got) == 3 and {b: e["members"] for b, e in bands.items()} == {"0": 3, "1": 3} and [p["file"] for p in bands["0"]["places"]] == ["f0.py", "f2.py", "f4.py"]


def test_packs_are_listed_seeded_tested_and_removed(spark, tmp_path):
    root = str(tmp_path)
    before = scan.list_packs(root)
    assert [x["outcome"] for x in scan.seed_packs(root)] == ["written", "written"] and [x["outcome"] for x in scan.seed_packs(root)] == ["kept", "kept"]
    packs = scan.load_packs(root)
    assert packs.diagnostics == [] and sorted({x["id"] for x in scan.list_packs(root)}) == sorted({x["id"] for x in before})
    folder = tmp_path / scan.PACKS
    (folder / "own.toml").write_text(
        '[[rule]]\nid = "mine"\nkind = "pattern"\nlanguage = "ts"\nmessage = "m"\npattern = "f($X)"\nrewrite = "g($X)"\nvalid = ["g(1)"]\ninvalid = ["f(1)"]\nexpect = "g(1)"\n'
        '[[rule]]\nid = "bad"\nkind = "pattern"\nmessage = "m"\npattern = "f("\nlanguages = ["go"]\n'
        '[[rule]]\nid = "big"\nkind = "sql"\nmessage = "m"\nquery = "SELECT path AS file, 1 AS line FROM files WHERE size > 5"\n'
        '[[rule.fixtures]]\nexpect = [{file = "a"}]\n[rule.fixtures.tables.files]\ncolumns = "path string, size int"\nrows = [["a", 9], ["b", 1]]\n'
    )
    packs = scan.load_packs(root)
    assert [d["message"] for d in packs.diagnostics] and "bad" in packs.diagnostics[0]["message"]
    packs.sql, packs.patterns = [r for r in packs.sql if r.id == "big"], [r for r in packs.patterns if r.id == "mine"]
    out = scan.self_tests(spark, packs, limit=3)
    assert (out["passed"], out["failed"], out["guide"]) == (4, 0, {"total": 4, "shown": 3})
    assert [x["outcome"] for x in scan.remove_packs(root)] == ["removed", "removed"]


def test_empty_tables(spark):
    files = spark.createDataFrame([], "id long, path string, complexity long, churn long, fan_in long, fan_out long, community_id long, lang string, is_test_path boolean, is_tooling_path boolean")
    from codeloom.schema import EDGES, ENTITIES

    t = Tables(files, spark.createDataFrame([], ENTITIES), spark.createDataFrame([], EDGES), spark.createDataFrame([], "file_id long, community_id long"), clone_band_members=spark.createDataFrame([], "band_id long, entity_id long"))
    findings, payload = scan.scan(spark, t, spark.createDataFrame([], "path string, text string"))
    assert findings.count() == 0 and payload["findings"] == [] and payload["diagnostics"] == []
    assert navmap.entrypoints(t) == []
