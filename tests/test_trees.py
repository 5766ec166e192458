"""Structural search by token trees."""

import pytest

from codeloom.operators import pattern_rules as R
from codeloom.operators import patterns, trees

TS = """import x from 'y';
function go(a, b) {
  console.log(a, b);
  console.log();
  if (a) { my.console.log(1); }
  try { run(a); } catch (e) { /* nothing */ }
  try { run(b); } catch { }
  const api_key = "abcdefgh1234";
  const conf = { password: 'hunter2hunter', user: "someone12" };
  return add(mul(a, b), c.d(e)[0], ...rest);
}
"""


def found(pattern, text=TS, lang="typescript", **relations):
    return [(m["text"], m["captures"]) for m in trees.search(lang, pattern, text, relations)]


def test_holes():
    assert found("console.log($$$A)") == [("console.log(a, b)", {"A": "a, b"}), ("console.log()", {"A": ""})]
    assert found("console.log($A, $B)") == [("console.log(a, b)", {"A": "a", "B": "b"})]
    assert found("console.log($A, $$$B)") == [("console.log(a, b)", {"A": "a", "B": "b"})]
    assert found("add($X, $Y, $$$R)") == [("add(mul(a, b), c.d(e)[0], ...rest)", {"X": "mul(a, b)", "Y": "c.d(e)[0]", "R": "...rest"})]
    assert found("run($X, $$$R)") == [("run(a)", {"X": "a", "R": ""}), ("run(b)", {"X": "b", "R": ""})]
    assert found("add($X)") == []
    assert found("mul($X, $X)") == [("mul(a, b)", {"X": "b"})]
    assert found("return $V;")[0][1] == {"V": "add(mul(a, b), c.d(e)[0], ...rest)"}
    assert [c["F"] for _, c in found("$F($A, $B)")] == ["go", "console.log", "mul"]


def test_statements_and_kinds():
    assert [t for t, _ in found("catch ($E) {}")] == ["catch (e) { /* nothing */ }"] and [t for t, _ in found("catch {}")] == ["catch { }"]
    assert found("if ($C) { $$$B }") == [("if (a) { my.console.log(1); }", {"C": "a", "B": "my.console.log(1)"})]
    assert [c["K"] for _, c in found("$K: $V:string")] == ["password", "user"]
    assert found("const $K = $V:string") == [('const api_key = "abcdefgh1234"', {"K": "api_key", "V": '"abcdefgh1234"'})]
    assert found("add($X:call, $$$R)") and not found("add($X:string, $$$R)")


def test_relations():
    assert [t for t, _ in found("run($X)", inside="try")] == ["run(a)", "run(b)"]
    assert found("run($X)", inside="if") == [] and found("my.console.log($X)", inside="if")
    assert [t for t, _ in found("add($$$A)", has="call")] and not found("run($X)", has="string")
    assert found("my.console.log($X)", inside="function") and [t for t, _ in found("import x", precedes="function")] == ["import x"]


def test_invalid_and_too_complex():
    for p in ("", "  ", "foo(", "$$$A", ";"):
        with pytest.raises(trees.InvalidPattern):
            trees.compile_pattern(p, "go")
    text = "f(" + ", ".join(["a"] * 400) + ");"
    old = trees.STEPS
    try:
        trees.STEPS = 2000
        with pytest.raises(trees.TooComplex):
            trees.search("typescript", "f($$$A, $$$B, $$$C, $$$D, z)", text)
    finally:
        trees.STEPS = old
    assert trees.atoms("console.log($MSG, $$$R) + x") == ["console", "log"]


@pytest.mark.parametrize(("lang", "text", "pattern", "want"), [
    ("rust", "fn f() { let x = Ok(3)?; println!(\"{}\", x); dbg!(x); }", "Ok($V)", ["Ok(3)"]),
    ("rust", "fn f() { println!(\"{}\", x); }", "println!($$$A)", ['println!("{}", x)']),
    ("go", "func f() { if err != nil { return err } }", "if err != nil { $$$B }", ["if err != nil { return err }"]),
    ("java", "class A { void f() { s.equals(\"x\"); Objects.equals(a, b); } }", "$X.equals($Y)", ['s.equals("x")']),
    ("ruby", "puts foo(1)\nputs bar(2)", "foo($X)", ["foo(1)"]),
    ("c", "int main() { free(p); free (q) ; }", "free($P)", ["free(p)", "free (q)"]),
])
def test_languages(lang, text, pattern, want):
    assert [m["text"] for m in trees.search(lang, pattern, text)] == want


def test_search_drops_texts_without_the_words_and_keeps_all_matches(spark):
    rows = [(f"a{i}.ts", TS if i % 3 else "x()") for i in range(30)] + [("n.ts", None)]
    df = spark.createDataFrame(rows, "path string, text string")
    got = patterns.search(df, "console.log($$$A)", lang="typescript").collect()
    assert len(got) == 2 * sum(i % 3 > 0 for i in range(30)) and all(r.problem is None for r in got)
    plan = patterns.search(df, "console.log($$$A)", lang="typescript")._jdf.queryExecution().executedPlan().toString()
    assert "Contains(text" in plan
    mixed = df.withColumn("lang", patterns.F.lit("typescript")).unionByName(spark.createDataFrame([("p.py", "print(run(1))", "python")], "path string, text string, lang string"))
    assert {r.file for r in patterns.search_all(mixed, "run($X)").collect()} == {p for p, t in rows if t and "run" in t} | {"p.py"}


def test_all_builtin_rules_are_sound_and_find_their_cases(spark):
    assert [p for r in R.BUILTIN for p in r.problems()] == []
    files = {
        "a.ts": TS, "tests/b.ts": TS, "m.rs": "fn f() { dbg!(x); }", "tests/m.rs": "fn f() { dbg!(x); }", "s.swift": "do { try f() } catch { }", "J.java": "class J { String token = \"abcdefgh1\"; void f() { try { g(); } catch (A e) { } } }",
        "p.py": "eval('1')\n", "q.js": "eval(x); window.eval(y);",
    }
    src = spark.createDataFrame(list(files.items()), "path string, text string")
    got = {(r.rule_id, r.file) for r in R.scan_patterns(src, R.BUILTIN).collect()}
    want = {("console-log-strict", "a.ts"), ("empty-catch-block", "a.ts"), ("empty-catch-block", "tests/b.ts"), ("hardcoded-credential-literal", "a.ts"), ("hardcoded-credential-declaration", "a.ts"), ("debug-macro-strict", "m.rs"), ("empty-catch-block-swift", "s.swift"), ("hardcoded-credential-literal", "J.java"), ("empty-catch-block", "J.java"), ("eval-usage", "p.py"), ("eval-usage", "q.js")}
    assert got == want


def test_rewrites_and_self_tests():
    rule = R.PatternRule("log", "info", "m", ["console.log($$$A)"], languages=("typescript",), rewrite="logger.info($$$A)", valid=["x.console.log(1)"], invalid=["é(); console.log(1, 2)"], expect="é(); logger.info(1, 2)")
    assert [x["passed"] for x in R.self_test(rule)] == [True, True, True]
    assert R.PatternRule("x", "info", "m", ["f($A)"], rewrite="g($B)", languages=("go",)).problems()
    text = "f(f(1)); f(2);"
    assert patterns.plan_rewrites(text, trees.search("javascript", "f($X)", text), "g($X)") == ("g(f(1)); g(2);", 2)
