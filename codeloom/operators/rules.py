"""SQL rules over the code graph: each a query with named thresholds; columns beyond file and line are evidence."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.hashing import fnv1a_hex

SEVERITIES = ["info", "warning", "error"]


@dataclass
class Rule:
    """ctes and body make the query; both run on the views of schema.Tables."""

    id: str
    severity: str
    message: str
    body: str
    ctes: str = ""
    thresholds: dict[str, float] = field(default_factory=dict)
    strings: dict[str, str] = field(default_factory=dict)
    remediation: str = ""
    fixtures: list[dict] = field(default_factory=list)

    def sql(self) -> str:
        return (f"WITH RECURSIVE {self.ctes} " if "RECURSIVE" in self.ctes else f"WITH {self.ctes} " if self.ctes else "").replace("RECURSIVE RECURSIVE", "RECURSIVE") + self.body


_SPAN = "e.start_line AS line, e.start_byte, e.end_byte, e.end_line"
#: Marker traits that say nothing of a class's size.
MARKERS = ["Debug", "Display", "Clone", "Copy", "PartialEq", "Eq", "Hash", "Default", "From", "Into", "TryFrom", "TryInto", "FromStr", "AsRef", "AsMut", "Ord", "PartialOrd", "Send", "Sync", "Iterator", "IntoIterator", "Deref", "DerefMut", "Drop", "ToString", "Comparable", "Serializable", "Cloneable", "Iterable", "Runnable", "AutoCloseable", "Closeable"]

_METHODS = "methods AS (SELECT id, file_id, name, owner_type, start_byte, end_byte, start_line, end_line FROM entities WHERE kind = 0 AND owner_type IS NOT NULL)"

BUILTIN = [
    Rule("file-complexity-hotspot", "warning", "many branches in one file: {complexity}", "SELECT path AS file, 1 AS line, complexity FROM files WHERE complexity > :max_complexity", thresholds={"max_complexity": 50.0}),
    Rule("churn-complexity-hotspot", "warning", "a file of many branches ({complexity}) that changes often ({churn} commits)", "SELECT path AS file, 1 AS line, complexity, churn FROM files WHERE complexity > :max_complexity AND churn > :min_churn", thresholds={"max_complexity": 50.0, "min_churn": 20.0}),
    Rule(
        "function-complexity-hotspot", "warning", "{name} branches {complexity} ways",
        (
            f"SELECT f.path AS file, {_SPAN}, e.id, e.name, 1 + coalesce(b.n, 0) AS complexity FROM entities e JOIN files f ON f.id = e.file_id "
            f"LEFT JOIN branches b ON b.file_id = e.file_id AND b.enclosing_function = e.name "
            f"AND coalesce(b.owner_type, '') = coalesce(e.owner_type, '') WHERE e.kind = 0 AND 1 + coalesce(b.n, 0) > :max_function_complexity"
        ),
        "branches AS (SELECT file_id, enclosing_function, owner_type, count(*) AS n FROM entities WHERE kind = 12 GROUP BY file_id, enclosing_function, owner_type)", {"max_function_complexity": 15.0},
    ),
    Rule(
        "duplicate-code-clone", "warning", "this body is also found elsewhere (band {band_id})",
        (
            f"SELECT f.path AS file, {_SPAN}, e.id, c.band_id FROM shown c JOIN entities e ON e.id = c.entity_id "
            f"JOIN files f ON f.id = e.file_id WHERE c.band_id IN (SELECT band_id FROM shown GROUP BY band_id HAVING count(*) >= :min_band_size "
            f"AND (count(DISTINCT owner_type) < count(*) OR count(DISTINCT owner_type) = 0))"
        ),
        (
            "shown AS (SELECT m.band_id, m.entity_id, e.owner_type FROM clone_band_members m JOIN entities e ON e.id = m.entity_id "
            "JOIN files f ON f.id = e.file_id WHERE NOT f.is_test_path AND NOT f.is_tooling_path "
            "AND e.end_line - e.start_line + 1 > :min_span_lines)"
        ), {"min_band_size": 3.0, "min_span_lines": 2.0},
    ),
    Rule("low-fan-in-high-fan-out-file", "info", "{fan_out} references out, {fan_in} in: little rests on this file and it rests on much", "SELECT path AS file, 1 AS line, fan_in, fan_out FROM files WHERE NOT is_test_path AND fan_in <= :max_fan_in AND fan_out >= :min_fan_out", thresholds={"max_fan_in": 2.0, "min_fan_out": 15.0}),
    Rule(
        "circular-import", "warning", "imports {other}, which imports it back",
        (
            "SELECT fa.path AS file, coalesce(ie.start_line, 1) AS line, a.id, b.id AS other_id, fb.path AS other FROM imports a "
            "JOIN imports b ON b.from_file_id = a.to_file_id AND b.to_file_id = a.from_file_id JOIN files fa ON fa.id = a.from_file_id "
            "JOIN files fb ON fb.id = a.to_file_id LEFT JOIN entities ie ON ie.id = a.from_entity_id WHERE a.from_file_id < a.to_file_id "
            "AND NOT fa.is_test_path AND NOT fb.is_test_path AND fa.path NOT LIKE '%.java' AND fb.path NOT LIKE '%.java'"
        ),
        "imports AS (SELECT id, from_file_id, to_file_id, from_entity_id FROM resolved_edges WHERE kind = 1 AND resolved)",
    ),
    Rule(
        "vertical-slice-sprawl", "warning", "{name} calls into {slices} other communities",
        (
            f"SELECT f.path AS file, {_SPAN}, e.id, e.name, count(DISTINCT t.community_id) AS slices FROM inside i "
            f"JOIN entities e ON e.id = i.fn JOIN files f ON f.id = e.file_id JOIN resolved_edges r ON r.from_entity_id = i.call_id "
            f"AND r.kind = 0 AND r.resolved JOIN files t ON t.id = r.to_file_id AND t.community_id <> f.community_id "
            f"GROUP BY f.path, e.start_line, e.start_byte, e.end_byte, e.end_line, e.id, e.name "
            f"HAVING count(DISTINCT t.community_id) >= :min_foreign_slices"
        ),
        "calls AS (SELECT id, file_id, start_byte, end_byte FROM entities WHERE kind = 6), fns AS (SELECT id, kind, file_id, start_byte, end_byte FROM entities WHERE kind IN (0, 19)), "
        "pairs AS (SELECT c.id AS call_id, n.id AS fn, n.kind, n.start_byte, n.end_byte FROM calls c JOIN fns n ON n.file_id = c.file_id AND c.start_byte >= n.start_byte AND c.end_byte <= n.end_byte), "
        "inside AS (SELECT p.call_id, p.fn FROM pairs p WHERE p.kind = 0 AND NOT EXISTS (SELECT 1 FROM pairs q WHERE q.call_id = p.call_id "
        "AND q.fn <> p.fn AND q.start_byte >= p.start_byte AND q.end_byte <= p.end_byte))", {"min_foreign_slices": 3.0},
    ),
    Rule(
        "solid-lsp", "warning", "{class_name} has {class_methods} of the {iface_methods} methods that {interface_name} asks for",
        (
            f"SELECT f.path AS file, {_SPAN}, e.id, e.enclosing_function AS class_name, e.name AS interface_name, coalesce(g.n, 0) AS class_methods, t.n AS iface_methods "
            f"FROM entities e JOIN files f ON f.id = e.file_id JOIN total t ON t.iface = e.name LEFT JOIN got g ON g.iface = e.name "
            f"AND g.file_id = e.file_id AND g.cls = e.enclosing_function WHERE e.kind = 16 AND NOT f.is_test_path AND f.path NOT LIKE '%.rb' "
            f"AND e.name IN (SELECT name FROM entities WHERE kind = 2) AND coalesce(g.n, 0) < t.n * :coverage_threshold"
        ),
        _METHODS + ", required AS (SELECT owner_type AS iface, name, count(*) AS k FROM methods WHERE end_line = start_line "
            "GROUP BY owner_type, name), total AS (SELECT iface, CAST(sum(k) AS BIGINT) AS n FROM required GROUP BY iface), "
        "have AS (SELECT DISTINCT file_id, owner_type AS cls, name FROM methods), "
        "got AS (SELECT r.iface, h.file_id, h.cls, CAST(sum(r.k) AS BIGINT) AS n FROM required r JOIN have h ON h.name = r.name "
        "GROUP BY r.iface, h.file_id, h.cls)", {"coverage_threshold": 0.7},
    ),
    Rule(
        "solid-isp", "warning", "{class_name} leaves {empty_stubs} of {class_methods} methods empty under the wide {interface_name} ({iface_method_count})",
        (
            f"SELECT f.path AS file, {_SPAN}, e.id, e.enclosing_function AS class_name, e.name AS interface_name, w.n AS iface_method_count, c.n AS class_methods, c.stubs AS empty_stubs "
            f"FROM entities e JOIN files f ON f.id = e.file_id JOIN wide w ON w.owner_type = e.name "
            f"JOIN classes c ON c.owner_type = e.enclosing_function AND c.file_id = e.file_id WHERE e.kind = 16 AND NOT f.is_test_path "
            f"AND f.path NOT LIKE '%.rb' AND c.stubs > c.n * :empty_body_threshold"
        ),
        _METHODS + ", wide AS (SELECT owner_type, count(*) AS n FROM methods GROUP BY owner_type HAVING count(*) > :method_threshold), "
            "busy AS (SELECT DISTINCT m.id FROM methods m JOIN entities k ON k.kind = 6 AND k.file_id = m.file_id "
            "AND k.start_byte >= m.start_byte AND k.end_byte <= m.end_byte), "
        "classes AS (SELECT m.file_id, m.owner_type, count(*) AS n, count(CASE WHEN m.end_line - m.start_line + 1 <= 2 "
        "AND b.id IS NULL THEN 1 END) AS stubs FROM methods m LEFT JOIN busy b ON b.id = m.id GROUP BY m.file_id, m.owner_type)", {"method_threshold": 7.0, "empty_body_threshold": 0.3},
    ),
    Rule(
        "fat-interface", "warning", "{member_count} methods in {class_name}",
        (
            f"SELECT f.path AS file, {_SPAN}, e.id, e.name AS class_name, count(*) AS member_count FROM entities e "
            f"JOIN files f ON f.id = e.file_id JOIN methods m ON m.owner_type = e.name AND m.file_id = e.file_id "
            f"AND m.start_byte >= e.start_byte AND m.end_byte <= e.end_byte WHERE e.kind IN (1, 2) AND NOT f.is_test_path AND NOT (e.kind = 2 "
            f"AND f.path LIKE '%.rb') AND e.name NOT LIKE '%Builder' AND e.name NOT LIKE '%Facade' AND e.name NOT LIKE '%Extensions' "
            f"AND e.name <> 'DependencyInjection' AND e.name NOT LIKE '%Installer' AND e.name NOT LIKE '%Registrar' "
            f"GROUP BY f.path, e.start_line, e.start_byte, e.end_byte, e.end_line, e.id, e.name HAVING count(*) > :max_members"
        ),
        _METHODS, {"max_members": 15.0},
    ),
    Rule(
        "too-many-interfaces", "warning", "{class_name} stands for {implements_count} interfaces",
        (
            "SELECT f.path AS file, min(e.start_line) AS line, e.enclosing_function AS class_name, count(*) AS implements_count "
            "FROM entities e JOIN files f ON f.id = e.file_id WHERE e.kind = 16 AND NOT f.is_test_path AND f.path NOT LIKE '%.rb' "
            "AND e.name NOT IN ({}) GROUP BY f.path, e.file_id, e.enclosing_function HAVING count(*) > :max_interfaces"
        ).format(", ".join(f"'{m}'" for m in MARKERS)),
        thresholds={"max_interfaces": 3.0},
    ),
    Rule(
        "deep-inheritance", "warning", "{chain_depth} types above {class_name}",
        (
            f"SELECT f.path AS file, {_SPAN}, e.id, e.name AS class_name, d.depth AS chain_depth FROM entities e "
            f"JOIN files f ON f.id = e.file_id JOIN type_depth d ON d.name = e.name WHERE e.kind = 1 AND NOT f.is_test_path "
            f"AND d.depth > :max_depth"
        ),
        thresholds={"max_depth": 3.0},
    ),
]
BY_ID = {r.id: r for r in BUILTIN}


def run_rule(spark: SparkSession, rule: Rule, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Rows of a rule on the registered views. type_depth, if the query names it, is built when missing."""
    if "type_depth" in rule.body and not spark.catalog.tableExists("type_depth"):
        from codeloom.operators.graph import ancestry_depth

        ancestry_depth(spark.table("entities")).createOrReplaceTempView("type_depth")
    sql = rule.sql()
    given = {**rule.thresholds, **rule.strings, **(thresholds or {})}
    used = set(re.findall(r":([a-z_]+)", sql))
    return spark.sql(sql, args={k: v for k, v in given.items() if k in used})


def render(message: str, evidence: dict) -> str:
    """{column} by its value; other placeholders stay."""
    return re.sub(r"\{(\w+)\}", lambda m: str(evidence[m[1]]) if isinstance(evidence.get(m[1]), (str, int, float, bool)) else m[0], message)


def finding_id(rule: str, file: str, start: int, end: int) -> str:
    return fnv1a_hex(f"{rule}\0{file}\0{start}\0{end}".encode())


def self_test(spark: SparkSession, rule: Rule) -> list[dict]:
    """A rule's own fixtures: tables with rows, and the rows that its query must give, in any order, as often as they
    are listed."""
    out = []
    for i, case in enumerate(rule.fixtures):
        try:
            for name, rows in case["tables"].items():
                spark.createDataFrame([tuple(r) for r in rows["rows"]], rows["columns"]).createOrReplaceTempView(name)
            got = run_rule(spark, rule)
            want = Counter(json.dumps(r, sort_keys=True) for r in case["expect"])
            columns = {c for r in case["expect"] for c in r}
            have = Counter(json.dumps({k: v for k, v in r.asDict().items() if k in columns or not columns}, sort_keys=True, default=str) for r in got.collect())
            out.append({"rule": rule.id, "case": f"fixture {i}", "passed": want == have})
        except Exception as e:  # noqa: BLE001 - a user's query may fail in any way
            out.append({"rule": rule.id, "case": f"fixture {i}", "passed": False, "message": str(e).splitlines()[0]})
    return out


def load_pack(path: str | Path) -> tuple[list[Rule], list[dict]]:
    """Rules of the TOML files below path; broken ones are reported and left out."""
    import tomllib

    rules, diagnostics = [], []
    for file in sorted(Path(path).glob("*.toml")):
        try:
            entries = tomllib.loads(file.read_text()).get("rule", [])
        except tomllib.TOMLDecodeError as e:
            diagnostics.append({"file": str(file), "message": str(e)})
            continue
        for x in entries:
            if x.get("kind") == "pattern":
                continue
            if x.get("kind") != "sql" or not {"id", "message", "query"} <= x.keys() or x.get("severity", "warning") not in SEVERITIES:
                diagnostics.append({"file": str(file), "message": f"rule {x.get('id', '?')} lacks a field or is of an unknown kind"})
                continue
            rules.append(Rule(x["id"], x.get("severity", "warning"), x["message"], x["query"], "", {k: float(v) for k, v in x.get("thresholds", {}).items()}, x.get("strings", {}), x.get("remediation", ""), x.get("fixtures", [])))
    return rules, diagnostics


def merge(*packs: list[Rule]) -> list[Rule]:
    """Later packs win by id."""
    out: dict[str, Rule] = {}
    for pack in packs:
        out |= {r.id: r for r in pack}
    return list(out.values())


SUPPRESS = re.compile(r"(?:#|//|--|/\*)\s*loom-ignore(-file)?(?:\s+([\w, -]+?))?\s*(?:--\s*(.*))?$")


def suppressions(file: str, text: str) -> list[dict]:
    """Comments that silence findings: in the whole file, or on the next line; for named rules or all."""
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        if m := SUPPRESS.search(line.rstrip()):
            rules = [r for r in re.split(r"[,\s]+", m[2] or "") if r]
            out.append({"file": file, "line": None if m[1] else n + 1, "rules": rules, "reason": m[3] or ""})
    return out


def suppress(findings: list[dict], marks: list[dict]) -> tuple[list[dict], list[dict]]:
    """(findings left, marks that silenced nothing)."""
    used, left = set(), []
    for f in findings:
        hits = [i for i, m in enumerate(marks) if m["file"] == f["file"] and (m["line"] is None or m["line"] == f["line"]) and (not m["rules"] or f["rule_id"] in m["rules"])]
        used.update(hits)
        if not hits:
            left.append(f)
    return left, [m for i, m in enumerate(marks) if i not in used]


def collapse(findings: DataFrame, key: str) -> DataFrame:
    """One row a clone band with the places of its members."""
    return findings.groupBy("rule_id", key).agg(F.sort_array(F.collect_set(F.struct("file", "line"))).alias("places"))
