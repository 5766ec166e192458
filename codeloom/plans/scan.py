"""The scan: pattern and SQL rules over one index, without generated files and suppressed findings; rewrites on request.

Findings stay DataFrames (FINDINGS) up to the end, where what is shown is collected: SHOWN rows at most, with the counts
of all of them.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import predicates as P
from codeloom.functions.hashing import fnv1a_column
from codeloom.operators import pattern_rules as PR
from codeloom.operators import patterns
from codeloom.operators import rules as R
from codeloom.operators.lineage import cut
from codeloom.schema import Tables

FINDINGS = "id string, rule_id string, severity string, message string, file string, line int, start_byte long, end_byte long, evidence string, remediation string, rewrite string, captures map<string,string>"
MARKS = "file string, at int, rules array<string>, reason string"
SHOWN = 5_000
#: Where packs are looked for: below the user's folder and below the repository.
PACKS = ".codeloom/rules"
_OWN = ("file", "line", "start_byte", "end_byte", "end_line")


def rendered(template: str, columns: dict[str, str]) -> Column:
    """The template with {column} by its value, for columns that hold text, numbers or truth."""
    parts, at = [], 0
    plain = ("string", "int", "bigint", "double", "float", "boolean", "smallint", "tinyint")
    for m in re.finditer(r"\{(\w+)\}", template):
        if columns.get(m[1], "").split("(")[0] in (*plain, "decimal"):
            parts += [F.lit(template[at : m.start()]), F.coalesce(F.col(m[1]).cast("string"), F.lit(m[0]))]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def finding_key(rule: Column, file: Column, start: Column, end: Column) -> Column:
    """16 hexadecimal digits of rule, file, start and end, parted by NUL."""
    return F.lpad(F.lower(F.hex(fnv1a_column(F.concat_ws("\0", rule, file, start.cast("string"), end.cast("string"))))), 16, "0")


def sql_findings(spark: SparkSession, rules: list[R.Rule]) -> tuple[DataFrame, list[dict]]:
    """(findings, diagnostics): a rule that fails is reported and the others go on."""
    found, diagnostics = [spark.createDataFrame([], FINDINGS)], []
    for rule in rules:
        try:
            df = R.run_rule(spark, rule)
            if missing := {"file", "line"} - set(df.columns):
                raise ValueError(f"the query lacks {sorted(missing)}")
            types = dict(df.dtypes)
            start, end = (F.coalesce(F.col(c).cast("long"), F.lit(0)) if c in types else F.lit(0).cast("long") for c in ("start_byte", "end_byte"))
            more = sorted(c for c in types if c not in _OWN)
            evidence = F.to_json(F.struct(*more)) if more else F.lit("{}")
            head = {"rule_id": F.lit(rule.id), "severity": F.lit(rule.severity), "message": rendered(rule.message, types), "line": F.col("line").cast("int"), "start_byte": start, "end_byte": end, "evidence": evidence, "remediation": F.lit(rule.remediation), "rewrite": F.lit(None).cast("string"), "captures": F.lit(None).cast("map<string,string>")}
            out = df.select("file", *[c.alias(n) for n, c in head.items()]).withColumn("id", finding_key(F.col("rule_id"), F.col("file"), F.col("start_byte"), F.col("end_byte")))
            found.append(cut(out.select(*[c.split()[0] for c in FINDINGS.replace("map<string,string>", "x").split(", ")]), "findings"))
        except Exception as e:  # noqa: BLE001 - a user's query may fail in any way
            diagnostics.append({"rule_id": rule.id, "message": str(e).splitlines()[0]})
    return reduce(DataFrame.unionByName, found), diagnostics


def pattern_findings(sources: DataFrame, rules: list[PR.PatternRule], tables: Tables | None = None) -> tuple[DataFrame, list[dict]]:
    """(findings, diagnostics) of (path, text); evidence holds what was captured, and the function around the hit."""
    diagnostics = [{"rule_id": r.id, "message": p} for r in rules for p in r.problems()]
    good = [r for r in rules if not r.problems()]
    if not good:
        return sources.sparkSession.createDataFrame([], FINDINGS), diagnostics
    hits = cut(PR.scan_patterns(sources, good), "hits")
    diagnostics += [{"rule_id": r.rule_id, "message": f"{r.problem} in {r.file}"} for r in hits.filter("problem is not null").select("rule_id", "problem", "file").limit(100).collect()]
    hits = hits.filter("problem is null")
    if tables is not None:
        hits = PR.with_enclosing(hits, tables.files, tables.entities)
    else:
        hits = hits.withColumn("enclosing", F.lit(None).cast("string"))
    message = F.col("message")
    for name in {m for r in good for m in re.findall(r"\{(\w+)\}", r.message)}:
        message = F.replace(message, F.lit(f"{{{name}}}"), F.coalesce(F.try_element_at("captures", F.lit(name)), F.lit(f"{{{name}}}")))
    evidence = F.to_json(F.struct("captures", "enclosing"))
    out = hits.select(finding_key(F.col("rule_id"), F.col("file"), F.col("start_byte"), F.col("end_byte")).alias("id"), "rule_id", "severity", message.alias("message"), "file", F.col("start_line").alias("line"), "start_byte", "end_byte", evidence.alias("evidence"), "remediation", "rewrite", "captures")
    return out, diagnostics


def suppression_marks(sources: DataFrame) -> DataFrame:
    """MARKS of (path, text): at is the line that is silenced, null for the whole file; no rules mean all."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(m["file"], m["line"], m["rules"], m["reason"]) for p, t in zip(f.path, f.text, strict=True) for m in R.suppressions(p, t)]
            out = pd.DataFrame(rows, columns=["file", "at", "rules", "reason"])
            out["at"] = out["at"].astype("Int64")
            yield out.astype(object).where(out.notna(), None)

    return sources.filter(F.col("text").contains("loom-ignore")).select("path", "text").mapInPandas(run, MARKS)


def suppressed(findings: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings left, marks that silenced nothing). A file's marks and findings meet by the file."""
    marks = marks.withColumn("mark", F.xxhash64("file", "at", "rules", "reason"))
    hit = (F.col("at").isNull() | (F.col("at") == F.col("line"))) & ((F.size("rules") == 0) | F.array_contains(F.col("rules"), F.col("rule_id")))
    pairs = cut(findings.select("id", "rule_id", "file", "line").join(marks.select("file", "at", "rules", "mark"), "file").filter(hit).select("id", "line", "mark").distinct(), "silenced")
    left = findings.join(pairs.select("id", "line").distinct(), ["id", "line"], "left_anti")
    return left, marks.join(pairs.select("mark").distinct(), "mark", "left_anti").drop("mark")


def collapsed(findings: DataFrame, rule: str = "duplicate-code-clone") -> DataFrame:
    """The findings with one row for each clone band instead of one a member: the first member's, with the places of all
    in its evidence."""
    band = F.get_json_object("evidence", "$.band_id")
    clones = findings.filter(F.col("rule_id") == rule).withColumn("band", band)
    places = clones.groupBy("band").agg(F.sort_array(F.collect_list(F.struct("file", "line", "start_byte", "end_byte"))).alias("places"), F.min(F.struct("file", "line", "start_byte", "id")).alias("first"))
    kept = clones.join(places.select(F.col("band").alias("b"), "places", "first"), F.col("band") == F.col("b")).filter((F.col("id") == F.col("first.id")) & (F.col("line") == F.col("first.line"))).dropDuplicates(["band"])
    evidence = F.to_json(F.struct(F.col("band").alias("band_id"), F.size("places").alias("members"), "places"))
    kept = kept.withColumn("evidence", evidence).select(*findings.columns)
    return findings.filter(F.col("rule_id") != rule).unionByName(kept)


def legend_of(findings: DataFrame) -> list[dict]:
    """Severity, remediation and count of each rule that found something: said once, not with each finding."""
    rows = findings.groupBy("rule_id").agg(F.first("severity").alias("severity"), F.first("remediation").alias("remediation"), F.count(F.lit(1)).alias("findings"))
    return [r.asDict() for r in rows.orderBy("rule_id").collect()]


def reaches(findings: DataFrame, threshold: str = "error") -> bool:
    """Whether a finding is at least that severe."""
    wanted = R.SEVERITIES[R.SEVERITIES.index(threshold) :]
    return findings.filter(F.col("severity").isin(wanted)).limit(1).count() > 0


# rewrites


def clean_tree(root: str) -> bool:
    """Whether the repository has no uncommitted changes: rewrites are undone by its own means."""
    run = subprocess.run(["git", "-C", root, "status", "--porcelain"], capture_output=True, text=True)
    return run.returncode == 0 and not run.stdout.strip()


def write_file(path: str, text: str) -> None:
    """All of it or nothing, with the old file's mode."""
    mode = os.stat(path).st_mode
    fd, fresh = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w", newline="") as f:
        f.write(text)
    os.chmod(fresh, mode)
    os.replace(fresh, path)


def apply_rewrites(findings: DataFrame, root: str, force: bool = False) -> tuple[dict[str, str], list[dict]]:
    """({finding id: status}, counts by status) of findings with a rewrite: applied, overlapped, no_template or refused.
    Only the files that change are touched, one after the other, by the driver."""
    wanted = findings.filter("rewrite is not null").select("id", "file", "start_byte", "end_byte", "rewrite", "captures")
    status: dict[str, str] = {r.id: "no_template" for r in findings.filter("rewrite is null and captures is not null").select("id").limit(SHOWN).collect()}
    allowed = force or clean_tree(root)
    for file in [r.file for r in wanted.select("file").distinct().orderBy("file").collect()]:
        matches = [r.asDict() for r in wanted.filter(F.col("file") == file).orderBy("start_byte", "end_byte").collect()]
        if not allowed:
            status |= {m["id"]: "refused" for m in matches}
            continue
        path, end = os.path.join(root, file), 0
        for m in matches:
            status[m["id"]] = "applied" if m["start_byte"] >= end else "overlapped"
            end = m["end_byte"] if m["start_byte"] >= end else end
        with open(path, newline="") as f:
            text = f.read()
        write_file(path, patterns.plan_rewrites(text, matches)[0])
    counts: dict[str, int] = {}
    for s in status.values():
        counts[s] = counts.get(s, 0) + 1
    return status, [{"status": s, "count": n} for s, n in sorted(counts.items())]


# packs


def pack_folders(root: str | None) -> list[Path]:
    return [Path.home() / PACKS, *([Path(root) / PACKS] if root else [])]


_PATTERN_FIELDS = {"id", "kind", "severity", "message", "pattern", "patterns", "languages", "language", "constraints", "relations", "tests", "tooling", "rewrite", "remediation", "valid", "invalid", "expect"}


def load_patterns(folder: Path) -> tuple[list[PR.PatternRule], list[dict]]:
    """Pattern rules of the TOML files of a folder; broken ones are reported and left out."""
    import tomllib

    found, diagnostics = [], []
    for file in sorted(folder.glob("*.toml")):
        try:
            entries = tomllib.loads(file.read_text()).get("rule", [])
        except tomllib.TOMLDecodeError:
            continue  # rules.load_pack reports it
        for x in entries:
            if x.get("kind") != "pattern":
                continue
            say = lambda what, x=x, file=file: diagnostics.append({"file": str(file), "message": f"rule {x.get('id', '?')}: {what}"})
            shapes = x.get("patterns", [x["pattern"]] if "pattern" in x else [])
            if not {"id", "message"} <= x.keys() or not shapes or x.get("severity", "warning") not in R.SEVERITIES or x.keys() - _PATTERN_FIELDS:
                say("a field is missing, unknown or wrong")
                continue
            langs = tuple(P.canonical_language(n) or n for n in x.get("languages", [x.get("language", "python")]))
            rule = PR.PatternRule(x["id"], x.get("severity", "warning"), x["message"], shapes, x.get("constraints", {}), x.get("relations", {}), x.get("tests", True), x.get("tooling", True), langs, x.get("rewrite"), x.get("remediation", ""), x.get("valid", []), x.get("invalid", []), x.get("expect"))
            if problems := rule.problems():
                say("; ".join(problems))
                continue
            found.append(rule)
    return found, diagnostics


@dataclass
class Packs:
    sql: list[R.Rule]
    patterns: list[PR.PatternRule]
    diagnostics: list[dict] = field(default_factory=list)


def load_packs(root: str | None, more: list[str] = ()) -> Packs:
    """Built-in rules, then the user's, the repository's and more folders' ones; later ones win by id."""
    out = Packs(list(R.BUILTIN), list(PR.BUILTIN))
    for folder in [*pack_folders(root), *map(Path, more)]:
        if not folder.is_dir():
            continue
        sql, problems = R.load_pack(folder)
        shapes, worse = load_patterns(folder)
        known = {r.id for r in [*sql, *shapes]}
        out.sql = [r for r in out.sql if r.id not in known] + sql
        out.patterns = [r for r in out.patterns if r.id not in known] + shapes
        out.diagnostics += problems + worse
    return out


def seed_packs(root: str, force: bool = False) -> list[dict]:
    """Write the built-in rules as files below root, to be changed there: {file, outcome}."""
    folder, out = Path(root) / PACKS, []
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in (("sql.toml", "".join(map(_sql_toml, R.BUILTIN))), ("patterns.toml", "".join(map(_pattern_toml, PR.BUILTIN)))):
        there = (folder / name).exists()
        if there and not force:
            out.append({"file": name, "outcome": "kept"})
            continue
        (folder / name).write_text(text)
        out.append({"file": name, "outcome": "overwritten" if there else "written"})
    return out


def remove_packs(root: str) -> list[dict]:
    """Delete the files that seed_packs writes."""
    out = []
    for name in ("sql.toml", "patterns.toml"):
        path = Path(root) / PACKS / name
        out.append({"file": name, "outcome": "removed" if path.exists() else "absent"})
        path.unlink(missing_ok=True)
    return out


def list_packs(root: str | None) -> list[dict]:
    packs = load_packs(root)
    return sorted(({"id": r.id, "kind": kind, "severity": r.severity} for kind, some in (("sql", packs.sql), ("pattern", packs.patterns)) for r in some), key=lambda x: (x["id"], x["kind"]))


def _toml(value) -> str:
    return json.dumps(value) if not isinstance(value, dict) else "{" + ", ".join(f"{json.dumps(k)} = {_toml(v)}" for k, v in value.items()) + "}"


def _sql_toml(r: R.Rule) -> str:
    return "[[rule]]\n" + "".join(f"{k} = {_toml(v)}\n" for k, v in {"id": r.id, "kind": "sql", "severity": r.severity, "message": r.message, "query": r.sql(), "thresholds": r.thresholds, "strings": r.strings, "remediation": r.remediation}.items()) + "\n"


def _pattern_toml(r: PR.PatternRule) -> str:
    fields = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(r).items() if v is not None}
    return "[[rule]]\nkind = \"pattern\"\n" + "".join(f"{k} = {_toml(v)}\n" for k, v in fields.items()) + "\n"


def self_tests(spark: SparkSession, packs: Packs, limit: int = 100) -> dict:
    """Results of the rules' own texts, failures first, limit of them at most, with the counts of all."""
    results = [x for r in packs.patterns for x in PR.self_test(r)] + [x for r in packs.sql for x in R.self_test(spark, r)]
    shown = sorted(results, key=lambda x: (x["passed"], x["rule"], x["case"]))[:limit]
    return {"results": shown, "passed": sum(x["passed"] for x in results), "failed": sum(not x["passed"] for x in results), "guide": {"total": len(results), "shown": len(shown)}}


def scan(spark: SparkSession, tables: Tables, sources: DataFrame | None, root: str | None = None, packs: Packs | None = None, apply: bool = False, force: bool = False) -> tuple[DataFrame, dict]:
    """(findings, payload) of all rules. sources: (path, text) of the indexed files, for patterns and suppressions.

    Order: patterns, SQL, without generated files, without suppressed ones, rewrites, one row a clone band, legend.
    """
    packs = packs or load_packs(root)
    tables.register(spark)
    findings, diagnostics = sql_findings(spark, packs.sql)
    stale = None
    if sources is not None:
        hits, problems = pattern_findings(sources, packs.patterns, tables)
        findings, diagnostics = hits.unionByName(findings), diagnostics + problems
    findings = findings.filter(~P.is_generated_path(F.col("file")))
    if sources is not None:
        findings, stale = suppressed(cut(findings, "findings"), suppression_marks(sources))
    findings = cut(findings, "findings")
    payload: dict = {"diagnostics": packs.diagnostics + diagnostics, "stale_suppressions": [r.asDict() for r in stale.orderBy("file", "at").limit(SHOWN).collect()] if stale is not None else []}
    if apply:
        payload["rewrites"], payload["rewrite_counts"] = apply_rewrites(findings, root, force)
    findings = cut(collapsed(findings), "findings")
    payload["legend"] = legend_of(findings)
    total = sum(x["findings"] for x in payload["legend"])
    order = F.array_position(F.array(*map(F.lit, R.SEVERITIES)), F.col("severity"))
    shown = findings.drop("remediation", "rewrite", "captures").orderBy(order.desc(), "file", "line", "rule_id", "id").limit(SHOWN).collect()
    payload["findings"] = [r.asDict() for r in shown]
    if total > len(shown):
        payload["guide"] = {"total": total, "shown": len(shown)}
    return findings, payload
