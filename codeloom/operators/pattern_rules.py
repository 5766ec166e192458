"""Rules whose hits are matches of structural patterns, each in its languages."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import predicates as P
from codeloom.operators import lookups, patterns


@dataclass
class PatternRule:
    """patterns: of one rule in its languages; tests, tooling: whether such files count; rewrite: a template for hits;
    valid, invalid: texts that the rule must leave alone or find, expect: what its rewrite makes of the first."""

    id: str
    severity: str
    message: str
    patterns: list[str]
    constraints: dict[str, str] = field(default_factory=dict)
    relations: dict[str, str] = field(default_factory=dict)
    tests: bool = True
    tooling: bool = True
    languages: tuple[str, ...] = ("python",)
    rewrite: str | None = None
    remediation: str = ""
    valid: list[str] = field(default_factory=list)
    invalid: list[str] = field(default_factory=list)
    expect: str | None = None

    def problems(self) -> list[str]:
        """What is wrong with the rule."""
        out = []
        for lang in self.languages:
            if lang not in P.LANGUAGES:
                out.append(f"{self.id}: unknown language {lang}")
                continue
            for p in self.patterns:
                try:
                    patterns.check_pattern(p, lang)
                except patterns.InvalidPattern as e:
                    out.append(f"{self.id}: {e}")
        holes = [set(re.findall(r"\$+(\w+)", p)) for p in self.patterns]
        for name in set(re.findall(r"\$+\{?(\w+)", self.rewrite or "")):
            if not all(name in h for h in holes):
                out.append(f"{self.id}: not every pattern captures {name}")
        for name in self.constraints:
            if not any(name in h for h in holes):
                out.append(f"{self.id}: no pattern captures {name}")
        for regex in self.constraints.values():
            try:
                re.compile(regex.removeprefix("!"))
            except re.error as e:
                out.append(f"{self.id}: {e}")
        return out


_SCRIPTS = ("javascript", "typescript", "tsx")
#: What a name of a secret looks like, and a literal that may be one.
_KEY = r"(?i)(pass(word|wd|phrase)?|secret|token|api_?key|credential|private_?key)\w*[\"']?$"
_VALUE = r"^[\"'`][^\s\"'`${}<>]{8,}[\"'`]$"
BUILTIN = [
    PatternRule("empty-except-block", "warning", "exception is swallowed", ["try:\n    $$$B\nexcept $E:\n    pass", "try:\n    $$$B\nexcept:\n    pass"], {"E": "!StopIteration|KeyboardInterrupt"}),
    PatternRule("empty-catch-block", "warning", "the catch does nothing with what it catches", ["catch ($$$E) {}", "catch {}"], languages=(*_SCRIPTS, "java", "csharp", "kotlin", "php", "dart", "scala", "cpp")),
    PatternRule("empty-catch-block-swift", "warning", "the catch does nothing with what it catches", ["catch {}", "catch $E {}"], languages=("swift",)),
    PatternRule("eval-usage", "error", "eval runs any code that it is given", ["eval($$$A)"]),
    PatternRule("eval-usage", "error", "eval runs any code that it is given", ["eval($$$A)"], languages=_SCRIPTS),
    PatternRule("debug-statement-strict", "info", "leftover debug output", ["print($$$A)", "breakpoint()"], tests=False, tooling=False),
    PatternRule("debug-macro-strict", "info", "leftover debug output", ["dbg!($$$A)", "println!($$$A)", "eprintln!($$$A)"], tests=False, tooling=False, languages=("rust",)),
    PatternRule("console-log-strict", "info", "leftover debug output", ["console.log($$$A)", "console.debug($$$A)", "debugger"], tests=False, tooling=False, languages=_SCRIPTS),
    PatternRule("hardcoded-credential-literal", "error", "{KEY} is written into the code", ["$KEY: $VAL:string", "$KEY = $VAL:string"], {"KEY": _KEY, "VAL": _VALUE}, tests=False, languages=(*_SCRIPTS, "go", "java", "csharp", "kotlin", "swift", "php", "dart", "scala", "rust")),
    PatternRule("hardcoded-credential-declaration", "error", "{KEY} is written into the code", ["const $KEY = $VAL:string", "let $KEY = $VAL:string", "var $KEY = $VAL:string", "val $KEY = $VAL:string"], {"KEY": _KEY, "VAL": _VALUE}, tests=False, languages=(*_SCRIPTS, "go", "kotlin", "swift", "scala")),
]


def scan_patterns(sources: DataFrame, rules: list[PatternRule]) -> DataFrame:
    """(rule_id, severity, message, rewrite, remediation, file, kind, text, span, captures, problem) of (path, text), each
    hit once."""
    found = []
    langs = F.coalesce(P.language(F.col("path")), F.lit(""))
    for r in rules:
        kept = sources
        if not r.tests:
            kept = kept.filter(~P.is_test_path(F.col("path")))
        if not r.tooling:
            kept = kept.filter(~P.is_tooling_path(F.col("path")))
        for lang in r.languages:
            for p in r.patterns:
                hits = patterns.search(kept.filter(langs == lang), p, r.relations, r.constraints, lang)
                head = {"rule_id": r.id, "severity": r.severity, "message": r.message, "rewrite": r.rewrite, "remediation": r.remediation}
                found.append(hits.select(*[F.lit(v).cast("string").alias(k) for k, v in head.items()], "*"))
    return reduce(DataFrame.unionByName, found).dropDuplicates(["rule_id", "file", "start_line", "start_col"])


def with_enclosing(hits: DataFrame, files: DataFrame, entities: DataFrame) -> DataFrame:
    """hits with the shortest function around each (null outside of any): matched by lines within the file."""
    spans = hits.join(files.select(F.col("path").alias("file"), F.col("id").alias("file_id")), "file").withColumn("span_id", F.xxhash64("rule_id", "file", "start_line", "start_col"))
    by_line = entities.select("kind", "id", "name", "file_id", F.col("start_line").alias("start_byte"), F.col("end_line").alias("end_byte"))
    around = lookups.narrowest_enclosing(spans.select("span_id", "file_id", F.col("start_line").alias("start_byte"), F.col("end_line").alias("end_byte")), by_line)
    return spans.join(around, "span_id", "left").drop("span_id", "file_id", "fn_id").withColumnRenamed("fn_name", "enclosing")


def self_test(rule: PatternRule) -> list[dict]:
    """One result for each of the rule's own texts: {rule, case, passed}."""
    out = []

    def hits(text: str, lang: str) -> list[dict]:
        return [m for p in rule.patterns for m in patterns.search_text(p, text, rule.relations, lang) if patterns.constrained(m["captures"], rule.constraints)]

    for lang in rule.languages[:1]:
        out += [{"rule": rule.id, "case": f"valid {i}", "passed": not hits(t, lang)} for i, t in enumerate(rule.valid)]
        out += [{"rule": rule.id, "case": f"invalid {i}", "passed": bool(hits(t, lang))} for i, t in enumerate(rule.invalid)]
        if rule.expect is not None and rule.rewrite is not None and rule.invalid:
            out.append({"rule": rule.id, "case": "rewrite", "passed": patterns.plan_rewrites(rule.invalid[0], hits(rule.invalid[0], lang), rule.rewrite)[0] == rule.expect})
    return out
