"""Source listings, contents and repository history as DataFrames."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import predicates as P
from codeloom.functions.hashing import fnv1a_column

CHURN_DAYS = 90
LISTING = "path string, mtime long, size long"


def ignore_regex(pattern: str) -> str:
    """A pattern of an ignore file, as a regular expression for paths below the file's folder: * and ? stay within a
    name, ** goes over folders; a pattern with a slash before its end counts from the folder, any other at any depth."""
    body = pattern.rstrip("/")
    anchored = "/" in body
    body = body.removeprefix("/")
    out, i = "" if anchored else "(?:.*/)?", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and (end := body.find("]", i + 2)) > 0:
            inner = body[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif body[i] == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(body[i]), i + 1
    return out


def _ignores(folder: str) -> list[tuple[re.Pattern, bool, bool]]:
    """(pattern, negated, folders only) of a folder's ignore file."""
    out = []
    try:
        lines = Path(folder, ".gitignore").read_text(errors="replace").splitlines()
    except OSError:
        return out
    for line in lines:
        line = line if line.endswith("\\ ") else line.rstrip()
        if not line or line[0] == "#":
            continue
        negated = line[0] == "!"
        body = line[1:] if negated else line
        try:
            out.append((re.compile(ignore_regex(body), re.S), negated, body.endswith("/")))
        except re.error:
            continue
    return out


def _ignored(path: str, is_dir: bool, rules: list[tuple[str, list]]) -> bool:
    """By the last pattern that fits; what lies in an ignored folder is never asked."""
    hit = False
    for base, patterns in rules:
        rel = os.path.relpath(path, base).replace(os.sep, "/")
        for pattern, negated, dirs in patterns:
            if (is_dir or not dirs) and pattern.fullmatch(rel):
                hit = not negated
    return hit


def list_sources(root: str) -> list[tuple[str, int, int]]:
    """(path, mtime in ns, size) below root in path order: hidden files too, .git never, ignored ones not; -1: unknown."""
    root = os.path.abspath(root)
    found: list[str] = [root] if os.path.isfile(root) else []

    def walk(folder: str, rules: list) -> None:
        rules = [*rules, (folder, _ignores(folder))]
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            if entry.name == ".git" or _ignored(entry.path, entry.is_dir(follow_symlinks=False), rules):
                continue
            if entry.is_dir(follow_symlinks=False):
                walk(entry.path, rules)
            elif entry.is_file():
                found.append(entry.path)

    if os.path.isdir(root):
        walk(root, [])
    out = []
    for p in sorted(found):
        try:
            s = os.stat(p)
            out.append((os.path.relpath(p, root) if os.path.isdir(root) else p, s.st_mtime_ns, s.st_size))
        except OSError:
            out.append((os.path.relpath(p, root), -1, -1))
    return out


def listing(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame(list_sources(root), LISTING)


def with_contents(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """(id, path, mtime, size, lang, content, content_hash): ids rank the paths; contents are read by executors."""
    listed = files if files is not None else listing(spark, root)
    ranked = spark.createDataFrame([(i, *r) for i, r in enumerate(sorted(tuple(r) for r in listed.select("path", "mtime", "size").collect()), 1)], f"id long, {LISTING}")
    base = os.path.abspath(root)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Hidden and underscored names too, which Spark's own file listing leaves out; null if unreadable."""
        for f in frames:
            contents = []
            for p in f.path:
                try:
                    contents.append(Path(base, p).read_bytes())
                except OSError:
                    contents.append(None)
            yield pd.DataFrame({"path": f.path, "content": contents})

    raw = ranked.select("path").repartition("path").mapInPandas(read, "path string, content binary")
    out = ranked.join(raw, "path").withColumn("lang", P.language(F.col("path")))
    return out.withColumn("content_hash", F.lpad(F.lower(F.hex(fnv1a_column(F.col("content")))), 16, "0"))


def churn(spark: SparkSession, root: str, days: int = CHURN_DAYS) -> DataFrame:
    """(path, churn): commits of the last days that touch a path; nothing outside a repository."""
    cmd = ["git", "-C", root, "-c", "core.quotepath=false", "log", f"--since={days} days ago", "--name-only", "--pretty=format:%x01"]
    run = subprocess.run(cmd, capture_output=True, text=True, errors="replace")
    rows = [(i, line) for i, block in enumerate(run.stdout.split("\x01")) for line in block.splitlines() if line] if run.returncode == 0 else []
    return spark.createDataFrame(rows, "commit int, path string").groupBy("path").agg(F.count(F.lit(1)).alias("churn"))


def changed_files(root: str, mode: str = "working", span: str | None = None) -> list[tuple[str, str]]:
    """(status, path) of a difference: staged, range or working tree."""
    extra = {"staged": ["--cached"], "range": [span or "HEAD~1..HEAD"], "working": ["HEAD"]}[mode]
    run = subprocess.run(["git", "-C", root, "-c", "core.quotepath=false", "diff", "--name-status", *extra], capture_output=True, text=True)
    return [(line.split("\t")[0][0], line.split("\t")[-1]) for line in run.stdout.splitlines() if "\t" in line]


def git_status(root: str) -> tuple[list[str], list[str], bool] | None:
    """(changed, deleted, whether files were added or went) of the working tree; None outside a repository."""
    run = subprocess.run(["git", "-C", root, "status", "--porcelain=v1", "-z", "--untracked-files=all"], capture_output=True, text=True, errors="replace")
    if run.returncode:
        return None
    fields, changed, deleted, moved = iter(run.stdout.split("\0")), [], [], False
    for field in fields:
        if not field:
            continue
        state, path = field[:2], field[3:]
        if "R" in state or "C" in state:
            old = next(fields, "")
            moved = True
            changed.append(path)
            if "R" in state:
                deleted.append(old)
        elif "D" in state:
            deleted.append(path)
            moved = True
        else:
            changed.append(path)
            moved |= state == "??" or "A" in state
    return sorted(changed), sorted(deleted), moved


def go_modules(root: str) -> list[tuple[str, str]]:
    """(module path, folder), the longest path first."""
    out = []
    for p, _, _ in list_sources(root):
        if os.path.basename(p) == "go.mod" and (m := re.search(r"^module\s+(\S+)", Path(root, p).read_text(errors="replace"), re.M)):
            out.append((m[1], os.path.dirname(p)))
    return sorted(out, key=lambda x: -len(x[0]))
