"""python -m codeloom.cli build ROOT INDEX | query JSON [OUTPUT] | map INDEX | extract PATH [OUTPUT] |
scan INDEX [--repoRoot=ROOT] [--rules=FOLDER] [--threshold=SEVERITY] [--apply] [--force] [--output=FILE] |
rules list|seed|remove|test [ROOT] [--force]"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession


def put(text: str, output: str | None = None) -> None:
    """To a file, or to the standard output."""
    if output:
        with open(output, "w") as f:
            f.write(text + "\n")
    else:
        print(text)


def main(args: list[str]) -> int:
    from codeloom.plans import index, modes, navmap

    spark = SparkSession.builder.getOrCreate()
    if args[:1] == ["build"]:
        print(json.dumps(modes.envelope(index.build(spark, args[1], args[2], "--force" in args))))
        return 0
    if args[:1] == ["query"]:
        try:
            out = modes.run_query(spark, json.loads(args[1]))
        except json.JSONDecodeError as e:
            out = modes.failure("invalid_input", str(e))
        put(json.dumps(out, default=str), args[2] if len(args) > 2 else None)
        return int(not out["ok"])
    if args[:1] == ["map"]:
        out = modes.run_query(spark, {"mode": "nav_map", "dbPath": args[1]})
        put(navmap.as_text(out["data"]) if out["ok"] else json.dumps(out))
        return int(not out["ok"])
    if args[:1] == ["scan"]:
        more = dict(a.removeprefix("--").split("=", 1) if "=" in a else (a.removeprefix("--"), True) for a in args[2:])
        out = modes.run_query(spark, {"mode": "scan", "dbPath": args[1], "severityThreshold": more.pop("threshold", "error"), **more})
        put(json.dumps(out, default=str), more.get("output"))
        return int(bool(out["data"].get("exceeded")) or not out["ok"])
    if args[:1] == ["rules"]:
        out = modes.run_query(spark, {"mode": "rules", "do": args[1], **({"repoRoot": args[2]} if len(args) > 2 else {}), "force": "--force" in args})
        put(json.dumps(out, default=str))
        return int(not out["ok"] or isinstance(out["data"], dict) and bool(out["data"].get("failed")))
    if args[:1] == ["extract"]:
        put(json.dumps(modes.envelope(index.extract_counts(spark, args[1])), default=str), args[2] if len(args) > 2 else None)
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
