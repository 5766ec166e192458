"""Predicates on paths and names, as columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# LIKE patterns (backslash escapes), matched without regard to ASCII case.
TEST_PATHS = [
    "%/test/%", "%/tests/%", "%/__tests__/%", "%/spec/%", "%/specs/%", "%/fixture/%", "%/fixtures/%", "%.test.%", "%.spec.%", "test/%", "tests/%",
    r"%\_test.go", r"%/test\_%.py", r"test\_%.py", r"%\_test.py", "%Test.java", "%Tests.java", "%Test.kt", "%Tests.kt", "%Test.cs", "%Tests.cs",
    "%.Test/%", "%.Tests/%", "%.UnitTests/%", "%.IntegrationTests/%", "%.FunctionalTests/%", "%.AcceptanceTests/%",
    r"%\_test.cc", r"%\_test.cpp", r"%\_test.cxx", "%.t.sol", "%.bats", r"%\_spec.rb", r"%\_test.rb", "%/test.rs", "%/tests.rs", "test.rs", "tests.rs",
]
TOOLING_PATHS = ["%/bench/%", "%/benches/%", "%/benchmark/%", "%/benchmarks/%", "bench/%", "benches/%", "%/scripts/%", "%/script/%", "scripts/%", "script/%", "%/docs/%", "docs/%", "%/.claude/%", ".claude/%"]
# Folders, folder sequences and endings of generated files.
EXCLUDED_DIRS = ["target", "node_modules", "dist", "build", "vendor", "third_party", "third-party", "bower_components", ".next", ".nuxt", "grammars"]
EXCLUDED_SEQUENCES = ["priv/static", "alembic/versions", "migrations/versions"]
GENERATED_SUFFIXES = [".min.js", ".min.mjs", ".min.cjs", ".min.css", ".bundle.js", ".bundle.mjs", ".pb.go", ".gen.go", ".gen.ts", ".gen.tsx", ".gen.js", ".gen.mjs", ".gen.cjs"]
# Extensions of front-end assets.
ASSET_EXTENSIONS = ["js", "mjs", "cjs", "jsx", "ts", "tsx", "css", "scss", "sass", "less", "vue", "svelte"]
# Names that tell a reader little, names of data methods, names that every object has.
LOW_ORIENTATION = ["new", "push", "pop", "size", "len", "length", "begin", "end", "clone", "merge", "dig", "unwrap", "default", "hash", "into", "from", "as_str", "as_ref", "as_mut", "to_string", "tostring", "configureawait", "true", "false", "none", "null", "notnull", "nil"]
DATA_METHODS = ["equals", "hashcode", "tostring", "compareto", "clone", "copy", "builder", "of", "valueof", "with", "deconstruct"]
OBJECT_METHODS = ["ToString", "Equals", "GetHashCode", "GetType", "Clone", "CompareTo", "Dispose", "DisposeAsync", "Finalize", "MemberwiseClone", "toString", "equals", "hashCode", "clone", "compareTo", "finalize", "close", "hash", "encode", "==", "!=", "<", "<=", ">", ">="]
# Fixed value: accessor names.
ACCESSOR = "^(get|set|is|has)($|_|[A-Z])"
# Extensions of each language.
LANGUAGES = {
    "typescript": ["ts", "mts", "cts"], "tsx": ["tsx"], "javascript": ["js", "jsx", "mjs", "cjs"], "c": ["c", "h"], "cpp": ["cpp", "cc", "cxx", "c++", "hpp", "hh", "hxx", "h++"],
    "go": ["go"], "java": ["java"], "csharp": ["cs"], "kotlin": ["kt", "kts"], "swift": ["swift"], "python": ["py"], "ruby": ["rb"], "php": ["php"], "lua": ["lua"],
    "scala": ["scala", "sc", "sbt"], "dart": ["dart"], "elixir": ["ex", "exs"], "solidity": ["sol"], "haskell": ["hs"], "bash": ["sh", "bash", "zsh", "ksh", "bats"], "rust": ["rs"],
}
EXTENSIONS = {e: lang for lang, es in LANGUAGES.items() for e in es}
# Other names of languages, and extensions that only the pattern search takes.
ALIASES = {"ts": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "rb": "ruby", "golang": "go", "rs": "rust", "c++": "cpp", "c#": "csharp", "cs": "csharp", "kt": "kotlin", "sh": "bash", "shell": "bash", "ex": "elixir", "hs": "haskell", "sol": "solidity"}
SEARCH_ONLY = {"pyi": "python", "pyw": "python", "phtml": "php", "rake": "ruby", "gemspec": "ruby", "ino": "cpp", "ipp": "cpp", "tpp": "cpp", "csx": "csharp"}


def canonical_language(name: str | None) -> str | None:
    """The language of a name, an alias or an extension with or without its stop; None if there is none."""
    low = (name or "").strip().lower().removeprefix(".")
    return low if low in LANGUAGES else ALIASES.get(low) or EXTENSIONS.get(low)


def search_language(path: str) -> str | None:
    """The language in which pattern search reads a file."""
    extension = path.rpartition("/")[2].rpartition(".")[2].lower()
    return EXTENSIONS.get(extension) or SEARCH_ONLY.get(extension)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def like_regex(patterns: list[str]) -> str:
    """One regular expression for LIKE patterns, without regard to ASCII case: a path is looked through once."""

    def one(pattern: str) -> str:
        body = re.sub(r"\\_|%|_|[^\w%]", lambda m: "_" if m[0] == r"\_" else ".*" if m[0] == "%" else "." if m[0] == "_" else re.escape(m[0]), pattern.strip("%"))
        return ("" if pattern[0] == "%" else "^") + body + ("" if pattern[-1] == "%" else r"\z")

    return "(?is)" + "|".join(map(one, patterns))


def is_test_path(path: Column) -> Column:
    return path.rlike(like_regex(TEST_PATHS))


def is_tooling_path(path: Column) -> Column:
    return path.rlike(like_regex(TOOLING_PATHS))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """Null for an extension without a language."""
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(table, extension(path))


def is_generated_path(path: Column) -> Column:
    parts = F.split(path, "/")
    within = F.concat(F.lit("/"), path)
    return F.arrays_overlap(parts, F.array(*map(F.lit, EXCLUDED_DIRS))) | _any([within.contains(f"/{s}/") for s in EXCLUDED_SEQUENCES]) | _any([path.endswith(s) for s in GENERATED_SUFFIXES])


def is_asset_path(path: Column) -> Column:
    return F.array_contains(F.split(path, "/"), "assets") & extension(path).isin(ASSET_EXTENSIONS)


def is_template_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(F.lit("templates"), F.lit("template")))


def is_noise_path(path: Column) -> Column:
    return is_generated_path(path) | is_asset_path(path) | is_template_path(path) | language(path).isNull()


def is_accessor(name: Column) -> Column:
    return name.rlike(ACCESSOR)


def is_low_orientation(name: Column) -> Column:
    return is_accessor(name) | F.lower(name).isin(LOW_ORIENTATION)


def is_trivial_method(name: Column) -> Column:
    return is_accessor(name) | F.lower(name).isin(DATA_METHODS)


def contains_unescaped(column: Column, query: Column) -> Column:
    """Substring seed: wildcards of the query keep their meaning."""
    return F.lower(column).like(F.concat(F.lit("%"), F.lower(query), F.lit("%")))


def is_minified(text: Column) -> Column:
    """A generated-code header in the first five lines, or one line of 2000 characters and half of all of 500."""
    lines = F.split(text, "\n")
    header = F.exists(F.slice(lines, 1, 5), lambda x: x.rlike("Code generated .* DO NOT EDIT"))
    longest = F.array_max(F.transform(lines, F.length))
    return header | ((longest >= 2000) & (F.size(F.filter(lines, lambda x: F.length(x) >= 500)) * 2 >= F.size(lines)))
