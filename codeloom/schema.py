"""Codes and schemas of the code-graph tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

# Entity kinds, edge kinds, symbol kinds.
ENTITY = {k: i for i, k in enumerate("function class interface variable parameter export call literal member_access import catch throw control_flow route response extends implements decorator type_ref callable_boundary".split())}
EDGE = {"call": 0, "import": 1, "extends": 2, "implements": 3}
SYMBOL = {"binding": 0, "reference": 1}
#: Extracted but never stored.
DROPPED = [ENTITY[k] for k in ("literal", "member_access", "catch", "throw")]
DECLARATIONS = [ENTITY[k] for k in ("function", "class", "interface", "variable", "parameter")]

SPAN = "start_byte long, end_byte long, start_line int, start_col int, end_line int, end_col int"
FILES = "id long, path string, mtime long, size long, content_hash string, complexity long, churn long, fan_in long, fan_out long, community_id long, lang string, is_test_path boolean, is_tooling_path boolean"
ENTITIES = f"id long, kind int, name string, file_id long, {SPAN}, enclosing_function string, method string, path string, status string, body_shape string, body_minhash array<long>, is_async boolean, is_test boolean, owner_type string"
SYMBOLS = f"id long, kind int, name string, file_id long, {SPAN}"
DIAGNOSTICS = "id long, file_id long, message string, severity string"
EDGES = "id long, from_file_id long, to_file_id long, kind int, resolved boolean, from_entity_id long, to_entity_id long"


@dataclass
class Tables:
    """The queryable tables; rules see each as a view of its name."""

    files: DataFrame
    entities: DataFrame
    resolved_edges: DataFrame
    community_members: DataFrame
    symbols: DataFrame | None = None
    diagnostics: DataFrame | None = None
    clone_bands: DataFrame | None = None
    clone_band_members: DataFrame | None = None

    def register(self, spark: SparkSession) -> None:
        for f in fields(self):
            if (df := getattr(self, f.name)) is not None:
                df.createOrReplaceTempView(f.name)
