"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontaminate, mixing, near_dedup, token_output, toxicity
from codeloom.llm.common import Scratch, table
from codeloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    return toxicity.classify(docs, table(spark, sf_dir, "labels")).filter("not toxic").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; five-word shingles, similarity 0.8 or more."""
    return near_dedup.deduplicate(docs, k=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, up to its edit budget, go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned to their target weights."""
    return mixing.mix(docs).select(*docs.columns)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all documents are written as shards and read back: doc_id, start, n_tokens, ids_crc32."""
    # fewer pieces are kept than by default: the workers have served all earlier stages
    return token_output.round_trip(docs, tokenizer_path(), cache_pieces=150_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_output", write_token_ids),
]

#: SQL can express neither the classifier chain nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's documents are written and read again, and deleted once the next stage's are there."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.clear(name)
    out = STAGES[-1][1](spark, docs, sf_dir)  # reads the shards that it has written
    scratch.clear()
    return out
