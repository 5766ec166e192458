"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to vectorised code in slices of about so many bytes.
SLICE_BYTES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own if all of
    Spark runs in this process (master local, as in tests), and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        path = f"file://{tempfile.gettempdir()}/codeloom-checkpoint"
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables in the shared folder, and their end: keep() materialises, clear() deletes all but the named."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, list[str]] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        self.paths.setdefault(name, []).append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, *but: str) -> None:
        for name in [n for n in self.paths if n not in but]:
            for path in self.paths.pop(name):
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> Column:
    """16 bytes of a row's doc_id and text: rows with the same key are repeats, whatever their other columns."""
    doc = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat_ws("\n", doc, F.concat(F.lit("="), F.col("text")))))


#: Rows of text that go to a Python worker at once: Spark's 10,000 long ones fill an executor beside the JVM's heap.
TEXT_ROWS = 1_000


def text_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold no more than TEXT_ROWS rows from now on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(sizes: Iterable[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(from, to) of runs whose sizes add up to about most; a single larger one makes a run of its own."""
    first = total = at = 0
    for at, n in enumerate(sizes, 1):
        if total and total + n > most:
            yield first, at - 1
            first, total = at - 1, 0
        total += n
    if at > first:
        yield first, at


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=schema.field(n).type) for n, x in columns.items()], schema=schema)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers live on, and their pages count."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def ascii_lower(column):
    """Lower-case A-Z and nothing else, on the JVM."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
