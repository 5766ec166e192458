"""Keeping an index fresh from a stream of change records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.plans import index

CHANGES = "path string, at timestamp"
DEBOUNCE = "750 milliseconds"


def watch(spark: SparkSession, changes: DataFrame, root: str, db: str, checkpoint: str, every: str = DEBOUNCE) -> StreamingQuery:
    """Each micro-batch of changes (CHANGES) brings the index up to date once, however many records it has. The trigger
    interval stands for the debounce: records that come together are one refresh."""

    def refresh(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            index.build(spark, root, db)

    return changes.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def bursts(changes: DataFrame, gap: str = DEBOUNCE, late: str = "10 seconds") -> DataFrame:
    """(folder, begin, end, changes) of bursts of changes in a folder, each ended by a gap: the debounce in event time.
    Folders are keys of their own, so that state is spread over tasks."""
    marked = changes.withWatermark("at", late).groupBy(F.session_window("at", gap), F.regexp_extract("path", r"^(.*)/", 1).alias("folder")).agg(F.count(F.lit(1)).alias("changes"))
    return marked.select("folder", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "changes")


class Watches:
    """Running watches by repository: one for each, ended one by one or all."""

    def __init__(self):
        self.running: dict[str, StreamingQuery] = {}

    def start(self, spark: SparkSession, changes: DataFrame, root: str, db: str, checkpoint: str, every: str = DEBOUNCE) -> bool:
        """False where the repository is watched already."""
        if (old := self.running.get(root)) is not None and old.isActive:
            return False
        self.running[root] = watch(spark, changes, root, db, checkpoint, every)
        return True

    def list(self) -> list[dict]:
        return [{"repo": root, "active": q.isActive, "id": str(q.id), "problem": str(q.exception()) if q.exception() else None} for root, q in sorted(self.running.items())]

    def stop(self, root: str | None = None) -> list[dict]:
        """Ends the watch of a repository, or all: {repo, outcome}."""
        out = []
        for name in [root] if root is not None else sorted(self.running):
            q = self.running.pop(name, None)
            out.append({"repo": name, "outcome": "stopped" if q is not None and q.isActive else "not running"})
            if q is not None:
                q.stop()
        return out
