"""Versioned tables with a commit row written last.

A commit names, for every table of the store, the version it points to: tables it wrote are at the
commit's own number, all others stay where they were. Readers follow the newest commit, so a
half-written one is never seen. ``foreachBatch`` may run a batch again after a failure: a commit
carries its writer's name and that writer's batch number, and only the same writer's same batch is
a repeat. Anything else becomes a new commit; two writers that race for one number make the later
one fail, never disappear.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from atlasledger.session import delete_folder

COMMIT = "snapshot bigint, writer string, batch bigint, tables map<string,bigint>"
#: Commits whose tables stay readable.
KEPT = 5


class Snapshots:
    """Versioned tables under one shared folder."""

    def __init__(self, spark: SparkSession, root: str, kept: int = KEPT):
        self.spark = spark
        self.root = root
        self.kept = kept

    def commits(self) -> DataFrame | None:
        """All commits, or nothing before the first."""
        try:
            return self.spark.read.schema(COMMIT).parquet(f"{self.root}/commits/*")
        except AnalysisException:
            return None

    def last(self, n: int = 1) -> list[Row]:
        """The newest ``n`` commits, newest first."""
        commits = self.commits()
        return [] if commits is None else commits.orderBy(F.desc("snapshot")).limit(n).collect()

    def newest(self) -> int | None:
        """Number of the newest commit."""
        found = self.last()
        return found[0]["snapshot"] if found else None

    def read(self, table: str, schema: str) -> DataFrame:
        """The newest committed version of a table, empty before the first."""
        found = self.last()
        at = found[0]["tables"].get(table) if found else None
        if at is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/at={at}")

    def done(self, writer: str, batch: int) -> bool:
        """Whether this writer has committed this batch."""
        commits = self.commits()
        mine = (F.col("writer") == writer) & (F.col("batch") == batch)
        return commits is not None and not commits.where(mine).isEmpty()

    def commit(self, tables: dict[str, DataFrame], writer: str, batch: int) -> int | None:
        """Write tables and then their commit row; its number, or none for a repeat."""
        if self.done(writer, batch):
            return None
        recent = self.last(self.kept)
        held = recent[0]["tables"] if recent else {}
        snapshot = recent[0]["snapshot"] + 1 if recent else 0
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/at={snapshot}")
        now = {**held, **dict.fromkeys(tables, snapshot)}
        row = self.spark.createDataFrame([(snapshot, writer, batch, now)], COMMIT)
        # fails if another writer has taken the number meanwhile
        row.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/commits/{snapshot}")
        if len(recent) == self.kept:
            # versions that only the commit falling out of the window points to
            living = [now, *[c["tables"] for c in recent[:-1]]]
            for name, at in recent[-1]["tables"].items():
                if all(t.get(name) != at for t in living):
                    delete_folder(self.spark, f"{self.root}/{name}/at={at}")
        return snapshot


def stream_writer(batch: DataFrame, name: str) -> str:
    """A writer's name for the stream that runs ``batch``: it stays over restarts from one checkpoint
    location and is another for another, where batch numbers begin anew."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if query is None:
        raise RuntimeError("not called from a streaming query")
    return f"{name}-{query}"
