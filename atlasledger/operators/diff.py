"""Differences between compositions and between stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def composition_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Coordinates added, modified or removed between two sides' tiles."""
    on = [*keys, "x", "y"]
    before = old.where(F.col("hash").isNotNull()).select(*on, F.col("hash").alias("old_hash"))
    after = new.where(F.col("hash").isNotNull()).select(*on, F.col("hash").alias("new_hash"))
    change = (
        F.when(F.col("old_hash").isNull(), F.lit("added"))
        .when(F.col("new_hash").isNull(), F.lit("removed"))
        .when(F.col("old_hash") != F.col("new_hash"), F.lit("modified"))
    )
    return (
        before.join(after, on, "full_outer")
        .withColumn("change", change)
        .where(F.col("change").isNotNull())
    )


def reconcile(catalogue: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """Status of each catalogued hash: missing locally, already remote, or to upload."""
    here = local.select("hash", F.lit(True).alias("_local"))
    there = remote.select("hash", F.lit(True).alias("_remote"))
    status = (
        F.when(F.col("_local").isNull(), F.lit("missing"))
        .when(F.col("_remote"), F.lit("skipped"))
        .otherwise(F.lit("upload"))
    )
    return (
        catalogue.select("hash")
        .join(here, "hash", "left")
        .join(there, "hash", "left")
        .select("hash", status.alias("status"))
    )


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
