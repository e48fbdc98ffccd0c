"""Content stores: files or rows addressed by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasledger.functions.hashes import is_hash

# Media types a store accepts and the file ending of each.
ENDINGS = {
    "image/webp": ".webp",
    "image/png": ".png",
    "image/jpeg": ".jpg",
    "image/avif": ".avif",
}


def scan_store(spark: SparkSession, root: str) -> DataFrame:
    """Hash, path, size and time of every stored object, without its content."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length", "modificationTime")
    )
    name = F.element_at(F.split("path", "/"), -1)
    found = F.regexp_extract(name, "^([0-9a-f]{32})", 1)
    return files.withColumn("hash", found).where(F.col("hash") != "")


def newest_per_hash(saves: DataFrame, order: str) -> DataFrame:
    """The last save of each hash; a store keeps one format per hash."""
    others = [c for c in saves.columns if c != "hash"]
    newest = F.max_by(F.struct(*others), order).alias("_s")
    return saves.groupBy("hash").agg(newest).select("hash", *[F.col(f"_s.{c}") for c in others])


def write_store(saves: DataFrame, root: str, order: str = "saved_at") -> None:
    """Save contents filed by the first two hex digits of their hash."""
    endings = F.create_map(*[F.lit(v) for pair in ENDINGS.items() for v in pair])
    ending = F.coalesce(
        F.try_element_at(endings, F.col("media_type")),
        F.raise_error(F.concat(F.lit("unsupported media type: "), F.col("media_type"))),
    )
    (
        newest_per_hash(saves.withColumn("ending", ending), order)
        .withColumn("prefix", F.substring("hash", 1, 2))
        .write.mode("overwrite")
        .option("compression", "zstd")
        .partitionBy("prefix")
        .parquet(root)
    )


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """Rows of a written store; a filter on ``prefix`` prunes folders."""
    return spark.read.parquet(root).withColumn("prefix", F.col("prefix").cast("string"))


def look_up(requests: DataFrame, store: DataFrame, requested: str, value: str) -> DataFrame:
    """Batch point look-up: each request with a status and, if found, the value."""
    asked = requests.withColumn("_h", F.when(is_hash(F.col(requested)), F.lower(requested)))
    held = store.select(F.col("hash").alias("_h"), F.col(value), F.lit(True).alias("_found"))
    status = (
        F.when(F.col("_h").isNull(), F.lit("bad_request"))
        .when(F.col("_found"), F.lit("ok"))
        .otherwise(F.lit("not_found"))
    )
    return asked.join(held, "_h", "left").withColumn("status", status).drop("_h", "_found")
