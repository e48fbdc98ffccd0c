"""Streaming form of the size-capped event log.

A micro-batch is packed like any log: a key with very many messages is cut into pieces that are worked
on side by side, starting from the batch that the key had open. What a key has open is kept in a
partitioned table, of which a tick replaces the buckets of the keys it met.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from atlasledger.operators.packing import MESSAGE_CAP, open_batches, pack_onto
from atlasledger.session import Scratch
from atlasledger.streaming.catalogue import Catalogue, Table
from atlasledger.streaming.snapshots import stream_writer

BUCKETS = 64


def pack_stream(
    log: DataFrame, key: str, order: str, text: str, root: str, cap: int = MESSAGE_CAP, buckets: int = BUCKETS
) -> DataStreamWriter:
    """Batch number of each message as it arrives, to be read with ``packed_log``.

    Messages of one micro-batch are taken in ``order``, after all those of earlier ones. A null
    message has no characters, a null key is a key.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        pack_tick(batch, batch_id, key, order, text, root, cap, buckets)

    return log.writeStream.foreachBatch(run)


def pack_tick(
    batch: DataFrame, batch_id: int, key: str, order: str, text: str, root: str, cap: int = MESSAGE_CAP, buckets: int = BUCKETS
) -> None:
    """Pack one micro-batch below ``root``.

    Its rows are written to a folder that it names, then what its keys have open is committed: a tick
    that is run again writes the same rows until its commit, and none after it. ``buckets`` must stay
    the same for a folder.
    """
    spark = batch.sparkSession
    opened = Table(f"bucket int, {key} {dict(batch.dtypes)[key]}, batch_no bigint, fill int", ["bucket"])
    store, writer = Catalogue(spark, root, {"open_batches": opened}), stream_writer(batch, "pack")
    since = store.begin()
    if store.done(writer, batch_id):
        return
    mine = batch.select(key, order, text).persist()
    with Scratch(spark) as scratch:
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        met = [r["bucket"] for r in mine.select(bucket.alias("bucket")).distinct().collect()]  # as many as buckets
        held = store.read("open_batches").where(F.col("bucket").isin(met))
        place = f"{root}/packed/writer={writer}/tick={batch_id}"
        packed = pack_onto(mine, [key], [order], text, held, cap, scratch.save)
        packed.write.mode("overwrite").parquet(place)
        packed = spark.read.schema(packed.schema).parquet(place)
        # numbers and fills only grow, so what a key has open now is the larger of both rows
        both = packed.select(key, "batch_no", "fill").unionByName(held.drop("bucket"))
        store.commit({"open_batches": open_batches(both, [key]).withColumn("bucket", bucket)}, writer, batch_id, since)
    mine.unpersist()


def packed_log(spark: SparkSession, root: str, key: str, order: str, types: dict[str, str]) -> DataFrame:
    """``key, order, length, batch_no`` of all messages packed below ``root``; none before the first tick."""
    schema = f"{key} {types[key]}, {order} {types[order]}, length int, batch_no bigint"
    try:
        return spark.read.schema(schema).parquet(f"{root}/packed/*/*")
    except AnalysisException:  # nothing has arrived yet
        return spark.createDataFrame([], schema)
