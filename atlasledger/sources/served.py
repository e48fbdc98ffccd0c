"""Tables laid out for the questions that are asked of them.

They are hashed into buckets on the keys by which they are looked up, grouped and joined, and sorted
by them within a bucket: grouping and joining move no row of theirs, and a look-up of some keys opens
the buckets of these alone. Hash columns have Bloom filters too, so that an absent key is known
without a page being read. All of it is Spark's own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasledger.functions.hashes import try_hash
from atlasledger.plans import serve
from atlasledger.session import Scratch

ROWS_PER_BUCKET = 2_000_000
#: The tables that served questions read, and the keys of their buckets.
KEYS = {
    "layers": ["map_id", "build_id"],
    "build_maps": ["map_id", "build_id"],
    "maps": ["map_id", "last_seen"],
}


def buckets_for(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """A power of two that follows the number of rows."""
    return 2 ** max(0, math.ceil(math.log2(max(1, rows) / rows_per_bucket)))


def write_bucketed(
    df: DataFrame, name: str, path: str, keys: list[str], buckets: int | None = None, bloom: str | None = None
) -> DataFrame:
    """Write ``df`` as the table ``name`` at ``path``, one sorted file per bucket.

    Without ``buckets`` the rows are counted, so hand over a landed table. ``bloom`` names a column
    of nearly distinct values to look for.
    """
    rows = None if buckets else df.count()
    buckets = buckets or buckets_for(rows)
    writer = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").option("path", path)
    if bloom:
        each = math.ceil(1.1 * rows / buckets) if rows else ROWS_PER_BUCKET
        writer = writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{bloom}", str(each))
    writer.option("compression", "zstd").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, name: str, path: str, schema: str, keys: list[str], buckets: int) -> DataFrame:
    """A bucketed table that another session wrote, under a name of this one."""
    columns = ", ".join(keys)
    place = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet "
        f"CLUSTERED BY ({columns}) SORTED BY ({columns}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return spark.table(name)


def find(table: DataFrame, key: str, wanted: Sequence) -> DataFrame:
    """The rows of some keys, as many as one page asks for.

    Each key is a comparison of its own, which a row group's Bloom filter answers; a longer ``IN`` is
    widened to the range between its least and greatest value.
    """
    some = sorted({w for w in wanted if w is not None})
    return table.where(reduce(lambda a, b: a | b, [F.col(key) == F.lit(w) for w in some], F.lit(False)))


def asked_for(requests: DataFrame, table: DataFrame, requested: str) -> DataFrame:
    """Of a table in buckets by ``hash`` the rows that some request names.

    The distinct hashes asked for go to the buckets; the table's rows stay where they are. A hash that
    a third of the requests name is one row here.
    """
    wanted = requests.select(try_hash(F.col(requested)).alias("hash")).where("hash is not null").distinct()
    return table.join(wanted, "hash", "left_semi")


class Served:
    """Layers, maps and products of a catalogue as its readers want them.

    ``land`` is run after a tick. Products are one short row per build: Spark broadcasts them if their
    file is small, and otherwise moves the versions once.
    """

    def __init__(self, spark: SparkSession, root: str, prefix: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
        """``prefix`` begins the names of the tables in the session's catalogue."""
        self.spark, self.root, self.prefix, self.rows_per_bucket = spark, root, prefix, rows_per_bucket

    def land(self, layers: DataFrame, build_maps: DataFrame, maps: DataFrame, products: DataFrame) -> "Served":
        given = {"layers": layers, "build_maps": build_maps, "maps": maps}
        with Scratch(self.spark) as scratch:
            for name, df in given.items():
                df = scratch.save(df)
                buckets = buckets_for(df.count(), self.rows_per_bucket)
                write_bucketed(df, f"{self.prefix}_{name}", f"{self.root}/{name}", KEYS[name], buckets)
        serve.products_per_build(products).write.mode("overwrite").parquet(f"{self.root}/products")
        return self

    def read(self, name: str) -> DataFrame:
        if name == "products":
            return self.spark.read.schema("build_id bigint, products array<string>").parquet(f"{self.root}/products")
        return self.spark.table(f"{self.prefix}_{name}")

    def map_versions(self) -> DataFrame:
        """``serve.map_versions``; no layer moves before its build's products are looked up."""
        return serve.with_products(serve.layer_pivot(self.read("layers")), self.read("products"))

    def map_list(self) -> DataFrame:
        """``serve.map_list``; maps go to the buckets of their builds."""
        return serve.map_list(self.read("maps"), self.read("build_maps"))
