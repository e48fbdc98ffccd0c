"""Discovery ticks over landed version feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from atlasledger.functions.versions import encode_version
from atlasledger.operators import discovery, merge
from atlasledger.sources import feeds
from atlasledger.streaming.catalogue import Catalogue
from atlasledger.streaming.snapshots import stream_writer

PRODUCT_KEY = ["build_id", "product"]
SOURCE_KEY = [*PRODUCT_KEY, "config_build", "config_cdn", "config_product"]


def landed_pages(spark: SparkSession, path: str, files_per_tick: int | None = None) -> DataFrame:
    """Stream of landed version pages filed as ``product=…/page``."""
    reader = spark.readStream.format("text").option("wholetext", "true")
    if files_per_tick:
        reader = reader.option("maxFilesPerTrigger", files_per_tick)
    return reader.load(path).withColumnRenamed("value", "document")


def page_versions(pages: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Feed rows of the followed products."""
    from atlasledger.functions.labels import matches_any

    wanted = discovery.without(
        pages.where(matches_any(F.col("product"), include)), "product", exclude
    )
    return feeds.parse_feed(wanted, "versions")


def product_id(build_id: Column, product: Column) -> Column:
    """A product's number, the same in whatever order products are found."""
    return F.xxhash64(build_id, product)


def followed(rows: DataFrame, summary: DataFrame, include: list[str]) -> tuple[DataFrame, DataFrame]:
    """Feed rows of products that the summary lists to be asked for, and the products whose version
    page (``product, seqn``) has another sequence than the summary says."""
    asked = discovery.queried_products(discovery.wanted_products(summary, include))
    kept = rows.join(asked.select(F.col("name").alias("product")).distinct(), "product", "left_semi")
    return kept, discovery.sequence_mismatches(asked, rows.select("product", "seqn"))


def tick(store: Catalogue, rows: DataFrame, writer: str, batch: int, seen: str) -> None:
    """Merge one tick's feed rows into the catalogue and commit the result.

    Only the builds that the rows name are read and written.
    """
    since = store.begin()
    listed = rows.select(encode_version(F.col("version")).alias("build_id"), "version")
    touched = [r["build_id"] for r in listed.select("build_id").distinct().collect()]  # some builds
    products = store.read("products", touched)
    sources = store.read("product_sources", touched)
    scans = store.read("product_scans", touched)
    number = product_id(F.col("build_id"), F.col("product"))

    new_builds = merge.new_rows(store.read("builds"), listed, ["build_id"])
    # read by the products table and by the queue below
    merged = merge.merge_products(products, discovery.product_sightings(rows)).withColumn("product_id", number)
    first = products.select("product_id", F.col("first_seen").alias("_first")).distinct()
    merged = merged.join(first, "product_id", "left").withColumn("first_seen", F.coalesce("_first", F.lit(seen))).persist()
    sightings = discovery.source_sightings(rows).select(
        *PRODUCT_KEY,
        F.col("build_config").alias("config_build"),
        F.col("cdn_config").alias("config_cdn"),
        F.col("product_config").alias("config_product"),
        "config_regions",
        F.lit(seen).alias("first_seen"),
    )
    queued = merge.queue_scans(scans, merged.where("processed"), ["build_id", "product_id"])
    store.commit(
        {
            "builds": new_builds,
            "products": merged,
            "product_sources": merge.merge_sources(sources, sightings, PRODUCT_KEY),
            "product_scans": scans.unionByName(queued, allowMissingColumns=True),
        },
        writer,
        batch,
        since,
    )
    merged.unpersist()


def discovery_stream(
    pages: DataFrame,
    store: Catalogue,
    include: list[str],
    exclude: list[str],
    seen: str | None = None,
    summary: DataFrame | None = None,
) -> DataStreamWriter:
    """Stream writer that runs one tick per micro-batch; set trigger and start it.

    With a ``summary`` (``name, product_seqn, flags``) only products that it lists to be asked for
    are followed.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = page_versions(batch, include, exclude)
        rows = (rows if summary is None else followed(rows, summary, include)[0]).persist()
        writer = stream_writer(batch, "discovery")
        tick(store, rows, writer, batch_id, seen or f"batch-{batch_id}")
        rows.unpersist()

    return pages.writeStream.foreachBatch(run)


def first_seen_events(rows: DataFrame) -> DataFrame:
    """Announce every build, product, region and queued scan once.

    Works on batches and streams; on a stream the seen keys are kept in the
    state store, one per catalogue entry.
    """
    build = F.col("version")
    product = F.concat_ws(" ", "product", "version")
    kinds = {
        "build": build,
        "product": product,
        "region": F.concat_ws(" ", product, F.col("region")),
        "scan": product,
    }
    events = F.explode(
        F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("subject")) for k, c in kinds.items()])
    )
    return rows.select(events.alias("_e")).select("_e.*").dropDuplicates(["kind", "subject"])
