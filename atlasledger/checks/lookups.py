"""Served questions on tables laid out for them, and stored content read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from atlasledger.checks import SQL, check
from atlasledger.checks.derive import cells, layers, products, sql, table
from atlasledger.checks.ingest import document_requests, scratch
from atlasledger.checks.served import all_layers, listed_maps
from atlasledger.operators import resolve
from atlasledger.session import checkpointed
from atlasledger.sources import served, store, tables


def landed(spark, sf) -> served.Served:
    """The catalogue's served tables in buckets."""
    name = f"served_{uuid.uuid4().hex}"
    rows = checkpointed(layers(spark, sf))  # told by layers and by maps
    counts = resolve.tile_counts(cells(spark, sf, placed=True))
    return served.Served(spark, scratch(spark, "served"), name).land(
        all_layers(spark, sf, rows), counts, listed_maps(spark, sf, rows), products(spark, sf)
    )


@check("served_map_versions", SQL["map_versions"])
def served_map_versions(spark, sf):
    return landed(spark, sf).map_versions().select(
        "map_id", "build_id", "l0", "l1", "l2", "l3", "l4",
        F.array_join("m0", " ").alias("m0"), F.array_join("products", ",").alias("products"),
    )


@check("served_map_list", SQL["map_list"])
def served_map_list(spark, sf):
    return landed(spark, sf).map_list().select(
        "map_id", "name", "parent", "first_seen", "last_seen", "layer_mask", "wdt_tile_count"
    )


@check("served_point_lookup", SQL["point_lookup"])
def served_point_lookup(spark, sf):
    requests, held = document_requests(spark, sf)
    bucketed = served.write_bucketed(
        checkpointed(held), f"contents_{uuid.uuid4().hex}", scratch(spark, "contents"), ["hash"], bloom="hash"
    )
    return store.look_up(requests, served.asked_for(requests, bucketed, "asked"), "asked", "size")


@check(
    "blob_round_trip",
    sql("""
SELECT md5(text) AS hash, octet_length(encode(any_value(text))) AS bytes, md5(any_value(text)) AS read_hash
FROM documents GROUP BY 1"""),
)
def blob_round_trip(spark, sf):
    """Every distinct text as a blob of the catalogue's table, compressed at rest and read back."""
    data = F.col("text").cast("binary")
    blobs = table(spark, sf, "documents").select(F.md5(data).alias("hash"), data.alias("data"))
    root = scratch(spark, "blobs")
    tables.write_table(blobs.groupBy("hash").agg(F.min("data").alias("data")), root, "data_blobs")
    back = tables.read_table(spark, root, "data_blobs")
    return back.select("hash", F.octet_length("data").cast("bigint").alias("bytes"), F.md5("data").alias("read_hash"))
