"""What a discovery tick makes of the version feeds, and old product tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasledger.functions.labels import matches_any
from atlasledger.functions.versions import encode_version


def wanted_products(summary: DataFrame, include: list[str]) -> DataFrame:
    """Feed products to follow: included by wildcard and not a CDN entry."""
    return summary.where((F.col("flags") != "cdn") & matches_any(F.col("name"), include))


def queried_products(wanted: DataFrame) -> DataFrame:
    """Of those, the ones whose version page is asked for."""
    return wanted.where(F.col("flags") == "")


def without(rows: DataFrame, column: str, excluded: list[str]) -> DataFrame:
    return rows.where(~F.col(column).isin(*excluded)) if excluded else rows


def only(rows: DataFrame, column: str, allowed: list[int]) -> DataFrame:
    """Keep the allowed ids; an empty list allows all."""
    return rows.where(F.col(column).isin(*allowed)) if allowed else rows


def sequence_mismatches(summary: DataFrame, pages: DataFrame) -> DataFrame:
    """Products whose version page has another sequence than the summary."""
    page = pages.select(F.col("product").alias("name"), F.col("seqn").alias("page_seqn")).distinct()
    return summary.join(page, "name").where(F.col("product_seqn") != F.col("page_seqn"))


def product_sightings(versions: DataFrame) -> DataFrame:
    """Feed rows by (build, product): their distinct regions.

    Regions are a fixed short list, so the sets are small.
    """
    return (
        versions.withColumn("build_id", encode_version(F.col("version")))
        .groupBy("build_id", "product")
        .agg(F.sort_array(F.collect_set("region")).alias("config_regions"))
    )


def source_sightings(versions: DataFrame) -> DataFrame:
    """Feed rows by (build, product, config triple): their distinct regions."""
    return (
        versions.withColumn("build_id", encode_version(F.col("version")))
        .groupBy("build_id", "product", "build_config", "cdn_config", "product_config")
        .agg(F.sort_array(F.collect_set("region")).alias("config_regions"))
    )


def version_count(versions: DataFrame) -> DataFrame:
    """Rows and exact distinct versions over all products."""
    return versions.agg(
        F.count(F.lit(1)).alias("feed_rows"), F.count_distinct("version").alias("versions")
    )


def endpoints(cdns: DataFrame, mirrors: list[str]) -> DataFrame:
    """Download endpoints: every listed host, then mirrors for stems they lack.

    Hosts are blank-separated. One row per (host, path); the earliest line
    gives the config path. ``mirrors`` is a configured short list.
    """
    listed = cdns.select(
        "line_no", F.explode(F.split("hosts", " +")).alias("host"), "path", "config_path"
    ).where(F.col("host") != "")
    first = listed.groupBy("host", "path").agg(
        F.min_by("config_path", "line_no").alias("config_path")
    )
    stems = cdns.groupBy("path").agg(F.min_by("config_path", "line_no").alias("config_path"))
    offered = stems.select(
        F.explode(F.array(*[F.lit(m) for m in mirrors])).alias("host"), "path", "config_path"
    )
    added = offered.join(first.select("host", "path"), ["host", "path"], "left_anti")
    return first.withColumn("origin", F.lit("listed")).unionByName(
        added.withColumn("origin", F.lit("mirror"))
    )


def single_region(rows: DataFrame, keys: list[str], region: str) -> DataFrame:
    """Rows of one region; a key with none or several is an error row.

    Returns ``keys, matches, ok``.
    """
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("region") == region).alias("matches"),
        (F.count_if(F.col("region") == region) == 1).alias("ok"),
    )


# --- one-off moves of older product tables --------------------------------

TWIN = ["build_id", "product", "config_build", "config_product"]


def kept_products(products: DataFrame) -> DataFrame:
    """The newest duplicate of each product and config pair."""
    return products.groupBy(*TWIN).agg(F.max("product_id").alias("product_id"))


def droppable_scans(products: DataFrame, scans: DataFrame) -> DataFrame:
    """Scans of dropped duplicates whose kept twin has the same state."""
    kept = kept_products(products)
    kept_state = kept.join(scans, "product_id").select(*TWIN, "state").distinct()
    dropped = products.join(kept.select("product_id"), "product_id", "left_anti")
    return (
        dropped.join(scans, "product_id")
        .join(kept_state, [*TWIN, "state"], "left_semi")
        .select("product_id", "state")
    )


def rebuilt_sources(products: DataFrame) -> DataFrame:
    """Sources of kept products, with the first sighting over all duplicates.

    Duplicates differ in CDN config, region lists and sighting time. They are reduced to their
    earliest sighting per config before they meet what is kept.
    """
    kept = products.groupBy(*TWIN, "config_regions").agg(F.max("product_id").alias("kept_id"))
    configs = list(dict.fromkeys([*TWIN, "config_build", "config_cdn", "config_product"]))
    return (
        products.groupBy(*configs)
        .agg(F.min("first_seen").alias("first_seen"))
        .join(kept, TWIN)
        .groupBy("kept_id", "config_build", "config_cdn", "config_product", "config_regions")
        .agg(F.min("first_seen").alias("first_seen"))
    )


def consolidated_regions(products: DataFrame) -> DataFrame:
    """Sorted distinct regions over all duplicates, on the kept product."""
    kept = kept_products(products)
    regions = (
        products.select(*TWIN, F.explode("config_regions").alias("_r"))
        .groupBy(*TWIN)
        .agg(F.sort_array(F.collect_set("_r")).alias("config_regions"))
    )
    return kept.join(regions, TWIN)


def repeated_regions(products: DataFrame) -> DataFrame:
    """Rows that break the rule that a region list is a set."""
    return products.where(
        F.size("config_regions") != F.size(F.array_distinct("config_regions"))
    )


def mismatched_builds(builds: DataFrame) -> DataFrame:
    """Rows whose id is not the number of their version."""
    return builds.where(encode_version(F.col("version")) != F.col("build_id"))
