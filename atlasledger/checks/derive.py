"""Catalogue facts derived from the driver's tables, in Spark and in SQL.

Both sides state the same rule. All rows of a table take part, so the facts
grow with the tables.

* A build is a quarter of a ship year. A part is one tile: parts 256 to a map,
  16 x 16 tiles around the middle of the grid. A build lists the tiles of parts
  shipped in its year; a tile resolves unless all its shipments were returned.
* A tile's content changes every fourth build, one map after the other, so
  neighbouring builds often agree.
* A shipment fills chunk ``l_orderkey % 256`` of its part's tile; areas are
  suppliers, their parent is supplier ``id div 2``.
* An order is a product scan and, with its customer, a line of a version feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasledger.functions.versions import encode_version
from atlasledger.operators.compose import compositions
from atlasledger.session import dealt

# shipments that one task makes chunks of
SHIPMENTS_PER_PIECE = 500_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def build_text(year: Column, quarter0: Column) -> Column:
    number = 10000 + (year - 1995) * 4 + quarter0
    return F.concat_ws(
        ".",
        (year - 1990).cast("string"),
        (quarter0 + 1).cast("string"),
        F.lit("0"),
        number.cast("string"),
    )


def place(part: Column) -> dict[str, Column]:
    return {
        "map_id": F.floor(part / 256).cast("int"),
        "x": (24 + part % 16).cast("int"),
        "y": (24 + F.floor(part / 16) % 16).cast("int"),
    }


def builds(spark: SparkSession, sf: str) -> DataFrame:
    years = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("yr")).distinct()
    quarters = years.select("yr", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("q"))
    text = build_text(F.col("yr"), F.col("q"))
    return quarters.select(
        ((F.col("yr") - 1995) * 4 + F.col("q")).alias("b"),
        text.alias("version"),
        encode_version(text).alias("build_id"),
    )


def build_count(spark: SparkSession, sf: str) -> int:
    """How many builds there are: no map has more versions than that."""
    return builds(spark, sf).count()


def shipment_pieces(spark: SparkSession, sf: str) -> int:
    """How many pieces the rows made of shipments are dealt in, so that no task grows with them."""
    return table(spark, sf, "lineitem").count() // SHIPMENTS_PER_PIECE + 1  # told by the files' footers


def part_years(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by the years of their shipments.

    Few shipments share a part and a year, so they are dealt by part, for the join with parts as well.
    """
    shipped = table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("yr"),
        F.col("l_partkey").alias("part"),
        (F.col("l_returnflag") != "R").alias("kept"),
    )
    return (
        dealt(shipped, ["part"], shipment_pieces(spark, sf))
        .groupBy("yr", "part")
        .agg(F.bool_or("kept").alias("present"))
    )


def cells(spark: SparkSession, sf: str, placed: bool = False) -> DataFrame:
    """Listed cells with file ids, content keys and CDN state.

    With ``placed`` all cells of a map lie in one piece. Parts move there by year, before they become
    cells of four builds with a hash each, and what gathers compositions need not move those.
    """
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("part"), "p_brand", "p_type", "p_size"
    )
    at = place(F.col("part"))
    listed = (
        part_years(spark, sf)
        .join(parts, "part")
        .withColumn("map_id", at["map_id"])
    )
    if placed:
        listed = dealt(listed, ["map_id"], shipment_pieces(spark, sf))
    listed = (
        listed.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(3))))
        .withColumn("b", (F.col("yr") - 1995) * 4 + F.col("q"))
    )
    step = F.floor((F.col("b") + F.col("map_id")) / 4).cast("string")
    number = 10000 + F.col("b")
    build_id = (
        F.shiftleft((F.col("yr") - 1990).cast("bigint"), 52)
        .bitwiseOR(F.shiftleft((F.col("q") + 1).cast("bigint"), 42))
        .bitwiseOR(number.cast("bigint"))
    )
    return listed.select(
        "b",
        build_id.alias("build_id"),
        "map_id",
        at["x"].alias("x"),
        at["y"].alias("y"),
        "part",
        (F.col("part") * 2 + 1).alias("minimap_texture"),
        F.when(F.col("p_size") > 25, F.col("part") * 2 + 2).otherwise(F.lit(0)).alias("map_texture"),
        F.when(F.col("p_type") != "ECONOMY", F.col("part") + 1)
        .otherwise(F.lit(0))
        .alias("root_adt"),
        "present",
        F.md5(F.concat("p_brand", F.lit("-"), step).cast("binary")).alias("ckey"),
        F.md5(F.concat("p_type", F.lit("-"), F.col("yr").cast("string")).cast("binary")).alias(
            "texture_ckey"
        ),
        (F.col("p_brand") == "Brand#13").alias("cdn_missing"),
    )


def tiles(spark: SparkSession, sf: str, placed: bool = False) -> DataFrame:
    """Minimap tiles of every build and map; a null hash is build-missing."""
    c = cells(spark, sf, placed)
    return c.select(
        "b",
        "build_id",
        "map_id",
        "x",
        "y",
        F.when(F.col("present"), F.col("ckey")).alias("hash"),
        (F.col("present") & F.col("cdn_missing")).alias("cdn_missing"),
    )


def file_index(spark: SparkSession, sf: str) -> DataFrame:
    held = cells(spark, sf).where("present")
    return held.select(
        "build_id",
        F.expr(
            "stack(2, minimap_texture, ckey, part * 2 + 2, texture_ckey) AS (fdid, ckey)"
        ),
    )


def tile_sizes(spark: SparkSession, sf: str) -> DataFrame:
    hashes = tiles(spark, sf).where(F.col("hash").isNotNull()).select("hash").distinct()
    size = F.when(F.substring("hash", 1, 1) < "6", 256).otherwise(512)
    return hashes.withColumn("tile_size", size)


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """One row per filled chunk: area id and impassable flag.

    Few shipments share a chunk, so they are dealt by how many there are: no task grows with them.
    """
    at = place(F.col("part"))
    shipped = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("part"), (F.col("l_orderkey") % 256).alias("idx"), "l_suppkey", "l_linenumber"
    )
    return (
        dealt(shipped, ["part", "idx"], shipment_pieces(spark, sf))
        .groupBy("part", "idx")
        .agg(
            F.min("l_suppkey").alias("area_id"), F.bool_or(F.col("l_linenumber") == 1).alias("impass")
        )
        .select(*[c.alias(n) for n, c in at.items()], "part", "idx", "area_id", "impass")
    )


def areas(spark: SparkSession, sf: str) -> DataFrame:
    """Area table; area 0 stands for no area and has no row."""
    return (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .where(F.col("s_suppkey") > 0)
        .select(
            F.col("s_suppkey").alias("area_id"),
            F.floor(F.col("s_suppkey") / 2).alias("parent_id"),
            F.col("n_name").alias("name"),
            F.col("s_name").alias("internal_name"),
            F.col("n_regionkey").alias("continent_id"),
        )
    )


def name_facts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("map_id"),
        F.col("event_id").alias("build_id"),
        F.col("event_type").alias("name"),
    )


def feed_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Feed rows of products by region, one per order."""
    year, quarter0 = F.year("o_orderdate"), F.quarter("o_orderdate") - 1
    rows = (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("version", build_text(year, quarter0))
        .withColumn("product", F.lower("c_mktsegment"))
    )

    def key(prefix: str, column: str) -> Column:
        return F.md5(F.concat(F.lit(prefix), F.col(column)).cast("binary"))

    return rows.select(
        F.col("o_orderkey").alias("order_no"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("seen"),
        "product",
        F.col("r_name").alias("region"),
        key("build-", "version").alias("build_config"),
        key("cdn-", "o_orderpriority").alias("cdn_config"),
        "version",
        key("product-", "product").alias("product_config"),
    )


def products(spark: SparkSession, sf: str) -> DataFrame:
    """One product per order, so products repeat per build as they once did."""
    f = feed_versions(spark, sf)
    return f.select(
        F.col("order_no").alias("product_id"),
        encode_version(F.col("version")).alias("build_id"),
        "product",
        F.col("build_config").alias("config_build"),
        F.col("cdn_config").alias("config_cdn"),
        F.col("product_config").alias("config_product"),
        F.array("region").alias("config_regions"),
        F.col("seen").alias("first_seen"),
    )


def scans(spark: SparkSession, sf: str) -> DataFrame:
    status, urgent = F.col("o_orderstatus"), F.col("o_orderpriority") == "1-URGENT"
    state = (
        F.when(status == "P", F.lit("pending"))
        .when((status == "F") & urgent, F.lit("encrypted_build"))
        .when(status == "F", F.lit("full_decrypt"))
        .when(urgent, F.lit("exception"))
        .otherwise(F.lit("partial_decrypt"))
    )
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("product_id"),
        state.alias("state"),
        F.when(F.col("o_orderpriority") == "5-LOW", 2).otherwise(1).alias("data_version_attempt"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_scanned"),
    )


def layer_tiles(spark: SparkSession, sf: str, placed: bool = False) -> DataFrame:
    """Tiles of the minimap (0) and map texture (1) layers."""
    c = cells(spark, sf, placed)
    held = F.col("present")
    content = F.expr(
        "stack(2, 0, minimap_texture, ckey, present AND cdn_missing,"
        " 1, map_texture, texture_ckey, false) AS (layer_type, fdid, hash, cdn_missing)"
    )
    return (
        c.select("b", "build_id", "map_id", "x", "y", "present", content)
        .where(F.col("fdid") != 0)
        .withColumn("hash", F.when(held, F.col("hash")))
        .drop("present")
    )


LAYER_KEYS = ["b", "build_id", "map_id", "layer_type"]


def layers(spark: SparkSession, sf: str) -> DataFrame:
    """Composition layer rows; layers without a resolved tile are dropped."""
    return (
        compositions(layer_tiles(spark, sf, placed=True), LAYER_KEYS, cdn=True, placed=True)
        .where(F.col("tiles") > 0)
        .select(*LAYER_KEYS, "composition_hash", "cdn_missing")
    )


# The same rules as SQL; every statement starts with these.
COMMON = """
WITH RECURSIVE builds AS (
  SELECT (yr - 1995) * 4 + q AS b,
         (yr - 1990) || '.' || (q + 1) || '.0.' || (10000 + (yr - 1995) * 4 + q) AS version,
         ((yr - 1990)::BIGINT << 52) | ((q + 1)::BIGINT << 42)
           | (10000 + (yr - 1995) * 4 + q)::BIGINT AS build_id
  FROM (SELECT DISTINCT year(l_shipdate) AS yr FROM lineitem), range(4) t(q)
),
part_years AS (
  SELECT year(l_shipdate) AS yr, l_partkey AS part, bool_or(l_returnflag <> 'R') AS present
  FROM lineitem GROUP BY 1, 2
),
cells AS (
  SELECT (yr - 1995) * 4 + q AS b,
         ((yr - 1990)::BIGINT << 52) | ((q + 1)::BIGINT << 42)
           | (10000 + (yr - 1995) * 4 + q)::BIGINT AS build_id,
         part // 256 AS map_id, 24 + part % 16 AS x, 24 + (part // 16) % 16 AS y, part,
         part * 2 + 1 AS minimap_texture,
         CASE WHEN p_size > 25 THEN part * 2 + 2 ELSE 0 END AS map_texture,
         CASE WHEN p_type <> 'ECONOMY' THEN part + 1 ELSE 0 END AS root_adt,
         present,
         md5(p_brand || '-' || (((yr - 1995) * 4 + q + part // 256) // 4)) AS ckey,
         md5(p_type || '-' || yr) AS texture_ckey,
         p_brand = 'Brand#13' AS cdn_missing
  FROM part_years JOIN part ON p_partkey = part, range(4) t(q)
),
tiles AS (
  SELECT b, build_id, map_id, x, y, CASE WHEN present THEN ckey END AS hash,
         present AND cdn_missing AS cdn_missing
  FROM cells
),
file_index AS (
  SELECT build_id, minimap_texture AS fdid, ckey FROM cells WHERE present
  UNION ALL
  SELECT build_id, part * 2 + 2, texture_ckey FROM cells WHERE present
),
tile_sizes AS (
  SELECT hash, CASE WHEN hash[1] < '6' THEN 256 ELSE 512 END AS tile_size
  FROM (SELECT DISTINCT hash FROM tiles WHERE hash IS NOT NULL)
),
chunks AS (
  SELECT part // 256 AS map_id, 24 + part % 16 AS x, 24 + (part // 16) % 16 AS y, part, idx,
         area_id, impass
  FROM (SELECT l_partkey AS part, l_orderkey % 256 AS idx, min(l_suppkey) AS area_id,
               bool_or(l_linenumber = 1) AS impass
        FROM lineitem GROUP BY 1, 2)
),
areas AS (
  SELECT s_suppkey AS area_id, s_suppkey // 2 AS parent_id, n_name AS name,
         s_name AS internal_name, n_regionkey AS continent_id
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey > 0
),
name_facts AS (
  SELECT user_id AS map_id, event_id AS build_id, event_type AS name FROM events
),
feed_versions AS (
  SELECT o_orderkey AS order_no, strftime(o_orderdate, '%Y-%m-%d') AS seen, product,
         r_name AS region, md5('build-' || version) AS build_config,
         md5('cdn-' || o_orderpriority) AS cdn_config, version, build_id,
         md5('product-' || product) AS product_config
  FROM (SELECT *, lower(c_mktsegment) AS product,
               (year(o_orderdate) - 1990) || '.' || quarter(o_orderdate) || '.0.'
                 || (10000 + (year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1) AS version,
               ((year(o_orderdate) - 1990)::BIGINT << 52) | (quarter(o_orderdate)::BIGINT << 42)
                 | (10000 + (year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1)::BIGINT
                 AS build_id
        FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
),
products AS (
  SELECT order_no AS product_id, build_id, product, build_config AS config_build,
         cdn_config AS config_cdn, product_config AS config_product,
         [region] AS config_regions, region, seen AS first_seen
  FROM feed_versions
),
scans AS (
  SELECT o_orderkey AS product_id,
         CASE WHEN o_orderstatus = 'P' THEN 'pending'
              WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'encrypted_build'
              WHEN o_orderstatus = 'F' THEN 'full_decrypt'
              WHEN o_orderpriority = '1-URGENT' THEN 'exception'
              ELSE 'partial_decrypt' END AS state,
         CASE WHEN o_orderpriority = '5-LOW' THEN 2 ELSE 1 END AS data_version_attempt,
         strftime(o_orderdate, '%Y-%m-%d') AS last_scanned
  FROM orders
),
layer_tiles AS (
  SELECT b, build_id, map_id, 0 AS layer_type, x, y, minimap_texture AS fdid,
         CASE WHEN present THEN ckey END AS hash, present AND cdn_missing AS cdn_missing
  FROM cells
  UNION ALL
  SELECT b, build_id, map_id, 1, x, y, map_texture, CASE WHEN present THEN texture_ckey END, false
  FROM cells WHERE map_texture <> 0
),
compositions AS (
  SELECT b, build_id, map_id, layer_type,
         md5(unhex(
           coalesce(string_agg(printf('%02x000000%02x000000', x, y) || hash, '' ORDER BY x, y)
                    FILTER (hash IS NOT NULL), '')
           || coalesce(string_agg(printf('%02x000000%02x000000', x, y), '' ORDER BY x, y)
                    FILTER (hash IS NULL), ''))) AS composition_hash,
         count(hash) AS tiles, count(*) - count(hash) AS missing,
         min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1,
         nullif(list_sort(list(DISTINCT hash) FILTER (cdn_missing)), []) AS cdn_missing
  FROM layer_tiles GROUP BY 1, 2, 3, 4
),
layers AS (
  SELECT b, build_id, map_id, layer_type, composition_hash, cdn_missing
  FROM compositions WHERE tiles > 0
)
"""


def sql(body: str) -> str:
    """A statement over the common facts; ``body`` may add CTEs of its own.

    A body that starts with a comma continues the list of CTEs.
    """
    return COMMON + body
