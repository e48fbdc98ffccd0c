"""Scalar functions over columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasledger.checks import check
from atlasledger.checks.derive import builds, chunks, feed_versions, sql, table, tiles
from atlasledger.functions import coords, hashes, labels, versions
from atlasledger.operators import areas as area_ops


@check(
    "version_encode",
    sql("SELECT DISTINCT version, build_id FROM feed_versions"),
)
def version_encode(spark, sf):
    rows = feed_versions(spark, sf).select("version").distinct()
    return rows.withColumn("build_id", versions.encode_version(F.col("version")))


@check(
    "version_encode_sql",
    sql("SELECT DISTINCT version, build_id, version AS again FROM feed_versions"),
)
def version_encode_sql(spark, sf):
    versions.register_sql(spark)
    rows = feed_versions(spark, sf).select("version").distinct()
    code = F.expr("encode_build_version(version)")
    return rows.withColumn("build_id", code).withColumn(
        "again", F.expr("decode_build_version(encode_build_version(version))")
    )


@check(
    "version_decode",
    sql("""
SELECT build_id, version, build_id >> 52 AS expansion, (build_id >> 42) & 1023 AS major,
       (build_id >> 32) & 1023 AS minor, build_id & 4294967295 AS build FROM builds"""),
)
def version_decode(spark, sf):
    code = F.col("build_id")
    parts = [versions.version_part(code, p).alias(p) for p in versions.PARTS]
    return builds(spark, sf).select("build_id", versions.decode_version(code).alias("version"), *parts)


@check(
    "version_try_parse",
    sql("""
, texts AS (
  SELECT o_orderkey, (o_orderkey % 3000) || '.' || (o_custkey % 1100) || '.' || o_orderkey
         || CASE WHEN o_orderstatus = 'P' THEN '.x' WHEN o_orderstatus = 'F' THEN '.5' ELSE '' END AS t
  FROM orders
)
SELECT o_orderkey, t AS version,
       CASE WHEN regexp_full_match(t, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+')
             AND split_part(t, '.', 1)::BIGINT <= 2047 AND split_part(t, '.', 2)::BIGINT <= 1023
             AND split_part(t, '.', 3)::BIGINT <= 1023
            THEN (split_part(t, '.', 1)::BIGINT << 52) | (split_part(t, '.', 2)::BIGINT << 42)
                 | (split_part(t, '.', 3)::BIGINT << 32) | split_part(t, '.', 4)::BIGINT END AS build_id
FROM texts"""),
)
def version_try_parse(spark, sf):
    tail = (
        F.when(F.col("o_orderstatus") == "P", ".x").when(F.col("o_orderstatus") == "F", ".5")
        .otherwise("")
    )
    text = F.concat(
        F.col("o_orderkey") % 3000, F.lit("."), F.col("o_custkey") % 1100, F.lit("."), "o_orderkey", tail
    )
    return table(spark, sf, "orders").select("o_orderkey", text.alias("version")).withColumn(
        "build_id", versions.try_encode_version(F.col("version"))
    )


@check(
    "hash_parse",
    sql("""
, texts AS (
  SELECT doc_id, CASE WHEN lang = 'en' THEN upper(md5(text)) WHEN lang = 'de' THEN md5(text)
                      ELSE md5(text) || 'g' END AS t FROM documents
)
SELECT doc_id, t AS given, CASE WHEN regexp_full_match(t, '[0-9a-fA-F]{32}') THEN lower(t) END AS hash
FROM texts"""),
)
def hash_parse(spark, sf):
    md5 = hashes.content_hash(F.col("text"))
    given = (
        F.when(F.col("lang") == "en", F.upper(md5)).when(F.col("lang") == "de", md5)
        .otherwise(F.concat(md5, F.lit("g")))
    )
    return table(spark, sf, "documents").select("doc_id", given.alias("given")).withColumn(
        "hash", hashes.try_hash(F.col("given"))
    )


@check(
    "hash_integrity",
    sql("""
, stored AS (
  SELECT doc_id, text, CASE WHEN source = (SELECT max(source) FROM documents) THEN md5(lang)
                            ELSE md5(text) END AS key FROM documents
)
SELECT doc_id, key, md5(text) AS content_hash FROM stored WHERE md5(text) <> key"""),
)
def hash_integrity(spark, sf):
    docs = table(spark, sf, "documents")
    last = docs.agg(F.max("source").alias("source")).withColumn("_last", F.lit(True))
    key = F.when(F.col("_last"), hashes.content_hash(F.col("lang"))).otherwise(
        hashes.content_hash(F.col("text"))
    )
    stored = docs.join(last, "source", "left").select("doc_id", "text", key.alias("key"))
    return stored.where(~hashes.intact(F.col("text"), F.col("key"))).select(
        "doc_id", "key", hashes.content_hash(F.col("text")).alias("content_hash")
    )


@check(
    "hash_order",
    sql("""
, h AS (SELECT DISTINCT md5(text) AS hash FROM documents),
keyed AS (
  SELECT hash,
    hash[15:16] || hash[13:14] || hash[11:12] || hash[9:10] || hash[7:8] || hash[5:6] || hash[3:4]
    || hash[1:2] || hash[31:32] || hash[29:30] || hash[27:28] || hash[25:26] || hash[23:24]
    || hash[21:22] || hash[19:20] || hash[17:18] AS k FROM h
)
SELECT hash, k AS sort_key FROM keyed ORDER BY k"""),
)
def hash_order(spark, sf):
    docs = table(spark, sf, "documents").select(hashes.content_hash(F.col("text")).alias("hash"))
    keyed = docs.distinct().withColumn("sort_key", hashes.hash_sort_key(F.col("hash")))
    return keyed.orderBy("sort_key")


@check(
    "map_parent_from_row",
    sql("""
SELECT p_partkey AS map_id, coalesce(nullif(CASE WHEN p_size > 40 THEN p_partkey // 3 ELSE -1 END, -1),
       nullif(CASE WHEN p_size > 20 THEN p_partkey // 2 ELSE -1 END, -1)) AS parent FROM part"""),
)
def map_parent_from_row(spark, sf):
    cosmetic = F.when(F.col("p_size") > 40, F.floor(F.col("p_partkey") / 3)).otherwise(-1)
    plain = F.when(F.col("p_size") > 20, F.floor(F.col("p_partkey") / 2)).otherwise(-1)
    row = F.to_json(F.struct(cosmetic.alias("CosmeticParentMapID"), plain.alias("ParentMapID")))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("map_id"), labels.parent_map(row).alias("parent")
    )


@check(
    "coord_text",
    sql("""
SELECT build_id, map_id, x || ',' || y AS coord, x, y FROM tiles"""),
)
def coord_text(spark, sf):
    t = tiles(spark, sf).select(
        "build_id", "map_id", coords.coord_text(F.col("x"), F.col("y")).alias("coord")
    )
    t = t.withColumn("_at", coords.try_coord(F.col("coord")))
    return t.select("build_id", "map_id", "coord", "_at.x", "_at.y")


@check(
    "chunk_flags",
    sql("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 64 AS flags, (l_suppkey & 2) <> 0 AS impass,
       (l_suppkey & 4) <> 0 AS river, (l_suppkey & 8) <> 0 AS ocean, (l_suppkey & 16) <> 0 AS magma,
       (l_suppkey & 32) <> 0 AS slime FROM lineitem"""),
)
def chunk_flags(spark, sf):
    flags = F.col("l_suppkey") % 64
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", flags.alias("flags"),
        *[coords.chunk_flag(flags, name).alias(name) for name in coords.CHUNK_FLAGS],
    )


@check(
    "chunk_index",
    sql("""
SELECT map_id, x, y, idx, idx % 16 AS cx, idx // 16 AS cy, (idx // 16) * 16 + idx % 16 AS again,
       (idx % 16 + 1) % 16 AS right_x, (idx % 16 + 1) // 16 + x AS right_tile FROM chunks"""),
)
def chunk_index(spark, sf):
    cx, cy = F.col("idx") % 16, F.floor(F.col("idx") / 16)
    return chunks(spark, sf).select(
        "map_id", "x", "y", "idx", cx.alias("cx"), cy.alias("cy"),
        coords.chunk_index(cx, cy).alias("again"),
        ((cx + 1) % 16).alias("right_x"),
        (F.floor((cx + 1) / 16) + F.col("x")).alias("right_tile"),
    )


@check(
    "world_coordinates",
    sql("""
, w AS (SELECT event_id, value * 100 - 17000 AS wx, (user_id * 100.5 - 9000)::DOUBLE AS wy FROM events)
SELECT event_id, round((1 - (wy + 17066.6666666667) / 34133.3333333333) * 64, 4) AS grid_x,
       round((1 - (wx + 17066.6666666667) / 34133.3333333333) * 64, 4) AS grid_y,
       round(wx, 3) AS world_x, round(wy, 3) AS world_y,
       round(wx / (34133.3333333333 / 64), 4) AS grid_distance,
       round(wy * (34133.3333333333 / 64), 2) AS world_distance FROM w"""),
)
def world_coordinates(spark, sf):
    w = table(spark, sf, "events").select(
        "event_id", (F.col("value") * 100 - 17000).alias("wx"),
        (F.col("user_id") * F.lit(100.5) - 9000).alias("wy"),
    )
    gx, gy = coords.world_to_grid(F.col("wx"), F.col("wy"))
    back_x, back_y = coords.grid_to_world(gx, gy)
    return w.select(
        "event_id", F.round(gx, 4).alias("grid_x"), F.round(gy, 4).alias("grid_y"),
        F.round(back_x, 3).alias("world_x"), F.round(back_y, 3).alias("world_y"),
        F.round(coords.world_distance_to_grid(F.col("wx")), 4).alias("grid_distance"),
        F.round(coords.grid_distance_to_world(F.col("wy")), 2).alias("world_distance"),
    )


@check(
    "optimal_level",
    sql("""
SELECT event_id, greatest(0, least(6, greatest(0,
         floor(log2((value + 0.01) * ((CASE WHEN event_type = 'click' THEN 256 ELSE 512 END) / 512.0)))::INT)))
       AS level
FROM events"""),
)
def optimal_level(spark, sf):
    size = F.when(F.col("event_type") == "click", 256).otherwise(512)
    level = coords.optimal_level(F.col("value") + 0.01, size)
    return table(spark, sf, "events").select("event_id", level.alias("level"))


@check(
    "media_types",
    sql("""
, c AS (
  SELECT doc_id, CASE lang WHEN 'en' THEN 'RIFF' || lpad(doc_id::VARCHAR, 4, '0')[1:4] || 'WEBP' || text
                           WHEN 'de' THEN lpad(doc_id::VARCHAR, 4, '0')[1:4] || 'ftypavif' || text
                           ELSE text END AS t, lang
  FROM documents
)
SELECT doc_id, CASE lang WHEN 'en' THEN 'image/webp' WHEN 'de' THEN 'image/avif'
                         ELSE 'application/octet-stream' END AS media_type FROM c"""),
)
def media_types(spark, sf):
    lead = F.substring(F.lpad(F.col("doc_id"), 4, "0"), 1, 4)
    content = (
        F.when(F.col("lang") == "en", F.concat(F.lit("RIFF"), lead, F.lit("WEBP"), "text"))
        .when(F.col("lang") == "de", F.concat(lead, F.lit("ftypavif"), "text"))
        .otherwise(F.col("text"))
    )
    return table(spark, sf, "documents").select(
        "doc_id", hashes.media_type(content).alias("media_type")
    )


@check(
    "zone_labels",
    sql("""
, z AS (
  SELECT p_partkey AS id, p_name AS name,
         CASE WHEN p_size > 30 THEN replace(p_name, ' ', '''') WHEN p_size > 20 THEN p_name
              WHEN p_size > 10 THEN p_type ELSE '' END AS internal FROM part
),
n AS (SELECT *, count(*) OVER (PARTITION BY name, internal) AS same FROM z),
l AS (
  SELECT *, CASE WHEN lower(regexp_replace(internal, '[\\s'':.\\\\-]', '', 'g'))
                      <> lower(regexp_replace(name, '[\\s'':.\\\\-]', '', 'g')) THEN internal END AS shown,
         CASE WHEN same > 1 THEN '(' || id || ')' END AS tag FROM n
)
SELECT id AS area_id, name, internal AS internal_name,
       CASE WHEN internal <> '' AND internal <> name THEN nullif(concat_ws(' ', shown, tag), '') END AS label
FROM l"""),
)
def zone_labels(spark, sf):
    z = table(spark, sf, "part").select(
        F.col("p_partkey").alias("area_id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") > 30, F.replace(F.col("p_name"), F.lit(" "), F.lit("'")))
        .when(F.col("p_size") > 20, F.col("p_name"))
        .when(F.col("p_size") > 10, F.col("p_type"))
        .otherwise("")
        .alias("internal_name"),
    )
    # the count spreads by partial aggregation, then joins back
    same = area_ops.name_ambiguity(z, ["internal_name"])
    label = labels.zone_label(
        F.col("name"), F.col("internal_name"), F.col("area_id"), F.col("same_name")
    )
    return z.join(same, ["internal_name", "name"]).select(
        "area_id", "name", "internal_name", label.alias("label")
    )


@check(
    "map_names",
    sql("""
SELECT c_custkey AS map_id, coalesce(nullif(CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END, ''),
       c_mktsegment) AS name FROM customer"""),
)
def map_names(spark, sf):
    name = F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("map_id"),
        labels.map_label(name, F.col("c_mktsegment")).alias("name"),
    )


@check(
    "error_first_line",
    sql("SELECT conv_id, turn, split_part(text, chr(10), 1) AS first_line FROM conversations"),
)
def error_first_line(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", labels.first_line(F.col("text")).alias("first_line")
    )


@check(
    "scan_outcomes",
    sql("""
SELECT o_orderkey AS scan_id,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'encrypted_build'
            WHEN o_orderpriority = '2-HIGH' THEN 'encrypted_map_database'
            WHEN coalesce(n, 0) > 0 THEN 'partial_decrypt' ELSE 'full_decrypt' END AS state
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS n FROM lineitem
                       GROUP BY 1) ON l_orderkey = o_orderkey"""),
)
def scan_outcomes(spark, sf):
    locked = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count_if(F.col("l_returnflag") == "A").alias("n")
    )
    key = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("k"))
    table_key = F.when(F.col("o_orderpriority") == "2-HIGH", F.lit("k"))
    return table(spark, sf, "orders").join(locked, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("scan_id"),
        labels.scan_outcome(key, table_key, F.coalesce("n", F.lit(0))).alias("state"),
    )


@check(
    "legacy_layer_names",
    sql("""
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE l_returnflag WHEN 'A' THEN 'map_texture' WHEN 'N' THEN 'no_liquid' ELSE 'minimap' END AS layer
FROM lineitem"""),
)
def legacy_layer_names(spark, sf):
    old = (
        F.when(F.col("l_returnflag") == "A", "maptexture")
        .when(F.col("l_returnflag") == "N", "noliquid")
        .otherwise("minimap")
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", labels.current_layer_name(old).alias("layer")
    )


@check(
    "preferred_base_layer",
    sql("""
SELECT p_partkey AS map_id,
       CASE WHEN p_size % 3 = 0 AND p_size > 10 THEN 0 WHEN p_size % 3 = 1 AND p_size > 25 THEN 1
            WHEN p_size > 10 THEN 0 WHEN p_size > 25 THEN 1 ELSE 0 END AS base_layer FROM part"""),
)
def preferred_base_layer(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("map_id"),
        labels.preferred_base(size % 3, size > 10, size > 25).alias("base_layer"),
    )


@check(
    "expected_paths",
    sql("""
SELECT p_partkey, 'world/maps/' || lower(p_type) || '/' || lower(p_type) || '.wdt' AS wdt,
       'world/maps/' || lower(p_type) || '/' || lower(p_type) || '_' || p_size || '_' || (p_partkey % 64)
         || '.adt' AS adt,
       md5(p_name)[1:2] || '/' || md5(p_name) AS store_key FROM part"""),
)
def expected_paths(spark, sf):
    folder = F.col("p_type")
    return table(spark, sf, "part").select(
        "p_partkey", labels.wdt_path(folder).alias("wdt"),
        labels.adt_path(folder, F.col("p_size"), F.col("p_partkey") % 64).alias("adt"),
        hashes.store_key(hashes.content_hash(F.col("p_name"))).alias("store_key"),
    )


@check(
    "extents_documents",
    sql("""
SELECT build_id, map_id, layer_type,
       '{"x0":' || x0 || ',"y0":' || y0 || ',"x1":' || x1 || ',"y1":' || y1 || '}' AS extents,
       x0, y0, x1, y1 FROM compositions"""),
)
def extents_documents(spark, sf):
    from atlasledger.checks.derive import LAYER_KEYS, layer_tiles
    from atlasledger.operators.compose import compositions

    rows = compositions(layer_tiles(spark, sf), LAYER_KEYS)
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    docs = rows.select(
        "build_id", "map_id", "layer_type", labels.extents_document(*box).alias("extents")
    )
    for name, column in labels.extents_columns(F.col("extents")).items():
        docs = docs.withColumn(name, column)
    return docs


@check(
    "tile_count_default",
    sql("""
SELECT c_custkey AS map_id, coalesce(n, 0) AS wdt_tile_count FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey"""),
)
def tile_count_default(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return table(spark, sf, "customer").join(counts, "c_custkey", "left").select(
        F.col("c_custkey").alias("map_id"), F.coalesce("n", F.lit(0)).alias("wdt_tile_count")
    )
