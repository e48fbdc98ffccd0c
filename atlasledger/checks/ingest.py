"""Sources and sinks: typed tables, feeds, key lists, grids and content stores.

Files a check reads back are first written, by Spark and from the driver's
tables, to the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from atlasledger.checks import check
from atlasledger.checks.derive import cells, feed_versions, layers, sql, table
from atlasledger.session import shared_folder
from atlasledger.sources import feeds, grids, store, tables


def scratch(spark, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_folder(spark)}/atlasledger-{name}-{uuid.uuid4().hex}"


@check(
    "catalogue_table_scan",
    sql("""
SELECT build_id, map_id, layer_type, composition_hash, array_to_string(cdn_missing, ' ') AS cdn_missing
FROM layers"""),
)
def catalogue_table_scan(spark, sf):
    root = scratch(spark, "tables")
    rows = layers(spark, sf).drop("b").withColumn("data_hash", F.lit(None).cast("string"))
    tables.write_table(rows, root, "build_map_layers")
    back = tables.read_table(spark, root, "build_map_layers")
    return back.select(
        "build_id", "map_id", "layer_type", "composition_hash",
        F.array_join("cdn_missing", " ").alias("cdn_missing"),
    )


@check(
    "scan_state_check",
    sql("""
SELECT o_orderkey AS product_id, o_orderstatus AS state FROM orders
WHERE lower(o_orderstatus) NOT IN ('pending', 'exception', 'encrypted_build', 'encrypted_map_database',
                                   'partial_decrypt', 'full_decrypt')"""),
)
def scan_state_check(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("product_id"), F.col("o_orderstatus").alias("state")
    )
    return tables.unknown_states(rows)


def feed_pages(spark, sf):
    """One version page per product and version.

    A page lists each region and config pair once, so it stays small however
    many orders stand behind it.
    """
    rows = feed_versions(spark, sf).select(
        "product", "version", "region", "build_config", "cdn_config", "product_config"
    ).distinct()
    line = F.concat_ws(
        "|", "region", "build_config", "cdn_config", F.lit(""),
        F.element_at(F.split("version", r"\."), 4), "version", "product_config",
    )
    header = feeds.FEEDS["versions"][0]
    return rows.groupBy("product", "version").agg(
        F.concat_ws(
            "\n",
            F.lit(header),
            F.concat(F.lit("## seqn = "), F.element_at(F.split("version", r"\."), 4)),
            F.array_join(F.sort_array(F.collect_list(line)), "\n"),
        ).alias("document")
    )


PAGE_ROWS_SQL = """
SELECT DISTINCT product, split_part(version, '.', 4)::BIGINT AS seqn, region, build_config, cdn_config,
       '' AS key_ring, split_part(version, '.', 4)::BIGINT AS build_number, version, product_config
FROM feed_versions"""


@check("feed_text", sql(PAGE_ROWS_SQL))
def feed_text(spark, sf):
    rows = feeds.parse_feed(feed_pages(spark, sf).drop("version"), "versions")
    return rows.drop("line_no")


@check(
    "feed_summary_text",
    sql("""
SELECT lower(c_mktsegment) AS name, c_custkey AS product_seqn, c_custkey + 1 AS seqn,
       CASE WHEN c_acctbal < 0 THEN 'cdn' ELSE '' END AS flags FROM customer"""),
)
def feed_summary_text(spark, sf):
    """A summary page per customer; an unflagged line leaves its last field out."""
    line = F.concat(
        F.lower("c_mktsegment"), F.lit("|"), F.col("c_custkey"),
        F.when(F.col("c_acctbal") < 0, F.lit("|cdn")).otherwise(F.lit("")),
    )
    header = feeds.FEEDS["summary"][0]
    pages = table(spark, sf, "customer").select(
        F.concat_ws(
            "\n", F.lit(header), F.concat(F.lit("## seqn = "), F.col("c_custkey") + 1), line
        ).alias("document")
    )
    return feeds.parse_feed(pages, "summary").select("name", "product_seqn", "seqn", "flags")


@check(
    "feed_endpoint_text",
    sql("""
SELECT s_suppkey AS seqn, s_name AS name, 'tpr/' || n_name AS path, n_name || ' ' || s_name AS hosts,
       '' AS servers, 'tpr/configs' AS config_path
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""),
)
def feed_endpoint_text(spark, sf):
    line = F.concat_ws(
        "|", "s_name", F.concat(F.lit("tpr/"), "n_name"), F.concat("n_name", F.lit(" "), "s_name"),
        F.lit(""), F.lit("tpr/configs"),
    )
    header = feeds.FEEDS["cdns"][0]
    pages = (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat_ws(
                "\r\n", F.lit(header), F.concat(F.lit("## seqn = "), F.col("s_suppkey")), line
            ).alias("document")
        )
    )
    return feeds.parse_feed(pages, "cdns").drop("line_no")


@check(
    "key_list",
    sql("""
SELECT page_id, upper(md5(url)[1:16]) AS key_name, md5(html) AS key_hex FROM pages"""),
)
def key_list(spark, sf):
    lines = table(spark, sf, "pages").select(
        "page_id",
        F.concat(
            F.substring(F.md5(F.col("url").cast("binary")), 1, 16), F.lit(" "),
            F.upper(F.md5(F.col("html").cast("binary"))), F.lit(" note "), F.col("page_id"),
        ).alias("line"),
    )
    return feeds.parse_key_list(lines, keep=("page_id",))


@check(
    "grid_unpack",
    sql("""
SELECT build_id, map_id, x, y, root_adt, 0 AS obj0_adt, 0 AS obj1_adt, 0 AS tex0_adt, 0 AS lod_adt,
       map_texture, 0 AS map_texture_n, minimap_texture FROM cells"""),
)
def grid_unpack(spark, sf):
    zero = F.lit(0).cast("bigint")
    listed = cells(spark, sf, placed=True).select(
        "build_id", "map_id", "x", "y", "root_adt", "map_texture", "minimap_texture",
        *[zero.alias(n) for n in ("obj0_adt", "obj1_adt", "tex0_adt", "lod_adt", "map_texture_n")],
    )
    packed = grids.pack_grid(listed, ["build_id", "map_id"])
    return grids.unpack_grid(packed, "payload")


@check(
    "row_documents",
    sql("""
SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","flags_0":' || c_nationkey
       || ',"flags_1":' || (c_nationkey + 1) || ',"flags_2":' || (c_nationkey * 2) || '}' AS document
FROM customer"""),
)
def row_documents(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey", "c_name",
        F.array("c_nationkey", F.col("c_nationkey") + 1, F.col("c_nationkey") * 2).alias("flags"),
    )
    return tables.row_documents(rows, {"flags": 3}).select("c_custkey", "document")


@check(
    "content_store",
    sql("""
, saves AS (
  SELECT md5(text) AS hash, doc_id AS saved_at, text,
         CASE WHEN lang = 'en' THEN 'image/webp' ELSE 'image/png' END AS media_type FROM documents
)
SELECT hash[1:2] AS prefix, hash, max(saved_at) AS saved_at, arg_max(media_type, saved_at) AS media_type,
       CASE arg_max(media_type, saved_at) WHEN 'image/webp' THEN '.webp' ELSE '.png' END AS ending,
       md5(arg_max(text, saved_at)) AS stored_hash
FROM saves GROUP BY 1, 2"""),
)
def content_store(spark, sf):
    saves = table(spark, sf, "documents").select(
        F.md5(F.col("text").cast("binary")).alias("hash"),
        F.col("doc_id").alias("saved_at"),
        F.col("text").cast("binary").alias("content"),
        F.when(F.col("lang") == "en", "image/webp").otherwise("image/png").alias("media_type"),
    )
    root = scratch(spark, "store")
    store.write_store(saves, root)
    back = store.read_store(spark, root)
    return back.select(
        "prefix", "hash", "saved_at", "media_type", "ending", F.md5("content").alias("stored_hash")
    )


@check(
    "point_lookup",
    sql("""
, requests AS (
  SELECT doc_id, CASE WHEN lang = 'en' THEN upper(md5(text)) WHEN lang = 'de' THEN md5(source || doc_id)
                      WHEN lang = 'fr' THEN 'not-a-hash' ELSE md5(text) END AS asked FROM documents
),
store AS (SELECT md5(text) AS hash, max(n_chars) AS size FROM documents GROUP BY 1)
SELECT doc_id, asked, s.size, CASE WHEN asked = 'not-a-hash' THEN 'bad_request' WHEN s.hash IS NULL THEN 'not_found'
                                  ELSE 'ok' END AS status
FROM requests r LEFT JOIN store s ON s.hash = lower(r.asked)"""),
)
def point_lookup(spark, sf):
    requests, held = document_requests(spark, sf)
    return store.look_up(requests, held, "asked", "size")


def document_requests(spark, sf):
    """A request for the content of each document, some malformed or absent, and all contents."""
    docs = table(spark, sf, "documents")
    md5 = F.md5(F.col("text").cast("binary"))
    asked = (
        F.when(F.col("lang") == "en", F.upper(md5))
        .when(F.col("lang") == "de", F.md5(F.concat("source", "doc_id").cast("binary")))
        .when(F.col("lang") == "fr", F.lit("not-a-hash"))
        .otherwise(md5)
    )
    requests = docs.select("doc_id", asked.alias("asked"))
    held = docs.groupBy(md5.alias("hash")).agg(F.max("n_chars").alias("size"))
    return requests, held


@check(
    "unique_content",
    sql("SELECT md5(text) AS hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1"),
)
def unique_content(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.groupBy(F.md5(F.col("text").cast("binary")).alias("hash")).agg(
        F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")
    )


@check("distinct_tile_hashes", sql("SELECT DISTINCT hash FROM tile_sizes"))
def distinct_tile_hashes(spark, sf):
    from atlasledger.checks.derive import tiles
    from atlasledger.operators.resolve import distinct_hashes

    return distinct_hashes(tiles(spark, sf))


@check(
    "path_list_files",
    sql("""
SELECT 'dir/file_' || p_partkey AS path,
       CASE WHEN p_size > 25 THEN p_partkey + 1000000 ELSE p_partkey END AS fdid
FROM part"""),
)
def path_list_files(spark, sf):
    """Path lists read from landed files; a path in a later file gets that file's id."""
    root = scratch(spark, "lines")
    parts = table(spark, sf, "part")
    name = F.concat(F.lit(";DIR/File_"), F.col("p_partkey"))
    parts.select(F.concat(F.col("p_partkey"), name)).write.text(f"{root}/1")
    later = parts.where(F.col("p_size") > 25)
    later.select(F.concat(F.col("p_partkey") + 1000000, name)).write.text(f"{root}/2")
    return feeds.parse_path_list(feeds.read_lines(spark, f"{root}/*"))


@check(
    "key_list_files",
    sql("""
SELECT upper(substr(md5(c_name), 1, 16)) AS key_name, md5(c_mktsegment) AS key_hex FROM customer"""),
)
def key_list_files(spark, sf):
    root = scratch(spark, "lines")
    line = F.concat(
        F.substring(F.md5(F.col("c_name").cast("binary")), 1, 16),
        F.lit(" "),
        F.upper(F.md5(F.col("c_mktsegment").cast("binary"))),
        F.lit(" # "),
        F.col("c_name"),
    )
    table(spark, sf, "customer").select(line).write.text(root)
    return feeds.parse_key_list(feeds.read_lines(spark, root))
