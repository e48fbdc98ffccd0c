"""Ancestor closures, parent chains and zone trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasledger.checks import check
from atlasledger.checks.aggregates import CLOSURE_CTE
from atlasledger.checks.derive import areas, chunks, layers, sql, table
from atlasledger.operators import areas as area_ops
from atlasledger.operators import chunks as chunk_ops
from atlasledger.plans import serve


@check("area_closure", sql(CLOSURE_CTE + "SELECT map_id, area_id FROM closure"))
def area_closure(spark, sf):
    return area_ops.ancestor_closure(
        chunk_ops.referenced_areas(chunks(spark, sf), ["map_id"]),
        areas(spark, sf).select("area_id", "parent_id"),
        ["map_id"],
    )


def map_parents(spark, sf):
    """Maps of the layer rows, each under the map with half its number."""
    maps = table(spark, sf, "part").select(
        F.floor(F.col("p_partkey") / 256).cast("int").alias("map_id")
    )
    return maps.distinct().withColumn("parent_id", F.floor(F.col("map_id") / 2).cast("int"))


PARENT_SQL = """
, parents AS (SELECT DISTINCT p_partkey // 256 AS map_id, p_partkey // 256 // 2 AS parent_id FROM part),
requests AS (
  SELECT p.map_id, b.build_id + 1 AS requested
  FROM (SELECT DISTINCT map_id FROM parents) p
  JOIN (SELECT DISTINCT map_id, build_id FROM layers) b ON b.map_id = p.map_id
),
chain AS (
  SELECT DISTINCT map_id AS root, map_id FROM requests
  UNION
  SELECT c.root, p.parent_id FROM chain c JOIN parents p ON p.map_id = c.map_id WHERE p.parent_id <> 0
)
"""


@check(
    "parent_map_chain",
    sql(PARENT_SQL + """
, asked AS (SELECT c.root, c.map_id, r.requested FROM chain c JOIN requests r ON r.map_id = c.root),
versions AS (SELECT DISTINCT map_id, build_id FROM layers),
low AS (SELECT a.*, v.build_id AS older FROM asked a
        ASOF LEFT JOIN versions v ON v.map_id = a.map_id AND v.build_id <= a.requested),
both_ AS (SELECT l.*, v.build_id AS newer FROM low l
          ASOF LEFT JOIN versions v ON v.map_id = l.map_id AND v.build_id >= l.requested)
SELECT root, map_id, requested,
       CASE WHEN older IS NOT NULL AND (newer IS NULL OR requested - older <= newer - requested)
            THEN older ELSE newer END AS build_id
FROM both_"""),
)
def parent_map_chain(spark, sf):
    from atlasledger.operators.history import nearest_build

    versions = layers(spark, sf).select("map_id", "build_id").distinct()
    requests = versions.select("map_id", (F.col("build_id") + 1).alias("requested"))
    chained = serve.parent_chains(requests, map_parents(spark, sf))
    return nearest_build(chained, versions).select("root", "map_id", "requested", "build_id")


@check(
    "zone_tree",
    sql("""
, tree AS (
  SELECT area_id, 0 AS depth, name || chr(1) || lpad(area_id::VARCHAR, 12, '0') AS path FROM areas
  WHERE parent_id NOT IN (SELECT area_id FROM areas)
  UNION ALL
  SELECT a.area_id, t.depth + 1, t.path || chr(1) || a.name || chr(1) || lpad(a.area_id::VARCHAR, 12, '0')
  FROM tree t JOIN areas a ON a.parent_id = t.area_id
),
family AS (
  SELECT a.area_id, a.name, CASE WHEN a.parent_id IN (SELECT area_id FROM areas) THEN a.parent_id ELSE 0 END AS f
  FROM areas a
)
SELECT t.area_id, t.depth, replace(t.path, chr(1), '/') AS path,
       row_number() OVER (PARTITION BY f.f ORDER BY f.name DESC, f.area_id DESC) = 1 AS is_last,
       t.area_id IN (SELECT parent_id FROM areas) AS has_children
FROM tree t JOIN family f ON f.area_id = t.area_id"""),
)
def zone_tree(spark, sf):
    out = area_ops.zone_tree(areas(spark, sf), [])
    return out.select(
        "area_id", "depth", F.translate("path", "\u0001", "/").alias("path"), "is_last", "has_children"
    )
