"""Tables in buckets: right rows, no exchange of what is landed, and look-ups that open little."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from atlasledger.checks import derive, lookups
from atlasledger.checks import served as served_checks
from atlasledger.sources import served, store


def md5(n):
    return hashlib.md5(str(n).encode()).hexdigest()


@pytest.fixture
def merged_joins(spark):
    """Joins as they are where neither side is small, with plans that do not change while running."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def table_name():
    return f"t_{uuid.uuid4().hex}"


def contents(spark, path, rows=20_000, buckets=4):
    df = spark.range(rows).select(F.md5(F.col("id").cast("string").cast("binary")).alias("hash"), F.col("id").alias("size"))
    return served.write_bucketed(df, table_name(), str(path), ["hash"], buckets, bloom="hash")


def leaves(df):
    found = df._jdf.queryExecution().executedPlan().collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def rows_read(df):
    return sum(leaf.metrics().apply("numOutputRows").value() for leaf in leaves(df))


def test_a_look_up_opens_one_bucket_and_an_absent_hash_no_row_group(spark, tmp_path, merged_joins):
    held = contents(spark, tmp_path / "c")
    one = served.find(held, "hash", [md5(7)])
    assert [r["size"] for r in one.collect()] == [7]
    assert rows_read(one) <= 5_500  # a quarter of the rows
    none = served.find(held, "hash", [md5("absent"), md5("neither")])
    assert none.collect() == [] and rows_read(none) == 0
    assert served.find(held, "hash", []).count() == served.find(held, "hash", [None]).count() == 0


def test_requests_go_to_the_contents(spark, tmp_path, merged_joins):
    held = contents(spark, tmp_path / "c")
    asked = [(1, md5(5)), (2, md5(5).upper()), (3, "x"), (4, None), (5, md5("absent"))]
    requests = spark.createDataFrame(asked, "id int, asked string")
    hit = served.asked_for(requests, held, "asked")
    assert [(r["hash"], r["size"]) for r in hit.collect()] == [(md5(5), 5)]
    assert exchanges(hit) == 1  # the requests
    rows = store.look_up(requests, hit, "asked", "size").collect()
    assert {r["id"]: (r["status"], r["size"]) for r in rows} == {
        1: ("ok", 5), 2: ("ok", 5), 3: ("bad_request", None), 4: ("bad_request", None), 5: ("not_found", None)
    }


def test_another_session_opens_the_table(spark, tmp_path, merged_joins):
    contents(spark, tmp_path / "c")
    again = served.open_bucketed(spark, table_name(), str(tmp_path / "c"), "hash string, size bigint", ["hash"], 4)
    assert again.count() == 20_000
    assert exchanges(again.groupBy("hash").agg(F.max("size"))) == 0


def landed(spark, root, maps=40, builds=50):
    at = spark.range(maps * builds).select((F.col("id") % maps).cast("int").alias("map_id"), F.floor(F.col("id") / maps).alias("build_id"))
    layers = at.withColumn("layer_type", F.explode(F.array(F.lit(0), F.lit(3)))).select(
        "*",
        F.when(F.col("layer_type") == 0, F.concat_ws("-", "map_id", "build_id")).alias("composition_hash"),
        F.when(F.col("layer_type") == 3, F.lit("d")).alias("data_hash"),
        F.lit(None).cast("array<string>").alias("cdn_missing"),
    )
    counts = at.withColumn("wdt_tile_count", F.col("build_id") * 2)
    rows = at.groupBy("map_id").agg(F.max("build_id").alias("last_seen")).select(
        "*", F.lit(1).alias("layer_mask"), F.lit('{"ParentMapID":3,"CosmeticParentMapID":-1}').alias("json")
    )
    products = at.select("build_id").distinct().select("build_id", F.lit("game").alias("product"), F.lit("2025").alias("first_seen"))
    return served.Served(spark, str(root), table_name(), rows_per_bucket=500).land(layers, counts, rows, products)


def test_grouping_and_joining_move_no_landed_row(spark, tmp_path, merged_joins):
    held = landed(spark, tmp_path)
    pivoted = held.map_versions()
    assert pivoted.count() == 2000
    one = pivoted.where("map_id = 7 and build_id = 3").select("l0", "l3", "products").collect()
    assert [tuple(r) for r in one] == [("7-3", "d", ["game"])]
    # the layers' own grouping needs none: the only exchanges are the two of the join with the builds
    assert exchanges(pivoted) == 2
    listed = held.map_list()
    assert {r["wdt_tile_count"] for r in listed.collect()} == {98} and listed.count() == 40
    assert exchanges(listed) == 1  # of the maps


def test_a_small_side_is_broadcast_from_its_files(spark, tmp_path):
    held = landed(spark, tmp_path)
    assert exchanges(held.map_versions()) == 0 and exchanges(held.map_list()) == 0


def test_buckets_follow_the_rows():
    assert [served.buckets_for(n, 10) for n in (0, 1, 10, 11, 40, 41)] == [1, 1, 1, 2, 4, 8]


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "hash string, size bigint")
    held = served.write_bucketed(none, table_name(), str(tmp_path / "e"), ["hash"], bloom="hash")
    requests = spark.createDataFrame([(md5(1),)], "asked string")
    assert store.look_up(requests, served.asked_for(requests, held, "asked"), "asked", "size").first()["status"] == "not_found"


def test_requested_maps_read_landed_versions(spark, sf):
    """Versions are asked three things; none of them derives the versions again."""
    out = contract.queries()["load_map"](spark, sf)
    assert not [f for f in out.inputFiles() if f"{sf}/" in f]


def test_landing_derives_layers_once(spark, sf, monkeypatch):
    calls = []
    for module in (lookups, served_checks):
        monkeypatch.setattr(module, "layers", lambda *a: calls.append(a) or derive.layers(*a), raising=False)
    assert lookups.landed(spark, sf).map_list().count() > 0
    assert len(calls) == 1
