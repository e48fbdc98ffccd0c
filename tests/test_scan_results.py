"""Scan results on demand, pyramids with sizes, and how documents are dealt to tasks."""

import pytest
from pyspark.sql import functions as F

from atlasledger.checks.served import scan_facts
from atlasledger.operators import areas, chunks, lod
from atlasledger.plans import scan


@pytest.fixture(scope="module")
def facts(spark, sf):
    return scan_facts(spark, sf)


@pytest.fixture(scope="module")
def everything(facts):
    return scan.scan_builds(facts)


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", ["layers", "masks", "compositions", "pyramid", "blobs", "maps", "tile_sizes", "extractions", "build_maps"])
def test_a_result_is_whole_whatever_else_is_wanted(facts, everything, name):
    alone = scan.scan_builds(facts, wanted=[name])
    assert list(alone) == [name]
    assert rows(alone[name]) == rows(everything[name])


def test_masks_are_those_of_the_layer_rows(everything):
    want = everything["layers"].groupBy("map_id").agg(F.bit_or(F.expr("shiftleft(1, layer_type)")).alias("layer_mask"))
    assert rows(everything["masks"]) == rows(want)


def test_masks_and_pyramids_make_no_data_documents(facts, monkeypatch):
    def no(*_):
        raise AssertionError("documents were made")

    monkeypatch.setattr(scan, "data_documents", no)
    for name in ("masks", "maps", "compositions", "pyramid"):
        scan.scan_builds(facts, wanted=[name])


def test_documents_are_dealt_by_how_many_there_are(spark):
    tiles = spark.createDataFrame([(m, 1, 2, 3, m % 5, True) for m in range(40)], "m int, x int, y int, idx int, area_id bigint, impass boolean")
    table = spark.createDataFrame([(a, 0, "n") for a in range(1, 5)], "area_id bigint, parent_id bigint, name string")
    grids = chunks.extractions(tiles, ["m", "x", "y"]).withColumn("owned", F.array_distinct("area_ids"))

    def made(count):
        closure = lambda a: areas.ancestor_closure(a, table.select("area_id", "parent_id"), ["m"], placed=True)
        return chunks.data_documents(grids, table.drop("parent_id"), ["m"], closure, count)

    many = made(1280)
    assert many.rdd.getNumPartitions() >= 1280 // chunks.DOCUMENTS_PER_PIECE
    assert rows(many) == rows(made(0))


def test_pyramid_cells_have_the_size_of_their_largest_tile(spark):
    """One layout gives hashes and sizes; cells do not meet their sizes in a join."""
    at = [(0, 0, 128), (1, 1, 256), (2, 1, None), (63, 63, 32), (33, 5, 512), (70, 1, 4096)]
    tiles = spark.createDataFrame(
        [(k, x, y, f"{x:02x}{y:02x}" * 8, s is None, s) for k in (1, 2) for x, y, s in at],
        "k int, x int, y int, hash string, cdn_missing boolean, tile_size int",
    )
    got = {(r["k"], r["level"], r["x"], r["y"]): (r["hash"], r["tile_size"]) for r in lod.sized_cells(tiles, ["k"]).collect()}
    want = {}
    for k in (1, 2):
        for x, y, s in at[:5]:
            for level in range(1, 7):
                key = (k, level, x >> level << level, y >> level << level)
                want[key] = max(want.get(key, 64), s or 0)
    assert {k: v[1] for k, v in got.items()} == want
    hashes = {(r["k"], r["level"], r["x"], r["y"]): r["hash"] for r in lod.lod_cells(tiles, ["k"]).collect()}
    assert {k: v[0] for k, v in got.items()} == hashes
    bare = lod.sized_cells(tiles, ["k"], hashed=False)
    assert {(r["k"], r["level"], r["x"], r["y"]): r["tile_size"] for r in bare.collect()} == want
    plan = lod.sized_cells(tiles, ["k"], hashed=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_area_tables_are_told_apart_by_all_rows(spark):
    def table(builds):
        held = [(b, a, p, n) for b, rows_ in builds.items() for a, p, n in rows_]
        return spark.createDataFrame(held, "build_id long, area_id long, parent_id long, name string")

    class Facts:
        cells = spark.createDataFrame([(b,) for b in (1, 2, 3, 4)], "build_id long")
        areas = table({1: [(1, 0, "a"), (2, 1, None)], 2: [(2, 1, None), (1, 0, "a")], 3: [(1, 0, "a"), (2, 1, "b")]})

    of_build, distinct = scan.area_tables(Facts)
    got = {r["build_id"]: r["area_hash"] for r in of_build.collect()}
    assert got[1] == got[2] != got[3] and got[4] == ""
    assert distinct.count() == 4
