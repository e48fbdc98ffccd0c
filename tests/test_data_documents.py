"""Data documents made in batches, against those that are joined, and what they write and move."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from atlasledger import session
from atlasledger.checks.served import scan_facts
from atlasledger.operators import chunks, data_documents, lod
from atlasledger.plans import scan
from atlasledger.session import Scratch

FACTS = "build_id long, map_id int, x int, y int, hash string"
CHUNKS = "adt_hash string, idx int, area_id long, impass boolean"
AREAS = "build_id long, area_id long, parent_id long, ID long, name string"


@pytest.fixture(scope="module")
def odd(spark):
    """Maps with many sets, tiles listed twice, chunks outside the tile, areas on a cycle, in a chain, unknown and null."""
    listed = []
    for b in range(1, 20):
        for m in (1, 2):
            listed += [(b, m, x, y, f"t{(x + y * (b // 2 if m == 1 else 0)) % 23}") for x in range(9, 12) for y in range(3)]
    listed += [(3, 1, 9, 0, "t5"), (3, 1, 9, 0, "t5"), (4, 1, 10, 1, "flags"), (5, 7, 0, 0, "bare"), (6, 8, 0, 0, "outside")]
    filled = [(f"t{i}", (i * 7 + k * 31) % 256, (i * 5 + k) % 90, (i + k) % 4 == 0) for i in range(23) for k in range(6)]
    filled += [("t3", 1, None, False), ("flags", 0, None, True), ("bare", 255, 0, False), ("outside", 256, 5, True), ("t4", 9, 10**12, None)]
    kinds = {1: lambda a: a // 2, 2: lambda a: a - 1 if a < 70 else 0, 3: lambda a: a % 9 + 1}
    areas = [(b, a, kinds[b % 3 + 1](a), kinds[b % 3 + 1](a) * 1000 + a, f"né {a}") for b in range(1, 18) for a in range(1, 85)]
    areas += [(b, 40, 80, 7, "second row") for b in range(1, 18, 3)] + [(b, None, 1, 0, "no id") for b in range(1, 18)]
    areas += [(b, 83, None, 1, "no parent") for b in range(1, 18)]
    listed = spark.createDataFrame(listed, FACTS).withColumn("hash", F.md5("hash"))
    filled = spark.createDataFrame(filled, CHUNKS).withColumn("adt_hash", F.md5("adt_hash"))
    facts = SimpleNamespace(cells=listed.select("build_id", "map_id"), areas=spark.createDataFrame(areas, AREAS))
    return facts, listed, chunks.extractions(filled, ["adt_hash"]).cache()


def rows(df):
    return sorted(map(repr, df.collect()))


def test_documents_in_batches_are_those_that_are_joined(odd):
    facts, listed, packed = odd
    joined = scan.data_documents(facts, listed, packed, most=0)
    made = scan.data_documents(facts, listed, packed)
    assert rows(made.hashes) == rows(joined.hashes.select(*made.hashes.columns))
    assert made.sets.groupBy("map_id").agg(F.count_distinct("set_hash", "area_hash").alias("n")).where(
        f"n > {data_documents.SETS_PER_PIECE}"
    ).count()
    got, want = (rows(scan.distinct_documents(m)) for m in (made, joined))
    assert got == want and len(got) > 20
    assert all(json.loads(r["document"])["tiles"] for r in scan.distinct_documents(made).collect())
    few = made.hashes.where("data_hash < '4'")
    assert rows(made.texts(few).distinct()) == rows(scan.distinct_documents(made).where("data_hash < '4'"))


def test_extractions_are_bitsets_and_grids(spark, odd):
    held = [("a", 0, 5, True), ("a", 255, 0, False), ("b", 7, None, True), ("b", 9, -3, None), ("c", 256, 1, True), ("d", -1, 2, False), ("d", 3, 2, False)]
    held += [("d", 3, 1, True), ("d", 3, None, False), ("d", 4, 7, False), ("e", 255, 1, None)]
    held = spark.createDataFrame(held, CHUNKS)
    grids = chunks.area_grids(held, ["adt_hash"]).withColumn("area_text", F.to_json("area_ids"))
    want = chunks.impass_bitsets(held, ["adt_hash"]).join(grids, "adt_hash", "left")
    got = chunks.extractions(held, ["adt_hash"])
    assert rows(got.select(*want.columns)) == rows(want)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_no_document_is_written_or_moved_before_it_is_handed_out(spark, sf, monkeypatch):
    saved = []
    save = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df: saved.append(df.columns) or save(self, df))
    blobs = scan.scan_builds(scan_facts(spark, sf), wanted=["blobs"])["blobs"]
    assert not [c for c in saved if "document" in c]
    plan = blobs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]
    assert blobs.count() == 14


def test_cells_of_many_compositions_are_cut_from_one_layout(spark):
    """Whatever batches compositions come in, and whatever their keys are."""
    tiles = spark.range(3000).selectExpr(
        "id % 40 AS k", "concat('c', id % 40) AS name", "cast(id % 61 AS int) AS x", "cast(id % 53 AS int) AS y",
        "md5(cast(cast(id AS string) AS binary)) AS hash", "id % 11 = 0 AS cdn_missing", "cast(if(id % 7 = 0, null, 64 << (id % 4)) AS int) AS tile_size",
    )
    keys = ["k", "name"]
    got = lod.sized_cells(tiles, keys)
    assert rows(got.select(*keys, "level", "x", "y", "hash")) == rows(lod.lod_cells(tiles, keys))
    sizes = {}
    for r in tiles.collect():
        for level in range(1, 7):
            key = (r["name"], level, r["x"] >> level << level, r["y"] >> level << level)
            sizes[key] = max(sizes.get(key, 64), r["tile_size"] or 0)
    assert {(r["name"], r["level"], r["x"], r["y"]): r["tile_size"] for r in got.collect()} == sizes
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert lod.sized_cells(tiles.limit(0), keys).count() == 0


def test_long_steps_let_go_of_their_shuffles(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(session, "free_shuffles", asked.append)
    with Scratch(spark) as scratch:
        scratch.save(spark.range(3))
        assert not asked
        monkeypatch.setattr(session, "LONG_STEP_S", -1)
        assert scratch.save(spark.range(3)).count() == 3
    assert asked == [spark]
