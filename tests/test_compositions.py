"""Compositions and pyramids: golden values and invariants."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from atlasledger.operators import compose, lod
from atlasledger.sources import documents

# A published composition document and its hash.
GOLDEN = (
    '{"tiles":{"016662f1b521fc5043fce76f3f48ab7f":["35,31"],"01bff988d9cbab711e5f969e2de230e5'
    '":["31,30"],"097bfac6b3a7b6a394691b4fa4d6aa2e":["31,34"],"162005c47d661b69ce31a900d8b72d'
    'c1":["35,32"],"18f70b35250e34c8ef8bb4cba4432c84":["34,32"],"1bd2cc8cbff4efbaa72014122eb8'
    '28fa":["31,35"],"1c9993f42ee8e2edb1a7b6430aa9eac1":["34,34"],"1d5ea497258ba37b161bcc5cd8'
    'c01dc0":["34,30"],"217c095a48abfce1c519f9bf2f550ebb":["31,31"],"2881a35e75b5741db3958ea1'
    '8be9efe4":["33,32"],"2a33bf8fdac1a7854d6d08c26e0b87c6":["33,33"],"2b7840b0e3e350a5193113'
    '396f3bd3bb":["33,30"],"34aa813169bef9df2a4091b46920bd22":["32,33"],"39d0a39b472213cc57b6'
    '726295094cf0":["32,34"],"41cf40d8c328f61b5496d2cd7d390665":["30,34"],"4e88b838d6b072d84c'
    '5c9e03cb287e00":["33,34"],"64696101e73f6490dea42147210c8fef":["34,31"],"83b7d7e58d4c6d06'
    'e7d42caadbd2f5e6":["30,35"],"882f74e92be466ec977cfad10748a4c5":["33,31"],"9bb6e60838620d'
    'df8eefeb987ab01e37":["32,32"],"a1e7b9f0c5ea93af9c2f70fdbe1984e4":["31,32"],"a30fd13f62d0'
    'e678ea6b6468b3e12298":["34,33"],"a724576e2ec50a3dcbf62b72bb3a43cd":["35,30"],"af8df198ae'
    '64f1099fd38fcdeb89989d":["35,34"],"ccc48b4e8591c9df3d5496a5b151c1c5":["31,33"],"d6e6a6c6'
    '9e1db5cd752d2c97a9dc2e4f":["35,33"],"e4cf8c82e69d5cee54d62b75fe5e4e92":["32,30"],"e6177d'
    '2bcae664a17f90a86aa46bc45f":["32,31"],"ef3ae8b80605064fadc0515b10c82ef2":["30,30","30,31'
    '","30,32","30,33","32,35","33,35","34,35","35,35"]}}'
)
GOLDEN_HASH = "82e7ec580499437e8fe75ddb069753b7"
# Its pyramid, as cells per level and the first cell's hash.
GOLDEN_LOD = {
    1: (9, 30, 30, "94a13e8028cabe288c15da7ee8df0fd8"),
    2: (4, 28, 28, "5b81e55be0ae3dbb7063cd54ce8d8fa4"),
    3: (4, 24, 24, "b64f2159854bb535992ef88452ea5627"),
    4: (4, 16, 16, "868ce1d8b2383070269cc4569212303f"),
    5: (4, 0, 0, "6adba4cc7eb4837f3557d904d4040944"),
    6: (1, 0, 0, "84dba2c5c7de468547f8e943fcf91799"),
}
OCEAN = "ef3ae8b80605064fadc0515b10c82ef2"
OCEAN_MISSING_TOP = "97fea45f33e5a29d7357435351c06b9f"
TILE = "comp_id string, x int, y int, hash string"


def golden(spark):
    docs = spark.createDataFrame([("g", GOLDEN)], "comp_id string, document string")
    return documents.composition_tiles(docs, "document", ["comp_id"])


def composed(tiles):
    rows = compose.compositions(tiles, ["comp_id"]).collect()
    return {r["comp_id"]: r for r in rows}


def plain_hash(tiles, missing=()):
    digest = hashlib.md5()
    for (x, y), h in sorted(tiles.items()):
        digest.update(x.to_bytes(4, "little", signed=True) + y.to_bytes(4, "little", signed=True))
        digest.update(bytes.fromhex(h))
    for x, y in sorted(missing):
        digest.update(x.to_bytes(4, "little", signed=True) + y.to_bytes(4, "little", signed=True))
    return digest.hexdigest()


def plain_lod(tiles, cdn, level):
    side, out = 1 << level, {}
    for ly in range(0, 64, side):
        for lx in range(0, 64, side):
            cells = [(lx + i % side, ly + i // side) for i in range(side * side)]
            if not any(c in tiles for c in cells):
                continue
            digest = hashlib.md5()
            for c in cells:
                h = tiles.get(c)
                digest.update(b"\0" * 16 if h is None else b"g" * 16 if h in cdn else bytes.fromhex(h))
            out[(lx, ly)] = digest.hexdigest()
    return out


def test_golden_composition(spark):
    row = composed(golden(spark))["g"]
    assert row["composition_hash"] == GOLDEN_HASH
    assert (row["tiles"], row["missing"]) == (36, 0)
    assert (row["x0"], row["y0"], row["x1"], row["y1"]) == (30, 30, 35, 35)


def test_golden_pyramid(spark):
    tiles = golden(spark).withColumn("cdn_missing", F.lit(False))
    cells = lod.lod_cells(tiles, ["comp_id"]).collect()
    for level, (count, x, y, want) in GOLDEN_LOD.items():
        of_level = {(c["x"], c["y"]): c["hash"] for c in cells if c["level"] == level}
        assert len(of_level) == count
        assert of_level[(x, y)] == want
    lost = golden(spark).withColumn("cdn_missing", F.col("hash") == OCEAN)
    top = lod.lod_cells(lost, ["comp_id"]).where("level = 6").first()
    assert top["hash"] == OCEAN_MISSING_TOP


def test_document_round_trip(spark):
    tiles = golden(spark).withColumn("tile_size", F.lit(512))
    written = documents.composition_documents(tiles, ["comp_id"]).first()["document"]
    want = json.loads(GOLDEN)
    assert json.loads(written) == {**want, "tileSize": 512}


def test_hash_ignores_arrival_order_and_takes_negatives(spark):
    random.seed(5)
    tiles = {(x, y): hashlib.md5(f"{x}{y}".encode()).hexdigest()
             for x in (-40, -1, 0, 3, 63, 70) for y in (-7, 0, 12, 64)}
    missing = [(5, -5), (-5, 5), (1, 1)]
    rows = [("a", x, y, h) for (x, y), h in tiles.items()] + [("a", x, y, None) for x, y in missing]
    for _ in range(2):
        random.shuffle(rows)
        row = composed(spark.createDataFrame(rows, TILE).repartition(3))["a"]
        assert row["composition_hash"] == plain_hash(tiles, missing)
        assert (row["x0"], row["y0"], row["x1"], row["y1"]) == (-40, -7, 70, 64)


def test_missing_changes_the_hash(spark):
    h = "ab" * 16
    rows = [("a", 1, 1, h), ("b", 1, 1, h), ("b", 2, 2, None), ("c", 2, 2, None)]
    got = composed(spark.createDataFrame(rows, TILE))
    assert len({r["composition_hash"] for r in got.values()}) == 3
    assert got["c"]["tiles"] == 0 and got["c"]["missing"] == 1
    assert got["c"]["composition_hash"] == plain_hash({}, [(2, 2)])


@pytest.mark.parametrize("dense", [False, True])
def test_pyramid_matches_plain_python(spark, dense):
    random.seed(11)
    spots = [(x, y) for x in range(64) for y in range(64)]
    if not dense:
        spots = random.sample(spots, 150)
    tiles = {c: hashlib.md5(str(c).encode()).hexdigest() for c in spots}
    cdn = set(random.sample(sorted(tiles.values()), 20))
    rows = [("a", x, y, h, h in cdn) for (x, y), h in tiles.items()]
    rows += [("a", 64, 0, "00" * 16, False), ("a", -1, 3, "11" * 16, False)]
    df = spark.createDataFrame(rows, TILE + ", cdn_missing boolean")
    cells = lod.lod_cells(df, ["comp_id"]).collect()
    for level in range(1, 7):
        got = {(c["x"], c["y"]): c["hash"] for c in cells if c["level"] == level}
        assert got == plain_lod(tiles, cdn, level)
    parts = lod.lod_components(df, ["comp_id"]).where("level = 2").collect()
    for cell in parts:
        want = [tiles.get((cell["x"] + i % 4, cell["y"] + i // 4)) for i in range(16)]
        assert cell["components"] == want


def test_empty_grid_has_no_pyramid(spark):
    df = spark.createDataFrame([("a", 1, 1, None, False)], TILE + ", cdn_missing boolean")
    assert lod.lod_cells(df, ["comp_id"]).count() == 0


def test_last_writer_of_a_cell_wins(spark):
    rows = [("a", 1, 1, "aa" * 16, 1), ("a", 1, 1, "bb" * 16, 2), ("a", 2, 1, "cc" * 16, 1)]
    df = spark.createDataFrame(rows, TILE + ", n int")
    got = {(r["x"], r["y"]): r["hash"] for r in compose.one_per_cell(df, ["comp_id"], "n").collect()}
    assert got == {(1, 1): "bb" * 16, (2, 1): "cc" * 16}


def test_tile_sizes(spark):
    rows = [("a", 0, 0, "a", False), ("a", 1, 0, "b", False), ("a", 2, 0, "c", True),
            ("b", 0, 0, "c", True), ("c", 0, 0, "a", False)]
    tiles = spark.createDataFrame(rows, TILE + ", cdn_missing boolean")
    sizes = spark.createDataFrame([("a", 256), ("b", 512)], "hash string, tile_size int")
    got = {r["comp_id"]: (r["tile_size"], r["mixed"])
           for r in compose.composition_tile_sizes(tiles, sizes, ["comp_id"]).collect()}
    assert got == {"a": (512, "256px=1, 512px=1"), "b": (512, None), "c": (256, None)}
    with pytest.raises(Exception, match="no size for tile"):
        unknown = spark.createDataFrame([("a", 0, 0, "z", False)], TILE + ", cdn_missing boolean")
        compose.composition_tile_sizes(unknown, sizes, ["comp_id"]).collect()


def test_bad_documents_fail(spark):
    bad = ['{"tiles":{"ef3ae8b80605064fadc0515b10c82ef2":["1"]}}', '{"tiles":{"xyz":["1,2"]}}']
    for text in bad:
        docs = spark.createDataFrame([("a", text)], "comp_id string, document string")
        with pytest.raises(Exception, match="not a co"):
            documents.composition_tiles(docs, "document", ["comp_id"]).collect()
    unsized = golden(spark).withColumn("tile_size", F.lit(None).cast("int"))
    with pytest.raises(Exception, match="needs a tile size"):
        documents.composition_documents(unsized, ["comp_id"]).collect()


def test_updated_pyramids_equal_full_ones(spark):
    """Tiles that come, go, change, turn missing or stay; compositions that are new, gone or the same."""
    rng = random.Random(4)
    schema = "k int, x int, y int, hash string, cdn_missing boolean"
    md5 = lambda n: hashlib.md5(str(n).encode()).hexdigest()
    before, after = [], []
    for k in range(7):
        for at in rng.sample(range(4096), 40):
            row = (k, at % 64, at // 64, md5(rng.randint(0, 99)), rng.random() < 0.1)
            fate = "stay" if k == 0 else rng.choice(["stay"] * 8 + ["go", "change", "missing"])
            if k != 5:
                before.append(row)
            if k == 6 or fate == "go":
                continue
            after.append({"stay": row, "change": (*row[:3], md5("new"), False), "missing": (*row[:4], not row[4])}[fate])
    after += [(1, 63, 63, md5("come"), False), (2, 0, 0, None, False)]
    old, new = spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)
    cells = lod.lod_cells(old, ["k"])
    rows = lambda df: sorted(map(tuple, df.select("k", "level", "x", "y", "hash").collect()))
    assert rows(lod.lod_update(old, cells, new, ["k"])) == rows(lod.lod_cells(new, ["k"]))
    # what is carried over is not hashed again: a mark put on the old cells stays where nothing changed
    marked = cells.withColumn("hash", F.concat(F.lit("old-"), "hash"))
    kept = {r[0] for r in rows(lod.lod_update(old, marked, new, ["k"])) if r[4].startswith("old-")}
    assert 0 in kept and not {5, 6} & kept
    assert all(r[4].startswith("old-") for r in rows(lod.lod_update(old, marked, new, ["k"])) if r[0] == 0)


def test_sizes_of_a_composition_meet_each_content_once(spark):
    """All of a composition's tiles of one content are one row where sizes are looked up."""
    rows = [("a", i % 64, i // 64, "one" if i % 5 else "two", i % 10 == 0) for i in range(4096)]
    tiles = spark.createDataFrame(rows, TILE + ", cdn_missing boolean")
    sizes = spark.createDataFrame([("one", 128), ("two", 256)], "hash string, tile_size int")
    got = lod.lod_tile_sizes(tiles, sizes, ["comp_id"], pieces=3)
    known = {(x, y): {"one": 128, "two": 256}[h] for _, x, y, h, lost in rows if not lost}
    for r in got.collect():
        side = 1 << r["level"]
        within = [known.get((r["x"] + dx, r["y"] + dy), 0) for dx in range(side) for dy in range(side)]
        assert r["tile_size"] == max(64, *within)
    plan = got._jdf.queryExecution().toString()
    join = plan[plan.index("== Optimized Logical Plan =="):plan.index("== Physical Plan ==")]
    assert join.index("Join LeftOuter") < join.index("collect_list(i#")
    assert got.count() == sum(4**level for level in range(6))


def test_digests_tell_components_apart_in_one_layout(spark):
    """A stand-in hides which tile is missing from the hash but not from the digest; nothing is joined or moved."""
    rows = [("a", 0, 0, "11" * 16, True), ("a", 5, 5, "33" * 16, False),
            ("b", 0, 0, "22" * 16, True), ("b", 5, 5, "33" * 16, False),
            ("c", 0, 0, "11" * 16, True), ("c", 5, 5, "33" * 16, False)]
    tiles = spark.createDataFrame(rows, TILE + ", cdn_missing boolean").repartition(4, "comp_id")
    cells = lod.digested_cells(tiles, ["comp_id"], placed=True)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    at = {(r["comp_id"], r["level"], r["x"], r["y"]): (r["hash"], r["digest"]) for r in cells.collect()}
    full = {(r["comp_id"], r["level"], r["x"], r["y"]): r["hash"] for r in lod.lod_cells(tiles, ["comp_id"]).collect()}
    assert {k: v[0] for k, v in at.items()} == full
    assert at["a", 6, 0, 0] == at["c", 6, 0, 0] and at["a", 2, 4, 4] == at["b", 2, 4, 4]
    assert at["a", 6, 0, 0][0] == at["b", 6, 0, 0][0] and at["a", 6, 0, 0][1] != at["b", 6, 0, 0][1]
    clash = {r["hash"] for r in lod.inconsistent_cells(cells, "hash", "digest").collect()}
    assert clash == {full["a", level, 0, 0] for level in range(1, 7)}


def test_histories_equal_full_pyramids_and_join_nothing(spark):
    """Builds that come, change, repeat, lose all tiles and come back; rows look one build back."""
    rng = random.Random(8)
    md5 = lambda n: hashlib.md5(str(n).encode()).hexdigest()
    rows = []
    for m in range(4):
        held = {}
        for b in range(6):
            for at in rng.sample(range(4096), 0 if b % 3 == 2 else 25):
                held[at] = None if rng.random() < 0.1 else md5(rng.randint(0, 50))
            for at in rng.sample(sorted(held), 3):
                del held[at]
            lost = (m, b) == (1, 3)  # listed, but nothing resolves
            rows += [(b, m, at % 64, at // 64, None if lost else h, rng.random() < 0.1) for at, h in held.items()]
    schema = "build_id int, map_id int, x int, y int, hash string, cdn_missing boolean"
    tiles = spark.createDataFrame(rows, schema).repartition(3, "map_id")
    keys = ["build_id", "map_id"]
    got = lod.lod_history(tiles, keys, "build_id", placed=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    cells = lambda df: sorted(map(tuple, df.select(*keys, "level", "x", "y", "hash").collect()))
    assert cells(got) == cells(lod.lod_cells(tiles, keys)) == cells(lod.lod_history(tiles, keys, "build_id"))
