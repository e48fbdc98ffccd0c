"""Invariants and edge cases of the other operators, against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from atlasledger.functions.versions import encode_version
from atlasledger.operators import areas, chunks, diff, history, merge, packing, terrain, viewport
from atlasledger.operators.ordered import HOT_SETTING
from atlasledger.plans import scan
from atlasledger.sources import feeds, grids


@pytest.fixture
def hot(spark):
    """Lower the hot-key limit so that every key counts as hot."""
    spark.conf.set(HOT_SETTING, "5")
    yield
    spark.conf.unset(HOT_SETTING)


def names(spark, rows):
    return spark.createDataFrame(rows, "map_id int, build_id bigint, name string")


def histories(df):
    rows = history.name_histories(history.name_changes(df)).collect()
    return {r["map_id"]: dict(r["name_history"]) for r in rows}


def test_name_history_does_not_depend_on_arrival(spark):
    facts = [(7, 1, "A"), (7, 3, "A"), (7, 2, "B"), (7, 4, None), (7, 5, "A")]
    for _ in range(3):
        random.shuffle(facts)
        assert histories(names(spark, facts)) == {7: {1: "A", 2: "B", 3: "A"}}


def plain_changes(facts):
    out, last = [], {}
    for m, b, n in sorted(facts):
        if last.get(m) != n:
            out.append((m, b, n))
        last[m] = n
    return out


def test_name_changes_and_groups_on_hot_keys(spark, hot):
    random.seed(3)
    facts = [(i % 2 if i % 3 else 0, i, random.choice("AB")) for i in range(300)]
    got = sorted(tuple(r) for r in history.name_changes(names(spark, facts)).collect())
    assert got == plain_changes(facts)
    grouped = history.version_groups(names(spark, facts), ["map_id"], "name")
    firsts = sorted((r["map_id"], r["build_id"]) for r in grouped.where("first_of_group").collect())
    assert firsts == [(m, b) for m, b, _ in plain_changes(facts)]
    assert grouped.agg(F.max("group_no")).first()[0] == max(
        sum(1 for c in plain_changes(facts) if c[0] == m) for m in (0, 1)
    )


def plain_nearest(asked, versions):
    return min(versions, key=lambda v: (abs(v - asked), v), default=None)


@pytest.mark.parametrize("limit", ["5", "1000000"])
def test_nearest_build(spark, limit):
    random.seed(4)
    versions = sorted(random.sample(range(0, 2**40, 2), 60)) + [2**62, 2**62 + 2]
    asked = [v + d for v in versions for d in (-1, 0, 1)] + [2**62 + 1]
    v = spark.createDataFrame([(1, b) for b in versions], "map_id int, build_id bigint")
    r = spark.createDataFrame([(1, a) for a in asked] + [(2, 5)], "map_id int, requested bigint")
    spark.conf.set(HOT_SETTING, limit)
    try:
        rows = history.nearest_build(r, v).collect()
    finally:
        spark.conf.unset(HOT_SETTING)
    assert len(rows) == len(asked) + 1
    for row in rows:
        want = plain_nearest(row["requested"], versions) if row["map_id"] == 1 else None
        assert row["build_id"] == want
        if want is not None:
            assert row["is_fallback"] == (want != row["requested"])


def test_alias_ranges(spark):
    changes = names(spark, [(1, 1, "A"), (1, 2, "B"), (1, 5, "A"), (1, 9, "C")])
    present = spark.createDataFrame([(1, "C")], "map_id int, name string")
    got = sorted((r["alias"], r["since"], r["until"]) for r in history.alias_ranges(changes, present).collect())
    assert got == [("A", 1, 2), ("A", 5, 9), ("B", 2, 5)]


def test_composition_diff(spark):
    schema = "m int, x int, y int, hash string"
    old = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 0, 2, "c"), (1, 9, 9, None)], schema)
    new = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "z"), (1, 0, 3, "d"), (1, 0, 2, None)], schema)
    got = {(r["x"], r["y"]): r["change"] for r in diff.composition_diff(old, new, ["m"]).collect()}
    assert got == {(0, 1): "modified", (0, 2): "removed", (0, 3): "added"}


def test_closure_with_cycles_and_unknown_parents(spark):
    parents = [(1, 2), (2, 3), (3, 1), (10, 11), (11, 99), (20, 0)] + [(i, i + 1) for i in range(100, 180)]
    table = spark.createDataFrame(parents, "area_id bigint, parent_id bigint")
    asked = spark.createDataFrame([("a", 1), ("b", 10), ("c", 20), ("d", 100), ("e", 55)], "k string, area_id bigint")
    got = {}
    for row in areas.ancestor_closure(asked, table, ["k"]).collect():
        got.setdefault(row["k"], set()).add(row["area_id"])
    assert got == {"a": {1, 2, 3}, "b": {10, 11, 99}, "c": {20}, "d": set(range(100, 181)), "e": {55}}


def test_closure_of_a_shallow_table(spark):
    parents = [(1, 2), (2, 3), (3, 1), (10, 11), (11, 99), (20, 0), (30, 20), (31, 30)]
    table = spark.createDataFrame(parents, "area_id bigint, parent_id bigint")
    asked = spark.createDataFrame([(1,), (10,), (31,), (55,)], "area_id bigint")
    got = {r["area_id"] for r in areas.ancestor_closure(asked, table, []).collect()}
    assert got == {1, 2, 3, 10, 11, 99, 20, 30, 31, 55}
    nothing = spark.createDataFrame([(20, 0)], "area_id bigint, parent_id bigint")
    assert {r["area_id"] for r in areas.ancestor_closure(asked, nothing, []).collect()} == {1, 10, 31, 55}


def test_zone_tree(spark):
    rows = [(1, 0, "B"), (2, 1, "C"), (3, 1, "A"), (4, 3, "X"), (5, 0, "A"), (6, 7, "L"), (7, 6, "M"), (8, 99, "Z")]
    table = spark.createDataFrame(rows, "area_id bigint, parent_id bigint, name string")
    out = areas.zone_tree(table, []).orderBy("path").collect()
    got = [(r["area_id"], r["depth"], r["is_last"], r["has_children"]) for r in out]
    assert got == [
        (5, 0, False, False), (1, 0, False, True), (3, 1, False, True), (4, 2, True, False),
        (2, 1, True, False), (8, 0, True, False),
    ]


def plain_batches(lengths, cap):
    fill, batch, out = 0, 0, []
    for n in lengths:
        if fill > 0 and fill + n + 1 > cap:
            batch, fill = batch + 1, 0
        fill = fill + 1 + n if fill > 0 else n
        out.append(batch)
    return out


@pytest.mark.parametrize("limit", ["20", "1000000"])
def test_packing_one_hot_key(spark, limit):
    random.seed(8)
    lengths = [random.choice([0, 1, 5, 17, 60, 99, 130]) for _ in range(400)]
    rows = [(1, i, "x" * n) for i, n in enumerate(lengths)] + [(2, 0, "y" * 500), (2, 1, "z")]
    rows += [(None, i, "x" * n if n else None) for i, n in enumerate(lengths)]
    log = spark.createDataFrame(rows, "k int, seq bigint, msg string")
    spark.conf.set(HOT_SETTING, limit)
    try:
        packed = packing.pack_messages(log, ["k"], ["seq"], "msg", cap=100).orderBy("k", "seq").collect()
    finally:
        spark.conf.unset(HOT_SETTING)
    assert [r["batch_no"] for r in packed if r["k"] == 1] == plain_batches(lengths, 100)
    assert [r["batch_no"] for r in packed if r["k"] == 2] == [0, 1]
    assert [r["batch_no"] for r in packed if r["k"] is None] == plain_batches(lengths, 100)


def test_chunk_bits_and_borders(spark):
    random.seed(9)
    held = {(x, y, i): random.random() < 0.4 for x in (3, 4) for y in (7, 8) for i in range(256)}
    rows = [(1, x, y, i, i % 7, f) for (x, y, i), f in held.items()] + [(1, 3, 7, 300, 1, True)]
    df = spark.createDataFrame(rows, "map_id int, x int, y int, idx bigint, area_id bigint, impass boolean")
    keys = ["map_id", "x", "y"]
    bits = chunks.impass_bitsets(df, keys)
    for row in bits.collect():
        raw = bytes.fromhex(row["bits"])
        for i in range(256):
            assert bool(raw[i // 8] >> (i % 8) & 1) == held[(row["x"], row["y"], i)]
    back = {(r["x"], r["y"], r["idx"]) for r in chunks.chunks_of_bitsets(bits, keys).collect()}
    assert back == {k for k, f in held.items() if f}

    flagged = {(x * 16 + i % 16, y * 16 + i // 16) for (x, y, i), f in held.items() if f}
    inside = df.where("idx < 256")
    for row in chunks.impass_borders(inside, ["map_id"]).collect():
        gx, gy = row["gx"], row["gy"]
        want = 1 | 2 * ((gx + 1, gy) in flagged) | 4 * ((gx, gy + 1) in flagged)
        want |= 8 * ((gx - 1, gy) in flagged) | 16 * ((gx, gy - 1) in flagged)
        assert row["bits"] == want


def test_grid_round_trip(spark):
    random.seed(10)
    cells = [(1, random.randrange(64), random.randrange(64), *[random.randrange(2**32) for _ in range(8)])
             for _ in range(50)]
    cells = list({c[1:3]: c for c in cells}.values())
    schema = "g int, x int, y int, " + ", ".join(f"{n} bigint" for n in grids.CELL_FIELDS)
    packed = grids.pack_grid(spark.createDataFrame(cells, schema), ["g"])
    assert len(packed.first()["payload"]) == 4096 * 32
    back = sorted(tuple(r) for r in grids.unpack_grid(packed, "payload").collect())
    assert back == sorted(cells)


def test_grids_that_end_early_or_lie_by_map(spark, sf):
    """A payload that ends within a cell reads as far as it goes; placed cells are packed where they are."""
    payload = bytes(range(1, 46))
    got = grids.unpack_grid(spark.createDataFrame([(1, payload)], "g int, payload binary"), "payload")
    rows = {(r["x"], r["y"]): [r[n] for n in grids.CELL_FIELDS] for r in got.collect()}
    words = [int.from_bytes(payload[i : i + 4], "little") for i in range(0, 45, 4)]
    assert rows[0, 0] == words[:8] and rows[1, 0] == [*words[8:12], None, None, None, None]
    assert len(rows) == 4096 and rows[2, 0] == rows[9, 9] == [None] * 8
    empty = spark.createDataFrame([(1, bytes(4096 * 32))], "g int, payload binary")
    assert grids.unpack_grid(empty, "payload").count() == 0
    plan = contract.queries()["grid_unpack"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(map_id" in plan and "hashpartitioning(build_id" not in plan


def test_viewport_tiles_match_brute_force(spark):
    random.seed(12)
    views = [(i, 1, random.uniform(-5, 70), random.uniform(-5, 70), random.uniform(0.5, 40), 2048, 1024)
             for i in range(30)]
    cells = [(1, level, x, y, f"{level}{x}{y}") for level in range(7)
             for x in range(0, 64, 1 << level) for y in range(0, 64, 1 << level)]
    v = spark.createDataFrame(views, "view_id int, map_id int, center_x double, center_y double, zoom double, width int, height int")
    c = spark.createDataFrame(cells, "map_id int, level int, x int, y int, hash string")
    seen = viewport.with_view(v, F.lit(512))
    got = {(r["view_id"], r["x"], r["y"]) for r in viewport.visible_tiles(seen, c).collect()}
    want = set()
    for r in seen.collect():
        size = 1 << r["level"]
        for _, level, x, y, _ in cells:
            if level == r["level"] and not (
                x + size <= r["min_x"] or x >= r["max_x"] or y + size <= r["min_y"] or y >= r["max_y"]
            ):
                want.add((r["view_id"], x, y))
    assert got == want
    order = viewport.load_order(viewport.visible_tiles(seen, c), 3)
    assert order.groupBy("view_id").count().agg(F.max("count")).first()[0] == 3


def test_terrain_layout(spark):
    heights = [float(i) for i in range(145)]
    df = spark.createDataFrame([("t", 0, 0, 10.0, heights), ("t", 1, 0, 20.0, heights)],
                               "tile string, index_x int, index_y int, position_z double, heights array<double>")
    cells = {(r["px"], r["py"]): r["height"] for r in terrain.height_cells(df, ["tile"]).collect()}
    assert cells[(0, 0)] == 10.0 and cells[(0, 1)] == 19.0 and cells[(0, 2)] == 27.0
    assert cells[(8, 0)] == 20.0  # the later chunk owns the shared border
    stats = terrain.height_stats(df, ["tile"]).first()
    assert (stats["min_height"], stats["max_height"], stats["heights"]) == (10.0, 164.0, 290)
    grey = terrain.grey(F.col("h"), F.lit(5.0), F.lit(5.0))
    assert spark.range(1).select(F.lit(5.0).alias("h")).select(grey).first()[0] == 128


def test_feed_errors(spark):
    head = feeds.FEEDS["summary"][0]
    good = f"{head}\n## seqn = 42\ngame|41|\ngame|40|cdn\nagent|7\n"
    rows = feeds.parse_feed(spark.createDataFrame([(good,)], "document string"), "summary").collect()
    assert [(r["seqn"], r["name"], r["product_seqn"], r["flags"]) for r in rows] == [
        (42, "game", 41, ""), (42, "game", 40, "cdn"), (42, "agent", 7, ""),
    ]
    bad = {
        "unexpected feed header": f"x{head}\n## seqn = 1\na|1|",
        "missing sequence line": f"{head}\na|1|",
        "unexpected # line": f"{head}\n## seqn = 1\n# no|1|",
    }
    for problem, text in bad.items():
        with pytest.raises(Exception, match=problem):
            feeds.parse_feed(spark.createDataFrame([(text,)], "document string"), "summary").collect()


def test_path_and_key_lists(spark):
    lines = [(0, "1;World/A.wdt"), (1, ""), (2, "x;y"), (3, "7"), (4, "2; world/a.wdt "), (5, "4294967296;b")]
    df = spark.createDataFrame(lines, "line_no bigint, line string")
    assert [tuple(r) for r in feeds.parse_path_list(df).collect()] == [("world/a.wdt", 2)]
    key = "0123456789abcdef " + "AB" * 16 + " tail"
    row = feeds.parse_key_list(spark.createDataFrame([(key,)], "line string")).first()
    assert tuple(row) == ("0123456789ABCDEF", "ab" * 16)
    with pytest.raises(Exception, match="not a key line"):
        feeds.parse_key_list(spark.createDataFrame([("short",)], "line string")).collect()


def test_key_list_has_a_row_per_page(spark, tmp_path):
    """Pages of one address give lines of one key name; none is paired with another's."""
    from atlasledger import checks
    from atlasledger.checks import ingest  # noqa: F401  (registers the query)

    pages = [(1, "u", "a"), (2, "u", "b"), (3, "v", "a"), (4, "u", "a")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = checks.QUERIES["key_list"](spark, str(tmp_path)).collect()
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    want = [(i, md5(u)[:16].upper(), md5(h)) for i, u, h in pages]
    assert sorted((r["page_id"], r["key_name"], r["key_hex"]) for r in got) == want


def test_merges(spark):
    old = spark.createDataFrame([(1, "p", ["eu"])], "build_id int, product string, config_regions array<string>")
    new = spark.createDataFrame([(1, "p", ["eu"]), (2, "p", ["us", "eu"])], old.schema)
    got = {r["build_id"]: r for r in merge.merge_products(old, new).collect()}
    assert not got[1]["processed"] and got[1]["config_regions"] == ["eu"]
    assert got[2]["processed"] and got[2]["config_regions"] == ["eu", "us"]

    layer = "build_id int, map_id int, layer_type int, composition_hash string, data_hash string, cdn_missing array<string>"
    layers = spark.createDataFrame([(1, 1, 0, "a", None, ["h1", "h2"]), (2, 1, 0, "b", None, ["h1"]), (3, 1, 0, "c", None, None)], layer)
    swept = {r["build_id"]: (r["cdn_missing"], r["swept"]) for r in merge.sweep(
        layers, spark.createDataFrame([("h1",)], "hash string")).collect()}
    assert swept == {1: (["h2"], True), 2: (None, True), 3: (None, False)}


def test_malformed_version_fails_the_tick(spark):
    df = spark.createDataFrame([("1.2.3",)], "version string")
    with pytest.raises(Exception, match="not a build version"):
        df.select(encode_version(F.col("version"))).collect()


def test_builds_with_equal_terrain_and_different_area_tables(spark):
    """Each build's area document embeds the build's own area rows and parents."""
    builds = [1, 2, 3, 4]
    row = "build_id long, area_id long, parent_id long, name string"
    shared = [(b, 7, 9 if b == 2 else 8, "seven") for b in builds[:3]]
    names = [(b, a, 0, n) for b in builds[:3] for a, n in ((8, "eight"), (9, "nine"))]

    def scanned(areas):
        facts = scan.ScanFacts(
            cells=spark.createDataFrame(
                [(b, 0, 1, 1, 0, 0, 5) for b in builds],
                "build_id long, map_id int, x int, y int, minimap_texture long, map_texture long, root_adt long",
            ),
            file_index=spark.createDataFrame([], "build_id long, fdid long, ckey string"),
            adt_index=spark.createDataFrame(
                [(b, 5, "0" * 32) for b in builds], "build_id long, fdid long, adt_hash string"
            ),
            overrides=spark.createDataFrame([], "map_id int, x int, y int, fdid long"),
            cdn_missing=spark.createDataFrame([], "hash string"),
            sizes=spark.createDataFrame([], "hash string, tile_size int"),
            chunks=spark.createDataFrame(
                [("0" * 32, i, 7, i == 3) for i in range(256)],
                "adt_hash string, idx int, area_id long, impass boolean",
            ),
            areas=areas,
        )
        out = {}
        for r in scan.data_layers(facts).collect():
            assert out.setdefault((r.build_id, r.layer_type), r.data_hash) == r.data_hash
        return out

    got = scanned(spark.createDataFrame(shared + names, row))
    assert sorted(got) == [(b, t) for b in builds for t in (3, 4)]
    assert len({got[b, 3] for b in builds}) == 1
    assert got[1, 4] == got[3, 4]
    assert len({got[1, 4], got[2, 4], got[4, 4]}) == 3
    # as if each build had been scanned by itself, with its own table for all
    for b in builds:
        own = [r for r in shared + names if r[0] == b]
        alone = scanned(spark.createDataFrame(own, row).drop("build_id"))
        assert alone[b, 4] == got[b, 4]


def test_data_documents_move_their_tiles_once(spark):
    """Both documents of a map come from one shuffle of its tiles, and are those of the operators apart."""
    rows = [(m, 30 + t, 31, i, a, i % 2 == t) for m in (1, 2) for t in range(3) for i, a in ((0, 4 * m), (7, 0), (255, 5))]
    rows.append((3, 1, 2, 9, 0, False))  # no flag and no area
    facts = spark.createDataFrame(rows, "m int, x int, y int, idx int, area_id bigint, impass boolean")
    table = spark.createDataFrame([(4, 2, 'a"b'), (8, 4, "c"), (5, 2, None), (2, 0, "root")], "area_id bigint, parent_id bigint, name string")
    parents, fields = table.select("area_id", "parent_id"), table.select("area_id", "name")
    packed = chunks.extractions(facts, ["m", "x", "y"])
    grids = packed.withColumn("owned", F.array_distinct("area_ids"))
    made = chunks.data_documents(grids, fields, ["m"], lambda a: areas.ancestor_closure(a, parents, ["m"], placed=True))
    got = {r["m"]: (r["flags"], r["area"]) for r in made.collect()}
    closure = areas.ancestor_closure(chunks.referenced_areas(facts, ["m"]), parents, ["m"])
    flags = {r["m"]: r["document"] for r in chunks.impass_documents(packed, ["m"]).collect()}
    area = {r["m"]: r["document"] for r in chunks.area_documents(packed, closure, fields, ["m"]).collect()}
    assert got == {m: (flags.get(m), area.get(m)) for m in (1, 2, 3)}
    executed = made._jdf.queryExecution().executedPlan()
    executed.executeCollectPublic()
    assert "ReusedExchange" in executed.toString()


def test_outcomes_are_recorded_in_one_pass(spark):
    """One pass over the scan rows says what results and failures said in joins of their own."""
    columns = (
        "product_id bigint, state string, last_scanned string, scan_ms bigint, exception string, encrypted_key string, "
        "encrypted_maps string, data_version int, data_version_attempt int, data_version_error string"
    )
    states = ["pending", "full_decrypt", "encrypted_build"]
    rows = [(i, states[i % 3], "old", 1, "was", "k0", "m0", 1, 1, "e0") for i in range(15)]
    held = spark.createDataFrame(rows, columns)
    kinds = ["full_decrypt", "encrypted_build", "partial_decrypt", None, None]
    news = [(i, kinds[i // 3], "now", None, "k", "m", "bad" if i // 3 == 3 else None) for i in range(15)]
    told = spark.createDataFrame(news, "product_id bigint, new_state string, finished string, took_ms bigint, key string, key_maps string, error string")
    got = merge.record_outcomes(held.join(told, "product_id"), 7).select(*held.columns)
    after = merge.record_results(held, told.where("error is null").drop("error"), 7).join(held.select("product_id", "exception"), "product_id")
    failed = merge.record_failures(after, told.where("error is not null").select("product_id", "error", "finished"), 7)
    rest = after.select("product_id", "scan_ms", "encrypted_key", "encrypted_maps", "data_version")
    want = failed.join(rest, "product_id").select(*held.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
