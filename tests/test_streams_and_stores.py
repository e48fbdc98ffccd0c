"""Snapshots, streams and content stores on small files."""

import hashlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from atlasledger import checks
from atlasledger.checks import streams  # noqa: F401  (registers the queries)
from atlasledger.operators.packing import pack_messages
from atlasledger.sources import feeds, store, tables
from atlasledger.plans.scan import ScanFacts
from atlasledger.streaming import catalogue, discovery, event_log, scans
from atlasledger.streaming.catalogue import Catalogue
from atlasledger.streaming.snapshots import Snapshots


def page(version, lines, seqn=1):
    body = [f"{r}|{b}|{c}||{version.split('.')[3]}|{version}|{p}" for r, b, c, p in lines]
    return "\n".join([feeds.FEEDS["versions"][0], f"## seqn = {seqn}", *body])


def land(folder, product, name, text):
    target = folder / f"product={product}"
    target.mkdir(parents=True, exist_ok=True)
    (target / name).write_text(text)


def run(query):
    query.trigger(availableNow=True).start().awaitTermination()


def test_snapshots_ignore_uncommitted_and_repeated(spark, tmp_path):
    snaps = Snapshots(spark, str(tmp_path / "s"))
    assert snaps.newest() is None and snaps.read("t", "a int").count() == 0
    snaps.commit({"t": spark.createDataFrame([(1,)], "a int")}, "w", 0)
    # a batch that wrote its table but never committed
    spark.createDataFrame([(9,)], "a int").write.parquet(str(tmp_path / "s" / "t" / "at=1"))
    assert [r["a"] for r in snaps.read("t", "a int").collect()] == [1]
    snaps.commit({"t": spark.createDataFrame([(2,)], "a int")}, "w", 1)
    snaps.commit({"t": spark.createDataFrame([(3,)], "a int")}, "w", 1)  # a repeat
    assert snaps.newest() == 1
    assert [r["a"] for r in snaps.read("t", "a int").collect()] == [2]


def test_no_commit_is_lost(spark, tmp_path):
    """Other writers, other tables and lower batch numbers all become commits of their own."""
    snaps = Snapshots(spark, str(tmp_path / "s"), kept=3)
    table = lambda n: spark.createDataFrame([(n,)], "a int")
    held = lambda name: [r["a"] for r in snaps.read(name, "a int").collect()]
    assert snaps.commit({"t": table(1)}, "w", 5) == 0
    assert snaps.commit({"u": table(2)}, "w", 6) == 1
    assert held("t") == [1] and held("u") == [2]  # carried over
    assert snaps.commit({"t": table(3)}, "other", 0) == 2
    assert snaps.commit({"t": table(4)}, "w", 0) == 3
    assert snaps.commit({"t": table(9)}, "w", 5) is None
    assert held("t") == [4] and held("u") == [2]
    for n in range(5):
        snaps.commit({"t": table(10 + n)}, "w", 10 + n)
    assert held("t") == [14] and held("u") == [2]
    kept = sorted(p.name for p in (tmp_path / "s" / "t").iterdir())
    assert kept == ["at=6", "at=7", "at=8"]


def test_a_new_checkpoint_location_repeats_nothing(spark, tmp_path):
    landed = tmp_path / "landed"
    snaps = Catalogue(spark, str(tmp_path / "catalogue"))
    for n in range(2):
        land(landed, "game", f"{n}.txt", page(f"11.0.7.5804{n}", [("us", "b", "c", "p")]))
        pages = discovery.landed_pages(spark, str(landed))
        stream = discovery.discovery_stream(pages, snaps, ["game*"], [])
        run(stream.option("checkpointLocation", str(tmp_path / f"cp{n}")))
    assert snaps.read("builds").count() == 2
    assert snaps.begin() == 3  # two ticks, staged and stored


def test_discovery_ticks(spark, tmp_path):
    landed, root = tmp_path / "landed", str(tmp_path / "catalogue")
    snaps = Catalogue(spark, root)

    def tick():
        pages = discovery.landed_pages(spark, str(landed))
        stream = discovery.discovery_stream(pages, snaps, ["game*"], ["game_skip"])
        run(stream.option("checkpointLocation", str(tmp_path / "cp")))

    def products():
        rows = snaps.read("products").collect()
        return {r["product"]: sorted(r["config_regions"]) for r in rows}

    land(landed, "game", "1.txt", page("11.0.7.58046", [("us", "b1", "c1", "p"), ("eu", "b1", "c1", "p")]))
    land(landed, "game_skip", "1.txt", page("11.0.7.58046", [("us", "b1", "c1", "p")]))
    land(landed, "agent", "1.txt", page("1.0.0.1", [("us", "b1", "c1", "p")]))
    tick()
    assert products() == {"game": ["eu", "us"]}
    land(landed, "game", "2.txt", page("11.0.7.58046", [("kr", "b1", "c1", "p"), ("us", "b2", "c1", "p")]))
    tick()
    assert products() == {"game": ["eu", "kr", "us"]}
    sources = snaps.read("product_sources").collect()
    assert {r["config_build"]: sorted(r["config_regions"]) for r in sources} == {"b1": ["kr"], "b2": ["us"]}
    assert {r["first_seen"] for r in sources} == {"batch-0", "batch-1"}
    scans = snaps.read("product_scans").collect()
    assert [r["state"] for r in scans] == ["pending"]
    assert snaps.read("builds").count() == 1


TINY = {
    "rows": catalogue.Table("build_id bigint, v int", catalogue.BY_BUILD),
    "seen": catalogue.Table("hash string", catalogue.BY_HASH),
}


def files(root, name):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in (root / name).rglob("*.parquet")}


def test_a_tick_writes_the_partitions_it_touches(spark, tmp_path):
    store = Catalogue(spark, str(tmp_path), TINY)
    assert store.begin() is None and store.read("rows").count() == 0
    rows = lambda d: spark.createDataFrame(list(d.items()), "build_id bigint, v int")
    hashes = lambda *h: spark.createDataFrame([(x,) for x in h], "hash string")
    store.commit({"rows": rows({b: 0 for b in range(28)} | {None: 5}), "seen": hashes("aa1", "bb1")}, "w", 0, store.begin())
    before = files(tmp_path, "rows") | files(tmp_path, "seen")
    store.commit({"rows": rows({7: 1}), "seen": hashes("bb2")}, "w", 1, store.begin())
    after = files(tmp_path, "rows") | files(tmp_path, "seen")
    gone, new = set(before) - set(after), set(after) - set(before)
    assert [p.split("/")[1] for p in gone] == ["build_id=7"]
    assert sorted(p.split("/")[1] for p in new) == ["build_id=7", "prefix=bb"]
    assert all(before[p] == after[p] for p in set(before) & set(after))
    assert {r["build_id"]: r["v"] for r in store.read("rows").collect()} == {b: int(b == 7) for b in range(28)} | {None: 5}
    assert [r["v"] for r in store.read("rows", [7, None]).orderBy("v").collect()] == [1, 5]
    assert sorted(r["hash"] for r in store.read("seen", prefixes=["bb"]).collect()) == ["bb1", "bb2"]
    assert len(store.read("rows", [7]).inputFiles()) >= 1
    plan = store.read("rows", [7])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "build_id" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_ticks_that_die_race_or_come_again(spark, tmp_path, monkeypatch):
    store = Catalogue(spark, str(tmp_path), TINY)
    rows = lambda v: {"rows": spark.createDataFrame([(1, v)], "build_id bigint, v int")}
    held = lambda: [r["v"] for r in store.read("rows").collect()]
    store.commit(rows(1), "w", 0, store.begin())
    assert store.commit(rows(9), "w", 0, store.begin()) is None and held() == [1]  # a repeat
    since = store.begin()
    store.commit(rows(2), "other", 0, since)
    with pytest.raises(RuntimeError):
        store.commit(rows(3), "w", 1, since)
    assert held() == [2]
    with monkeypatch.context() as patch:  # staged, and dead before it is stored
        patch.setattr(Catalogue, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.commit(rows(4), "w", 2, store.begin())
    assert held() == [2]
    store.begin()
    assert held() == [4] and store.commit(rows(5), "w", 2, store.begin()) is None
    assert not list((tmp_path / "staged").glob("*"))


def test_staged_files_are_moved_and_not_written_again(spark, tmp_path, monkeypatch):
    store = Catalogue(spark, str(tmp_path), TINY)
    rows = lambda v: spark.createDataFrame([(b, v) for b in range(4)] + [(None, v)], "build_id bigint, v int")
    seen = spark.createDataFrame([("aa1",), ("bb1",)], "hash string")
    store.commit({"rows": rows(1)}, "w", 0, store.begin())
    with monkeypatch.context() as patch:
        patch.setattr(Catalogue, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.commit({"rows": rows(2), "seen": seen}, "w", 1, store.begin())
    staged = {p.name for p in (tmp_path / "staged").rglob("*.parquet")}
    # dead again, when some of it was moved
    moved = iter(range(3))
    real = catalogue.replace_folder
    with monkeypatch.context() as patch:
        patch.setattr(catalogue, "replace_folder", lambda *a: (next(moved), real(*a)))
        with pytest.raises(StopIteration):
            store.begin()
    assert store.begin() is not None
    assert {p.name for n in ("rows", "seen") for p in (tmp_path / n).rglob("*.parquet")} == staged
    assert sorted((r["build_id"] is None, r["v"]) for r in store.read("rows").collect()) == [(False, 2)] * 4 + [(True, 2)]
    assert sorted(r["hash"] for r in store.read("seen").collect()) == ["aa1", "bb1"]


def scan_store(spark, root, builds):
    """A catalogue with a queued product for each build, and the facts of those builds."""
    store = Catalogue(spark, root)
    known = spark.createDataFrame([(b, b, "game", "2025") for b in builds], "product_id bigint, build_id bigint, product string, first_seen string")
    queue = known.select("product_id", "build_id", F.lit("pending").alias("state"))
    store.commit({"products": known, "product_scans": queue}, "setup", 0, store.begin())
    h = lambda n: hashlib.md5(str(n).encode()).hexdigest()
    make = spark.createDataFrame
    facts = ScanFacts(
        cells=make([(b, 1, 30, 30 + k, 10 * b + k + 1, 0, 0) for b in builds for k in range(2)] + [(2, 1, 70, 3, 77, 0, 0)] * (2 in builds),
                   "build_id bigint, map_id int, x int, y int, minimap_texture int, map_texture int, root_adt int"),
        file_index=make([(b, 10 * b + k + 1, h(k)) for b in builds for k in range(2)], "build_id bigint, fdid int, ckey string"),
        adt_index=make([], "build_id bigint, fdid int, adt_hash string"),
        overrides=make([], "map_id int, x int, y int, fdid int"),
        cdn_missing=make([(h(1),)], "hash string"),
        sizes=make([(h(0), 512), (h(1), 512)], "hash string, tile_size int"),
        chunks=make([], "adt_hash string, idx int, area_id bigint, impass boolean"),
        areas=make([], "area_id bigint, parent_id bigint, name string"),
    )
    return store, facts, h


def test_a_bad_build_stops_no_other_and_late_tiles_repair(spark, tmp_path):
    store, facts, h = scan_store(spark, str(tmp_path), [1, 2, 3])
    assert scans.scan_tick(store, facts, 2, 3, "now") and not scans.scan_tick(store, facts, 2, 3, "now")
    rows = {r["build_id"]: r for r in store.read("product_scans").collect()}
    assert {b: r["state"] for b, r in rows.items()} == {1: "full_decrypt", 2: "exception", 3: "full_decrypt"}
    assert rows[2]["exception"] == "cell 70,3 of map 1 is outside the grid" and rows[1]["data_version"] == 2
    layers = lambda: {r["build_id"]: r["cdn_missing"] for r in store.read("build_map_layers").collect()}
    assert layers() == {1: [h(1)], 3: [h(1)]}
    # the tile turns up with a fourth build; the first and third are repaired and queued again
    extra = spark.createDataFrame([(4, 4, "game", "2026")], "product_id bigint, build_id bigint, product string, first_seen string")
    queue = extra.select("product_id", "build_id", F.lit("pending").alias("state"))
    store.commit({"products": extra, "product_scans": queue}, "more", 0, store.begin())
    _, now, _ = scan_store(spark, str(tmp_path / "x"), [4])
    now.cdn_missing = now.cdn_missing.limit(0)
    assert scans.scan_tick(store, now, 2, 1, "later")
    assert layers() == {1: None, 3: None, 4: None}
    states = {r["build_id"]: r["state"] for r in store.read("product_scans").collect()}
    assert states == {1: "pending", 2: "exception", 3: "pending", 4: "full_decrypt"}


def test_steps_of_a_tick_read_saved_cells(spark, tmp_path, monkeypatch):
    store, facts, _ = scan_store(spark, str(tmp_path), [1, 3])
    facts.map_locks = spark.createDataFrame([(3, 1, "KEY")], "build_id bigint, map_id int, key_name string")
    read, real = [], scans.layer_tiles
    monkeypatch.setattr(scans, "layer_tiles", lambda mine: (read.append(mine.cells), real(mine))[1])
    assert scans.scan_tick(store, facts, 2, 2, "now")
    plan = read[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "parquet" in plan
    assert {r["build_id"]: r["state"] for r in store.read("product_scans").collect()} == {1: "full_decrypt", 3: "partial_decrypt"}
    assert {r["build_id"] for r in store.read("build_map_layers").collect()} == {1}


def test_known_terrain_is_not_packed_again(spark, tmp_path):
    store, facts, h = scan_store(spark, str(tmp_path), [1, 2])
    make = spark.createDataFrame
    terrain = lambda builds: {
        "cells": make([(b, 1, 30, 30 + k, 10 * b + k + 1, 0, 5 + k) for b in builds for k in range(2)],
                      "build_id bigint, map_id int, x int, y int, minimap_texture int, map_texture int, root_adt int"),
        "adt_index": make([(b, 5 + k, h(f"adt{k}")) for b in builds for k in range(2)], "build_id bigint, fdid int, adt_hash string"),
    }
    facts = replace(
        facts,
        chunks=make([(h("adt0"), 3, 7, True), (h("adt1"), 4, 8, False)], "adt_hash string, idx int, area_id bigint, impass boolean"),
        areas=make([(7, 0, "seven"), (8, 7, "eight")], "area_id bigint, parent_id bigint, name string"),
        **terrain([1, 2]),
    )
    assert scans.scan_tick(store, facts, 2, 1, "now")
    held = files(tmp_path, "extractions")
    assert store.read("extractions").count() == 2
    # without any chunk at hand: the second build lists the same terrain
    assert scans.scan_tick(store, replace(facts, chunks=facts.chunks.limit(0)), 2, 1, "now")
    assert files(tmp_path, "extractions") == held
    data = {(r["build_id"], r["layer_type"]): r["data_hash"] for r in store.read("build_map_layers").where("data_hash is not null").collect()}
    assert set(data) == {(b, t) for b in (1, 2) for t in (3, 4)} and data[1, 4] == data[2, 4] and data[1, 3] == data[2, 3]
    # a build with both data layers makes none again, and keeps them
    queue = store.read("product_scans").withColumn("state", F.lit("pending"))
    store.commit({"product_scans": queue}, "again", 0, store.begin())
    broken = replace(facts, chunks=facts.chunks.withColumn("area_id", F.raise_error(F.lit("read")).cast("bigint")))
    assert scans.scan_tick(store, broken, 3, 2, "now")
    after = {(r["build_id"], r["layer_type"]): r["data_hash"] for r in store.read("build_map_layers").where("data_hash is not null").collect()}
    assert after == data


def test_products_are_followed_by_the_summary(spark):
    rows = spark.createDataFrame([("a", 3, "x"), ("b", 4, "x"), ("c", 5, "x")], "product string, seqn int, v string")
    summary = spark.createDataFrame([("a", 3, ""), ("b", 9, ""), ("c", 5, "cdn"), ("d", 1, "")], "name string, product_seqn int, flags string")
    kept, off = discovery.followed(rows, summary, ["*"])
    assert sorted(r["product"] for r in kept.collect()) == ["a", "b"]
    assert [(r["name"], r["product_seqn"], r["page_seqn"]) for r in off.collect()] == [("b", 9, 4)]


@pytest.mark.parametrize("hot", [1_000_000, 5])
def test_event_log_stream_continues_open_batches(spark, tmp_path, hot):
    rows = [(k, i, "x" * (37 * (i + (k or 7)) % 700)) for k in (1, None) for i in range(40)]
    rows += [(9, i, "y" * (31 * i % 90)) for i in range(900)]  # several pieces in every tick where 5 rows are hot
    rows += [(3, 16, None), (3, 17, ""), (3, 18, "z" * 5000), (3, 19, "z")]
    log = spark.createDataFrame(rows, "k bigint, seq bigint, msg string")
    source, root = str(tmp_path / "in"), str(tmp_path / "log")
    spark.conf.set("spark.atlasledger.hotKeyRows", str(hot))
    try:
        for low, high in ((0, 15), (15, 29), (29, 9999)):
            log.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(source)
            stream = event_log.pack_stream(spark.readStream.schema(log.schema).parquet(source), "k", "seq", "msg", root, buckets=3)
            run(stream.option("checkpointLocation", str(tmp_path / "cp")))
    finally:
        spark.conf.unset("spark.atlasledger.hotKeyRows")
    got = event_log.packed_log(spark, root, "k", "seq", dict(log.dtypes)).collect()
    batch = pack_messages(log, ["k"], ["seq"], "msg").collect()
    key = lambda r: (str(r["k"]), r["seq"], r["length"], r["batch_no"])
    assert sorted(map(key, got)) == sorted(map(key, batch))


def test_event_log_stream_reads_a_table_of_one_or_many_files(spark, tmp_path):
    """A table that is a folder of files was not found; no message at all is an empty log."""
    rows = [(k, t, "user", "m" * (300 * t + k % 7)) for k in (1, 2**60 + 1) for t in range(9)] + [(None, 0, "user", "x")]
    log = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = sorted(map(str, pack_messages(log, ["conv_id"], ["turn"], "text").collect()))
    many = tmp_path / "many"
    log.repartition(3).write.parquet(str(many / "conversations.parquet"))
    log.coalesce(1).write.parquet(str(tmp_path / "one" / "folder"))
    (file,) = (tmp_path / "one" / "folder").glob("*.parquet")
    file.rename(tmp_path / "one" / "conversations.parquet")
    for place in (many, tmp_path / "one"):
        got = checks.QUERIES["event_log_stream"](spark, str(place))
        assert sorted(map(str, got.select("conv_id", "turn", "length", "batch_no").collect())) == want
    assert event_log.packed_log(spark, str(tmp_path / "none"), "conv_id", "turn", dict(log.dtypes)).isEmpty()


def test_short_sequences_share_a_call(spark):
    """A call into Python a conversation took most of the time; its plan groups nothing there now."""
    log = spark.range(50).selectExpr("id % 7 k", "id seq", "repeat('x', CAST(id * 41 % 900 AS INT)) msg")
    packed = pack_messages(log, ["k"], ["seq"], "msg")
    assert "FlatMapGroups" not in packed._jdf.queryExecution().toString()


def test_event_log_tick_is_stored_once(spark, tmp_path):
    log = spark.createDataFrame([(1, i, "x" * 600) for i in range(10)], "k bigint, seq bigint, msg string")
    source, root = str(tmp_path / "in"), str(tmp_path / "log")
    log.coalesce(1).write.parquet(source)
    ticks = []
    writer = event_log.pack_stream(spark.readStream.schema(log.schema).parquet(source), "k", "seq", "msg", root)

    def twice(batch, batch_id):
        for _ in range(2):
            event_log.pack_tick(batch, batch_id, "k", "seq", "msg", root)
        ticks.append(batch_id)

    run(writer.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "cp")))
    got = event_log.packed_log(spark, root, "k", "seq", dict(log.dtypes)).collect()
    assert ticks == [0] and sorted((r["seq"], r["batch_no"]) for r in got) == [(i, i // 3) for i in range(10)]


def test_content_store(spark, tmp_path):
    root = str(tmp_path / "store")
    h1, h2 = hashlib.md5(b"1").hexdigest(), hashlib.md5(b"2").hexdigest()
    saves = spark.createDataFrame(
        [(h1, 1, bytearray(b"old"), "image/png"), (h1, 2, bytearray(b"new"), "image/webp"),
         (h2, 1, bytearray(b"x"), "image/avif")],
        "hash string, saved_at int, content binary, media_type string",
    )
    store.write_store(saves, root)
    got = {r["hash"]: (bytes(r["content"]), r["ending"]) for r in store.read_store(spark, root).collect()}
    assert got == {h1: (b"new", ".webp"), h2: (b"x", ".avif")}
    plan = store.read_store(spark, root).where(F.col("prefix") == h1[:2])
    assert {r["hash"] for r in plan.collect()} == {h1}
    with pytest.raises(Exception, match="unsupported media type"):
        store.write_store(saves.withColumn("media_type", F.lit("text/plain")), str(tmp_path / "bad"))


def test_store_listing_takes_the_hash_from_the_file_name(spark, tmp_path):
    h = hashlib.md5(b"tile").hexdigest()
    (tmp_path / h[:2]).mkdir()
    (tmp_path / h[:2] / f"{h}.webp").write_bytes(b"tile")
    (tmp_path / h[:2] / "notes.txt").write_bytes(b"?")
    rows = store.scan_store(spark, str(tmp_path)).collect()
    assert [(r["hash"], r["length"]) for r in rows] == [(h, 4)]


def test_blob_tables_are_compressed_at_rest(spark, tmp_path):
    blobs = spark.range(50).select(
        F.md5(F.col("id").cast("string").cast("binary")).alias("hash"),
        F.repeat(F.lit("area "), 20000).cast("binary").alias("data"),
    )
    tables.write_table(blobs, str(tmp_path), "data_blobs")
    stored = sum(f.stat().st_size for f in (tmp_path / "data_blobs").glob("*.parquet"))
    assert stored < 50 * 100000 * 0.05
    assert tables.read_table(spark, str(tmp_path), "data_blobs").count() == 50
