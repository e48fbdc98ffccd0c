"""Codecs, hashes, labels and coordinates, table-driven."""

import pytest
from pyspark.sql import functions as F

from atlasledger.functions import coords, hashes, labels, versions

VERSIONS = {
    "2047.1023.1023.12345678": 9223372032572154190,
    "11.0.7.58046": 49539625965904574,
    "10.2.7.54577": 45044822431552817,
    "9.1.5.40196": 40536816167722244,
    "1.15.4.54590": 4569587504960830,
    "9.0.1.33978": 40532400941335738,
    "4.0.0.0": 18014398509481984,
}
INVALID = ["", "11.0.7", "11.0.7.58046.1", "invalid.version", "2048.1024.1024.12345678",
           "-1.1.1.12345678", "1.2.3.4294967296", "1.2.3.x", None]


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("r")).first()["r"]


def test_versions_round_trip_and_order(spark):
    df = spark.createDataFrame(list(VERSIONS.items()), "t string, want bigint")
    df = df.withColumn("code", versions.encode_version(F.col("t")))
    rows = df.withColumn("again", versions.decode_version(F.col("code"))).collect()
    for row in rows:
        assert row["code"] == row["want"] == versions.version_number(row["t"])
        assert row["again"] == row["t"]
    ordered = [r["t"] for r in df.orderBy("code").collect()]
    assert ordered == sorted(VERSIONS, key=lambda v: [int(p) for p in v.split(".")])


def test_invalid_versions(spark):
    df = spark.createDataFrame([(v,) for v in INVALID], "t string")
    assert df.where(versions.is_version(F.col("t"))).count() == 0
    assert df.where(versions.try_encode_version(F.col("t")).isNotNull()).count() == 0
    for bad in INVALID:
        with pytest.raises(Exception, match="not a build version"):
            spark.createDataFrame([(bad,)], "t string").select(
                versions.encode_version(F.col("t"))
            ).collect()
    with pytest.raises(Exception, match="never negative"):
        one(spark, versions.decode_version(F.col("c")), c=-5)


def test_sql_functions(spark):
    versions.register_sql(spark)
    row = spark.sql("SELECT encode_build_version('11.0.7.58046') a, decode_build_version(49539625965904574L) b")
    assert tuple(row.first()) == (49539625965904574, "11.0.7.58046")


def test_hashes(spark):
    good = "A" * 32
    assert one(spark, hashes.parse_hash(F.col("h")), h=good) == "a" * 32
    for bad in ("", "a" * 31, "a" * 33, "g" * 32):
        assert one(spark, hashes.try_hash(F.col("h")), h=bad) is None
        with pytest.raises(Exception, match="not a content hash"):
            one(spark, hashes.parse_hash(F.col("h")), h=bad)
    assert one(spark, hashes.content_hash(F.col("t")), t="") == "d41d8cd98f00b204e9800998ecf8427e"


def test_hash_order_is_by_little_endian_halves(spark):
    values = ["01" + "00" * 15, "0001" + "00" * 14, "00" * 8 + "ff" * 8, "ff" * 16, "00" * 16]
    df = spark.createDataFrame([(v,) for v in values], "h string")
    got = [r["h"] for r in df.orderBy(hashes.hash_sort_key(F.col("h"))).collect()]

    def halves(h):
        raw = bytes.fromhex(h)
        return (int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:], "little"))

    assert got == sorted(values, key=halves)


@pytest.mark.parametrize("n", [0, 1, 63, 255, 256, 65536, 2**31 - 1, -1, -32, -(2**31)])
def test_le32(spark, n):
    want = (n & 0xFFFFFFFF).to_bytes(4, "little").hex()
    assert one(spark, hashes.le32_hex(F.col("n")), n=n) == want
    pair = one(spark, hashes.le32_pair_hex(F.col("n"), F.lit(7)), n=n)
    assert pair.lower() == want + (7).to_bytes(4, "little").hex()
    assert one(spark, hashes.le32_number(F.col("t"), 1), t=want) == n & 0xFFFFFFFF


def test_media_types(spark):
    cases = [
        (b"RIFF1234WEBPx", "image/webp"),
        (b"0000ftypavif", "image/avif"),
        (b"0000ftyp", "application/octet-stream"),
        (b"", "application/octet-stream"),
    ]
    df = spark.createDataFrame([(bytearray(c), w) for c, w in cases], "c binary, w string")
    assert df.where(hashes.media_type(F.col("c")) != F.col("w")).count() == 0


def test_wildcards(spark):
    def hit(text, pattern):
        return one(spark, labels.matches_any(F.col("t"), [pattern]), t=text)

    assert hit("game_beta", "GAME*") and hit("game", "g?me") and hit("a.b", "a.b")
    assert not hit("axb", "a.b") and not hit("xgame", "game*") and not hit("game", "g?")


def test_zone_label(spark):
    def label(name, internal, same):
        return one(
            spark,
            labels.zone_label(F.col("n"), F.col("i"), F.lit(7), F.col("s")),
            n=name, i=internal, s=same,
        )

    assert label("North's End", "NorthsEnd", 1) is None
    assert label("North's End", "NorthsEnd", 2) == "(7)"
    assert label("The Sea", "OpenWater", 1) == "OpenWater"
    assert label("The Sea", "OpenWater", 3) == "OpenWater (7)"
    assert label("The Sea", "", 3) is None and label("The Sea", "The Sea", 3) is None


def test_scan_outcomes_and_parents(spark):
    def outcome(build, table, maps):
        return one(
            spark, labels.scan_outcome(F.col("b"), F.col("t"), F.col("m")), b=build, t=table, m=maps
        )

    assert outcome("k", None, 0) == "encrypted_build"
    assert outcome(None, "k", 5) == "encrypted_map_database"
    assert outcome(None, None, 5) == "partial_decrypt"
    assert outcome(None, None, 0) == "full_decrypt"
    parent = labels.parent_map(F.col("j"))
    assert one(spark, parent, j='{"CosmeticParentMapID":3,"ParentMapID":4}') == 3
    assert one(spark, parent, j='{"CosmeticParentMapID":-1,"ParentMapID":4}') == 4
    assert one(spark, parent, j='{"ParentMapID":-1}') is None


def test_coordinates(spark):
    parsed = one(spark, coords.try_coord(F.col("t")), t="-3,17")
    assert (parsed["x"], parsed["y"]) == (-3, 17)
    for bad in ("", "3", "3,", "3,4,5", "a,b"):
        assert one(spark, coords.try_coord(F.col("t")), t=bad) is None
    gx, gy = coords.world_to_grid(F.col("a"), F.col("b"))
    assert round(one(spark, gx, a=0.0, b=0.0), 6) == 32.0 == round(one(spark, gy, a=0.0, b=0.0), 6)
    levels = {0.5: 0, 1.0: 0, 2.0: 1, 4.5: 2, 64.0: 6, 1000.0: 6}
    for zoom, want in levels.items():
        assert one(spark, coords.optimal_level(F.col("z"), F.lit(512)), z=zoom) == want
    assert one(spark, coords.optimal_level(F.col("z"), F.lit(256)), z=4.0) == 1


def test_sql_codec_refuses_what_is_no_version(spark):
    versions.register_sql(spark)
    good = spark.sql("SELECT encode_build_version('11.0.7.58046') AS c, encode_build_version('2047.1023.1023.4294967295') AS top").first()
    assert (good.c, good.top) == (49539625965904574, (1 << 63) - 1)
    for bad in ("4000.1.1.1", "11.5000.7.1", "11.0.7.58046.9", "11.0.7", "", "a.b.c.d", "1.1.1.4294967296", "-1.1.1.1", "1.1.1.1\n", "1.1.1.99999999999999999999"):
        with pytest.raises(Exception, match="not a build version"):
            spark.createDataFrame([(bad,)], "v string").selectExpr("encode_build_version(v)").collect()


def test_no_pattern_takes_a_final_line_break(spark):
    row = spark.createDataFrame([("0" * 32 + "\n", "1.1.1.1\n", "abc\n")], "h string, v string, t string")
    from atlasledger.functions import hashes, labels

    got = row.select(hashes.is_hash(F.col("h")).alias("h"), versions.is_version(F.col("v")).alias("v"), labels.matches_any(F.col("t"), ["abc"]).alias("t")).first()
    assert tuple(got) == (False, False, False)
