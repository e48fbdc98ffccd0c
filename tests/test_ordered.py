"""The piece-wise path of the ordered operators equals the plain window."""

from pyspark.sql import functions as F

from atlasledger.operators import ordered as O


def build(df):
    out = O.with_neighbour(df, ["k"], ["o"], {"v": "pv", "o": "po"}, mark="m")
    out = O.with_neighbour(out, ["k"], ["o"], {"o": "no"}, step=1)
    out = O.with_last_known(out, ["k"], ["o"], "v", "before")
    out = O.with_last_known(out, ["k"], ["o"], "v", "after", forward=False)
    out = O.with_running_sum(out, ["k"], ["o"], "w", "total")
    return sorted((tuple(r) for r in out.collect()), key=lambda t: (t[0] is None, t[0] or 0, t[1]))


def test_hot_keys_match_plain_windows(spark):
    df = spark.range(600).select(
        F.when(F.col("id") % 3 > 0, (F.col("id") % 7 == 0).cast("int")).alias("k"),
        F.col("id").alias("o"),
        F.when(F.col("id") % 11 == 0, F.col("id")).alias("v"),
        # null for whole pieces, and now and then
        F.when((F.col("id") > 300) & (F.col("id") % 4 > 0), F.col("id") % 5).alias("w"),
    )
    plain = build(df)
    spark.conf.set(O.HOT_SETTING, "50")
    try:
        assert O.has_hot_key(df, ["k"]) and not O.has_hot_key(df, ["k"], bound=10)
        pieces = O._pieces(df, ["k"], ["o"]).select("k", "_piece").distinct().count()
        assert pieces > 3
        assert build(df) == plain
    finally:
        spark.conf.unset(O.HOT_SETTING)
