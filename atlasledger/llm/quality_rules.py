"""Quality rules in Spark SQL functions only: countable base rules, then a hashed n-gram
log-likelihood ratio between a trusted target and the raw corpus.

Words and pairs of neighbouring words are hashed into ``BUCKETS`` buckets. Two multinomials over the
buckets are counted on whole tables: over all documents, and over the trusted ones. A document's
verdict is its mean log ratio per n-gram, so length does not matter, against a fixed threshold.
The driver holds the ``BUCKETS`` ratios, a number that no input changes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 16384
#: The target is smoothed towards the raw counts as if by this many n-grams, so that a small trusted
#: set cannot condemn what it merely has not seen.
PRIOR = 32768.0
#: Mean log ratio (nats per n-gram) from which a document is kept.
THRESHOLD = -0.07
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    bare = F.btrim(text, F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(bare != "", F.split(bare, "[ \\t\\n\\x0B\\f\\r]+")).otherwise(none)


def _next(items: Column, join) -> Column:
    """``join`` of every item with its successor; as many as there are pairs."""
    following = F.slice(items, F.lit(2), F.greatest(F.size(items), F.lit(1)))
    paired = F.zip_with(items, following, join)
    return F.slice(paired, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0)))


def hashed(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``_one`` and ``_two``, hashes of its words and of its pairs of neighbours."""
    one = F.transform(words(text), lambda w: F.xxhash64(w))
    return docs.withColumn("_one", one).withColumn("_two", _next(F.col("_one"), lambda a, b: F.xxhash64(a, b)))


def _repeated_words(three: Column) -> Column:
    """Words in runs of three that come twice, given the hashes of all runs.

    Only where some run repeats are the runs sorted with their places; neighbours that are equal
    mark their places, and sorted places add up to three words each less the overlap.
    """
    order = F.sort_array(F.transform(three, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda e: F.transform(
        F.zip_with(
            F.zip_with(e, F.slice(e, F.lit(2), F.greatest(F.size(e), F.lit(1))), lambda a, b: F.struct(a.i.alias("i"), a.h.alias("h"), (a.h == b.h).alias("next"))),
            F.concat(F.slice(e, F.lit(1), F.lit(1)), F.slice(e, F.lit(1), F.size(e) - 1)),
            lambda a, b: F.struct(a.i.alias("i"), (F.coalesce(a["next"], F.lit(False)) | ((a.h == b.h) & (a.i != b.i))).alias("hit")),
        ),
        lambda x: F.when(x.hit, x.i),
    )
    bound = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  evaluated once
    places = bound(order, lambda e: F.sort_array(F.filter(same(e), lambda x: x.isNotNull())))
    total = bound(
        places,
        lambda p: F.aggregate(
            F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))),
            F.lit(0).cast("long"),
            lambda total, x: total + x,
        ),
    )
    return F.when(F.size(F.array_distinct(three)) == F.size(three), F.lit(0).cast("long")).otherwise(total)


def base(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with the counts the base rules are about, and ``base_failed``.

    A null text counts as an empty one. ``docs`` comes out with ``_one`` and ``_two`` (``hashed``).
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    out = hashed(docs.withColumn("_lines", lines), text).withColumn("_three", _next(F.col("_two"), lambda a, b: F.xxhash64(a, b)))
    out = (
        out.withColumn("n_words", F.size("_one").cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]+", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", _repeated_words(F.col("_three")))
        .drop("_lines", "_three")
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Per bucket, log of its share of the trusted n-grams over its share of all n-grams.

    ``trusted`` names trusted ids in ``id_col``; ids that are null or unknown count for nothing, and
    a repeated one counts once. With no n-grams at all, every ratio is 0. Both counts are of whole
    tables and are summed before they are shuffled.
    """
    trust = trusted.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    text = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # sorted and merged at every size: the trusted ids grow with the labels
    text = text.join(trust.withColumn("_good", F.lit(1)).hint("merge"), "_id", "left")
    grams = hashed(text, F.col("_text")).select(
        F.col("_good"), F.explode(F.concat("_one", "_two")).alias("_gram")
    )
    counts = (
        grams.groupBy(F.pmod("_gram", F.lit(BUCKETS)).cast("int").alias("bucket"))
        .agg(F.count("*").alias("raw"), F.count("_good").alias("good"))
        .collect()
    )
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for row in counts:
        raw[row.bucket], good[row.bucket] = row.raw, row.good
    every, target = sum(raw) + BUCKETS, sum(good)
    share = [(n + 1) / every for n in raw]
    return [math.log((g + PRIOR * p) / (target + PRIOR) / p) for g, p in zip(good, share, strict=True)]


def quality_rules(
    docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: ``row`` (all its columns as a struct, so that no names can clash), the
    base counts, ``base_failed``, ``score`` (mean log ratio per n-gram) and ``kept``.

    A null or wordless text has no n-grams, fails the base rules and scores 0. Repeated rows are
    judged alike. Ties with the threshold are kept. An empty table gives an empty result. One job
    counts n-grams while the plan is built.
    """
    ratio = F.lit(log_ratios(docs, trusted, id_col, text_col))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = base(out, F.col("row").getField(text_col))
    grams = F.concat("_one", "_two")
    total = F.aggregate(grams, F.lit(0.0), lambda total, g: total + ratio[F.pmod(g, F.lit(BUCKETS)).cast("int")])
    size = F.size("_one") + F.size("_two")
    return (
        out.withColumn("score", F.when(size > 0, total / size).otherwise(0.0))
        .drop("_one", "_two")
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    )
