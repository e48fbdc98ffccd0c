"""Landed text feeds: typed version feeds, path lists and key lists.

A typed feed document has a schema line, a sequence line, then pipe-separated
rows. Documents are one per product and region set, so a whole document is a
small value; a folder may hold any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Header line and row fields of each typed feed.
FEEDS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "summary": (
        "Product!STRING:0|Seqn!DEC:4|Flags!STRING:0",
        [("name", "string"), ("product_seqn", "bigint"), ("flags", "string")],
    ),
    "versions": (
        "Region!STRING:0|BuildConfig!HEX:16|CDNConfig!HEX:16|KeyRing!HEX:16|BuildId!DEC:4"
        "|VersionsName!String:0|ProductConfig!HEX:16",
        [
            ("region", "string"),
            ("build_config", "string"),
            ("cdn_config", "string"),
            ("key_ring", "string"),
            ("build_number", "bigint"),
            ("version", "string"),
            ("product_config", "string"),
        ],
    ),
    "cdns": (
        "Name!STRING:0|Path!STRING:0|Hosts!STRING:0|Servers!STRING:0|ConfigPath!STRING:0",
        [
            ("name", "string"),
            ("path", "string"),
            ("hosts", "string"),
            ("servers", "string"),
            ("config_path", "string"),
        ],
    ),
}
SEQUENCE_PATTERN = r"^## seqn = ([0-9]+)$"


def parse_feed(documents: DataFrame, feed: str, document: str = "document") -> DataFrame:
    """Rows of typed feed documents, next to the documents' other columns.

    A wrong header, a missing sequence line or a later ``#`` line is an error;
    a missing trailing field is the empty string.
    """
    header, fields = FEEDS[feed]
    text = F.regexp_replace(F.col(document), "\r\n", "\n")
    text = F.regexp_replace(text, "\n$", "")
    lines = F.split(text, "\n")
    sequence = F.regexp_extract(F.try_element_at(lines, F.lit(2)), SEQUENCE_PATTERN, 1)
    checked = (
        F.when(F.element_at(lines, 1) != header, _fail("unexpected feed header", document))
        .when(F.coalesce(sequence, F.lit("")) == "", _fail("missing sequence line", document))
        .otherwise(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))))
    )
    kept = [c for c in documents.columns if c != document]
    rows = documents.select(
        *kept, sequence.cast("bigint").alias("seqn"), F.posexplode(checked).alias("line_no", "line")
    )
    line = F.when(F.col("line").startswith("#"), _fail("unexpected # line", "line")).otherwise(
        F.col("line")
    )
    pieces = F.split(line, r"[|]")
    out = []
    for i, (name, kind) in enumerate(fields):
        piece = F.get(pieces, i)
        if i == len(fields) - 1:
            piece = F.coalesce(piece, F.lit(""))
        out.append(piece.cast(kind).alias(name))
    return rows.select(*kept, "seqn", (F.col("line_no") + 1).alias("line_no"), *out)


def _fail(problem: str, column: str) -> Column:
    return F.raise_error(F.concat(F.lit(problem + ": "), F.substring(F.col(column), 1, 80)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: file by name, split by offset, then line by line.

    Spark packs splits of several files by size, so a running number alone would not follow the
    files. Places are ordered but not consecutive.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("offset"),
        F.monotonically_increasing_id().alias("line"),
    )
    return spark.read.text(path).select(place.alias("line_no"), F.col("value").alias("line"))


def parse_path_list(lines: DataFrame) -> DataFrame:
    """``id;path`` lines to one file id per path; the last line of a path wins."""
    pieces = F.split(F.col("line"), ";", 2)
    parsed = lines.select(
        F.col("line_no"),
        F.trim(F.get(pieces, 0)).try_cast("bigint").alias("fdid"),
        F.lower(F.trim(F.get(pieces, 1))).alias("path"),
    ).where(F.col("fdid").between(0, 4294967295) & (F.col("path") != ""))
    return parsed.groupBy("path").agg(F.max_by("fdid", "line_no").alias("fdid"))


def parse_key_list(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fixed-width key lines: 16 hex name, a blank, 32 hex value, ignored tail.

    A row per line, after the columns in ``keep``; several lines may name one key.
    """
    line = F.col("line")
    good = line.rlike("^[0-9a-fA-F]{16} [0-9a-fA-F]{32}")
    checked = F.when(good, line).otherwise(_fail("not a key line", "line"))
    return lines.select(
        *keep,
        F.upper(F.substring(checked, 1, 16)).alias("key_name"),
        F.lower(F.substring(checked, 18, 32)).alias("key_hex"),
    )
