"""Build versions as sortable 64-bit numbers.

A version ``expansion.major.minor.build`` occupies 11 + 10 + 10 + 32 bits, so
numeric order of the code is version order.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Shift and largest value of each part.
PARTS = {
    "expansion": (52, 2047),
    "major": (42, 1023),
    "minor": (32, 1023),
    "build": (0, 4294967295),
}
VERSION_PATTERN = r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\z"


def try_encode_version(text: Column) -> Column:
    """The version's number, or null when it is malformed."""

    def packed(pieces: Column) -> Column:
        valid, code = F.lit(True), F.lit(0).cast("bigint")
        for i, (shift, largest) in enumerate(PARTS.values()):
            number = F.get(pieces, F.lit(i)).try_cast("bigint")
            valid = valid & number.isNotNull() & (number <= largest)
            code = code.bitwiseOR(F.shiftleft(number, shift))
        return F.when(valid, code)

    # the one-element array binds the split pieces, so the text is split once
    code = F.get(F.transform(F.array(F.split(text, r"\.")), packed), F.lit(0))
    return F.when(text.rlike(VERSION_PATTERN), code)


def is_version(text: Column) -> Column:
    """True when ``text`` is four in-range parts of plain digits."""
    return try_encode_version(text).isNotNull()


def encode_version(text: Column) -> Column:
    """The version's number; a malformed version is an error."""
    problem = F.concat(F.lit("not a build version: "), F.coalesce(text, F.lit("null")))
    return F.coalesce(try_encode_version(text), F.raise_error(problem))


def version_part(code: Column, part: str) -> Column:
    """One of expansion, major, minor, build out of a version number."""
    shift, largest = PARTS[part]
    return F.shiftright(code, shift).bitwiseAND(F.lit(largest).cast("bigint"))


def decode_version(code: Column) -> Column:
    """Dotted text of a version number; a negative number is an error."""
    text = F.concat_ws(".", *[version_part(code, p).cast("string") for p in PARTS])
    return F.when(code >= 0, text).when(
        code < 0, F.raise_error(F.lit("a build version is never negative"))
    )


def version_number(text: str) -> int:
    """The number of a constant version, for use as a literal threshold."""
    code = 0
    for piece, (shift, largest) in zip(text.split("."), PARTS.values(), strict=True):
        if not piece.isdigit() or int(piece) > largest:
            raise ValueError(f"not a build version: {text}")
        code |= int(piece) << shift
    return code


def register_sql(spark: SparkSession) -> None:
    """Publish the codec as SQL functions (expressions, no Python worker)."""
    number = {k: f"try_cast(split_part(v, '.', {i}) AS BIGINT)" for i, k in enumerate(PARTS, 1)}
    valid = " AND ".join([f"v RLIKE r'{VERSION_PATTERN}'", *[f"{number[k]} <= {PARTS[k][1]}" for k in PARTS]])
    code = " | ".join(f"shiftleft({number[k]}, {PARTS[k][0]})" for k in PARTS)
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION encode_build_version(v STRING) RETURNS BIGINT RETURN
          CASE WHEN {valid} THEN {code}
               ELSE raise_error(concat('not a build version: ', coalesce(v, 'null'))) END
        """
    )
    spark.sql(
        """
        CREATE OR REPLACE TEMPORARY FUNCTION decode_build_version(c BIGINT) RETURNS STRING RETURN
          concat_ws('.', shiftright(c, 52) & 2047L, shiftright(c, 42) & 1023L,
                    shiftright(c, 32) & 1023L, c & 4294967295L)
        """
    )
