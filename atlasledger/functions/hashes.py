"""Content hashes: 16-byte MD5 kept as lowercase hex text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The hash text pattern and the two stand-ins used in pyramids.
HASH_PATTERN = r"^[0-9a-fA-F]{32}\z"
ABSENT_HEX = "00" * 16
CDN_MISSING_HEX = "67" * 16


def is_hash(text: Column) -> Column:
    return F.coalesce(text.rlike(HASH_PATTERN), F.lit(False))


def try_hash(text: Column) -> Column:
    """Lowercase hash text, or null when it is not a hash."""
    return F.when(is_hash(text), F.lower(text))


def parse_hash(text: Column) -> Column:
    """Lowercase hash text; anything else is an error."""
    return F.when(is_hash(text), F.lower(text)).otherwise(
        F.raise_error(F.concat(F.lit("not a content hash: "), F.coalesce(text, F.lit("null"))))
    )


def content_hash(content: Column) -> Column:
    """Hash of text or binary content."""
    return F.md5(content.cast("binary"))


def intact(content: Column, key: Column) -> Column:
    """True when the content hashes to the key it is stored under."""
    return content_hash(content) == F.lower(key)


def hash_sort_key(hash_text: Column) -> Column:
    """Text that orders like the hash's two little-endian 64-bit halves.

    Each half has its bytes turned round, so comparing the text compares the
    halves as unsigned numbers.
    """
    turned = [
        F.substring(hash_text, half * 16 + (7 - byte) * 2 + 1, 2)
        for half in (0, 1)
        for byte in range(8)
    ]
    return F.concat(*turned)


def _swapped(number: Column) -> Column:
    """A 32-bit integer with its bytes turned round, as a non-negative long."""
    wide = number.cast("bigint")

    def byte(at: int) -> Column:
        return F.shiftright(wide, 8 * at).bitwiseAND(F.lit(0xFF).cast("bigint"))

    out = F.shiftleft(byte(0), 24)
    for at in (1, 2, 3):
        out = out.bitwiseOR(F.shiftleft(byte(at), 24 - 8 * at))
    return out


def le32_hex(number: Column) -> Column:
    """Hex of a 32-bit integer's four bytes, lowest byte first."""
    return F.lower(F.lpad(F.hex(_swapped(number)), 8, "0"))


def le32_pair_hex(first: Column, second: Column) -> Column:
    """Hex of two 32-bit integers, each lowest byte first, in one conversion."""
    both = F.shiftleft(_swapped(first), 32).bitwiseOR(_swapped(second))
    return F.lpad(F.hex(both), 16, "0")


def le32_number(hex_text: Column, at: int | Column) -> Column:
    """The unsigned 32-bit number whose low-byte-first hex starts at ``at``."""
    at = F.lit(at) if isinstance(at, int) else at
    pieces = [F.substring(hex_text, at + shift, F.lit(2)) for shift in (6, 4, 2, 0)]
    return F.conv(F.concat(*pieces), 16, 10).cast("bigint")


def hex_number(hex_text: Column, at: int) -> Column:
    """The 64-bit number whose 16 hex digits, highest byte first, start at ``at``; negative from 2^63 on."""
    return F.conv(F.substring(hex_text, at, 16), 16, -10).cast("bigint")


def le32_of(number: Column, half: int) -> Column:
    """The unsigned 32-bit number, lowest byte first, in the higher (0) or lower (1) half of a 64-bit number."""
    return _swapped(F.shiftrightunsigned(number, 32) if half == 0 else number)


def store_key(hash_text: Column) -> Column:
    """Where a content store files a hash: ``aa/aabb…``."""
    return F.concat(F.substring(hash_text, 1, 2), F.lit("/"), hash_text)


def media_type(content: Column) -> Column:
    """Media type told from the leading bytes."""
    content = content.cast("binary")
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.rlike("^52494646.{8}57454250$"), F.lit("image/webp"))
        .when(head.rlike("^.{8}66747970.{8}$"), F.lit("image/avif"))
        .otherwise(F.lit("application/octet-stream"))
    )
