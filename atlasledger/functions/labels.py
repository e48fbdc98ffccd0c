"""Names, paths, states and other small text rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from atlasledger import schema

# Characters ignored when an internal name is compared.
IGNORED_IN_NAMES = r"[\s':.\\-]"


def wildcard_regex(pattern: str) -> str:
    """Case-insensitive anchored regex of a ``*`` / ``?`` pattern."""
    body = "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in pattern)
    return rf"(?is)^{body}\z"


def matches_any(text: Column, patterns: list[str]) -> Column:
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | text.rlike(wildcard_regex(pattern))
    return hit


def search_text(needle: str, *fields: Column) -> Column:
    """True when any field holds the trimmed, lowercased needle; empty finds all."""
    wanted = needle.strip().lower()
    if not wanted:
        return F.lit(True)
    hit = F.lit(False)
    for field in fields:
        hit = hit | F.lower(field.cast("string")).contains(wanted)
    return hit


def layer_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(v) for row in schema.LAYERS for v in row[:2]])
    return F.try_element_at(names, code)


def current_layer_name(old: Column) -> Column:
    """Layer names used before the rename, brought up to date."""
    names = F.create_map(*[F.lit(v) for pair in schema.LEGACY_LAYER_NAMES.items() for v in pair])
    return F.coalesce(F.try_element_at(names, old), old)


def known_state(state: Column) -> Column:
    return state.isin(*schema.SCAN_STATES)


def scan_outcome(build_key: Column, map_table_key: Column, encrypted_maps: Column) -> Column:
    """State a finished scan ends in, by what turned out to be locked."""
    return (
        F.when(build_key.isNotNull(), F.lit("encrypted_build"))
        .when(map_table_key.isNotNull(), F.lit("encrypted_map_database"))
        .when(encrypted_maps > 0, F.lit("partial_decrypt"))
        .otherwise(F.lit("full_decrypt"))
    )


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def map_label(name: Column, directory: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), directory)


def parent_map(row_json: Column) -> Column:
    """Parent id out of a map row document: cosmetic parent first, -1 is none."""
    cosmetic = F.get_json_object(row_json, "$.CosmeticParentMapID").try_cast("int")
    plain = F.get_json_object(row_json, "$.ParentMapID").try_cast("int")
    return F.coalesce(F.nullif(cosmetic, F.lit(-1)), F.nullif(plain, F.lit(-1)))


def zone_label(name: Column, internal: Column, area_id: Column, same_name: Column) -> Column:
    """What to show behind a zone name, or null when nothing is worth showing."""

    def plain(text: Column) -> Column:
        return F.lower(F.regexp_replace(text, IGNORED_IN_NAMES, ""))

    shown = F.when(plain(internal) != plain(name), internal)
    tag = F.when(same_name > 1, F.concat(F.lit("("), area_id.cast("string"), F.lit(")")))
    label = F.concat_ws(" ", shown, tag)
    worth = (F.coalesce(internal, F.lit("")) != "") & (internal != name) & (label != "")
    return F.when(worth, label)


def wdt_path(directory: Column) -> Column:
    folder = F.lower(directory)
    return F.concat(F.lit("world/maps/"), folder, F.lit("/"), folder, F.lit(".wdt"))


def adt_path(directory: Column, x: Column, y: Column) -> Column:
    folder = F.lower(directory)
    at = F.concat_ws("_", x.cast("string"), y.cast("string"))
    return F.concat(F.lit("world/maps/"), folder, F.lit("/"), folder, F.lit("_"), at, F.lit(".adt"))


def preferred_base(preferred: Column, has_minimap: Column, has_texture: Column) -> Column:
    """Base layer to show: the preferred one if there, else minimap, else texture."""
    return (
        F.when((preferred == 0) & has_minimap, F.lit(0))
        .when((preferred == 1) & has_texture, F.lit(1))
        .when(has_minimap, F.lit(0))
        .when(has_texture, F.lit(1))
        .otherwise(F.lit(0))
    )


def extents_document(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    box = F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return F.when(x0.isNotNull(), F.to_json(box))


def extents_columns(document: Column) -> dict[str, Column]:
    return {
        side: F.get_json_object(document, f"$.{side}").try_cast("smallint")
        for side in ("x0", "y0", "x1", "y1")
    }
