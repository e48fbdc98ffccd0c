"""Per-chunk data layers: impassable flags and area ids.

A tile has 16 x 16 chunks; chunk rows carry ``x, y, idx`` with idx = cy*16+cx.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasledger.functions.coords import CHUNKS, bitset_bit, coord_text
from atlasledger.session import checkpointed, dealt, small_batches

CHUNKS_PER_TILE = CHUNKS * CHUNKS

# Neighbour offsets of a chunk and the bit each one sets.
NEIGHBOUR_BITS = {(0, 0): 1, (1, 0): 2, (0, 1): 4, (-1, 0): 8, (0, -1): 16}


def impass_bitsets(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """32-byte bitset (as hex) of each key's impassable chunks.

    Bit i%8 of byte i/8 stands for chunk i. Four 64-bit words are or-ed in the
    map-side aggregation, so a hot key sends one row per task. Chunk numbers
    outside the tile are ignored.
    """
    idx = F.col("idx")
    inside = idx.between(0, CHUNKS_PER_TILE - 1) & F.col("impass")
    bit = F.expr("shiftleft(1L, CAST(idx AS INT) % 64)")
    words = [
        F.coalesce(
            F.bit_or(F.when(inside & (F.floor(idx / 64) == w), bit)), F.lit(0).cast("bigint")
        ).alias(f"_w{w}")
        for w in range(4)
    ]
    return chunks.groupBy(*keys).agg(*words).select(
        *keys, F.concat(*[_le64_hex(F.col(f"_w{w}")) for w in range(4)]).alias("bits")
    )


def _le64_hex(word: Column) -> Column:
    wide = F.lpad(F.hex(word), 16, "0")
    return F.lower(F.concat(*[F.substring(wide, at, 2) for at in range(15, 0, -2)]))


def non_empty(bitsets: DataFrame) -> DataFrame:
    return bitsets.where(F.col("bits") != "00" * 32)


def chunks_of_bitsets(bitsets: DataFrame, keys: list[str]) -> DataFrame:
    """One row per set bit: ``keys, idx``."""
    every = F.sequence(F.lit(0), F.lit(CHUNKS_PER_TILE - 1))
    # the one-element array binds the bitset, so that a computed one is made once
    held = F.transform(
        F.array("bits"), lambda bits: F.filter(every, lambda i: bitset_bit(bits, i))
    )
    return bitsets.select(*keys, F.explode(F.get(held, 0)).alias("idx"))


def area_grids(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """The 256 area ids of each key in chunk order, 0 where a chunk is absent.

    ``chunks`` has one row per chunk, so a group holds at most 256 rows.
    """
    at = F.col("idx").cast("int")
    entry = F.struct(at.alias("i"), F.col("area_id").cast("bigint").alias("a"))
    grouped = (
        chunks.where(F.col("idx").between(0, CHUNKS_PER_TILE - 1))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(entry)).alias("_c"))
    )
    zero = F.lit(0).cast("bigint")

    def with_gap(cell: Column, j: Column) -> Column:
        before = F.when(j == 0, F.lit(-1)).otherwise(F.get(F.col("_c"), j - 1)["i"])
        return F.concat(F.array_repeat(zero, cell["i"] - before - 1), F.array(cell["a"]))

    tail = F.array_repeat(zero, CHUNKS_PER_TILE - 1 - F.element_at("_c", -1)["i"])
    return grouped.select(
        *keys, F.concat(F.flatten(F.transform("_c", with_gap)), tail).alias("area_ids")
    )


def extractions(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Bitset, area grid and the grid's text of each key, as ``impass_bitsets`` and ``area_grids`` make them.

    Chunks move once for all three, and those of many keys are laid out at once.
    """
    entry = F.struct(
        F.col("idx").cast("int").alias("i"), F.col("area_id").cast("bigint").alias("a"),
        F.coalesce(F.col("impass"), F.lit(False)).alias("f"),
    )
    inside = F.col("idx").between(0, CHUNKS_PER_TILE - 1)
    met = chunks.repartition(*[F.col(k) for k in keys]).groupBy(*keys).agg(F.collect_list(F.when(inside, entry)).alias("_c"))
    types = dict(met.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "bits string", "area_ids array<bigint>", "area_text string"])

    def lay_out(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = laid_out(part.column("_c"))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *made], [*keys, "bits", "area_ids", "area_text"])

    return small_batches(met).mapInArrow(lay_out, schema)


def laid_out(lists: pa.ListArray) -> list[pa.Array]:
    """Bitsets, area grids and their texts of lists of ``i, a, f``: chunk, area and flag."""
    ends, n = lists.offsets.to_numpy(), len(lists)
    flat = lists.values.slice(ends[0], ends[-1] - ends[0])
    at, areas = flat.field("i").to_numpy(), flat.field("a")
    flags = flat.field("f").to_numpy(zero_copy_only=False)
    none, areas = areas.is_null().to_numpy(zero_copy_only=False), areas.fill_null(0).to_numpy()
    row = np.repeat(np.arange(n), np.diff(ends))
    # in order of chunks; one that is listed again stands behind and makes its grid longer, one without an area goes first
    order = np.lexsort((areas, ~none, at, row))
    row, at, areas, none, flags = row[order], at[order], areas[order], none[order], flags[order]
    marked = np.zeros((n, CHUNKS_PER_TILE), bool)
    marked[row[flags], at[flags]] = True
    digits = np.packbits(marked, axis=1, bitorder="little").tobytes().hex()
    width = CHUNKS_PER_TILE // 4
    bits = pa.array([digits[k : k + width] for k in range(0, n * width, width)], pa.string())

    again = np.zeros(len(at), bool)
    again[1:] = (row[1:] == row[:-1]) & (at[1:] == at[:-1])
    behind = again.cumsum()
    place = row * CHUNKS_PER_TILE + at + behind
    whole = n * CHUNKS_PER_TILE + (int(behind[-1]) if len(behind) else 0)
    grid, empty = np.zeros(whole, np.int64), np.zeros(whole, bool)
    grid[place], empty[place] = areas, none
    longer = np.bincount(row[again], minlength=n)
    starts = pa.array(np.concatenate([[0], (CHUNKS_PER_TILE + longer).cumsum()]), pa.int32())
    bare = pa.array(np.diff(ends) == 0)
    values = pa.array(grid, pa.int64(), mask=empty)
    grids = pa.ListArray.from_arrays(starts, values, mask=bare)
    texts = pa.ListArray.from_arrays(starts, values.cast(pa.string()).fill_null("null"), mask=bare)
    joined = pc.binary_join(texts, ",")
    return [bits, grids, pc.binary_join_element_wise("[", joined, "]", "")]


def data_kinds(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, flagged``: the keys that have an area grid, and whether a chunk of theirs is impassable."""
    inside = chunks.where(F.col("idx").between(0, CHUNKS_PER_TILE - 1))
    return inside.groupBy(*keys).agg(F.coalesce(F.bool_or("impass"), F.lit(False)).alias("flagged"))


def impass_documents(bitsets: DataFrame, keys: list[str]) -> DataFrame:
    """Impassable-chunk document of each map; tiles without a set bit are left out.

    ``bitsets`` is keyed by ``keys, x, y``: a document holds at most one entry
    per grid tile.
    """
    entry = F.struct(
        coord_text(F.col("x"), F.col("y")).alias("key"),
        F.base64(F.unhex(F.col("bits"))).alias("value"),
    )
    return (
        non_empty(bitsets)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(entry)).alias("_t"))
        .select(*keys, F.to_json(F.struct(F.map_from_entries("_t").alias("tiles"))).alias("document"))
        .withColumn("data_hash", F.md5(F.col("document").cast("binary")))
    )


def area_documents(
    grids: DataFrame, closure: DataFrame, area_table: DataFrame, keys: list[str]
) -> DataFrame:
    """Area document of each map: tiles' area ids plus every area they rely on.

    ``grids`` is ``keys, x, y, area_text``, the grid already as JSON text, so
    that a tile many maps list is rendered once. ``closure`` is ``keys,
    area_id`` (referenced areas and their ancestors); ``area_table`` is
    ``area_id`` and the columns to embed; keys among its columns tell several
    area tables apart.
    """
    tile = F.struct(coord_text(F.col("x"), F.col("y")).alias("key"), "area_text")
    listed = F.transform(
        F.sort_array(F.collect_list(tile)),
        lambda t: F.concat(F.lit('"'), t["key"], F.lit('":'), t["area_text"]),
    )
    tiles = (
        grids.repartition(*[F.col(k) for k in keys])
        .groupBy(*keys)
        .agg(F.array_join(listed, ",").alias("tiles"))
    )
    tables = [k for k in keys if k in area_table.columns]
    fields = [c for c in area_table.columns if c not in ("area_id", *tables)]
    area = F.struct(
        F.col("area_id").cast("string").alias("key"), F.struct(*fields).alias("value")
    )
    areas = (
        closure.join(area_table, [*tables, "area_id"])
        .groupBy(*keys)
        .agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(area)))).alias("areas"))
    )
    document = F.concat(
        F.lit('{"tiles":{'), "tiles", F.lit('},"areas":'), F.coalesce("areas", F.lit("{}")), F.lit("}")
    )
    return (
        tiles.join(areas, keys, "left")
        .select(*keys, document.alias("document"))
        .withColumn("data_hash", F.md5(F.col("document").cast("binary")))
    )


# documents that one task puts together: each of a megabyte or two, with the areas it embeds as rows before
DOCUMENTS_PER_PIECE = 32


def data_documents(
    grids: DataFrame, area_table: DataFrame, keys: list[str], closure: Callable[[DataFrame], DataFrame], count: int = 0
) -> DataFrame:
    """``keys, flags, area``: both data documents of each key, null where it has none.

    ``grids`` is ``keys, x, y, bits, area_text, owned``, the last the areas of the tile's chunks;
    ``closure`` makes ``keys, area_id`` of all areas that a document embeds of ``keys, area_id`` of
    those that its tiles own. Tiles move once: documents, areas and the areas' rows are put together
    where a key's tiles have met, as long as the area table is small enough to be sent there.
    Without ``bits`` no tile has a flag. ``count`` is how many keys there are, if known; tiles are dealt so that a task meets few of them.
    """
    bits = F.col("bits") if "bits" in grids.columns else F.lit("00" * 32).alias("bits")
    tile = F.struct(coord_text(F.col("x"), F.col("y")).alias("key"), bits, "area_text", "owned")
    # keys are never null; said here, it is said to both sides of the join below, which then read one shuffle
    known = grids.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    placed = dealt(known, keys, count // DOCUMENTS_PER_PIECE + 1)
    met = placed.groupBy(*keys).agg(F.collect_list(tile).alias("_t"))
    flagged = F.filter(F.sort_array("_t"), lambda t: t["bits"] != "00" * 32)
    value = F.transform(flagged, lambda t: F.concat(F.lit('"'), t["key"], F.lit('":"'), F.base64(F.unhex(t["bits"])), F.lit('"')))
    texts = F.filter(F.sort_array("_t"), lambda t: t["area_text"].isNotNull())
    listed = F.transform(texts, lambda t: F.concat(F.lit('"'), t["key"], F.lit('":'), t["area_text"]))
    made = met.select(*keys, F.array_join(value, ",").alias("flags"), F.array_join(listed, ",").alias("tiles"))

    owned = met.select(*keys, F.explode(F.array_distinct(F.flatten(F.col("_t.owned")))).alias("area_id"))
    tables = [k for k in keys if k in area_table.columns]
    fields = [c for c in area_table.columns if c not in ("area_id", *tables)]
    number = F.col("area_id").cast("string")
    entry = F.concat(F.lit('"'), number, F.lit('":'), F.to_json(F.struct(*fields)))
    # each area is written once, whatever documents embed it
    entries = checkpointed(area_table.select(*tables, "area_id", F.struct(number.alias("key"), entry.alias("text")).alias("_e")))
    embedded = (
        closure(owned.where(F.col("area_id") != 0))
        .join(entries, [*tables, "area_id"])
        .groupBy(*keys)
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list("_e")), lambda e: e["text"]), ",").alias("areas"))
    )
    return made.join(embedded, keys, "left").select(
        *keys,
        F.when(F.col("flags") != "", F.concat(F.lit('{"tiles":{'), "flags", F.lit("}}"))).alias("flags"),
        F.when(
            F.col("tiles") != "",
            F.concat(F.lit('{"tiles":{'), "tiles", F.lit('},"areas":{'), F.coalesce("areas", F.lit("")), F.lit("}}")),
        ).alias("area"),
    )


def referenced_areas(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct non-zero area ids of each key."""
    return chunks.where(F.col("area_id") != 0).select(*keys, "area_id").distinct()


def area_boxes(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Bounding box of each area in tile units, to a sixteenth."""
    left = F.col("x") + F.col("idx") % CHUNKS / CHUNKS
    top = F.col("y") + F.floor(F.col("idx") / CHUNKS) / CHUNKS
    return chunks.groupBy(*keys, "area_id").agg(
        F.min(left).alias("min_x"),
        F.min(top).alias("min_y"),
        F.max(left + 1 / CHUNKS).alias("max_x"),
        F.max(top + 1 / CHUNKS).alias("max_y"),
    )


def area_masks(grids: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """255 / 0 mask of each tile that holds the area wanted for its map."""
    mask = F.transform("area_ids", lambda a: F.when(a == F.col("area_id"), 255).otherwise(0))
    return (
        grids.join(wanted, keys)
        .where(F.array_contains("area_ids", F.col("area_id")))
        .withColumn("mask", mask)
        .drop("area_ids")
    )


def impass_borders(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbour bits of each impassable chunk, across tile borders.

    Bit 0 the chunk itself, then right, bottom, left, top. Each impassable
    chunk tells itself and its four neighbours, and one or-aggregation on the
    global chunk position collects what it was told; no join.
    """
    told = F.explode(
        F.array(
            *[
                F.struct(
                    # the neighbour on the right hears from its left, and so on
                    (F.col("gx") - dx).alias("gx"),
                    (F.col("gy") - dy).alias("gy"),
                    F.lit(bit).alias("bit"),
                )
                for (dx, dy), bit in NEIGHBOUR_BITS.items()
            ]
        )
    )
    placed = chunks.where("impass").select(
        *keys,
        (F.col("x") * CHUNKS + F.col("idx") % CHUNKS).cast("int").alias("gx"),
        (F.col("y") * CHUNKS + F.floor(F.col("idx") / CHUNKS)).cast("int").alias("gy"),
    )
    return (
        placed.select(*keys, told.alias("_t"))
        .groupBy(*keys, F.col("_t.gx").alias("gx"), F.col("_t.gy").alias("gy"))
        .agg(F.bit_or("_t.bit").alias("bits"))
        .where(F.col("bits").bitwiseAND(F.lit(1)) == 1)
    )
