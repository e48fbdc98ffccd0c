"""Tile, chunk, viewport and world coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grid is 64 x 64 tiles of 16 x 16 chunks; the world spans
# 34133.3333333333 yards with its origin in the middle; tiles draw at 512 px.
GRID = 64
CHUNKS = 16
MAX_LEVEL = 6
WORLD_SIZE = 34133.3333333333
WORLD_MIN = -17066.6666666667
DRAWN_TILE = 512.0

# Meaning of the chunk flag bits.
CHUNK_FLAGS = {"impass": 0x2, "river": 0x4, "ocean": 0x8, "magma": 0x10, "slime": 0x20}


def coord_text(x: Column, y: Column) -> Column:
    return F.concat_ws(",", x.cast("string"), y.cast("string"))


def try_coord(text: Column) -> Column:
    """``struct<x,y>`` out of ``"x,y"``, or null when it is not two integers."""
    pieces = F.split(text, ",")
    x = F.try_element_at(pieces, F.lit(1)).try_cast("int")
    y = F.try_element_at(pieces, F.lit(2)).try_cast("int")
    good = (F.size(pieces) == 2) & x.isNotNull() & y.isNotNull()
    return F.when(good, F.struct(x.alias("x"), y.alias("y")))


def parse_coord(text: Column) -> Column:
    parsed = try_coord(text)
    problem = F.raise_error(F.concat(F.lit("not a coordinate: "), F.coalesce(text, F.lit("null"))))
    return F.when(parsed.isNotNull(), parsed).otherwise(problem)


def chunk_index(chunk_x: Column, chunk_y: Column) -> Column:
    return chunk_y * CHUNKS + chunk_x


def chunk_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(F.lit(CHUNK_FLAGS[name]).cast("bigint")) != 0


def bitset_bit(bits_hex: Column, index: Column) -> Column:
    """Bit ``index`` of a hex bitset: bit i%8 of byte i/8."""
    byte = F.conv(F.substring(bits_hex, F.floor(index / 8).cast("int") * 2 + 1, F.lit(2)), 16, 10)
    return F.getbit(byte.cast("int"), (index % 8).cast("int")) == 1


def world_to_grid(world_x: Column, world_y: Column) -> tuple[Column, Column]:
    """North/west yards to grid position; the axes swap and flip."""
    along_x = (world_x - WORLD_MIN) / WORLD_SIZE
    along_y = (world_y - WORLD_MIN) / WORLD_SIZE
    return (1 - along_y) * GRID, (1 - along_x) * GRID


def grid_to_world(grid_x: Column, grid_y: Column) -> tuple[Column, Column]:
    return (
        (1 - grid_y / GRID) * WORLD_SIZE + WORLD_MIN,
        (1 - grid_x / GRID) * WORLD_SIZE + WORLD_MIN,
    )


def world_distance_to_grid(yards: Column) -> Column:
    return yards / (WORLD_SIZE / GRID)


def grid_distance_to_world(tiles: Column) -> Column:
    return tiles * (WORLD_SIZE / GRID)


def viewport_bounds(
    center_x: Column, center_y: Column, zoom: Column, width: Column, height: Column
) -> dict[str, Column]:
    """Whole-tile bounds of what a canvas shows around a centre."""
    across = width / (F.lit(DRAWN_TILE) / zoom)
    down = height / (F.lit(DRAWN_TILE) / zoom)
    return {
        "min_x": F.floor(center_x - across / 2).cast("int"),
        "max_x": F.ceil(center_x + across / 2).cast("int"),
        "min_y": F.floor(center_y - down / 2).cast("int"),
        "max_y": F.ceil(center_y + down / 2).cast("int"),
    }


def optimal_level(
    zoom: Column, tile_size: Column, bias: float = 1.0, floor_level: int = 0
) -> Column:
    """Pyramid level whose texels come closest to one per pixel."""
    effective = zoom * (tile_size / DRAWN_TILE) / bias
    level = F.floor(F.log2(effective)).cast("int")
    return F.greatest(F.lit(floor_level), F.least(F.lit(MAX_LEVEL), F.greatest(F.lit(0), level)))


def overlaps_bounds(
    x: Column, y: Column, size: Column, bounds: dict[str, Column]
) -> Column:
    """Half-open overlap of a square cell with viewport bounds."""
    return (
        (x + size > bounds["min_x"])
        & (x < bounds["max_x"])
        & (y + size > bounds["min_y"])
        & (y < bounds["max_y"])
    )
