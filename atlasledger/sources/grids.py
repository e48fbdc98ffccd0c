"""Packed 64 x 64 cell grids as rows, and rows as packed grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasledger.functions.hashes import hex_number, le32_number, le32_of, le32_pair_hex

# The eight unsigned 32-bit ids of a cell, in stored order.
CELL_FIELDS = [
    "root_adt",
    "obj0_adt",
    "obj1_adt",
    "tex0_adt",
    "lod_adt",
    "map_texture",
    "map_texture_n",
    "minimap_texture",
]
CELL_BYTES = 4 * len(CELL_FIELDS)
ROW_BYTES = 64 * CELL_BYTES


def unpack_grid(grids: DataFrame, payload: str) -> DataFrame:
    """One row per non-zero cell of a binary grid column (row = y, column = x).

    The payload is cut into 64 grid rows before it is exploded, so no exploded
    row carries more than one grid row of bytes.
    """
    kept = [c for c in grids.columns if c != payload]
    # the one-element array binds the payload, so that a computed one is made once
    grid_rows = F.transform(
        F.array(F.col(payload)),
        lambda grid: F.transform(
            F.sequence(F.lit(0), F.lit(63)),
            lambda y: F.substring(grid, y * ROW_BYTES + 1, F.lit(ROW_BYTES)),
        ),
    )
    # empty rows go before they are cut, and empty cells before they are read
    by_row = grids.select(*kept, F.posexplode(F.get(grid_rows, 0)).alias("y", "_row")).where(
        F.col("_row") != F.lit(bytearray(ROW_BYTES))
    )
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda x: F.substring(F.col("_row"), x * CELL_BYTES + 1, F.lit(CELL_BYTES)),
    )
    by_cell = by_row.select(*kept, "y", F.posexplode(cells).alias("x", "_cell"))
    by_cell = by_cell.where(F.col("_cell") != F.lit(bytearray(CELL_BYTES))).withColumn("_hex", F.hex("_cell"))
    # two ids are read at once; only a cell that a payload ends in has fewer bytes
    whole = F.octet_length("_cell") == CELL_BYTES
    pairs = [F.when(whole, hex_number(F.col("_hex"), 16 * i + 1)).alias(f"_p{i}") for i in range(len(CELL_FIELDS) // 2)]
    ids = [
        F.when(whole, le32_of(F.col(f"_p{i // 2}"), i % 2)).otherwise(le32_number(F.col("_hex"), 8 * i + 1)).alias(n)
        for i, n in enumerate(CELL_FIELDS)
    ]
    return by_cell.select(*kept, "x", "y", "_cell", "_hex", *pairs).select(*kept, "x", "y", *ids)


def pack_grid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The binary grid of each key; ``cells`` has one row per coordinate.

    Cells that lie by some of the keys already are not moved.
    """
    fields = [F.col(name) for name in CELL_FIELDS]
    content = F.concat(*[le32_pair_hex(a, b) for a, b in zip(fields[::2], fields[1::2])])
    entry = F.struct((F.col("y") * 64 + F.col("x")).alias("i"), content.alias("cell"))
    grouped = (
        cells.where(F.col("x").between(0, 63) & F.col("y").between(0, 63))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(entry)).alias("_cells"))
    )
    filled = F.transform(
        F.col("_cells"),
        lambda cell, j: F.concat(
            F.repeat(
                F.lit("00" * CELL_BYTES),
                cell["i"] - F.when(j == 0, F.lit(-1)).otherwise(F.get(F.col("_cells"), j - 1)["i"]) - 1,
            ),
            cell["cell"],
        ),
    )
    tail = F.repeat(F.lit("00" * CELL_BYTES), 4095 - F.element_at("_cells", -1)["i"])
    return grouped.select(*keys, F.unhex(F.concat(F.array_join(filled, ""), tail)).alias("payload"))
