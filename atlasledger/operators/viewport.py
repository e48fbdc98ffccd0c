"""Which pyramid tiles a viewport shows, and in which order to load them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasledger.functions.coords import GRID, optimal_level, overlaps_bounds, viewport_bounds
from atlasledger.operators.ordered import top_per_key


def with_view(viewports: DataFrame, tile_size: Column) -> DataFrame:
    """Add bounds and the optimal level to viewport rows."""
    bounds = viewport_bounds(
        F.col("center_x"), F.col("center_y"), F.col("zoom"), F.col("width"), F.col("height")
    )
    out = viewports.withColumn("level", optimal_level(F.col("zoom"), tile_size))
    for name, column in bounds.items():
        out = out.withColumn(name, column)
    return out


def _first_cell(low: Column, size: Column) -> Column:
    """Origin of the first cell that reaches past ``low``."""
    return F.greatest(F.lit(0), F.floor(low / size) * size).cast("int")


def _last_cell(high: Column, size: Column) -> Column:
    """Origin of the last cell that starts before ``high``."""
    return F.least(F.lit(GRID), F.ceil(high / size) * size).cast("int") - size


def visible_cells(views: DataFrame) -> DataFrame:
    """The cells of its level each viewport overlaps, inside the grid.

    This turns the range join with the tiles into an equality join: a level
    has at most (64 / 2^level)^2 cells, however many tiles and maps there are.
    """
    size = F.expr("shiftleft(1, level)")

    def span(low: str, high: str) -> Column:
        first = _first_cell(F.col(low), size)
        last = _last_cell(F.col(high), size)
        return F.when(first <= last, F.sequence(first, last, size)).otherwise(
            F.array().cast("array<int>")
        )

    return views.withColumn("x", F.explode(span("min_x", "max_x"))).withColumn(
        "y", F.explode(span("min_y", "max_y"))
    )


def visible_tiles(
    views: DataFrame,
    cells: DataFrame,
    z_index: int = 0,
    resident_level: int = 5,
    keys: tuple[str, ...] = ("map_id",),
) -> DataFrame:
    """Pyramid tiles each viewport shows, with their load priority.

    ``cells`` is ``keys, level, x, y, hash`` over levels 0..6; views have ``keys`` too.
    """
    shown = visible_cells(views).join(cells, [*keys, "level", "x", "y"])
    size = F.expr("shiftleft(1, level)")
    across = F.col("x") + size / 2 - F.col("center_x")
    down = F.col("y") + size / 2 - F.col("center_y")
    distance = F.sqrt(across * across + down * down)
    near = F.greatest(F.lit(0.0), 1000 - distance * 10)
    by_level = F.when(F.col("level") == resident_level, F.lit(50000)).otherwise(
        (6 - F.col("level")) * 1000
    )
    return shown.withColumn("priority", near + z_index * 10000 + by_level)


def load_order(visible: DataFrame, k: int) -> DataFrame:
    """The first ``k`` tiles each viewport should load."""
    order = [F.col("priority").desc(), F.col("x"), F.col("y")]
    return top_per_key(visible, ["view_id"], order, k)


def in_bounds(level: Column, x: Column, y: Column, bounds: dict[str, Column]) -> Column:
    return overlaps_bounds(x, y, F.pow(F.lit(2), level).cast("int"), bounds)


def cdn_missing_coords(tiles: DataFrame, cdn_missing: DataFrame, keys: list[str]) -> DataFrame:
    """Coordinates of a composition whose hash the CDN does not have."""
    return tiles.join(cdn_missing.select(*keys, "hash"), [*keys, "hash"], "left_semi")
