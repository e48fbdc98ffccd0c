"""Scanning builds: from listed files to catalogue rows, for any number of builds at once."""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atlasledger.functions.labels import scan_outcome
from atlasledger.operators import areas as area_ops
from atlasledger.operators import chunks as chunk_ops
from atlasledger.operators import compose, lod, merge, resolve, scans
from atlasledger.operators import data_documents as texts
from atlasledger.session import checkpointed
from atlasledger.sources import documents

LAYER = ["build_id", "map_id", "layer_type"]
BUILD_MAP = ["build_id", "map_id"]


@dataclass
class ScanFacts:
    """What a scan reads.

    cells: ``build_id, map_id, x, y, minimap_texture, map_texture, root_adt``;
    file_index: ``build_id, fdid, ckey``; adt_index: ``build_id, fdid,
    adt_hash``; overrides: ``map_id, x, y, fdid``; cdn_missing: ``hash``;
    sizes: ``hash, tile_size``; chunks: ``adt_hash, idx, area_id, impass``;
    areas: ``area_id, parent_id`` and the columns documents embed, with a
    ``build_id`` where builds have area tables of their own; for the others see below.
    """

    cells: DataFrame
    file_index: DataFrame
    adt_index: DataFrame
    overrides: DataFrame
    cdn_missing: DataFrame
    sizes: DataFrame
    chunks: DataFrame
    areas: DataFrame
    #: What turned out to be locked or broken, where anything is: ``build_id, build_key, table_key``
    #: (null where open), ``build_id, map_id, key_name`` and ``build_id, error``.
    locks: DataFrame | None = None
    map_locks: DataFrame | None = None
    failures: DataFrame | None = None
    #: ``build_id, map_id, json, directory, name`` of every build's map table, where it is read.
    maps: DataFrame | None = None

    def of_builds(self, builds: DataFrame) -> "ScanFacts":
        """The facts of some builds only."""

        def part(df: DataFrame) -> DataFrame:
            return df.join(builds.select("build_id"), "build_id", "left_semi")

        return ScanFacts(
            part(self.cells),
            part(self.file_index),
            part(self.adt_index),
            self.overrides,
            self.cdn_missing,
            self.sizes,
            self.chunks,
            part(self.areas) if "build_id" in self.areas.columns else self.areas,
            *(df if df is None else part(df) for df in (self.locks, self.map_locks, self.failures, self.maps)),
        )


def build_outcomes(facts: ScanFacts, builds: DataFrame) -> DataFrame:
    """``build_id, new_state, key, key_maps, error`` of each build.

    What is wrong with one build is a row of it here and stops no other: ``error`` is what its scan
    failed with, or a cell outside the grid, the first of them in order. A locked build or map table
    names its key, a partial result its locked maps by key.
    """
    spark = builds.sparkSession

    def told(df: DataFrame | None, columns: str) -> DataFrame:
        return spark.createDataFrame([], columns) if df is None else df

    odd = facts.cells.where(~(F.col("x").between(0, 63) & F.col("y").between(0, 63)))
    at = F.format_string("cell %d,%d of map %d is outside the grid", F.col("x").cast("int"), F.col("y").cast("int"), F.col("map_id").cast("int"))
    errors = told(facts.failures, "build_id bigint, error string").select("build_id", "error")
    errors = errors.unionByName(odd.select("build_id", at.alias("error"))).groupBy("build_id").agg(F.min("error").alias("error"))
    locks = told(facts.locks, "build_id bigint, build_key string, table_key string").groupBy("build_id").agg(
        F.min("build_key").alias("build_key"), F.min("table_key").alias("table_key")
    )
    by_key = scans.locked_maps_by_key(told(facts.map_locks, "build_id bigint, map_id int, key_name string"), ["build_id"])
    maps = by_key.groupBy("build_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key_name", "map_ids"))))).alias("maps"))
    out = builds.select("build_id").distinct()
    for df in (errors, locks, maps):
        out = out.join(df, "build_id", "left")
    state = scan_outcome(F.col("build_key"), F.col("table_key"), F.col("maps").isNotNull().cast("int"))
    return out.select(
        "build_id",
        F.when(F.col("error").isNull(), state).alias("new_state"),
        F.coalesce("build_key", "table_key").alias("key"),
        F.col("maps").alias("key_maps"),
        "error",
    )


def open_facts(facts: ScanFacts, outcomes: DataFrame) -> ScanFacts:
    """The facts of builds that can be scanned, without the maps that are locked."""
    mine = facts.of_builds(outcomes.where(F.col("new_state").isin("full_decrypt", "partial_decrypt")))
    if mine.map_locks is not None:
        mine.cells = mine.cells.join(mine.map_locks.select(*BUILD_MAP).distinct(), BUILD_MAP, "left_anti")
    return mine


def layer_tiles(facts: ScanFacts) -> DataFrame:
    """Every listed coordinate of the three tile layers, resolved and flagged."""
    build_maps = facts.cells.select(*BUILD_MAP).distinct()
    listed = resolve.layer_cells(facts.cells).unionByName(
        resolve.override_cells(build_maps, facts.overrides)
    )
    lost = facts.cdn_missing.select("hash", F.lit(True).alias("cdn_missing"))
    return (
        resolve.resolve(listed, facts.file_index)
        .join(lost, "hash", "left")
        .withColumn("cdn_missing", F.coalesce("cdn_missing", F.lit(False)))
    )


def composition_layers(tiles: DataFrame, sizes: DataFrame) -> DataFrame:
    """Composition rows of layers that have a tile, with size and missing list."""
    composed = compose.compositions(tiles, LAYER, cdn=True).where(F.col("tiles") > 0)
    return composed.join(compose.composition_tile_sizes(tiles, sizes, LAYER), LAYER)


def area_tables(facts: ScanFacts) -> tuple[DataFrame, DataFrame]:
    """``build_id, area_hash``, and the rows of each distinct area table once.

    A build's area table is hashed row by row, whatever their order; one that repeats rows of another
    is taken as a different one. Without ``build_id`` all builds share one table, whose hash is empty.
    """
    builds = facts.cells.select("build_id").distinct()
    if "build_id" not in facts.areas.columns:
        shared = F.lit("").alias("area_hash")
        return builds.select("build_id", shared), facts.areas.select("*", shared)
    columns = [c for c in facts.areas.columns if c != "build_id"]
    row = F.md5(F.to_json(F.struct(*columns)).cast("binary"))
    # sums of two halves of the rows' hashes do not depend on their order, and no table lies in one row
    halves = [F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(20,0)")) for at in (1, 16)]
    whole = F.concat_ws("-", F.count(F.lit(1)), *halves)
    hashed = checkpointed(
        facts.areas.groupBy("build_id").agg(F.md5(whole.cast("binary")).alias("area_hash"))
    )
    firsts = hashed.groupBy("area_hash").agg(F.min("build_id").alias("build_id"))
    distinct = facts.areas.join(firsts, "build_id").select("area_hash", *columns).distinct()
    of_build = builds.join(hashed, "build_id", "left").select(
        "build_id", F.coalesce("area_hash", F.lit("")).alias("area_hash")
    )
    return of_build, checkpointed(distinct)


def listed_terrain(facts: ScanFacts) -> DataFrame:
    """``build_id, map_id, x, y, hash`` of every terrain file that the builds list."""
    index = facts.adt_index.select("build_id", F.col("fdid").alias("root_adt"), "adt_hash")
    return (
        facts.cells.where(F.col("root_adt") != 0)
        .join(index, ["build_id", "root_adt"])
        .select(*BUILD_MAP, "x", "y", F.col("adt_hash").alias("hash"))
    )


def extracted(facts: ScanFacts, listed: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The extraction rows of the listed terrain files, and those of them that are new.

    Files that an earlier scan has packed, the rows of ``known``, are taken from there; of the others
    each is packed once, whoever lists it.
    """
    wanted = listed.select(F.col("hash").alias("adt_hash")).distinct()
    if known is not None:
        old = known.join(wanted, "adt_hash", "left_semi")
        wanted = wanted.join(known.select("adt_hash"), "adt_hash", "left_anti")
    chunks = facts.chunks.join(wanted, "adt_hash", "left_semi")
    fresh = checkpointed(chunk_ops.extractions(chunks, ["adt_hash"]))
    return (fresh if known is None else fresh.unionByName(old.select(*fresh.columns))), fresh


def lacking_data(facts: ScanFacts, layers: DataFrame) -> ScanFacts:
    """The facts of those maps only that do not have both data layers yet."""
    missing = resolve.maps_lacking_data(facts.cells.select(*BUILD_MAP).distinct(), layers)
    return replace(facts, cells=facts.cells.join(missing.select(*BUILD_MAP), BUILD_MAP, "left_semi"))


def data_layers(facts: ScanFacts, listed: DataFrame | None = None, packed: DataFrame | None = None) -> DataFrame:
    """Impassable and area data hashes of every build and map; see ``data_documents``."""
    return data_rows(data_documents(facts, listed, packed))


class DataDocuments(NamedTuple):
    """Data documents told by their hashes, and what makes their texts.

    sets: ``build_id, map_id, set_hash, area_hash``; hashes: ``layer_type, set_hash, area_hash,
    data_hash`` of each distinct set of both; texts: gives ``data_hash, document`` for rows of ``hashes``.
    """

    sets: DataFrame
    hashes: DataFrame
    texts: Callable[[DataFrame], DataFrame]


def data_rows(made: DataDocuments) -> DataFrame:
    """Layer rows of data documents."""
    key = ["set_hash", "area_hash"]
    return made.sets.join(made.hashes.select(*key, "layer_type", "data_hash"), key).select(*LAYER, "data_hash")


def data_documents(
    facts: ScanFacts, listed: DataFrame | None = None, packed: DataFrame | None = None,
    save: Callable[[DataFrame], DataFrame] = checkpointed, most: int = texts.AREA_BYTES,
) -> DataDocuments:
    """The data documents of every build and map.

    Most builds list the same terrain files as the one before. The file lists
    are hashed first and each distinct list makes its documents once, its area
    document once per distinct area table. ``listed`` and ``packed`` are saved
    results of ``listed_terrain`` and ``extracted``, if there are any. Documents are made for their
    hashes and made again where their texts are read, so that none is stored or moved in between.
    Area tables of more than ``most`` bytes of text are not held by tasks but joined.
    """
    of_build, areas = area_tables(facts)
    if listed is None or packed is None:
        listed = checkpointed(listed_terrain(facts))
        packed, _ = extracted(facts, listed)
    sets = save(
        compose.compositions(listed, BUILD_MAP)
        .join(of_build, "build_id")
        .select(*BUILD_MAP, F.col("composition_hash").alias("set_hash"), "area_hash")
    )
    key = ["set_hash", "area_hash"]
    firsts = save(sets.groupBy(*key).agg(F.min(F.struct(*BUILD_MAP)).alias("_f")).select(*key, "_f.*"))
    count = firsts.count()
    fields = [c for c in areas.columns if c not in ("area_hash", "area_id", "parent_id")]
    text = F.concat(F.lit('"'), F.col("area_id").cast("string"), F.lit('":'), F.to_json(F.struct(*fields)))
    tables = texts.area_tables(areas.select("area_hash", "area_id", "parent_id", text.alias("text")), most)
    if tables is None:
        rows = save(_joined_documents(listed, packed, areas, firsts, count))
        return DataDocuments(sets, rows.drop("document"), lambda wanted: _of(rows, wanted).select("data_hash", "document"))
    # a map has no more sets than builds
    number = F.row_number().over(Window.partitionBy("map_id").orderBy("build_id")) - 1
    piece, slot = F.floor(number / texts.SETS_PER_PIECE), number % texts.SETS_PER_PIECE
    placed = save(firsts.select(*key, *BUILD_MAP, piece.cast("int").alias("piece"), slot.cast("int").alias("slot")))
    members = listed.join(placed, BUILD_MAP).select("map_id", "piece", "slot", "x", "y", F.col("hash").alias("adt_hash"))
    tiles = save(texts.pieces(members, packed))
    hashes = save(texts.documents(tiles, placed, tables, count, written=False))

    def written(wanted: DataFrame) -> DataFrame:
        of_kind = [F.max(F.when(F.col("layer_type") == n, F.col("data_hash"))).alias(c) for n, c in ((3, "flags_hash"), (4, "areas_hash"))]
        asked = placed.join(_of(hashes, wanted).groupBy(*key).agg(*of_kind), key)
        return texts.documents(tiles, asked, tables, count, written=True).select("data_hash", "document")

    return DataDocuments(sets, hashes, written)


def _of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of some documents."""
    key = ["layer_type", "set_hash", "area_hash"]
    return rows.join(wanted.select(*key), key, "left_semi")


def _joined_documents(listed: DataFrame, packed: DataFrame, areas: DataFrame, firsts: DataFrame, count: int) -> DataFrame:
    """``layer_type, set_hash, area_hash, data_hash, document``, where no task can hold the area tables."""
    key = ["set_hash", "area_hash"]
    members = listed.join(firsts, BUILD_MAP).select(*key, "x", "y", F.col("hash").alias("adt_hash"))
    owned = F.array_distinct("area_ids").alias("owned")
    grids = members.join(packed.select("adt_hash", "bits", "area_text", owned), "adt_hash").drop("adt_hash")
    parents = areas.select("area_hash", "area_id", "parent_id")
    both = chunk_ops.data_documents(
        grids,
        areas.drop("parent_id"),
        key,
        lambda areas_: area_ops.ancestor_closure(areas_, parents, key, ["area_hash"], placed=True),
        count,
    )
    made = F.inline(
        F.array(
            F.struct(F.lit(3).alias("layer_type"), F.col("flags").alias("document")),
            F.struct(F.lit(4).alias("layer_type"), F.col("area").alias("document")),
        )
    )
    rows = both.select(*key, made).where(F.col("document").isNotNull())
    return rows.select("layer_type", *key, F.md5(F.col("document").cast("binary")).alias("data_hash"), "document")


def distinct_documents(made: DataDocuments, stored: DataFrame | None = None, save: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """``data_hash, document`` of each content once, without those ``stored``; no document moves to be compared."""
    key = ["layer_type", "set_hash", "area_hash"]
    firsts = made.hashes.groupBy("data_hash").agg(F.min(F.struct(*key)).alias("_f"))
    if stored is not None:
        firsts = firsts.join(stored, "data_hash", "left_anti")
    return made.texts(save(firsts.select("_f.*")))


def contents(tiles: DataFrame, composed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``composition_hash, x, y, hash, cdn_missing`` of each distinct composition once.

    Most builds repeat the compositions of the one before. Those in ``known`` are left out.
    """
    fresh = composed if known is None else composed.join(known, "composition_hash", "left_anti")
    firsts = fresh.groupBy("composition_hash").agg(F.min(F.struct(*LAYER)).alias("_f"))
    return tiles.join(firsts.select("composition_hash", "_f.*"), LAYER).select(
        "composition_hash", "x", "y", "hash", "cdn_missing"
    )


def composition_rows(held: DataFrame, composed: DataFrame) -> DataFrame:
    """``hash, document, tiles, x0, y0, x1, y1`` of each composition in ``held``."""
    columns = ["tile_size", "tiles", "x0", "y0", "x1", "y1"]
    facts = composed.groupBy("composition_hash").agg(F.min(F.struct(*columns)).alias("_f")).select("composition_hash", "_f.*")
    sized = held.join(facts.select("composition_hash", "tile_size"), "composition_hash")
    docs = documents.composition_documents(sized, ["composition_hash"])
    return docs.join(facts, "composition_hash").select(
        F.col("composition_hash").alias("hash"), "document", *columns[1:]
    )


def pyramid_rows(held: DataFrame, sizes: DataFrame) -> DataFrame:
    """``composition_hash, level, x, y, hash, tile_size`` of each composition in ``held``."""
    return lod.sized_cells(compose.sized(held.where(lod.held_in_grid()), sizes), ["composition_hash"])


def layers_seen(facts: ScanFacts, tiles: DataFrame, listed: DataFrame) -> DataFrame:
    """``map_id, layer_type`` of the layers that a scan makes, told without making any document."""
    shown = tiles.where(F.col("hash").isNotNull()).select("map_id", "layer_type").distinct()
    files = listed.select("map_id", F.col("hash").alias("adt_hash")).distinct()
    kinds = chunk_ops.data_kinds(facts.chunks, ["adt_hash"])
    code = F.when(F.col("flagged"), F.array(F.lit(3), F.lit(4))).otherwise(F.array(F.lit(4)))
    data = files.join(kinds, "adt_hash").select("map_id", F.explode(code).alias("layer_type")).distinct()
    return shown.unionByName(data)


#: What a scan makes; see ``scan_builds``.
RESULTS = (
    "tiles", "build_maps", "layers", "masks", "work_list", "tile_metadata", "compositions", "pyramid", "tile_sizes",
    "extractions", "blobs", "maps", "name_changes",
)


def scan_builds(facts: ScanFacts, known: DataFrame | None = None, wanted: Collection[str] = RESULTS) -> dict[str, DataFrame]:
    """All catalogue rows that a scan of the builds in ``facts`` produces, or those of them ``wanted``.

    ``tiles, build_maps, layers, masks, work_list, tile_metadata``; ``compositions``, ``pyramid`` and
    ``tile_sizes`` of compositions whose ``composition_hash`` is not in ``known``, each made once
    however many builds show it; ``extractions`` of terrain files; ``blobs`` (``data_hash,
    document``); and where map tables are read ``maps`` with their masks and ``name_changes``.
    Steps that nothing wanted reads are left out; each result has all its rows whatever else is wanted.
    """

    def asked(*names: str) -> bool:
        return any(n in wanted for n in names)

    out = {}
    shown = asked("layers", "compositions", "pyramid", "tile_sizes")
    # results below read these several times, so the joins run once
    if shown or asked("tiles", "masks", "work_list", "tile_metadata", "maps"):
        tiles = checkpointed(layer_tiles(facts))
    if asked("layers", "compositions"):
        composed = checkpointed(composition_layers(tiles, facts.sizes))
    elif shown:  # hashes only
        composed = checkpointed(compose.compositions(tiles, LAYER).where(F.col("tiles") > 0).select(*LAYER, "composition_hash"))
    if asked("layers", "blobs", "extractions", "masks", "maps"):
        listed = checkpointed(listed_terrain(facts))
    if asked("layers", "blobs", "extractions"):
        packed, _ = extracted(facts, listed)
        out["extractions"] = packed
    if asked("layers", "blobs"):
        made = data_documents(facts, listed, packed)
    if asked("blobs"):
        out["blobs"] = distinct_documents(made)
    if asked("layers"):
        out["layers"] = composed.select(
            *LAYER,
            "composition_hash",
            F.lit(None).cast("string").alias("data_hash"),
            "cdn_missing",
            "tiles",
            "missing",
            "tile_size",
        ).unionByName(data_rows(made), allowMissingColumns=True)
    if shown:
        held = contents(tiles, composed, known)
        if asked("compositions"):
            out["compositions"] = composition_rows(held, composed)
        if asked("pyramid", "tile_sizes"):
            out["pyramid"] = pyramid_rows(held, facts.sizes)
            out["tile_sizes"] = out["pyramid"].groupBy("hash").agg(F.max("tile_size").alias("tile_size"))
    if asked("masks", "maps"):
        seen = layers_seen(facts, tiles, listed)
        out["masks"] = merge.layer_masks(seen)
    if asked("tiles", "work_list", "tile_metadata"):
        out["tiles"] = tiles
        out["work_list"] = resolve.unknown(resolve.distinct_hashes(tiles), facts.sizes)
        out["tile_metadata"] = resolve.first_metadata(tiles)
    if asked("build_maps"):
        out["build_maps"] = resolve.tile_counts(facts.cells)
    if facts.maps is not None and asked("maps", "name_changes"):
        maps, out["name_changes"] = merge.merge_maps(facts.maps)
        if asked("maps"):
            out["maps"] = merge.merge_masks(maps.withColumn("layer_mask", F.lit(0)), seen)
    return {name: out[name] for name in wanted if name in out}
