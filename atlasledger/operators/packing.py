"""Packing an ordered message log into size-capped batches.

Messages join a batch with a line break between them until the next one would
take it past the cap; a longer message is a batch of its own. Where a message
lands depends on all before it, so a key is a sequence. A key small enough
for one task is walked at once. A hot key is cut into pieces: every piece is
first summarised by what it does to each possible fill of the open batch (the
cap bounds how many there are), the short list of summaries is chained, and
then all pieces are walked again side by side from their true start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atlasledger.operators.ordered import _pieces, _spanning, has_hot_key, join_carried
from atlasledger.session import checkpointed

# Fixed value: characters one posted message may have.
MESSAGE_CAP = 2000


def assign_batches(
    lengths: np.ndarray, fill: int = 0, batch: int = 0, cap: int = MESSAGE_CAP
) -> tuple[np.ndarray, np.ndarray]:
    """Batch number of each message, and the fill of the open batch after it."""
    numbers = np.empty(len(lengths), dtype=np.int64)
    fills = np.empty(len(lengths), dtype=np.int32)
    for i, length in enumerate(lengths.tolist()):
        if fill > 0 and fill + length + 1 > cap:
            batch += 1
            fill = length
        else:
            fill = fill + 1 + length if fill > 0 else length
        # anything at or above the cap closes on the next message alike
        fill = min(fill, cap)
        numbers[i], fills[i] = batch, fill
    return numbers, fills


def summarise(lengths: np.ndarray, cap: int = MESSAGE_CAP) -> tuple[np.ndarray, np.ndarray]:
    """What a run of messages makes of each starting fill 0..cap.

    Returns the fill after the run and the number of batches closed in it.
    Starting fills that have met continue as one, so the work soon falls to a
    few values per message.
    """
    group = np.arange(cap + 1)
    fills = np.arange(cap + 1)
    closed = np.zeros(cap + 1, dtype=np.int64)
    since = np.zeros(cap + 1, dtype=np.int64)
    for i, length in enumerate(lengths.tolist()):
        full = (fills > 0) & (fills + length + 1 > cap)
        since += full
        fills = np.where(full | (fills == 0), length, fills + 1 + length)
        fills = np.minimum(fills, cap)
        if i % 16 == 0 or i == len(lengths) - 1:
            closed += since[group]
            fills, merged = np.unique(fills, return_inverse=True)
            group = merged[group]
            since = np.zeros(len(fills), dtype=np.int64)
    return fills[group], closed


def pack_messages(
    log: DataFrame, keys: list[str], order: list[str], text: str, cap: int = MESSAGE_CAP
) -> DataFrame:
    """``keys, order, batch_no, length`` of every message; only lengths travel.

    A null message has no characters; a null key is a key.
    """
    return pack_onto(log, keys, order, text, None, cap).drop("fill")


def pack_onto(
    log: DataFrame,
    keys: list[str],
    order: list[str],
    text: str,
    opened: DataFrame | None,
    cap: int = MESSAGE_CAP,
    save: Callable[[DataFrame], DataFrame] = checkpointed,
) -> DataFrame:
    """``pack_messages`` that goes on where earlier messages ended, with ``fill`` after each message.

    ``opened`` has ``keys, batch_no, fill`` of the batch that each key has open, as ``open_batches``
    makes it; keys without a row start at batch 0. The pieces of hot keys are handed to ``save``.
    """
    length = F.coalesce(F.length(text), F.lit(0))
    slim = log.select(*keys, *order, length.alias("length"))
    if has_hot_key(slim, keys):
        work = _pieces(slim, keys, order, save)
        starts = _piece_starts(work, keys, order, opened, cap)
    else:
        work = slim.withColumn("_piece", F.lit(0))
        starts = None if opened is None else _starts(opened, keys).withColumn("_piece", F.lit(0))
    if starts is not None:
        work = join_carried(work, starts, keys)
    else:
        work = work.withColumn("_fill", F.lit(0)).withColumn("_batch", F.lit(0).cast("bigint"))
    work = work.withColumn("_fill", F.coalesce("_fill", F.lit(0))).withColumn(
        "_batch", F.coalesce("_batch", F.lit(0).cast("bigint"))
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields)

    # sequences lie one after the other in a task, so short ones cost no call of their own
    first = F.row_number().over(W.partitionBy(*keys, "_piece").orderBy(*order)) == 1
    columns = [*keys, *order, "length"]

    def walk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, fill = 0, 0
        for part in parts:
            lengths, begins, batches, filled = (
                part.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_first", "_batch", "_fill")
            )
            numbers, fills = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int32)
            at = np.flatnonzero(begins).tolist()
            for lo, hi in zip([0, *at], [*at, len(lengths)]):
                if lo == hi:
                    continue
                if begins[lo]:
                    batch, fill = int(batches[lo]), int(filled[lo])
                numbers[lo:hi], fills[lo:hi] = assign_batches(lengths[lo:hi], fill, batch, cap)
                batch, fill = int(numbers[hi - 1]), int(fills[hi - 1])
            out = [part.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*out, pa.array(numbers), pa.array(fills)], [*columns, "batch_no", "fill"])

    return work.withColumn("_first", first).mapInArrow(walk, f"{schema}, batch_no bigint, fill int")


def open_batches(packed: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, batch_no, fill`` of the batch that each key of ``pack_onto``'s rows has open.

    Numbers never fall, nor does the fill within a batch, so it is a plain maximum.
    """
    last = packed.groupBy(*keys).agg(F.max(F.struct("batch_no", "fill")).alias("_last"))
    return last.select(*keys, "_last.batch_no", "_last.fill")


def _starts(opened: DataFrame, keys: list[str]) -> DataFrame:
    return opened.select(*keys, F.col("fill").alias("_fill"), F.col("batch_no").alias("_batch"))


def _piece_starts(
    work: DataFrame, keys: list[str], order: list[str], opened: DataFrame | None, cap: int
) -> DataFrame:
    """Open fill and batch number at the start of each piece."""
    types = dict(work.dtypes)
    key_schema = ", ".join(f"{k} {types[k]}" for k in keys)

    def effect(part: pd.DataFrame) -> pd.DataFrame:
        fills, closed = summarise(part.sort_values(order)["length"].to_numpy(), cap)
        row = {k: [part[k].iloc[0]] for k in (*keys, "_piece")}
        return pd.DataFrame({**row, "fills": [fills], "closed": [closed]})

    def chain(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("_piece")
        fill, batch, starts = int(parts["_fill"].iloc[0]), int(parts["_batch"].iloc[0]), []
        for fills, closed in zip(parts["fills"], parts["closed"]):
            starts.append((fill, batch))
            fill, batch = int(fills[fill]), batch + int(closed[fill])
        parts["_fill"] = [s[0] for s in starts]
        parts["_batch"] = [s[1] for s in starts]
        return parts[[*keys, "_piece", "_fill", "_batch"]]

    pieces = work.select(*keys, "_piece").distinct()
    zero = [F.lit(0).alias("_fill"), F.lit(0).cast("bigint").alias("_batch")]
    if opened is None:
        first = pieces.select("*", *zero)
    else:
        at = pieces.withColumnRenamed("_piece", "_at").withColumn("_piece", F.lit(0))
        held = join_carried(at, _starts(opened, keys).withColumn("_piece", F.lit(0)), keys)
        first = held.select(
            *keys, F.col("_at").alias("_piece"),
            F.coalesce("_fill", zero[0]).alias("_fill"), F.coalesce("_batch", zero[1]).alias("_batch"),
        )
    cut = _spanning(pieces, keys)
    effects = (
        join_carried(work, cut.withColumn("_cut", F.lit(True)), keys)
        .where("_cut")
        .groupBy(*keys, "_piece")
        .applyInPandas(effect, f"{key_schema}, _piece int, fills array<bigint>, closed array<bigint>")
    )
    chained = (
        join_carried(effects, first, keys)
        .groupBy(*keys)
        .applyInPandas(chain, f"{key_schema}, _piece int, _fill int, _batch bigint")
    )
    told = chained.withColumnsRenamed({"_fill": "_fill1", "_batch": "_batch1"})
    return join_carried(first, told, keys).select(
        *keys, "_piece",
        F.coalesce("_fill1", "_fill").alias("_fill"), F.coalesce("_batch1", "_batch").alias("_batch"),
    )


def batch_summaries(packed: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First and last message, count and posted length of each batch."""
    return packed.groupBy(*keys, "batch_no").agg(
        F.min(order).alias(f"first_{order}"),
        F.max(order).alias(f"last_{order}"),
        F.count(F.lit(1)).alias("messages"),
        (F.sum("length") + F.count_if(F.col("length") >= 0) - 1).alias("chars"),
    )
