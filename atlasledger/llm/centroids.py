"""Centroid clustering of integer vectors by equal-average equal-variance nearest neighbour search.

Search (Ra, Kim 1993; Lee, Chen 1995): with sum ``S`` and spread ``A = n * sum(x * x) - S * S`` of a
vector's ``n`` components, ``n * d(x, c) >= (S_x - S_c) ** 2 + (sqrt(A_x) - sqrt(A_c)) ** 2``.
Centroids are sorted by ``S``, their mean times ``n``. From a vector's own mean the search goes
outwards, the nearer side first: the first bound ends it, as all that follows lies further off, and
both bounds together skip a centroid. What is left is measured in integers, so results are exact;
only the root is rounded, and its bound is lowered by more than it can be off.

A round ships the centroids to the tasks, which give counts and component sums per cluster, each task
once; nothing else is shuffled. Only the centroids ever reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from atlasledger.session import Scratch, small_batches

#: Components beyond this have squared distances that no long holds.
MOST = 1 << 27
ROWS = 4096
#: By how much a root's bound is lowered, as a share of the root and of the largest component: far
#: above what rounding can do.
SLACK, SLACK_EACH = 1e-9, 1e-12


class Clusters(NamedTuple):
    """``rows``: ``row, cluster, distance`` of each kept vector. ``centroids``: the final ones by
    number. ``inertia``: summed distance by cluster."""

    rows: DataFrame
    centroids: list[list[int]]
    inertia: list[int]


def integers(vectors: DataFrame, dim: int, scale: float, vec_col: str, id_col: str) -> DataFrame:
    """``row, vec_id, x``: all other columns as a struct, the id, and the components as integers.

    Only vectors of exactly ``dim`` components, none null, NaN or infinite, are kept.
    """
    rest = [F.col(f"`{c}`") for c in vectors.columns if c != vec_col]
    named = F.struct(*rest) if rest else F.struct(F.lit(None).cast("int").alias("none"))
    rows = vectors.select(named.alias("row"), F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    rows = rows.where((F.size("v") == dim) & finite)
    least, most = F.array_min("v").cast("double"), F.array_max("v").cast("double")
    wide = (least * scale < -MOST) | (most * scale >= MOST)
    told = F.raise_error(F.lit(f"a component times {scale:g} is beyond {MOST}: no long holds its squared distances"))
    whole = F.transform("v", lambda e: F.floor(e.cast("double") * scale).cast("int"))
    return rows.select("row", "vec_id", F.when(wide, F.lit(None)).otherwise(whole).alias("x"), wide.alias("wide")).select(
        "row", "vec_id", F.when(F.col("wide"), told.cast("array<int>")).otherwise(F.col("x")).alias("x")
    )


class Search:
    """The centroids, sorted by mean, with what the bounds need."""

    def __init__(self, centroids: np.ndarray) -> None:
        total = centroids.sum(axis=1)
        self.order = np.lexsort((np.arange(len(total)), total))  # number of the centroid at each place
        self.c = centroids[self.order]
        self.total = total[self.order]
        self.root = _root(self.c, self.total)
        self.most = int(np.abs(centroids).max(initial=0))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid (the smaller at a tie), squared distance, distances measured."""
        n, dim = x.shape
        total = x.sum(axis=1)
        root = _root(x, total)
        least = SLACK_EACH * dim * max(self.most, int(np.abs(x).max(initial=0)))
        high = np.searchsorted(self.total, total)
        low = high - 1
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, len(self.total))
        live = np.arange(n)
        measured, far = 0, np.iinfo(np.int64).max
        while len(live):
            lo, hi, own = low[live], high[live], total[live]
            down = np.where(lo >= 0, own - self.total[np.maximum(lo, 0)], far)
            up = np.where(hi < len(self.total), self.total[np.minimum(hi, len(self.total) - 1)] - own, far)
            take = down <= up
            gap = np.where(take, down, up)
            # the mean alone: the nearer side is out, so all that is left is
            open_ = (gap < far) & (gap <= _limit(best[live], dim))
            live, take, gap = live[open_], take[open_], gap[open_]
            place = np.where(take, low[live], high[live])
            low[live] -= take
            high[live] += ~take
            spread = np.abs(root[live] - self.root[place])
            sure = np.maximum(0, spread - SLACK * (root[live] + self.root[place]) - least)
            bound = gap.astype(float) ** 2 + sure**2
            near = np.flatnonzero(bound * (1 - SLACK) <= dim * best[live].astype(float))
            at, place = live[near], place[near]
            apart = x[at] - self.c[place]
            d = np.einsum("ij,ij->i", apart, apart)
            measured += len(at)
            name = self.order[place]
            better = (d < best[at]) | (d == best[at]) & (name < number[at])
            best[at[better]], number[at[better]] = d[better], name[better]
        return number, best, measured


def _limit(best: np.ndarray, dim: int) -> np.ndarray:
    """The largest gap whose square is not above ``dim * best``, or a little more."""
    return np.floor(np.sqrt(best.astype(float) * dim) * (1 + SLACK) + 1).astype(np.int64)


def _root(x: np.ndarray, total: np.ndarray) -> np.ndarray:
    mean = total / x.shape[1]
    return np.sqrt(x.shape[1]) * np.sqrt(((x - mean[:, None]) ** 2).sum(axis=1))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Count and component sums of each cluster in one task; sums stay below 2 ** 63 for 2 ** 36 rows."""
    search, (k, dim) = Search(centroids), centroids.shape
    count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
    for batch in batches:
        x = _matrix(batch.column(0), dim)
        for a in range(0, len(x), ROWS):
            number, _, _ = search.nearest(x[a : a + ROWS])
            count += np.bincount(number, minlength=k)
            by = np.argsort(number, kind="stable")
            own, first = np.unique(number[by], return_index=True)
            total[own] += np.add.reduceat(x[a : a + ROWS][by], first)
    some = np.flatnonzero(count)
    cluster, place = np.repeat(some, dim), np.tile(np.arange(dim), len(some))
    columns = cluster.astype(np.int32), place.astype(np.int32), count[cluster], total[some].reshape(-1)
    yield pa.record_batch([pa.array(c) for c in columns], ["cluster", "place", "n", "total"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    search, dim = Search(centroids), centroids.shape[1]
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            number, best, _ = search.nearest(_matrix(part.column(1), dim))
            yield pa.record_batch([part.column(0), pa.array(number.astype(np.int32)), pa.array(best)], ["row", "cluster", "distance"])


def _moved(x: DataFrame, now: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    told = x.mapInArrow(lambda it: _sums(it, now), "cluster int, place int, n long, total long")
    # as decimals, so that no sum overflows; tasks have combined their rows already
    sums = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    out = now.copy()
    for r in told.groupBy("cluster", "place").agg(F.sum("n").alias("n"), sums).collect():  # k * dim rows
        out[r.cluster, r.place] = int(r.total) // r.n
    return out


def clusters(
    vectors: DataFrame, scratch: Scratch, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, seed: str = "2",
    vec_col: str = "embedding", id_col: str = "vec_id",
) -> Clusters:
    """``rounds`` of moving ``k`` centroids, then every vector's cluster.

    Vectors other than of ``dim`` finite components are left out. Components are ``floor(scale * x)``.
    The centroids start as the ``k`` vectors with the least SHA-256 of ``<seed>:<id>``; rows of one id
    come by their components, rows without an id after all others, and fewer vectors make fewer
    centroids, none at all an empty result. Repeated rows count as often as they come. Ties go to the
    smaller number, a cluster without vectors keeps its centroid. A component of 2 ** 27 or more after
    scaling is an error, since its distances fit no long. Only the two named columns are read; all but
    the vector come back in ``row``. The vectors stay in ``scratch``, as the result reads them.
    """
    kept = scratch.save(integers(small_batches(vectors), dim, scale, vec_col, id_col))
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(named.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    now = np.array([r.x for r in first], np.int64).reshape(len(first), dim)
    x = kept.select("x")
    schema = StructType([kept.schema["row"]]).add("cluster", IntegerType()).add("distance", LongType())
    if not len(now):
        return Clusters(kept.sparkSession.createDataFrame([], schema), [], [])
    for _ in range(rounds):
        now = _moved(x, now)
    rows = scratch.save(kept.select("row", "x").mapInArrow(lambda it: _assigned(it, now), schema))
    scratch.drop(kept)
    inertia = [0] * len(now)
    for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect():  # one row per cluster
        inertia[r.cluster] = r.d
    return Clusters(rows, now.tolist(), inertia)


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def described(found: Clusters) -> DataFrame:
    """``row, cluster, distance`` with the ``cluster_inertia``, the whole ``inertia`` and the
    ``centroid_sha256``. The centroids' table has ``k`` rows, so it is broadcast."""
    table = [(n, d, digest(c)) for n, (c, d) in enumerate(zip(found.centroids, found.inertia, strict=True))]
    named = found.rows.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(named), "cluster").withColumn("inertia", F.lit(sum(found.inertia)).cast("long"))
