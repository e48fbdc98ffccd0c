"""MinHash near-duplicates with fast similarity sketches.

Sketch (Dahlgaard, Knudsen, Thorup, "Fast Similarity Sketching", 2017): in round ``i < t`` every
shingle is thrown into a hashed one of ``t`` bins; in round ``t + j`` every shingle goes to bin
``j``, so no bin stays empty; a bin keeps the least (round, hash). Rounds stop once all bins of a
document are filled, which takes one or two rounds for a long text. Bins agree with probability
equal to the Jaccard similarity, with the concentration of independent MinHash.

Banding: ``BANDS`` bands of ``ROWS`` bins. At similarity 0.85 a pair shares no band with
probability ``(1 - 0.85 ** 5) ** 32 = 7e-9``, at 0.8 with ``3e-6``.

Work is on distinct shingle sets, numbered once they are known, so copies cost one aggregate and ids
decide nothing but a component's name. In a band's group every set is first compared with the group's
least one only. In groups that this leaves unconnected, the sets outside the group's largest component
are compared with all others, in blocks of ``BLOCK`` sets and ``BLOCK_BYTES`` of text, so a group of
any size is split over tasks and no link is lost. Links are confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasledger.llm import tokens
from atlasledger.llm import words as W
from atlasledger.llm.components import components
from atlasledger.session import Scratch, small_batches

SHINGLE = 5
BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
BLOCK, BLOCK_BYTES = 4096, 8 << 20
#: Least similarity, in percent, that bands and ``SURE`` are made for.
LEAST_PERCENT = 80
#: Bins of two sketches that agree at least, else a pair is not looked at: 100 of 160 when links take
#: 0.8 or more, where a link has fewer with probability below 3e-6 (0.85: 4e-11).
SURE = 100
_FREE = np.uint64((1 << 64) - 1)


def shingles(column: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Distinct shingles of each row as sorted 64-bit hashes, some rows at a time.

    Gives ``(first row, bounds, hashes)``; the hashes of row ``first + k`` lie between ``bounds[k]``
    and ``bounds[k + 1]``. A row of fewer words has its whole sequence as one, one of none has none.
    """
    _, bounds = W.buffers(column)
    for a, b in W.slices(bounds):
        found = W.split(*W.buffers(column[a:b]))
        hashed = W.hashes(found, lower=True)
        runs = W.windows(hashed, size)
        parts, count = [], np.diff(found.first)
        for k in range(b - a):
            n, at = int(count[k]), int(found.first[k])
            if n >= size:
                parts.append(np.sort(runs[at : at + n - size + 1]))
            else:
                parts.append(W.windows(hashed[at : at + n], n) if n else runs[:0])
        flat = np.concatenate(parts) if parts else runs[:0]
        row = np.repeat(np.arange(b - a), [len(p) for p in parts])
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
        flat, row = flat[new], row[new]
        yield a, np.searchsorted(row, np.arange(b - a + 1)), flat


def sketch(bounds: np.ndarray, hashed: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The sketch of each set (rows x bins); sets must not be empty."""
    rows = len(bounds) - 1
    out = np.full(rows * bins, _FREE, np.uint64)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    live = np.ones(rows, bool)
    for turn in range(2 * bins):
        value = W.mixed(hashed + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        low = (value >> np.uint64(10)) | np.uint64(turn << 54)
        if turn < bins:
            to = ((value & np.uint64(0xFFFFFFFF)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(out, row * bins + to, low)
        else:
            np.minimum.at(out, row * bins + (turn - bins), low)
        still = np.zeros(rows, bool)
        some = np.flatnonzero(live)
        still[some] = (out.reshape(rows, bins)[some] == _FREE).any(axis=1)
        live = still
        keep = live[row]
        row, hashed = row[keep], hashed[keep]
        if not len(row):
            break
    return out.reshape(rows, bins)


def _banded(found: np.ndarray) -> np.ndarray:
    key = np.zeros((len(found), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = W.mixed(key * np.uint64(0xD1342543DE82EF95) + found[:, k::ROWS])
    return key.view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens.forget()
    for batch in batches:
        ids, texts, prints = batch.columns
        for at, bounds, hashed in shingles(texts):
            rows = len(bounds) - 1
            size = np.diff(bounds)
            some = np.flatnonzero(size)
            keys = np.zeros((rows, BANDS), np.int64)
            marks = np.zeros((rows, BINS), np.uint8)
            if len(some):
                sketched = sketch(np.append(bounds[some], bounds[-1]), hashed)
                keys[some] = _banded(sketched)
                marks[some] = sketched & np.uint64(255)
            total = [np.zeros(rows, np.uint64) for _ in range(2)]
            for k, salt in enumerate((1, 2)):
                run = np.concatenate([[np.uint64(0)], np.cumsum(W.mixed(hashed + np.uint64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)))])
                total[k] = run[bounds[1:]] - run[bounds[:-1]]
            flat = pa.array(keys[some].reshape(-1), pa.int64())
            ends = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
            yield pa.record_batch(
                [
                    ids[at : at + rows],
                    prints[at : at + rows],
                    pa.array(size.astype(np.int64)),
                    pa.array(total[0].view(np.int64)),
                    pa.array(total[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), flat),
                    pa.array([m.tobytes() for m in marks], pa.binary()),
                ],
                ["doc_id", "text_hash", "n_shingles", "h1", "h2", "bands", "marks"],
            )


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs ``a, b, text_a, text_b`` whose full sets are similar enough."""
    for batch in batches:
        keep = []
        left = ((at + k, h[b[k] : b[k + 1]]) for at, b, h in shingles(batch.column(2)) for k in range(len(b) - 1))
        right = (h[b[k] : b[k + 1]] for _, b, h in shingles(batch.column(3)) for k in range(len(b) - 1))
        for (k, x), y in zip(left, right, strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                keep.append(k)
        yield pa.record_batch([c.take(pa.array(keep, pa.int64())) for c in batch.columns[:2]], ["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of whole groups from batches sorted by their first ``keys`` columns."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        last = [held.column(k)[-1].as_py() for k in range(keys)]
        same = np.ones(held.num_rows, bool)
        for k, value in enumerate(last):
            same &= held.column(k).to_numpy() == value
        cut = int(np.argmax(same))
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None:
        yield held


def _met(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links between sets of one group that are in different components.

    Rows ``key, low, high, block, node, component, marks, bands, text`` come sorted by the first
    three. A pair that shares several bands is looked at in the first of them only. Sizes and
    sketches rule out most pairs, full sets decide on the others. A link joins two components at
    once, so what it connects is not compared again.
    """
    for table in _groups(batches, 3):
        key, low, high, block, node = (table.column(k).to_numpy() for k in range(5))
        part = table.column(5).to_numpy().copy()
        marks = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint8).reshape(-1, BINS)
        bands = table.column(7).combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        flat = [(b, h) for _, b, h in shingles(table.column(8).combine_chunks())]
        size = np.concatenate([np.diff(b) for b, _ in flat])
        bound = np.concatenate([[0], np.cumsum(size)])
        hashed = np.concatenate([h for _, h in flat])
        new = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        edge = np.concatenate([[0], np.flatnonzero(new) + 1, [len(key)]])
        out = [[], []]
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if (part[a:b] == part[a]).all():
                continue
            turn = np.argmax(bands[a] == key[a])
            _, named = np.unique(hashed[bound[a] : bound[b]], return_inverse=True)
            seen = np.zeros(len(named), bool)
            far = np.flatnonzero(block[a:b] == high[a]) + a
            for x in (np.flatnonzero(block[a:b] == low[a]) + a).tolist():
                y = far[far > x] if low[a] == high[a] else far
                y = y[part[y] != part[x]]
                y = y[np.minimum(size[y], size[x]) * 100 >= np.maximum(size[y], size[x]) * percent]
                y = y[(marks[y] == marks[x]).sum(axis=1) >= SURE]
                y = y[~(bands[y, :turn] == bands[x, :turn]).any(axis=1)]
                if not len(y):
                    continue
                own = named[bound[x] - bound[a] : bound[x + 1] - bound[a]]
                seen[own] = True
                at = np.concatenate([np.arange(bound[k], bound[k + 1]) for k in y]) - bound[a]
                both = np.add.reduceat(seen[named[at]], np.concatenate([[0], np.cumsum(size[y])[:-1]]), dtype=np.int64)
                seen[own] = False
                y = y[100 * both >= percent * (size[x] + size[y] - both)]
                if len(y):
                    out[0].append(np.maximum(node[y], node[x]))
                    out[1].append(np.minimum(node[y], node[x]))
                    part[a:b][np.isin(part[a:b], part[y])] = part[x]
        if out[0]:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in out], ["a", "b"])


def _unconnected(member: DataFrame, part: DataFrame, sets: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)``, ``a > b``, between sets of one group that no link has joined yet.

    Sets within a group's largest component need not meet. The others are cut into blocks by a hash,
    and so is that component; every two blocks of the others meet in a group of their own, and every
    one of them meets every block of the component. A task holds two blocks.
    """
    member = member.select("key", "node", "bytes").join(part, "node", "left")
    member = member.withColumn("component", F.coalesce("component", "node"))
    each = member.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    top = F.max(F.struct("n", "component", "bytes")).alias("top")
    group = each.groupBy("key").agg(top, F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))

    def blocks(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")

    rest = F.col("n") - F.col("top.n")
    group = group.where(rest > 0).select(
        "key",
        F.col("top.component").alias("largest"),
        blocks(F.col("top.n"), F.col("top.bytes")).alias("inner"),
        blocks(rest, F.col("bytes") - F.col("top.bytes")).alias("outer"),
    )
    member = member.join(group, "key")
    member = member.join(sets.select("node", "marks", "bands"), "node").join(texts.select("node", "text"), "node")
    inner = F.col("component") == F.col("largest")
    at = F.pmod(F.xxhash64("node", "key"), F.when(inner, F.col("inner")).otherwise(F.col("outer"))).cast("int")
    # blocks of the largest component have the numbers -1, -2, ...
    member = member.withColumn("block", F.when(inner, -1 - at).otherwise(at))
    outer = F.sequence(F.lit(0), F.col("outer") - 1)
    every = F.concat(F.sequence(-F.col("inner"), F.lit(-1)), outer)
    met = member.withColumn("other", F.explode(F.when(inner, outer).otherwise(every)))
    met = met.select(
        "key",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        "block", "node", "component", "marks", "bands", "text",
    )
    return (
        met.repartition("key", "low", "high")
        .sortWithinPartitions("key", "low", "high")
        .mapInArrow(lambda it: _met(it, percent), "a long, b long")
        .distinct()
    )


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that are links. The pair side of the joins is the one that may be
    skewed; the text side has one row per document."""
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    joined = joined.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _confirmed(it, percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, kept`` and ``text_hash``, Spark's
    ``xxhash64`` of the text, which tells rows with equal ids apart.

    Two texts are linked if their sets of ``SHINGLE``-word shingles (A-Z lower-cased) have a Jaccard
    similarity of at least ``percent`` / 100, which is ``LEAST_PERCENT`` or more; ``component_id`` is the
    smallest id reachable by links and ``kept`` marks it. Null and wordless texts have no shingles and
    are linked with nothing: their component is their own id. Rows are told apart by their text: a
    repeated row is a copy of itself, and is kept as often as it comes if its id is the component's;
    an id may stand for several texts, each with links of its own. Rows without an id are linked like
    others, but none names a component unless none of it has an id; then the component is null and its
    rows are kept. Only the two named columns are read, whatever others are called.
    Jobs run while the plan is built. Three narrow tables stay in the shared folder until that is
    cleared, as the result reads them; others are deleted at once.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent is {percent}; bands and sketches find links of {LEAST_PERCENT} to 100 percent")
    scratch = Scratch(docs.sparkSession)
    docs = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    rows = scratch.save(
        docs.select("doc_id", "text", "text_hash").mapInArrow(
            _sketched, "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, bands array<long>, marks binary"
        )
    )
    # a set's number, and a row that has its text
    found = rows.where("n_shingles > 0").groupBy("h1", "h2")
    found = found.agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("at"),
        F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("marks").alias("marks"),
    )
    sets = scratch.save(found.withColumn("node", F.monotonically_increasing_id()))
    member = sets.select(F.explode("bands").alias("key"), "node", "n")
    group = member.groupBy("key").agg(
        F.min(F.struct("node", "n")).alias("lead"), F.count("*").alias("size")
    )
    # groups of two or more, with their least set
    member = scratch.save(
        member.join(group.where("size > 1"), "key").select(
            "key", "node", "n", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n")
        )
    )
    near = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    star = scratch.save(
        member.where("node != lead")
        .where(near(F.col("n"), F.col("lead_n")))
        .select(F.col("node").alias("a"), F.col("lead").alias("b"))
        .distinct()
    )
    named = sets.join(member.select("node").distinct(), "node", "left_semi").select("node", "at")
    same = docs["doc_id"].eqNullSafe(F.col("at.doc_id")) & (docs["text_hash"] == F.col("at.text_hash"))
    texts = scratch.save(docs.join(named, same).select("node", "text").dropDuplicates(["node"]))
    links = scratch.save(_verified(star, texts, percent))
    part = scratch.save(components(links, scratch))
    sized = member.select("key", "node").join(texts.select("node", F.octet_length("text").cast("long").alias("bytes")), "node")
    more = scratch.save(_unconnected(sized, part, sets, texts, percent))
    if not more.isEmpty():
        part = scratch.save(components(links.unionByName(more), scratch))
    for done in (member, star, texts, links, more):  # all that follows reads rows, sets and part
        scratch.drop(done)
    # each component's least id, back to its sets
    named = sets.select("h1", "h2", "node", "least").join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    least = named.join(least, "component").select("h1", "h2", "component_id")
    linked = rows.where("n_shingles > 0").join(least, ["h1", "h2"], "left")
    alone = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return (
        linked.select("doc_id", "n_shingles", "component_id", "text_hash")
        .unionByName(alone.select("doc_id", "n_shingles", "component_id", "text_hash"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
