"""Exact repeats of word runs, found from fixed-block anchors.

Every document is laid out in non-overlapping reference blocks of ``(width + 1) // 2`` words; any
run of ``width`` words holds one whole block. Every rolling window of block length probes the block
index. Around hits, runs of ``width`` words are compared by fingerprints (62 bits within a bucket
that an independent hash gives), and words covered by a run that occurs elsewhere make up the maximal
repeats.

Documents are dealt into groups of some megabytes by a hash of id and text, so neither a source nor
a set of copies meets in one group. What is exchanged are sorted hash sets as packed bytes, one per
(group, bucket of hash space): a passage that a third of all documents share is one entry per group.
Buckets and groups grow in number, not in size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from atlasledger.llm import tokens
from atlasledger.llm import words as W
from atlasledger.session import small_batches

WIDTH = 35
GROUP_BYTES = 8 << 20
_PACKED = "bucket long, part long, packed binary"
_LOW = np.uint64((1 << 38) - 1)


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return (values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _five(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _bucketed(part: int, bucket: np.ndarray, values: np.ndarray, pack: Callable[[np.ndarray], bytes]) -> pa.Table:
    """One row per bucket; ``bucket`` is sorted."""
    named, at = np.unique(bucket, return_index=True)
    ends = np.append(at, len(bucket))[1:]
    packed = [pack(values[a:b]) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
    return pa.table({"bucket": pa.array(named.astype(np.int64)), "part": pa.array([part] * len(named), pa.int64()), "packed": pa.array(packed, pa.binary())})


def _texts(table: pa.Table, text_col: str) -> pa.Array:
    column = table.column("row").combine_chunks()
    return pa.StructArray.field(column, column.type.get_field_index(text_col))


def _probe_sets(table: pa.Table, text_col: str, block: int, buckets: int) -> pa.Table:
    """The group's rolling windows, once each, with two marks: is it a reference block, comes it twice."""
    tokens.forget()
    part = table.column("part")[0].as_py()
    found = []
    texts = _texts(table, text_col)
    for a, b in W.slices(W.buffers(texts)[1]):
        words = W.split(*W.buffers(texts[a:b]))
        whole = W.whole_windows(words, block)
        runs = W.windows(W.hashes(words), block)[whole]
        anchor = ((np.arange(len(whole)) - words.first[words.row[: len(whole)]]) % block == 0)[whole]
        found.append(runs >> np.uint64(1) << np.uint64(1) | anchor.astype(np.uint64))
    runs = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    if not len(runs):
        return _bucketed(part, runs, runs, _five)
    kept = runs >> np.uint64(1)
    at = np.concatenate([[0], np.flatnonzero(kept[1:] != kept[:-1]) + 1])
    twice = (np.diff(np.append(at, len(runs))) > 1).astype(np.uint64)
    anchor = np.bitwise_or.reduceat(runs & np.uint64(1), at)
    kept = kept[at]
    return _bucketed(part, _bucket(kept << np.uint64(1), buckets), (kept & _LOW) << np.uint64(2) | twice << np.uint64(1) | anchor, _five)


def _shared(table: pa.Table, unpack: Callable[[bytes], np.ndarray], anchored: bool) -> pa.Table:
    """Of one bucket, each group's values that come twice in all (``anchored``: and hit a block)."""
    packed = table.column("packed").to_pylist()
    values = [unpack(p) for p in packed]
    group = np.repeat(np.arange(len(values)), [len(v) for v in values])
    flat = np.concatenate(values)
    marks = flat & np.uint64(3)
    flat = flat >> np.uint64(2)
    order = np.argsort(flat, kind="stable")
    near = flat[order]
    at = np.concatenate([[0], np.flatnonzero(near[1:] != near[:-1]) + 1])
    size = np.diff(np.append(at, len(near)))
    count = np.add.reduceat(1 + (marks[order] >> np.uint64(1)).astype(np.int64), at)
    good = count > 1
    if anchored:
        good &= np.bitwise_or.reduceat(marks[order] & np.uint64(1), at) > 0
    hot = np.zeros(len(flat), bool)
    hot[order] = np.repeat(good, size)
    flat, group = flat[hot], group[hot]
    edge = np.searchsorted(group, np.arange(len(values) + 1))
    some = [k for k in range(len(values)) if edge[k + 1] > edge[k]]
    return pa.table(
        {
            "bucket": table.column("bucket").combine_chunks().take(pa.array(some, pa.int64())),
            "part": table.column("part").combine_chunks().take(pa.array(some, pa.int64())),
            "packed": pa.array([flat[edge[k] : edge[k + 1]].tobytes() for k in some], pa.binary()),
        }
    )


def _known(hits: pa.Table, shift: int) -> np.ndarray:
    """A group's values out of all buckets as sorted 64-bit keys."""
    parts = [
        _key(np.frombuffer(packed, np.uint64), np.array([bucket], np.uint64), shift)
        for bucket, packed in zip(hits.column("bucket").to_pylist(), hits.column("packed").to_pylist(), strict=True)
    ]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _key(values: np.ndarray, bucket: np.ndarray, shift: int) -> np.ndarray:
    """``shift`` 38: bucket and value side by side; 0: hashed together."""
    return bucket << np.uint64(shift) | values if shift else W.mixed(values + bucket * np.uint64(0x9E3779B97F4A7C15))


def _within(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _spread(hit: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """Places from ``before`` ahead of a hit to ``after`` behind it, of ``n``."""
    at = np.flatnonzero(hit)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.maximum(at - before, 0), 1)
    np.add.at(step, np.minimum(at + after + 1, n), -1)
    return np.cumsum(step[:-1]) > 0


def _prints(hashed: np.ndarray, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 62-bit value of every run; both come of independent hashes."""
    return _bucket(W.windows(hashed, width, 1), buckets), W.windows(hashed, width, 2) >> np.uint64(2)


def _run_sets(table: pa.Table, hits: pa.Table, text_col: str, block: int, width: int, buckets: int, runs: int) -> pa.Table:
    """The group's runs of ``width`` words that hold an anchor hit, once each."""
    known = _known(hits, 38)
    texts = _texts(table, text_col)
    found = [[], []]
    for a, b in W.slices(W.buffers(texts)[1]):
        words = W.split(*W.buffers(texts[a:b]))
        hashed = W.hashes(words)
        probes = W.windows(hashed, block)
        hit = _within(_key(probes >> np.uint64(1) & _LOW, _bucket(probes >> np.uint64(1) << np.uint64(1), buckets), 38), known) & W.whole_windows(words, block)
        whole = W.whole_windows(words, width)
        # an anchor lies in the run: it starts 0 to width - block words behind the run's start
        near = _spread(hit, width - block, 0, len(hit))[: len(whole)] & whole
        if near.any():
            bucket, value = _prints(hashed, width, runs)
            found[0].append(bucket[near])
            found[1].append(value[near])
    part = table.column("part")[0].as_py()
    if not found[0]:
        none = np.zeros(0, np.uint64)
        return _bucketed(part, none, none, np.ndarray.tobytes)
    bucket, value = (np.concatenate(f) for f in found)
    order = np.lexsort((value, bucket))
    bucket, value = bucket[order], value[order]
    at = np.concatenate([[0], np.flatnonzero((value[1:] != value[:-1]) | (bucket[1:] != bucket[:-1])) + 1])
    twice = (np.diff(np.append(at, len(value))) > 1).astype(np.uint64)
    return _bucketed(part, bucket[at], value[at] << np.uint64(2) | twice << np.uint64(1), np.ndarray.tobytes)


def _cleaned(table: pa.Table, hits: pa.Table, text_col: str, width: int, runs: int) -> pa.Table:
    """Each row with what is left of its text."""
    known = _known(hits, 0)
    texts = _texts(table, text_col)
    total, gone, left, spans = [], [], [], []
    for a, b in W.slices(W.buffers(texts)[1]):
        words = W.split(*W.buffers(texts[a:b]))
        hashed = W.hashes(words)
        bucket, value = _prints(hashed, width, runs)
        hit = _within(_key(value, bucket, 0), known) & W.whole_windows(words, width)
        cover = _spread(hit, 0, width - 1, len(hashed))
        count = np.concatenate([[0], np.cumsum(cover)])
        total.append(np.diff(words.first))
        gone.append(count[words.first[1:]] - count[words.first[:-1]])
        data = words.data.tobytes()
        # copy from run to run of kept words: bytes of a run, its white space made one space
        for k in range(b - a):
            x, y = int(words.first[k]), int(words.first[k + 1])
            own = cover[x:y]
            begin = np.flatnonzero(own & ~np.concatenate([[False], own[:-1]])) if y > x else own
            end = np.flatnonzero(own & ~np.concatenate([own[1:], [False]])) + 1 if y > x else own
            spans.append([{"first": int(p), "end": int(q)} for p, q in zip(begin, end, strict=True)])
            edges, parts = [0, *np.stack([begin, end], 1).reshape(-1).tolist(), y - x] if y > x else [], []
            for p, q in zip(edges[::2], edges[1::2], strict=True):
                if q > p:
                    parts += data[words.start[x + p] : words.end[x + q - 1]].split()
            left.append(b" ".join(parts).decode())
    numbers = lambda p: pa.array(np.concatenate(p) if p else np.zeros(0, np.int64), pa.int64())
    return pa.table(
        {
            "row": table.column("row").combine_chunks(),
            "n_words": numbers(total),
            "n_removed": numbers(gone),
            "kept_text": pa.array(left, pa.string()),
            "removed": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
        }
    )


def repeated_runs(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``row`` (all its columns as a struct, so that no names can clash),
    ``n_words, n_removed, kept_text`` and ``removed``, the maximal runs of removed words as
    ``[first, end)``.

    A word goes if a run of ``width`` words that covers it starts anywhere else too, in the same
    text or another; all occurrences go. Kept words are joined by one space. Null and wordless texts
    come back with no words and an empty text. Repeated rows and rows with equal ids are texts of
    their own. One job adds up the text's bytes while the plan is built.
    """
    if width < 2:
        raise ValueError("width must be 2 or more")
    block = (width + 1) // 2
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(1, math.ceil(size / GROUP_BYTES))
    # a group's hash sets are about as large as its text, so as many buckets as groups
    probes = runs = max(16, parts)
    part = F.pmod(F.xxhash64(id_col, text_col), F.lit(parts)).cast("long")
    dealt = small_batches(docs).select(part.alias("part"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    sets = dealt.groupBy("part").applyInArrow(lambda t: _probe_sets(t, text_col, block, probes), _PACKED)
    hits = sets.groupBy("bucket").applyInArrow(lambda t: _shared(t, _from_five, True), _PACKED)
    runs_of = dealt.groupBy("part").cogroup(hits.groupBy("part")).applyInArrow(
        lambda t, h: _run_sets(t, h, text_col, block, width, probes, runs) if t.num_rows else _none(), _PACKED
    )
    twice = runs_of.groupBy("bucket").applyInArrow(lambda t: _shared(t, lambda p: np.frombuffer(p, np.uint64), False), _PACKED)
    out = (
        StructType()
        .add("row", dealt.schema["row"].dataType)
        .add("n_words", LongType())
        .add("n_removed", LongType())
        .add("kept_text", StringType())
        .add("removed", ArrayType(StructType().add("first", LongType()).add("end", LongType())))
    )
    return dealt.groupBy("part").cogroup(twice.groupBy("part")).applyInArrow(
        lambda t, h: _cleaned(t, h, text_col, width, runs), out
    )


def _none() -> pa.Table:
    none = np.zeros(0, np.uint64)
    return _bucketed(0, none, none, np.ndarray.tobytes)
