"""Spelling variants: words of a vocabulary one edit apart, found by Bloom-guided neighbourhoods.

Every word's edits are generated as hashes only: a hash is a sum over code points times powers of an
odd number, so an edit changes it by one addition. Each is probed against blocked Bloom filters of
the vocabulary, one per word length, that are broadcast. What the filters let through, neighbours and
a few false positives, is shuffled to an exact join with the vocabulary.

Of two words that differ by one replacement, the one with the smaller letter finds the other, and the
longer word finds the shorter by deletion, so every pair is found exactly once.

The filters have ``BITS`` bits a word and are built in tasks, chunk by chunk. A pass broadcasts at
most ``FILTER_BYTES``; a larger vocabulary takes several passes over the words, each with a range of
the filters' blocks, so nothing that is broadcast grows with the corpus.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasledger.llm import tokens
from atlasledger.llm import words as W
from atlasledger.session import Scratch, small_batches

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Bits of the filters per word; a word sets eight, one in each 64-bit part of its block.
BITS, BLOCK_BITS = 16, 512
FILTER_BYTES = 64 << 20
CHUNK_BLOCKS = 4096
#: Longer words share one filter; their hashes tell lengths apart.
LONGEST = 64
#: Edits generated at once, distinct words that a task counts before it hands them on, words in a task.
EDITS, HELD, TASK_WORDS = 1 << 19, 400_000, 20_000
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_SALTS = np.array([0x47B6137B44974D91, 0x8824AD5BA2B7289D, 0x705495C72DF1424B, 0x9EFC49475C6BFB31], np.uint64)
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CRC = np.array([~zlib.crc32(bytes([k ^ 255])) & 0xFFFFFFFF ^ 0x00FFFFFF for k in range(256)], np.uint32)
_VOCABULARY = "word string, n long, shard int, h long, letters0 long, letters1 long"


# -- words and their counts


def _crc32s(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each run of bytes, continued from ``state``, the CRC of what stands before it."""
    crc = ~state
    left = np.flatnonzero(size <= 64)
    at = 0
    while len(left):
        own = crc[left]
        crc[left] = _CRC[(own ^ data[start[left] + at]) & np.uint32(255)] ^ (own >> np.uint32(8))
        at += 1
        left = left[size[left] > at]
    crc = ~crc
    for k in np.flatnonzero(size > 64):
        crc[k] = zlib.crc32(data[start[k] : start[k] + size[k]].tobytes(), int(state[k]))
    return crc


def _runs(ids: pa.Array, texts: pa.Array, least: int, slips: int) -> pa.Table:
    """``word, n`` of some rows: runs of letters, lower-cased, of ``least`` code points or more."""
    data, bounds = W.buffers(texts)
    if not len(data):
        return pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
    # in UTF-8 the letters U+00C0 to U+00FF are the byte C3 and one more, and no others begin so
    lead = data == 0xC3
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    low = _LOWER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    before = np.concatenate([[0], np.cumsum(lead)])
    long = end - start - (before[end] - before[start]) >= least
    start, end = start[long], end[long]
    extra = []
    if slips and len(start):
        named = [zlib.crc32(b":" if i is None else b"%d:" % i) for i in ids.to_pylist()]
        row = np.searchsorted(bounds, start, "right") - 1
        h = _crc32s(np.array(named, np.uint32)[row], low, start, end - start)
        slip = h % np.uint32(slips) == 0
        for k in np.flatnonzero(slip).tolist():
            word = low[start[k] : end[k]].tobytes().decode()
            at = int(h[k]) % len(word)
            if len(word) > least:
                extra.append(word[:at] + word[at + 1 :])
        start, end = start[~slip], end[~slip]
    size = end - start
    mark = np.zeros(len(data) + 1, np.int8)
    mark[start] += 1
    mark[end] -= 1
    flat = low[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(size)])
    words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)).cast(pa.string())
    found = pa.concat_arrays([words, pa.array(extra, pa.string())]).value_counts()
    return pa.table({"word": found.field("values"), "n": found.field("counts")})


def _counted(batches: Iterator[pa.RecordBatch], least: int, slips: int) -> Iterator[pa.RecordBatch]:
    tokens.forget()
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        out = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
        return out.select(["word", "n_sum"]).rename_columns(["word", "n"])

    for batch in batches:
        ids, texts = batch.columns
        for a, b in W.slices(W.buffers(texts)[1]):
            held.append(_runs(ids[a:b], texts[a:b], least, slips))
            if sum(t.num_rows for t in held) > HELD:
                held = [merged()]
                if held[0].num_rows > HELD // 2:
                    yield from held.pop().to_batches()
    if held:
        yield from merged().to_batches()


def _latin(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte per code point of words of ``a-z U+00C0-U+00FF``, and each word's bounds."""
    data, bounds = W.buffers(column)
    lead = data == 0xC3
    before = np.concatenate([[0], np.cumsum(lead)])
    high = np.concatenate([[False], lead[:-1]]) if len(lead) else lead
    return (data + np.where(high, np.uint8(64), np.uint8(0)))[~lead], bounds - before[bounds]


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _finished(raw: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    return W.mixed(raw + W.mixed(np.atleast_1d(length).astype(np.uint64) * np.uint64(_BASE)))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        letters, bounds = _latin(batch.column(0))
        length = np.diff(bounds)
        at = np.arange(len(letters)) - np.repeat(bounds[:-1], length)
        raw = np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()))[at], bounds[:-1])
        # which of the 128 letter numbers below a word has: a-z from 0, U+00C0 to U+00FF from 64
        number = np.where(letters < 128, letters - 97, letters - 128).astype(np.uint64)
        bit = np.uint64(1) << (number & np.uint64(63))
        masks = [np.bitwise_or.reduceat(np.where((number >> np.uint64(6)) == k, bit, np.uint64(0)), bounds[:-1]) for k in (0, 1)]
        yield pa.record_batch(
            [
                *batch.columns[:2],
                pa.array(np.minimum(length, LONGEST).astype(np.int32)),
                pa.array(_finished(raw, length).view(np.int64)),
                *(pa.array(m.view(np.int64)) for m in masks),
            ],
            [c.split()[0] for c in _VOCABULARY.split(", ")],
        )


def vocabulary(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slips: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``word, n`` and what ``neighbours`` reads of every word, over the whole of all texts.

    Words are runs of ``A-Z a-z U+00C0-U+00FF``, only A-Z lower-cased. With ``slips``, a run whose
    CRC-32 of ``<id>:<run>`` that number divides loses its code point ``crc % length``; a null id is
    written as nothing. Words of at least ``least_length`` code points and ``least_count``
    occurrences are given. Null and empty texts have no words, repeated rows count as often as they
    come, and only the two named columns are read.
    """
    if least_length < 1:
        raise ValueError("words have a code point at least")
    rows = small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    told = rows.mapInArrow(lambda it: _counted(it, least_length, slips), "word string, n long")
    told = told.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    return told.mapInArrow(_hashed, _VOCABULARY)


# -- filters


class Shards:
    """Where the filter of each word length lies: ``blocks[shard]`` blocks from ``base[shard]`` on."""

    def __init__(self, counts: dict[int, int], chunk: int = CHUNK_BLOCKS) -> None:
        self.chunk = chunk  # blocks in a row of the filters' table
        self.blocks = np.zeros(LONGEST + 1, np.uint64)
        for shard, n in counts.items():
            self.blocks[shard] = math.ceil(n * BITS / BLOCK_BITS)
        self.base = np.concatenate([[0], np.cumsum(self.blocks)[:-1]]).astype(np.int64)
        self.total = int(self.blocks.sum())

    def block(self, h: np.ndarray, shard: int | np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * self.blocks[shard] >> np.uint64(32)).astype(np.int64) + self.base[shard]


def _bit(h: np.ndarray, part: int) -> np.ndarray:
    return h * _SALTS[part // 2] >> np.uint64(58 if part % 2 else 52) & np.uint64(63)


def _chunk(table: pa.Table, blocks: int) -> pa.Table:
    """The bits of one chunk of so many blocks."""
    out = np.zeros(blocks * 8, np.uint64)
    h = table.column("h").to_numpy().view(np.uint64)
    at = table.column("block").to_numpy() % blocks * 8
    for part in range(8):
        np.bitwise_or.at(out, at + part, np.uint64(1) << _bit(h, part))
    return pa.table({"chunk": table.column("chunk")[:1], "bits": W.binary([out.tobytes()])})


def filters(words: DataFrame, shards: Shards) -> DataFrame:
    """``chunk, bits``: the filters' blocks, ``shards.chunk`` of them a row."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, h = (c.to_numpy() for c in batch.columns)
            block = shards.block(h.view(np.uint64), shard)
            yield pa.record_batch([pa.array(block // shards.chunk), pa.array(block), batch.column(1)], ["chunk", "block", "h"])

    told = words.select("shard", "h").mapInArrow(dealt, "chunk long, block long, h long")
    return told.groupBy("chunk").applyInArrow(lambda t: _chunk(t, shards.chunk), "chunk long, bits binary")


class Filter:
    """The blocks from ``first`` on that one pass has."""

    def __init__(self, shards: Shards, first: int, blocks: np.ndarray) -> None:
        self.shards, self.first, self.flat = shards, first, blocks.reshape(-1)
        self.n = len(self.flat) // 8

    def has(self, h: np.ndarray, shard: int) -> np.ndarray:
        """Numbers of the hashes that may be words of the shard within this pass's blocks."""
        if not self.shards.blocks[shard]:
            return np.zeros(0, np.int64)
        block = self.shards.block(h, shard) - self.first
        at = np.flatnonzero((block >= 0) & (block < self.n))
        for part in range(8):
            word = self.flat[block[at] * 8 + part]
            at = at[(word >> _bit(h[at], part) & np.uint64(1)).astype(bool)]
        return at


# -- neighbours


def _edits(letters: np.ndarray, alphabet: np.ndarray, found: Filter) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Edits of words of one length (a row each) that the filter lets through, as word number,
    position and new letter, 0 for a deletion."""
    n, length = letters.shape
    power = _powers(length)
    each = (letters.astype(np.uint64) + np.uint64(1)) * power[:length]
    raw = each.sum(axis=1, dtype=np.uint64)
    shard = min(length, LONGEST)
    flat = letters.reshape(-1)
    for letter in alphabet.tolist():
        at = np.flatnonzero(flat < letter)
        word, place = np.divmod(at, length)
        edited = raw[word] + (np.uint64(letter) - flat[at].astype(np.uint64)) * power[place]
        hit = found.has(_finished(edited, length), shard)
        yield word[hit], place[hit], np.full(len(hit), letter)
    if length > 1:
        new = np.ones(letters.shape, bool)
        new[:, 1:] = letters[:, 1:] != letters[:, :-1]  # of equal neighbours one is enough
        upto = np.cumsum(each, axis=1, dtype=np.uint64)
        edited = ((upto - each) + (raw[:, None] - upto) * _BACK)[new]
        hit = found.has(_finished(edited, length - 1), min(length - 1, LONGEST))
        word, place = (k[hit] for k in np.nonzero(new))
        yield word, place, np.zeros(len(hit), np.int64)


def _probed(batches: Iterator[pa.RecordBatch], alphabets: dict[int, np.ndarray], found: Filter) -> Iterator[pa.RecordBatch]:
    """``a, n_a, b``: edits ``b`` of the words ``a`` that may be words."""
    for batch in batches:
        letters, bounds = _latin(batch.column(0))
        length = np.diff(bounds)
        for own in np.unique(length).tolist():
            numbers = np.flatnonzero(length == own)
            alphabet = alphabets[min(own, LONGEST)]
            for part in np.array_split(numbers, max(1, math.ceil(len(numbers) * own / EDITS))):
                matrix = letters[bounds[part][:, None] + np.arange(own)]
                hits: list[tuple[int, str]] = []
                for word, place, letter in _edits(matrix, alphabet, found):
                    for w, p, c in zip(word.tolist(), place.tolist(), letter.tolist(), strict=True):
                        text = matrix[w].tobytes().decode("latin-1")
                        hits.append((w, text[:p] + (chr(c) if c else "") + text[p + 1 :]))
                if hits:
                    rows = batch.take(pa.array(part[[w for w, _ in hits]]))
                    yield pa.record_batch([rows.column(0), rows.column(1), pa.array([b for _, b in hits])], ["a", "n_a", "b"])


def _alphabet(masks: list[int]) -> np.ndarray:
    return np.array([k + (97 if k < 64 else 128) for k in range(128) if masks[k // 64] >> k % 64 & 1], np.int64)


def neighbours(words: DataFrame, scratch: Scratch, filter_bytes: int = FILTER_BYTES, chunk_blocks: int = CHUNK_BLOCKS) -> DataFrame:
    """``a, n_a, b, n_b``: every two words one edit apart, each pair once.

    ``words`` is a saved ``vocabulary`` with each word once. Jobs run while the plan is built.
    """
    spark = words.sparkSession
    stats = words.groupBy("shard").agg(F.count("*").alias("n"), F.bit_or("letters0").alias("m0"), F.bit_or("letters1").alias("m1"))
    known = stats.collect()  # a row per length up to LONGEST
    shards = Shards({r.shard: r.n for r in known}, chunk_blocks)
    alphabets = {r.shard: _alphabet([r.m0, r.m1]) for r in known}
    built = scratch.save(filters(words, shards))
    total = sum(r.n for r in known)
    dealt = words.select("word", "n", "shard").repartition(max(1, math.ceil(total / TASK_WORDS)))
    step = max(1, filter_bytes // (chunk_blocks * BLOCK_BITS // 8))  # chunks in a pass
    chunks = math.ceil(shards.total / chunk_blocks)
    passes = []
    for at in range(0, chunks, step):
        part = np.zeros((min(step, chunks - at), chunk_blocks * 8), np.uint64)
        for r in built.where(F.col("chunk").between(at, at + step - 1)).collect():  # filter_bytes at most
            part[r.chunk - at] = np.frombuffer(r.bits, np.uint64)
        first, last = at * chunk_blocks, min((at + step) * chunk_blocks, shards.total)
        met = [s for s in range(LONGEST + 1) if shards.blocks[s] and shards.base[s] < last and shards.base[s] + int(shards.blocks[s]) > first]
        # words of these lengths and, by a deletion, those one longer
        asked = dealt.where(F.col("shard").isin(sorted({s + d for s in met for d in (0, 1) if s + d <= LONGEST})))
        shared = spark.sparkContext.broadcast(part)
        run = lambda it, shared=shared, first=first: _probed(it, alphabets, Filter(shards, first, shared.value))
        passes.append(scratch.save(asked.select("word", "n").mapInArrow(run, "a string, n_a long, b string")))
        shared.destroy()
    scratch.drop(built)
    if not passes:
        return spark.createDataFrame([], "a string, n_a long, b string, n_b long")
    maybe = reduce(DataFrame.unionByName, passes)
    return maybe.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b").select("a", "n_a", "b", "n_b")


def variants(
    words: DataFrame, scratch: Scratch, factor: int = 2, filter_bytes: int = FILTER_BYTES, chunk_blocks: int = CHUNK_BLOCKS
) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of a saved ``vocabulary``.

    The form is the near word of the largest ``n``, the least in code-point order at a tie, if that is
    ``factor`` times the word's own ``n`` or more. The root is where the forms lead to: as counts grow
    by the factor, a path of forms is short, and following them doubles the step each round.
    """
    if factor < 2:
        raise ValueError("forms must be more frequent than the word, or they lead in circles")
    near = neighbours(words, scratch, filter_bytes, chunk_blocks)
    ends = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), (-F.col("n_b")).alias("less")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), (-F.col("n_a")).alias("less")),
    )
    best = near.select(F.inline(ends)).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))
    told = words.select("word", "n").join(best, "word", "left")
    formed = -F.col("best.less") >= factor * F.col("n")
    told = scratch.save(
        told.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"),
        )
    )
    now = scratch.save(told.where("form is not null").select("word", F.col("form").alias("to"), F.lit(True).alias("moved")))
    while not now.where("moved").isEmpty():
        step = now.join(now.select(F.col("word").alias("to"), F.col("to").alias("next")), "to", "left")
        step = scratch.save(step.select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(now)
        now = step
    roots = now.select("word", F.col("to").alias("root"))
    return told.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
