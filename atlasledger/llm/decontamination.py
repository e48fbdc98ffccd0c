"""Benchmark passages in documents, by the q-gram lemma.

A passage of ``m`` characters with at most ``k`` edits shares at least ``m + 1 - q (k + 1)`` q-grams
with its place in a document, on diagonals at most ``k`` apart from the place's own (Jokinen and
Ukkonen, 1991; Rasmussen, Stoye and Myers, 2006). Hits are counted in diagonal bands of twice
``2 k + 1`` that overlap by half, so one band holds them all; bands with enough hits are regions, and
a banded alignment finds the least edits there. Nothing that keeps to the budget is missed.

Texts are compared lower-cased, with runs of white space as one space. Documents are read whole and
stay where they are: the benchmark goes to the tasks, in blocks of bounded size.
"""

from __future__ import annotations

import bisect
import math
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasledger.llm import tokens
from atlasledger.llm.words import mixed
from atlasledger.session import small_batches

#: Edits allowed, as a share of the passage's characters.
ERROR = 0.1
GRAM = 8
#: Passages of fewer characters are searched for as they are, without edits and between word bounds.
LEAST_CHARS = 12
#: Characters of benchmark passages per pass over the documents (some 40 bytes each in a task).
BLOCK_CHARS = 2_000_000
#: Characters of documents worked on at once; a longer text is cut into overlapping parts.
PART_CHARS = 1 << 15
#: Hits worked on at once.
MOST_HITS = 1 << 20
_STEP = np.uint64(0xD1342543DE82EF95)
# fixed values: code points of white space
_SPACES = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_SPACE_LOW = np.zeros(256, bool)
_SPACE_LOW[_SPACES[_SPACES < 256]] = True
# fixed values: ranges of scripts without spaces between words (Thai and Lao, Myanmar, Khmer, East Asian)
_UNSPACED = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_FOUND = "doc_id long, item_id long, edits long, first long, end long"


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the text as it is compared, and where each stands in the text as it is."""
    low = text.lower()
    if len(low) != len(text):  # one character for one, so that places hold
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _SPACE_LOW[np.minimum(codes, 255)] & (codes < 256)
    far = np.flatnonzero(codes >= 0x1680)
    if len(far):
        space[far] = np.isin(codes[far], _SPACES)
    keep = ~space
    keep[1:] |= ~space[:-1]
    place = np.flatnonzero(keep)
    if len(place) and space[place[-1]]:
        place = place[:-1]
    return np.where(space[place], np.uint32(32), codes[place]), place


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of every ``q`` consecutive code points."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(q):
        out *= _STEP
        out += codes[k : n + k]
    return mixed(out)


def edits(item: np.ndarray, region: np.ndarray, first: int, width: int, budget: int) -> tuple[int, int]:
    """Least edits between ``item`` and any part of ``region``, and that part's end.

    Only diagonals (place in the region less place in the item) from ``first`` on, ``width`` of them,
    are worked out, and only until none is within ``budget``.
    """
    far = len(item) + width + 1
    step = np.arange(width)
    place = first + step
    now = np.where((place >= 0) & (place <= len(region)), 0, far)
    for i, code in enumerate(item):
        place = first + i + step  # of the character that the diagonal meets
        inside = (place >= 0) & (place < len(region))
        same = np.zeros(width, bool)
        same[inside] = region[place[inside]] == code
        new = now + ~same
        new[~inside] = far
        new[:-1] = np.minimum(new[:-1], now[1:] + 1)  # the item's character has no counterpart
        ends = first + i + 1 + step
        new[(ends < 0) | (ends > len(region))] = far
        now = np.minimum.accumulate(new - step) + step  # characters of the region without one
        if now.min() > budget:
            return far, first
    best = int(np.argmin(now))
    return int(now[best]), first + len(item) + best


class _Index(NamedTuple):
    """All q-grams of the passages that use the same ``q``."""

    q: int
    gram: np.ndarray  # distinct, sorted
    first: np.ndarray  # where each one's places begin; one entry more
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray  # by 20 bits of the hash, is there such a gram


class Items(NamedTuple):
    item_id: list[int | None]
    codes: list[np.ndarray]
    budget: np.ndarray
    needed: np.ndarray
    indexes: list[_Index]
    short: dict[bytes, list[int]]  # passages under ``LEAST_CHARS`` by their code points
    overlap: int  # more than any place of a passage with the bands about it


def prepared(rows: list[tuple[int | None, str | None]], error: float) -> Items:
    """Passages with their budgets and q-grams: of ``GRAM`` characters, or fewer where the lemma
    would else promise none."""
    ids, codes = [], []
    for item_id, text in rows:
        own = normalised(text or "")[0]
        if len(own):
            ids.append(item_id)
            codes.append(own)
    size = np.array([len(c) for c in codes], np.int64)
    long = size >= LEAST_CHARS
    budget = np.where(long, np.floor(size * error), 0).astype(np.int64)
    q = np.where(long, np.minimum(GRAM, size // (budget + 1)), 0)
    short: dict[bytes, list[int]] = {}
    for k in np.flatnonzero(~long).tolist():
        short.setdefault(codes[k].tobytes(), []).append(k)
    indexes = []
    for width in sorted(set(q[long].tolist())):
        own = np.flatnonzero(q == width)
        hashed = [grams(codes[k], width) for k in own]
        flat = np.concatenate(hashed)
        item = np.repeat(own, [len(h) for h in hashed])
        place = np.concatenate([np.arange(len(h)) for h in hashed])
        order = np.argsort(flat, kind="stable")
        gram, first = np.unique(flat[order], return_index=True)
        known = np.zeros(1 << 20, bool)
        known[(gram >> np.uint64(44)).astype(np.int64)] = True
        indexes.append(_Index(width, gram, np.append(first, len(flat)), item[order], place[order], known))
    overlap = int((2 * size + 8 * budget).max()) if len(size) else 0
    return Items(ids, codes, budget, size + 1 - q * (budget + 1), indexes, short, overlap)


def _short_places(codes: np.ndarray, short: dict[bytes, list[int]]) -> Iterator[tuple[int, int, int]]:
    """``(item, first, end)`` of short passages between word bounds."""
    if not short or not len(codes):
        return
    named, which = np.unique(codes, return_inverse=True)
    free = [unicodedata.category(chr(c))[0] not in "LMN" or any(a <= c <= b for a, b in _UNSPACED) for c in named.tolist()]
    apart = np.array(free)[which]
    bound = np.ones(len(codes) + 1, bool)
    bound[1:-1] = apart[:-1] | apart[1:]
    for size in sorted({len(p) // 4 for p in short}):
        known = np.concatenate([grams(np.frombuffer(p, np.uint32), size) for p in short if len(p) == 4 * size])
        hashed = grams(codes, size)
        at = np.flatnonzero(bound[: len(hashed)] & bound[size : size + len(hashed)])
        for a in at[np.isin(hashed[at], known)].tolist():
            for item in short.get(codes[a : a + size].tobytes(), ()):
                yield item, a, a + size


def _hits(codes: np.ndarray, index: _Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a text has q-grams of passages, which ones, and how many places those have there."""
    hashed = grams(codes, index.q)
    at = np.flatnonzero(index.filter[(hashed >> np.uint64(44)).astype(np.int64)])
    k = np.minimum(np.searchsorted(index.gram, hashed[at]), len(index.gram) - 1)
    hit = index.gram[k] == hashed[at]
    at, k = at[hit], k[hit]
    return at, k, index.first[k + 1] - index.first[k]


def _regions(index: _Index, items: Items, at: np.ndarray, k: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, int]]:
    """``(item, band)`` with enough hits; band ``j`` of an item holds the diagonals from ``j`` times
    its stride on, two strides of them."""
    total = int(count.sum())
    if not total:
        return
    entry = np.repeat(index.first[k] - np.cumsum(count) + count, count) + np.arange(total)
    item, place = index.item[entry], index.place[entry]
    band = (np.repeat(at, count) - place) // (2 * items.budget[item] + 1)
    low = int(band.min()) - 1
    span = int(band.max()) - low + 1
    # every hit counts in its own band and in the one that begins a stride earlier, there once for
    # each place of the passage
    key = item * span + (band - low)
    key, place = np.concatenate([key, key - 1]), np.concatenate([place, place])
    named, hits = np.unique(key, return_counts=True)
    some = hits >= items.needed[named // span]
    if not some.any():
        return
    mine = np.isin(key, named[some])
    far = int(place.max()) + 1
    named, hits = np.unique(np.unique(key[mine] * far + place[mine]) // far, return_counts=True)
    for one in named[hits >= items.needed[named // span]].tolist():
        yield one // span, one % span + low


def matches(codes: np.ndarray, items: Items) -> dict[int, list[tuple[int, int, int]]]:
    """By item, the places ``(edits, first, end)`` that its regions show; they may overlap.

    A text with very many hits, as of one repeated word, is worked on in halves that overlap.
    """
    found: dict[int, list[tuple[int, int, int]]] = {}
    hits = [_hits(codes, index) for index in items.indexes]
    if sum(int(count.sum()) for *_, count in hits) > MOST_HITS and len(codes) > 4 * items.overlap:
        half = len(codes) // 2
        found = matches(codes[: half + items.overlap], items)
        for item, spans in matches(codes[half:], items).items():
            found.setdefault(item, []).extend((least, a + half, b + half) for least, a, b in spans)
        return found
    regions = (r for index, own in zip(items.indexes, hits, strict=True) for r in _regions(index, items, *own))
    for item, band in regions:
        passage, budget = items.codes[item], int(items.budget[item])
        stride = 2 * budget + 1
        first = band * stride
        begin, stop = max(0, first), min(len(codes), first + 2 * stride + len(passage))
        region = codes[begin:stop]
        exact = region.tobytes().find(passage.tobytes())
        if exact >= 0 and exact % 4 == 0:
            found.setdefault(item, []).append((0, begin + exact // 4, begin + exact // 4 + len(passage)))
            continue
        least, end = edits(passage, region, first - begin, 2 * stride, budget)
        if least <= budget:
            # the part's start: the same from behind, over the diagonals that end there
            back, length = edits(passage[::-1], region[:end][::-1], -budget, 2 * budget + 1, budget)
            start = end - length if back == least else max(0, end - len(passage))
            found.setdefault(item, []).append((least, begin + start, begin + end))
    return found


def in_text(text: str, items: Items) -> list[tuple[int, int, int, int]]:
    """``(item, edits, first, end)`` of passages in a whole text; places are those of the text as it
    is. Where places of one passage overlap, the one with the fewest edits is told."""
    codes, place = normalised(text)
    found: dict[int, set[tuple[int, int, int]]] = {}
    for at in range(0, max(1, len(codes)), PART_CHARS):
        for item, spans in matches(codes[at : at + PART_CHARS + items.overlap], items).items():
            found.setdefault(item, set()).update((least, at + a, at + b) for least, a, b in spans)
    for item, a, b in _short_places(codes, items.short):
        found.setdefault(item, set()).add((0, a, b))
    out = []
    for item, spans in found.items():
        kept: list[tuple[int, int]] = []  # in order
        for least, a, b in sorted(spans):
            k = bisect.bisect_left(kept, (a, b))
            if (k == 0 or kept[k - 1][1] <= a) and (k == len(kept) or kept[k][0] >= b):
                kept.insert(k, (a, b))
                out.append((item, least, int(place[a]), int(place[b - 1]) + 1))
    return sorted(out)


def _searched(batches: Iterator[pa.RecordBatch], rows: list[tuple[int | None, str | None]], error: float) -> Iterator[pa.RecordBatch]:
    tokens.forget()
    items = prepared(rows, error)
    names = [c.split()[0] for c in _FOUND.split(", ")]
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            if text and items.codes:
                out += [(doc_id, items.item_id[k], *span) for k, *span in in_text(text, items)]
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, error: float = ERROR, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "text"
) -> DataFrame:
    """Every place where a passage of ``benchmark`` stands in a text: ``doc_id, item_id, edits,
    first, end`` (characters of the text).

    Places of one passage do not overlap; the one with fewest edits is told. Passages under
    ``LEAST_CHARS`` characters are found exactly and between word bounds only. Null and empty texts
    and passages match nothing; rows without ids are searched and
    told with null. Repeated rows are told repeatedly. A benchmark of more than ``BLOCK_CHARS``
    characters takes one pass over the documents per block. The driver reads the benchmark, block by
    block, while the plan is built.
    """
    rows = small_batches(docs).select(F.col(id_col).cast("long"), F.col(text_col))
    out = None
    for listed in _blocks(benchmark, item_col, passage_col):
        found = rows.mapInArrow(lambda it, listed=listed: _searched(it, listed, error), _FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def _blocks(benchmark: DataFrame, item_col: str, passage_col: str) -> Iterator[list[tuple[int | None, str | None]]]:
    """The passages in blocks of about ``BLOCK_CHARS`` characters; one empty block if there are none."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(passage_col).alias("passage"))
    size = items.agg(F.sum(F.length("passage"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_CHARS))
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == block).collect()
        yield sorted(((r.item_id, r.passage) for r in own), key=str)


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, error: float = ERROR, text_col: str = "text", item_col: str = "item_id", passage_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` in whose text no passage of ``benchmark`` stands, with all their columns.

    As in ``contaminated``, but rows go at once instead of being joined with what was found. Null and
    empty texts stay.
    """
    columns = docs.columns
    out = small_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    for listed in _blocks(benchmark, item_col, passage_col):

        def run(batches: Iterator[pa.RecordBatch], listed=listed) -> Iterator[pa.RecordBatch]:
            tokens.forget()
            items = prepared(listed, error)
            for batch in batches:
                rows = batch.column(0)
                texts = pa.StructArray.field(rows, rows.type.get_field_index(text_col))
                keep = [not (t and items.codes and in_text(t, items)) for t in (x.as_py() for x in texts)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in columns])
