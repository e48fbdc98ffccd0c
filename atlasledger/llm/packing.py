"""Vector bin packing of token sequences by the dot-product heuristic.

A sequence is a bin with simultaneous limits on tokens, segments and loss-bearing tokens. Pieces
longer than a bin are cut into full bins and a tail. Tails wait in a pool; a bin is filled by placing,
again and again, the piece with the greatest weighted dot product of its sizes with what the bin has
left (Panigrahy et al., "Heuristics for Vector Bin Packing", 2011; weights are the inverse limits).
When no piece fits any more and cutting is allowed, a piece is cut to fill the gap.

Each task packs what it reads, in one pass over a bounded pool, so there is no shuffle; what a task
ends on is cut into sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasledger.llm.tokens import encoder
from atlasledger.session import small_batches

POOL = 2048
_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, loss_tokens long"
)


class Limits(NamedTuple):
    tokens: int = 1024
    segments: int = 256
    loss: int = 1024


class Piece(NamedTuple):
    """Ids ``start`` to ``end`` of an example; ``loss`` counts its loss-bearing ids up to each place
    (None: all are)."""

    doc_id: int | None
    ids: np.ndarray
    loss: np.ndarray | None
    start: int
    end: int

    def loss_of(self, start: int, end: int) -> int:
        return end - start if self.loss is None else int(self.loss[end] - self.loss[start])

    def most(self, tokens: int, loss: int) -> int:
        """How many ids from the start keep within both."""
        end = min(self.end, self.start + tokens)
        if self.loss is not None:
            end = min(end, int(np.searchsorted(self.loss, self.loss[self.start] + loss, "right")) - 1)
            return max(0, end - self.start)
        return max(0, min(end, self.start + loss) - self.start)


class Packer:
    """Packs pieces into sequences; ``sequences`` come out as lists of pieces."""

    def __init__(self, limits: Limits, cut: bool = True) -> None:
        if min(limits) < 1:
            raise ValueError("limits must be 1 or more")
        self.limits, self.cut = limits, cut
        self._pool: list[Piece] = []

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Takes an example in; full sequences that need no pool come out at once."""
        at = piece.start
        while at < piece.end:
            rest = piece._replace(start=at)
            size = rest.most(self.limits.tokens, self.limits.loss)
            if at + size == piece.end and size < self.limits.tokens:
                break
            yield [rest._replace(end=at + size)]
            at += size
        if at < piece.end:
            self._pool.append(piece._replace(start=at))
        if len(self._pool) >= POOL:
            yield from self._packed(POOL // 2)

    def end(self) -> Iterator[list[Piece]]:
        yield from self._packed(0)

    def _packed(self, keep: int) -> Iterator[list[Piece]]:
        """Sequences from the pool until ``keep`` pieces or fewer are left."""
        pool = self._pool
        size = np.array([(p.end - p.start, 1, p.loss_of(p.start, p.end)) for p in pool], float).reshape(-1, 3).T.copy()
        here = np.ones(len(pool), bool)
        weight = 1.0 / np.array(self.limits, float) ** 2
        while (count := int(here.sum())) > keep:
            left = np.array(self.limits, float)
            bin_: list[Piece] = []
            while left[0] and left[1]:
                fits = here & (size[0] <= left[0]) & (size[1] <= left[1]) & (size[2] <= left[2])
                k = int(np.argmax(np.where(fits, (weight * left) @ size, -1.0)))
                if fits[k]:
                    bin_.append(pool[k])
                    left -= size[:, k]
                    here[k] = False
                    continue
                if not self.cut or not here.any():
                    break
                # the largest piece is cut: what is left of it stays easy to place
                k = int(np.argmax(np.where(here, size[0], -1)))
                take = pool[k].most(int(left[0]), int(left[2]))
                if not take:
                    break
                head = pool[k]._replace(end=pool[k].start + take)
                bin_.append(head)
                pool[k] = pool[k]._replace(start=head.end)
                used = head.loss_of(head.start, head.end)
                size[:, k] -= (take, 0, used)
                left -= (take, 1, used)
            if left[0] and self.cut and not here.any():
                yield from self._powers(bin_)
            else:
                yield bin_
            if int(here.sum()) == count and not bin_:
                raise RuntimeError("no piece fits an empty sequence")
        self._pool = [p for p, h in zip(pool, here.tolist(), strict=True) if h]

    def _powers(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        """A last sequence that is not full, as sequences of power-of-two lengths."""
        left = sum(p.end - p.start for p in pieces)
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            out = []
            while room:
                p = pieces[0]
                take = min(room, p.end - p.start)
                out.append(p._replace(end=p.start + take))
                room -= take
                pieces = pieces[1:] if take == p.end - p.start else [p._replace(start=p.start + take), *pieces[1:]]
            yield out


def _pack(
    batches: Iterator[pa.RecordBatch], examples: Callable[[pa.RecordBatch], Iterator[Piece]], limits: Limits, cut: bool, with_ids: bool
) -> Iterator[pa.RecordBatch]:
    packer = Packer(limits, cut)
    number = TaskContext.get().partitionId() << 32
    rows: list[tuple] = []

    def told(sequences: Iterator[list[Piece]]) -> None:
        nonlocal number
        for pieces in sequences:
            offset = 0
            for p in pieces:
                own = p.ids[p.start : p.end]
                crc = zlib.crc32(own.tobytes())
                size = p.end - p.start
                loss = p.loss_of(p.start, p.end)
                rows.append((p.doc_id, p.start, size, crc, len(p.ids), number, offset, loss, *([own] * with_ids)))
                offset += size
            number += 1

    names = [c.split()[0] for c in _PIECES.split(", ")] + ["ids"] * with_ids

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        arrays = [pa.array(c, pa.int64()) for c in columns[:8]]
        if with_ids:
            arrays.append(pa.array([c.astype(np.int32) for c in columns[8]], pa.list_(pa.int32())))
        rows.clear()
        return pa.record_batch(arrays, names)

    for batch in batches:
        for piece in examples(batch):
            told(packer.add(piece))
            if len(rows) >= 4096:
                yield batch_of()
    told(packer.end())
    yield batch_of()


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits(), with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Packs whole texts, each followed by ``end_id``, into sequences.

    A row per piece: ``doc_id, start`` (its document's ids before it), ``length, ids_crc32,
    doc_tokens, sequence_id, offset, loss_tokens`` and, if asked for, ``ids``. All ids bear loss. Each
    id lies in exactly one piece; offsets of a sequence are gapless. Sequences are full, or have a
    power-of-two length, unless they reach the limit on segments. A null or empty text is its end id.
    Rows without an id or with repeated ids are documents of their own. Sequence numbers are unique
    within a result and depend on how the table is split into tasks.
    """

    def examples(batch: pa.RecordBatch) -> Iterator[Piece]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for doc_id, packed in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
            ids = np.frombuffer(packed + end, "<u4")
            yield Piece(doc_id, ids, None, 0, len(ids))

    rows = small_batches(docs).select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(lambda it: _pack(it, examples, limits, True, with_ids), _PIECES + ", ids array<int>" * with_ids)


def pack_examples(
    examples: DataFrame, limits: Limits, cut: bool = False, with_ids: bool = True, id_col: str = "example_id", ids_col: str = "ids", loss_col: str = "loss"
) -> DataFrame:
    """Packs instruction examples: ``ids array<int>`` and ``loss array<boolean>``, true where an id
    bears loss. Rows and result as in ``pack_documents``.

    With ``cut`` off an example stays whole, unless it is larger than a sequence: then full
    sequences are cut off it. A null or empty list of ids gives no piece; a null mask, or null in
    it, means no loss; a mask of another length is an error.
    """

    def read(batch: pa.RecordBatch) -> Iterator[Piece]:
        for doc_id, ids, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = np.array(ids or [], "<u4")
            mask = np.zeros(len(ids), bool) if mask is None else np.array([bool(m) for m in mask], bool)
            if len(mask) != len(ids):
                raise ValueError(f"example {doc_id}: {len(ids)} ids and {len(mask)} marks")
            yield Piece(doc_id, ids, np.concatenate([[0], np.cumsum(mask)]), 0, len(ids))

    rows = small_batches(examples).select(F.col(id_col).cast("long"), F.col(ids_col), F.col(loss_col))
    return rows.mapInArrow(lambda it: _pack(it, read, limits, cut, with_ids), _PIECES + ", ids array<int>" * with_ids)
