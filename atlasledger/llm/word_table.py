"""BPE encoding and decoding by a table of distinct words.

Encoding: tasks split texts into the words that the tokenizer's pattern gives, block by block of
``BLOCK_BYTES``. A block writes its rows with the positions of their words, as codes into the block's
own list of distinct words, to one file, and gives that list to Spark, dealt to buckets by a hash of
the word. In a bucket equal words meet, each distinct word is encoded once, and its ids go back to the
blocks that have it, where codes are replaced by ids. So neither texts nor positions are ever
shuffled, only packed lists of distinct words; a block has a word once, so no word is a hot key.

Decoding: the distinct ids of a slice of rows are joined with the table of pieces, which the
vocabulary bounds, and positions replaced by pieces.
"""

from __future__ import annotations

import json
import math
import os
import struct
import uuid
from array import array
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from atlasledger.llm import tokens
from atlasledger.llm import words as W
from atlasledger.llm.files import opened, written
from atlasledger.session import Scratch, small_batches

#: Bytes of text in a block (a longer text is a block of its own), and ids given or decoded at once.
BLOCK_BYTES = 16 << 20
SLICE_IDS = 1 << 20
#: Bytes of text that are split at once, bytes of all text per bucket, and words a task remembers.
SPLIT_BYTES = 2 << 20
BUCKET_BYTES = 16 << 30
KNOWN = 1_000_000
#: Partitions that blocks are dealt to at most. They are told by number, as packed lists are far smaller
#: than the ids that come of them, by which Spark would put too many into one.
MOST_PARTS = 50_000
# fixed values: characters beyond plain Latin, and a space that ends a longer run of white space
OTHER, RUN = "[^\t\n\r\\x20-\\x7e\xa1-\u024f]", "\\s [\\s]|\\s $"
#: Characters of a long text that are split at once, cut at a single space.
PART = 1 << 20
_PLANES = [("low", 0, 255), ("mid", 8, 255), ("high", 16, 0xFFFF)]
_NONE = np.zeros(0, np.int64)


class Tokenizer:
    """The library's tokenizer with what it takes to split texts and read ids as bytes."""

    _ready: dict[tuple[str, bool], "Tokenizer"] = {}

    @classmethod
    def at(cls, path: str, special: bool) -> "Tokenizer":
        if (path, special) not in cls._ready:
            cls._ready[path, special] = cls(path, special)
        return cls._ready[path, special]

    def __init__(self, path: str, special: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        split = told["pre_tokenizer"] or {}
        if told["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level tokenizers that split by their pattern and change no text")
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in told["added_tokens"]):
            raise ValueError(f"{path}: special tokens that take white space or only stand alone")
        self.library = Library.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = not special
        names = sorted((a["content"] for a in told["added_tokens"]), key=len, reverse=True)
        self.names = names if special else []
        self.width, self._kind = (2, "H") if max(self.library.get_vocab(with_added_tokens=True).values()) < 1 << 16 else (4, "I")

    def words(self, text: str) -> Iterator[str]:
        """The words of any text, by the library itself; special tokens are words."""
        rest = [text]
        for name in self.names:
            rest = [x for part in rest for k, p in enumerate([part] if part in self.names else part.split(name)) for x in ([name, p] if k else [p])]
        for part in rest:
            if part in self.names:
                yield part
            elif part:
                yield from (part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part))

    def ids(self, found: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned integers of ``width`` bytes."""
        return [array(self._kind, e.ids).tobytes() for e in self.library.encode_batch_fast(found, add_special_tokens=False)]


def pieces(tokenizer: str) -> list[tuple[int, bytes]]:
    """Every id of the vocabulary with its bytes."""
    from tokenizers import Tokenizer as Library

    # fixed values: the byte-level alphabet shows these bytes as themselves, the others from U+0100 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    out = []
    for piece, number in Library.from_file(tokenizer).get_vocab(with_added_tokens=True).items():
        known = all(c in byte for c in piece)
        out.append((number, bytes(byte[c] for c in piece) if known else piece.encode()))
    return out


# -- splitting


def _gather(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers ``first[k], first[k] + 1, ...``, ``size[k]`` of them, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


class _Block:
    """Rows of one block on the way to their file."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self._tokenizer = tokenizer
        self.code: dict[str, int] = {}
        self.rows: list[pa.Array] = []
        self._texts: list[pa.Array] = []
        self._waiting = self.bytes = 0
        self._codes: list[np.ndarray] = []  # of all words in the order of the rows
        self._sizes: list[np.ndarray] = []  # words of each row

    def add(self, rows: pa.Array, texts: pa.Array) -> None:
        self.rows.append(rows)
        self._texts.append(texts)
        self.bytes += texts.nbytes
        self._waiting += texts.nbytes
        if self._waiting >= SPLIT_BYTES:
            self._done()

    def _done(self) -> None:
        """Split what waits; larger pieces have fewer distinct chunks in all."""
        if self._texts:
            codes, sizes = self._split()
            self._codes.append(codes.astype(np.uint32))
            self._sizes.append(sizes)
            self._texts, self._waiting = [], 0

    def _split(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words in the order of the rows, and words per row."""
        texts = pa.concat_arrays(self._texts).cast(pa.large_string()).fill_null("")
        # what the fast way splits as the library does; see tokens.py
        other = pc.or_(pc.match_substring_regex(texts, OTHER), pc.match_substring_regex(texts, RUN))
        odd = pc.or_(other, pc.greater(pc.binary_length(texts), PART))
        for name in self._tokenizer.names:
            odd = pc.or_(odd, pc.match_substring(texts, name))
        odd = odd.to_numpy(zero_copy_only=False).astype(bool)
        codes, sizes = self._plain(texts.filter(pa.array(~odd)))
        if not odd.any():
            return codes, sizes
        parts, size = [], np.zeros(len(texts), np.int64)
        size[~odd] = sizes
        before, at, last = np.concatenate([[0], np.cumsum(sizes)]), 0, 0
        for k in np.flatnonzero(odd).tolist():
            at += k - last
            parts += [codes[before[at - (k - last)] : before[at]], self._slow(texts[k].as_py())]
            size[k] = len(parts[-1])
            last = k + 1
        return np.concatenate([*parts, codes[before[at] :]]), size

    def _number(self, found: list[str]) -> np.ndarray:
        code = self.code
        return np.array([code.setdefault(w, len(code)) for w in found], np.uint32)

    def _slow(self, text: str) -> np.ndarray:
        """A text that the library splits, in parts; single spaces between non-spaces are safe cuts."""
        out, at = [], 0
        while at < len(text):
            to = min(at + PART, len(text))
            while to < len(text) and not (text[to] == " " and not text[to - 1].isspace() and not text[to + 1 : to + 2].isspace() and self._apart(text, to)):
                to += 1
            part = text[at:to]
            plain = not tokens._OTHER.search(part) and not tokens._RUN.search(part) and not any(n in part for n in self._tokenizer.names)
            out.append(self._number(tokens._SPLIT.findall(part) if plain else list(self._tokenizer.words(part))))
            at = to
        return np.concatenate(out) if out else _NONE.astype(np.uint32)

    def _apart(self, text: str, at: int) -> bool:
        """Whether no special token's name lies across a place."""
        return not any(n in text[max(0, at - len(n) + 1) : at + len(n) - 1] for n in self._tokenizer.names)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words of all texts, and words per text: distinct chunks between single spaces
        are split once, as the pattern never joins what stands on either side of one."""
        if not len(texts):
            return np.zeros(0, np.uint32), _NONE
        lists = pc.split_pattern(texts, " ")
        count = pc.list_value_length(lists).to_numpy().astype(np.int64)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        flat = lists.flatten().dictionary_encode()
        chunk = flat.indices.to_numpy().astype(np.int64)
        known = flat.dictionary.to_numpy(zero_copy_only=False).tolist()  # far quicker than to_pylist
        # behind the chunks with a space before them come those without, which begin a text
        lead = {c: k for k, c in enumerate(dict.fromkeys(chunk[first].tolist()))}
        own = [tokens._SPLIT.findall(" " + c) for c in known] + [tokens._SPLIT.findall(known[c]) for c in lead]
        chunk[first] = [len(known) + lead[c] for c in chunk[first].tolist()]
        size = np.fromiter(map(len, own), np.int64, len(own))
        start = np.concatenate([[0], np.cumsum(size)])
        codes = self._number([w for words in own for w in words])
        n = size[chunk]
        before = np.concatenate([[0], np.cumsum(n)])
        return codes[_gather(start[chunk], n)], np.diff(before[np.append(first, len(chunk))])

    def write(self, folder: str, buckets: int) -> pa.RecordBatch:
        """The block's file; gives its distinct words, packed by bucket.

        A block without words gives one empty list, so that it is known too.
        """
        self._done()
        codes, size = np.concatenate(self._codes), np.concatenate(self._sizes)
        words = pa.array(list(self.code), pa.string())
        self.code, self._codes = {}, []
        rank = np.empty(len(words), np.uint32)
        rank[np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")] = np.arange(len(words))
        codes = rank[codes]  # the most frequent first, so that high bytes are mostly zero
        data, bounds = W.buffers(words)
        hashed = W.hashes(W.Words(data, bounds[:-1], bounds[1:], bounds[:0], bounds[:0]))
        bucket = (hashed % np.uint64(buckets)).astype(np.int64)
        by = pc.sort_indices(pa.table({"b": bucket, "w": words}), sort_keys=[("b", "ascending"), ("w", "ascending")]).to_numpy()
        name = uuid.uuid4().int >> 65  # of its own for each attempt: lists and file belong together
        self._file(folder, name, codes, size, rank[by])
        bucket, words = bucket[by], words.take(pa.array(by))
        edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        parts = len(edge) - 1
        lists = [_packed(*_sized(words[a:b])) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        own = bucket[edge[:-1]] if len(bucket) else np.zeros(1, np.int64)
        columns = own, np.full(parts, name, np.int64), np.full(parts, parts, np.int32)
        return pa.record_batch([*(pa.array(c) for c in columns), W.binary(lists)], ["bucket", "block", "parts", "words"])

    def _file(self, folder: str, name: int, codes: np.ndarray, size: np.ndarray, order: np.ndarray) -> None:
        """Rows with their codes, and ``order``, the codes of the words as they are listed."""
        ends = np.concatenate([[0], np.cumsum(size)])
        rows = pa.concat_arrays(self.rows)
        told = {"order": _packed(np.zeros(0, np.int64), order.astype("<u4").view(np.uint8))}
        schema = pa.schema([("row", rows.type), *((p, pa.large_binary()) for p, _, _ in _PLANES)], metadata=told)
        with written(folder, f"{name}.codes") as file, pa.ipc.new_stream(file, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            at = 0
            while at < len(size):  # batches that a reader can hold with their ids
                to = max(at + 1, min(at + 4096, int(np.searchsorted(ends, ends[at] + SLICE_IDS // 4, "right")) - 1))
                own, bounds = codes[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
                arrays = []
                for _, shift, most in _PLANES:
                    plane = (own >> np.uint32(shift) & np.uint32(most)).astype("<u2" if most > 255 else "u1")
                    offsets = pa.py_buffer((bounds * plane.itemsize).astype(np.int64))
                    arrays.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), to - at, [None, offsets, pa.py_buffer(plane)]))
                out.write_batch(pa.record_batch([rows[at:to], *arrays], schema=schema))
                at = to


def _sized(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = W.buffers(column)
    return np.diff(bounds), data


def _packed(size: np.ndarray, data: np.ndarray) -> bytes:
    """Byte strings of these sizes, one after the other, compressed."""
    raw = size.astype("<u4").tobytes() + data.tobytes()
    return struct.pack("<QQ", len(size), len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(packed: bytes) -> tuple[np.ndarray, bytes]:
    n, total = struct.unpack_from("<QQ", packed)
    raw = pa.decompress(packed[16:], total, "zstd", asbytes=True)
    return np.frombuffer(raw, "<u4", n).astype(np.int64), raw[4 * n :]


def _split(batches: Iterator[pa.RecordBatch], folder: str, path: str, special: bool, block_bytes: int, buckets: int) -> Iterator[pa.RecordBatch]:
    tokens.forget()
    tokenizer = Tokenizer.at(path, special)
    block = _Block(tokenizer)
    for batch in batches:
        rows, texts = batch.columns
        for a, b in W.slices(W.buffers(texts)[1]):
            if block.rows and block.bytes + texts[a:b].nbytes > block_bytes:
                yield block.write(folder, buckets)
                block = _Block(tokenizer)
            block.add(rows[a:b], texts[a:b])
    if block.rows:
        yield block.write(folder, buckets)


# -- ids


def _encoded(batches: Iterator[pa.RecordBatch], path: str, special: bool) -> Iterator[pa.RecordBatch]:
    """Rows ``bucket, block, parts, words``, sorted by bucket, with ``ids`` for ``words``."""
    tokenizer = Tokenizer.at(path, special)
    now, known = None, {}
    for batch in batches:
        bucket, packed = batch.column(0).to_pylist(), batch.column(3)
        for k in range(batch.num_rows):
            if bucket[k] != now or len(known) > KNOWN:
                now, known = bucket[k], {}
            size, data = _unpacked(packed[k].as_py())
            ends = np.concatenate([[0], np.cumsum(size)]).tolist()
            words = [data[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            new = [w for w in words if w not in known]
            known.update(zip(new, tokenizer.ids(new), strict=True))
            ids = [known[w] for w in words]
            told = _packed(np.fromiter(map(len, ids), np.int64, len(ids)), np.frombuffer(b"".join(ids), np.uint8))
            yield pa.record_batch([*(c[k : k + 1] for c in batch.columns[:3]), W.binary([told])], ["bucket", "block", "parts", "ids"])


def _replaced(batches: Iterator[pa.RecordBatch], folder: str, width: int) -> Iterator[pa.RecordBatch]:
    """Rows ``bucket, block, parts, ids``, sorted by block and bucket, to the blocks' rows with ids."""
    store, root = opened(folder)

    def given(block: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        unpacked = [_unpacked(h) for h in held]
        sizes = np.concatenate([n for n, _ in unpacked]) // width
        ids = np.frombuffer(b"".join(d for _, d in unpacked), f"<u{width}").astype(np.int32)
        with store.open_input_stream(f"{root}/{block}.codes") as file:
            stream = pa.ipc.open_stream(file)
            order = np.frombuffer(_unpacked(stream.schema.metadata[b"order"])[1], "<u4")
            size, first = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            size[order], first[order] = sizes, np.cumsum(sizes) - sizes
            for part in stream:
                planes = [W.buffers(c) for c in part.columns[1:]]
                codes = sum(np.frombuffer(d.tobytes(), "<u2" if most > 255 else "u1").astype(np.int64) << shift for (d, _), (_, shift, most) in zip(planes, _PLANES, strict=True))
                n = size[codes]
                ends = np.concatenate([[0], np.cumsum(n)])[planes[0][1]]
                values = ids[_gather(first[codes], n)]
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))], ["row", "ids"])

    held: list[bytes] = []
    for batch in batches:
        for block, parts, ids in zip(*(c.to_pylist() for c in batch.columns[1:4]), strict=True):
            held.append(ids)
            if len(held) == parts:
                yield from given(block, held)
                held = []
    if held:
        raise ValueError("a block came without some of its words")


class Encoded(NamedTuple):
    """Blocks whose codes are replaced by ids when rows are asked for."""

    blocks: DataFrame
    given: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
    schema: StructType

    def rows(self) -> DataFrame:
        return self.blocks.mapInArrow(self.given, self.schema)


def encode(docs: DataFrame, scratch: Scratch, tokenizer: str, special: bool = True, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Encoded:
    """Per row of ``docs``: ``row`` (all its columns but the text, as a struct, so that no names can
    clash) and ``ids array<int>``, those of the library's ``encode(text, add_special_tokens=False)``.

    With ``special``, special tokens' names in a text are those tokens, as the library has it; else
    they are ordinary text. Null and empty texts have no ids. Repeated rows come out repeatedly.
    ``tokenizer`` is a byte-level tokenizer's file, found at the same path by every task. A job runs
    while the plan is built. Words and positions stay in ``scratch``, as the result reads them.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    named = F.struct(*rest) if rest else F.struct(F.lit(None).cast("int").alias("none"))
    rows = small_batches(docs).select(named.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    folder = scratch.path(f"codes-{uuid.uuid4().hex}")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_BYTES))
    split = lambda it: _split(it, folder, tokenizer, special, block_bytes, buckets)
    found = scratch.save(rows.mapInArrow(split, "bucket long, block long, parts int, words binary"))
    near = found.repartition("bucket").sortWithinPartitions("bucket")
    made = near.mapInArrow(lambda it: _encoded(it, tokenizer, special), "bucket long, block long, parts int, ids binary")
    parts = min(MOST_PARTS, max(1, found.select("block").distinct().count()))
    back = made.repartition(parts, "block").sortWithinPartitions("block", "bucket")
    schema = StructType([rows.schema["row"]]).add("ids", ArrayType(IntegerType()))
    width = Tokenizer.at(tokenizer, special).width
    return Encoded(back, lambda it: _replaced(it, folder, width), schema)


# -- pieces


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of rows, each behind its distinct ids: ``slice, place, id, row, ids``."""
    number = 0
    for batch in batches:
        rows, lists = batch.columns
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        at = 0
        while at < len(size):
            to = max(at + 1, min(len(size), int(np.searchsorted(ends, ends[at] + SLICE_IDS, "right")) - 1))
            own = pc.drop_null(lists[at:to].flatten().unique())
            n, m = len(own), to - at
            yield pa.record_batch(
                [
                    pa.array(np.full(n + m, number)),
                    pa.array(np.concatenate([np.full(n, -1), np.arange(m)])),
                    pa.concat_arrays([own.cast(pa.int32()), pa.nulls(m, pa.int32())]),
                    pa.concat_arrays([pa.nulls(n, rows.type), rows[at:to]]),
                    pa.concat_arrays([pa.nulls(n, lists.type), lists[at:to]]),
                ],
                ["slice", "place", "id", "row", "ids"],
            )
            number += 1
            at = to


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the pieces of their slice's ids before them, to ``row, ids, text``."""
    now, told, piece = None, [], []
    table = None  # the slice's ids in order, with bounds and bytes of their pieces

    def text(own: pa.Array) -> list[str]:
        """The texts of some lists of ids."""
        flat = own.flatten()
        size = pc.fill_null(pc.list_value_length(own), 0).to_numpy().astype(np.int64)
        known, first, length, data = table
        values = flat.fill_null(-1).to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(known, values), len(known) - 1) if len(known) else values * 0
        if len(known) and (wrong := (known[at] != values) & (values >= 0)).any() or not len(known) and (values >= 0).any():
            raise ValueError("a row came without its pieces")
        n = np.where(values >= 0, length[at], 0) if len(known) else values * 0
        flat = data[_gather(first[at], n)].tobytes() if len(known) else b""
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(size)])].tolist()
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]

    for batch in batches:
        number, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        key = number * 2 + (place >= 0)
        edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if number[a] != now:
                now, told, piece, table = number[a], [], [], None
            if place[a] < 0:
                told.append(batch.column(2)[a:b])
                piece.append(batch.column(5)[a:b])
                continue
            if table is None:
                ids = pa.concat_arrays(told).to_numpy().astype(np.int64) if told else _NONE
                by = np.argsort(ids)
                data, bounds = W.buffers(pa.concat_arrays(piece)) if piece else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
                table = ids[by], bounds[:-1][by], np.diff(bounds)[by], data
            lists = batch.column(4)[a:b]
            yield pa.record_batch([batch.column(3)[a:b], lists, pa.array(text(lists), pa.string())], ["row", "ids", "text"])


def decode(encoded: DataFrame | Encoded, tokenizer: str) -> DataFrame:
    """``row, ids, text`` of rows ``row, ids``: the library's ``decode(ids, skip_special_tokens=False)``.

    Bytes that are no UTF-8 become U+FFFD; null ids, and ids that the vocabulary lacks, are left out,
    and null lists are empty texts. The pieces are broadcast, as the vocabulary bounds them, so that
    rows stay in their tasks.
    """
    if isinstance(encoded, Encoded):  # in one Python worker
        source, given, schema = encoded
        run = lambda it: _asked(given(it))
    else:
        source = small_batches(encoded).select("row", F.col("ids").cast("array<int>"))
        schema, run = source.schema, _asked
    table = source.sparkSession.createDataFrame(pieces(tokenizer), "id int, piece binary")
    asked = StructType().add("slice", LongType()).add("place", LongType()).add("id", IntegerType())
    asked = asked.add("row", schema["row"].dataType).add("ids", ArrayType(IntegerType()))
    joined = source.mapInArrow(run, asked).join(F.broadcast(table), "id", "left")
    joined = joined.select("slice", "place", "id", "row", "ids", "piece").sortWithinPartitions("slice", "place")
    out = StructType([schema["row"]]).add("ids", ArrayType(IntegerType())).add("text", StringType())
    return joined.mapInArrow(_joined, out)
