"""Token files: a concatenated array of ids per file, with Elias-Fano coded document boundaries.

File: ids (unsigned little-endian, ``width`` bytes each), the code of the boundaries (ids up to the
end of each document), the code of the document ids above the least one, then a fixed-size foot that
says where each begins. A reader takes the foot and the codes, and reads ids by byte range.
Files hold ranges of document ids in ascending order; the manifest table lists them.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atlasledger.llm.elias_fano import EliasFano, encoded
from atlasledger.llm.files import opened, written
from atlasledger.llm.tokens import encoder
from atlasledger.session import Scratch, small_batches

READ_BYTES = 8 << 20
#: Text per file at most, on average; there are no fewer files than Spark has shuffle partitions.
FILE_BYTES = 256 << 20
MAGIC = b"EFIDS\x001\x00"
#: magic, width, documents without an id, documents, ids, bytes of both codes, least document id
_FOOT = struct.Struct("<8sBQQQQQq")
_MANIFEST = "part int, name string, n_docs long, n_ids long"


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    encode, kind = encoder(path), f"<u{width}"
    end = np.array([end_id], "<u4").tobytes()
    part = TaskContext.get().partitionId()
    name = f"ids-{part:06d}.bin"
    batches = (b for b in batches if b.num_rows)
    first = next(batches, None)
    if first is None:
        return
    sizes, ids, total = [], [], 0

    def some() -> Iterator[pa.RecordBatch]:
        yield first
        yield from batches

    with written(folder, name) as file:
        for batch in some():
            ids += batch.column(0).to_pylist()
            for packed in encode(batch.column(1).to_pylist()):
                packed += end
                sizes.append(len(packed) // 4)
                file.write(packed if width == 4 else np.frombuffer(packed, "<u4").astype(kind).tobytes())
        known = [i for i in ids if i is not None]
        least = known[0] if known else 0
        ends = np.cumsum(np.array(sizes, np.uint64))
        total = int(ends[-1])
        # Python integers: ids may be as far apart as 64 bits allow
        codes = encoded(ends), encoded(np.array([i - least for i in known], np.uint64))
        for code in codes:
            file.write(code)
        file.write(_FOOT.pack(MAGIC, width, len(ids) - len(known), len(ids), total, *map(len, codes), least))
    yield pa.record_batch(
        [pa.array([part], pa.int32()), pa.array([name]), pa.array([len(ids)]), pa.array([total])],
        [c.split()[0] for c in _MANIFEST.split(", ")],
    )


def write_token_files(
    docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int, vocabulary: int = 1 << 16, files: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, str]:
    """Encodes every text, appends ``end_id`` and writes files below ``scratch``, by ascending id.

    ``vocabulary`` is above every id; up to 65,536 an id takes two bytes. Null texts are empty; rows
    without an id come first. Equal ids are ordered by their texts. The number of files follows the
    size of the texts, unless ``files`` says it, so that a task's lists and codes stay bounded. Gives the
    manifest with ``start``, the number of ids in all files before, and the files' folder.
    """
    folder = scratch.path("ids")
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    if files is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / FILE_BYTES))
    # the tie splits an id that very many rows share
    near = rows.repartitionByRange(files, "doc_id", "tie")
    near = near.sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    manifest = scratch.save(near.mapInArrow(lambda it: _write(it, folder, tokenizer, end_id, width), _MANIFEST))
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("start", F.coalesce(before, F.lit(0))), folder


class TokenFile:
    """One file, opened by its foot."""

    def __init__(self, store, path: str) -> None:
        self._file = store.open_input_file(path)
        end = self._file.size()
        foot = _FOOT.unpack(self._at(end - _FOOT.size, _FOOT.size))
        magic, self.width, self.n_null, self.n_docs, self.n_ids, one, two, self.least = foot
        if magic != MAGIC or end != self.n_ids * self.width + one + two + _FOOT.size:
            raise ValueError(f"{path} is no token file, or is cut")
        at = self.n_ids * self.width
        self.ends = EliasFano(self._at(at, one))
        self.ids = EliasFano(self._at(at + one, two))

    def _at(self, offset: int, length: int) -> bytes:
        self._file.seek(offset)
        return self._file.read(length)

    def doc_ids(self, start: int, stop: int) -> list[int | None]:
        known = self.ids.select(max(0, start - self.n_null), max(0, stop - self.n_null)).tolist()
        return [None] * max(0, min(stop, self.n_null) - start) + [self.least + i for i in known]

    def bounds(self, start: int, stop: int) -> np.ndarray:
        """Ids before document ``start``, then up to the end of each until ``stop``."""
        before = [0] if start == 0 else [self.ends[start - 1]]
        return np.concatenate([np.array(before, np.int64), self.ends.select(start, stop).astype(np.int64)])

    def tokens(self, begin: int, end: int) -> np.ndarray:
        return np.frombuffer(self._at(begin * self.width, (end - begin) * self.width), f"<u{self.width}")


def _read(batches: Iterator[pa.RecordBatch], folder: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    store, path = opened(folder)
    for batch in batches:
        for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            file = TokenFile(store, f"{path}/{name}")
            at = 0
            while at < file.n_docs:
                bounds = file.bounds(at, at + 4096)
                most = max(1, int(np.searchsorted(bounds, bounds[0] + READ_BYTES // file.width, "right")) - 1)
                bounds = bounds[: most + 1]
                own = file.tokens(int(bounds[0]), int(bounds[-1])).astype("<u4")
                cut = (bounds - bounds[0]).tolist()
                parts = [own[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                columns = [
                    pa.array(file.doc_ids(at, at + most), pa.int64()),
                    pa.array(bounds[:-1] + start),
                    pa.array(np.diff(bounds)),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    values = pa.array(own.astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), values))
                    names.append("ids")
                yield pa.record_batch(columns, names)
                at += most


def read_token_files(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids array<int>``."""
    files = manifest.count()
    asked = manifest.select("name", "start").repartition(max(1, files), "name")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return asked.mapInArrow(lambda it: _read(it, folder, with_ids), schema)
