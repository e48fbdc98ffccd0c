"""WARC archives, index first.

Writing: records are dealt to archives of about ``ARCHIVE_BYTES`` of payload by a hash of id and
digest, each archive is one file of gzip members, and the index has each record's archive, offset,
length, URL and digest. Of equal payloads one is stored, the others are revisit records. Equal
payloads are found on (id, digest) alone; payloads cross the network once.

Reading: selected index rows are sorted by archive and offset, neighbouring byte ranges are read
together, and every member is checked against its digest.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasledger.llm.files import opened, ranges, written
from atlasledger.session import Scratch

ARCHIVE_BYTES = 32 << 20
#: Shorter payloads are always stored: a revisit record would be no smaller.
LEAST_REVISIT = 100
GAP, MOST = 64 << 10, 8 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = (
    "page_id long, url string, archive string, offset long, length long, payload_digest string, "
    "payload_bytes long, record_type string, refers_to long"
)
_READ = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_uri(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:  # a header line cannot hold white space or control characters
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~%"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields (lower-case names) of the record and of its HTTP head, and the HTTP body."""

    def fields(head: bytes) -> dict[str, str]:
        return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}

    head, _, rest = raw.partition(b"\r\n\r\n")
    named = fields(head)
    block = rest[: int(named["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return named, fields(http), body


def _gzip(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _written(table: pa.Table, first: pa.Table, folder: str) -> pa.Table:
    """Writes one archive; ``first`` has the least id of payloads that come more than once."""
    out = []
    if table.num_rows:
        stored = dict(zip(first.column("digest").to_pylist(), first.column("first_id").to_pylist(), strict=True))
        name = f"pages-{table.column('part')[0].as_py():06d}.warc.gz"
        offset = 0
        with written(folder, name) as file:
            # by row: one record at a time is turned into Python objects
            for k in range(table.num_rows):
                page_id, url, digest = (table.column(c)[k].as_py() for c in ("page_id", "url", "digest"))
                payload = table.column("payload")[k].as_py()
                refers_to = stored.get(digest) if len(payload) >= LEAST_REVISIT else None
                refers_to = None if refers_to == page_id else refers_to
                member = _gzip(record(page_id, url, payload, digest, refers_to))
                file.write(member)
                kind = "response" if refers_to is None else "revisit"
                out.append((page_id, url, name, offset, len(member), digest, len(payload), kind, refers_to))
                offset += len(member)
    columns = list(zip(*out, strict=True)) or [[]] * 9
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in _INDEX.split(", ")]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})


def write_archives(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> tuple[DataFrame, str]:
    """Writes ``pages`` as archives below ``scratch``; gives the index and the archives' folder.

    A null payload is empty. Of records with equal payloads of ``LEAST_REVISIT`` bytes or more, the
    one with the least id is the response and the others are revisits; records without an id come
    after all others, and if none has an id all are responses. Rows that repeat id and payload of a
    response are responses too. Null URLs have no header field. Other columns are not read.
    """
    folder = scratch.path("warc")
    size = pages.agg(F.sum(F.octet_length(payload_col))).first()[0] or 0
    parts = max(1, math.ceil(size / ARCHIVE_BYTES))

    def rows() -> DataFrame:
        payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
        out = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
        out = out.withColumn("digest", F.sha2("payload", 256))
        return out.withColumn("part", F.pmod(F.xxhash64("page_id", "digest"), F.lit(parts)).cast("long"))

    keys = rows().withColumn("size", F.octet_length("payload")).drop("payload", "url")
    shared = (
        keys.where(F.col("size") >= LEAST_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 and first_id is not null")
    )
    first = keys.select("part", "digest").distinct().join(shared.select("digest", "first_id"), "digest")
    index = rows().groupBy("part").cogroup(first.groupBy("part")).applyInArrow(lambda t, f: _written(t, f, folder), _INDEX)
    return scratch.save(index), folder


def _read(batches: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    store, path = opened(folder)
    names = [c.split()[0] for c in _READ.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        archive, offset, length = (c.to_pylist() for c in batch.columns[:3])
        url, digest = (c.to_pylist() for c in batch.columns[3:])
        at = 0
        while at < len(archive):
            to = at
            while to < len(archive) and archive[to] == archive[at]:
                to += 1
            with store.open_input_file(f"{path}/{archive[at]}") as file:
                spans = list(zip(offset[at:to], length[at:to], strict=True))
                for start, size, held in ranges(spans, GAP, MOST):
                    file.seek(start)
                    data = file.read(size)
                    out = []
                    for k in held:
                        own = spans[k][0] - start
                        raw = zlib.decompress(data[own : own + spans[k][1]], 31)
                        named, http, body = parsed(raw)
                        told = named["warc-payload-digest"].removeprefix("sha256:")
                        kind = named["warc-type"]
                        if told != digest[at + k] or kind == "response" and hashlib.sha256(body).hexdigest() != told:
                            raise ValueError(f"{archive[at]} at {spans[k][0]}: digest does not match")
                        number = lambda field, named=named: int(n) if (n := named.get(field, "")[10:-1]) else None
                        full = int(http["content-length"])
                        if kind == "response" and len(body) != full:
                            raise ValueError(f"{archive[at]} at {spans[k][0]}: payload is cut")
                        out.append((number("warc-record-id"), url[at + k], kind, number("warc-refers-to"), told, full, body))
                    columns = list(zip(*out, strict=True))
                    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=False)]
                    if payloads:
                        arrays.append(pa.array(columns[6], pa.binary()))
                    yield pa.record_batch(arrays, names + ["payload"] * payloads)
            at = to


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that rows of an index name, with ``payload`` (revisits: empty) if asked for.

    Fails on a record whose payload does not match its digest.
    """
    asked = index.select("archive", "offset", "length", "url", "payload_digest")
    archives = asked.select("archive").distinct().count()
    near = asked.repartition(max(1, archives), "archive").sortWithinPartitions("archive", "offset")
    return near.mapInArrow(lambda it: _read(it, folder, payloads), _READ + ", payload binary" * payloads)
