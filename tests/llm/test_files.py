"""WARC archives, token files and their parts: exact round trips."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from atlasledger.llm import token_files, warc
from atlasledger.llm.elias_fano import EliasFano, encoded
from atlasledger.llm.files import ranges, written
from atlasledger.llm.queries import QUERIES, TOKENIZER, VOCABULARY
from atlasledger.llm.tokens import encoder
from atlasledger.session import Scratch

PAGES = "page_id long, url string, html string, archive string, digest int"


@pytest.fixture(scope="session")
def library():
    out = Tokenizer.from_file(TOKENIZER)
    out.encode_special_tokens = True
    return out


@given(st.lists(st.integers(0, 1 << 62), max_size=600), st.integers(0, 700), st.integers(0, 700))
@settings(deadline=None)
def test_elias_fano(values, a, b):
    values.sort()
    code = encoded(np.array(values, np.uint64))
    found = EliasFano(code)
    assert len(found) == len(values)
    assert found.select(0, len(values)).tolist() == values
    assert found.select(a, b).tolist() == values[a:b]
    if values:
        assert found[len(values) - 1] == values[-1]
    with pytest.raises(IndexError):
        found[len(values)]


def test_elias_fano_is_small_and_strict():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    code = encoded(ends)
    assert len(code) * 8 / len(ends) < 2 + np.log2(1000) + 1  # a table of 64-bit offsets takes 64
    assert (EliasFano(code).select(70_001, 70_900) == ends[70_001:70_900].astype(np.uint64)).all()
    assert EliasFano(encoded(np.full(1000, 5))).select(0, 1000).tolist() == [5] * 1000
    with pytest.raises(ValueError):
        encoded(np.array([3, 2]))


def test_ranges_are_read_together():
    spans = [(0, 10), (10, 5), (40, 5), (200, 50), (251, 100)]
    assert list(ranges(spans, 25, 1000)) == [(0, 45, [0, 1, 2]), (200, 151, [3, 4])]
    assert list(ranges(spans, 25, 100)) == [(0, 45, [0, 1, 2]), (200, 50, [3]), (251, 100, [4])]
    assert list(ranges([], 1, 1)) == []


def test_a_failed_write_leaves_no_file(tmp_path):
    with pytest.raises(RuntimeError), written(str(tmp_path), "x") as out:
        out.write(b"half")
        raise RuntimeError
    assert not list(tmp_path.iterdir())


def test_chunks_give_the_library_s_ids(library):
    rng = random.Random(1)
    parts = ["a", "the", "'s", "'ll", "'", "  ", " ", "\n", "\t", "é", "Ñ", "²", "1", "23", "!!", "<|endoftext|>", "\x0b", " ", "—", "日本", "’", "\r\n", "_", "ß", "\x1c", "\x85", "​", "🙂"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    spaces = ["a", "b", ".", " ", " ", "\n", "\t", "\x0b", "\r", "'s", "1"]  # nothing that is encoded whole
    texts += ["".join(rng.choice(spaces) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    got = [ids for k in range(0, len(texts), 100) for ids in encoder(TOKENIZER)(texts[k : k + 100])]
    for text, own, ids in zip(texts, got, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own == np.array(ids.ids, "<u4").tobytes(), repr(text)
    assert encoder(TOKENIZER)([None, ""]) == [b"", b""]


def expected_tokens(rows, library, end_id):
    """Per document of rows in file order."""
    at, out = 0, []
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_query(spark, sf, library):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = QUERIES["op3_token_files"](spark, sf).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == expected_tokens(rows, library, 2)


@pytest.mark.parametrize("vocabulary,width", [(VOCABULARY, 2), (100_000, 4)])
def test_token_files_of_awkward_rows(spark, awkward, library, monkeypatch, vocabulary, width):
    monkeypatch.setattr(token_files, "READ_BYTES", 1000)
    scratch = Scratch(spark)
    manifest, folder = token_files.write_token_files(awkward, scratch, TOKENIZER, 2, vocabulary, files=5)
    assert manifest.count() > 1
    got = token_files.read_token_files(manifest, folder).orderBy("start").collect()
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    texts = {}
    for r in awkward.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        texts.setdefault(r.doc_id, []).append(ids)
    at = 0
    for r in got:
        texts[r.doc_id].remove(list(r.ids))
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert not any(texts.values())
    store, path = token_files.opened(folder)
    name = manifest.orderBy("part").first()["name"]
    assert token_files.TokenFile(store, f"{path}/{name}").width == width


def test_far_apart_ids_and_empty_table(spark, make):
    scratch = Scratch(spark)
    low, high = -(1 << 63), (1 << 63) - 1
    manifest, folder = token_files.write_token_files(make([(high, "a"), (low, "b"), (0, "c")]), scratch, TOKENIZER, 2)
    assert [r.doc_id for r in token_files.read_token_files(manifest, folder).orderBy("start").collect()] == [low, 0, high]
    manifest, folder = token_files.write_token_files(make([]), Scratch(spark), TOKENIZER, 2)
    assert token_files.read_token_files(manifest, folder).count() == 0


def test_a_cut_token_file_is_an_error(spark, make):
    scratch = Scratch(spark)
    manifest, folder = token_files.write_token_files(make([(1, "some text")]), scratch, TOKENIZER, 2)
    store, path = token_files.opened(folder)
    whole = f"{path}/{manifest.first()['name']}"
    data = open(whole, "rb").read()
    with open(whole, "wb") as out:
        out.write(data[1:])
    with pytest.raises(ValueError):
        token_files.TokenFile(store, whole)


def archived(spark, pages):
    index, folder = warc.write_archives(pages, Scratch(spark))
    return index, folder, warc.read_records(index, folder).collect()


def expected_types(rows):
    first = {}
    for page_id, _, html in rows:
        own = (html or "").encode()
        if len(own) >= 100 and page_id is not None:
            first[own] = min(first.get(own, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        own = (html or "").encode()
        to = first.get(own) if len(own) >= 100 else None
        revisit = to is not None and to != page_id
        out.append((page_id, len(own), hashlib.sha256(own).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=repr)


def test_warc_query(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = QUERIES["op2_warc"](spark, sf).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected_types(rows)


def test_warc_of_awkward_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 20)
    big, hot = "<p>" + "grün 日本 " * 200_000, "copy " * 40
    rows = [(1, "http://a/ b\r\nX: y", None), (2, None, ""), (3, "u", "x" * 99), (4, "u", "x" * 99), (5, "http://ü", "y" * 100), (6, "u", "y" * 100)]
    rows += [(7, "u", big), (8, "u", big), (None, "u", hot), (9, "u", "a\r\n\r\nb" * 50), (9, "u", "a\r\n\r\nb" * 50), (None, None, "z" * 200), (None, None, "z" * 200)]
    rows += [(100 + k, f"u{k}", hot) for k in range(300)]
    pages = spark.createDataFrame([(*r, "n", 1) for r in rows], PAGES)
    index, folder, got = archived(spark, pages)
    told = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr)
    assert told == expected_types(rows)
    urls = sorted(((r.page_id, r.url) for r in got), key=repr)
    assert urls == sorted(((i, u) for i, u, _ in rows), key=repr)
    for r in got:
        own = bytes(r.payload)
        assert own == b"" if r.record_type == "revisit" else hashlib.sha256(own).hexdigest() == r.payload_digest
    assert index.select("archive").distinct().count() > 1
    # every archive is a chain of gzip members that the index cuts apart
    path = folder.removeprefix("file:")
    for name, own in {r.archive: None for r in index.collect()}.items():
        whole = open(f"{path}/{name}", "rb").read()
        own = sorted((r.offset, r.length) for r in index.collect() if r.archive == name)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) == len(whole)
        assert gzip.decompress(whole) == b"".join(gzip.decompress(whole[o : o + n]) for o, n in own)
    # some records only
    some = index.where("page_id % 50 = 0")
    assert {r.page_id for r in warc.read_records(some, folder, payloads=False).collect()} == {100 + k for k in range(300) if (100 + k) % 50 == 0}


def test_warc_of_no_pages(spark):
    assert archived(spark, spark.createDataFrame([], PAGES))[2] == []


def test_a_damaged_record_is_an_error(spark):
    index, folder, _ = archived(spark, spark.createDataFrame([(1, "u", "some page", "n", 1)], PAGES))
    row = index.first()
    path = f"{folder.removeprefix('file:')}/{row.archive}"
    raw = gzip.decompress(open(path, "rb").read()).replace(b"some page", b"same page")
    with open(path, "wb") as out:
        out.write(warc._gzip(raw))
    with pytest.raises(Exception, match="digest"):
        warc.read_records(index, folder).collect()


def test_files_follow_the_size_of_the_texts(spark, make, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 1000)
    docs = make([(i, "some words of a text " * 10) for i in range(60)])
    with Scratch(spark) as scratch:
        manifest, folder = token_files.write_token_files(docs, scratch, TOKENIZER, 2, 50_257)
        assert manifest.count() > 8  # 12,600 bytes; 4 shuffle partitions
        got = token_files.read_token_files(manifest, folder).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(60))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(60)]
