"""Packed sequences: every id once, gapless, within all limits."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from atlasledger.llm import packing
from atlasledger.llm.packing import Limits, Packer, Piece, pack_documents, pack_examples
from atlasledger.llm.queries import QUERIES, TOKENIZER


def checked(rows, ids, limits, loss=None, full=True):
    """Everything that holds of any result; ``ids`` is a list of (id, array). Gives the padding."""
    left = defaultdict(list)
    for doc_id, own in ids:
        left[doc_id].append(own)
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    assert set(pieces) == {i for i, own in ids if len(own)}
    for doc_id, own in pieces.items():
        if len(left[doc_id]) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                whole = left[doc_id][0]
                assert r.start == at and r.doc_tokens == len(whole)
                assert r.ids_crc32 == zlib.crc32(whole[at : at + r.length].tobytes())
                at += r.length
            assert at == len(left[doc_id][0])
        else:
            assert sum(r.length for r in own) == sum(map(len, left[doc_id]))
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= limits.tokens and len(own) <= limits.segments
        assert sum(r.loss_tokens for r in own) <= limits.loss
        padding += limits.tokens - at if at & (at - 1) else 0
        if full:
            assert at == limits.tokens or not at & (at - 1) or len(own) == limits.segments
    return padding


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(TOKENIZER)
    out.encode_special_tokens = True
    return out


def encoded(library, rows):
    return [(i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for i, t in rows]


def test_query(spark, sf, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op4_packing"](spark, sf).collect()
    assert checked(got, encoded(library, rows), Limits()) == 0


def test_awkward_rows_and_other_limits(awkward, library):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = pack_documents(awkward, TOKENIZER, 0, Limits(100, 3, 64), with_ids=True).collect()
    checked(got, encoded(library, rows), Limits(100, 3, 64), full=False)
    assert all(len(r.ids) == r.length for r in got)


def test_empty_table(make):
    assert pack_documents(make([]), TOKENIZER, 0).count() == 0


def test_examples_stay_whole_and_keep_all_limits(spark):
    rng = random.Random(4)
    limits = Limits(64, 4, 30)
    rows = []
    for k in range(3000):
        n = rng.choice([1, 5, 20, 40, 64, 90])
        rows.append((k, [rng.randint(0, 50_000) for _ in range(n)], [rng.random() < 0.4 for _ in range(n)]))
    rows += [(9001, [], []), (9002, None, None), (9003, [1, 2], None), (9004, [1, 2], [None, True])]
    frame = spark.createDataFrame(rows, "example_id long, ids array<int>, loss array<boolean>")
    got = pack_examples(frame, limits).collect()
    checked(got, [(i, np.array(x or [], "<u4")) for i, x, _ in rows], limits, full=False)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, ids, mask in rows:
        bearing = sum(map(bool, mask or []))
        assert sum(r.loss_tokens for r in by[i]) == bearing
        if ids and len(ids) <= limits.tokens and bearing <= limits.loss:
            assert len(by[i]) == 1
    # a first-fit decreasing bound: far from one sequence each, and bins well filled
    used = len({r.sequence_id for r in got})
    least = max(sum(r.length for r in got) / 64, sum(r.loss_tokens for r in got) / 30, len(got) / 4)
    assert used < 1.15 * least
    again = pack_examples(frame, limits, cut=True).collect()
    checked(again, [(i, np.array(x or [], "<u4")) for i, x, _ in rows], limits, full=False)


def test_a_mask_of_another_length_is_an_error(spark):
    frame = spark.createDataFrame([(1, [1, 2], [True])], "example_id long, ids array<int>, loss array<boolean>")
    with pytest.raises(Exception, match="marks"):
        pack_examples(frame, Limits()).collect()


def test_dot_product_fills_a_scarce_limit_first():
    """With loss scarce, loss-heavy and loss-free pieces share sequences."""
    packer = Packer(Limits(100, 10, 50), cut=False)
    out = []
    for k in range(40):
        ids = np.zeros(50, "<u4")
        mask = np.full(50, k % 2 == 0)
        out += list(packer.add(Piece(k, ids, np.concatenate([[0], np.cumsum(mask)]), 0, 50)))
    out += list(packer.end())
    assert len(out) == 20 and all({p.doc_id % 2 for p in s} == {0, 1} for s in out)


def test_limits_must_allow_something():
    with pytest.raises(ValueError):
        Packer(Limits(0, 1, 1))


def test_the_pool_stays_bounded(monkeypatch):
    monkeypatch.setattr(packing, "POOL", 64)
    packer = Packer(Limits())
    for k in range(5000):
        list(packer.add(Piece(k, np.zeros(37, "<u4"), None, 0, 37)))
        assert len(packer._pool) <= 64
