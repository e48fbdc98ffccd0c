"""The Arrow word kernel against regular expressions."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from atlasledger.llm import words as W

TEXTS = st.lists(st.none() | st.text("ab\x0b\t \né日\x1c.A", max_size=30), max_size=8)


@given(TEXTS)
@settings(deadline=None)
def test_words_and_hashes(texts):
    found = W.split(*W.buffers(pa.array(texts, pa.string())))
    data = found.data.tobytes()
    got = [data[a:b].decode() for a, b in zip(found.start, found.end, strict=True)]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert got == [w for own in want for w in own]
    assert np.diff(found.first).tolist() == [len(w) for w in want]
    hashed = W.hashes(found)
    assert len(set(zip(got, hashed.tolist(), strict=True))) == len(set(got)) == len(set(hashed.tolist()))
    low = W.hashes(found, lower=True)
    lowered = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in got]
    assert len(set(low.tolist())) == len(set(lowered))


@given(st.lists(st.sampled_from("abc"), max_size=40), st.integers(1, 37))
@settings(deadline=None)
def test_windows_know_their_items(items, width):
    hashed = np.array([W.mixed(np.array([ord(c)], np.uint64))[0] for c in items], np.uint64)
    runs = W.windows(hashed, width)
    want = [tuple(items[k : k + width]) for k in range(len(items) - width + 1)]
    assert len(runs) == len(want)
    assert len(set(runs.tolist())) == len(set(want)) == len(set(zip(want, runs.tolist(), strict=True)))


def test_long_words_and_slices():
    texts = ["x" * 10_000, "x" * 10_001, None, "y"]
    hashed = W.hashes(W.split(*W.buffers(pa.array(texts))))
    assert len(set(hashed.tolist())) == 3
    assert list(W.slices(np.array([0, 5, 6, 30, 31]), 10)) == [(0, 2), (2, 3), (3, 4)]
    assert list(W.slices(np.array([0]))) == []


def test_a_slice_of_a_column_is_read_at_its_place():
    column = pa.array(["a b", "c d", "e"]).slice(1)
    data, bounds = W.buffers(column)
    assert data.tobytes() == b"c de" and bounds.tolist() == [0, 3, 4]
