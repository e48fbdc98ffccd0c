"""Repeated word runs against counting all runs."""

import hashlib
import re
from collections import Counter

import pytest

from atlasledger.llm import substrings
from atlasledger.llm.queries import QUERIES
from atlasledger.llm.substrings import repeated_runs
from llm_texts import prose


def brute(texts, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def nulls(doc_id):
    return -1 if doc_id is None else doc_id


def told(df):
    return sorted((nulls(r["row"].doc_id), r.n_words, r.n_removed, r.kept_text) for r in df.collect())


def want(rows, width):
    return sorted((nulls(i), *x) for (i, _), x in zip(rows, brute([t for _, t in rows], width), strict=True))


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op6_repeated_runs"](spark, sf).collect())
    assert got == [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in want(rows, 35)]


@pytest.mark.parametrize("width", [2, 3, 34, 35])
def test_shifts_self_repeats_and_shared_passages(make, width, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP_BYTES", 3000)  # many groups
    shared = prose(9, 60)
    rows = [(k, f"{prose(100 + k, k)} {shared}\n{prose(200 + k, 40)}") for k in range(25)]
    rows += [(30, f"{prose(8, 35)} {prose(7, 3)}\t{prose(8, 35)}"), (31, prose(9, 60).replace(" ", "\n")), (32, prose(9, 34))]
    rows += [(33, "a a a a " * 30), (34, "é" + prose(6, 50)), (35, prose(6, 50)), (36, prose(6, 35) + "!")]
    out = repeated_runs(make(rows), width)
    assert told(out) == want(rows, width)
    for r in out.collect():
        assert sum(s.end - s.first for s in r.removed) == r.n_removed


def test_awkward_rows(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    out = repeated_runs(awkward)
    assert told(out) == want(rows, 35)
    assert out.select("row.*").columns == awkward.columns


def test_empty_table(make):
    assert repeated_runs(make([])).count() == 0
