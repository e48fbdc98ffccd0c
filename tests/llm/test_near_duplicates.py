"""Near-duplicates against all pairs, on tables where that is feasible."""

import random
import re

import numpy as np
import pytest

from atlasledger.llm import near_duplicates as N
from atlasledger.llm.components import components
from atlasledger.session import Scratch

from llm_texts import prose


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def brute(rows, percent):
    """By distinct set, as the operator: ``{row number: (size, component)}``."""
    own = [sets(t) for _, t in rows]
    named = {}
    for (i, _), s in zip(rows, own, strict=True):
        if s:
            named.setdefault(s, []).append(i)
    keys = list(named)
    least = {s: min((i for i in ids if i is not None), default=None) for s, ids in named.items()}
    root = {s: s for s in keys}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for k, a in enumerate(keys):
        for b in keys[:k]:
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                root[find(a)] = find(b)
    part = {}
    for s in keys:
        part.setdefault(find(s), []).append(least[s])
    out = []
    for (i, _), s in zip(rows, own, strict=True):
        out.append((i, len(s), min((x for x in part[find(s)] if x is not None), default=None) if s else i))
    return sorted(out, key=repr)


def told(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def edited(text, rate, seed):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > rate else f"z{rng.randint(0, 9999)}" for w in text.split(" "))


def test_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = N.near_duplicates(docs, 85)
    assert told(out) == brute(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


@pytest.mark.parametrize("rate", [0.01, 0.03, 0.05])
def test_a_large_group_around_the_threshold(make, rate, monkeypatch):
    """Links between members that are none of the group's least, and blocks of a group."""
    monkeypatch.setattr(N, "BLOCK", 16)
    base = prose(5, 150)
    rows = [(i, edited(base, rate, i)) for i in range(90)] + [(500, base), (501, base.upper())]
    assert told(N.near_duplicates(make(rows), 85)) == brute(rows, 85)


def test_awkward_rows(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    out = N.near_duplicates(awkward, 80)
    assert told(out) == brute(rows, 80)
    assert {(r.doc_id, r.kept) for r in out.collect() if r.doc_id in (1, 2, 3, 4, 8)} == {(1, True), (2, True), (3, True), (4, True), (8, False)}


def test_repeated_ids_of_different_texts_and_none(make):
    """Links are those of the texts, whatever ids they share or lack."""
    a, b, c = prose(1, 200), prose(2, 200), prose(3, 200)
    rows = [(5, a), (5, b), (8, b + " one"), (None, a + " one"), (None, c), (None, c + " one"), (9, c + " two words"), (None, prose(4, 50)), (5, a), (2, a + " x")]
    for given in (rows, rows[::-1]):
        out = N.near_duplicates(make(given), 85)
        assert told(out) == brute(given, 85)
        got = {(r.doc_id, r.n_shingles): r.component_id for r in out.collect()}
        assert got[8, 197] == 5 and got[5, 196] in (2, 5) and {r.component_id for r in out.collect() if r.doc_id == 9} == {9}


def test_the_pair_stage_grows_with_the_input(make, spark, monkeypatch):
    """One template whose copies are all just below the threshold: rows sent are a share of rows."""
    sent = {}
    for n in (200, 400, 800):
        base = prose(5, 40).split()
        rng = random.Random(n)
        rows = []
        for i in range(n):
            words = list(base)
            words[rng.randrange(40)] = f"z{i}"
            rows.append((i, " ".join(words)))
        held = {}

        def counted(member, part, sets, texts, percent, real=N._unconnected, held=held):
            repartition = type(member).repartition

            def told(self, *cols):
                if cols == ("key", "low", "high"):
                    held["rows"] = self.count()
                return repartition(self, *cols)

            monkeypatch.setattr(type(member), "repartition", told)
            try:
                return real(member, part, sets, texts, percent)
            finally:
                monkeypatch.setattr(type(member), "repartition", repartition)

        with monkeypatch.context() as patch:
            patch.setattr(N, "_unconnected", counted)
            out = N.near_duplicates(make(rows), 85)
            assert out.where("kept").count() >= 1
        sent[n] = held["rows"]
    assert sent[800] < 6 * max(sent[200], 1)


def test_empty_table(make):
    assert N.near_duplicates(make([])).count() == 0


def test_sketches_agree_like_the_sets():
    rng = np.random.default_rng(3)
    agreed = []
    for _ in range(200):
        own = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        x, y = np.unique(own[:270]), np.unique(own[30:])  # 240 of 300
        found = N.sketch(np.array([0, len(x), len(x) + len(y)]), np.concatenate([x, y]))
        assert (found != N._FREE).all()
        agreed.append((found[0] == found[1]).mean())
    assert abs(np.mean(agreed) - 0.8) < 0.01 and np.std(agreed) < 0.04
    one = N.sketch(np.array([0, 1, 3]), np.array([7, 7, 9], np.uint64))
    assert (one != N._FREE).all()


def test_components(spark):
    rng = random.Random(1)
    edges = [(a, a + 1) for a in range(0, 200)] + [(300 + rng.randint(0, 40), 300 + rng.randint(0, 40)) for _ in range(45)] + [(7, None), (9, 9)]
    root = list(range(400))
    for _ in range(400):
        for a, b in edges:
            if b is not None:
                root[a] = root[b] = min(root[a], root[b])
    with Scratch(spark) as scratch:
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {n: root[n] for a, b in edges if b is not None and a != b for n in (a, b)}


def test_percent_below_what_bands_find(make):
    for percent in (60, 79, 101):
        with pytest.raises(ValueError):
            N.near_duplicates(make([(1, "some text")]), percent)
