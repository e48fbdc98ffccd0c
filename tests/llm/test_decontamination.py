"""Benchmark passages against a full alignment of every text with every passage."""

import random

import numpy as np
import pytest

from atlasledger.llm import decontamination as D
from atlasledger.llm.queries import QUERIES

from llm_texts import prose

ITEMS = "item_id long, text string, error string"


def least_edits(passage, text):
    """Edits between the passage and any part of the text, by the full table."""
    column = list(range(len(passage) + 1))
    best = column[-1]
    for c in text:
        new = [0]
        for k, p in enumerate(passage):
            new.append(min(column[k] + (p != c), column[k + 1] + 1, new[k] + 1))
        column = new
        best = min(best, column[-1])
    return best


def plain(text):
    return "".join(map(chr, D.normalised(text)[0]))


def edited(rng, text, n, letters):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[k] = rng.choice(letters)
        elif kind < 0.7 and len(out) > 1:
            del out[k]
        else:
            out.insert(k, rng.choice(letters))
    return "".join(out)


def test_nothing_within_the_budget_is_missed():
    rng = random.Random(5)
    for trial in range(250):
        letters = ["ab cde", "abcdefghij klm", "ab"][trial % 3]
        passage = "".join(rng.choice(letters) for _ in range(rng.randint(12, 70)))
        items = D.prepared([(1, passage)], 0.1)
        if not items.codes:
            continue
        around = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(2)]
        text = around[0] + edited(rng, passage, rng.randint(0, 9), letters) + around[1]
        least = least_edits(plain(passage), plain(text))
        found = D.in_text(text, items)
        assert bool(found) == (least <= items.budget[0])
        if found:
            assert min(f[1] for f in found) == least
        for _, own, first, end in found:
            assert least_edits(plain(passage), plain(text[first:end])) <= own <= items.budget[0]


def test_parts_of_long_texts_overlap(monkeypatch):
    monkeypatch.setattr(D, "PART_CHARS", 100)
    rng = random.Random(2)
    passage = "the quick brown fox jumps over the lazy dog again"
    items = D.prepared([(1, passage)], 0.1)
    noise = lambda n: "".join(rng.choice("zyxw ") for _ in range(n))
    for gap in range(60, 220, 7):
        text = f"{noise(gap)} {passage} {noise(150)} {passage.upper()} {noise(30)}"
        found = D.in_text(text, items)
        assert [text[a:b].lower() for _, _, a, b in found] == [passage, passage]


def test_places_are_those_of_the_text_as_it_is():
    passage = "Some Passage İn the benchmark\nof  words"
    items = D.prepared([(7, passage)], 0.1)
    text = "  \tİİ before: \n some passage İn THE   benchmark of words. after"
    ((_, least, first, end),) = D.in_text(text, items)
    assert least == 0 and text[first:end] == "some passage İn THE   benchmark of words"


@pytest.mark.parametrize("block", [2_000_000, 3000])
def test_query_and_blocks(spark, sf, block, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", block)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    got = QUERIES["op10_decontamination"](spark, sf).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    texts = {r.doc_id: plain(r.text or "") for r in docs}
    exact = {(i, r.item_id) for i, t in texts.items() for r in items if plain(r.text) in t}
    assert exact and exact <= found
    known = {r.item_id: plain(r.text) for r in items}
    for i, k in found - exact:
        assert least_edits(known[k], texts[i]) <= len(known[k]) // 10
    rng = random.Random(3)  # of the others, some by the full table
    for i, k in rng.sample([(i, k) for i in texts for k in known if (i, k) not in found and len(texts[i]) < 1500], 40):
        assert least_edits(known[k], texts[i]) > len(known[k]) // 10


def test_awkward_rows(spark, awkward):
    passages = [(1, prose(2, 90)), (1, prose(2, 90)), (2, None), (3, ""), (4, "short"), (None, "日本語 の 文 — ok fine"), (5, "x" * 200)]
    bench = spark.createDataFrame([(*p, "n") for p in passages], ITEMS)
    got = sorted(((r.doc_id, r.item_id, r.edits) for r in D.contaminated(awkward, bench).collect() if r.doc_id != 9), key=repr)
    assert got == sorted([(6, 1, 0), (6, 1, 0), (None, 1, 0), (None, 1, 0), (11, None, 0)], key=repr)
    kept = D.decontaminated(awkward, bench)
    assert kept.columns == awkward.columns
    want = [r for r in awkward.collect() if not (r.doc_id in (9, 11) or r.text == prose(2, 90))]
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, want))


def test_empty_tables(spark, make, awkward):
    none = spark.createDataFrame([], ITEMS)
    assert D.contaminated(awkward, none).count() == 0
    assert D.decontaminated(awkward, none).count() == awkward.count()
    bench = spark.createDataFrame([(1, "a passage of the benchmark", "n")], ITEMS)
    assert D.contaminated(make([]), bench).count() == D.decontaminated(make([]), bench).count() == 0


def test_repeats_of_one_passage_are_told_one_by_one():
    items = D.prepared([(1, "a passage of the benchmark")], 0.1)
    found = D.in_text("a passage of the benchmark, a passage of the benchmarc; a passage of a bench", items)
    assert [f[1] for f in found] == [0, 1]


def test_hostile_repetition_stays_small():
    items = D.prepared([(k, "ab" * (50 + k)) for k in range(5)], 0.1)
    found = D.in_text("ab" * 5000, items)
    assert np.mean([f[1] == 0 for f in found]) == 1


def test_short_passages_are_found_exactly_between_word_bounds(spark, make):
    rows = [(1, "42 km"), (2, "Paris"), (3, "東京都"), (4, " "), (5, "paris"), (6, "a passage of the benchmark")]
    items = D.prepared(rows, 0.1)
    text = "In  PARIS, not comparison or parisian; 42\n km, not 142 km. 私は東京都に. A passage of the benchmarc"
    got = [(items.item_id[k], least, text[a:b]) for k, least, a, b in D.in_text(text, items)]
    assert sorted(g for g in got if g[0] != 6) == [(1, 0, "42\n km"), (2, 0, "PARIS"), (3, 0, "東京都"), (5, 0, "PARIS")]
    assert [g[:2] for g in got if g[0] == 6] == [(6, 1)]
    bench = spark.createDataFrame([(2, "Paris", "n")], ITEMS)
    docs = make([(1, "To Paris!"), (2, "a comparison"), (3, None), (4, "")])
    assert [(r.doc_id, r.first, r.end) for r in D.contaminated(docs, bench).collect()] == [(1, 3, 8)]
    assert sorted(r.doc_id for r in D.decontaminated(docs, bench).collect()) == [2, 3, 4]
