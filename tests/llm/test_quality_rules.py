"""Base counts and n-gram scores against plain Python."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from atlasledger.llm import quality_rules as Q
from atlasledger.llm.queries import QUERIES

from llm_texts import prose

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def counted(text):
    text, own = text or "", words(text)
    seen = Counter(zip(own, own[1:], own[2:], strict=False))
    covered = set()
    for k in range(len(own) - 2):
        if seen[tuple(own[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if words(x)]
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def grams(spark, texts):
    """Buckets of each text's n-grams, with Spark's hash as the only thing borrowed."""
    own = [words(t) for t in texts]
    single = sorted({w for o in own for w in o})
    one = {r.w: r.h for r in spark.createDataFrame([(w,) for w in single], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = sorted({(one[a], one[b]) for o in own for a, b in zip(o, o[1:], strict=False)})
    two = {(r.a, r.b): r.h for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    return [[one[w] % Q.BUCKETS for w in o] + [two[one[a], one[b]] % Q.BUCKETS for a, b in zip(o, o[1:], strict=False)] for o in own]


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    trusted = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 1}
    got = {r.doc_id: r for r in QUERIES["op1_quality_rules"](spark, sf).collect()}
    assert len(got) == len(docs)
    own = grams(spark, [r.text for r in docs])
    raw = Counter(g for o in own for g in o)
    good = Counter(g for r, o in zip(docs, own, strict=True) if r.doc_id in trusted for g in o)
    every, target = sum(raw.values()) + Q.BUCKETS, sum(good.values())
    ratio = {}
    for b in raw:
        share = (raw[b] + 1) / every
        ratio[b] = math.log((good[b] + Q.PRIOR * share) / (target + Q.PRIOR) / share)
    for r, o in zip(docs, own, strict=True):
        g = got[r.doc_id]
        assert tuple(g[c] for c in COUNTS) == counted(r.text)
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
        assert math.isclose(g.score, sum(ratio[x] for x in o) / len(o) if o else 0.0, abs_tol=1e-9)
        assert g.kept == (not g.base_failed and g.score >= Q.THRESHOLD)


def test_counts_of_odd_texts(make):
    texts = ["a b c a b c", "a a a a", "x y z x y", "b\nb\n\n \nb \nb", "\n\n", "#* a|b <é>", "a b c d a b c e b c d", "a\x1cb \x85 q", prose(1, 40) + " " + prose(1, 40)]
    out = Q.quality_rules(make(list(enumerate(texts))), make([]).select("doc_id")).collect()
    assert {r["row"].doc_id: tuple(r[c] for c in COUNTS) for r in out} == {k: counted(t) for k, t in enumerate(texts)}


def test_awkward_rows(spark, awkward):
    trusted = spark.createDataFrame([(6,), (6,), (None,), (77,)], "doc_id long")
    out = Q.quality_rules(awkward, trusted)
    assert out.count() == awkward.count() and out.select("row.*").columns == awkward.columns
    for r in out.collect():
        assert tuple(r[c] for c in COUNTS) == counted(r["row"].text)
        assert r.score is not None and r.kept is not None
        if not r.n_words:
            assert r.score == 0 and r.base_failed and not r.kept


def test_empty_tables(make):
    assert Q.quality_rules(make([]), make([]).select("doc_id")).count() == 0
    assert set(Q.log_ratios(make([]), make([]).select("doc_id"))) == {0.0}


def test_main_path_is_native(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = Q.quality_rules(docs, docs.select("doc_id"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
