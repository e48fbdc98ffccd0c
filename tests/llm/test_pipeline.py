"""The corpus pipeline against plain Python, stage by stage, and the entry without this package."""

import os
import re
import shutil
import subprocess
import sys

import corpus_pipeline as C
from atlasledger.llm import near_duplicates as N
from test_decontamination import plain
from test_near_duplicates import brute
from test_substrings import brute as runs

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in C.STAGES] == ["language", "near_duplicates", "substrings", "decontamination", "packing"]
    language, near, substrings, clean, packing = (f for _, f in C.STAGES)
    start = docs.collect()

    # documents with letters are recognised; here all are
    first = language(spark, docs, sf)
    assert first.columns == COLUMNS
    assert rows(first) == sorted((tuple(r) for r in start if re.search(r"[^\W\d_]", r.text or "")), key=repr)

    second = near(spark, first, sf)
    part = brute([(r.doc_id, r.text) for r in start], C.SIMILAR)
    keep = {i for i, _, c in part if i == c}
    assert len(keep) < len(start)
    assert rows(second) == sorted((tuple(r) for r in start if r.doc_id in keep), key=repr)

    third = substrings(spark, second, sf)
    before = sorted(second.collect(), key=lambda r: r.doc_id)
    want = []
    for r, (n, gone, left) in zip(before, runs([r.text for r in before], 35), strict=True):
        if not gone:
            want.append(tuple(r))
        elif gone < n:
            want.append((r.doc_id, left, r.lang, r.source, len(left)))
    assert rows(third) == sorted(want, key=repr)
    assert any(len(w[1]) != len(r.text) for w, r in zip(want, before, strict=False))

    fourth = clean(spark, third, sf)
    passages = [plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {r.doc_id for r in third.collect() if any(p in plain(r.text) for p in passages)}
    left = {r.doc_id for r in fourth.collect()}
    assert held and left == {r.doc_id for r in third.collect()} - held

    last = packing(spark, fourth, sf)
    assert {r.doc_id for r in last.collect()} == left
    whole = C.run(spark, sf)
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert sum(n for *_, n, _ in key(whole)) == sum(n for *_, n, _ in key(last))


def test_awkward_rows_through_all_stages(spark, sf, awkward):
    docs = awkward.select(*COLUMNS)
    got = {}
    for name, stage in C.STAGES:
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)  # as if written and reread
        got[name] = docs
        if name != "packing":
            assert docs.columns == COLUMNS
    ids = lambda name: sorted((r.doc_id for r in got[name].collect()), key=repr)
    assert ids("language") == sorted([4, 5, 5, 6, 6, None, 7, 8, 9, 11], key=repr)
    # 5 and 5 are one row twice; null has a text of 6; 8 is a near copy of 7
    assert ids("near_duplicates") == [11, 4, 5, 6, 6, 7, 9]


def test_no_documents(spark, sf, make):
    docs = make([]).select(*COLUMNS)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_near_duplicates_of_repeated_ids(spark, sf, make):
    text = "one two three four five six seven eight"
    docs = make([(3, text), (5, text + "!"), (5, text), (5, "another text of its own here"), (5, "another text of its own here")]).select(*COLUMNS)
    got = C.near_duplicate(spark, docs, sf)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(3, text), (5, "another text of its own here"), (5, text + "!")]
    assert N.near_duplicates(docs, 80).where("kept").count() == 4


def test_entry_without_this_package(tmp_path):
    """What is left imports and registers its own queries."""
    root = os.path.dirname(os.path.abspath(C.__file__))
    shutil.copytree(os.path.join(root, "atlasledger"), tmp_path / "atlasledger", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(k[:2] == 'op' and k[2].isdigit() for k in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_nothing_else_imports_this_package():
    root = os.path.dirname(os.path.abspath(C.__file__))
    for folder, _, names in os.walk(os.path.join(root, "atlasledger")):
        for name in names:
            if name.endswith(".py") and "llm" not in folder.split(os.sep):
                assert "llm" not in open(os.path.join(folder, name)).read(), name
