"""Toxicity: features against plain Python, held-out quality, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from atlasledger.llm import toxicity as T
from atlasledger.llm.queries import QUERIES
from atlasledger.session import Scratch

from llm_texts import prose

NONE = T.Lexicon(np.zeros(0, np.uint64), np.zeros(0))
LABELS = "doc_id long, quality int, toxic int, text string"


def feature(text, name, lexicon=NONE):
    return T.features(pa.array([text], pa.string()), lexicon)[0][T.FEATURES.index(name)]


def test_features():
    assert feature("you are an idiot", "insult_density") == 1 / 4
    assert feature("you are an IDIOT!", "insult_density") == 1 / 4
    assert feature("an id1ot, no: 1d$ot", "obfuscated") == 2 / 4  # look-alikes between letters
    assert feature("an id1ot", "insult_density") == 1 / 2
    assert feature("you x y idiot", "near_second_person") == 1 / 4
    assert feature("you x y z idiot", "near_second_person") == 0
    assert feature("ABc d", "capitals") == 2 / 4
    assert feature("ABC de F", "capital_words") == 1 / 3
    assert feature("a!?b", "exclamations") == 2 / 4
    assert feature("a,b;", "punctuation") == 2 / 4
    assert feature("a12", "digits") == 2 / 3
    for empty in (None, "", "  "):
        assert not T.features(pa.array([empty], pa.string()), NONE).any()


def test_second_person_does_not_reach_into_the_next_text():
    found = T.features(pa.array(["x you", "idiot a b"]), NONE)
    assert found[:, T.FEATURES.index("near_second_person")].tolist() == [0, 0]


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op5_toxicity"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    score, label = [], []
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.held_out and r.doc_id in toxic:
            score.append(r.score)
            label.append(toxic[r.doc_id])
    score, label = np.array(score), np.array(label)
    rank = np.argsort(np.argsort(score)) + 1
    bad = label.sum()
    auc = (rank[label == 1].sum() - bad * (bad + 1) / 2) / (bad * (len(label) - bad))
    assert auc > 0.95
    assert ((score >= 0.5) == label).mean() > 0.97
    assert ((score - label) ** 2).mean() < 0.03  # calibrated: 0.1 for the base rate alone


@pytest.fixture(scope="module")
def labelled(make):
    texts = [(k, prose(k, 60) + (" grumblor" if k % 3 == 0 else "")) for k in range(400)]
    return make(texts)


def labels_of(spark, rows):
    return spark.createDataFrame([(i, 1, t, "clashing") for i, t in rows], LABELS)


def test_a_word_never_seen_elsewhere_is_learned(spark, labelled, awkward):
    told = labels_of(spark, [(k, int(k % 3 == 0)) for k in range(400)] + [(None, 1), (3, None), (3, 0), (9999, 1)])
    with Scratch(spark) as scratch:
        model = T.learn(labelled, told, scratch)
    new = {r["row"].doc_id: r.score for r in T.score(labelled, model).collect()}
    assert np.mean([new[k] for k in range(0, 400, 3)]) > 0.9
    assert np.mean([new[k] for k in range(1, 400, 3)]) < 0.1
    out = T.score(awkward, model)
    assert out.select("row.*").columns == awkward.columns
    rows = out.collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)


def test_labels_that_teach_nothing(spark, labelled, make):
    for rows, rate in (([], 0.0), ([(k, 1) for k in range(50)], 1.0), ([(1, 1), (2, 0)], 0.5)):
        with Scratch(spark) as scratch:
            model = T.learn(labelled, labels_of(spark, rows), scratch)
        assert {r.score for r in T.score(labelled, model).collect()} == {rate}
    assert T.score(make([]), model).count() == 0


def test_the_bound_on_labels_holds(spark, labelled, monkeypatch):
    monkeypatch.setattr(T, "LEARN_FROM", 10)
    with Scratch(spark) as scratch:
        T.learn(labelled, labels_of(spark, [(k, k % 2) for k in range(400)]), scratch)
        assert scratch._kept[0].count() == 10
