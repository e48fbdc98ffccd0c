import hashlib

import numpy as np
import pytest

from atlasledger.llm.centroids import Search, clusters, described, digest
from atlasledger.llm.queries import op11_centroids
from atlasledger.session import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, x int, distance long"


def plain(rows, k, rounds, scale=256, seed="2"):
    """Brute force over ``(id, integer components)``."""
    kept = [(i, [int(np.floor(scale * float(np.float32(e)))) for e in v]) for i, v in rows]
    named = sorted(((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None))
    c = [x for _, x in named[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), n) for n, y in enumerate(c))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for n in range(len(c)):
            of = [x for (_, x), m in zip(kept, own) if m == n]
            if of:
                c[n] = [sum(e) // len(of) for e in zip(*of)]
    return c, [(i, *nearest(x)) for i, x in kept]


@pytest.fixture
def vectors(spark):
    def made(rows):
        return spark.createDataFrame([(i, v, 1, "c", 2, None) for i, v in rows], SCHEMA)

    return made


@pytest.mark.parametrize("spread", [0.0, 1.0, 40.0])
def test_equals_brute_force(spark, vectors, spread):
    rng = np.random.default_rng(int(spread))
    rows = [(i % 90, (rng.normal(size=5) + spread * rng.integers(-2, 3)).tolist()) for i in range(120)]
    with Scratch(spark) as scratch:
        found = clusters(vectors(rows), scratch, k=9, rounds=3, dim=5)
        c, near = plain(rows, 9, 3)
        got = sorted((r.row.vec_id, r.distance, r.cluster) for r in found.rows.collect())
        assert found.centroids == c and got == sorted(near)
        assert found.inertia == [sum(d for _, d, n in near if n == k) for k in range(9)]
        told = described(found).collect()
        assert {r.inertia for r in told} == {sum(d for _, d, _ in near)}
        assert all(r.centroid_sha256 == digest(c[r.cluster]) and r.cluster_inertia == found.inertia[r.cluster] for r in told)


def test_awkward_vectors(spark, vectors):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [9.0, 9.0]), (3, [-0.001, -1.0])]
    out = [(4, None), (5, []), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (8, [1.0, None]), (9, [nan, 1.0]), (10, [inf, 1.0]), (11, [1.0, -inf])]
    with Scratch(spark) as scratch:
        found = clusters(vectors(rows + out), scratch, k=2, rounds=1, dim=2)
        assert found.centroids == plain(rows, 2, 1)[0]
        got = sorted((r.row.vec_id or 0, r.distance, r.cluster) for r in found.rows.collect())
        assert got == sorted((i or 0, d, n) for i, d, n in plain(rows, 2, 1)[1])
        assert found.rows.select("row.*").columns == ["vec_id", "label", "cluster", "x", "distance"]
        for few in (rows[:1], []):
            found = clusters(vectors(few), scratch, k=5, dim=2)
            assert len(found.centroids) == len(few) == described(found).count()
        # an empty centroid stays, equal ones go to the smaller number
        found = clusters(vectors([(i, [1.0, 1.0]) for i in range(6)]), scratch, k=3, dim=2)
        assert found.centroids == [[256, 256]] * 3 and found.inertia == [0, 0, 0]
        assert {r.cluster for r in found.rows.collect()} == {0}
        with pytest.raises(Exception, match="beyond"):
            clusters(vectors([(1, [1e6, 0.0])]), scratch, k=1, dim=2)


def test_bounds_reject_and_stay_exact():
    rng = np.random.default_rng(3)
    for most in (3, 1000, 1 << 27):
        c = rng.integers(-most, most, (30, 8)) // rng.integers(1, 9, (30, 1))
        c[7] = c[3]
        x = np.concatenate([c[rng.integers(0, 30, 200)] + rng.integers(-1, 2, (200, 8)), c, np.full((1, 8), most - 1)])
        x = np.clip(x, -most, most - 1)
        number, best, measured = Search(c).nearest(x)
        d = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
        assert number.tolist() == d.argmin(axis=1).tolist() and best.tolist() == d.min(axis=1).tolist()
        assert measured < 0.6 * len(x) * len(c) or most == 3


def test_query_takes_whole_table(spark, sf):
    got = op11_centroids(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
