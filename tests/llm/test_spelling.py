import random
import re
import zlib
from collections import Counter

import pytest

from atlasledger.llm import spelling
from atlasledger.llm.queries import op12_spelling
from atlasledger.llm.spelling import neighbours, variants, vocabulary
from atlasledger.session import Scratch


def counted(rows, least, count, slips):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\xc0-\xff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slips and h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += len(run) >= least
    return {w: n for w, n in out.items() if n >= count}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(words):
    near = {a: [b for b in words if is_near(a, b)] for a in words}
    form = {}
    for a, own in near.items():
        best = min(own, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= 2 * words[a] else None
    out = {}
    for a in words:
        root = a
        while form[root] is not None:
            root = form[root]
        out[a] = (words[a], len(near[a]), form[a], words[form[a]] if form[a] else None, root)
    return out


def texts(seed, n):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abéÿÀ") for _ in range(rng.randint(3, 8))) for _ in range(25)]
    return [(i % 40, " ".join(rng.choice(stems) for _ in range(rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("filter_bytes, chunk", [(spelling.FILTER_BYTES, 4096), (64, 1)])
def test_equals_brute_force(spark, make, filter_bytes, chunk):
    """With one pass over the words, and with a pass for every block of the filters."""
    rows = texts(1, 90)
    with Scratch(spark) as scratch:
        words = scratch.save(vocabulary(make(rows), least_length=3, least_count=2, slips=7))
        want = counted(rows, 3, 2, 7)
        assert {r.word: r.n for r in words.collect()} == want
        got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variants(words, scratch, 2, filter_bytes, chunk).collect()}
        assert got == plain(want)
        pairs = [tuple(sorted((r.a, r.b))) for r in neighbours(words, scratch, filter_bytes, chunk).collect()]
        assert sorted(pairs) == sorted({tuple(sorted((a, b))) for a in want for b in want if is_near(a, b)})


def test_awkward_texts(spark, make, awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    with Scratch(spark) as scratch:
        words = scratch.save(vocabulary(awkward, least_length=1, least_count=1, slips=3))
        want = counted(rows, 1, 1, 3)
        assert {r.word: r.n for r in words.collect()} == want
        empty = scratch.save(vocabulary(make([]), slips=3))
        assert variants(empty, scratch).collect() == [] and neighbours(empty, scratch).collect() == []
        with pytest.raises(ValueError):
            variants(words, scratch, factor=1)


def test_very_long_words_and_paths(spark, make):
    long = "ab" * 40_000
    rows = [(1, f"{long} {long}x {long[:-1]}"), (2, "kasse " * 2 + "kaste " * 4 + "paste " * 9 + "pasté " * 40), (3, long), (4, "x×÷ÿ x×÷ÿ X×÷ÿ")]
    with Scratch(spark) as scratch:
        words = scratch.save(vocabulary(make(rows), least_length=3, least_count=1))
        got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variants(words, scratch).collect()}
        assert got == plain(counted(rows, 3, 1, 0))
        assert got["kasse"][2] == "kaste" and got["kasse"][4] == "pasté" and got[long + "x"][4] == long


def test_filter_misses_nothing():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    shards = spelling.Shards({5: 3000, 9: 2000})
    shard = np.repeat([5, 9], [3000, 2000])
    block = shards.block(h, shard)
    assert block.min() >= 0 and block.max() < shards.total
    table = pa.table({"chunk": np.zeros(5000, np.int64), "block": block, "h": h.view(np.int64)})
    bits = np.frombuffer(spelling._chunk(table, spelling.CHUNK_BLOCKS).column("bits")[0].as_py(), np.uint64)
    found = spelling.Filter(shards, 0, bits)
    assert len(found.has(h[:3000], 5)) == 3000 and len(found.has(h[3000:], 9)) == 2000
    assert len(found.has(h[3000:], 5)) < 40 and len(found.has(h, 7)) == 0


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.word: r.n for r in op12_spelling(spark, sf).collect()}
    assert got == counted(rows, 5, 3, 97)
