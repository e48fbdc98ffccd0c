"""Language identification: forward sums against enumeration, held-out accuracy, odd rows."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from atlasledger.llm import language as L
from atlasledger.llm.queries import PIECES, QUERIES
from atlasledger.session import Scratch


@pytest.fixture(scope="module")
def model(spark, sf):
    with Scratch(spark) as scratch:
        return L.learn(spark.read.parquet(f"{sf}/documents.parquet"), PIECES, scratch)


def enumerated(word: bytes, p: dict[bytes, float]) -> float:
    """The sum over all segmentations, from the definition."""
    if not word:
        return 1.0
    return sum(p[word[:n]] * enumerated(word[n:], p) for n in range(1, min(len(word), L.PIECE_BYTES) + 1) if word[:n] in p)


def as_dict(model, k):
    out = {}
    for size in range(1, L.PIECE_BYTES + 1):
        for i, piece in enumerate(model.pieces[size].tolist()):
            out[piece.to_bytes(size, "little")] = math.exp(model.log_p[k, model.first[size] + i])
    return out


def test_sums_over_all_segmentations(model):
    texts = ["the", "Thering éa", "x", "größe straße", "ababababab"]
    words = L._words(pa.array(texts))
    lattice = L._Lattice(words, np.arange(len(words.start)), model.pieces, model.first)
    got = lattice.log_sums(model.log_p, len(words.start))
    data = words.data.tobytes()
    for k in range(len(model.languages)):
        p = as_dict(model, k)
        for w in range(len(words.start)):
            own = b" " + data[words.start[w] : words.end[w]]
            assert math.isclose(got[k, w], math.log(enumerated(own, p)), rel_tol=1e-9)


def test_scores_equal_plain_sums(spark, sf, model):
    """Language and score of whole texts, from the definition in plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 400").orderBy("doc_id").limit(12)
    p = [as_dict(model, k) for k in range(len(model.languages))]

    def log_sum(word, own):
        """Over all segmentations, by the sums of all prefixes."""
        sums = [1.0]
        for end in range(1, len(word) + 1):
            sums.append(sum(sums[end - n] * own.get(word[end - n : end], 0.0) for n in range(1, min(end, L.PIECE_BYTES) + 1)))
        return math.log(sums[-1])

    told = {r.row.doc_id: r for r in L.identify(docs, model).collect()}
    for r in docs.collect():
        found = L._words(pa.array([r.text]))
        data = found.data.tobytes()
        words = [b" " + data[a:b] for a, b in zip(found.start, found.end)]
        logit = [model.prior[k] + sum(log_sum(w, p[k]) for w in words) for k in range(len(p))]
        best = max(range(len(p)), key=lambda k: logit[k])
        got = told[r.doc_id]
        if got.lang_pred != L.UNKNOWN:
            assert got.lang_pred == model.languages[best]
            assert math.isclose(got.score, 1 / sum(math.exp(x - logit[best]) for x in logit), rel_tol=1e-6)
    assert any(r.lang_pred != L.UNKNOWN for r in told.values())


def test_expected_uses_match_the_gradient(model):
    """Expected uses are the derivative of the log sum by the logs of the probabilities."""
    words = L._words(pa.array(["thering the"]))
    lattice = L._Lattice(words, np.arange(2), model.pieces, model.first)
    p = np.exp(model.log_p[0])
    used = lattice.expected(p, np.array([3.0, 2.0]))
    weigh = np.array([3.0, 2.0])
    base = lattice.log_sums(np.log(p)[None], 2)[0] @ weigh
    for piece in np.flatnonzero(used > 0.01)[:20]:
        more = p.copy()
        more[piece] *= 1 + 1e-6
        assert math.isclose((lattice.log_sums(np.log(more)[None], 2)[0] @ weigh - base) / 1e-6, used[piece], rel_tol=1e-3)


def test_probabilities_add_up(model):
    assert np.allclose(np.exp(model.log_p).sum(axis=1), 1)
    assert math.isclose(np.exp(model.prior).sum(), 1)


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op7_language"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    right = []
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if r.held_out:
            right.append(r.lang_pred == docs[r.doc_id].lang)
    assert np.mean(right) > 0.99


def test_awkward_rows(awkward, model):
    out = L.identify(awkward, model)
    rows = out.collect()
    assert len(rows) == awkward.count() and out.select("row.*").columns == awkward.columns
    for r in rows:
        letters = any(c.isalpha() for c in r["row"].text or "")
        assert (r.lang_pred == L.UNKNOWN) != letters
        assert (r.score == 0) != letters
        assert letters or r.lang_pred == "und"


def test_letters_beyond_ascii_only(make, model):
    rows = [(1, "日本語"), (2, "— … 🙂"), (3, "é"), (4, "١٢٣"), (5, "ﬁ")]
    got = {r["row"].doc_id: r.lang_pred != "und" for r in L.identify(make(rows), model).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_words_longer_than_a_part(make, model):
    rows = [(1, "the" * 500), (2, "the" * 32), (3, ("the" * 500 + " ") * 3)]
    assert {r.lang_pred for r in L.identify(make(rows), model).collect()} == {"en"}


def test_no_labels_and_no_rows(spark, make):
    with Scratch(spark) as scratch:
        none = L.learn(make([(1, "text", None), (None, "text", "en"), (2, None, "en")]), PIECES, scratch)
    assert none.languages == []
    assert [(r.lang_pred, r.score) for r in L.identify(make([(1, "some text")]), none).collect()] == [("und", 0.0)]
    assert L.identify(make([]), none).count() == 0


def test_one_language(spark, make):
    with Scratch(spark) as scratch:
        one = L.learn(make([(1, "some text", "xx"), (2, "more", "xx")]), PIECES, scratch)
    assert [(r.lang_pred, r.score) for r in L.identify(make([(1, "anything")]), one).collect()] == [("xx", 1.0)]


def large(path, own):
    """A model as if learned from millions of pieces a language; ``own`` has texts that only ``bb`` knows."""
    pieces, first = L.vocabulary(path)
    used = np.full((2, first[-1] + len(pieces[-1])), L.FLOOR)
    seen = {piece.to_bytes(1, "little"): first[1] + i for i, piece in enumerate(pieces[1].tolist())}
    used[:, [seen[b" "], seen[b"e"], seen[b"t"]]] = 1e6
    for byte in set("".join(own).lower().encode()):
        used[1, seen[bytes([byte])]] = 1e5
    return L.Model(["aa", "bb"], np.log([0.5, 0.5]), pieces, first, np.log(used / used.sum(axis=1, keepdims=True)))


def test_characters_outside_the_vocabulary(make):
    learned = ["ａｂｃｄｅｆｇｈ" * 4, "ｱｲｳｴｵｶｷｸ" * 4]
    unlearned = ["ሀለሐመሠረሰሸ" * 4, "𝒜𝒞𝒟𝒢𝒥𝒦𝒩𝒪" * 4]
    model = large(PIECES, learned)
    got = L.identify(make(list(enumerate(learned + unlearned))), model).collect()
    assert all(0.5 <= r.score <= 1 for r in got)
    assert {r["row"].doc_id: r.lang_pred for r in got if r["row"].doc_id < 2} == {0: "bb", 1: "bb"}
    for text in learned + unlearned:
        words = L._words(pa.array([text]))
        lattice = L._Lattice(words, np.arange(len(words.start)), model.pieces, model.first)
        assert np.isfinite(lattice.log_sums(model.log_p, len(words.start))).all()
        used = lattice.expected(np.exp(model.log_p[0]), np.full(len(words.start), 1e9))
        # every byte is covered once by each segmentation
        size = np.repeat(np.arange(len(model.pieces)), [len(p) for p in model.pieces])
        assert math.isclose(used @ size, 1e9 * (len(text.lower().encode()) + 1), rel_tol=1e-6)


def test_long_pieces_and_long_words(model):
    """All pieces of the vocabulary take part, and sums go on over the whole of a word."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = {bytes([b]) for b in range(256)}
    for k in range(library.get_piece_size()):
        if not (library.is_control(k) or library.is_unknown(k) or library.is_byte(k)):
            found.add(library.id_to_piece(k).replace("▁", " ").encode())
    assert sum(map(len, model.pieces)) == len(found)
    text = "responsibility государственный interessantes" + "internationalization" * 12
    words = L._words(pa.array([text]))
    got = L._Lattice(words, np.arange(len(words.start)), model.pieces, model.first).log_sums(model.log_p, len(words.start))
    data = words.data.tobytes()
    for k in range(len(model.languages)):
        p = as_dict(model, k)
        assert set(p) == found
        for w in range(len(words.start)):
            own = b" " + data[words.start[w] : words.end[w]]
            alpha = [0.0]  # logs, byte by byte from the definition
            for j in range(1, len(own) + 1):
                alpha.append(np.logaddexp.reduce([alpha[i] + math.log(p[own[i:j]]) for i in range(max(0, j - 25), j) if own[i:j] in p]))
            assert math.isclose(got[k, w], alpha[-1], rel_tol=1e-9)
