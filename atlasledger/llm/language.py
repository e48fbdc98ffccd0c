"""Language identification with segmentation-marginalised unigrams.

A fixed public vocabulary gives pieces; each language has a probability for each piece. A word's
probability in a language is the sum over all its segmentations into pieces of the product of their
probabilities, which the forward algorithm adds up in one pass over the word. Probabilities are
learned by expectation-maximisation over the same sums. A text's score is the sum over its words.

Words are runs of letters of the lower-cased text (beyond ASCII: of any characters), with a space in
front, as the vocabulary's pieces have it. All its pieces and all single bytes take part, so that
every word has a segmentation; words of any length are summed over as wholes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from atlasledger.llm import tokens
from atlasledger.llm import words as W
from atlasledger.session import Scratch, small_batches

#: The vocabulary's longest piece; one with a longer piece is refused.
PIECE_BYTES = 25
#: Documents per language that the model is learned from at most; which ones, a hash of the id says.
LEARN_FROM = 4000
ROUNDS = 3
FLOOR = 0.05
#: Groups under which one slower call takes less time than several fast ones.
FEW = 64
REMEMBERED = 200_000
UNKNOWN = "und"
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


class Model(NamedTuple):
    languages: list[str]
    prior: np.ndarray  # log share of the documents learned from
    pieces: list[np.ndarray]  # by length in bytes, the pieces as sorted integers, beyond 8 bytes Python's
    first: list[int]  # by length, the number of its first piece
    log_p: np.ndarray  # languages x pieces


def vocabulary(path: str) -> tuple[list[np.ndarray], list[int]]:
    """Pieces of a sentencepiece model by length in bytes, as little-endian integers."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for k in range(model.get_piece_size()):
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)):
            found.add(model.id_to_piece(k).replace("▁", " ").encode())
    if max(map(len, found)) > PIECE_BYTES:
        raise ValueError(f"a piece of {max(map(len, found))} bytes; at most {PIECE_BYTES} are looked for")
    pieces, first, at = [np.zeros(0, np.uint64)], [0], 0
    for size in range(1, PIECE_BYTES + 1):
        own = np.array(sorted(int.from_bytes(p, "little") for p in found if len(p) == size), np.uint64 if size <= 8 else object)
        pieces.append(own)
        first.append(at)
        at += len(own)
    return pieces, first


def _words(column: pa.Array) -> W.Words:
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return W.split(*W.buffers(pc.utf8_lower(column)), W.NO_LETTER)


class _Lattice:
    """All segmentations of some words: an edge per piece that stands somewhere in a word.

    Nodes are (bytes of the word so far, row), so those of one length lie together; edges are in the
    order of the node where they end. Sums are kept as logs, so no word, corpus or vocabulary is too
    large for them. Memory follows the bytes of the words, whatever their lengths.
    """

    def __init__(self, words: W.Words, chosen: np.ndarray, pieces: list[np.ndarray], first: list[int]) -> None:
        length = (words.end - words.start)[chosen] + 1
        # rows are words, longest first, with a space in front
        self.word = np.argsort(-length, kind="stable")
        self.length = length[self.word]
        at = np.cumsum(self.length) - self.length
        flat = np.full(int(self.length.sum()), 32, np.uint8)
        source = np.repeat(words.start[chosen][self.word] - 1 - at, self.length) + np.arange(len(flat))
        inner = np.ones(len(flat), bool)
        inner[at] = False
        flat[inner] = words.data[source[inner]]
        row = np.repeat(np.arange(len(at)), self.length)
        place = np.arange(len(flat)) - at[row]
        longest = int(self.length[0]) if len(at) else 0
        #: how many rows have so many bytes, and the first node of each length
        self.rows = np.searchsorted(-self.length, -np.arange(longest + 1), "right") if longest else np.zeros(1, np.int64)
        self.node = np.concatenate([[0], np.cumsum(self.rows)])
        self.final = self.node[self.length] + np.arange(len(at))
        found = list(_pieces_in(flat, self.length[row] - place, pieces, first))
        edges = np.zeros(self.node[-1] + 1, np.int64)
        ends = [self.node[place[k] + size] + row[k] for size, k, _ in found]
        for end in ends:  # a node ends one piece of each size at most
            edges[end + 1] += 1
        self.bounds = np.cumsum(edges)
        free = self.bounds[:-1].copy()
        self.start, self.end, self.piece = (np.zeros(self.bounds[-1], np.int32) for _ in range(3))
        for end, (_, k, piece) in zip(ends, found, strict=True):
            own = free[end]
            free[end] += 1
            self.start[own], self.end[own], self.piece[own] = self.node[place[k]] + row[k], end, piece

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """Per node, the log of the sum over the segmentations up to there; edges have log weights."""
        alpha = np.zeros(self.node[-1])
        for j in range(1, len(self.rows)):
            a, b = self.node[j], self.node[j + 1]
            e = self.bounds[a : b + 1]
            alpha[a:b] = _log_sums(alpha[self.start[e[0] : e[-1]]] + weight[e[0] : e[-1]], e[:-1] - e[0])
        return alpha

    def log_sums(self, log_p: np.ndarray, words: int) -> np.ndarray:
        """Languages x words: the log of each word's sum over all segmentations."""
        out = np.zeros((len(log_p), words))
        for k, p in enumerate(log_p):
            out[k, self.word] = self.forward(p[self.piece])[self.final]
        return out

    def expected(self, p: np.ndarray, count: np.ndarray) -> np.ndarray:
        """How often each piece is used over all segmentations of words that come ``count`` times."""
        weight = np.log(p)[self.piece]
        alpha = self.forward(weight)
        order = np.argsort(self.start, kind="stable")
        end, back = self.end[order], weight[order]
        bounds = np.searchsorted(self.start[order], np.arange(len(alpha) + 1))
        beta = np.zeros(len(alpha))
        for j in range(len(self.rows) - 2, -1, -1):
            # rows that end here stand behind those that go on
            a, b = self.node[j], self.node[j] + self.rows[j + 1]
            e = bounds[a : b + 1]
            beta[a:b] = _log_sums(beta[end[e[0] : e[-1]]] + back[e[0] : e[-1]], e[:-1] - e[0])
        row = (np.arange(len(alpha)) - np.repeat(self.node[:-1], self.rows))[self.start]
        used = np.exp(alpha[self.start] + weight + beta[self.end] - alpha[self.final][row])
        return np.bincount(self.piece, used * count[self.word][row], len(p))


def _pieces_in(flat: np.ndarray, left: np.ndarray, pieces: list[np.ndarray], first: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By length: the bytes at which a piece begins that ends within ``left`` bytes, and its number."""
    eight = W.eights(flat)[: len(flat)]
    for size in range(1, 9):
        own = pieces[size]
        if len(own):
            value = eight & _MASK[size]
            k = np.minimum(np.searchsorted(own, value), len(own) - 1)
            hit = np.flatnonzero((own[k] == value) & (left >= size))
            yield size, hit, k[hit] + first[size]
    # longer ones only where eight bytes begin one; in reverse, their bytes sort as the integers do
    heads = np.unique(np.array([p & int(_MASK[8]) for own in pieces[9:] for p in own], np.uint64))
    if not len(heads):
        return
    some = np.flatnonzero(heads[np.minimum(np.searchsorted(heads, eight), len(heads) - 1)] == eight)
    for size in range(9, len(pieces)):
        some = some[left[some] >= size]
        if len(pieces[size]) and len(some):
            own = np.array([p.to_bytes(size, "big") for p in pieces[size]], f"S{size}")
            value = flat[some[:, None] + np.arange(size - 1, -1, -1)].view(f"S{size}")[:, 0]
            k = np.minimum(np.searchsorted(own, value), len(own) - 1)
            hit = own[k] == value
            yield size, some[hit], k[hit] + first[size]


def _log_sums(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Logs of the sums of what ``value`` has the logs of, per group; ``first`` has each group's first."""
    if len(first) < FEW:
        return np.logaddexp.reduceat(value, first)
    top = np.maximum.reduceat(value, first)
    value = np.exp(value - np.repeat(top, np.diff(first, append=len(value))))
    return top + np.log(np.add.reduceat(value, first))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of ``lang, text`` rows with their counts in the slice."""
    tokens.forget()
    for batch in batches:
        lang = np.array(batch.column(0).to_pylist(), object)
        for a, b in W.slices(W.buffers(batch.column(1))[1]):
            words = _words(batch.column(1)[a:b])
            for name in sorted(set(lang[a:b])):
                own = np.flatnonzero((lang[a:b] == name)[words.row])
                _, at, count = np.unique(W.hashes(words)[own], return_index=True, return_counts=True)
                data = words.data.tobytes()
                text = [data[words.start[k] : words.end[k]] for k in own[at]]
                yield pa.record_batch([pa.array([name] * len(at)), pa.array(text, pa.binary()), pa.array(count.astype(np.int64))], ["lang", "word", "n"])


def _expected(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    total = np.zeros(model.log_p.shape)
    p = np.exp(model.log_p)
    for batch in batches:
        lang = np.array(batch.column(0).to_pylist(), object)
        for k, name in enumerate(model.languages):
            own = batch.filter(pa.array(lang == name))
            for a, b in W.slices(W.buffers(own.column(1))[1]):
                data, bounds = W.buffers(own.column(1)[a:b])
                words = W.Words(data, bounds[:-1], bounds[1:], np.arange(b - a), np.arange(b - a + 1))
                lattice = _Lattice(words, np.arange(b - a), model.pieces, model.first)
                total[k] += lattice.expected(p[k], own.column(2)[a:b].to_numpy())
    lang, piece = np.nonzero(total)
    yield pa.record_batch([pa.array(lang), pa.array(piece), pa.array(total[lang, piece])], ["lang", "piece", "n"])


def learn(docs: DataFrame, path: str, scratch: Scratch, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Model:
    """A model from the rows of ``docs`` that have a language, a text and an id.

    At most about ``LEARN_FROM`` documents per language are read, chosen by a hash of the id; the
    driver holds languages x pieces numbers. With no such row, the model knows no language.
    """
    rows = small_batches(docs).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    size = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(size)
    pieces, first = vocabulary(path)
    n = first[-1] + len(pieces[-1])
    prior = np.log(np.array([size[k] for k in languages], float) / max(1, sum(size.values())))
    model = Model(languages, prior, pieces, first, np.full((len(languages), n), -np.log(n)))
    if not languages:
        return model
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, LEARN_FROM / size[k])))])
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    counted = chosen.select("lang", "text").mapInArrow(_counted, "lang string, word binary, n long")
    counts = scratch.save(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    for _ in range(ROUNDS):
        told = counts.mapInArrow(lambda it, model=model: _expected(it, model), "lang long, piece long, n double")
        used = np.full(model.log_p.shape, FLOOR)
        for row in told.groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect():
            used[row.lang, row.piece] += row.n
        model = model._replace(log_p=np.log(used / used.sum(axis=1, keepdims=True)))
    return model


def _scored(batches: Iterator[pa.RecordBatch], model: Model, text_col: str) -> Iterator[pa.RecordBatch]:
    tokens.forget()
    known, sums = np.zeros(0, np.uint64), np.zeros((len(model.languages), 0))
    for batch in batches:
        rows = batch.column(0)
        texts = pa.StructArray.field(rows, rows.type.get_field_index(text_col)) if text_col else rows
        texts = pc.if_else(rows.is_valid(), texts, pa.scalar(None, texts.type))
        for a, b in W.slices(W.buffers(texts)[1]):
            words = _words(texts[a:b])
            named, at, to = np.unique(W.hashes(words), return_index=True, return_inverse=True)
            new = ~np.isin(named, known)
            if new.any():
                lattice = _Lattice(words, at[new], model.pieces, model.first)
                if len(known) + int(new.sum()) > REMEMBERED:
                    keep = np.isin(known, named)
                    known, sums = known[keep], sums[:, keep]
                known = np.concatenate([known, named[new]])
                sums = np.concatenate([sums, lattice.log_sums(model.log_p, int(new.sum()))], axis=1)
                order = np.argsort(known)
                known, sums = known[order], sums[:, order]
            place = np.searchsorted(known, named)[to]
            logit = np.stack([np.bincount(words.row, s[place], b - a) for s in sums]) if len(sums) else np.zeros((1, b - a))
            logit = logit + model.prior[:, None] if len(sums) else logit
            best = logit.argmax(axis=0)
            share = 1 / np.exp(logit - logit.max(axis=0)).sum(axis=0)
            some = np.diff(words.first) > 0
            for k in np.flatnonzero(some):  # a word may be characters beyond ASCII that are no letters
                own = words.data[words.start[words.first[k]] : words.end[words.first[k + 1] - 1]]
                if not (own < 128).any() or not (~W.NO_LETTER[own] & (own < 128)).any():
                    some[k] = any(c.isalpha() for c in texts[a + int(k)].as_py())
            if not model.languages:
                some[:] = False
            lang = [model.languages[x] if y else UNKNOWN for x, y in zip(best.tolist(), some.tolist(), strict=True)]
            yield pa.record_batch([rows[a:b], pa.array(lang), pa.array(np.where(some, share, 0.0))], ["row", "lang_pred", "score"])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``row`` (all its columns as a struct, so that no names can clash),
    ``lang_pred`` and ``score``, the probability of that language among those learned.

    A text that is null or has no letter is ``und`` with score 0, as is every text if no language
    was learned. Ties go to the language first in the alphabet.
    """
    rows = small_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = StructType(list(rows.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType())
    return rows.mapInArrow(lambda it: _scored(it, model, text_col), schema)
