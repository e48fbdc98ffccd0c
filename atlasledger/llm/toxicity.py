"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Labelled rows give a lexicon: word beginnings that toxic texts have far more often than others. Trees
are fitted over a dozen features of a whole text: densities of the learned and of a small fixed
lexicon, closeness of lexicon words to the second person, capitals, punctuation, digits and
obfuscated spellings. Rows are split into folds; a row that trees or calibration learn from has
features by a lexicon learned from other folds. The last fold calibrates the trees' margin to a
probability by isotonic regression. Trees and calibration are those of Spark's ML library.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from atlasledger.llm import words as W
from atlasledger.session import Scratch, small_batches

#: Labelled rows that the model is learned from at most; which ones, a hash of the id says.
LEARN_FROM = 20_000
#: Folds of the rows learned from; the last one calibrates, the others fit the trees.
FOLDS = 4
LEXICON_SIZE = 4000
LEAST_TOXIC, LEAST_LOG_ODDS = 3, 2.0
#: Beginnings of words that may stand in the lexicon, in bytes; 0 is the whole word.
BEGINNINGS = (4, 5, 6, 0)
NEAR = 3
# fixed values: second-person words of four languages, common insults, look-alike characters
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti usted ustedes vosotros tuyo"
).split()
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting dumb fool jerk clown garbage".split()
LOOKS_LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
FEATURES = (
    "lexicon_weight lexicon_density lexicon_most lexicon_hits near_second_person insult_density capitals "
    "capital_words exclamations punctuation obfuscated digits size"
).split()

_PLAIN = np.arange(256, dtype=np.uint8)
_DISGUISE = np.zeros(256, bool)
for _from, _to in LOOKS_LIKE.items():
    _PLAIN[ord(_from)] = ord(_to)
    _DISGUISE[ord(_from)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_EXCLAIM = np.zeros(256, bool)
_EXCLAIM[[33, 63]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class Lexicon(NamedTuple):
    """Hashed word beginnings, sorted, with their log odds."""

    unit: np.ndarray
    weight: np.ndarray


class Model(NamedTuple):
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibrated: IsotonicRegressionModel | None
    rate: float  # what is told of every text where trees could not be fitted


def _plain(column: pa.Array) -> tuple[W.Words, np.ndarray, np.ndarray]:
    """Lower-case words with look-alikes between letters undone, where those are, and the row bounds."""
    data, bounds = W.buffers(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))
    letter = ~W.NO_LETTER[data]
    odd = np.zeros(len(data), bool)
    if len(data) > 2:
        odd[1:-1] = _DISGUISE[data[1:-1]] & letter[:-2] & letter[2:]
        data = np.where(odd, _PLAIN[data], data)
    return W.split(data, bounds, W.NO_LETTER), odd, bounds


def _units(words: W.Words) -> list[np.ndarray]:
    """For each of ``BEGINNINGS``, a hash of every word's beginning; a shorter word has itself."""
    out = []
    for k, size in enumerate(BEGINNINGS):
        cut = words._replace(end=np.minimum(words.end, words.start + size)) if size else words
        out.append(W.mixed(W.hashes(cut) + np.uint64(k + 1)))
    return out


def _hashed(listed: list[str]) -> np.ndarray:
    column = pa.array(listed)
    return np.sort(W.hashes(W.split(*W.buffers(column))))


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Rows x ``FEATURES`` of a text column; an empty text has zeros throughout."""
    rows = len(column)
    out = np.zeros((rows, len(FEATURES)))
    data, bounds = W.buffers(column)
    words, odd, low_bounds = _plain(column)
    n = np.diff(words.first)
    per_word = 1 / np.maximum(n, 1)
    per_byte = 1 / np.maximum(np.diff(bounds), 1)
    summed = lambda flags, edge: (c := np.concatenate([[0], np.cumsum(flags)]))[edge[1:]] - c[edge[:-1]]

    weight = np.zeros(len(words.row))
    for unit in _units(words):
        if len(lexicon.unit):
            k = np.minimum(np.searchsorted(lexicon.unit, unit), len(lexicon.unit) - 1)
            weight = np.maximum(weight, np.where(lexicon.unit[k] == unit, lexicon.weight[k], 0.0))
    whole = W.hashes(words)
    insult = _within(whole, _hashed(INSULTS))
    hit = (weight > 0) | insult
    out[:, 0] = np.bincount(words.row, weight, rows) * per_word
    hits = summed(hit, words.first)
    out[:, 1] = hits * per_word
    np.maximum.at(out[:, 2], words.row, weight)
    out[:, 3] = np.log1p(hits)
    at = np.flatnonzero(_within(whole, _hashed(SECOND_PERSON)))
    near = np.zeros(len(words.row), bool)
    for step in range(-NEAR, NEAR + 1):
        to = at + step
        ok = (to >= 0) & (to < len(near))
        ok[ok] = words.row[to[ok]] == words.row[at[ok]]
        near[to[ok]] = True
    out[:, 4] = summed(hit & near, words.first) * per_word
    out[:, 5] = summed(insult, words.first) * per_word
    upper = _UPPER[data]
    out[:, 6] = summed(upper, bounds) / np.maximum(summed(~W.NO_LETTER[data], bounds), 1)
    raw = W.split(data, bounds, W.NO_LETTER)
    count = np.concatenate([[0], np.cumsum(upper)])
    shouted = (raw.end - raw.start > 1) & (count[raw.end] - count[raw.start] == raw.end - raw.start)
    out[:, 7] = summed(shouted, raw.first) / np.maximum(np.diff(raw.first), 1)
    out[:, 8] = summed(_EXCLAIM[data], bounds) * per_byte
    out[:, 9] = summed(_MARK[data], bounds) * per_byte
    out[:, 10] = summed(odd, low_bounds) * per_word
    out[:, 11] = summed(_DIGIT[data], bounds) * per_byte
    out[:, 12] = np.log1p(n)
    return out


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``fold, toxic, text`` rows, in how many texts of each fold and kind each unit stands."""
    for batch in batches:
        fold, toxic = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        for a, b in W.slices(W.buffers(batch.column(2))[1]):
            words = _plain(batch.column(2)[a:b])[0]
            unit = np.concatenate(_units(words))
            row = np.tile(words.row, len(BEGINNINGS))
            order = np.lexsort((unit, row))
            unit, row = unit[order], row[order]
            new = np.ones(len(unit), bool)
            new[1:] = (unit[1:] != unit[:-1]) | (row[1:] != row[:-1])
            unit, row = unit[new], row[new]
            for k in range(FOLDS):
                own = fold[a:b][row] == k
                named, to = np.unique(unit[own], return_inverse=True)
                bad = np.bincount(to, toxic[a:b][row[own]], len(named)).astype(np.int64)
                every = np.bincount(to, minlength=len(named))
                folds = np.full(len(named), k, np.int32)
                yield pa.record_batch(
                    [pa.array(folds), pa.array(named.view(np.int64)), pa.array(bad), pa.array(every)], ["fold", "unit", "toxic", "n"]
                )


def _lexicon(counts: DataFrame, size: dict[tuple[int, int], int], folds: list[int]) -> Lexicon:
    """The lexicon that some folds show. ``counts`` has a unit's numbers of texts by fold."""
    bad = sum(n for (fold, toxic), n in size.items() if toxic and fold in folds)
    good = sum(n for (fold, toxic), n in size.items() if not toxic and fold in folds)
    toxic = sum(F.col(f"toxic_{k}") for k in folds)
    clean = sum(F.col(f"n_{k}") for k in folds) - toxic
    odds = F.log((toxic + 0.5) / (bad + 1)) - F.log((clean + 0.5) / (good + 1))
    found = (
        counts.select("unit", toxic.alias("toxic"), odds.alias("weight"))
        .where((F.col("toxic") >= LEAST_TOXIC) & (F.col("weight") >= LEAST_LOG_ODDS))
        .orderBy(F.desc(F.col("toxic") * F.col("weight")), "unit")
        .limit(LEXICON_SIZE)  # the size of the lexicon, a parameter of the model
        .collect()
    )
    unit = np.array([r.unit for r in found], np.int64).view(np.uint64)
    order = np.argsort(unit)
    return Lexicon(unit[order], np.array([r.weight for r in found], float)[order])


def _with_features(rows: DataFrame, lexicon: Lexicon, text_col: str | None) -> DataFrame:
    """``rows`` has one column ``row``; its text is field ``text_col``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            texts = pa.StructArray.field(column, column.type.get_field_index(text_col))
            for a, b in W.slices(W.buffers(texts)[1]):
                found = features(texts[a:b], lexicon)
                ends = pa.array(np.arange(0, found.size + 1, len(FEATURES), dtype=np.int32))
                flat = pa.ListArray.from_arrays(ends, pa.array(found.reshape(-1)))
                yield pa.record_batch([column[a:b], flat], ["row", "dense"])

    schema = StructType(list(rows.schema.fields)).add("dense", ArrayType(DoubleType()))
    return rows.mapInArrow(run, schema).withColumn("features", array_to_vector("dense")).drop("dense")


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from ``labels`` (id and 0 or 1) and the texts of ``docs``.

    ``LEARN_FROM`` labelled ids at most take part, those with the least hashes; null ids or labels
    do not, and of several labels of one id the highest counts. The ids are a bounded table and are
    broadcast, so texts are not shuffled. Where trees or calibration would see no toxic or no other
    text, the model tells the share of toxic ones of every text.
    """
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    told = told.where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    told = told.orderBy(F.xxhash64("id"), "id").limit(LEARN_FROM)
    texts = small_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(told), "id").withColumn("fold", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(FOLDS)).cast("int"))
    rows = scratch.save(texts.repartition("id"))
    size = {(r.fold, r.toxic): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    seen = rows.select("fold", "toxic", "text").mapInArrow(_seen, "fold int, unit long, toxic long, n long")
    by_fold = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}_{k}") for k in range(FOLDS) for c in ("toxic", "n")]
    counts = seen.groupBy("unit").agg(*by_fold, F.sum("toxic").alias("_toxic")).where(F.col("_toxic") >= LEAST_TOXIC)
    counts = scratch.save(counts)
    lexicon = _lexicon(counts, size, list(range(FOLDS)))
    total = sum(size.values())
    rate = sum(n for (_, toxic), n in size.items() if toxic) / total if total else 0.0
    last = FOLDS - 1
    fit = [sum(size.get((k, toxic), 0) for k in range(last)) for toxic in (0, 1)]
    if not all(fit) or not all(size.get((last, toxic)) for toxic in (0, 1)):
        return Model(lexicon, None, None, rate)
    dense = None
    for fold in range(FOLDS):
        own = rows.where(F.col("fold") == fold).select(F.struct("fold", "toxic", "text").alias("row"))
        others = _lexicon(counts, size, [k for k in range(FOLDS) if k != fold])
        part = _with_features(own, others, "text").select(
            "row.fold", F.col("row.toxic").cast("double").alias("label"), vector_to_array("features").alias("dense")
        )
        dense = part if dense is None else dense.unionByName(part)
    dense = scratch.save(dense).withColumn("features", array_to_vector("dense"))
    fitted = GBTClassifier(maxDepth=3, maxIter=20, stepSize=0.2, seed=7)
    trees = fitted.fit(dense.where(F.col("fold") < last).select("features", "label"))
    margin = _margin(trees.transform(dense.where(F.col("fold") == last)))
    calibrated = IsotonicRegression(featuresCol="margin", predictionCol="isotonic").fit(margin.select("margin", "label"))
    return Model(lexicon, trees, calibrated, rate)


def _margin(told: DataFrame) -> DataFrame:
    return told.withColumn("margin", vector_to_array("rawPrediction")[1])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``row`` (all its columns as a struct, so that no names can clash) and
    ``score`` from 0 to 1, higher where toxic is likelier.

    Null and empty texts have all features 0 and the score that the trees give to that. Equal
    calibrated values are set apart, by less than a thousandth, in the order of the trees' margin.
    """
    rows = small_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if model.trees is None:
        return rows.withColumn("score", F.lit(model.rate))
    told = _margin(model.trees.transform(_with_features(rows, model.lexicon, text_col)))
    told = model.calibrated.transform(told)
    finer = 1 / (1 + F.exp(-2 * F.col("margin")))
    return told.select("row", (0.998 * F.col("isotonic") + 0.001 * finer).alias("score"))
