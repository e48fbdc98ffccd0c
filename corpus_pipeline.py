"""From raw documents to packed training sequences.

Each stage is a function of ``(spark, docs, sf_dir)``; its rows are written as Parquet and reread as
the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasledger.llm.decontamination import decontaminated
from atlasledger.llm.language import UNKNOWN, identify, learn
from atlasledger.llm.near_duplicates import near_duplicates
from atlasledger.llm.packing import Limits, pack_documents
from atlasledger.llm.substrings import repeated_runs
from atlasledger.session import Scratch

#: Probability of the likeliest language, among those learned, under which a document is rejected. It
#: sums over all words, so a text of a few words is near 1 whatever it is: this hardly ever acts.
LEAST_SCORE = 0.5
#: Jaccard similarity, in percent, from which documents are near-duplicates.
SIMILAR = 80
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _rows(docs: DataFrame, row: str = "row") -> list:
    """The columns of ``docs`` back from the struct that operators carry them in."""
    return [F.col(row).getField(c).alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised, by a model learned from those that name one.

    Null texts and texts without a letter go, and in effect only those: a text in a language that was
    not learned, or junk with letters, is recognised as the nearest learned one and stays. If no row
    names a language, only those go by rule.
    """
    with Scratch(spark) as scratch:
        model = learn(docs, PIECES, scratch)
    if not model.languages:
        return docs.where(F.col("text").rlike("\\p{L}"))
    told = identify(docs, model)
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*_rows(docs))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one with the smallest id.

    A repeated row is kept once. Documents without words, null texts among them, are no group and all
    stay. Of a group in which no document has an id, none is the smallest, so all of them stay.
    """
    kept = near_duplicates(docs, percent=SIMILAR).where("kept")
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    hashed = docs.withColumn("_own", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash"))
    # merged at every size: what is kept grows with the documents
    joined = hashed.join(kept.hint("merge"), same, "left_semi")
    return joined.dropDuplicates(["doc_id", "_own"]).select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of 35 words or more that come more than once, wherever they come.

    A text that loses words is left as its other words with single spaces, and goes if none is left.
    Other texts stay as they are, without words too.
    """
    left = repeated_runs(docs)
    changed = F.col("n_removed") > 0
    left = left.where(~changed | (F.col("n_removed") < F.col("n_words")))
    own = {
        "text": F.when(changed, F.col("kept_text")).otherwise(F.col("row.text")),
        "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars")),
    }
    return left.select(*[own[c].alias(c) if c in own else F.col("row").getField(c).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out documents with a passage of the benchmark.

    Null and empty texts hold none and stay; repeated rows go or stay alike; an empty benchmark, or
    null items in it, takes out nothing.
    """
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 ids; a row per piece.

    Every row is packed, repeated ones too; a null or empty text is its end id alone, and a row without
    an id has pieces without one.
    """
    return pack_documents(docs, TOKENIZER, 0, Limits(tokens=1024))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicate),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: No stage before packing can be stated in SQL as a whole; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
