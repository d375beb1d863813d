"""A corpus made ready for training: five stages, each written as Parquet and read again as the next one's documents.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgap.llm import langid, mixing, pieces, quality_net, simhash
from skillgap.llm.names import fresh
from skillgap.llm.queries import model_path, table
from skillgap.sources.scratch import remove, scratch_path, scratch_scope


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network scores at its threshold or more; it learns from all labels."""
    net = quality_net.learn(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs.columns, "score")
    return quality_net.score(docs, net, name=score).filter(F.col(score) >= quality_net.THRESHOLD).drop(score)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one known language makes up at least half; learnt from the languages given."""
    model = langid.learn(docs)
    lang, score = fresh(docs.columns, "lang_pred", "score")
    found = langid.predict(docs, model, lang=lang, score=score)
    return found.filter((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= 0.5)).drop(lang, score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_first(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with their number and digests."""
    return pieces.encode_pieces(docs, model_path(), keep=True).drop("decoded")


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources", mixture),
    ("SentencePiece", tokens),
]
#: The network, the mixture model and the merges are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over ``documents``; every stage is written to the shared folder.

    What a stage has staged goes when it is written, and its input with it; the last stage's table stays.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.split()[0].lower())
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
