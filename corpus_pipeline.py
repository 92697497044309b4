"""From documents to training input: quality, language, near-duplicates, mixing order, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of documents; the last gives each document's slot and place in the mixing order, and is sorted by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagframe.llm import language_id, minhash_dedup, mixing, quality, sentencepieces
from tagframe.llm.common import saved, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier, fitted on `labels`, does not reject."""
    scored = quality.quality_scores(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that some learned language explains; texts without letters or beyond MOST_BITS go.

    A text of one or two phrases is too short to be judged by its bits, and stays.
    """
    named = language_id.languages(docs.withColumnsRenamed({c: f"_{k}" for k, c in enumerate(docs.columns) if c in language_id.NEW}), language_id.learn(docs))
    kept = named.where((F.col("lang_pred") != "und") & ((F.col("bits") <= language_id.MOST_BITS) | (F.col("phrases") <= 2))).drop(*language_id.NEW)
    return kept.toDF(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates (five words, similarity 0.8): the one with the least doc_id.

    Every row is judged by its own text, whatever its doc_id; of groups without any doc_id one row stays too.
    """
    return minhash_dedup.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in the order in which the schedule mixes their sources."""
    return mixing.mixed_order(docs).orderBy("slot", "place", "doc_id").select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the documents, sorted by slot and place of the schedule.

    Rows read back from files have no order, so the schedule is asked again; the same documents get the same one.
    """
    order = mixing.mixed_order(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", "text", "slot", "place")
    return sentencepieces.encoded(order.orderBy("slot", "place"), sentencepieces.model_bytes()).select("doc_id", "lang", "source", "slot", "place", "n_tokens", "ids")


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_each_group),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding", token_ids),
]

#: No stage but the order can be put in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = saved(docs, f"stage{k}")
    return docs
