"""The corpus pipeline over ``documents``: five stages, each written as Parquet and reread by the next.

Language ID drops what it cannot name; of each group of near copies one document stays; documents that hold a benchmark
item go; personal data is replaced; the rest is encoded, and decoded again as a check. Every stage works on all rows its
predecessor kept and, but for the last, returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import decontaminate, langid, pieces, pii, simhash
from palisade.llm.common import documents, fresh, ready
from palisade.llm.queries import piece_model
from palisade.plans.registry import query
from palisade.session import land, landed_count, read_table, release

#: A language is not taken on less than this probability; with four languages even a blind guess has a quarter.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, null ones included, and texts of no recognisable language go."""
    ready(spark)
    name, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    found = langid.identify(docs, langid.train(docs), to=name, score=score)
    return found.where((F.col(name) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).drop(name, score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose three-word fingerprints differ in two bits or fewer are linked; the smallest doc_id of each component stays."""
    ready(spark)
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, read_table(ready(spark), sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in brackets; n_chars follows the text."""
    ready(spark)
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    ready(spark)
    coded = pieces.encode(docs.select("doc_id", "text"), piece_model(), check="restored")
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "restored")


STAGES = [
    ("language ID", language), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination),
    ("PII", personal_data), ("SentencePiece encoding and decoding", tokens),
]

#: A network, boosted trees and the model's merges are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = documents(spark, sf_dir), landed_count(spark)
    for _, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir))
        release(spark, mark, keep=1)  # what the stage landed on its way, and what it was given
    return STAGES[-1][1](spark, docs, sf_dir)
