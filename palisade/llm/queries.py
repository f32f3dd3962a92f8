"""The catalogue's queries of these operators, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import bpe, decontaminate, langid, merkle, negatives, neighbours, pieces, pii, secrets, sharding, simhash, tokenfile, webtext
from palisade.llm.common import documents, ready
from palisade.plans.registry import query
from palisade.session import read_table

SHARDS = 40


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; the operators take the content, so only the driver needs it."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_decontamination", decontaminate.ORACLE)
def benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(documents(spark, folder), read_table(spark, folder, "benchmark"))


@query("op2_jump_shards", sharding.oracle(SHARDS))
def jump_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, folder), SHARDS)


@query("op4_pii")
def pii_spans(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder)
    return pii.report(rows, pii.train(rows))


@query("op9_secrets", secrets.oracle())
def secret_spans(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(documents(spark, folder))


@query("op10_simhash")
def simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.report(documents(spark, folder))


@query("op5_rans")
def token_file(spark: SparkSession, folder: str) -> DataFrame:
    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as file:
        store = tokenfile.write(documents(spark, folder), file.read())
    return tokenfile.report(spark, store)


def piece_model() -> bytes:
    with open(vocabulary("piece_bpe_32k.model"), "rb") as file:
        return file.read()


@query("op3_pieces")
def piece_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every text's ids, and whether decoding them gives the text back."""
    coded = pieces.encode(documents(spark, folder).select("doc_id", "text"), piece_model(), check="restored")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "restored")


@query("op7_language")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder)
    return langid.report(rows, langid.train(rows))


@query("op8_web_text")
def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return webtext.extract(read_table(ready(spark), folder, "pages"))


@query("op6_learned_partitions")
def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(read_table(ready(spark), folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op13_merkle", merkle.oracle())
def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.report(documents(spark, folder))


@query("op11_hard_negatives", negatives.ORACLE)
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.report(read_table(ready(spark), folder, "embeddings"))


@query("op12_bpe")
def bpe_ids(spark: SparkSession, folder: str) -> DataFrame:
    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as file:
        return bpe.report(documents(spark, folder), file.read())
