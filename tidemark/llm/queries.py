"""The registered training-data queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, mixing, neighbours, ngrams, pieces, quality, secrets, substrings, topk, toxicity
from .common import id_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), digests=True)


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    held = (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    return toxicity.score_documents(docs, lexicon).select("doc_id", held, "score", "predicted", "n_terms")


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.learn(docs, train=id_remainder(F.col("__id"), 3) != 1)
    held = (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out")
    return language.predict_documents(docs, profiles).select("doc_id", held, "lang_pred", "score")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = id_remainder(F.col("__id"), 5) != 0
    path = F.concat_ws("/", "source", "lang")
    return quality.classify(docs, table(spark, sf_dir, "labels"), F.col("source"), path, train=train)


@query
def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"), digests=True)


@query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.join_documents(table(spark, sf_dir, "documents"), n=3, percent=90)


@query
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


@query
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"), repetition=3.0)
