"""A training corpus from raw documents, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir), the rows that its predecessor kept, and returns a DataFrame;
all but the last return the columns of `documents`. `run` writes every stage's result as Parquet to
the shared checkpoint folder and reads it again, so a lost executor costs one stage's tasks at most;
a stage's result is deleted once the next one is written.

Cases, for every stage: a null or empty text stays (it scores as clean, links with nothing, holds no
secret, has no tokens); texts of any length are taken whole; a null id stays a row of its own; rows
that repeat an id and a text are kept or dropped together; an empty table gives an empty table with
the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, ngrams, pieces, secrets, toxicity
from tidemark.llm.common import Scratch, table
from tidemark.llm.queries import tokenizer_path

REPETITION = 2.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; the lexicon is learned from the labelled
    ones among them. Without labels nothing is dropped."""
    return toxicity.reject(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles of similarity 0.8 link: the smallest id.
    Rows with a null id stay, and so do all rows of a kept id."""
    joined = ngrams.join_documents(docs, n=5, percent=80)
    kept = joined.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__kept")).distinct()
    kept = docs.join(kept, docs["doc_id"] == F.col("__kept"), "left_semi")
    return kept.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with credentials masked, the linked parts of multipart ones too."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of small sources again, up to `REPETITION` passes; rows in
    the order of the mix, in which the sources' blocks interleave."""
    counts = Scratch(spark, "mixing").put("counts", mixing.token_counts(docs, "doc_id", "text", "source"))
    return mixing.mix(docs, mixing.plan(counts, repetition=REPETITION)).orderBy("__position").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of token ids, and the SHA-256 of the ids and of the text they decode to; a null
    text counts as empty."""
    return pieces.encode_documents(docs, tokenizer_path(), digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: The stages learn a lexicon and close links transitively: no single SQL statement gives run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.put(f"{i}-{name}", stage(spark, docs, sf_dir))
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
