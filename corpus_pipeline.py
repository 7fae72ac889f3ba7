"""A training corpus from raw documents: language, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. Texts of any length are read whole; an empty table gives an empty result at
every stage. Null and empty texts leave in the first stage, which finds no language in them; rows without an id stay, as nothing
names them; rows that repeat an id and a text become one in the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.llm import exact_dedup, language_cnn, near_groups, packing, phrase_automata
from cladeworks.llm.shared import scratch

#: A document whose language is this uncertain is rejected; with four languages no score is below 0.25.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no text, no letter, or no language more probable than ``LEAST_SCORE``."""
    network = language_cnn.train(docs.where(~language_cnn.held_out()).select("doc_id", "text", "lang"))
    return language_cnn.keep_recognised(docs, network, LEAST_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return near_groups.drop_near_duplicates(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document with a smaller id has already are removed; a document that keeps none goes."""
    return phrase_automata.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("passages", passages), ("packing", pack)]

#: The first stage is a trained network, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
