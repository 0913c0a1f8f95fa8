"""The corpus pipeline: toxicity, language identification, near-duplicates, mixture, packing.

Each stage reads what its predecessor kept, as Parquet in the shared folder, and
its decisions take effect: rejected documents go, one document of each
near-duplicate group stays, copies follow the mixture, and the last stage lays
the pieces into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabularium.llm import language, mixing, packing, simhash, toxicity
from tabularium.llm.common import forget, forget_at_exit, shared_folder, table
from tabularium.llm.tokens import public_vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; the model learns from labels over the documents given."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_civil(docs, model).select(*COLUMNS)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose declared language the prediction doesn't surely contradict."""
    vocabulary = public_vocabulary("piece_bpe_32k.model")
    model = language.fit(docs, vocabulary)
    return language.keep_declared(docs, model, vocabulary).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group."""
    return simhash.keep_one(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents by the production weights, in shuffled order."""
    return mixing.mix(docs, mixing.WEIGHTS, mixing.REST).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each copy lies in sequences of 2048 tokens."""
    return packing.pack(docs, public_vocabulary("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", keep_civil),
    ("language_id", keep_language),
    ("simhash_near_dedup", keep_one_of_each),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's result is written as Parquet and read again.

    A stage's result is deleted as soon as the next one is written, the last one's when the application ends.
    """
    docs, folder, last = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    forget_at_exit(spark, folder)
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            forget(spark, last)
        last = path
    return docs


#: Trained models and fingerprints are beyond SQL; tests hold run() against the stages' brute-force versions.
ORACLE_SQL = None
