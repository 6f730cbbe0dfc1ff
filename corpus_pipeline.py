"""From documents to packed training sequences, by five operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inkframe.llm import language_id, mixing, near_dedup, packing, substring_dedup
from inkframe.llm.staging import Stage, table

#: A text with less than this share of trigrams known in any one language is rejected.
LEAST_SCORE = 0.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: texts without letters, and those unlike all languages, go."""
    model = language_id.train(docs.filter(language_id.learned()))
    # the input may have columns of the prediction's names: all but the text get names of their own
    own = docs.toDF(*[c if c == "text" else f"own_{i}" for i, c in enumerate(docs.columns)])
    found = language_id.predict(own, model).filter(f"lang_pred <> 'und' and score >= {LEAST_SCORE}")
    return found.select(*own.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of twenty words that start earlier in the corpus."""
    return substring_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the sources' target shares, repeated or left out."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    stage = Stage(spark, "packing")
    return packing.pack(stage.put("pieces", packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))), stage)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]
#: Sketches, packing and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stage = table(spark, sf_dir, "documents"), Stage(spark, "pipeline")
    for name, step in STAGES[:-1]:
        docs = stage.put(name, step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
