"""A training-corpus pipeline: STAGES applied one after the other, each written as Parquet and reread.

Every stage works on all rows that its predecessor kept. All but the last return the columns of documents; the last returns,
for each document of the mix (a document taken twice is there twice), its number of tokens and the digests of its ids and of
the text decoded from them.

Defined cases: documents with null, empty or blank text fit no language and go in the second stage, or in the first if its judge
rejects them; with nothing to learn from, the first two stages keep all; of rows alike in all columns one stays; a null source is a
source like others; null ids and columns of clashing names pass as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgeno.llm import bpe, langid, mixing, quality, simhash
from loomgeno.llm.common import materialize
from loomgeno.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained judge, taught by the table of labels, accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language."""
    return langid.identified(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of least doc_id, of each group of near-duplicates: five-word shingle sets at a similarity of 0.8 or more."""
    return simhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    return bpe.round_trip(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality), ("language", keep_languages), ("near_duplicates", one_of_each), ("mix", mix_sources), ("tokens", tokens),
]

#: SQL can't express the classifiers, the hash thresholds or byte-pair encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
