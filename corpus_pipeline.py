"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it
kept; all but the last return the columns of documents.  ``run`` writes every result as
Parquet in the folder that driver and executors share and reads it as the next input.

Defined cases are those of the operators: null, empty and unreadable texts go in the
first stage (they have no language); rows with one doc_id are one document; a table
without rows gives none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corrmatch.llm import jaccard, langid, mixing, packing, substrings
from corrmatch.llm.common import read, shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the language is known; the others go."""
    return langid.accept(docs, langid.trained(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id."""
    return jaccard.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one of smaller doc_id keeps."""
    return substrings.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose words meet the target weights of sources, languages and topics."""
    return mixing.sample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequences of 2,048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", passages),
    ("source_mixing", mixture),
    ("best_fit_packing", packed),
]

#: Hash signatures, a trained classifier and packing are beyond SQL; tests hold the
#: stages against plain versions instead.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``.

    What a stage was given is removed once its result is written whole.
    """
    folder, given = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if given:
            _remove(spark, f"{folder}/{given}")
        given = name
    return docs
