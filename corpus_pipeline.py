"""A corpus pipeline in five stages: quality, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. A stage begins by deleting the scratch tables of the stages before it: their results have been
written by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, mixing, ngram_join, packing, quality
from tessera.llm.common import clear_scratch, delete, read, scratch_path
from tessera.llm.queries import tokenizer

#: The classifier has no SQL, so the rows of run() are tested against brute force instead.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of ``sf_dir``, scores 0.7 or more, with all their columns.

    Null and empty texts are scored as texts without words, texts of any length whole; equal texts, ties and repeated
    rows are judged alike; null ids have no label and are scored like others. Without labels every score is 0.5 and
    nothing stays. An empty table gives no rows; other columns may have any names.
    """
    clear_scratch(spark)
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id, with all its columns.

    Null ids are least; null and empty texts are equal; texts of any length are compared whole; of repeated rows with the
    id that stays one stays. An empty table gives no rows; other columns may have any names.
    """
    clear_scratch(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five words, similarity 0.8) the document with the least doc_id, with all its columns.

    A class without ids keeps one of its rows; texts without words, null ones too, are a class; texts of any length are
    compared whole; of repeated rows one stays. An empty table gives no rows; other columns may have any names.
    """
    clear_scratch(spark)
    return ngram_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them, with all their columns.

    A null source is a source of its own, last in order; documents without words, null texts too, stay once; null ids are
    ordered by their text; rows that tie with the last one taken are all taken. An empty table gives no rows.
    """
    clear_scratch(spark)
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens.

    Null and empty texts are one piece of one id; long texts are cut, never shortened; repeated rows and null ids are
    packed like others. An empty table gives no rows; other columns play no part.
    """
    clear_scratch(spark)
    return packing.pack_documents(docs, tokenizer())


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents of ``sf_dir``. What a stage wrote goes when the next one has written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{k}-{name}", until_exit=True)
            made.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                delete(spark, before)
            before = path
    return made
