"""From raw documents to token ids: quality, exact and near copies, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``.  ``run`` writes each stage's rows as Parquet in the shared
folder of ``spark.checkpoint.dir`` and reads them again, so a lost executor never costs
more than one stage.

Rows with a null id are judged by their text in the classifier, in exact deduplication and
against the benchmark; the similarity join can't name them and keeps them; the encoder gives
them a null id.  Null texts count as empty.  An empty table passes all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import decontaminate, exact_dedup, jaccard_join, quality, sentencepiece_fst
from tidewire.llm.queries import table, use_checkpoints


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal quality classifier doesn't reject."""
    return quality.select_good(docs, table(spark, sf_dir, "labels"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document that stays of each group of equal texts."""
    use_checkpoints(spark)
    return exact_dedup.deduplicate(docs)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each component of the shingle-set similarity join."""
    use_checkpoints(spark)
    return jaccard_join.keep_one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document that is left."""
    return sentencepiece_fst.encode_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", keep_one_copy),
    ("n-gram Jaccard join", keep_one_near_copy),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding", encode),
]

#: the classifier and the encoder can't be written in SQL; a test holds each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4()}"
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
    return docs
