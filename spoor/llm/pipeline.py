"""The corpus pipeline: five stages, each written as Parquet and reread as the next one's documents.

Each function takes (spark, docs, sf_dir). All but the last return the columns
of documents, extra ones included, whatever their names; the last returns the
digests of the encoded texts. In every stage null texts count as empty, null
ids are ids of their own, and an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, jaccard, mixing, toxicity
from .common import table, written

RANKS = "byte_bpe_multi_50k.tiktoken"


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go.

    Each row is judged by its own text: repeated rows and rows that share an id
    are judged one by one; null and empty texts get the model's base score.
    Without labels of both classes the model rests on the fixed lists.
    """
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays.

    Null ids are lowest; of repeated rows one stays; all null and empty texts
    are equal. Rows that share an id but not the text all stay.
    """
    return exact.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, the one with the least doc_id.

    Null ids are lowest. Texts of fewer than five words are linked if their
    words are equal. Of rows that share an id, one of each sequence of words stays.
    """
    return jaccard.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by training position, repeated or left out as their source's target says.

    A null source is a source of its own. Documents without words are never
    taken; repeated rows count each; ties in position go by doc_id. Files and
    their rows are in training order.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text's ids, with their number and digest, decoded again, and its training position.

    position rises with the order of the files and rows that the stage before
    wrote; it is null where ``docs`` does not come from files. Every row gives
    one row, repeated ones too; a null text has no ids.
    """
    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, position=_position(docs), keep_ids=True)


def _position(docs: DataFrame) -> Column:
    """The number of a row's file among part files, then its number in the file."""
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("bigint")
    place = (F.shiftleft(part, 40) + F.col("_metadata.row_index")).alias("position")
    try:
        docs.select(place)
    except AnalysisException:  # not read from files
        return F.lit(None).cast("bigint").alias("position")
    return place


STAGES = [("toxicity", keep_clean), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mix", mix_sources), ("encode", encode)]

#: The toxicity model and the MinHash candidates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
