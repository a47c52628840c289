"""A corpus pipeline over the table ``documents``: filter, deduplicate twice, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it
kept; all but the last return the columns of ``documents``. Between stages the rows
are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, dedup, jaccard, mixing, quality
from plumbline.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts go; repeated rows share one fate; rows of one id are judged each by its
    own text; null ids are judged like others; an empty table stays empty; all columns stay,
    whatever their names. The same holds for the columns and empty tables of the next three.
    """
    return quality.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts.

    Null and empty texts are equal; the longest stays, then the smallest id, a null one last;
    repeated rows of one id and length share one fate.
    """
    return dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity of 0.8 or more.

    Texts without words stay; of several texts of the smallest id, or where all ids are null, those
    of one set stay; repeated rows share one fate.
    """
    return jaccard.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the probabilities that meet the target weights.

    A null source or language is a value of its own; rows of one id draw alike, a null id like an
    empty one; rows of a cell without words stay.
    """
    return mixing.keep_mixed(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left: doc_id, n_tokens, ids_sha256, decoded_sha256, ids.

    A null or empty text has none; repeated rows give repeated results; null ids pass through.
    """
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram jaccard join", near_stage),
    ("mixing sources", mixing_stage),
    ("byte-level bpe", encode_stage),
]

#: Byte-pair merges are beyond SQL; tests/llm compares run() with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` of the folder; the last one's rows. An empty table, or one of which nothing is left, gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
