"""Exact dedup: a tree-merge of digest runs.

The rows of each input partition are a run. Within a run, rows of one digest collapse
to the best row and a count. Then runs meet in rounds, ``FAN`` neighbours at a time (run
r joins run r // FAN, a binomial tree at a fan of two), each round merging the runs'
entries in order of digest and keeping the best row of each, until one run is left.
The winners go back down the same tree, so that no join key ever has more rows
than a run holds or more partners than ``FAN``: a text that a third of all rows
share costs each round no more than ``FAN`` entries in any task.

A digest entry is verified: entries merge only if the SHA-256, an independent
64-bit hash and the length of the normalised text all agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, rows_of, saved, strip_space, text_key

#: Runs that meet in one round.
FAN = 4
_KEY = ["_sha", "_check", "_chars"]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when equal after deleting ASCII white space. The row with the
    most code points in the original text stays, then the smallest id. A null text
    counts as empty; empty texts form one group; an empty table gives no rows; a row
    with a null id takes part and never wins over a row with an id of the same length. Rows of one
    id and length are ties and share one fate. Other columns are ignored,
    whatever their names.
    """
    return judged(docs, id_col, text).drop("_text")


def judged(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """The same with _text, the hash of each row's text."""
    spark = docs.sparkSession
    runs = max(parts(spark), 2)
    raw = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    bare = strip_space(raw)
    leaf = saved(
        docs.select(F.col(id_col).alias("_id"), F.length(raw).alias("_len"), text_key(raw).alias("_text"), bare.alias("_bare")).select(
            "_id",
            "_len",
            "_text",
            F.unhex(F.sha2(F.col("_bare"), 256)).alias("_sha"),
            F.xxhash64("_bare").alias("_check"),
            F.length("_bare").alias("_chars"),
            (F.spark_partition_id() % runs).alias("_run"),
        )
    )
    # the least struct is the best row: longest text, then an id, then the smallest
    best = F.struct((-F.col("_len")).alias("l"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i"))
    level = leaf.groupBy("_run", *_KEY).agg(F.min(best).alias("_best"), F.count("*").alias("_size"))
    levels, n = [], runs
    while n > 1:
        level = saved(level)
        levels.append(level)
        level = (
            level.withColumn("_run", F.floor(F.col("_run") / FAN))
            .groupBy("_run", *_KEY)
            .agg(F.min("_best").alias("_best"), F.sum("_size").alias("_size"))
        )
        n = -(-n // FAN)
    for below in reversed(levels):
        up = level.select(F.col("_run").alias("_up"), *_KEY, F.col("_best").alias("_top"), F.col("_size").alias("_all"))
        level = (
            below.select("_run", *_KEY, F.floor(F.col("_run") / FAN).alias("_up"))
            .join(up, ["_up", *_KEY])
            .select("_run", *_KEY, F.col("_top").alias("_best"), F.col("_all").alias("_size"))
        )
    return leaf.join(level, ["_run", *_KEY]).select(
        F.col("_id").alias(id_col),
        F.col("_best.i").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_best.i").eqNullSafe(F.col("_id")) & (F.col("_best.l") == -F.col("_len"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
        "_text",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) that stay, with all their columns, whatever their names.

    Rows of equal id and length in one group share one fate, repeated rows among them; a null
    text counts as empty; a null id stays only where its row is longer than all others of the
    group; an empty table stays empty.
    """
    return rows_of(docs, judged(docs).where("kept").select("doc_id", F.col("_text").alias("key")))


ORACLE = """
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS len,
                  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size, max(len) OVER (PARTITION BY text_sha256) AS top FROM t)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AND len = top AS kept, text_sha256 FROM w
"""
