"""Small helpers that the operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from itertools import count, takewhile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators of words here.
SPACE = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def strip_space(text: Column) -> Column:
    """The text without ASCII white space; a null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or on one machine a folder of our own where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        held = spark.sparkContext.getCheckpointDir()
        if held is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = held or tempfile.mkdtemp(prefix="plumbline-")
        if held is None:
            spark.sparkContext.setCheckpointDir(at)
    return at


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder's URI under the shared folder; the writer makes it."""
    return os.path.join(shared_dir(spark), f"plumbline-{name}-{uuid.uuid4().hex}")


def saved(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, where the loss of an executor does not reach them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Short rows that one task reads of a kept table.
ROWS = 16_000


def tasks_for(kept: DataFrame, rows: int = ROWS) -> int:
    """How many tasks of ``rows`` rows a kept table makes."""
    return max(1, -(-kept.count() // rows))


def packed(df: DataFrame, most: int | None = None) -> DataFrame:
    """Like ``saved``, in as few partitions as its rows need: what is small makes few tasks and few shuffle files, however many partitions it came from.

    Where it is known beforehand that ``most`` tasks are enough for it, no more write it.
    """
    out = saved(df.coalesce(most) if most else df)
    return out.coalesce(tasks_for(out))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like ``saved``, as a Parquet table: columnar and compressed, for wide or many rows."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """With an id, what tells the rows of a table apart: repeated rows have one key."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def rows_of(docs: DataFrame, keys: DataFrame, key: Column | None = None) -> DataFrame:
    """The rows of ``docs`` whose doc_id and key (unless given, that of the text) are among ``keys`` (doc_id, key), with all their columns, whatever their names."""
    taken = {c.lower() for c in docs.columns}
    i, k = ("".join([n, *("_" for _ in takewhile(lambda m: n + "_" * m in taken, count()))]) for n in ("_id", "_key"))
    keys = keys.select(F.col("doc_id").alias(i), F.col("key").alias(k)).distinct()
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col(i)) & ((text_key(F.col("text")) if key is None else key) == F.col(k)), "left_semi")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """How many partitions a shuffle makes in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: DuckDB's SQL for CRC-32: a table of 256 entries made by rule, and the CRC of the UTF-8 bytes of ``text`` where that table is at hand as ``tab``.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab"


def crc_sql(text: str) -> str:
    each = f"list_transform(range(strlen({text})), lambda i: ('0x' || hex({text})[2 * i + 1 : 2 * i + 2])::BIGINT)"
    return f"xor(list_reduce({each}, lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295), 4294967295)"
