"""Readers of the store's files, with their fallbacks."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..constants import DEFAULT_CONSTRUCTIONS, DEFAULT_LABELS, DEFAULT_PROCESSES, LABEL_PLACEHOLDER, SEED_CONSTRUCTIONS, SEED_PROCESSES
from ..functions.text import trimmed
from ..operators.masters import label_lines, process_lines, with_ordinal


def _missing(e: AnalysisException) -> bool:
    return e.getCondition() == "PATH_NOT_FOUND"


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file holding a JSON array of objects; a missing file is an empty table, a malformed one an error when read."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], schema)


def json_strings(spark: SparkSession, path: str, default: list[str]) -> DataFrame:
    """A file holding a JSON array of strings, as column code; the default where it is missing or malformed."""
    fallback = spark.createDataFrame([(x,) for x in default], "code string")
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if not _missing(e):
            raise
        return fallback
    parsed = text.select(F.from_json("value", "array<string>").alias("codes"))
    good = parsed.where("codes IS NOT NULL").select(F.explode("codes").alias("code"))
    none = parsed.agg(F.count("codes").alias("_n"))
    return good.unionByName(fallback.join(F.broadcast(none)).where("_n = 0").drop("_n"))


def json_rows(spark: SparkSession, path: str, schema: str, default: list[tuple]) -> DataFrame:
    """A file holding a JSON array of objects; the default rows where it is missing or malformed."""
    fallback = spark.createDataFrame(default, schema)
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if not _missing(e):
            raise
        return fallback
    parsed = text.select(F.from_json("value", f"array<struct<{schema}>>").alias("rows"))
    good = parsed.where("rows IS NOT NULL").select(F.inline("rows"))
    none = parsed.agg(F.count("rows").alias("_n"))
    return good.unionByName(fallback.join(F.broadcast(none)).where("_n = 0").drop("_n"))


def default_labels(spark: SparkSession, path: str) -> DataFrame:
    return json_strings(spark, path, list(DEFAULT_LABELS))


def default_constructions(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path, "id long, name string, code string, isActive boolean", [(*x, True) for x in DEFAULT_CONSTRUCTIONS])


def default_processes(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path, "id long, constructionId long, name string, code string, isActive boolean", [(*x, True) for x in DEFAULT_PROCESSES])


def seeded(spark: SparkSession, constructions: DataFrame | None = None, processes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sites, processes) of a new store: the seed rows, under the columns of the default tables. Tables that are given are there already, and stay as they are."""
    sites = spark.createDataFrame([(*x, True) for x in SEED_CONSTRUCTIONS], "id long, name string, code string, isActive boolean")
    steps = spark.createDataFrame([(*x, True) for x in SEED_PROCESSES], "id long, constructionId long, name string, code string, isActive boolean")
    return sites if constructions is None else constructions, steps if processes is None else processes


def csv_cells(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Records of a CSV file as (ord, c0, c1, ...), numbered from 0 in file order, blank ones too; quoted cells may hold line ends.

    An import is one small file that somebody uploads, and one task parses it. Missing cells are null.
    """
    names = ["ord", *(f"c{i}" for i in range(columns))]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                records = csv.reader(io.StringIO(bytes(content).decode("utf-8-sig"), newline=""))
                yield pd.DataFrame([(i, *(r + [None] * columns)[:columns]) for i, r in enumerate(records)], columns=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parse, "ord long, " + ", ".join(f"{c} string" for c in names[1:]))


def label_csv(spark: SparkSession, path: str) -> DataFrame:
    """(ord, code) of a label import: first cells, headers and blanks left out."""
    return label_lines(csv_cells(spark, path, 1).select("ord", F.col("c0").alias("cell")))


def construction_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, code) of a site import: the first record is a header; ids count all records after it."""
    c = csv_cells(spark, path, 2).where("ord > 0")
    return c.select(F.col("ord").alias("id"), trimmed(F.col("c0")).alias("name"), trimmed(F.col("c1")).alias("code")).where("name != '' AND code != ''")


def process_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, constructionId, name, code) of a process import, numbered likewise."""
    return process_lines(csv_cells(spark, path, 3).where("ord > 0"))


def label_asset(spark: SparkSession, path: str) -> DataFrame:
    """(label_index, code) of a bundled list: trimmed ASCII lines without placeholders, each once, where it first stands. Unreadable: empty."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], "label_index long, code string")
    code = trimmed(F.col("value"))
    kept = lines.select(code.alias("code"), F.monotonically_increasing_id().alias("label_index")).where((F.col("code") != "") & (F.col("code") != LABEL_PLACEHOLDER) & F.col("code").rlike(r"\A[\x00-\x7F]*\z"))
    return kept.groupBy("code").agg(F.min("label_index").alias("label_index")).select("label_index", "code")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(idx, symbol): 0 is the blank, then the file's non-empty lines in order."""
    lines = spark.read.text(path).where("value != ''").withColumn("_at", F.monotonically_increasing_id())
    blank = spark.createDataFrame([(0, "blank")], "idx long, symbol string")
    return blank.unionByName(with_ordinal(lines, ["_at"], "idx", 1).select("idx", F.col("value").alias("symbol")))
