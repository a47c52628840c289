"""Exports: rows as they appear in CSV files, and the files."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import NO_VALUE


def export_rows(registrations: DataFrame) -> DataFrame:
    """The registration export's columns: missing names as a dash, codes joined, the time to the second."""
    name = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(NO_VALUE))
    return registrations.select(
        "id",
        name("construction_name").alias("construction"),
        name("process_name").alias("process"),
        F.array_join("product_numbers", ", ").alias("codes"),
        F.col("worker_id").alias("worker"),
        F.replace(F.substring("received_at", 1, 19), F.lit("T"), F.lit(" ")).alias("received"),
    )


def write_csv(rows: DataFrame, path: str, one_header: bool = False) -> None:
    """Part files with a header each; UTF-8 with a byte-order mark before the first column's name, CR LF at the end of records.

    With ``one_header`` only the first part has it: the parts put together by name are one file, though no task has seen it whole.
    """
    head = io.StringIO()
    csv.writer(head, lineterminator="").writerow(rows.columns)

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not one_header or TaskContext.get().partitionId() == 0:
            yield pd.DataFrame({"value": ["\ufeff" + head.getvalue()]})
        yield from batches

    line = F.to_csv(F.struct(*rows.columns), {"escape": '"'})
    rows.select(line.alias("value")).mapInPandas(lines, "value string").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Replace a JSON collection, each part file a JSON array; the commit protocol makes the new files visible only when all are written."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lead = "["
        for b in batches:
            if len(b):
                yield pd.DataFrame({"value": [(lead if i == 0 else ",") + x for i, x in enumerate(b["value"])]})
                lead = ","
        yield pd.DataFrame({"value": ["]" if lead == "," else "[]"]})

    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).mapInPandas(lines, "value string").write.mode("overwrite").text(path)
