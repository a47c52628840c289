"""Master data: imports, deletions, upserts, refreshes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import LABEL_HEADERS
from ..functions.text import server_normalized, trimmed
from .keep import saved


def label_lines(rows: DataFrame) -> DataFrame:
    """First cells of an import (ord, cell) as codes: header cells, wherever they stand, and cells that normalise to nothing are skipped."""
    c = trimmed(F.regexp_replace("cell", "^﻿", ""))
    header = (c == LABEL_HEADERS[0]) | (F.lower(c) == LABEL_HEADERS[1])
    return rows.where((c != "") & ~header).select("ord", server_normalized(c).alias("code")).where("code != ''")


def import_labels(existing: DataFrame, incoming: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """(labels after, counts). ``existing`` (code), ``incoming`` (ord, code); mode replace or diff.

    Replacing keeps each incoming code once and skips none; a difference adds codes that
    are neither there nor earlier in the file and counts the rest as skipped.
    """
    new = incoming.select("code").distinct()
    if mode == "replace":
        return new, new.agg(F.count("*").alias("count"), F.lit(0).cast("long").alias("skipped"))
    added = new.join(existing.select("code").distinct(), "code", "left_anti")
    counts = added.agg(F.count("*").alias("count")).join(incoming.agg(F.count("*").alias("_all"))).select("count", (F.col("_all") - F.col("count")).alias("skipped"))
    return existing.select("code").unionByName(added).distinct(), counts


def import_diff(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """All incoming rows whose key is not there yet; repeats within the file all count, and ids stay as they come."""
    return existing.unionByName(incoming.join(existing.select(*keys).distinct(), keys, "left_anti").select(*existing.columns))


def import_counts(existing: DataFrame, incoming: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """How many rows a site or process import takes and skips; replacing takes all."""
    new = incoming if mode == "replace" else incoming.join(existing.select(*keys).distinct(), keys, "left_anti")
    taken = new.agg(F.count("*").alias("count"))
    return taken.join(incoming.agg(F.count("*").alias("_all"))).select("count", (F.col("_all") - F.col("count")).alias("skipped"))


def import_rows(existing: DataFrame, incoming: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """A site or process table after an import: the incoming rows alone, or those with new keys added."""
    return incoming.select(*existing.columns) if mode == "replace" else import_diff(existing, incoming, keys)


def process_lines(rows: DataFrame) -> DataFrame:
    """Process import (ord, c0, c1, c2) after the header: the site number, else 1, with name and code; ids are ordinals, skipped rows counted."""
    name, code, site = trimmed(F.col("c1")), trimmed(F.col("c2")), trimmed(F.col("c0"))
    number = F.coalesce(F.when(site.rlike(r"\A[+-]?[0-9]+\z"), site.try_cast("bigint")), F.lit(1))
    return rows.select(F.col("ord").alias("id"), number.alias("constructionId"), name.alias("name"), code.alias("code")).where((F.col("name") != "") & (F.col("code") != ""))


def with_fallback(stored: DataFrame, bundled: DataFrame) -> DataFrame:
    """The stored labels, or the bundled ones if none is stored."""
    n = stored.agg(F.count("*").alias("_n"))
    return stored.unionByName(bundled.join(F.broadcast(n)).where("_n = 0").drop("_n"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert or replace by primary key."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def delete_where(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    return rows.join(ids, key, "left_anti")


def cascade(children: DataFrame, parents: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(key).alias(foreign)), foreign, "left_semi")


def orphans(children: DataFrame, parents: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """Children without a parent; a refresh with any of them fails as a whole."""
    return children.join(parents.select(F.col(key).alias(foreign)), foreign, "left_anti")


def next_id(rows: DataFrame) -> DataFrame:
    return rows.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("_next"))


def add_row(rows: DataFrame, new: DataFrame) -> DataFrame:
    """``rows`` with the one row of ``new`` (the other columns), under the id after the largest."""
    return rows.unionByName(new.join(F.broadcast(next_id(rows))).withColumnRenamed("_next", "id").select(*rows.columns))


def add_label(labels: DataFrame, typed: DataFrame) -> DataFrame:
    """Labels with one typed ``code`` added in its normalised form; one that is there, or normalises to nothing, adds none."""
    new = typed.select(server_normalized(F.col("code")).alias("code")).where("code != ''")
    return labels.select("code").unionByName(new.join(labels.select("code"), "code", "left_anti"))


def with_items(parents: DataFrame, items: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame]:
    """New registrations (key, ...) under ids from ``first_id`` in order of key, and their items (key, ...) bearing the parent's id."""
    numbered = saved(with_ordinal(parents, ["key"], "id", first_id))
    return numbered.drop("key"), items.join(numbered.select("key", F.col("id").alias("registrationId")), "key").drop("key")


def refreshed(sites: DataFrame, processes: DataFrame, new_sites: DataFrame, new_processes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both master tables after a refresh: the new ones, or the old ones where a new process names a site that is not there."""
    bad = orphans(new_processes, new_sites, "constructionId").agg(F.count("*").alias("_bad"))
    pick = lambda old, new: new.join(F.broadcast(bad)).where("_bad = 0").drop("_bad").unionByName(old.join(F.broadcast(bad)).where("_bad > 0").drop("_bad"))
    return pick(sites, new_sites), pick(processes, new_processes)


def split_flat(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Old flat registrations as (parents, items): each row one parent of its id and one item of order 0."""
    return flat.drop("productCode"), flat.select(F.col("id").alias("registrationId"), "productCode", F.lit(0).alias("displayOrder"), "registeredAt")


def ingested(posted: DataFrame, received_at: str | None = None, existing: int = 0) -> DataFrame:
    """Records of posted registrations (id, at, process_id, ..., codes): one a code, with its own id, a list of the one code and the time of receipt, the query's own unless given."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if received_at is None else F.lit(received_at)
    rows = posted.select(*(c for c in posted.columns if c != "codes"), F.posexplode("codes").alias("pos", "code"))
    out = with_ordinal(rows, ["at", "id", "pos"], "_row", existing + 1)
    return out.drop("id", "at", "pos").withColumnRenamed("_row", "id").withColumn("product_numbers", F.array("code")).withColumn("received_at", now).drop("code")


def exploded(posted: DataFrame, existing: int = 0) -> DataFrame:
    """Posted registrations (id, at, codes), one row a code; ids run on from ``existing`` in order of arrival."""
    rows = posted.select("id", "at", F.posexplode("codes").alias("pos", "code"))
    return with_ordinal(rows, ["at", "id", "pos"], "row_id", existing + 1)


def with_ordinal(rows: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """Number rows in a total order without gathering them: sorted ranges that are kept, a count for each, and the place within."""
    spark = rows.sparkSession
    # kept, so that the ranges are the same in every reading, also after the loss of an executor
    ranged = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))
    offsets, total = [], start
    for r in ranged.groupBy("_range").count().orderBy("_range").collect():
        offsets.append((r["_range"], total))
        total += r["count"]
    base = spark.createDataFrame(offsets, "_range int, _base long")
    # the lower 33 bits of these ids are a row's place in its partition
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("_at", place).join(F.broadcast(base), "_range").withColumn(name, F.col("_base") + F.col("_at")).drop("_range", "_base", "_at")
