"""Reading the registration store: the flat history, its filters, counts and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ELIGIBLE, MAX_RETRIES, UNSYNCED
from ..functions.text import contains_like

FLAT = ["id", "productCode", "constructionName", "processName", "warehouseNo", "columnNo", "tierNo", "syncStatus", "registeredAt", "syncedAt", "userId", "imagePath"]


def flat(registrations: DataFrame, items: DataFrame) -> DataFrame:
    """Items with their registration's columns; a registration without items has no row. ``displayOrder`` rides along for ordering."""
    return items.join(registrations, items["registrationId"] == registrations["id"]).select(*FLAT, "displayOrder")


def newest_first(history: DataFrame) -> DataFrame:
    """By time, newest first; id, item number and code make the order total."""
    return history.orderBy(F.desc("registeredAt"), "id", "displayOrder", "productCode").drop("displayOrder")


def unsynced(status: Column) -> Column:
    return status.isin(*UNSYNCED)


def eligible(status: Column, retries: Column) -> Column:
    """What a sync sends; narrower than ``unsynced``."""
    return status.isin(*ELIGIBLE) & (retries < MAX_RETRIES)


def search(history: DataFrame, typed: str) -> DataFrame:
    return history.where(contains_like(F.col("productCode"), typed) | contains_like(F.col("constructionName"), typed))


def ordered_codes(items: DataFrame) -> DataFrame:
    """One row a registration: its codes in display order. A registration's items are few; the array is its payload."""
    ordered = F.sort_array(F.collect_list(F.struct("displayOrder", "productCode", "price")))
    return items.groupBy("registrationId").agg(ordered.alias("o")).select("registrationId", F.col("o.productCode").alias("codes"))


def process_ids(processes: DataFrame, constructions: DataFrame) -> DataFrame:
    """(constructionName, processName, processId): the smallest id where names repeat."""
    c = constructions.select(F.col("id").alias("constructionId"), F.col("name").alias("constructionName"))
    return processes.join(c, "constructionId").groupBy("constructionName", F.col("name").alias("processName")).agg(F.min("id").alias("processId"))


def login_outcomes(tries: DataFrame, users: DataFrame) -> DataFrame:
    """``tries`` (userId, password, and others) with the outcome: what is blank, else mismatch, or ok for an active user (userId, password, id, isActive)."""
    known = users.where("isActive").groupBy("userId", "password").agg(F.min("id").alias("_user"))
    no_id, no_pw = F.trim("userId") == "", F.trim("password") == ""
    outcome = F.when(no_id & no_pw, "both blank").when(no_id, "id blank").when(no_pw, "password blank").when(F.col("_user").isNull(), "mismatch").otherwise("ok")
    return tries.join(known, ["userId", "password"], "left").withColumn("outcome", outcome).drop("_user")
