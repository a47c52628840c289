"""Sync as pure state transitions over tables of parents and items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .history import eligible


def step(parents: DataFrame, items: DataFrame, outcomes: DataFrame, now: int) -> DataFrame:
    """Parents after one sync, with ``sent``: the items that went out with each.

    ``outcomes`` (id, ok, message) says how sending went. Eligible parents without items become
    SYNCED and count nothing; others become SYNCED on success, which leaves an old message
    in place; on failure they become FAILED with one more retry and the outcome's message.
    Other parents stay as they are.
    """
    n = items.groupBy(F.col("registrationId").alias("id")).agg(F.count("*").alias("_n"))
    p = parents.join(n, "id", "left").join(outcomes, "id", "left")
    due = eligible(F.col("syncStatus"), F.col("retryCount"))
    done = due & (F.col("_n").isNull() | F.coalesce("ok", F.lit(False)))
    failed = due & ~done
    return p.withColumns(
        {
            "sent": F.when(done, F.coalesce("_n", F.lit(0))).otherwise(0).cast("long"),
            "syncStatus": F.when(done, "SYNCED").when(failed, "FAILED").otherwise(F.col("syncStatus")),
            "syncedAt": F.when(done, F.lit(now)).when(failed, F.lit(None)).otherwise(F.col("syncedAt")),
            "retryCount": F.when(failed, F.col("retryCount") + 1).otherwise(F.col("retryCount")),
            "errorMessage": F.when(failed, F.coalesce("message", F.lit("Unknown Exception"))).otherwise(F.col("errorMessage")),
        }
    ).drop("_n", "ok", "message")
