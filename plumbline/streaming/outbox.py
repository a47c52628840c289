"""Sending registrations as they come, exactly once on our side: an outbox over Structured Streaming.

Every micro-batch writes three tables under its number, each of them complete or absent:

- ``outbox``: what is to be sent now, a row a registration, with a key of its own (its id and
  attempt) and the state SYNCING;
- ``receipts``: how sending each key went;
- ``open`` and ``done``: what is left to send and what is finished, after both.

A batch that comes again finds what it had written. With ``open`` written it does nothing; with
receipts it commits them; with an outbox alone it sends the same keys again. So a crash
between sending and committing leaves no registration in SYNCING for good, and a receiver
that keeps the keys it has seen takes no registration twice. Only open rows are carried from
batch to batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import eligible
from ..operators.sync import step

#: A registration on its way: payload is what is sent, items how many codes it holds.
OPEN = "id long, syncStatus string, retryCount int, errorMessage string, syncedAt long, registeredAt long, items long, payload string"
RECEIPT = "id long, ok boolean, message string"


class Outbox:
    """A function for foreachBatch over new registrations (columns of OPEN; the status and counts as they come).

    ``send`` takes the rows of an outbox (key, id, payload), oldest first, and returns a receipt (id,
    ok, message) for each; it may see a key again after a crash. ``now`` is the clock, in
    milliseconds.
    """

    def __init__(self, folder: str, send: Callable[[DataFrame], DataFrame], now: Callable[[], int]):
        self.folder, self.send, self.now = folder, send, now

    def path(self, name: str, batch: int) -> str:
        return f"{self.folder}/{name}/{batch:012d}"

    def has(self, spark: SparkSession, name: str, batch: int) -> bool:
        """Whether a table was written to its end."""
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name, batch) + "/_SUCCESS")
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def table(self, spark: SparkSession, name: str, batch: int, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(self.path(name, batch))

    def keep(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(self.path(name, batch))

    def before(self, new: DataFrame, batch: int) -> DataFrame:
        """Open rows of the last batch and new ones; a registration that is open already is not taken in again."""
        names = [c.split()[0] for c in OPEN.split(", ")]
        spark = new.sparkSession
        new = new.select(*names).dropDuplicates(["id"])
        if batch == 0:
            return new
        old = self.table(spark, "open", batch - 1, OPEN)
        return old.unionByName(new.join(old.select("id"), "id", "left_anti"))

    def __call__(self, new: DataFrame, batch: int) -> None:
        spark = new.sparkSession
        if self.has(spark, "open", batch):
            return
        rows = self.before(new, batch)
        if not self.has(spark, "outbox", batch):
            due = rows.where(eligible(F.col("syncStatus"), F.col("retryCount")))
            key = F.concat_ws("-", "id", "retryCount")
            self.keep(due.where("items > 0").select(key.alias("key"), "id", F.lit("SYNCING").alias("syncStatus"), "payload", "registeredAt"), "outbox", batch)
        if not self.has(spark, "receipts", batch):
            out = self.table(spark, "outbox", batch, "key string, id long, syncStatus string, payload string, registeredAt long")
            self.keep(self.send(out.orderBy("registeredAt", "id").select("key", "id", "payload")).select("id", "ok", "message"), "receipts", batch)
        receipts = self.table(spark, "receipts", batch, RECEIPT)
        counts = rows.where("items > 0").select(F.col("id").alias("registrationId"), F.explode(F.sequence(F.lit(1).cast("long"), "items")).alias("_n"))
        after = step(rows, counts, receipts, self.now())
        finished = F.col("syncStatus") == "SYNCED"
        self.keep(after.where(finished).select("id", "syncedAt", "sent"), "done", batch)
        # written last: the batch is committed with it
        self.keep(after.where(~finished).drop("sent"), "open", batch)


def done(spark: SparkSession, folder: str) -> DataFrame:
    """All finished registrations (id, syncedAt, sent) of committed batches and of one that is about to be."""
    return spark.read.schema("id long, syncedAt long, sent long").parquet(f"{folder}/done/*")
