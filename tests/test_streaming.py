import pytest
from pyspark.sql import functions as F

from plumbline.streaming import outbox, streams


def drained(query):
    query.processAllAvailable()
    query.stop()


def test_throttled_and_sessions(spark, tmp_path):
    frames = spark.createDataFrame([(1, t, t) for t in (0, 100, 150, 299, 300)], "stream long, ts_ms long, frame_id long")
    frames.write.parquet(f"{tmp_path}/frames")
    source = spark.readStream.schema(frames.schema).parquet(f"{tmp_path}/frames")
    drained(streams.throttled_frames(source).writeStream.format("memory").queryName("taken").outputMode("append").start())
    assert sorted(r.ts_ms for r in spark.table("taken").collect()) == [0, 150, 300]

    events = spark.createDataFrame([(1, 0), (1, 3 * 3600), (1, 6 * 3600 + 1), (1, 40 * 3600)], "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events")
    source = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    drained(streams.idle_sessions(source).writeStream.format("memory").queryName("closed").outputMode("append").start())
    assert sorted(r.n for r in spark.table("closed").collect()) == [1, 2]


def test_counts_and_sync(spark, tmp_path):
    rows = spark.createDataFrame([("PENDING",), ("PENDING",), ("SYNCED",)], "syncStatus string")
    rows.write.parquet(f"{tmp_path}/r")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/r")
    drained(streams.live_counts(source).writeStream.format("memory").queryName("counts").outputMode("complete").start())
    assert {r.syncStatus: r.n for r in spark.table("counts").collect()} == {"PENDING": 2, "SYNCED": 1}
    seen = []
    drained(streams.periodic(source, lambda df, n: seen.append((n, df.count())), f"{tmp_path}/cp", "1 second").start())
    assert (0, 3) in seen


def put(spark, folder, rows, schema):
    """One more file for a stream that reads a folder."""
    df = spark.createDataFrame(rows, schema)
    df.withColumn("at", F.timestamp_millis("at")).coalesce(1).write.mode("append").parquet(folder) if "at long" in schema else df.coalesce(1).write.mode("append").parquet(folder)


def stepwise(spark, folder, made, name, batches, schema):
    """What a stateful stream has put out after each of several micro-batches."""
    put(spark, folder, [], schema)
    source = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    query = made(source).writeStream.format("memory").queryName(name).outputMode("append").start()
    out, seen = [], 0
    for rows in batches:
        put(spark, folder, rows, schema)
        query.processAllAvailable()
        found = [tuple(r) for r in spark.table(name).collect()]
        out.append(sorted(found[seen:]))
        seen = len(found)
    query.stop()
    return out


def test_keep_latest_across_batches(spark, tmp_path):
    schema = "stream long, at long, kind string, frame_id long"
    batches = [
        [(1, 1000, "frame", 1), (1, 1010, "frame", 2), (1, 1020, "frame", 3), (2, 1000, "frame", 50)],
        [(1, 1100, "frame", 4), (1, 1200, "done", None)],  # 2 and 3 were dropped, one of them in the batch before
        [(1, 1300, "done", None), (1, 1400, "frame", 5)],
        [(3, 100_000, "frame", 9)],  # the watermark passes the time by which streams 1 and 2 should have been done
        [(2, 200_000, "frame", 51), (1, 200_001, "frame", 6)],
    ]
    batches = [[(s, t, k, -1 if f is None else f) for s, t, k, f in b] for b in batches]
    got = stepwise(spark, f"{tmp_path}/f", lambda s: streams.keep_latest(s, busy_ms=60_000), "latest", batches, schema)
    assert got == [[(1, 1, 1000), (2, 50, 1000)], [(1, 4, 1200)], [(1, 5, 1400)], [(3, 9, 100_000)], [(1, 6, 200_001), (2, 51, 200_000)]]


def test_retries_with_a_fixed_clock(spark, tmp_path):
    assert [streams.backoff_ms(n) for n in (1, 2, 3, 11, 12, 99)] == [10_000, 20_000, 40_000, 10_240_000, 18_000_000, 18_000_000]
    batches = [
        [("sync", 1, "start"), ("sync", 5, "start")],  # the second meets a live job
        [("sync", 1000, "failed"), ("sync", 1500, "start")],
        [("clock", 10_999, "done")],  # a millisecond early
        [("clock", 11_000, "done"), ("clock", 11_500, "done")],
        [("sync", 12_000, "failed")],
        [("clock", 31_999, "done")],
        [("clock", 32_001, "done")],
        [("sync", 33_000, "done"), ("sync", 34_000, "start")],
    ]
    got = stepwise(spark, f"{tmp_path}/r", streams.retries, "tries", batches, "name string, at long, kind string")
    assert got == [[("sync", 1, 1)], [], [], [("sync", 2, 11_000)], [], [], [("sync", 3, 32_000)], [("sync", 1, 34_000)]]


def registrations(rows):
    return [(i, "PENDING", 0, None, None, at, n, f"p{i}") for i, at, n in rows]


class Receiver:
    """A server that notes every call and, by key, what it has taken; ids in ``down`` fail."""

    def __init__(self, down=()):
        self.calls, self.taken, self.down, self.crash = [], {}, set(down), None

    def __call__(self, rows):
        out = []
        for r in rows.collect():
            self.calls.append(r.key)
            ok = r.id not in self.down
            if ok:
                self.taken.setdefault(r.key, r.payload)
            out.append((r.id, ok, None if ok else "HTTP 503"))
        if self.crash:
            raise RuntimeError(self.crash)
        return rows.sparkSession.createDataFrame(out, outbox.RECEIPT)


def test_outbox(spark, tmp_path):
    where, server = f"{tmp_path}/o", Receiver(down={3})
    box = outbox.Outbox(where, server, lambda: 77)
    frame = lambda rows: spark.createDataFrame(registrations(rows), outbox.OPEN)
    first = frame([(2, 20, 3), (1, 10, 2), (3, 30, 1), (4, 5, 0)])
    box(first, 0)
    assert server.calls == ["1-0", "2-0", "3-0"]  # oldest first; without items nothing is sent
    assert sorted(tuple(r) for r in outbox.done(spark, where).collect()) == [(1, 77, 2), (2, 77, 3), (4, 77, 0)]
    box(first, 0)  # the batch comes again
    assert len(server.calls) == 3
    # a crash after sending: nothing is committed, and the same keys go out again, to be taken once
    server.crash = "lost"
    with pytest.raises(RuntimeError, match="lost"):
        box(frame([(5, 50, 1), (3, 30, 1)]), 1)
    assert box.has(spark, "outbox", 1) and not box.has(spark, "receipts", 1)
    assert {r.syncStatus for r in box.table(spark, "outbox", 1, "syncStatus string").collect()} == {"SYNCING"}
    server.crash = None
    outbox.Outbox(where, server, lambda: 88)(frame([(5, 50, 1), (3, 30, 1)]), 1)
    assert server.calls[3:] == ["3-1", "5-0", "3-1", "5-0"] and set(server.taken) == {"1-0", "2-0", "5-0"}
    # a crash after the receipts: they are committed without sending
    keep = box.keep
    box.keep = lambda df, name, n: (_ for _ in ()).throw(RuntimeError("full")) if name == "done" else keep(df, name, n)
    with pytest.raises(RuntimeError, match="full"):
        box(frame([]), 2)
    n = len(server.calls)
    box.keep = keep
    box(frame([]), 2)
    assert len(server.calls) == n
    # three failures are enough
    box(frame([]), 3)
    assert [(r.id, r.syncStatus, r.retryCount, r.errorMessage) for r in box.table(spark, "open", 3, outbox.OPEN).collect()] == [(3, "FAILED", 3, "HTTP 503")]
    assert len(server.calls) == n


def test_outbox_as_a_stream(spark, tmp_path):
    server = Receiver()
    box = outbox.Outbox(f"{tmp_path}/o", server, lambda: 1)
    put(spark, f"{tmp_path}/in", registrations([(1, 1, 1), (2, 2, 2)]), outbox.OPEN)
    source = spark.readStream.schema(outbox.OPEN).parquet(f"{tmp_path}/in")
    for rows in ([], [(3, 3, 1)]):
        put(spark, f"{tmp_path}/in", registrations(rows), outbox.OPEN)
        drained(streams.periodic(source, box, f"{tmp_path}/cp", "1 second").start())
    assert server.calls == ["1-0", "2-0", "3-0"]
