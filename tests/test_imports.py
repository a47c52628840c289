"""Imports, sync, search and files as the store has them: cases that once went wrong."""

import csv
import random
import re
import unicodedata

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import image as I
from plumbline.functions import text as X
from plumbline.operators import masters as M
from plumbline.operators import match as Y
from plumbline.operators import sessions, sync
from plumbline.sources import readers, sinks


def test_label_import_normalises(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text("﻿製品番号\nａ１\nb2é\n鉄\n\n CODE \n", encoding="utf-8")
    assert sorted(r.code for r in readers.label_csv(spark, str(path)).collect()) == ["A1", "B2"]


def test_csv_ids_count_blank_records(spark, tmp_path):
    path = tmp_path / "sites.csv"
    path.write_text('name,code\r\nOne,C1\r\n\r\n"Two\r\nlines",C2\r\nshort\r\n', encoding="utf-8")
    assert [(r.id, r.name, r.code) for r in readers.construction_csv(spark, str(path)).orderBy("id").collect()] == [(1, "One", "C1"), (3, "Two\r\nlines", "C2")]


def test_json_array_reads_what_was_written(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i == 2 else f"n{i}") for i in range(5)], "id long, name string").repartition(3)
    sinks.write_json(rows, str(tmp_path / "j"))
    assert sorted((r.id, r.name) for r in readers.json_array(spark, str(tmp_path / "j"), "id long, name string").collect()) == sorted((r.id, r.name) for r in rows.collect())
    sinks.write_json(rows.limit(0), str(tmp_path / "none"))
    assert readers.json_array(spark, str(tmp_path / "none"), "id long, name string").count() == 0


def test_json_defaults(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{not json", encoding="utf-8")
    assert readers.default_processes(spark, str(tmp_path / "bad.json")).count() == 17
    assert readers.default_constructions(spark, str(tmp_path / "missing.json")).count() == 2
    (tmp_path / "good.json").write_text('[\n {"id": 7, "name": "n", "code": "c", "isActive": true}\n]', encoding="utf-8")
    assert [r.id for r in readers.default_constructions(spark, str(tmp_path / "good.json")).collect()] == [7]


def test_csv_written_with_mark_and_line_ends(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([('a "quoted", cell',)], "`製品番号` string").coalesce(1), str(tmp_path / "c"))
    raw = next(p for p in (tmp_path / "c").iterdir() if p.name.startswith("part-")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and b"\r\n" in raw
    assert list(csv.reader(raw.decode("utf-8-sig").splitlines())) == [["製品番号"], ['a "quoted", cell']]


def test_search_folds_ascii_only(spark):
    df = spark.createDataFrame([("A工区",), ("a工区",), ("b\\c",), ("É",), ("é",)], "s string")
    found = lambda typed: sorted(r.s for r in df.where(X.contains_like(F.col("s"), typed)).collect())
    assert found("A工区") == ["A工区", "a工区"] and found("B\\C") == ["b\\c"] and found("É") == ["É"] and len(found(" ")) == 5


def test_sync_keeps_and_stores_messages(spark):
    parents = spark.createDataFrame([(1, "FAILED", 1, "old", None), (2, "FAILED", 2, "old", 5), (3, "PENDING", 0, None, None), (4, "FAILED", 3, "old", None)], "id long, syncStatus string, retryCount int, errorMessage string, syncedAt long")
    items = spark.createDataFrame([(1,), (2,), (3,)], "registrationId long")
    outcomes = spark.createDataFrame([(1, True, None), (2, False, "HTTP 500"), (3, False, None)], "id long, ok boolean, message string")
    got = {r.id: (r.syncStatus, r.retryCount, r.errorMessage, r.syncedAt) for r in sync.step(parents, items, outcomes, 9).collect()}
    assert got == {1: ("SYNCED", 1, "old", 9), 2: ("FAILED", 3, "HTTP 500", None), 3: ("FAILED", 1, "Unknown Exception", None), 4: ("FAILED", 3, "old", None)}


def test_insert_with_items(spark):
    parents = spark.createDataFrame([("b", "u2"), ("a", "u1")], "key string, userId string")
    items = spark.createDataFrame([("a", f"PROD-TEST-A{i}", i) for i in range(3)], "key string, productCode string, displayOrder int")
    p, i = M.with_items(parents, items, 11)
    assert sorted((r.id, r.userId) for r in p.collect()) == [(11, "u1"), (12, "u2")]
    assert [(r.registrationId, r.displayOrder) for r in i.orderBy("displayOrder").collect()] == [(11, 0), (11, 1), (11, 2)]


def test_ordinals_of_ties_and_empty(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"))
    got = [(r.k, r.n) for r in M.with_ordinal(rows, ["k"], "n", 5).orderBy("n").collect()]
    assert [n for _, n in got] == list(range(5, 1005)) and [k for k, _ in got] == sorted(k for k, _ in got)
    assert M.with_ordinal(rows.limit(0), ["k"], "n").count() == 0


def test_matches_settled_by_the_index_equal_the_wider_search(spark):
    labels = Y.indexed(spark.createDataFrame([(f"AB-{i:03d}",) for i in range(60)] + [("ZX-100",), ("ZX-10",), ("QQQQ-1",)], "code string"))
    texts = spark.createDataFrame([("AB-01O",), ("AB-999",), ("ZX-1OO",), ("QQQ-1",), ("XX-010",), ("AB",), ("TOTALLY-OTHER",)], "text string")
    wide = Y.ranked(Y.candidates(texts, labels)).where("rank <= 3")
    got = {(r.text, r["rank"], r.code, r.distance) for r in Y.top(texts, labels).collect()}
    assert got == {(r.text, r["rank"], r.code, r.distance) for r in wide.collect()} and got


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_labels_within_a_radius(spark, radius, monkeypatch):
    """Labels alike at the front, short ones and an empty one, against all pairs."""
    monkeypatch.setattr(Y, "_LENGTHS", 4096 if radius == 2 else 0)
    rnd = random.Random(radius)
    tail = lambda n: "".join(rnd.choice("ABC12") for _ in range(rnd.randrange(n)))
    labels = sorted({f"BRAND#{tail(6)}" for _ in range(60)} | {tail(5) for _ in range(30)} | {"", "A", "-"} | {tail(40) for _ in range(20)})
    texts = sorted({f"BRAND#{tail(6)}" for _ in range(30)} | {tail(8) for _ in range(40)} | {x[:9] + tail(3) for x in labels if len(x) > 12} | {"A---", "----", "B  1"})
    form = lambda c: c.replace("-", "").replace(" ", "")
    l = spark.createDataFrame([(c, i, form(c)) for i, c in enumerate(labels)], "code string, label_index int, label string")
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    v = t.where("length(text) >= 4").withColumn("form", X.match_form(F.col("text"))).withColumn("v", F.explode(X.variants(F.col("form"))))
    every = v.crossJoin(l).withColumn("d", F.levenshtein("v", "label")).where(f"d <= {radius}").groupBy("text", "code").agg(F.min("d").alias("d"))
    want = {(r.text, r.code): r.d for r in every.collect()}
    assert {(r.text, r.code): r.distance for r in Y.candidates(t, l, radius).collect()} == want and want
    # no cut falls into the front that all labels of a length share, while the rest has enough characters
    same = l.where("label LIKE 'BRAND#____'")
    assert all(s == 0 or s > 6 for s in Y.cuts(same, 3).first().starts) if same.count() > 5 else True


def test_corner_order_and_crop(spark):
    df = spark.createDataFrame([([10.0, 10.0, 0.0, 0.0, 10.0, 1.0, 0.0, 9.0],)], "p array<double>")
    w, h = G.crop_size(G.corner_order(F.col("p")))
    r = df.select(G.corner_order(F.col("p")).alias("p"), w.alias("w"), h.alias("h")).first()
    assert r.p == [0.0, 0.0, 10.0, 1.0, 10.0, 10.0, 0.0, 9.0] and (r.w, r.h) == (10, 9)


@pytest.mark.parametrize(("rgb", "want"), [((255, 0, 0), (0.0, 1.0, 1.0)), ((0, 255, 0), (120.0, 1.0, 1.0)), ((0, 0, 255), (240.0, 1.0, 1.0)), ((128, 128, 128), (0.0, 0.0, 128 / 255)), ((255, 0, 255), (300.0, 1.0, 1.0))])
def test_hsv(spark, rgb, want):
    h, s, v = I.hsv(*(F.lit(float(x)) for x in rgb))
    r = spark.range(1).select(h.alias("h"), s.alias("s"), v.alias("v")).first()
    assert (r.h, r.s, r.v) == want


def test_zipped_lists_fill_up(spark):
    df = spark.createDataFrame([(["A", "B", "C"], ["a", None], ["x.jpg"])], "codes array<string>, raws array<string>, crops array<string>")
    z = X.zipped(F.col("codes"), raw=(F.col("raws"), None), crop=(F.col("crops"), F.lit("")))
    assert [tuple(x) for x in df.select(z.alias("z")).first().z] == [("A", "a", "x.jpg"), ("B", "B", ""), ("C", "C", "")]


def test_one_hot_user_over_many_ranges(spark, many_ranges):
    rnd = random.Random(11)
    rows, s = [], 0
    for k in range(3000):
        s += rnd.choice([0, 60, 3600, 3 * 3600, 3 * 3600 + 1])
        rows.append((1, s, k))
    rows += [(u, rnd.randrange(10**6), 10_000 + 10 * u + k) for u in range(2, 30) for k in range(rnd.randrange(1, 8))] + [(None, 5, 20_000), (None, 6, 20_001)]
    events = spark.createDataFrame(rows, "user_id long, s long, event_id long").select("user_id", F.timestamp_seconds("s").alias("ts"), "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    plain = events.withColumn("n", F.coalesce((F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 3 HOURS")).cast("int"), F.lit(1))).withColumn("session", F.sum("n").over(w)).collect()
    want = {r.event_id: r.session for r in plain}
    got = sessions.sessions(events)
    assert {r.event_id: r.session for r in got.collect()} == want and got.columns == ["user_id", "ts", "event_id", "session"]
    hot = sessions._ranged(events, "user_id", "ts", "event_id").where("user_id = 1").select("_range").distinct().count()
    assert hot > 1  # the hot user fills several tasks


@pytest.mark.parametrize("gap", [1, 40, 150, 5000])
def test_throttling_over_many_ranges(spark, many_ranges, gap):
    rnd = random.Random(gap)
    rows, t = [], 0
    for k in range(2500):
        t += rnd.choice([0, 0, 1, 20, 33, 149, 150, 151])
        rows.append((1, t, k))
    rows += [(2, x, 5000 + x) for x in range(0, 900, 30)] + [(None, x, 9000 + x) for x in range(0, 400, 100)]
    last, want = {}, set()
    for stream, at, frame in sorted(rows, key=lambda r: (r[0] or 0, r[1], r[2])):
        if stream not in last or at - last[stream] >= gap:
            last[stream] = at
            want.add((stream, at, frame))
    frames = spark.createDataFrame([*rows, (1, None, 1)], "stream long, ts_ms long, frame_id long")
    assert {tuple(r) for r in sessions.throttled(frames, gap).collect()} == want
    big = frames.withColumn("frame_id", F.col("frame_id") + (1 << 60))
    assert {(r.stream, r.ts_ms, r.frame_id - (1 << 60)) for r in sessions.throttled(big, gap).collect()} == want
    assert sessions.throttled(frames.limit(0), gap).count() == 0


def test_normalising_mixes_ascii_and_others(spark):
    cells = ["  ab-1 ", "ａ１", "e\u0301x", "²", None, "", "ﬁ\u3000z", "\u3000ＡＢ　", "plain"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    want = [None if c is None else "".join(x for x in unicodedata.normalize("NFKC", c).upper().strip() if " " <= x <= "~") for c in cells]
    assert [r[0] for r in df.select(X.server_normalized(F.col("c"))).collect()] == want


def test_requests_and_answers(spark):
    df = spark.createDataFrame([('{"process_id": 3, "division": "d", "worker_id": "x", "product_numbers": ["A", null]}',), ("nonsense",), ("{}",), (None,)], "j string")
    first, *rest = [r[0] for r in df.select(X.read_request(F.col("j"))).collect()]
    assert (first.process_id, first.division, first.worker_id, first.product_numbers, first.construction_name) == (3, "d", None, ["A", None], None)
    assert rest[2] is None and all(v is None for r in rest[:2] for v in r)
    answers = spark.createDataFrame([(200, '{"success": true, "message": "fine"}'), (200, '{"success": false, "message": "no"}'), (503, None), (500, '{"success": true}'), (201, "[]")], "s int, b string")
    ok, message = X.send_outcome(F.col("s"), F.col("b"))
    assert [tuple(r) for r in answers.select(ok, message).collect()] == [(True, None), (False, "no"), (False, "HTTP 503"), (False, "HTTP 500"), (False, "HTTP 201")]


def test_import_rows_and_seeds(spark):
    sites, steps = readers.seeded(spark)
    assert (sites.count(), steps.count()) == (3, 9) and M.orphans(steps, sites, "constructionId").count() == 0
    new = spark.createDataFrame([(1, "n", "CONST-001", True), (2, "m", "X", True)], sites.schema)
    assert sorted(r.code for r in M.import_rows(sites, new, ["code"], "replace").collect()) == ["CONST-001", "X"]
    assert sorted(r.code for r in M.import_rows(sites, new, ["code"], "diff").collect()) == ["CONST-001", "CONST-002", "CONST-003", "X"]
    kept = readers.seeded(spark, new)
    assert kept[0] is new and kept[1].count() == 9


def test_csv_with_one_header(spark, tmp_path):
    rows = spark.range(100).repartitionByRange(3, "id").select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("code"))
    sinks.write_csv(rows, f"{tmp_path}/out", one_header=True)
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))).decode("utf-8-sig")
    assert whole == "code\r\n" + "".join(f"c{i:02d}\r\n" for i in range(100))


def test_time_of_receipt(spark):
    posted = spark.createDataFrame([(1, 5, ["A", "B"])], "id long, at long, codes array<string>")
    got = M.ingested(posted).collect()
    assert len({r.received_at for r in got}) == 1 and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}", got[0].received_at)
