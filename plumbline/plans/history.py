"""Queries over the registration store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CONFIDENCE_AMBER, CONFIDENCE_GREEN, NO_VALUE, REFRESH_MS, UNSET
from ..functions.text import location, worker_number
from ..operators import history as H
from ..sources import standins as T
from .registry import query

_FLAT = "i.productCode, " + ", ".join(f"r.{c}" for c in H.FLAT if c != "productCode")
_JOIN = "items i JOIN registrations r ON i.registrationId = r.id"
_RI = T.with_("registrations", "items")


def _flat(spark, d):
    return H.flat(T.registrations(spark, d), T.items(spark, d))


@query(f"{_RI} SELECT {_FLAT} FROM {_JOIN} ORDER BY registeredAt DESC")
def registration_history(spark, d):
    return H.newest_first(_flat(spark, d))


@query(f"{_RI} SELECT {_FLAT} FROM {_JOIN} WHERE syncStatus = 'FAILED'")
def history_by_status(spark, d):
    return H.newest_first(_flat(spark, d).where(F.col("syncStatus") == "FAILED"))


@query(f"{_RI} SELECT {_FLAT} FROM {_JOIN} WHERE syncStatus IN ('PENDING', 'FAILED', 'SYNCING')")
def unsynced_registrations(spark, d):
    return H.newest_first(_flat(spark, d).where(H.unsynced(F.col("syncStatus"))))


@query(f"{_RI} SELECT count(*) AS n FROM {_JOIN} WHERE syncStatus IN ('PENDING', 'FAILED', 'SYNCING')")
def unsynced_item_count(spark, d):
    return _flat(spark, d).where(H.unsynced(F.col("syncStatus"))).agg(F.count("*").alias("n"))


@query(f"{T.with_('registrations')} SELECT id, syncStatus, retryCount, registeredAt FROM registrations WHERE syncStatus IN ('PENDING', 'FAILED') AND retryCount < 3")
def send_eligible_registrations(spark, d):
    r = T.registrations(spark, d).where(H.eligible(F.col("syncStatus"), F.col("retryCount")))
    return r.select("id", "syncStatus", "retryCount", "registeredAt").orderBy("registeredAt", "id")


@query(f"{T.with_('registrations')} SELECT id, syncStatus, retryCount FROM registrations WHERE syncStatus IN ('PENDING', 'FAILED', 'SYNCING') AND NOT (syncStatus IN ('PENDING', 'FAILED') AND retryCount < 3)")
def dead_letter_registrations(spark, d):
    s, n = F.col("syncStatus"), F.col("retryCount")
    return T.registrations(spark, d).where(H.unsynced(s) & ~H.eligible(s, n)).select("id", "syncStatus", "retryCount")


@query(f"{_RI} SELECT {_FLAT} FROM {_JOIN} WHERE productCode ILIKE '%rand#1_-4%' OR constructionName ILIKE '%rand#1_-4%'")
def history_search(spark, d):
    return H.newest_first(H.search(_flat(spark, d), " rAnd#1_-4 "))


@query(f"{T.with_('constructions')} SELECT id, name, code FROM constructions WHERE isActive ORDER BY name")
def active_constructions(spark, d):
    return T.constructions(spark, d).where("isActive").orderBy("name").select("id", "name", "code")


@query(f"{T.with_('processes')} SELECT id, name, code FROM processes WHERE isActive AND constructionId = 1 ORDER BY name")
def processes_for_construction(spark, d):
    return T.processes(spark, d).where(F.col("isActive") & (F.col("constructionId") == 1)).orderBy("name").select("id", "name", "code")


_IDS = "ids AS (SELECT c.name AS constructionName, p.name AS processName, min(p.id) AS processId FROM processes p JOIN constructions c ON p.constructionId = c.id GROUP BY ALL)"


@query(f"{T.with_('constructions', 'processes')}, {_IDS} SELECT * FROM ids")
def process_id_by_name(spark, d):
    return H.process_ids(T.processes(spark, d), T.constructions(spark, d))


@query(
    f"{T.with_('constructions', 'processes', 'registrations')}, {_IDS} SELECT r.id, coalesce(processId, 1) AS processId, r.userId::INT AS workerId FROM "
    "(SELECT * REPLACE (CASE WHEN id % 11 = 0 THEN 'gone' ELSE processName END AS processName) FROM registrations) r LEFT JOIN ids USING (constructionName, processName)"
)
def process_id_with_fallback(spark, d):
    ids = H.process_ids(T.processes(spark, d), T.constructions(spark, d))
    r = T.registrations(spark, d).withColumn("processName", F.when(F.col("id") % 11 == 0, "gone").otherwise(F.col("processName")))
    return r.join(ids, ["constructionName", "processName"], "left").select("id", F.coalesce("processId", F.lit(1)).alias("processId"), worker_number(F.col("userId")).alias("workerId"))


@query(f"{T.with_('product_labels')} SELECT count(*) AS n FROM product_labels")
def label_count(spark, d):
    return T.product_labels(spark, d).agg(F.count("*").alias("n"))


@query(f"{T.with_('product_labels')} SELECT max(updatedAt) AS lastSynced FROM product_labels")
def label_last_synced(spark, d):
    return T.product_labels(spark, d).agg(F.max("updatedAt").alias("lastSynced"))


@query(f"{T.with_('product_labels')} SELECT now_ms, coalesce(now_ms - (SELECT max(updatedAt) FROM product_labels) >= 86400000, true) AS refresh FROM (SELECT DISTINCT epoch_ms(o_orderdate) % 200000000 AS now_ms FROM orders)")
def label_refresh_gate(spark, d):
    """Whether labels are fetched again at each of many moments."""
    last = T.product_labels(spark, d).agg(F.max("updatedAt").alias("last"))
    now = T.read(spark, d, "orders").select((T.millis("o_orderdate") % 200000000).alias("now_ms")).distinct()
    return now.join(F.broadcast(last)).select("now_ms", F.coalesce(F.col("now_ms") - F.col("last") >= REFRESH_MS, F.lit(True)).alias("refresh"))


@query(f"{T.with_('constructions')} SELECT coalesce(max(id), 0) + 1 AS next FROM constructions")
def next_construction_id(spark, d):
    return T.constructions(spark, d).agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next"))


@query(f"{T.with_('items')} SELECT registrationId, displayOrder, productCode, price FROM items WHERE registrationId <= 500 OR displayOrder = 1")
def items_by_registration(spark, d):
    return T.items(spark, d).where("registrationId <= 500 OR displayOrder = 1").select("registrationId", "displayOrder", "productCode", "price").orderBy("registrationId", "displayOrder", "productCode", "price")


@query(f"{T.with_('items')} SELECT registrationId, string_agg(productCode, ',' ORDER BY displayOrder, productCode, price) AS codes, count(*) AS n FROM items GROUP BY 1")
def items_payload_array(spark, d):
    return H.ordered_codes(T.items(spark, d)).select("registrationId", F.array_join("codes", ",").alias("codes"), F.size("codes").cast("long").alias("n"))


_USERS = "SELECT c_custkey AS id, c_name AS userId, 'pw-' || c_nationkey AS password, c_acctbal >= 0 AS isActive FROM customer"
_TRIES = "SELECT c_custkey AS try_id, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS userId, CASE WHEN c_custkey % 5 = 0 THEN ' ' WHEN c_custkey % 3 = 0 THEN 'no' ELSE 'pw-' || c_nationkey END AS password FROM customer"


def _users(spark, d):
    """Invented credentials and login attempts, one of each a customer."""
    c = T.read(spark, d, "customer")
    password = F.concat(F.lit("pw-"), F.col("c_nationkey").cast("string"))
    users = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("userId"), password.alias("password"), (F.col("c_acctbal") >= 0).alias("isActive"))
    k = F.col("c_custkey")
    tries = c.select(k.alias("try_id"), F.when(k % 7 == 0, "").otherwise(F.col("c_name")).alias("userId"), F.when(k % 5 == 0, " ").when(k % 3 == 0, "no").otherwise(password).alias("password"))
    return users, tries


@query(f"SELECT try_id, min(id) AS id FROM ({_TRIES}) t JOIN ({_USERS}) u USING (userId, password) WHERE isActive GROUP BY 1")
def authenticate_user(spark, d):
    users, tries = _users(spark, d)
    return tries.join(users.where("isActive"), ["userId", "password"]).groupBy("try_id").agg(F.min("id").alias("id"))


@query(
    f"SELECT try_id, CASE WHEN trim(t.userId) = '' AND trim(t.password) = '' THEN 'both blank' WHEN trim(t.userId) = '' THEN 'id blank' WHEN trim(t.password) = '' THEN 'password blank' WHEN u.id IS NULL THEN 'mismatch' ELSE 'ok' END AS outcome FROM ({_TRIES}) t LEFT JOIN (SELECT userId, password, min(id) AS id FROM ({_USERS}) WHERE isActive GROUP BY ALL) u USING (userId, password)"
)
def login_validation(spark, d):
    users, tries = _users(spark, d)
    return H.login_outcomes(tries, users).select("try_id", "outcome")


@query(f"{T.with_('registrations')} SELECT id, CASE syncStatus WHEN 'PENDING' THEN 'waiting' WHEN 'SYNCING' THEN 'sending' WHEN 'SYNCED' THEN 'sent' ELSE 'failed' END AS badge FROM registrations")
def status_badge(spark, d):
    s = F.col("syncStatus")
    return T.registrations(spark, d).select("id", F.when(s == "PENDING", "waiting").when(s == "SYNCING", "sending").when(s == "SYNCED", "sent").otherwise("failed").alias("badge"))


@query("SELECT vec_id, i - 1 AS pos, CASE WHEN abs(embedding[i])::FLOAT * 2 >= 0.6::FLOAT THEN 'green' WHEN abs(embedding[i])::FLOAT * 2 >= 0.3::FLOAT THEN 'amber' ELSE 'red' END AS band FROM embeddings, range(1, 9) t(i)")
def confidence_band(spark, d):
    e = T.read(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 8)).alias("pos", "x"))
    c = F.abs("x") * F.lit(2.0).cast("float")
    band = F.when(c >= F.lit(CONFIDENCE_GREEN).cast("float"), "green").when(c >= F.lit(CONFIDENCE_AMBER).cast("float"), "amber").otherwise("red")
    return e.select("vec_id", F.col("pos").cast("long").alias("pos"), band.alias("band"))


@query("SELECT event_id, CASE WHEN value < 100 THEN 'blurred' WHEN abs((value * 3) % 90) > 15 AND abs((value * 3) % 90) < 75 THEN 'tilted' ELSE 'none' END AS warning FROM events")
def quality_warning(spark, d):
    from ..functions.numeric import is_blurred, is_tilted

    e = T.read(spark, d, "events")
    return e.select("event_id", F.when(is_blurred(F.col("value")), "blurred").when(is_tilted(F.col("value") * 3), "tilted").otherwise("none").alias("warning"))


_SENT = "SELECT userId, count(*) AS n, count(*) FILTER (WHERE syncStatus = 'SYNCED') AS sent FROM registrations GROUP BY 1"


@query(f"{T.with_('registrations')} SELECT userId, CASE WHEN userId::BIGINT % 13 = 0 THEN 'offline' WHEN sent = n THEN 'all sent' WHEN sent > 0 THEN 'some sent' ELSE 'none sent' END AS outcome FROM ({_SENT})")
def registration_outcome(spark, d):
    by = T.registrations(spark, d).groupBy("userId").agg(F.count("*").alias("n"), F.count_if(F.col("syncStatus") == "SYNCED").alias("sent"))
    outcome = F.when(F.col("userId").cast("long") % 13 == 0, "offline").when(F.col("sent") == F.col("n"), "all sent").when(F.col("sent") > 0, "some sent").otherwise("none sent")
    return by.select("userId", outcome.alias("outcome"))


@query(f"{T.with_('registrations')} SELECT id, concat_ws(' / ', nullif(warehouseNo, ''), nullif(columnNo, ''), nullif(tierNo, '')) AS location FROM registrations")
def location_label(spark, d):
    return T.registrations(spark, d).select("id", location(*(F.col(c) for c in ("warehouseNo", "columnNo", "tierNo"))).alias("location"))


@query(
    f"""{_RI}, p AS (SELECT registrationId, string_agg(productCode, ', ' ORDER BY displayOrder, productCode, price) AS codes FROM items GROUP BY 1)
    SELECT id, coalesce(nullif(CASE WHEN id % 4 = 0 THEN '' ELSE constructionName END, ''), '{NO_VALUE}') AS construction, coalesce(nullif(CASE WHEN id % 6 = 0 THEN NULL ELSE processName END, ''), '{NO_VALUE}') AS process,
    codes, userId AS worker, replace(substring(strftime(make_timestamp(registeredAt * 1000), '%Y-%m-%dT%H:%M:%S.000'), 1, 19), 'T', ' ') AS received FROM registrations JOIN p ON registrationId = id"""
)
def registrations_csv_projection(spark, d):
    from ..sources.sinks import export_rows

    codes = H.ordered_codes(T.items(spark, d))
    r = T.registrations(spark, d).join(codes, F.col("registrationId") == F.col("id"))
    received = F.date_format(F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, registeredAt / 1000)"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return export_rows(
        r.select("id", F.when(F.col("id") % 4 == 0, "").otherwise(F.col("constructionName")).alias("construction_name"), F.when(F.col("id") % 6 != 0, F.col("processName")).alias("process_name"), F.col("codes").alias("product_numbers"), F.col("userId").alias("worker_id"), received.alias("received_at"))
    )
