"""Queries on master data, sync and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import masters as M
from ..operators import sessions as S
from ..operators import sync as Y
from ..operators.history import ordered_codes
from ..sources import standins as T
from .registry import query

# ---- label imports: some labels are there, some under another size; the file has headers, blanks, small, wide and foreign letters ----
_ASCII = "".join(chr(i) for i in range(0x21, 0x7F))
_WIDE = "".join(chr(i + 0xFEE0) for i in range(0x21, 0x7F))
_CODE = "upper(p_brand) || '-' || p_size"
_EXISTING = f"existing AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN {_CODE} ELSE {_CODE} || '-OLD' END AS code FROM part)"
_Q = lambda x: x.replace("'", "''")
_INCOMING = f"""incoming AS (SELECT p_partkey AS ord, CASE p_partkey % 9 WHEN 0 THEN '製品番号' WHEN 1 THEN ' Code ' WHEN 2 THEN ' ' WHEN 3 THEN translate({_CODE}, '{_Q(_ASCII)}', '{_WIDE}') WHEN 4 THEN lower({_CODE})
    WHEN 5 THEN {_CODE} || 'é' WHEN 6 THEN '鉄' ELSE ' ' || {_CODE} || ' ' END AS cell FROM part)"""
_LINES = f"f AS (SELECT * FROM (SELECT ord, regexp_replace(trim(upper(translate(cell, '{_WIDE}', '{_Q(_ASCII)}'))), '[^\\x20-\\x7E]', '', 'g') AS code FROM incoming WHERE trim(cell) <> '' AND trim(cell) <> '製品番号' AND lower(trim(cell)) <> 'code') WHERE code <> '')"


def _labels(spark, d):
    p = T.read(spark, d, "part")
    code = F.concat(F.upper("p_brand"), F.lit("-"), F.col("p_size").cast("string"))
    k = F.col("p_partkey") % 9
    cell = F.when(k == 0, "製品番号").when(k == 1, " Code ").when(k == 2, " ").when(k == 3, F.translate(code, _ASCII, _WIDE)).when(k == 4, F.lower(code))
    cell = cell.when(k == 5, F.concat(code, F.lit("é"))).when(k == 6, "鉄").otherwise(F.concat(F.lit(" "), code, F.lit(" ")))
    existing = p.select(F.when(F.col("p_partkey") % 2 == 0, code).otherwise(F.concat(code, F.lit("-OLD"))).alias("code")).distinct()
    return existing, M.label_lines(p.select(F.col("p_partkey").alias("ord"), cell.alias("cell")))


@query(f"WITH {_INCOMING}, {_LINES} SELECT DISTINCT code FROM f")
def label_import_replace(spark, d):
    return M.import_labels(*_labels(spark, d), "replace")[0]


@query(f"WITH {_EXISTING}, {_INCOMING}, {_LINES} SELECT code FROM existing UNION SELECT code FROM f")
def label_import_diff(spark, d):
    return M.import_labels(*_labels(spark, d), "diff")[0]


@query(f"WITH {_EXISTING}, {_INCOMING}, {_LINES} SELECT count(DISTINCT code) FILTER (WHERE code NOT IN (SELECT code FROM existing)) AS count, count(*) - count(DISTINCT code) FILTER (WHERE code NOT IN (SELECT code FROM existing)) AS skipped FROM f")
def label_import_counts(spark, d):
    return M.import_labels(*_labels(spark, d), "diff")[1]


@query(
    f"{T.with_('constructions')}, i AS (SELECT n_nationkey::BIGINT + 1 AS id, n_name AS name, 'C' || (n_nationkey % 9) AS code, true AS isActive FROM nation) SELECT * FROM constructions UNION ALL SELECT * FROM i WHERE code NOT IN (SELECT code FROM constructions)"
)
def construction_import_diff(spark, d):
    n = T.read(spark, d, "nation")
    k = F.col("n_nationkey")
    incoming = n.select((k.cast("long") + 1).alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("C"), (k % 9).cast("string")).alias("code"), F.lit(True).alias("isActive"))
    return M.import_diff(T.constructions(spark, d), incoming, ["code"])


_CELLS = "SELECT p_partkey AS ord, CASE p_partkey % 6 WHEN 0 THEN 'x' || p_size WHEN 1 THEN ' ' || (p_size % 5) || ' ' WHEN 2 THEN '3.7' WHEN 3 THEN '' ELSE (p_size % 5)::VARCHAR END AS c0, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_type END AS c1, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE ' P' || (p_size % 30) END AS c2 FROM part"
_PROC = f"(SELECT ord AS id, CASE WHEN regexp_full_match(trim(c0), '[+-]?[0-9]+') THEN trim(c0)::BIGINT ELSE 1 END AS constructionId, trim(c1) AS name, trim(c2) AS code FROM ({_CELLS}) WHERE trim(c1) <> '' AND trim(c2) <> '')"


def _cells(spark, d):
    p = T.read(spark, d, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    five = (size % 5).cast("string")
    c0 = F.when(k % 6 == 0, F.concat(F.lit("x"), size.cast("string"))).when(k % 6 == 1, F.concat(F.lit(" "), five, F.lit(" "))).when(k % 6 == 2, "3.7").when(k % 6 == 3, "").otherwise(five)
    return p.select(k.alias("ord"), c0.alias("c0"), F.when(k % 7 == 0, " ").otherwise(F.col("p_type")).alias("c1"), F.when(k % 10 == 0, "").otherwise(F.concat(F.lit(" P"), (size % 30).cast("string"))).alias("c2"))


@query(f"SELECT * FROM {_PROC}")
def process_import_parse(spark, d):
    return M.process_lines(_cells(spark, d))


@query(f"{T.with_('processes')} SELECT id, constructionId, name, code, isActive FROM processes UNION ALL SELECT *, true FROM {_PROC} p WHERE (constructionId, code) NOT IN (SELECT (constructionId, code) FROM processes)")
def process_import_diff(spark, d):
    return M.import_diff(T.processes(spark, d), M.process_lines(_cells(spark, d)).withColumn("isActive", F.lit(True)), ["constructionId", "code"])


@query(f"SELECT *, true AS \"isActive\" FROM {_PROC}")
def process_import_replace(spark, d):
    return M.import_rows(T.processes(spark, d), M.process_lines(_cells(spark, d)).withColumn("isActive", F.lit(True)), ["constructionId", "code"], "replace")


_SOURCE = lambda name, over: f"SELECT '{name}' AS store, code FROM (SELECT p_type AS code FROM part WHERE p_size > {over} UNION ALL SELECT code FROM b WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size > {over}))"


@query(f"WITH b AS (SELECT DISTINCT p_brand AS code FROM part) {_SOURCE('empty', 1000)} UNION ALL {_SOURCE('filled', 20)}")
def label_source_fallback(spark, d):
    """Labels of a store that holds none, and of one that holds some."""
    p = T.read(spark, d, "part")
    bundled = p.select(F.col("p_brand").alias("code")).distinct()
    of = lambda name, over: M.with_fallback(p.where(f"p_size > {over}").select(F.col("p_type").alias("code")), bundled).select(F.lit(name).alias("store"), "code")
    return of("empty", 1000).unionByName(of("filled", 20))


@query(
    f"""{T.with_('registrations', 'items')}, p AS (SELECT registrationId AS id, list(productCode ORDER BY displayOrder, productCode, price) AS codes FROM items GROUP BY 1),
    e AS (SELECT r.id, registeredAt AS at_ms, unnest(codes) AS code, generate_subscripts(codes, 1) - 1 AS pos FROM registrations r JOIN p USING (id))
    SELECT id, code, pos::INT AS pos, 100 + row_number() OVER (ORDER BY at_ms, id, pos) AS row_id FROM e"""
)
def ingest_explode(spark, d):
    codes = ordered_codes(T.items(spark, d)).withColumnRenamed("registrationId", "id")
    posted = T.registrations(spark, d).join(codes, "id").select("id", F.col("registeredAt").alias("at"), "codes")
    return M.exploded(posted, 100).select("id", "code", "pos", "row_id")


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def bulk_delete(spark, d):
    gone = T.read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return M.delete_where(T.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")), "id", gone)


@query(f"{T.with_('items')} SELECT registrationId, productCode, displayOrder FROM items WHERE registrationId IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def cascade_delete(spark, d):
    left = T.read(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"))
    return M.cascade(T.items(spark, d), left, "registrationId").select("registrationId", "productCode", "displayOrder")


_NEW = "SELECT o_orderkey + 5000 AS id, o_totalprice AS price FROM orders"


@query(f"WITH n AS ({_NEW}) SELECT * FROM n UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT id FROM n)")
def upsert_replace(spark, d):
    old = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return M.upsert(old, old.withColumn("id", F.col("id") + 5000), "id")


_STEP = f"""{T.with_('registrations', 'items')}, n AS (SELECT registrationId AS id, count(*) AS n FROM items GROUP BY 1),
x AS (SELECT r.*, n, syncStatus IN ('PENDING', 'FAILED') AND retryCount < 3 AS due, (n IS NULL OR r.id % 4 <> 0) AS good FROM registrations r LEFT JOIN n USING (id)),
y AS (SELECT id, CASE WHEN due AND good THEN 'SYNCED' WHEN due THEN 'FAILED' ELSE syncStatus END AS syncStatus, CASE WHEN due AND good THEN 1700000000000 WHEN due THEN NULL ELSE syncedAt END AS syncedAt,
  CASE WHEN due AND NOT good THEN retryCount + 1 ELSE retryCount END AS retryCount, CASE WHEN due AND NOT good THEN 'HTTP ' || (500 + id % 3) ELSE errorMessage END AS errorMessage, CASE WHEN due AND good THEN coalesce(n, 0) ELSE 0 END AS sent, n, due FROM x)"""


def _step(spark, d):
    parents, items = T.registrations(spark, d), T.items(spark, d)
    return Y.step(parents, items, parents.select("id", (F.col("id") % 4 != 0).alias("ok"), F.concat(F.lit("HTTP "), (F.col("id") % 3 + 500).cast("string")).alias("message")), 1700000000000)


_COLS = "id, syncStatus, syncedAt, retryCount, errorMessage, sent"


@query(f"{_STEP} SELECT {_COLS} FROM y")
def sync_step(spark, d):
    return _step(spark, d).select(*_COLS.split(", "))


@query(f"{_STEP} SELECT retryCount, count(*) AS n FROM y WHERE syncStatus = 'FAILED' GROUP BY 1")
def sync_retry_increment(spark, d):
    return _step(spark, d).where("syncStatus = 'FAILED'").groupBy("retryCount").agg(F.count("*").alias("n"))


@query(f"{_STEP} SELECT id, syncStatus, sent FROM y WHERE n IS NULL")
def sync_empty_parent(spark, d):
    parents_of_none = M.orphans(T.registrations(spark, d).select("id"), T.items(spark, d), "id", "registrationId")
    return _step(spark, d).join(parents_of_none, "id", "left_semi").select("id", "syncStatus", "sent")


@query(f"{_STEP} SELECT sum(sent)::BIGINT AS sent, count(*) FILTER (WHERE sent > 0) AS parents FROM y")
def sync_sent_total(spark, d):
    return _step(spark, d).agg(F.sum("sent").alias("sent"), F.count_if(F.col("sent") > 0).alias("parents"))


@query("SELECT p.n_nationkey::BIGINT AS id, p.n_regionkey::BIGINT AS constructionId FROM nation p WHERE p.n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey <> 3)")
def master_refresh_fk_check(spark, d):
    """Processes that a refresh without site 3 would orphan; any such row refuses the refresh."""
    sites = T.constructions(spark, d).where("id <> 3")
    return M.orphans(T.processes(spark, d), sites, "constructionId").select("id", "constructionId")


@query(
    f"{T.with_('registrations')}, f AS (SELECT id, 'L-' || id AS productCode, registeredAt FROM registrations) SELECT 'parent' AS kind, id, NULL::VARCHAR AS productCode, NULL::INT AS displayOrder, registeredAt FROM f UNION ALL SELECT 'item', id, productCode, 0, registeredAt FROM f"
)
def schema_split_migration(spark, d):
    flat = T.registrations(spark, d).select("id", F.concat(F.lit("L-"), F.col("id").cast("string")).alias("productCode"), "registeredAt")
    parents, items = M.split_flat(flat)
    a = parents.select(F.lit("parent").alias("kind"), "id", F.lit(None).cast("string").alias("productCode"), F.lit(None).cast("int").alias("displayOrder"), "registeredAt")
    return a.unionByName(items.select(F.lit("item").alias("kind"), F.col("registrationId").alias("id"), "productCode", "displayOrder", "registeredAt"))


_GAP = "g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 3 HOURS, true)::INT AS new FROM events), s AS (SELECT event_id, user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM g)"


@query(f"WITH {_GAP} SELECT event_id, user_id, session FROM s")
def session_timeout(spark, d):
    return S.sessions(T.read(spark, d, "events")).select("event_id", "user_id", "session")


@query(f"WITH {_GAP} SELECT user_id, session, count(*) AS n, min((epoch_us(ts) // 1000)) AS first_ms, max((epoch_us(ts) // 1000)) AS last_ms FROM s GROUP BY ALL")
def session_window_counts(spark, d):
    s = S.sessions(T.read(spark, d, "events")).withColumn("ms", T.millis("ts"))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


_FRAMES = "f AS (SELECT user_id AS stream, (epoch_us(ts) // 1000) AS ts_ms, event_id AS frame_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


@query(
    f"""WITH RECURSIVE {_FRAMES}, w AS (SELECT stream, ts_ms, frame_id, k, ts_ms AS last, true AS taken FROM f WHERE k = 1 UNION ALL
    SELECT f.stream, f.ts_ms, f.frame_id, f.k, CASE WHEN f.ts_ms - w.last >= 7200000 THEN f.ts_ms ELSE w.last END, f.ts_ms - w.last >= 7200000 FROM w JOIN f ON f.stream = w.stream AND f.k = w.k + 1)
    SELECT stream, ts_ms, frame_id FROM w WHERE taken"""
)
def frame_throttle(spark, d):
    e = T.read(spark, d, "events").select(F.col("user_id").alias("stream"), T.millis("ts").alias("ts_ms"), F.col("event_id").alias("frame_id"))
    return S.throttled(e, 7200000)
