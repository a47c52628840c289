"""Queries on the capture flow: the recognition chain, requests, master changes, overlays and crops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import image as I
from ..functions import numeric as N
from ..functions import text as X
from ..operators import masters as M
from ..operators import match as Y
from ..operators import regions as R
from ..operators.history import ordered_codes
from ..sources import standins as T
from .labels import _CHARS, _CLEAN, _FORM, _TRIM, _VARIANTS
from .registry import query
from .vision import _BOX, _E, _PS, _QUADS, _boxes, _e, _quads, _spread

# ---- recognition chain ----
_READ = f"""{T.with_('product_labels', 'recognised_texts')},
raw AS (SELECT text_id, (text_id % 100) / 100::DOUBLE AS confidence, CASE text_id % 6 WHEN 0 THEN '  Xa1 ' || text || ' ' WHEN 1 THEN '  ' WHEN 2 THEN text || '!' ELSE text END AS raw FROM recognised_texts),
dom AS (SELECT text_id, confidence, {_TRIM('raw')} AS raw, {_CLEAN('raw')} AS text FROM raw WHERE {_TRIM('raw')} <> ''),
l AS (SELECT code, row_number() OVER (ORDER BY code)::INT AS label_index, {_FORM('code')} AS label FROM product_labels),
t AS (SELECT DISTINCT text, {_FORM('text')} AS form FROM dom WHERE length(text) >= 4),
v AS (SELECT text, form, unnest({_VARIANTS('form')}) AS v FROM t),
c AS (SELECT text, code, label_index, min(levenshtein(v, label)) AS distance, bool_or(length(v) >= 2 AND length(label) >= 2 AND v[:2] = label[:2]) AS prefix, abs(length(any_value(form)) - length(any_value(label))) AS length_diff
      FROM v JOIN l ON abs(length(form) - length(label)) <= 3 GROUP BY ALL HAVING min(levenshtein(v, label)) <= 3),
p AS (SELECT *, bool_or(prefix) OVER (PARTITION BY text) AS any_prefix FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY distance, prefix DESC, length_diff, label_index) AS rank FROM p WHERE prefix OR NOT any_prefix),
best AS (SELECT text, arg_min(code, rank) AS code, min(distance)::INT AS distance, string_agg(code, '|' ORDER BY rank) AS candidates FROM r WHERE rank <= 3 GROUP BY text)"""


def _read(spark, d):
    k = F.col("text_id") % 6
    raw = F.when(k == 0, F.concat(F.lit("  Xa1 "), "text", F.lit(" "))).when(k == 1, "  ").when(k == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return T.recognised_texts(spark, d).select("text_id", ((F.col("text_id") % 100) / 100).alias("confidence"), raw.alias("raw"))


@query(
    f"""WITH {_READ.removeprefix('WITH ')} SELECT text_id, confidence, dom.raw AS raw_text, dom.text AS cleaned_code, length(dom.text) BETWEEN 2 AND 50 AND regexp_full_match(dom.text, '[{_CHARS}]+') AS is_valid, best.code AS matched_label,
    coalesce(distance, 2147483647) AS match_distance, coalesce(distance = 0, false) AS is_exact, coalesce(candidates, '') AS candidates, coalesce(best.code, dom.text) AS display_code FROM dom LEFT JOIN best ON best.text = dom.text"""
)
def recognition_chain(spark, d):
    """Each read text cleaned, validated and matched; blank ones are dropped."""
    return Y.resolved(_read(spark, d), Y.indexed(T.product_labels(spark, d)))


@query(f"WITH {_READ.removeprefix('WITH ')} SELECT CASE WHEN dom.text IS NULL THEN 'tracking' WHEN best.code IS NULL THEN 'unmatched' ELSE 'matched' END AS state, count(*) AS n FROM raw LEFT JOIN dom USING (text_id) LEFT JOIN best ON best.text = dom.text GROUP BY 1")
def overlay_state(spark, d):
    """What the overlay shows of each region: a label, a text without one, or a blank that is still tracked."""
    return Y.overlay_states(_read(spark, d), Y.indexed(T.product_labels(spark, d))).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS registrationId, l_linenumber AS displayOrder, l_partkey AS code, l_quantity > 10 AS selected, l_tax > 0.04 AS edited, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY ALL")
def selected_rows(spark, d):
    """Rows that the user left ticked, with whether they edited them."""
    li = T.read(spark, d, "lineitem").withColumns({"selected": F.col("l_quantity") > 10, "edited": F.col("l_tax") > 0.04})
    return li.where("selected").groupBy(F.col("l_orderkey").alias("registrationId"), F.col("l_linenumber").alias("displayOrder"), F.col("l_partkey").alias("code"), "selected", "edited").agg(F.count("*").alias("n"))


# ---- parallel lists and payloads ----
_CODES = f"{T.with_('registrations', 'items')}, p AS (SELECT registrationId AS id, list(productCode ORDER BY displayOrder, productCode, price) AS codes FROM items GROUP BY 1)"


@query(f"{_CODES}, z AS (SELECT id, codes, codes[:2] AS raws, unnest(range(1, len(codes) + 1)) AS i FROM p) SELECT id, i - 1 AS pos, codes[i] AS code, coalesce(raws[i], codes[i]) AS raw_text, CASE WHEN i = 1 THEN 'crop0' ELSE '' END AS crop FROM z")
def zipped_lists(spark, d):
    """Codes with their read texts and crops by position; the shorter lists are filled up."""
    p = ordered_codes(T.items(spark, d))
    codes = F.col("codes")
    z = X.zipped(codes, raw_text=(F.slice(codes, 1, 2), None), crop=(F.array(F.lit("crop0")), F.lit("")))
    return p.select(F.col("registrationId").alias("id"), F.posexplode(z).alias("pos", "z")).select("id", F.col("pos").cast("long").alias("pos"), "z.code", "z.raw_text", "z.crop")


@query(
    f"""{_CODES} SELECT r.id, '{{"process_id":' || (r.id % 25) || ',"division":"' || processName || '","worker_id":' || userId || ',"device_id":"dev","registered_at":"' || strftime(make_timestamp(registeredAt * 1000), '%Y-%m-%dT%H:%M:%S')
    || '","product_numbers":[' || array_to_string(list_transform(codes, lambda x: '"' || x || '"'), ',') || '],"construction_name":"' || constructionName || '","process_name":"' || processName || '"}}' AS payload FROM registrations r JOIN p USING (id)"""
)
def request_payload(spark, d):
    """The request that sends a registration, under the server's names."""
    r = T.registrations(spark, d).join(ordered_codes(T.items(spark, d)).withColumnRenamed("registrationId", "id"), "id")
    at = F.date_format(F.timestamp_millis("registeredAt"), "yyyy-MM-dd'T'HH:mm:ss")
    c = F.col
    return r.select("id", X.request_payload(process_id=c("id") % 25, division=c("processName"), worker_id=X.worker_number(c("userId")), device_id=F.lit("dev"), registered_at=at, product_numbers=c("codes"), construction_name=c("constructionName"), process_name=c("processName")).alias("payload"))


_PARTS = f"{_CODES} SELECT r.id, (r.id % 25)::INT AS process_id, processName AS division, userId::INT AS worker_id, 'dev' AS device_id, strftime(make_timestamp(registeredAt * 1000), '%Y-%m-%dT%H:%M:%S') AS registered_at, len(codes)::INT AS n, codes[1] AS first, codes[len(codes)] AS last, constructionName AS construction_name, processName AS process_name FROM registrations r JOIN p USING (id)"


@query(_PARTS)
def request_fields(spark, d):
    """Requests read back from JSON."""
    r = request_payload(spark, d).withColumn("r", X.read_request(F.col("payload")))
    n = F.col("r.product_numbers")
    return r.select("id", *(f"r.{k}" for k in ("process_id", "division", "worker_id", "device_id", "registered_at", "construction_name", "process_name")), F.size(n).alias("n"), F.get(n, F.lit(0)).alias("first"), F.get(n, F.size(n) - 1).alias("last"))


@query(f"{T.with_('recognised_texts')} SELECT text_id, '信頼度:' || format('{{:.2f}}', (text_id % 100) / 100.0::DOUBLE) || '  距離:' || (text_id % 4) || '  OCR:' || text AS note, '・' || text || '  (信頼度:' || format('{{:.2f}}', (text_id % 100) / 100.0::DOUBLE) || ')' AS unmatched FROM recognised_texts")
def result_notes(spark, d):
    k, t = F.col("text_id"), F.col("text")
    conf = (k % 100) / 100.0
    return T.recognised_texts(spark, d).select("text_id", X.result_note(conf, k % 4, t).alias("note"), X.bullet(X.unmatched_note(t, conf)).alias("unmatched"))


@query(f"{T.with_('registrations')} SELECT id, strftime(make_timestamp(registeredAt * 1000), '%Y-%m-%dT%H:%M:%S') AS sent_form, strftime(make_timestamp(registeredAt * 1000), '%Y/%m/%d %H:%M') AS shown_form, strftime(make_timestamp(registeredAt * 1000), '%Y%m%d_%H%M%S') AS file_form FROM registrations")
def date_formats(spark, d):
    at = F.timestamp_millis("registeredAt")
    forms = {"sent_form": "yyyy-MM-dd'T'HH:mm:ss", "shown_form": "yyyy/MM/dd HH:mm", "file_form": "yyyyMMdd_HHmmss"}
    return T.registrations(spark, d).select("id", *(F.date_format(at, f).alias(k) for k, f in forms.items()))


@query(
    f"""{T.with_('registrations')} SELECT id, '【' || constructionName || '】' || processName AS header, trim(string_split(constructionName || ' (信頼度: 0.5)', ' (信頼度:')[1]) AS plain, format('{{:.2f}}', id / 7.0::DOUBLE) AS shown,
    CASE WHEN trim(columnNo) = '' THEN '未指定' ELSE trim(columnNo) END AS column_shown FROM registrations"""
)
def shown_texts(spark, d):
    c = F.col
    marked = F.concat("constructionName", F.lit(" (信頼度: 0.5)"))
    return T.registrations(spark, d).select(
        "id", X.header_label(c("constructionName"), c("processName")).alias("header"), X.before_mark(marked, " (信頼度:").alias("plain"), X.two_decimals(c("id") / 7.0).alias("shown"), X.or_unset(c("columnNo")).alias("column_shown")
    )


@query("SELECT event_id, ((value::INT * 90) % 360 + 360) % 360 AS turned, greatest(0, 100 - (event_id % 40 + event_id % 30 + event_id % 50))::BIGINT AS other_ms FROM (SELECT event_id, event_id % 17 - 8 AS value FROM events)")
def turns_and_timings(spark, d):
    """A turn as an angle between 0 and 360, and the part of a run's time that no phase accounts for."""
    e = F.col("event_id")
    return T.read(spark, d, "events").select("event_id", N.right_angle((e % 17 - 8).cast("int") * 90).alias("turned"), N.unaccounted(F.lit(100), e % 40, e % 30, e % 50).alias("other_ms"))


# ---- changes of master data ----
@query("SELECT DISTINCT code FROM (SELECT p_brand AS code FROM part UNION ALL SELECT 'NEW-1')")
def add_label(spark, d):
    """A typed label in its normalised form; one that is there already adds nothing."""
    labels = T.read(spark, d, "part").select(F.col("p_brand").alias("code")).distinct()
    typed = lambda x: spark.createDataFrame([(x,)], "code string")
    return M.add_label(M.add_label(M.add_label(labels, typed(" ｎｅｗ－1 ")), typed("NEW-1")), typed("鉄"))


@query(f"{T.with_('constructions')} SELECT * FROM constructions UNION ALL SELECT (SELECT max(id) + 1 FROM constructions), 'New site', 'C9', true")
def add_construction(spark, d):
    return M.add_row(T.constructions(spark, d), spark.createDataFrame([("New site", "C9", True)], "name string, code string, isActive boolean"))


@query(f"{T.with_('processes')} SELECT * FROM processes UNION ALL SELECT (SELECT max(id) + 1 FROM processes), 2, 'New step', 'P99', true")
def add_process(spark, d):
    return M.add_row(T.processes(spark, d), spark.createDataFrame([(2, "New step", "P99", True)], "constructionId long, name string, code string, isActive boolean"))


_ORD = "ord AS (SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey) + 1000 AS id FROM orders)"


@query(f"{T.with_('items')}, {_ORD} SELECT id AS registrationId, productCode, displayOrder, price FROM items JOIN ord ON registrationId = key")
def insert_with_items(spark, d):
    """Items of new registrations under the ids their parents got."""
    parents = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    return M.with_items(parents, T.items(spark, d).withColumnRenamed("registrationId", "key"), 1001)[1].select("registrationId", "productCode", "displayOrder", "price")


@query(
    f"""{_CODES}, e AS (SELECT r.id, registeredAt AS at_ms, processName, userId, unnest(codes) AS code, generate_subscripts(codes, 1) AS pos FROM registrations r JOIN p USING (id))
    SELECT row_number() OVER (ORDER BY at_ms, id, pos) AS id, processName AS division, userId AS worker_id, code AS product_number, '2026-01-02T03:04:05' AS received_at FROM e"""
)
def ingest_records(spark, d):
    """The server's records of posted registrations, one a code."""
    codes = ordered_codes(T.items(spark, d)).withColumnRenamed("registrationId", "id").select("id", "codes")
    posted = T.registrations(spark, d).join(codes, "id").select("id", F.col("registeredAt").alias("at"), F.col("processName").alias("division"), F.col("userId").alias("worker_id"), "codes")
    return M.ingested(posted, "2026-01-02T03:04:05").select("id", "division", "worker_id", F.get("product_numbers", F.lit(0)).alias("product_number"), "received_at")


@query(f"{T.with_('processes')} SELECT 'refused' AS kind, id, constructionId FROM processes UNION ALL SELECT 'taken', id, constructionId FROM processes WHERE constructionId <> 3")
def master_refresh(spark, d):
    """A refresh that would orphan processes changes nothing; one that would not replaces both tables."""
    sites, steps = T.constructions(spark, d), T.processes(spark, d)
    fewer = sites.where("id != 3")
    refused = M.refreshed(sites, steps, fewer, steps.where("id % 2 = 0 OR constructionId = 3"))[1]
    taken = M.refreshed(sites, steps, fewer, steps.where("constructionId != 3"))[1]
    return refused.select(F.lit("refused").alias("kind"), "id", "constructionId").unionByName(taken.select(F.lit("taken").alias("kind"), "id", "constructionId"))


_SITES = "i AS (SELECT n_nationkey::BIGINT + 1 AS id, n_name AS name, 'C' || (n_nationkey % 9) AS code FROM nation)"


@query(f"{T.with_('constructions')}, {_SITES} SELECT 'replace' AS mode, count(*) AS count, 0 AS skipped FROM i UNION ALL SELECT 'diff', count(*) FILTER (WHERE code NOT IN (SELECT code FROM constructions)), count(*) FILTER (WHERE code IN (SELECT code FROM constructions)) FROM i")
def construction_import_counts(spark, d):
    k = F.col("n_nationkey")
    new = T.read(spark, d, "nation").select((k.cast("long") + 1).alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("C"), (k % 9).cast("string")).alias("code"))
    old = T.constructions(spark, d)
    return M.import_counts(old, new, ["code"], "replace").select(F.lit("replace").alias("mode"), "*").unionByName(M.import_counts(old, new, ["code"], "diff").select(F.lit("diff").alias("mode"), "*"))


# ---- regions, colours, crops ----
@query(
    f"""WITH {_QUADS}, a AS (SELECT vec_id, k, abs((x[1] * y[2] - x[2] * y[1]) + (x[2] * y[3] - x[3] * y[2]) + (x[3] * y[4] - x[4] * y[3]) + (x[4] * y[1] - x[1] * y[4])) / 2 AS area FROM pts)
    SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY area DESC, k)::INT AS rank, round(area, 5) AS area FROM a WHERE area > 120 QUALIFY rank <= 5"""
)
def largest_regions(spark, d):
    r = _quads(spark, d).select("vec_id", "k", F.col("k").alias("ord"), G.area(F.col("p")).alias("area"))
    return R.largest(r, "vec_id", 5).select("vec_id", "k", "rank", F.round("area", 5).alias("area"))


@query(f"WITH {_BOX} SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY k)::INT AS badge FROM box WHERE r - l > 8")
def badge_numbers(spark, d):
    """Badges count the regions shown, while ``k`` keeps the gaps of those filtered out."""
    return R.badges(_boxes(spark, d).where("right - left > 8").select("vec_id", "k"), "vec_id", "k")


_CORNERS = f"""{_QUADS}, s AS (SELECT vec_id, k, list_sort(list_transform(range(1, 5), lambda i: {{'y': y[i], 'i': i, 'x': x[i]}})) AS s FROM pts),
h AS (SELECT vec_id, k, list_sort([{{'x': s[1].x, 'k': 0, 'y': s[1].y}}, {{'x': s[2].x, 'k': 1, 'y': s[2].y}}]) AS a, list_sort([{{'x': s[3].x, 'k': 0, 'y': s[3].y}}, {{'x': s[4].x, 'k': 1, 'y': s[4].y}}]) AS b FROM s),
o AS (SELECT vec_id, k, [a[1].x, a[1].y, a[2].x, a[2].y, b[2].x, b[2].y, b[1].x, b[1].y] AS p FROM h)"""


@query(f"WITH {_CORNERS} SELECT vec_id, k, {_PS('p')} FROM o")
def quad_corner_order(spark, d):
    return _quads(spark, d).withColumn("p", G.corner_order(F.col("p"))).select("vec_id", "k", *_spread("p"))


_SIDE = lambda a, b: f"sqrt(pow(p[{2 * a + 1}] - p[{2 * b + 1}], 2) + pow(p[{2 * a + 2}] - p[{2 * b + 2}], 2))"


@query(f"WITH {_CORNERS} SELECT vec_id, k, greatest(1, least(2000, trunc(({_SIDE(0, 1)} + {_SIDE(3, 2)}) / 2)))::INT AS w, greatest(1, least(2000, trunc(({_SIDE(0, 3)} + {_SIDE(1, 2)}) / 2)))::INT AS h FROM o")
def crop_sizes(spark, d):
    w, h = G.crop_size(G.corner_order(F.col("p")))
    return _quads(spark, d).select("vec_id", "k", w.alias("w"), h.alias("h"))


@query(
    f"""WITH {_QUADS}, c AS (SELECT vec_id, k, list_transform(p, lambda v, i: (CASE WHEN i % 2 = 1 THEN list_avg(x) + (v - list_avg(x)) * 0.7::DOUBLE ELSE list_avg(y) + (v - list_avg(y)) * 0.7::DOUBLE END) * 4.0::DOUBLE + CASE WHEN i % 2 = 1 THEN -40.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM pts)
    SELECT vec_id, k, {_PS('p')} FROM c"""
)
def overlay_polygon(spark, d):
    """Polygons of a 120 by 160 image over a view of 400 by 640."""
    p = G.on_view(F.col("p"), F.lit(120.0), F.lit(160.0), F.lit(400.0), F.lit(640.0))
    return _quads(spark, d).withColumn("p", p).select("vec_id", "k", *_spread("p"))


_RGB = f"{_E}, px AS (SELECT vec_id, k, round(least(255, greatest(0, (e[3 * k + 1] + 0.6) * 230))) AS r, round(least(255, greatest(0, (e[3 * k + 2] + 0.6) * 230))) AS g, round(least(255, greatest(0, (e[3 * k + 3] + 0.6) * 230))) AS b FROM e, range(21) t(k))"


def _rgb(spark, d):
    v = lambda j: F.round(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (F.get("e", F.col("k") * 3 + j) + 0.6) * 230)))
    return _e(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(20)))).select("vec_id", F.col("k").cast("long").alias("k"), v(0).alias("r"), v(1).alias("g"), v(2).alias("b"))


@query(
    f"""WITH {_RGB}, m AS (SELECT *, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS span FROM px)
    SELECT vec_id, k, round(CASE WHEN span = 0 THEN 0 WHEN top = r THEN CASE WHEN g < b THEN (g - b) / span + 6 ELSE (g - b) / span END WHEN top = g THEN (b - r) / span + 2 ELSE (r - g) / span + 4 END * 60, 6) AS h,
    round(CASE WHEN top = 0 THEN 0 ELSE span / top END, 6) AS s, round(top / 255, 6) AS v FROM m"""
)
def rgb_to_hsv(spark, d):
    h, s, v = I.hsv(F.col("r"), F.col("g"), F.col("b"))
    return _rgb(spark, d).select("vec_id", "k", F.round(h, 6).alias("h"), F.round(s, 6).alias("s"), F.round(v, 6).alias("v"))


@query(f"WITH {_RGB}, q AS (SELECT *, (r * 1.5 - 20) AS c FROM px) SELECT vec_id, k, round((r / 255 - 0.485::DOUBLE) / 0.229::DOUBLE, 6) AS detect, round(r / 127.5::DOUBLE - 1, 6) AS recognise, greatest(0, least(255, c)) AS stretched FROM q")
def tensor_values(spark, d):
    """A red value as the detector and the recogniser take it, and after a stretch."""
    r = F.col("r")
    return _rgb(spark, d).select("vec_id", "k", F.round(I.detection_input(r), 6).alias("detect"), F.round(I.recognition_input(r), 6).alias("recognise"), I.stretched(r, F.lit(1.5), F.lit(-20.0)).alias("stretched"))


@query(f"WITH {_E}, f AS (SELECT vec_id, list_transform(range(20), lambda i: e[3 * i + 1]) || list_transform(range(20), lambda i: e[3 * i + 2]) || list_transform(range(20), lambda i: e[3 * i + 3]) AS f FROM e) SELECT vec_id, unnest(range(60)) AS pos, unnest(f) AS v FROM f")
def tensor_planes(spark, d):
    """Twenty pixels of three channels, channel by channel."""
    pixels = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.slice("e", i * 3 + 1, 3))
    return _e(spark, d).select("vec_id", F.posexplode(I.planes(pixels)).alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), "v")


_NEST = f"WITH {_E} SELECT vec_id, t AS step, round(list_max(e[t * 8 + 1 : t * 8 + 8]), 6) AS best FROM e, range(8) r(t)"


@query(_NEST)
def nested_output(spark, d):
    """Model output [1][steps][classes] unwrapped to its steps."""
    nested = F.array(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("e", t * 8 + 1, 8)))
    return _e(spark, d).select("vec_id", F.posexplode(F.flatten(nested)).alias("step", "row")).select("vec_id", F.col("step").cast("long").alias("step"), F.round(F.array_max("row"), 6).alias("best"))
