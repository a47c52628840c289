"""Queries on codes, labels and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import match as M
from ..sources import standins as T
from .registry import query

_CHARS = r"A-Za-z0-9+\-./_ \[\]"
_TRIM = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_CLEAN = lambda c: _TRIM(f"regexp_replace({_TRIM(c)}, '^[XY][a-z][0-9]\\s*', '')")
_RAW = "(SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '  Xa1 ' || p_brand || '-' || p_size || ' ' WHEN 1 THEN 'Ya1Xb2' || p_brand WHEN 2 THEN p_type || CASE p_partkey % 3 WHEN 0 THEN '~!#!' ELSE '' END ELSE CASE p_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'A' ELSE repeat(p_brand, 6) END END AS raw FROM part)"


def _raw(spark, d):
    """Codes as a reader might deliver them: padded, prefixed, with wrong characters, short, long."""
    k = F.col("p_partkey")
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit("  Xa1 "), "p_brand", F.lit("-"), F.col("p_size").cast("string"), F.lit(" ")))
        .when(k % 4 == 1, F.concat(F.lit("Ya1Xb2"), "p_brand"))
        .when(k % 4 == 2, F.concat("p_type", F.when(k % 3 == 0, "~!#!").otherwise("")))
        .when(k % 5 == 0, " ")
        .when(k % 5 == 1, "A")
        .otherwise(F.repeat("p_brand", F.lit(6)))
    )
    return T.read(spark, d, "part").select(k.alias("id"), raw.alias("raw"))


@query(f"SELECT id, {_CLEAN('raw')} AS code FROM {_RAW}")
def clean_product_code(spark, d):
    return _raw(spark, d).select("id", X.clean_code(F.col("raw")).alias("code"))


@query(
    f"SELECT id, CASE WHEN {_TRIM('raw')} = '' THEN 'blank' WHEN length({_TRIM('raw')}) < 2 THEN 'short' WHEN length({_TRIM('raw')}) > 50 THEN 'long' WHEN NOT regexp_full_match({_TRIM('raw')}, '[{_CHARS}]+') THEN 'charset' END AS error, "
    f"nullif(array_to_string(list_filter(string_split(regexp_replace(raw, '[{_CHARS}]', '', 'g'), ''), lambda x, i: x <> '' AND list_position(string_split(regexp_replace(raw, '[{_CHARS}]', '', 'g'), ''), x) = i), ''), '') AS bad FROM {_RAW}"
)
def validate_product_code(spark, d):
    """What is wrong with a code, and its wrong characters, first seen first."""
    bad = F.array_join(X.invalid_chars(F.col("raw")), "")
    return _raw(spark, d).select("id", X.validation_error(F.col("raw")).alias("error"), F.nullif(bad, F.lit("")).alias("bad"))


@query(f"{T.with_('lines')}, c AS (SELECT conv_id, turn, line_no, {_CLEAN('line')} AS code FROM lines) SELECT conv_id, code, count(DISTINCT turn * 1000 + line_no) AS n FROM c WHERE length(code) >= 2 AND regexp_full_match(code, '[{_CHARS}]+') GROUP BY ALL")
def extract_valid_codes(spark, d):
    """Distinct codes of each conversation's lines, with the number of lines."""
    c = T.lines(spark, d).withColumn("code", X.clean_code(F.col("line"))).where(X.is_extractable(F.col("code")))
    return c.groupBy("conv_id", "code").agg(F.count_distinct(F.col("turn") * 1000 + F.col("line_no")).alias("n"))


@query("SELECT p_partkey AS id, regexp_replace(trim(upper(' ' || p_name || ' ')), '[^\\x20-\\x7E]', '', 'g') AS code FROM part")
def server_normalize_code(spark, d):
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), X.server_normalized(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("code"))


_FORM = lambda c: f"replace(replace(replace(upper(trim({c})), ' ', ''), '-', ''), chr(12288), '')"
_VARIANTS = lambda c: f"CASE WHEN length({c}) = 0 THEN [{c}] ELSE list_distinct([{c}] || list_transform(range(1, length({c}) + 1), lambda i: {c}[:i - 1] || translate({c}[i], '0O1I5S8B6G2Z7T4A', 'O0I1S5B8B6Z2T7A4') || {c}[i + 1:])) END"


@query(f"{T.with_('product_labels')} SELECT code, {_FORM('code')} AS form FROM product_labels")
def label_normalize(spark, d):
    return T.product_labels(spark, d).select("code", X.match_form(F.col("code")).alias("form"))


@query(f"{T.with_('product_labels')} SELECT code, unnest({_VARIANTS(_FORM('code'))}) AS variant FROM product_labels")
def label_variants(spark, d):
    return T.product_labels(spark, d).select("code", F.explode(X.variants(X.match_form(F.col("code")))).alias("variant"))


@query("SELECT a.p_partkey AS id, levenshtein(a.p_name, b.p_name) AS d FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def label_edit_distance(spark, d):
    p = T.read(spark, d, "part")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(nxt, "p_partkey").select(F.col("p_partkey").alias("id"), F.levenshtein("p_name", "other").cast("long").alias("d"))


_MATCH = f"""{T.with_('product_labels', 'recognised_texts')},
l AS (SELECT code, row_number() OVER (ORDER BY code)::INT AS label_index, {_FORM('code')} AS label FROM product_labels),
t AS (SELECT DISTINCT text, {_FORM('text')} AS form FROM recognised_texts WHERE length(text) >= 4),
v AS (SELECT text, form, unnest({_VARIANTS('form')}) AS v FROM t),
c AS (SELECT text, code, label_index, min(levenshtein(v, label)) AS distance, bool_or(length(v) >= 2 AND length(label) >= 2 AND v[:2] = label[:2]) AS prefix, abs(length(any_value(form)) - length(any_value(label))) AS length_diff
      FROM v JOIN l ON abs(length(form) - length(label)) <= 3 GROUP BY ALL HAVING min(levenshtein(v, label)) <= 3),
p AS (SELECT *, bool_or(prefix) OVER (PARTITION BY text) AS any_prefix FROM c),
r AS (SELECT *, row_number() OVER w AS rank, lead(distance) OVER w AS nd, lead(length_diff) OVER w AS nl FROM p WHERE prefix OR NOT any_prefix WINDOW w AS (PARTITION BY text ORDER BY distance, prefix DESC, length_diff, label_index)),
f AS (SELECT text, rank::INT AS rank, code, distance::INT AS distance, distance = 0 AS is_exact, bool_or(rank = 1 AND coalesce(nd = distance AND nl = length_diff, false)) OVER (PARTITION BY text) AS is_ambiguous FROM r)"""


def _top(spark, d, k):
    return M.top(T.recognised_texts(spark, d), M.indexed(T.product_labels(spark, d)), k)


@query(f"{_MATCH} SELECT * FROM f WHERE rank <= 3")
def fuzzy_top3(spark, d):
    return _top(spark, d, 3)


@query(f"{_MATCH} SELECT * FROM f WHERE rank = 1")
def fuzzy_best(spark, d):
    return _top(spark, d, 1)


@query(f"{_MATCH} SELECT is_ambiguous, is_exact, count(*) AS n FROM f WHERE rank = 1 GROUP BY ALL")
def fuzzy_ambiguous(spark, d):
    return _top(spark, d, 1).groupBy("is_ambiguous", "is_exact").agg(F.count("*").alias("n"))


@query(f"{_MATCH} SELECT text, count(*) AS n, bool_or(prefix) AS any_prefix, count(*) FILTER (WHERE prefix) AS with_prefix FROM c GROUP BY text")
def fuzzy_prefix_priority(spark, d):
    return M.candidate_counts(T.recognised_texts(spark, d), M.indexed(T.product_labels(spark, d)))


@query(f"{_MATCH} SELECT text_id, m.text IS NOT NULL AS matched, m.code FROM recognised_texts LEFT JOIN (SELECT text, code FROM f WHERE rank = 1) m USING (text)")
def matched_unmatched_split(spark, d):
    t = T.recognised_texts(spark, d)
    return t.join(_top(spark, d, 1).select("text", "code"), "text", "left").select("text_id", F.col("code").isNotNull().alias("matched"), "code")


@query(f"{T.with_('product_labels', 'recognised_texts')} SELECT text_id, code IS NOT NULL AS is_in_master FROM recognised_texts LEFT JOIN product_labels ON text = code")
def master_membership(spark, d):
    t, m = T.recognised_texts(spark, d), T.product_labels(spark, d).select("code")
    return t.join(m, t["text"] == m["code"], "left").select("text_id", F.col("code").isNotNull().alias("is_in_master"))
