"""Mixing sources to target weights by iterative proportional fitting.

Token counts collapse to a table of cells (source, language, topic). Raking scales
the cells, one margin after the other, until each margin meets its target shares,
no cell growing beyond the tokens it has. A document then stays with the
probability of its cell, drawn from a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, saved, words

DIMS = ("source", "lang", "topic")
#: Share of all tokens to keep; sweeps over the margins; targets: shares of the tokens now, to this power.
BUDGET, SWEEPS = 0.6, 8
POWERS = {"source": 0.5, "lang": 0.5, "topic": 1.0}
NONE = "(none)"
#: So many cells at most are raked in one task.
SMALL = 50_000


def topic(text: Column) -> Column:
    """A coarse topic that needs no model: what kind of text this is."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.contains("Licensed under"), "licensed")
        .when(t.contains(" | "), "tabular")
        .when(t.contains("@") | t.rlike("[0-9]{4}"), "records")
        .when(F.length(t) >= 4000, "longform")
        .otherwise("prose")
    )


def targets(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares of a margin: its present shares to a power, scaled to one. Small powers level the margin."""
    by = cells.groupBy(dim).agg(F.sum("t").alias("t"))
    total = by.agg(F.sum(F.pow("t", F.lit(power))).alias("all")).first()["all"] or 1.0
    return by.select(dim, (F.pow("t", F.lit(power)) / F.lit(total)).alias("share"))


def rake(cells: DataFrame, margins: dict[str, DataFrame], budget: float, sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (the dimensions, t) with x: the calibrated tokens, at most t.

    ``margins`` maps a dimension to its target shares (dimension, share); ``budget`` is
    the number of tokens wanted. A value without a target gets none; a target without
    cells stays unmet. Up to SMALL cells, one task rakes them without a shuffle; more
    are dealt by dimension, and each sweep is kept in the shared folder.
    """
    out = cells.withColumn("x", F.col("t").cast("double"))
    for dim, share in margins.items():
        out = out.join(share.select(dim, F.col("share").alias(f"_{dim}")), dim, "left")
    out = saved(out)
    small = out.count() <= SMALL
    out = out.coalesce(1) if small else out
    for _ in range(sweeps):
        for dim in margins:
            # a margin whose cells have nothing left stays as it is
            factor = F.coalesce(F.col(f"_{dim}") * budget / F.nullif(F.sum("x").over(Window.partitionBy(dim)), F.lit(0.0)), F.lit(0.0))
            out = out.withColumn("x", F.least(F.col("t").cast("double"), F.col("x") * factor))
        out = out if small else saved(out)
    return saved(out.select(*cells.columns, "x"))


def residual(cells: DataFrame, margins: dict[str, DataFrame], budget: float) -> float:
    """How far the calibrated tokens x of raked ``cells`` are from the margins: the largest difference of a value's share of ``budget`` from its target."""
    off = [
        cells.groupBy(d).agg(F.sum("x").alias("x")).join(share.select(d, "share"), d, "full").agg(F.max(F.abs(F.coalesce("x", F.lit(0.0)) / budget - F.coalesce("share", F.lit(0.0)))).alias("off"))
        for d, share in margins.items()
    ]
    return max((df.first()["off"] or 0.0 for df in off), default=0.0) if budget else 0.0


def mix(docs: DataFrame, budget: float = BUDGET, powers: dict[str, float] = POWERS, topic_of: Column | None = None, seed: str = "mix", margins: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source, lang): doc_id, source, lang, topic, n_tokens, p, kept.

    ``margins`` gives target weights as tables (dimension, share) for any of source, lang and
    topic; a dimension without one is raked to its present shares to a power. ``p`` is the
    share of its cell's tokens that stay; how near the targets are met, ``residual`` tells.
    Null dimensions form a value of their own, "(none)". A value that its target table lacks
    gets no tokens. A text without words adds no tokens; a cell without tokens keeps
    its documents. Repeated rows share one fate; a null id draws like an empty one; an
    empty table gives no rows; other columns are ignored.
    """
    return drawn(docs, budget, powers, topic_of, seed, margins).drop("key")


def drawn(docs: DataFrame, budget: float = BUDGET, powers: dict[str, float] = POWERS, topic_of: Column | None = None, seed: str = "mix", margins: dict[str, DataFrame] | None = None) -> DataFrame:
    """The same with key, the hash of each row's text and dimensions."""
    n = F.size(words(F.col("text"))).cast("long")
    slim = docs.select("doc_id", mix_key().alias("key"), *(F.coalesce(F.col(d), F.lit(NONE)).alias(d) for d in ("source", "lang")), (topic(F.col("text")) if topic_of is None else F.coalesce(topic_of, F.lit(NONE))).alias("topic"), n.alias("n_tokens"))
    slim = saved(slim)
    cells = saved(slim.groupBy(*DIMS).agg(F.sum("n_tokens").alias("t")).where("t > 0"))
    total = cells.agg(F.sum("t").alias("t")).first()["t"] or 0
    given = margins or {}
    fitted = rake(cells, {d: given[d] if d in given else saved(targets(cells, d, powers[d])) for d in DIMS}, budget * total)
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    p = F.coalesce(F.col("x") / F.col("t"), F.lit(1.0))
    return slim.join(fitted, list(DIMS), "left").select("doc_id", "key", *DIMS, "n_tokens", F.round(p, 6).alias("p"), (u < p).alias("kept"))


def mix_key() -> Column:
    return F.xxhash64(*(F.coalesce(c, F.lit("")) for c in ("text", "source", "lang")))


def keep_mixed(docs: DataFrame, margins: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, lang and others) that the mix keeps, with all their columns, whatever their names.

    Rows of one id draw alike, each for its own cell; repeated rows share one fate; a null id
    draws like an empty one; a null source or language is a value of its own; rows of a cell
    without words stay; an empty table stays empty.
    """
    return rows_of(docs, drawn(docs, margins=margins).where("kept"), mix_key())


def oracle(source: str = "documents") -> str:
    """DuckDB SQL for op9's rows, one CTE a margin and sweep."""
    t = "coalesce(text, '')"
    ctes = [
        f"""s AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
              CASE WHEN contains({t}, 'Licensed under') THEN 'licensed' WHEN contains({t}, ' | ') THEN 'tabular' WHEN contains({t}, '@') OR regexp_matches({t}, '[0-9]{{4}}') THEN 'records'
                   WHEN length({t}) >= 4000 THEN 'longform' ELSE 'prose' END AS topic,
              len(list_filter(string_split_regex({t}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM {source})""",
        f"c AS (SELECT {', '.join(DIMS)}, sum(n_tokens)::DOUBLE AS t FROM s GROUP BY ALL HAVING sum(n_tokens) > 0)",
        f"b AS (SELECT {BUDGET} * sum(t) AS b FROM c)",
    ]
    for d in DIMS:
        ctes.append(f"t_{d} AS (SELECT {d}, pow(sum(t), {POWERS[d]}) / sum(pow(sum(t), {POWERS[d]})) OVER () AS share FROM c GROUP BY {d})")
    last = "c0"
    ctes.append("c0 AS (SELECT *, t AS x FROM c)")
    for i in range(SWEEPS):
        for d in DIMS:
            new = f"c{i}_{d}"
            ctes.append(f"{new} AS MATERIALIZED (SELECT y.* REPLACE (least(t, x * share * b / sx) AS x) FROM {last} y JOIN (SELECT {d}, sum(x) AS sx FROM {last} GROUP BY {d}) m USING ({d}) JOIN t_{d} USING ({d}), b)")
            last = new
    u = "('0x' || substring(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    return f"WITH {', '.join(ctes)} SELECT doc_id, {', '.join(DIMS)}, n_tokens, round(coalesce(x / t, 1.0), 6) AS p, {u} < coalesce(x / t, 1.0) AS kept FROM s LEFT JOIN {last} USING ({', '.join(DIMS)})"
