"""URL filter: rules first, then a logistic regression over hashed character n-grams.

The regression is fitted to a small labelled table of URLs in its dual form, which
needs only the table's Gram matrix (rows squared, a fixed size), by a fixed number
of gradient steps inside one SQL expression. Its primal weights, one for each hash
bucket, then score any number of URLs inside their rows, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: the rules, (verdict, host, path) ----
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
# ---- end of fixed values ----

# The labelled URLs, made up for this file; another table can be given.
BLOCKED = """
casino-royal.test/play casino.games.test/bonus/3 win-casino.test/slots mega-casino-win.test/spin online-casino.shop.test/a poker-win.test/table
bets-now.test/odds free-bets.club.test/1 sports-bets.test/live betting-tips.test/free big-win-bets.test/go jackpot-win.test/en/12
cheap-pills.store.test/buy pills-online.test/order diet-pills.test/x cheap-meds.test/en/7 cheap-watches.test/de/3 cheap-loans.test/now
adult-video.test/x adult-chat.test/fr/9 x-adult.test/free adult-x.clips.test/en/44 hot-adult.test/es/2 xxx-adult.test/view
ads-server.test/click track-ads.test/pixel ads-track.cdn.test/i click-track.test/t pop-ads.test/en/5 ads-network.test/serve
spam-blast.test/mail link-farm.test/page spam-farm.links.test/en/8 content-farm.test/de/6 mail-spam.test/list seo-farm.test/links
free-prizes.test/win free-coins.test/get free-win.test/spin track-user.test/id
"""
ALLOWED = """
news.daily.test/en/100 www.library.test/de/12 blog.garden.test/fr/7 m.weather.test/es/31 docs.python.test/en/3 museum.test/history
www.university.test/en/90 research.institute.test/papers/4 blog.travel.test/en/55 recipes.kitchen.test/fr/18 m.sports.test/en/61 wiki.test/en/articles
forum.music.test/de/77 www.city.test/es/20 shop.books.test/en/14 blog.painting.test/de/43 photos.nature.test/fr/2 www.hospital.test/en/9
m.transit.test/de/88 science.journal.test/en/5 www.theatre.test/fr/66 archive.letters.test/es/13 www.school.test/en/21 maps.region.test/de/30
blog.history.test/en/73 www.farmers.test/en/8 garden.seeds.test/es/41 www.bank.test/de/19 m.radio.test/fr/52 language.lessons.test/en/36
thoring.test/en/11 www.therand.test/de/29 blog.ontion.test/fr/64 m.intheat.test/en/70 ererthon.test/es/15 www.andesh.test/en/82
tinoured.test/de/4 blog.stering.test/en/37 m.wherent.test/fr/91 hanthe.test/es/58 www.reently.test/en/6 atonthis.test/de/17
blog.shouth.test/en/28 m.esthing.test/fr/33 www.ofthand.test/en/49 thinder.test/es/80 blog.leading.test/de/24 m.ablerth.test/en/10
www.notary.test/de/53 blog.cooking.test/en/62 m.cinema.test/fr/71 opera.test/es/16 www.climate.test/en/45 blog.running.test/de/35
"""

#: Character n-grams of these lengths, hash buckets, step, decay, steps.
GRAMS, BUCKETS, STEP, DECAY, STEPS = (3, 4, 5), 4096, 0.02, 0.01, 400


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://(.*)\z", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), upper, upper.lower())


def path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://(.*)\z", 1)
    return F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def longest_rule(rules: list[tuple[str, str, str]]) -> Column:
    """The rule that fits columns host and path, as struct(size, at, rule, verdict); the longest wins, then the later in order. Null if none fits."""
    if not rules:
        return F.lit(None).cast("struct<size:int,at:int,rule:string,verdict:string>")
    table = F.array(*(F.struct(F.lit(len(h + p)).alias("size"), F.lit(i).alias("at"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit(p).alias("p")) for i, (v, h, p) in enumerate(rules)))
    fits = F.filter(table, lambda r: ((F.col("host") == r.h) | F.endswith(F.col("host"), F.concat(F.lit("."), r.h))) & F.startswith(F.col("path"), r.p))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["at"].alias("at"), r.rule.alias("rule"), r.verdict.alias("verdict"))))


def features(buckets: int = BUCKETS) -> Column:
    """Distinct hash buckets of the n-grams of ``^host$`` and ``<path>``; the marks keep the two apart."""
    def grams(t: Column, n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n)))
        return F.when(F.length(t) >= n, cut).otherwise(F.array().cast("array<string>"))

    marked = (F.concat(F.lit("^"), "host", F.lit("$")), F.concat(F.lit("<"), "path", F.lit(">")))
    bucket = lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 6), 16, 10).cast("int") % buckets
    return F.array_distinct(F.transform(F.concat(*(grams(t, n) for t in marked for n in GRAMS)), bucket))


def labelled(spark: SparkSession) -> DataFrame:
    """The small labelled table: row, label (1: block), host, path."""
    rows = [(i, y, u) for i, (y, u) in enumerate([(1.0, u) for u in BLOCKED.split()] + [(0.0, u) for u in ALLOWED.split()])]
    values = ", ".join(f"({i}, {y}D, 'http://{u}')" for i, y, u in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(row, label, url)").select("row", "label", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))


def fit(train: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Weights of the buckets, then the bias. ``train`` (row, label, host, path) is small: its Gram matrix is held in one row.

    Rows are told apart by ``row``, which must differ; repeated urls count as often as they
    stand; an empty host or path has no n-grams but its marks; an empty table gives weights of 0.
    """
    rows = train.withColumn("f", features(buckets)).withColumn("norm", F.sqrt(F.greatest(F.size("f"), F.lit(1))))
    # the table is one small row from here on; array positions stand for rows
    table = rows.agg(F.sort_array(F.collect_list(F.struct("row", "label", "f", "norm"))).alias("t"))
    gram = "transform(t, a -> struct(a.row AS row, a.label AS label, transform(t, b -> size(array_intersect(a.f, b.f)) / (a.norm * b.norm) + 1) AS ks))"
    descent = f"""aggregate(sequence(1, {STEPS}), transform(g, x -> 0D), (a, step) ->
        zip_with(g, a, (x, own) -> own * {1 - STEP * DECAY}D + {STEP}D * (x.label - 1 / (1 + exp(-aggregate(zip_with(x.ks, a, (k, v) -> k * v), 0D, (s, v) -> s + v))))))"""
    # bound by a lambda, the matrix is computed once and not at every step
    alpha = table.selectExpr(f"inline(transform(array({gram}), g -> arrays_zip(transform(g, x -> x.row), {descent}))[0]) AS (row, alpha)")
    fitted = rows.join(alpha, "row").select("row", "alpha", "norm", F.explode("f").alias("bucket"))
    held = {r.bucket: r.w for r in fitted.groupBy("bucket").agg(F.sum(F.col("alpha") / F.col("norm")).alias("w")).collect()}
    bias = sum(r.alpha for r in alpha.collect())
    return [held.get(i, 0.0) for i in range(buckets)] + [bias]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, train: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's; the
    longest rule wins. Without a rule the regression decides: block from probability
    0.5. A null url, or one without ``://``, has an empty host and path, fits no rule
    and gets the verdict of the bias alone. Repeated rows repeat; an empty table gives
    no rows; other columns are ignored, whatever their names.
    """
    weights = fit(labelled(pages.sparkSession) if train is None else train)
    held = F.split(F.lit(",".join(f"{w:.9g}" for w in weights)), ",").cast("array<double>")
    urls = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    scored = urls.withColumns({"_rule": longest_rule(rules), "_f": features(len(weights) - 1)})
    z = F.aggregate("_f", F.lit(0.0), lambda s, i: s + F.get(held, i)) / F.sqrt(F.greatest(F.size("_f"), F.lit(1))) + F.lit(weights[-1])
    return scored.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), F.when(z >= 0, "block").otherwise("allow")).alias("verdict"))


def oracle() -> str:
    """DuckDB SQL for op7's rows, the fit as a recursive query."""
    rows = ", ".join(f"({i}, {y}::DOUBLE, 'http://{u}')" for i, (y, u) in enumerate([(1.0, u) for u in BLOCKED.split()] + [(0.0, u) for u in ALLOWED.split()]))
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    cut = lambda s: f"""regexp_extract(coalesce({s}, ''), '(?s)^.*?://(.*)$', 1)"""
    parts = lambda s: f"lower(regexp_extract({cut(s)}, '^[^/?#]*')) AS host, regexp_extract({cut(s)}, '^[^/?#]*([^?#]*)', 1) AS path"
    grams = " || ".join(f"list_transform(range(1, length({t}) - {n - 2}), lambda i: substring({t}, i, {n}))" for t in ("('^' || host || '$')", "('<' || path || '>')") for n in GRAMS)
    feats = f"list_distinct(list_transform({grams}, lambda g: ('0x' || substring(md5(g), 1, 6))::INT % {BUCKETS}))"
    return f"""
WITH RECURSIVE lab AS (SELECT row, label, {parts('url')} FROM (VALUES {rows}) t(row, label, url)),
f AS (SELECT row, label, {feats} AS f FROM lab),
gram AS (SELECT list(label ORDER BY row) AS y, list(ks ORDER BY row) AS k FROM (
  SELECT a.row, a.label, list(len(list_intersect(a.f, b.f)) / (sqrt(len(a.f)) * sqrt(len(b.f))) + 1 ORDER BY b.row) AS ks FROM f a, f b GROUP BY ALL)),
steps(i, a) AS (SELECT 0, list_transform(y, lambda v: 0::DOUBLE) FROM gram UNION ALL
  SELECT i + 1, list_transform(range(1, len(a) + 1), lambda r: a[r] * {1 - STEP * DECAY} + {STEP} * (y[r] - 1 / (1 + exp(-list_dot_product(k[r], a))))) FROM steps, gram WHERE i < {STEPS}),
al AS (SELECT a FROM steps WHERE i = {STEPS}),
w AS (SELECT b, sum(v) AS w FROM (SELECT unnest(f) AS b, a[row + 1] / sqrt(len(f)) AS v FROM f, al) GROUP BY b),
p AS (SELECT page_id, row_number() OVER () AS rid, {parts('url')} FROM pages),
pf AS (SELECT rid, {feats} AS f FROM p),
z AS (SELECT rid, sum(coalesce(w.w, 0)) / sqrt(any_value(n)) + any_value(bias) AS z FROM
  (SELECT rid, unnest(f) AS b, len(f) AS n, list_sum(a) AS bias FROM pf, al) x LEFT JOIN w ON w.b = x.b GROUP BY rid),
r AS (SELECT rid, arg_max(h || pp, length(h || pp)) AS rule, arg_max(v, length(h || pp)) AS verdict FROM p, (VALUES {rules}) t(v, h, pp)
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pp) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(z, (SELECT list_sum(a) FROM al)) >= 0 THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN z USING (rid) LEFT JOIN r USING (rid)"""
