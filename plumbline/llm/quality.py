"""Quality rules as weak supervision.

Each rule reads counts of a text and votes good, bad or abstains. Expectation
maximisation (two classes, each rule with its own accuracy on good and on bad
texts, votes independent given the class) estimates the accuracies from the votes
alone, and a text is kept by its posterior probability of being good. One thing the
votes cannot tell: whether texts that a single rule rejects are bad texts of one kind
or good ones that the rule misjudges. So the accuracy of every rule on good texts has
one Beta prior, whose pseudo-counts are in proportion to the votes that the rule casts;
what a rule's bad vote weighs against the others is estimated. The votes
collapse to patterns with counts before any estimation: at most 3 to the power of
the number of rules rows, however many texts there are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, rows_of, saved, strip_space, text_key, words

#: Words in a window, rounds of estimation, pseudo-count of each vote, least posterior.
WINDOW, ROUNDS, PSEUDO, KEEP = 8, 10, 1.0, 0.5
#: Prior of a rule's accuracy on good texts: mean, and how many times the rule's own votes it weighs.
PRIOR, WEIGHT = 0.999, 9.0
#: rule: (votes bad, votes good); the votes are SQL over the counts, and it abstains where neither holds.
RULES = {
    "length": ("n_words < 20", "n_words >= 50"),
    "symbols": ("10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    "capitals": ("2 * n_capitals > word_chars", "5 * n_capitals <= word_chars"),
    "stutter": ("10 * n_stutter > n_words", "50 * n_stutter <= n_words"),
    "repeats": ("100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    "lines": ("2 * n_dup_lines > n_lines", "10 * n_dup_lines <= n_lines"),
    "variety": ("10 * n_distinct < n_words", "2 * n_distinct >= n_words"),
    "word_length": ("word_chars < 2 * n_words OR word_chars > 12 * n_words", "word_chars >= 3 * n_words AND word_chars <= 9 * n_words"),
}
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_stutter", "n_distinct"]


def vote(rule: str) -> str:
    """0 bad, 1 abstain, 2 good."""
    bad, good = RULES[rule]
    return f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 2 ELSE 1 END"


def text_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of its column text, all computed inside the row."""
    text = F.coalesce("text", F.lit(""))
    split = docs.withColumns({"_w": words(F.col("text")), "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(SPACE.replace("[", "[^")))})
    # the hash of the window that starts at each word
    hashed = split.withColumn("_h", F.expr(f"if(size(_w) > {WINDOW}, transform(sequence(0, size(_w) - {WINDOW}), i -> xxhash64(slice(_w, i + 1, {WINDOW}))), cast(array() as array<bigint>))"))
    # equal windows meet by sorting; then the words that the starts of the repeated ones cover, overlaps once
    covered = f"""
      transform(array(sort_array(transform(_h, (h, i) -> struct(h, i)))), s ->
        aggregate(
          sort_array(transform(filter(sequence(0, size(s) - 1), k -> get(s, k - 1).h <=> s[k].h OR get(s, k + 1).h <=> s[k].h), k -> s[k].i)),
          struct(0 AS end, 0L AS n),
          (a, p) -> struct(p + {WINDOW} AS end, a.n + p + {WINDOW} - greatest(p, a.end) AS n),
          a -> a.n))[0]"""
    out = {
        "n_words": F.size("_w"),
        "word_chars": F.length(strip_space(F.col("text"))),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.expr(f"if(size(array_distinct(_h)) < size(_h), {covered}, 0L)"),
        "n_lines": F.size("_lines"),
        "n_capitals": F.length(F.regexp_replace(text, "[^A-Z]+", "")),
        "n_stutter": F.expr("if(size(_w) > 1, size(filter(sequence(1, size(_w) - 1), i -> _w[i] = _w[i - 1])), 0)"),
        "n_distinct": F.size(F.array_distinct("_w")),
    }
    return hashed.withColumns({k: v.cast("long") for k, v in out.items()}).drop("_w", "_lines", "_h")


def estimate(votes: DataFrame, rules: list[str], rounds: int = ROUNDS) -> dict:
    """Class share and accuracies from votes (one column per rule): {"good": share, rule: (accuracy on bad, on good)}.

    Starts from the view that a text with any bad vote is likely bad. An empty table
    leaves every accuracy at one half.
    """
    size = len(rules)
    add = lambda of, cond: f"aggregate(w, 0D, (s, p) -> s + IF({cond}, p.{of}, 0D))"
    # p: a pattern's votes v and its weights, as good (g) and as bad (b); m: the model before; all in the row that holds the patterns
    odds = """ln(m.good) - ln(1 - m.good) + aggregate(zip_with(p.v, m.acc, (x, a) ->
        CASE x WHEN 0 THEN ln(1 - a.good) - ln(a.bad) WHEN 2 THEN ln(a.good) - ln(1 - a.bad) ELSE 0D END), 0D, (s, t) -> s + t)"""
    weigh = lambda q: f"transform(t, p -> transform(array({q}), q -> struct(p.v AS v, p.n * q AS g, p.n * (1 - q) AS b))[0])"
    fitted = f"""struct(
        ({add("g", "true")} + {PSEUDO}D) / ({add("g", "true")} + {add("b", "true")} + {2 * PSEUDO}D) AS good,
        transform(sequence(0, {size - 1}), j -> struct(
          ({add("b", "p.v[j] = 0")} + {PSEUDO}D) / ({add("b", "p.v[j] <> 1")} + {2 * PSEUDO}D) AS bad,
          ({add("g", "p.v[j] = 2")} + {WEIGHT * PRIOR}D * {add("g", "p.v[j] <> 1")} + {PSEUDO}D) / ({1 + WEIGHT}D * {add("g", "p.v[j] <> 1")} + {2 * PSEUDO}D) AS good)) AS acc)"""
    step = lambda q: f"transform(array({weigh(q)}), w -> {fitted})[0]"
    first = step("IF(array_min(p.v) = 0, 0.1D, 0.9D)")
    patterns = votes.groupBy(F.array(*rules).alias("v")).agg(F.count("*").cast("double").alias("n"))
    table = patterns.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("t"))
    got = table.selectExpr(f"transform(array(t), t -> aggregate(sequence(2, {rounds}), {first}, (m, i) -> {step(f'1 / (1 + exp(-({odds})))')}))[0] AS m").first().m
    return {"good": got.good} | {r: (a.bad, a.good) for r, a in zip(rules, got.acc, strict=True)}


def posterior(model: dict, rules: list[str]):
    """The probability that a text with these votes is good."""
    odds = F.lit(math.log(model["good"]) - math.log(1 - model["good"]))
    for r in rules:
        on_bad, on_good = model[r]
        odds = odds + F.when(F.col(r) == 0, math.log(1 - on_good) - math.log(on_bad)).when(F.col(r) == 2, math.log(on_good) - math.log(1 - on_bad)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, the counts, base_failed, posterior, kept.

    A null or empty text has no words and fails the base rules. Repeated rows are
    judged alike, null ids pass through, an empty table gives no rows, and other
    columns are ignored, whatever their names.
    """
    return judged(docs).drop("key")


def judged(docs: DataFrame) -> DataFrame:
    """The same with key, the hash of each row's text."""
    rules = list(RULES)
    counts = saved(text_counts(docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))).select("doc_id", "key", *COUNTS))
    voted = counts.withColumns({r: F.expr(vote(r)) for r in rules})
    model = estimate(voted, rules)
    failed = F.expr(BASE_FAILED)
    return voted.select("doc_id", "key", *COUNTS, failed.alias("base_failed"), posterior(model, rules).alias("posterior")).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) whose text is kept, with all their columns, whatever their names.

    Rows of one id are judged each by its own text; a null or empty text goes; repeated rows
    share one fate, null ids are judged like others, and an empty table stays empty.
    """
    return rows_of(docs, judged(docs).where("kept"))


def oracle(source: str = "documents") -> str:
    """DuckDB SQL for op1's rows: the counts from unnested windows, the estimation one CTE a round."""
    rules = list(RULES)
    ctes = [
        f"""d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid,
              list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
              list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM {source})""",
        f"""win AS (SELECT rid, unnest(range(0, len(w) - {WINDOW - 1})) AS p, w FROM d WHERE len(w) > {WINDOW})""",
        f"""rep AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, array_to_string(w[p + 1 : p + {WINDOW}], ' ')) AS c FROM win)""",
        f"""cov AS (SELECT rid, count(DISTINCT p + o) AS n FROM rep, range({WINDOW}) t(o) WHERE c > 1 GROUP BY rid)""",
        """c AS (SELECT d.doc_id, d.rid, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
              length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
              coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals,
              len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_stutter, len(list_distinct(w))::BIGINT AS n_distinct
              FROM d LEFT JOIN cov USING (rid))""",
        f"v AS (SELECT *, {', '.join(f'{vote(r)} AS {r}' for r in rules)} FROM c)",
        f"g AS (SELECT {', '.join(rules)}, count(*) AS n FROM v GROUP BY ALL)",
        f"q0 AS (SELECT *, CASE WHEN least({', '.join(rules)}) = 0 THEN 0.1::DOUBLE ELSE 0.9::DOUBLE END AS q FROM g)",
    ]

    def odds(m: str) -> str:
        terms = [f"ln({m}.good) - ln(1 - {m}.good)"]
        for r in rules:
            terms.append(f"CASE {r} WHEN 0 THEN ln(1 - {m}.{r}_good) - ln({m}.{r}_bad) WHEN 2 THEN ln({m}.{r}_good) - ln(1 - {m}.{r}_bad) ELSE 0 END")
        return "1 / (1 + exp(-(" + " + ".join(terms) + ")))"

    for i in range(ROUNDS):
        s = lambda cond, q: f"coalesce(sum(n * {q}) FILTER (WHERE {cond}), 0)"
        accs = ", ".join(
            f"({s(f'{r} = 0', '(1 - q)')} + 1) / ({s(f'{r} <> 1', '(1 - q)')} + 2) AS {r}_bad, ({s(f'{r} = 2', 'q')} + {WEIGHT * PRIOR}::DOUBLE * {s(f'{r} <> 1', 'q')} + 1) / ({1 + WEIGHT}::DOUBLE * {s(f'{r} <> 1', 'q')} + 2) AS {r}_good" for r in rules
        )
        ctes.append(f"m{i} AS MATERIALIZED (SELECT (sum(n * q) + 1) / (sum(n) + 2) AS good, {accs} FROM q{i})")
        ctes.append(f"q{i + 1} AS (SELECT g.*, {odds(f'm{i}')} AS q FROM g, m{i})")
    last = odds(f"m{ROUNDS - 1}")
    return f"WITH {', '.join(ctes)} SELECT doc_id, {', '.join(COUNTS)}, ({BASE_FAILED}) AS base_failed, round({last}, 4) AS posterior, NOT ({BASE_FAILED}) AND {last} >= {KEEP} AS kept FROM v, m{ROUNDS - 1}"
