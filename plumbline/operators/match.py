"""Fuzzy matching of recognised text to the label master.

A text's distance to a label is the least edit distance over the text's look-alike
variants. Texts and labels meet through a segment index: a label is cut into one piece
more than the edits allowed, so that one piece at least survives whole, at a place that
the number of edits before and after it bounds. Labels are often alike at the front;
cuts are therefore set by how much the characters at each place tell labels of one
length apart, and not at equal distances. The bounded edit distance decides.

Distinct forms are matched once, however many texts have them. The best few of a form
mostly lie within one or two edits: the search widens edit by edit, and forms that have
enough candidates drop out.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MATCH_MAX_DISTANCE, MATCH_MIN_LENGTH, MATCH_TOP
from ..functions.text import clean_code, match_form, trimmed, validation_error, variants
from .keep import saved
from .masters import with_ordinal

_K = MATCH_MAX_DISTANCE
_KEY = ["len", "part", "piece"]
#: Up to so many lengths of labels go to all tasks; more are joined.
_LENGTHS = 4096


def indexed(labels: DataFrame) -> DataFrame:
    """Labels (code) with their place in code order (the last tie-break) and their match form."""
    return with_ordinal(labels.select("code"), ["code"], "label_index").select("code", F.col("label_index").cast("int").alias("label_index"), match_form(F.col("code")).alias("label"))


def cuts(labels: DataFrame, pieces: int) -> DataFrame:
    """For each length of labels (label) of ``pieces`` characters or more: where the pieces start (from 0) and how long they are.

    Every piece has about the same share of what the characters tell (the entropy at their
    places, among labels of that length), and one character at least. Cuts only decide how many
    candidates there are; the result must be kept, as both sides of a search need the same.
    """
    chars = labels.select(F.length("label").alias("len"), F.posexplode(F.split("label", "")).alias("pos", "ch")).where((F.col("len") >= pieces) & (F.col("pos") < F.col("len")))
    seen = chars.groupBy("len", "pos", "ch").agg(F.count("*").alias("n"))
    told = seen.groupBy("len", "pos").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("bits"))
    upto = Window.partitionBy("len").orderBy("pos")
    told = told.withColumns({"before": F.sum("bits").over(upto) - F.col("bits"), "all": F.sum("bits").over(Window.partitionBy("len"))})
    # a piece begins with the first place before which its share has been told
    share = [F.count_if(F.col("before") < F.col("all") * j / pieces - 1e-9).alias(f"c{j}") for j in range(1, pieces)]
    found = told.groupBy("len").agg(*share) if share else told.select("len").distinct()
    starts = [F.lit(0)]
    for j in range(1, pieces):
        starts.append(F.greatest(starts[-1] + 1, F.least(F.col(f"c{j}"), F.col("len") - (pieces - j))))
    ends = [*starts[1:], F.col("len")]
    return found.select("len", F.array(*(s.cast("int") for s in starts)).alias("starts"), F.array(*((e - s).cast("int") for s, e in zip(starts, ends, strict=True))).alias("sizes"))


def _key(part: Column, piece: Column) -> Column:
    return F.struct(part.cast("int").alias("part"), piece.alias("piece"))


def _short_keys(c: Column, alone: Column) -> Column:
    """Keys for labels too short to be cut: every pair of strings within the radius in length matches (``alone``); a longer text shares a character."""
    chars = F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    return F.concat(F.when(alone, F.array(_key(F.lit(-2), F.lit("")))).otherwise(F.array().cast("array<struct<part:int,piece:string>>")), F.transform(chars, lambda x: _key(F.lit(-1), x)))


def _label_keys(labels: DataFrame, at: DataFrame, radius: int) -> DataFrame:
    """A row for each piece of each label: code, label_index, label, len, part, piece."""
    cut = labels.withColumn("len", F.length("label")).join(at, "len", "left")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda j: _key(j, F.substring("label", F.get("starts", j) + 1, F.get("sizes", j))))
    keys = F.when(F.col("starts").isNotNull(), pieces).otherwise(_short_keys(F.col("label"), F.lit(True)))
    return cut.select("code", "label_index", "label", "len", F.explode(keys).alias("k")).select("code", "label_index", "label", "len", "k.part", "k.piece")


def _text_keys(varied: DataFrame, at: DataFrame, radius: int) -> DataFrame:
    """A row for each piece of a label that a variant (form, heads, v) may hold, for each length in reach.

    Piece j has at most j edits before it and at most radius - j after it, if it is the
    first to survive with as few on either side; this bounds how far it can have moved.
    """
    near = varied.withColumns({"size": F.length("v"), "len": F.explode(F.sequence(F.greatest(F.lit(0), F.length("v") - radius), F.length("v") + radius))})
    cut = near.join(at, "len", "left")
    longer = F.col("size") - F.col("len")

    def of_piece(j: Column) -> Column:
        start, size = F.get("starts", j), F.get("sizes", j)
        low = F.greatest(-j, longer - (radius - j), -start)
        high = F.least(j, longer + (radius - j), F.col("size") - size - start)
        spots = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda m: _key(j, F.substring("v", start + m + 1, size)))

    pieces = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(radius)), of_piece)))
    alone = F.col("size") <= radius
    short = F.filter(_short_keys(F.col("v"), alone), lambda k: (k["part"] == -2) == alone)
    keys = F.when(F.col("starts").isNotNull(), pieces).when(F.col("len") <= radius, short)
    return cut.select("form", "heads", "v", "len", F.explode(keys).alias("k")).select("form", "heads", "v", "len", "k.part", "k.piece")


def _forms(texts: DataFrame) -> DataFrame:
    """Distinct texts that can match (text, form)."""
    return texts.select("text").distinct().where(F.length("text") >= MATCH_MIN_LENGTH).select("text", match_form(F.col("text")).alias("form"))


def within(forms: DataFrame, labels: DataFrame, radius: int = _K) -> DataFrame:
    """(form, code, label_index, label, distance, prefix, length_diff) for labels within ``radius`` edits of each distinct form."""
    at = saved(cuts(labels, radius + 1))
    if at.count() <= _LENGTHS:  # a row for each length that labels have
        at = F.broadcast(at)
    spread = 2 * forms.sparkSession.sparkContext.defaultParallelism  # few bytes, much work: not to be put together again
    f = forms.select("form").distinct().repartition(spread, "form").withColumn("vs", variants(F.col("form")))
    heads = F.array_distinct(F.transform(F.filter("vs", lambda v: F.length(v) >= 2), lambda v: F.substring(v, 1, 2)))
    varied = f.select("form", heads.alias("heads"), F.explode("vs").alias("v"))
    pairs = _text_keys(varied, at, radius).join(_label_keys(labels, at, radius), _KEY).withColumn("d", F.levenshtein("v", "label", radius)).where("d >= 0")
    prefix = (F.length("label") >= 2) & F.array_contains("heads", F.substring("label", 1, 2))
    return pairs.groupBy("form", "code", "label_index").agg(
        F.first("label").alias("label"), F.min("d").alias("distance"), F.max(prefix).alias("prefix"), F.first(F.abs(F.length("form") - F.length("label"))).alias("length_diff")
    )


def candidates(texts: DataFrame, labels: DataFrame, radius: int = _K) -> DataFrame:
    """(text, code, label_index, label, distance, prefix, length_diff) for labels within reach of each distinct text.

    ``texts`` has a column text. Texts of fewer than ``MATCH_MIN_LENGTH`` characters, as they
    stand, match nothing. The distance 0 is that of equal forms: case, spaces, hyphens and one
    look-alike are free.
    """
    t = _forms(texts)
    return within(t, labels, radius).join(t, "form").select("text", "code", "label_index", "label", "distance", "prefix", "length_diff")


def candidate_counts(texts: DataFrame, labels: DataFrame, radius: int = _K) -> DataFrame:
    """How many labels are within reach of each distinct text that has any, and how many of them share its head."""
    t = saved(_forms(texts))
    n = within(t, labels, radius).groupBy("form").agg(F.count("*").alias("n"), F.max("prefix").alias("any_prefix"), F.count_if("prefix").alias("with_prefix"))
    return t.join(n, "form").drop("form")


def ranked(found: DataFrame, by: str = "text") -> DataFrame:
    """Candidates in order of rank; where any shares the text's first two characters, only such are ranked."""
    by_text = Window.partitionBy(by)
    ordered = by_text.orderBy("distance", F.desc("prefix"), "length_diff", "label_index")
    best = found.withColumn("_any", F.max("prefix").over(by_text)).where("prefix OR NOT _any").drop("_any")
    return best.withColumns({"rank": F.row_number().over(ordered), "next_distance": F.lead("distance").over(ordered), "next_diff": F.lead("length_diff").over(ordered)})


def top(texts: DataFrame, labels: DataFrame, k: int = MATCH_TOP) -> DataFrame:
    """Up to k matches of each distinct text: text, rank, code, distance, is_exact, is_ambiguous.

    A text is ambiguous when its first two candidates tie in distance and length difference.
    """
    t = saved(_forms(texts))
    rest, found = t.select("form").distinct(), []
    for radius in range(1, _K + 1):
        near = saved(within(rest, labels, radius))
        if radius < _K:
            # where enough labels share the head and lie within this many edits, no other can come among the first
            settled = near.where("prefix").groupBy("form").agg(F.count("*").alias("_n")).where(f"_n >= {max(k, 2)}").select("form")
            found.append(near.join(settled, "form", "left_semi"))
            rest = saved(rest.join(settled, "form", "left_anti"))
        else:
            found.append(near)
    r = ranked(functools.reduce(DataFrame.unionByName, found), "form")
    tie = (F.col("rank") == 1) & (F.col("next_distance") == F.col("distance")) & (F.col("next_diff") == F.col("length_diff"))
    flag = F.max(F.coalesce(tie, F.lit(False))).over(Window.partitionBy("form"))
    best = r.withColumn("is_ambiguous", flag).where(F.col("rank") <= k).select("form", "rank", "code", "distance", (F.col("distance") == 0).alias("is_exact"), "is_ambiguous")
    return t.join(best, "form").drop("form")


def resolved(reads: DataFrame, labels: DataFrame, k: int = MATCH_TOP) -> DataFrame:
    """Each read text (raw, and whatever else, such as an id and a confidence) cleaned, validated and matched; blank ones are dropped.

    Adds raw_text, cleaned_code, is_valid, matched_label, match_distance (the largest integer without
    a match), is_exact, candidates (up to ``k``, joined by bars) and display_code in place of raw.
    """
    kept = reads.withColumns({"raw_text": trimmed(F.col("raw")), "cleaned_code": clean_code(F.col("raw"))}).where("raw_text != ''").drop("raw")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "code", "distance", "is_exact")))  # at most k
    best = top(kept.select(F.col("cleaned_code").alias("text")), labels, k).groupBy("text").agg(ordered.alias("_m")).withColumnRenamed("text", "_of")
    first = lambda name: F.get("_m", F.lit(0))[name]
    return kept.join(best, kept["cleaned_code"] == best["_of"], "left").withColumns(
        {
            "is_valid": validation_error(F.col("cleaned_code")).isNull(),
            "matched_label": first("code"),
            "match_distance": F.coalesce(first("distance"), F.lit(2147483647)),
            "is_exact": F.coalesce(first("is_exact"), F.lit(False)),
            "candidates": F.coalesce(F.array_join(F.transform("_m", lambda x: x["code"]), "|"), F.lit("")),
            "display_code": F.coalesce(first("code"), "cleaned_code"),
        }
    ).drop("_m", "_of")


def overlay_states(reads: DataFrame, labels: DataFrame) -> DataFrame:
    """Each read text with what the overlay shows of it (state): matched, unmatched, or tracking while it is blank."""
    texts = reads.withColumn("_text", clean_code(F.col("raw")))
    best = top(texts.where(trimmed(F.col("raw")) != "").select(F.col("_text").alias("text")), labels, 1).select(F.col("text").alias("_of"), "code")
    state = F.when(trimmed(F.col("raw")) == "", "tracking").when(F.col("code").isNull(), "unmatched").otherwise("matched")
    return texts.join(best, texts["_text"] == best["_of"], "left").withColumn("state", state).drop("_text", "_of", "code")
