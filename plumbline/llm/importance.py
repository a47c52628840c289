"""Importance resampling towards a target: documents drawn by the gains of their hashed n-grams.

Words go through Arrow kernels: ``ascii_lower``, ``split_pattern_regex``, ``list_flatten``
and ``dictionary_encode``. An n-gram is a pair of dictionary indices, that of the n-gram
one word shorter and that of the word after it; pairs are dictionary-encoded again, so
the CRC of an n-gram is computed once for each distinct pair of a batch, from the CRCs of
its two parts. Gains are taken by bucket and summed over the segment of each document.

The texts are read twice: once for the counts of the buckets, which are summed within a
task before any shuffle, and once for the weights, which need the table of gains, one
number for each bucket whatever the size of the corpus. Only ids and numbers are sorted
for the draw.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.masters import with_ordinal
from .common import CRC_TABLE, UPPER, crc_sql, saved
from .hashing import portions

WIDTH, BUCKETS, PERCENT, SEED, MIN_WORDS = 3, 10_000, 5, 42, 20
#: ASCII characters that are neither letters nor digits stand between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _zero_byte() -> np.ndarray:
    """What one more zero byte makes of a CRC, for each value of each of its four bytes: 4 x 256."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    rest = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in (0, 1, 2)]
    return np.stack([c, *rest])


def _apply(step: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = step[0][crc & 255]
    for k in (1, 2, 3):
        out = out ^ step[k][(crc >> np.uint32(8 * k)) & 255]
    return out


_steps = [_zero_byte()]  # 1, 2, 4, ... zero bytes


def joined_crc(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings in a row, from the CRC of each and the second's size; CRCs are linear."""
    out, k = first.copy(), 0
    while (size >> k).any():
        if k == len(_steps):
            _steps.append(np.stack([_apply(_steps[-1], row) for row in _steps[-1]]))
        on = np.flatnonzero((size >> k) & 1)
        out[on] = _apply(_steps[k], out[on])
        k += 1
    return out ^ second


class Grams:
    """The n-grams of a batch of texts: for each length 1 to ``width`` the document and bucket of every one."""

    def __init__(self, texts: pa.Array, width: int = WIDTH, buckets: int = BUCKETS):
        # 32-bit offsets: the kernel takes slices of large strings from the wrong place, and a portion is short or one text
        lower = pc.ascii_lower(texts.cast(pa.string()).fill_null(""))
        lists = pc.split_pattern_regex(lower, BETWEEN)
        flat, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
        some = pc.not_equal(flat, "")
        coded, self.doc = flat.filter(some).dictionary_encode(), doc.filter(some).to_numpy(zero_copy_only=False)
        self.n_docs = len(texts)
        self.n_words = np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n_words = max(len(coded.dictionary), 1)
        raw = [w.encode("utf-8") for w in coded.dictionary.to_pylist()]
        size = np.array([len(w) for w in raw], np.int64)
        crc = np.array([zlib.crc32(w) for w in raw], np.uint32)
        space = joined_crc(np.full(len(raw), zlib.crc32(b" "), np.uint32), crc, size)  # of a space and the word
        #: (document, bucket) arrays, one pair for each length.
        self.runs = [(self.doc, (crc % buckets).astype(np.int64)[word])]
        gram, gram_crc = word, crc
        for n in range(2, width + 1):
            m = len(word) - n + 1
            if m <= 0:
                break
            # shifted indices: the n-gram one shorter that starts here, and the word that ends this one
            pairs = pa.array(gram[:m] * n_words + word[n - 1 :]).dictionary_encode()
            distinct = pairs.dictionary.to_numpy(zero_copy_only=False)
            left, right = distinct // n_words, distinct % n_words
            gram_crc = joined_crc(gram_crc[left], space[right], size[right] + 1)
            gram = pairs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            within = self.doc[:m] == self.doc[n - 1 :]
            self.runs.append((self.doc[:m][within], (gram_crc % buckets).astype(np.int64)[gram[within]]))

    def counts(self, buckets: int) -> np.ndarray:
        return sum(np.bincount(b, minlength=buckets) for _, b in self.runs)

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """The sum of gains of each document, a segment of each run."""
        out = np.zeros(self.n_docs, np.int64)
        for doc, bucket in self.runs:
            total = np.concatenate([[0], np.cumsum(gains[bucket])])
            ends = np.searchsorted(doc, np.arange(self.n_docs + 1))
            out += total[ends[1:]] - total[ends[:-1]]
        return out


def bucket_counts(texts: DataFrame, width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all n-grams of ``texts`` (text); a task sends at most one row for each bucket."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for part in portions(b):
                total += Grams(part.column(0), width, buckets).counts(buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return texts.select("text").mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, width: int = WIDTH, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log-ratio of each bucket's share in ``target`` to that in ``docs``, floored; one is added to every count."""
    both = bucket_counts(docs, width, buckets).withColumn("side", F.lit(0)).unionByName(bucket_counts(target, width, buckets).withColumn("side", F.lit(1)))
    count = np.zeros((2, buckets))
    for r in both.collect():  # at most two rows a bucket
        count[r["side"], r["bucket"]] = r["n"]
    s, t = count
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of ``docs`` (doc_id, text)."""
    buckets = len(gains)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b):
                g = Grams(part.column(1), width, buckets)
                features = sum(np.maximum(g.n_words - k, 0) for k in range(width))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(g.n_words), pa.array(features), pa.array(g.sums(gains))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a standard Gumbel variable, floored, fixed by seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, width: int = WIDTH, buckets: int = BUCKETS, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_features, weight, score, rank.

    Of the documents with ``min_words`` words or more, ``percent`` in a hundred are drawn, those
    with the highest scores (weight plus Gumbel noise: a draw without replacement by the
    weights); ``rank`` is their place, null for all others. Equal scores go to the smaller
    doc_id, a null id last; repeated rows have equal scores and stand next to each other. A
    null or empty text has no n-gram and weight 0. An empty table gives no rows, an empty
    target gains against an even spread. Other columns of either table are ignored.
    """
    gains = bucket_gains(docs, target, width, buckets)
    scored = saved(weighed(docs, gains, width).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    drawn = scored.where(F.col("n_words") >= min_words).count() * percent // 100
    order = {"_out": F.col("n_words") < min_words, "_down": -F.col("score"), "_last": F.col("doc_id").isNull()}
    placed = with_ordinal(scored.withColumns(order), [*order, "doc_id"], "_place")
    # documents that may be drawn come first in this order
    rank = F.when(F.col("_place") <= drawn, F.col("_place").cast("long"))
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def keep_drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id and rank of the documents drawn."""
    return resample(docs, target, percent, seed).where("rank IS NOT NULL").select("doc_id", "rank")


def oracle() -> str:
    """The query in DuckDB's SQL."""
    grams = lambda table, key: f"""SELECT {key} AS id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g
        FROM (SELECT *, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{BETWEEN}'), lambda x: x <> '') AS w FROM {table})"""  # noqa: E731
    h = f"('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT"
    return f"""
    WITH crc AS ({CRC_TABLE}),
    dg AS MATERIALIZED ({grams('documents', 'doc_id')}), tg AS ({grams('benchmark', 'item_id')}),
    g AS (SELECT g, sum(s) AS s, sum(t) AS t FROM (SELECT g, count(*) AS s, 0 AS t FROM dg GROUP BY g UNION ALL SELECT g, 0, count(*) FROM tg GROUP BY g) GROUP BY g),
    b AS MATERIALIZED (SELECT g, s, t, {crc_sql('g')} % {BUCKETS} AS bucket FROM g, crc),
    c AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t, (sum(sum(s)) OVER ())::DOUBLE AS al, (sum(sum(t)) OVER ())::DOUBLE AS tal FROM b GROUP BY bucket),
    gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (al + {BUCKETS}) / ((s + 1) * (tal + {BUCKETS}))))::BIGINT AS gain FROM c),
    w AS (SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM dg JOIN b USING (g) JOIN gain USING (bucket) GROUP BY id),
    r AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(({h} + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score,
                 len(list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{BETWEEN}'), lambda x: x <> '')) >= {MIN_WORDS} AS fit
          FROM documents LEFT JOIN w ON id = doc_id),
    k AS (SELECT *, CASE WHEN fit THEN row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) END AS place, (count(*) FILTER (WHERE fit) OVER ()) * {PERCENT} // 100 AS drawn FROM r)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM k
    """
