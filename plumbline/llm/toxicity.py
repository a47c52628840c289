"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

The features of a text are the hashed character n-grams of its distinct words, words
marked at both ends. Each is scaled by the log ratio of its smoothed counts in toxic
and in clean training texts, and a logistic regression learns weights on the scaled
features. Being linear, the score of a text is a sum over its distinct words, so a
batch scores every distinct word once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Words, distinct_words, portions, word_grams

#: Lengths of n-grams, hash buckets, most training texts of each class, fitting steps, penalty.
GRAMS, BUCKETS, SAMPLE, STEPS, PENALTY = (3, 4, 5, 6), 1 << 18, 1500, 200, 1e-4
OUT = "doc_id long, score double, predicted int"


def fit(texts: list[str], labels: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights of the buckets and the bias; ``prior`` is the share of toxic texts to assume, whatever the sample's.

    Empty texts have no features and count in the bias; repeated texts count as often as they stand.
    """
    spaced, doc, word = distinct_words(Words(pa.array(texts, pa.large_string())))
    owner, bucket = (x.astype(np.int32) for x in word_grams(spaced, GRAMS, BUCKETS))
    n_words = max(int(word.max(initial=0)) + 1, 1)

    def counts(by_doc: np.ndarray) -> np.ndarray:
        by_word = np.bincount(word, weights=by_doc[doc], minlength=n_words)
        return np.bincount(bucket, weights=by_word[owner], minlength=BUCKETS)

    toxic, clean = counts(labels) + 1, counts(1 - labels) + 1
    ratio = np.log(toxic / toxic.sum()) - np.log(clean / clean.sum())
    scaled = ratio[bucket].astype(np.float32)
    v, bias = np.full(BUCKETS, 0.0), 0.0
    m1, m2, b1, b2 = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for step in range(1, STEPS + 1):
        by_word = np.bincount(owner, weights=scaled * v[bucket], minlength=n_words)
        z = np.bincount(doc, weights=by_word[word], minlength=len(texts)) + bias
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(texts)
        g = np.bincount(bucket, weights=scaled * np.bincount(word, weights=off[doc], minlength=n_words)[owner], minlength=BUCKETS) + PENALTY * v
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * off.sum(), 0.99 * b2 + 0.01 * off.sum() ** 2
        fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        v -= 0.02 * fix * m1 / (np.sqrt(m2) + 1e-10)
        bias -= 0.05 * fix * b1 / (np.sqrt(b2) + 1e-10)
    share = min(max(float(labels.mean()) if len(labels) else 0.5, 1e-6), 1 - 1e-6)
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    return (ratio * v).astype(np.float32), float(bias + np.log(prior / (1 - prior)) - np.log(share / (1 - share)))


def score_texts(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    spaced, doc, word = distinct_words(Words(texts))
    owner, bucket = word_grams(spaced, GRAMS, BUCKETS)
    by_word = np.bincount(owner, weights=weights[bucket], minlength=int(word.max(initial=0)) + 1)
    z = np.bincount(doc, weights=by_word[word], minlength=len(texts)) + bias
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fit to at most ``sample`` texts of each class of ``labels`` (doc_id, toxic), drawn by a hash of the id.

    Only the drawn ids are broadcast, never more than twice ``sample``, so the texts are
    not shuffled. Labels other than 0 and 1, and those of ids without a document, are left
    out; of several texts of one id the least counts. Without both classes the model says 0.5 throughout.
    """
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = rows.agg(F.avg("toxic").alias("a")).first()["a"]
    drawn = None
    for y in (0, 1):
        some = rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        drawn = some if drawn is None else drawn.union(some)
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect()
    got.sort(key=lambda r: r.doc_id)
    y = np.array([r.toxic for r in got], float)
    if not 0 < y.sum() < len(y):
        return np.zeros(BUCKETS, np.float32), 0.0
    return fit([r.text for r in got], y, share)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, score (0 to 1), predicted (1 from 0.5).

    A null or empty text has the score of its bias alone. Repeated rows score alike;
    null ids pass through; an empty table gives no rows; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                p = score_texts(part.column(1), *held.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(task, OUT)
