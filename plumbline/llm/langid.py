"""Language identification by a linear-chain conditional random field over words.

A word's features are its hashed character n-grams (those that touch a word's end
are its affixes) and its membership in lexicons learned with the model. Learned
transition weights tie neighbouring words. Training sequences are stretches of
labelled texts of different languages set one after another, so that the field
learns how texts switch. Forward-backward gives every word's label probabilities;
a text gets the label with the most probability over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Words, portions, word_grams

#: Lengths of n-grams, hash buckets, most training texts of a language, words in a training sequence and in a stretch.
GRAMS, BUCKETS, SAMPLE, SEQUENCE, STRETCH = (2, 3, 4), 1 << 16, 200, 48, (4, 24)
STEPS, PENALTY = 60, 1e-5
#: Texts of so many bytes are labelled together.
PORTION = 2 << 20


@dataclass
class Field:
    labels: list[str]
    emit: np.ndarray  # (BUCKETS + one a lexicon, label)
    move: np.ndarray  # (label, label)
    lexicon: np.ndarray  # sorted word hashes
    member: np.ndarray  # the lexicon (label) of each


def features(words: Words, index: np.ndarray, lexicon: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row in ``index``, feature) of the words at ``index``."""
    owner, bucket = word_grams(words.joined(index), GRAMS, BUCKETS)
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, words.hash[index]), len(lexicon) - 1)
        known = np.flatnonzero(lexicon[at] == words.hash[index])
        owner, bucket = np.concatenate([owner, known]), np.concatenate([bucket, BUCKETS + member[at[known]]])
    return owner, bucket


def emissions(owner: np.ndarray, bucket: np.ndarray, emit: np.ndarray, n: int) -> np.ndarray:
    size = np.maximum(np.bincount(owner, minlength=n), 1)
    return np.stack([np.bincount(owner, weights=emit[bucket, j], minlength=n) for j in range(emit.shape[1])], 1) / np.sqrt(size)[:, None]


def forward_backward(score: np.ndarray, move: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label probabilities of every word, what its past says, what it and its future say).

    Sequence i has ``size[i]`` words from row ``first[i]``. All sequences advance together.
    """
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    e = np.exp(score - score.max(1, keepdims=True)) + 1e-300
    m = np.exp(move - move.max())
    ahead, back = np.empty_like(e), np.empty_like(e)
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1 if len(size) else 1), "right")  # sequences that have a word t
    a = None
    for t, n in enumerate(live):
        at = first[:n] + t
        a = e[at] if a is None else (a[:n] @ m) * e[at]
        a /= a.sum(1, keepdims=True)
        ahead[at] = a
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        b = np.ones((n, e.shape[1]))
        if t + 1 < len(live):
            n2 = live[t + 1]
            nxt = first[:n2] + t + 1
            b[:n2] = (back[nxt] * e[nxt]) @ m.T
            b[:n2] /= b[:n2].sum(1, keepdims=True)
        back[first[:n] + t] = b
    p = ahead * back
    return p / p.sum(1, keepdims=True), ahead, e * back


def stretches(first: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Every word of the texts once (text i has words first[i] to first[i + 1]): texts cut into stretches of random lengths, and the stretches shuffled."""
    n = int(first[-1])
    # cuts at random steps, and wherever a text ends
    steps = np.cumsum(rng.integers(*STRETCH, n // STRETCH[0] + 1))
    cuts = np.union1d(first, steps[steps < n])
    size = np.diff(cuts)
    order = rng.permutation(len(size))
    low, size = cuts[:-1][order], size[order]
    return np.repeat(low - np.cumsum(size) + size, size) + np.arange(n)


def fit(texts: list[str], labels: list[str], seed: int = 7) -> Field:
    """Fit to whole labelled texts; every word bears the label of its text.

    Lexicons count all words, and every word stands in a training sequence, in a stretch of its
    text among those of others. Empty texts add nothing.
    """
    names = sorted(set(labels))
    L = len(names)
    of_doc = np.array([names.index(x) for x in labels])
    words = Words(pa.array(texts, pa.large_string()))
    hashes, index, kind = np.unique(words.hash, return_index=True, return_inverse=True)
    label = of_doc[words.doc]
    # lexicons: words met at least thrice, at least nine times in ten under one label
    by = np.stack([np.bincount(kind[label == j], minlength=len(hashes)) for j in range(L)], 1)
    sure = (by.sum(1) >= 3) & (by.max(1) >= 0.9 * by.sum(1))
    lexicon, member = hashes[sure], by[sure].argmax(1)
    owner, bucket = features(words, index, lexicon, member)
    norm = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(hashes)), 1))
    # stretches end to end, cut into sequences of one length; the first words fill up the last
    flat = stretches(words.first, np.random.default_rng(seed)) if len(kind) else np.empty(0, np.int64)
    flat = np.resize(flat, -(-len(flat) // SEQUENCE) * SEQUENCE)
    k, y = kind[flat].reshape(-1, SEQUENCE), label[flat].reshape(-1, SEQUENCE)
    S = len(k)
    starts, sizes = np.arange(S) * SEQUENCE, np.full(S, SEQUENCE)
    emit, move = np.zeros((BUCKETS + L, L)), np.zeros((L, L))
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (emit, move)]
    truth = np.zeros((S * SEQUENCE, L))
    truth[np.arange(S * SEQUENCE), y.ravel()] = 1
    pairs = np.zeros((L, L))
    np.add.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    for step in range(1, STEPS + 1 if S else 1):
        score = emissions(owner, bucket, emit, len(hashes))[k.ravel()]
        p, past, future = forward_backward(score, move, starts, sizes)
        off = p - truth
        by_word = np.stack([np.bincount(k.ravel(), weights=off[:, j], minlength=len(hashes)) for j in range(L)], 1) * norm[:, None]
        g_emit = np.stack([np.bincount(bucket, weights=by_word[owner, j], minlength=BUCKETS + L) for j in range(L)], 1) / len(off) + PENALTY * emit
        past, future = past.reshape(S, SEQUENCE, L), future.reshape(S, SEQUENCE, L)
        joint = past[:, :-1, :, None] * future[:, 1:, None, :] * np.exp(move)
        joint /= joint.sum((2, 3), keepdims=True)
        g_move = (joint.sum((0, 1)) - pairs) / len(off) + PENALTY * move
        for x, g, (m1, m2) in zip((emit, move), (g_emit, g_move), state, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.02 * (g * g - m2)
            x -= 0.15 * np.sqrt(1 - 0.98**step) / (1 - 0.9**step) * m1 / (np.sqrt(m2) + 1e-9)
    return Field(names, emit.astype(np.float32), move, lexicon, member)


def label_texts(texts: pa.Array, field: Field) -> tuple[np.ndarray, np.ndarray, Words, np.ndarray]:
    """(label of each text, its probability, the words, label probabilities of every word)."""
    words = Words(texts)
    _, index, kind = np.unique(words.hash, return_index=True, return_inverse=True)
    owner, bucket = features(words, index, field.lexicon, field.member)
    score = emissions(owner, bucket, field.emit, len(index))[kind]
    size = words.first[1:] - words.first[:-1]
    full = np.flatnonzero(size > 0)
    p, _, _ = forward_backward(score, field.move, words.first[full], size[full])
    mean = np.stack([np.bincount(words.doc, weights=p[:, j], minlength=words.n_docs) for j in range(p.shape[1])], 1) / np.maximum(size, 1)[:, None]
    return mean.argmax(1), mean.max(1), words, p


def train(docs: DataFrame, sample: int = SAMPLE) -> Field | None:
    """Fit to at most ``sample`` texts of each language of ``docs`` (doc_id, text, lang), drawn by a hash of the id.

    Rows without text or lang are left out; of several rows of one id the least by language
    and text counts. None if no language is left.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    names = sorted(r.lang for r in rows.select("lang").distinct().collect())
    drawn = None
    for name in names:
        some = rows.where(F.col("lang") == name).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        drawn = some if drawn is None else drawn.union(some)
    if drawn is None:
        return None
    got = rows.join(F.broadcast(drawn.distinct()), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("doc_id", "r.*").collect()
    got.sort(key=lambda r: r.doc_id)
    return fit([r.text for r in got], [r.lang for r in got])


def predict(docs: DataFrame, field: Field | None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, lang_pred, score (0 to 1).

    A null text and one without a letter get ``und`` and 0, as does every text if there is
    no field. Repeated rows get equal answers; null ids pass through; an empty table gives
    no rows; other columns are never read.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letter"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, limit=PORTION):
                letter = part.column(2).to_numpy(zero_copy_only=False)
                if held.value is None or not letter.any():
                    names, score = np.full(len(letter), "und", object), np.zeros(len(letter))
                else:
                    best, score, _, _ = label_texts(part.column(1), held.value)
                    names, score = np.where(letter, np.array(held.value.labels, object)[best], "und"), np.where(letter, np.clip(score, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(task, "doc_id long, lang_pred string, score double")
