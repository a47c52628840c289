"""LM scoring with an Elias-Fano n-gram trie.

A trie of words, pairs and triples is counted from the training texts and written in
shards to the shared folder. Level one is the vocabulary: sorted 64-bit word hashes,
a word's id being its rank. Level two holds each word's successors, level three each
pair's; both are monotone sequences in Elias-Fano form, the numbers of a context
rising from where those of the context before it end, with monotone pointers from
each entry to its successors below. A triple's last word is stored by its place among
the successors of the middle word, which is what the search looks for. Probabilities
are smoothed by interpolated absolute discounting and quantised to 256 values a level
and shard. Scoring tasks map the shards into memory and look up a batch at a time.
The number of shards follows the bytes of text; triples have shards of their own, cut
by the counts of their pairs, so that a frequent first word spreads over several.

A word's hash stands for the word: two words of one hash (odds of 1 in 10^5 for ten
million words) would count as one. All pairs and triples are kept, once-seen ones
included; what the discount takes from each goes to the shorter context, so that every
context's probabilities sum to one.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_dir, saved
from .eliasfano import EliasFano, map_arrays, write_arrays
from .hashing import Words, mix, portions

_U = np.uint64
#: The hash of the end of a text.
END = mix(np.array([0xE0F], _U))[0]
#: Keys that a task holds before it adds up; bytes of text for each shard; most shards of words and pairs; occurrences of pairs for each shard of triples; bytes of text looked up together.
HELD, SHARD_BYTES, SHARDS, TRIPLES, PORTION = 4_000_000, 16 << 20, (1 << 16) - 1, 3_000_000, 2 << 20
BLOB = "shard int, keys binary, counts binary"


@dataclass(frozen=True)
class Model:
    folder: str
    shards: int
    bases: tuple[int, ...]  # id of each shard's first word, then the number of words
    tokens: int
    pair_bases: tuple[int, ...] = ()  # likewise for pairs
    rank_bits: int = 0  # bits for a word's place among the successors of another
    triple_bases: tuple[int, ...] = (0,)  # first pair of each shard of triples, then the number of pairs

    @property
    def vocabulary(self) -> int:
        return self.bases[-1]


def _squeeze(sorted_numbers: np.ndarray) -> bytes:
    """Gaps of a sorted sequence, byte by byte from the lowest, compressed."""
    gaps = np.diff(sorted_numbers, prepend=sorted_numbers.dtype.type(0)).view(np.uint8).reshape(-1, 8)
    return zstandard.compress(np.ascontiguousarray(gaps.T).tobytes(), 1)


def _expand(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(_U).ravel(), dtype=_U)


class Tally:
    """Counts 64-bit keys that rise with their shard; ``owner`` gives the shards of sorted keys."""

    def __init__(self, owner: Callable[[np.ndarray], np.ndarray]):
        self.owner, self.held, self.size = owner, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(keys)
        self.size += len(keys)
        if self.size >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys = np.sort(np.concatenate(self.held))
        self.held, self.size = [], 0
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        count, keys = np.diff(np.append(first, len(keys))).astype("<u4"), keys[first]
        shard = self.owner(keys)
        cut = np.flatnonzero(np.diff(shard, prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(shard)], strict=True):
            cols = [pa.array([int(shard[a])], pa.int32()), pa.array([_squeeze(keys[a:b])]), pa.array([zstandard.compress(count[a:b].tobytes(), 1)])]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "keys", "counts"])


def _bits(*sizes: int) -> None:
    if sum(sizes) > 64:
        raise OverflowError("the vocabulary or the number of pairs is too large for 64-bit keys")


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of a shard from the blobs of all tasks, added up as they come: no more is held than about twice the distinct keys."""
    key, count = np.empty(0, _U), np.empty(0, np.int64)
    held, size = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate([key, *(k for k, _ in held)]), np.concatenate([count, *(c for _, c in held)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(counts, first)

    for k, c in zip(table.column("keys"), table.column("counts"), strict=True):
        held.append((_expand(k.as_py()), np.frombuffer(zstandard.decompress(c.as_py()), "<u4").astype(np.int64)))
        size += len(held[-1][0])
        if size >= max(HELD // 4, len(key)):
            key, count = merged()
            held, size = [], 0
    return merged() if held else (key, count)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each number, 256 values): equally filled bins, each standing for its mean."""
    if not len(x):
        return np.empty(0, np.uint8), np.zeros(256, np.float32)
    edges = np.unique(np.quantile(x, np.linspace(0, 1, 257))[1:-1])
    code = np.searchsorted(edges, x, "right")
    book = np.bincount(code, weights=x, minlength=256) / np.maximum(np.bincount(code, minlength=256), 1)
    return code.astype(np.uint8), book.astype(np.float32)


def discount(count: np.ndarray) -> float:
    """Absolute discount from the numbers of things seen once and twice."""
    one, two = int((count == 1).sum()), int((count == 2).sum())
    return min(max(one / (one + 2 * two), 0.1), 0.95) if one else 0.5


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted numbers: the distinct ones, the first place of each, and which of them each is."""
    new = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.empty(0, bool)
    first = np.flatnonzero(new)
    return x[first], first, np.cumsum(new) - 1


def _rising(context: np.ndarray, number: np.ndarray, span: int) -> np.ndarray:
    return context.astype(_U) * _U(span) + number.astype(_U)


class Shard:
    """Views of one shard's words and pairs."""

    def __init__(self, folder: str, i: int, levels: int):
        a = map_arrays(f"{folder}/words-{i:05d}")
        self.hash, self.count = EliasFano(a, "hash"), a["count"]
        if levels >= 2:
            a = map_arrays(f"{folder}/pairs-{i:05d}")
            self.has, self.next, self.begin = EliasFano(a, "has"), EliasFano(a, "next"), EliasFano(a, "begin")
            self.span2, self.p2, self.book2, self.count2, self.back1, self.back1_book = int(a["span"][0]), a["p"], a["book"], a["count"], a["back"], a["back_book"]


class Triples:
    """Views of one shard of triples."""

    def __init__(self, folder: str, i: int):
        a = map_arrays(f"{folder}/triples-{i:05d}")
        self.has, self.next = EliasFano(a, "has"), EliasFano(a, "next")
        self.span, self.p, self.book, self.back, self.back_book = int(a["span"][0]), a["p"], a["book"], a["back"], a["back_book"]


def _grouped(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that occurs, with its rows."""
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    for i in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        yield i, order[cut[i] : cut[i + 1]]


@functools.lru_cache(maxsize=4)
def opened(model: Model, levels: int) -> "Trie":
    return Trie(model, levels)


class Trie:
    """The shards of a model up to some level, mapped when first needed."""

    def __init__(self, model: Model, levels: int):
        self.model, self.levels = model, levels
        self.bases = np.array(model.bases, np.int64)
        self.triple_bases = np.array(model.triple_bases, np.int64)
        self.at: dict[int, Shard] = {}
        self.third: dict[int, Triples] = {}

    def shard(self, i: int) -> Shard:
        if i not in self.at:
            self.at[i] = Shard(self.model.folder, i, self.levels)
        return self.at[i]

    def by_shard(self, shard: np.ndarray) -> Iterator[tuple[Shard, int, np.ndarray]]:
        for i, rows in _grouped(shard, self.model.shards):
            yield self.shard(i), i, rows

    def words(self, hashes: np.ndarray) -> dict[str, np.ndarray]:
        """Of each hash: id (-1 for a word that is not in the vocabulary), count, shard, and place of the word among those with successors (-1: none)."""
        n = len(hashes)
        out = {"id": np.full(n, -1, np.int64), "count": np.zeros(n, np.int64), "shard": shard_of(hashes, self.model.shards), "context": np.full(n, -1, np.int64)}
        for s, i, rows in self.by_shard(out["shard"]):
            at = s.hash.find(hashes[rows])
            ok = at >= 0
            rows, at = rows[ok], at[ok]
            out["id"][rows] = at + self.bases[i]
            out["count"][rows] = s.count[at]
            if self.levels >= 2:
                out["context"][rows] = s.has.find(at.astype(_U))
        return out

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        for s, i, rows in self.by_shard(np.searchsorted(self.bases, ids, "right") - 1):
            out[rows] = s.count[ids[rows] - self.bases[i]]
        return out

    def pairs(self, shard: np.ndarray, context: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        """For words (shard, context) and b (ids, -1 none) after them: place of the pair in its shard, place among the first word's successors, log10 p, log10 weight of the shorter context."""
        n = len(b)
        out = {"at": np.full(n, -1, np.int64), "rank": np.full(n, -1, np.int64), "p": np.zeros(n), "back": np.zeros(n)}
        known = np.flatnonzero(context >= 0)
        for s, _, some in self.by_shard(shard[known]):
            rows = known[some]
            c = context[rows]
            out["back"][rows] = s.back1_book[s.back1[c]]
            ok = b[rows] >= 0
            rows, c = rows[ok], c[ok]
            at = s.next.find(_rising(c, b[rows], s.span2))
            ok = at >= 0
            rows, c, at = rows[ok], c[ok], at[ok]
            out["at"][rows] = at
            out["rank"][rows] = at - s.begin.get(c).astype(np.int64)
            out["p"][rows] = s.book2[s.p2[at]]
        return out

    def triples(self, shard: np.ndarray, at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For pairs at places ``at`` of shards and the place ``rank`` of a third word among the second's successors: (found, log10 p, log10 weight of the pair's shorter context)."""
        n = len(at)
        found, p, back = np.zeros(n, bool), np.zeros(n), np.zeros(n)
        known = np.flatnonzero(at >= 0)
        pair = np.array(self.model.pair_bases, np.int64)[shard[known]] + at[known]
        for i, some in _grouped(np.searchsorted(self.triple_bases, pair, "right") - 1, len(self.triple_bases) - 1):
            if i not in self.third:
                self.third[i] = Triples(self.model.folder, i)
            s, rows = self.third[i], known[some]
            c = s.has.find((pair[some] - self.triple_bases[i]).astype(_U))
            ok = c >= 0
            rows, c = rows[ok], c[ok]
            back[rows] = s.back_book[s.back[c]]
            ok = rank[rows] >= 0
            rows, c = rows[ok], c[ok]
            k = s.next.find(_rising(c, rank[rows], s.span))
            ok = k >= 0
            found[rows[ok]] = True
            p[rows[ok]] = s.book[s.p[k[ok]]]
        return found, p, back


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the hash, so that ids rise with the shard."""
    return (((hashes >> _U(32)) * _U(shards)) >> _U(32)).astype(np.int64)


def sequences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every token of a batch: each text's words, then its end."""
    n = words.n_docs
    at = np.arange(len(words.hash)) + words.doc
    hashes, doc = np.full(len(words.hash) + n, END, _U), np.empty(len(words.hash) + n, np.int64)
    hashes[at], doc[at] = words.hash, words.doc
    ends = words.first[1:] + np.arange(n)
    doc[ends] = np.arange(n)
    return hashes, doc


def looked_up(trie: Trie, words: Words) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(what ``Trie.words`` says of every token, text of each)."""
    hashes, doc = sequences(words)
    kinds, back = np.unique(hashes, return_inverse=True)
    got = trie.words(kinds)
    return {k: v[back] for k, v in got.items()}, doc


def build(docs: DataFrame, shards: int | None = None) -> Model:
    """Train on ``docs`` (text): three counting jobs, each writing one level of every shard.

    A null text is an empty one, and an empty text counts an end alone; repeated rows count as often
    as they stand; other columns are ignored. An empty table gives a model without words.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    S = shards or min(SHARDS, max(1, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES)))
    folder = new_dir(spark, "lm")
    pa.fs.FileSystem.from_uri(folder)[0].create_dir(pa.fs.FileSystem.from_uri(folder)[1], recursive=True)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(lambda k: shard_of(k, S))
        for batch in batches:
            for part in portions(batch):
                yield from tally.add(sequences(Words(part.column(0)))[0])
        yield from tally.flush()

    def write_words(table: pa.Table) -> pa.Table:
        i = table.column("shard")[0].as_py()
        key, count = _summed(table)
        write_arrays(f"{folder}/words-{i:05d}", EliasFano.build(key, "hash") | {"count": count})
        return pa.table({"shard": [i], "n": [len(key)], "total": [int(count.sum())]}, schema=pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("total", pa.int64())]))

    done = {r.shard: r for r in saved(texts.mapInArrow(count_words, BLOB).groupBy("shard").applyInArrow(write_words, "shard int, n long, total long")).collect()}
    bases = [0]
    for i in range(S):  # shards without a word get an empty level
        bases.append(bases[-1] + (done[i].n if i in done else 0))
        if i not in done:
            write_arrays(f"{folder}/words-{i:05d}", EliasFano.build(np.empty(0, _U), "hash") | {"count": np.empty(0, np.int64)})
    model = Model(folder, S, tuple(bases), sum(r.total for r in done.values()))
    uniform = model.tokens + model.vocabulary + 1

    bits = model.vocabulary.bit_length()
    _bits(bits, bits)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = opened(model, 1)
        tally = Tally(lambda k: np.searchsorted(trie.bases, (k >> _U(bits)).astype(np.int64), "right") - 1)
        for batch in batches:
            for part in portions(batch, limit=PORTION):
                got, doc = looked_up(trie, Words(part.column(0)))
                ids = got["id"]
                ok = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (doc[1:] == doc[:-1]))
                yield from tally.add((ids[ok].astype(_U) << _U(bits)) | ids[ok + 1].astype(_U))
        yield from tally.flush()

    def write_pairs(table: pa.Table) -> pa.Table:
        i, trie = table.column("shard")[0].as_py(), opened(model, 1)
        key, count = _summed(table)
        d = discount(count)
        a, b = (key >> _U(bits)).astype(np.int64) - trie.bases[i], (key & _U((1 << bits) - 1)).astype(np.int64)
        heads, first, context = _runs(a)
        total = trie.shard(i).count[heads]
        own = (count - d) / total[context]
        back = np.maximum(1 - np.bincount(context, weights=own, minlength=len(heads)), 1e-9)
        lower = (trie.counts_of(b) + 1) / uniform
        p, book = quantise(np.log10(own + back[context] * lower))
        weight, weight_book = quantise(np.log10(back))
        write_arrays(
            f"{folder}/pairs-{i:05d}",
            EliasFano.build(heads.astype(_U), "has")
            | EliasFano.build(_rising(context, b, model.vocabulary), "next")
            | EliasFano.build(np.append(first, len(key)).astype(_U), "begin")
            | {"span": np.array([model.vocabulary]), "p": p, "book": book, "count": count.astype("<u4"), "back": weight, "back_book": weight_book},
        )
        most = int(np.bincount(context).max(initial=0)) if len(context) else 0
        cuts = np.flatnonzero(np.diff((np.cumsum(count) - count) // TRIPLES, prepend=-1)).tolist()
        return pa.table({"shard": pa.array([i], pa.int32()), "n": pa.array([len(key)], pa.int64()), "most": pa.array([most], pa.int64()), "cuts": pa.array([cuts], pa.list_(pa.int64()))})

    def fill(name: str, n: int, done: set[int], extra: dict[str, np.ndarray]) -> None:
        empty = np.empty(0, _U)
        for i in set(range(n)) - done:
            arrays = EliasFano.build(empty, "has") | EliasFano.build(empty, "next") | {"span": np.array([1]), "p": np.empty(0, np.uint8), "book": np.zeros(256, np.float32), "back": np.empty(0, np.uint8), "back_book": np.zeros(256, np.float32)}
            write_arrays(f"{folder}/{name}-{i:05d}", arrays | extra)

    made = saved(texts.mapInArrow(count_pairs, BLOB).groupBy("shard").applyInArrow(write_pairs, "shard int, n long, most long, cuts array<long>")).collect()
    fill("pairs", S, {r.shard for r in made}, EliasFano.build(np.empty(0, _U), "begin") | {"count": np.empty(0, "<u4")})

    held = {r.shard: r.n for r in made}
    pair_bases = (0, *itertools.accumulate(held.get(i, 0) for i in range(S)))
    triple_bases = (*(pair_bases[r.shard] + c for r in sorted(made) for c in r.cuts), pair_bases[-1])
    model = replace(model, pair_bases=pair_bases, triple_bases=triple_bases, rank_bits=max((r.most for r in made), default=0).bit_length())
    _bits(pair_bases[-1].bit_length(), model.rank_bits)
    rank_bits = _U(model.rank_bits)

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, base = opened(model, 2), np.array(pair_bases, np.int64)
        tally = Tally(lambda k: np.searchsorted(trie.triple_bases, (k >> rank_bits).astype(np.int64), "right") - 1)
        for batch in batches:
            for part in portions(batch, limit=PORTION):
                got, doc = looked_up(trie, Words(part.column(0)))
                at, rank = paired(trie, got, doc)[:2]
                ok = np.flatnonzero((at[1:-1] >= 0) & (rank[2:] >= 0)) + 2 if len(at) > 2 else np.empty(0, np.int64)
                pair = base[got["shard"][ok - 2]] + at[ok - 1]
                yield from tally.add((pair.astype(_U) << rank_bits) | rank[ok].astype(_U))
        yield from tally.flush()

    def write_triples(table: pa.Table) -> pa.Table:
        i, trie = table.column("shard")[0].as_py(), opened(model, 2)
        key, count = _summed(table)
        d = discount(count)
        # all pairs of a shard of triples are of one shard of pairs
        j = int(np.searchsorted(np.array(pair_bases, np.int64), triple_bases[i], "right")) - 1
        s, start = trie.shard(j), triple_bases[i] - pair_bases[j]
        pair, rank = (key >> rank_bits).astype(np.int64) - triple_bases[i], (key & _U((1 << model.rank_bits) - 1)).astype(np.int64)
        heads, _, context = _runs(pair)
        own = (count - d) / s.count2[heads + start][context]
        back = np.maximum(1 - np.bincount(context, weights=own, minlength=len(heads)), 1e-9)
        # p of the third word after the second alone, from the second's shard
        middle = (s.next.get(pair + start) % _U(s.span2)).astype(np.int64)
        lower = np.zeros(len(pair))
        for t, j, rows in trie.by_shard(np.searchsorted(trie.bases, middle, "right") - 1):
            c = t.has.find((middle[rows] - trie.bases[j]).astype(_U))
            lower[rows] = t.book2[t.p2[t.begin.get(c).astype(np.int64) + rank[rows]]]
        p, book = quantise(np.log10(own + back[context] * 10.0**lower))
        weight, weight_book = quantise(np.log10(back))
        span = int(rank.max(initial=0)) + 1
        write_arrays(
            f"{folder}/triples-{i:05d}",
            EliasFano.build(heads.astype(_U), "has")
            | EliasFano.build(_rising(context, rank, span), "next")
            | {"span": np.array([span]), "p": p, "book": book, "back": weight, "back_book": weight_book},
        )
        return pa.table({"shard": pa.array([i], pa.int32()), "n": pa.array([len(key)], pa.int64())})

    made = saved(texts.mapInArrow(count_triples, BLOB).groupBy("shard").applyInArrow(write_triples, "shard int, n long")).collect()
    fill("triples", len(triple_bases) - 1, {r.shard for r in made}, {})
    return model


def paired(trie: Trie, got: dict[str, np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token with the one before it: place of the pair, rank, log10 p, log10 weight; -1 and 0 at a text's first."""
    n = len(doc)
    at, rank, p, back = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n), np.zeros(n)
    if n > 1:
        before = np.where(doc[1:] == doc[:-1], got["context"][:-1], -1)
        pair = trie.pairs(got["shard"][:-1], before, got["id"][1:])
        at[1:], rank[1:], p[1:], back[1:] = pair["at"], pair["rank"], pair["p"], pair["back"]
    return at, rank, p, back


def score_tokens(trie: Trie, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, count in training, base log10 p, model log10 p) of every token."""
    got, doc = looked_up(trie, words)
    base = np.log10((got["count"] + 1) / (trie.model.tokens + trie.model.vocabulary + 1))
    at, rank, p2, back1 = paired(trie, got, doc)
    p = np.where(at >= 0, p2, back1 + base)
    if len(doc) > 2:
        pair = np.where(doc[2:] == doc[1:-1], at[1:-1], -1)
        found, p3, back2 = trie.triples(got["shard"][:-2], pair, rank[2:])
        p[2:] = np.where(found, p3, back2 + p[2:])
    return doc, got["count"], base, p


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is its end alone. Repeated rows score alike; null ids pass through;
    an empty table gives no rows; other columns are ignored. With nothing to train on, every
    token is unknown.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = opened(model, 3)
        for batch in batches:
            for part in portions(batch, limit=PORTION):
                doc, counts, base, p = score_tokens(trie, Words(part.column(1)))
                add = lambda x: np.bincount(doc, weights=x, minlength=part.num_rows)  # noqa: E731, B023
                cols = [pa.array(np.bincount(doc, minlength=part.num_rows)), pa.array(add(counts > 0).astype(np.int64)), pa.array(np.full(part.num_rows, model.tokens)), pa.array(add(base)), pa.array(add(p))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(task, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
