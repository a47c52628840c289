"""N-gram Jaccard join by grouped prefixes.

Texts become sets of hashed word shingles, ordered by how common a shingle is in
the whole table (rare ones first). Two sets with enough in common share a shingle
within the first part of either (prefix filter). Texts of one set are one node;
nodes of one prefix and size are one group, and groups, not nodes, meet by shared
prefix shingles. Group pairs that pass the filters on size, on the positions of what
they share and on parity bits of their members are expanded to those members, and
verified on whole sets.

Big families of near copies would give all their pairs, so they are collapsed first.
Members of a group are verified against its first; then, a few times over, the list of
each prefix shingle has a leader among the sets of about one size, and every group in
another component than its leader's is verified against it. Only then are all pairs
taken that pass the filters and still lie in different components; those of one
component are connected already. No pair that could change a component is left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_dir, packed, rows_of, saved, tasks_for, text_key
from .components import components
from .eliasfano import map_arrays, write_arrays
from .hashing import Words, mix, portions

#: Buckets in a file of counts; shingles that a task holds before it sends them.
BLOCK, HELD = 1 << 22, 4_000_000
#: Bits that tell sets apart before their texts are fetched.
PARITY = 512
#: So many ids at most are broadcast to fetch texts by id.
BROADCAST_IDS = 200_000
#: Pairs whose texts one task compares.
TEXTS = 1000
#: How often lists are collapsed on leaders before all pairs are taken; how many outside its largest component make a list worth a further round.
ROUNDS, FEW = 2, 8
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingles(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of runs of ``width`` words; with fewer words, the whole sequence as one."""
    w = Words(texts)
    n = len(w.hash) - width + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(width if n > 0 else 0):
        h = mix(h + w.hash[j : j + n] * _K[j % len(_K)])
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(h[a : b - width + 1]))
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for x in w.hash[a:b]:
                one = mix(one * _K[4] + x)
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> bytes:
    """16 bytes that stand for a set of shingles."""
    return np.array([mix(s * _K[1]).sum(dtype=np.uint64), mix(s + _K[2]).sum(dtype=np.uint64)], np.uint64).tobytes()


def parity(s: np.ndarray) -> list[int]:
    """PARITY bits, each the parity of the shingles that hash to it, as longs. Two sets differ in at least as many shingles as bits."""
    bits = np.bincount((mix(s ^ _K[3]) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def may_link(one: str, two: str, n1: Column, n2: Column, percent: int) -> Column:
    """False only where parity bits show that members of two groups differ in more shingles than similar sets can.

    Columns ``every`` and ``some`` with the suffixes ``one`` and ``two`` hold the bits that all
    members of a group have, and those that any has (null: the same).
    """

    def word(i: int) -> Column:
        (e1, s1), (e2, s2) = ((F.get(f"every{x}", F.lit(i)), F.get(F.coalesce(f"some{x}", f"every{x}"), F.lit(i))) for x in (one, two))
        return F.bit_count(e1.bitwiseAND(F.bitwise_not(s2)).bitwiseOR(e2.bitwiseAND(F.bitwise_not(s1))))

    differ = word(0)
    for i in range(1, PARITY // 64):
        differ = differ + word(i)
    return differ <= (n1 + n2) * (100 - percent) / (100 + percent) + 1e-6


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


class Counts:
    """How many sets of a table have a shingle of each bucket, up to 255, in files of BLOCK buckets in the shared folder.

    Files are mapped into memory when first asked for. Their number grows with the table,
    so that buckets stay about as many as shingles and rare ones can be told from others.
    """

    def __init__(self, folder: str, blocks: int):
        self.folder, self.blocks, self.at = folder, blocks, {}

    def bucket(self, s: np.ndarray) -> np.ndarray:
        return ((s >> np.uint64(24)) % np.uint64(self.blocks * BLOCK)).astype(np.int64)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        bucket = self.bucket(s)
        out = np.zeros(len(s), np.uint8)
        order = np.argsort(bucket)
        cut = np.searchsorted(bucket[order], np.arange(self.blocks + 1) * BLOCK)
        for i in np.flatnonzero(cut[1:] > cut[:-1]):
            if i not in self.at:
                self.at[i] = map_arrays(f"{self.folder}/{i:05d}")["n"]
            rows = order[cut[i] : cut[i + 1]]
            out[rows] = self.at[i][bucket[rows] - i * BLOCK]
        return out


@functools.lru_cache(maxsize=2)
def opened(folder: str, blocks: int) -> Counts:
    return Counts(folder, blocks)


def shingle_counts(docs: DataFrame, width: int) -> tuple[str, int]:
    """Count the shingles of all texts; (folder, number of blocks) of the files.

    Tasks send sorted bucket numbers as gaps, about a byte for each shingle.
    """
    spark = docs.sparkSession
    folder = new_dir(spark, "shingles")
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    blocks = max(1, docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (8 * BLOCK) + 1  # a shingle for some eight bytes
    table = Counts(folder, blocks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            b = np.sort(np.concatenate(held))
            cut = np.searchsorted(b, np.arange(blocks + 1) * BLOCK)
            for i in np.flatnonzero(cut[1:] > cut[:-1]):
                gaps = np.diff(b[cut[i] : cut[i + 1]] - i * BLOCK, prepend=0).astype("<u4")
                blob = zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int32()), pa.array([blob], pa.binary())], ["block", "gaps"])

        for batch in batches:
            for part in portions(batch):
                for s in shingles(part.column(0), width):
                    held.append(table.bucket(s))
                    size += len(s)
                if size >= HELD:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    def write(rows: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for x in rows.column("gaps").to_pylist():
            gaps = np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(4, -1).T).view("<u4").ravel()
            total += np.bincount(np.cumsum(gaps, dtype=np.int64), minlength=BLOCK)
        block = rows.column("block")[0].as_py()
        write_arrays(f"{folder}/{block:05d}", {"n": np.minimum(total, 255).astype(np.uint8)})
        return pa.table({"block": pa.array([block], pa.int32())})

    done = {r.block for r in saved(docs.select("text").mapInArrow(count, "block int, gaps binary").groupBy("block").applyInArrow(write, "block int")).collect()}
    for i in set(range(blocks)) - done:
        write_arrays(f"{folder}/{i:05d}", {"n": np.zeros(BLOCK, np.uint8)})
    return folder, blocks


def described(docs: DataFrame, width: int, percent: int, counted: tuple[str, int]) -> DataFrame:
    """(doc_id, key, n, node, gid, skip, prefix, bits): the text's hash, set size, set, group of equal prefix and size, the prefix's hashes, rarest first, and parity bits.

    The first ``skip`` hashes of a prefix, which one text alone has, are left out of it: nothing meets by them.
    """
    folder, blocks = counted

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = opened(folder, blocks)
        for batch in batches:
            for part in portions(batch):
                n, node, gid, skip, prefix, bits = [], [], [], [], [], []
                sets = shingles(part.column(1), width)
                counts = np.split(common(np.concatenate(sets)), np.cumsum([len(s) for s in sets])[:-1])
                for s, seen in zip(sets, counts, strict=True):
                    order = np.argsort(seen, kind="stable")  # s rises, so ties stand in order of hash
                    p = s[order[: prefix_size(len(s), percent)]] if len(s) else s
                    n.append(len(s))
                    node.append(set_key(s))
                    placed = np.append(p * _K[3] + np.arange(len(p), dtype=np.uint64), np.uint64(len(s)))
                    gid.append(int(mix(placed).sum(dtype=np.uint64).astype(np.int64)))
                    alone = int(np.count_nonzero(seen[order[: len(p)]] == 1)) if len(s) else 0
                    skip.append(alone)
                    prefix.append(p[alone:].tobytes())
                    bits.append(parity(s))
                cols = [part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(gid, pa.int64()), pa.array(skip, pa.int64()), pa.array(prefix, pa.binary()), pa.array(bits, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "n", "node", "gid", "skip", "prefix", "bits"])

    return docs.select("doc_id", "text", text_key(F.col("text")).alias("key")).mapInArrow(task, "doc_id long, key long, n long, node binary, gid long, skip long, prefix binary, bits array<long>")


def meet(units: DataFrame) -> DataFrame:
    """Prefix shingles that more than one of ``units`` (unit, n, skip, prefix) has, as rows (token, unit, n, pos, k); k is how many such hashes the unit has.

    Lists are dealt by range of (shingle, size, unit), so a shingle that very many share is
    spread over tasks; at a task's edges a row is kept whether or not it has company.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(3)]
            if not tokens:
                continue
            sizes = np.array([len(t) for t in tokens])
            rep = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(rep)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + b.column(2).to_numpy()[rep]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), b.column(0).take(pa.array(rep)), b.column(1).take(pa.array(rep)), pa.array(pos), pa.array(sizes[rep])], ["token", "unit", "n", "pos", "k"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, prev = None, True  # the last row waits for the next; whether the row before it is of its list (at the edge: maybe)
        for b in batches:
            if not b.num_rows:
                continue
            b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            token, m = b.column(0).to_numpy(), b.num_rows - 1
            same = token[1:] == token[:-1]
            before = np.concatenate([[prev], same])
            if m:
                yield b.slice(0, m).filter(pa.array(before[:m] | same))
            held, prev = b.slice(m, 1), bool(before[m])
        if held is not None:
            yield held

    kind = "token long, unit binary, n long, pos long, k long"
    rows = units.where("length(prefix) > 0").select("unit", "n", "skip", "prefix").mapInArrow(spread, kind)
    return rows.repartitionByRange("token", "n", "unit").sortWithinPartitions("token", "n", "unit").mapInArrow(scan, kind)


def sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int, tasks: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough, with their Jaccard similarity. ``tasks``: how many are enough for the nodes."""
    some = tasks_for(pairs, TEXTS)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().coalesce(tasks)
    wanted = packed(ends.join(nodes.select("node", "rep"), "node").select("node", F.col("rep").alias("doc_id")), tasks)
    ids = wanted.select("doc_id").distinct()
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in shingles(part.column(1), width)], pa.binary()), part.column(1)], ["node", "text"])

    # texts travel, not their sets: they are smaller, and a set is soon made
    held = docs.select("doc_id", "text").join(ids, "doc_id").mapInArrow(keyed, "node binary, text string")
    nameless = wanted.where("doc_id IS NULL").select("node")
    if not nameless.isEmpty():  # sets that only rows with a null id have: their texts are found by the set
        texts = docs.where("doc_id IS NULL").select("doc_id", "text").mapInArrow(keyed, "node binary, text string")
        held = held.union(texts.join(nameless, "node").groupBy("node").agg(F.first("text").alias("text")))
    both = (
        pairs.join(held.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
        .coalesce(some)
        .join(held.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        .select("a", "b", "x", "y")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in portions(batch, "x"):
                keep, how = [], []
                for x, y in zip(shingles(b.column(2), width), shingles(b.column(3), width), strict=True):
                    i = len(np.intersect1d(x, y, assume_unique=True))
                    u = len(x) + len(y) - i
                    keep.append(100 * i >= percent * u)
                    how.append(i / u if u else 0.0)
                rows = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(how, pa.float64())], ["a", "b", "jaccard"])
                yield rows.filter(pa.array(keep, pa.bool_()))

    return packed(both.mapInArrow(compare, "a binary, b binary, jaccard double"), some)


def merged(comps: DataFrame, links: DataFrame, key: str, tasks: int) -> DataFrame:
    """``comps`` (``key``, comp), for which ``tasks`` tasks are enough, after ``links`` (a, b) between keys: components that links join become one."""
    of = lambda x: comps.select(F.col(key).alias(x), F.col("comp").alias("c" + x))
    # however many links join two components, they count as one
    between = links.join(of("a"), "a").coalesce(tasks).join(of("b"), "b").coalesce(tasks).select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a != b").distinct()
    top = components(between, tasks).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    return saved(comps.join(top, "comp", "left").select(key, F.coalesce("top", "comp").alias("comp")).coalesce(tasks)).coalesce(tasks)


def similar(docs: DataFrame, width: int = 5, percent: int = 80, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Texts link when 100 * shared shingles >= ``percent`` * shingles of either; a component
    is what links reach, named by its smallest doc_id. A text without words has no shingles
    and its own doc_id as component. Texts of one set always link. Repeated rows repeat;
    null ids take part but name no component unless they are alone; an empty table gives no
    rows; other columns are ignored.
    """
    return joined(docs, width, percent, rounds).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def joined(docs: DataFrame, width: int, percent: int, rounds: int) -> DataFrame:
    """(doc_id, key, n, node, least, first): each row's text, set size, set, smallest doc_id of its component, and the least set that has it."""
    counted = shingle_counts(docs, width)
    base = saved(described(docs, width, percent, counted))
    fs, path = pa.fs.FileSystem.from_uri(counted[0])
    fs.delete_dir(path)  # what was made with them is kept
    nodes = saved(base.where("n > 0").groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "gid", "skip", "prefix", "bits")), F.min("doc_id").alias("rep")))
    # steps on short rows get tasks by their number; of a large table that is more than a shuffle makes, and changes nothing
    k = tasks_for(nodes)
    few = lambda df: df.coalesce(k)
    nodes = few(nodes)
    slim = nodes.select("node", "n", "rep")

    # the members of a group meet its first; what they link to is a unit of it
    many = nodes.groupBy("gid").agg(F.count("*").alias("k"), F.min("node").alias("head")).where("k > 1").select("gid", "head")
    own = packed(nodes.select("gid", "node").join(few(many), "gid").where("node > head").select(F.col("head").alias("a"), F.col("node").alias("b")), k)
    members = nodes.select("node", "gid", F.col("node").alias("comp"))
    if not own.isEmpty():
        members = merged(nodes.select("node", F.col("node").alias("comp")), verified(own, slim, docs, width, percent, k), "node", k)
        members = few(members.join(nodes.select("node", "gid"), "node"))
    words = range(PARITY // 64)
    every, some = (F.array(*(f(F.get("bits", F.lit(i))) for i in words)) for f in (F.bit_and, F.bit_or))
    units = saved(
        few(members.join(nodes.drop("gid"), "node"))
        .groupBy("gid", "comp")
        .agg(F.min("node").alias("unit"), *(F.first(c).alias(c) for c in ("n", "skip", "prefix")), every.alias("every"), F.when(F.count("*") > 1, some).alias("some"))
        .drop("gid", "comp")
        .coalesce(k)
    ).coalesce(k)
    of_unit = members.join(few(members.groupBy("gid", "comp").agg(F.min("node").alias("unit"))), ["gid", "comp"]).select("node", "unit") if not own.isEmpty() else slim.select("node", F.col("node").alias("unit"))
    of_unit = few(saved(few(of_unit)))
    # sets of about one size: similar ones lie in one band or in two that touch
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int")
    rows = packed(meet(units).withColumn("band", band))
    kr = max(k, tasks_for(rows))
    bits = units.select("unit", "every", "some")
    comps = units.select("unit", F.col("unit").alias("comp"))
    need = (F.col("n1") + F.col("n2")) * percent / (100 + percent) - 1e-6
    # what is shared before this place is no more than stands before it in either, what is shared from it on no more than stands there
    places_fit = F.least("pos1", "pos2") + F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2")) >= need
    fit = sizes_fit(F.col("n1"), F.col("n2"), percent) & places_fit
    bits_fit = may_link("1", "2", F.col("n1"), F.col("n2"), percent)
    named = lambda df, i, *names: df.select(*(F.col(c).alias(f"{c}{i}") for c in names))

    def apart() -> DataFrame:
        """The rows of lists that reach more than one component."""
        placed = rows.join(comps, "unit").coalesce(kr)
        lists = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
        return packed(placed.join(lists.coalesce(kr), "token"), kr)

    def largest(live: DataFrame) -> DataFrame:
        """The largest component of each list, and how many rows are not in it."""
        return live.groupBy("token", "comp").count().coalesce(kr).groupBy("token").agg(F.max(F.struct("count", "comp")).alias("m"), F.sum("count").alias("all")).select("token", F.col("m.comp").alias("main"), (F.col("all") - F.col("m.count")).alias("others"))

    for i in range(rounds):
        live = apart()
        # one of those with most to share, the same in many lists; later another in each list that has more than a few outside its largest component
        able = live if i == 0 else live.join(largest(live).where(f"others >= {FEW}"), "token")
        turn = F.lit(0).cast("long") if i == 0 else F.xxhash64("token", "unit", F.lit(i))
        first = able.groupBy("token", "band").agg(F.max(F.struct("k", turn.alias("turn"), "unit", "n", "pos", "comp")).alias("l"))
        first = first.select("token", F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1)))).alias("band"), *(F.col(f"l.{c}").alias(f"{c}1") for c in ("unit", "n", "pos", "comp")))
        other = live.select("token", "band", *(F.col(c).alias(f"{c}2") for c in ("unit", "n", "pos", "comp")))
        met = other.join(first.coalesce(kr), ["token", "band"]).where((F.col("comp1") != F.col("comp2")) & fit).select("unit1", "n1", "unit2", "n2").coalesce(kr).distinct().coalesce(kr)
        met = met.join(named(bits, 1, "unit", "every", "some"), "unit1").coalesce(kr).join(named(bits, 2, "unit", "every", "some"), "unit2").coalesce(kr).where(bits_fit)
        pairs = packed(met.select(F.least("unit1", "unit2").alias("a"), F.greatest("unit1", "unit2").alias("b")).distinct(), kr)
        if pairs.isEmpty():
            break
        comps = merged(comps, verified(pairs, slim, docs, width, percent, k), "unit", k)

    # all pairs of units that share a prefix shingle, but for those in one component already; one of a pair is always outside its list's largest component
    live = apart()
    main = largest(live).coalesce(kr)
    full = live.join(bits, "unit").coalesce(kr).select("token", "unit", "n", "pos", "comp", "every", "some")
    outside = full.join(main, "token").coalesce(kr).where("comp != main")
    swap = F.col("unit1") > F.col("unit2")
    names = ("token", "unit", "n", "pos", "comp", "every", "some")
    pairs = (
        named(full, 1, *names)
        .join(named(outside, 2, *names, "main"), F.col("token1") == F.col("token2"))
        .where((F.col("comp1") != F.col("comp2")) & ((F.col("comp1") == F.col("main2")) | (F.col("comp1") < F.col("comp2"))) & fit & bits_fit)
        .select(*(F.when(swap, F.col(f"{c}{3 - i}")).otherwise(F.col(f"{c}{i}")).alias(f"{c}{i}") for c in ("unit", "n", "pos") for i in (1, 2)))
        .groupBy("unit1", "unit2", "n1", "n2")
        .agg(F.count("*").alias("c"), F.max("pos1").alias("l1"), F.max("pos2").alias("l2"))
        .where(F.col("c") + F.least(F.col("n1") - F.col("l1"), F.col("n2") - F.col("l2")) - 1 >= need)
    )
    pairs = packed(pairs.select("unit1", "unit2"), kr)
    if not pairs.isEmpty():
        inside = nodes.select("node", "n", "bits").join(of_unit, "node")
        sides = (inside.select(F.col("unit").alias(f"unit{i}"), F.col("node").alias(x), F.col("n").alias(f"n{i}"), F.col("bits").alias(f"every{i}"), F.lit(None).cast("array<long>").alias(f"some{i}")) for i, x in ((1, "a"), (2, "b")))
        one, two = sides
        meets = (F.col("l.unit2") == F.col("r.unit2")) & may_link("1", "2", F.col("n1"), F.col("n2"), percent)
        across = pairs.join(one, "unit1").coalesce(kr).alias("l").join(two.alias("r"), meets).select("a", "b")
        more = verified(packed(across), slim, docs, width, percent, k)
        unit_of = lambda x: of_unit.select(F.col("node").alias(x), F.col("unit").alias("u" + x))
        comps = merged(comps, more.join(unit_of("a"), "a").coalesce(k).join(unit_of("b"), "b").select(F.col("ua").alias("a"), F.col("ub").alias("b")), "unit", k)

    last = few(few(of_unit.join(comps, "unit")).join(slim, "node").select("node", "rep", "comp"))
    least = saved(last.groupBy("comp").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("id"), F.col("node").alias("node"))).alias("l")).coalesce(k)).coalesce(k)
    named = few(last.select("node", "comp").join(least, "comp")).select("node", F.col("l.id").alias("least"), F.col("l.node").alias("first"))
    return base.select("doc_id", "key", "n", "node").join(named, "node", "left")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but for near copies: of each component the row with the smallest doc_id stays.

    Where that id has several texts in a component, or all its ids are null, those of one set
    stay; repeated rows share one fate. Rows without words stay. An empty table stays empty;
    all columns are kept, whatever their names.
    """
    placed = joined(docs, width, percent, ROUNDS)
    return rows_of(docs, placed.where("node <=> first AND doc_id <=> least OR n = 0"))
