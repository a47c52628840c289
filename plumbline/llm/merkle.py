"""Merkle manifest of a table: a proof for every row, by butterfly exchange.

Rows of a source stand in order of id and are hashed to leaves; every ``fan`` nodes in a
row become one, until one is left, and the sources' roots become one root the same way.

Leaves are dealt into blocks of fan ** height, aligned to the tree. A block hashes its own
subtree. Then blocks swap roots in rounds: in round r, blocks whose numbers differ in
digit r (base ``fan``) alone give each other the ancestor they hold, and each of them hashes
the next ancestor for itself. After the last round every block holds the root and the
siblings above it, so nothing has to travel down again. A block takes part in a round as
one short row; where the last group is not full, its members serve several partners in turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CRC_TABLE, crc_sql, packed, saved

#: Nodes that become one, and levels of the tree within a block.
FAN, HEIGHT = 3, 6
_PATH = "array<struct<before:string,after:string>>"
_TREE = ["known", "name"]


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(*values: Column) -> Column:
    """Hash of a row: each value as its UTF-8 byte count, a colon and itself, or ``-`` for a null."""
    text = [v.cast("string") for v in values]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text))


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, node, lambda a, s: digest(s["before"], a, s["after"]))


def siblings(path: Column) -> Column:
    """All siblings in a row, level by level, each level from left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``place`` (from 0) in their tree and its size ``n``, without gathering a tree: sorted ranges, and a count for each tree in each."""
    by = [*_TREE, *order]
    ranged = saved(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id()))
    # the lower 33 bits of these ids are a row's place in its partition
    ranged = ranged.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    runs = ranged.groupBy("_range", *_TREE).agg(F.min("_at").alias("_first"), F.count("*").alias("_many"))
    tree = Window.partitionBy(*_TREE)  # as many rows as ranges, at most
    before = F.coalesce(F.sum("_many").over(tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_range", *_TREE, (before - F.col("_first")).alias("_shift"), F.sum("_many").over(tree).alias("n"))
    return ranged.join(runs, ["_range", *_TREE]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")


def raised(nodes: list[str], fan: int) -> list[str]:
    return [hashlib.sha256("".join(nodes[i : i + fan]).encode()).hexdigest() for i in range(0, len(nodes), fan)]


def levels_of(nodes: list[str], n: int, fan: int, height: int) -> list[list[str]]:
    """A block's levels, from its leaves to the node it gives up: ``height`` steps, or to a single node where the block is the whole tree."""
    out = [nodes]
    alone = n <= fan**height
    while len(out[-1]) > 1 if alone else len(out) <= height:
        out.append(raised(out[-1], fan))
    return out


def exchanged(blocks: DataFrame, fan: int) -> DataFrame:
    """Blocks (known, name, block, n_blocks, node) with the path above each (array of before, after) and ``node`` the tree's root."""
    state = packed(blocks.withColumn("path", F.array().cast(_PATH)))
    n, span = state.agg(F.coalesce(F.max("n_blocks"), F.lit(1))).first()[0], 1
    key = [*_TREE, "block"]
    while span < n:
        many = F.ceil(F.col("n_blocks") / span)  # nodes on this level
        own = F.floor(F.col("block") / span)
        run = F.floor(own / fan) * fan
        busy = state.where(many > 1)
        # the partner in another part of the group has the same lower digits; a part that is not full serves them in turn
        other = busy.select(*key, "n_blocks", own.alias("own"), many.alias("many"), F.explode(F.sequence(run, run + (fan - 1))).alias("at")).where("at <> own AND at < many")
        start = F.col("at") * span
        partner = start + (F.col("block") % span) % F.least(F.lit(span), F.col("n_blocks") - start)
        asked = other.select(*key, "own", "at", partner.cast("long").alias("_partner"))
        held = state.select(*_TREE, F.col("block").alias("_partner"), F.col("node").alias("_node"))
        got = asked.join(held, [*_TREE, "_partner"]).groupBy(*key).agg(
            *(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(side, F.struct("at", "_node")))), lambda s: s["_node"]), "").alias(name) for name, side in (("_before", F.col("at") < F.col("own")), ("_after", F.col("at") > F.col("own"))))
        )  # at most fan - 1 rows a block
        none = F.lit("")
        met = state.join(got, key, "left").withColumns({"_before": F.coalesce("_before", none), "_after": F.coalesce("_after", none)})
        step = F.array(F.struct(F.col("_before").alias("before"), F.col("_after").alias("after"))).cast(_PATH)
        state = packed(
            met.select(
                *key,
                "n_blocks",
                F.when(many > 1, digest("_before", "node", "_after")).otherwise(F.col("node")).alias("node"),
                F.when(many > 1, F.concat("path", step)).otherwise(F.col("path")).alias("path"),
            )
        )
        span *= fan
    return state


def trees(rows: DataFrame, order: list[str], carried: list[str], fan: int, height: int) -> tuple[DataFrame, DataFrame]:
    """(blocks with their members, blocks with the paths above them) of the trees over ``rows`` (known, name, node)."""
    size = fan**height
    member = F.struct("place", "node", *carried)
    blocks = saved(
        placed(rows, order).groupBy(*_TREE, "n", F.floor(F.col("place") / size).alias("block")).agg(F.sort_array(F.collect_list(member)).alias("m"))  # at most ``size`` members
    )

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = [levels_of(m, n, fan, height)[-1][0] for m, n in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(5), pa.array(nodes, pa.string())], [*_TREE, "block", "n_blocks", "node"])

    lower = blocks.select(*_TREE, "block", F.col("m.node").alias("nodes"), "n", F.ceil(F.col("n") / size).alias("n_blocks"))
    return blocks, exchanged(lower.mapInArrow(tops, "known boolean, name string, block long, n_blocks long, node string"), fan)


def opened(blocks: DataFrame, carried: dict[str, str], fan: int, height: int) -> DataFrame:
    """A row for each member of the blocks (m, n, path, top, and columns of strings ``carried`` by member): node, path, top and what it carries."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                nodes, n, upper, top = (one.column(k)[0].as_py() for k in range(4))
                levels = levels_of(nodes, n, fan, height)
                paths = []
                for k in range(len(nodes)):
                    steps, at = [], k
                    for level in levels[:-1]:
                        low = at - at % fan
                        steps.append({"before": "".join(level[low:at]), "after": "".join(level[at + 1 : low + fan])})
                        at //= fan
                    paths.append(steps + upper)
                path = pa.array(paths, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))
                rest = [one.column(4 + k).flatten() for k in range(len(carried))]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), path, pa.array([top] * len(nodes), pa.string()), *rest], ["node", "path", "top", *carried])

    members = blocks.select(F.col("m.node").alias("nodes"), "n", "path", "top", *(F.col(f"m.{c}").alias(c) for c in carried))
    return members.mapInArrow(task, ", ".join(["node string", f"path {_PATH}", "top string", *(f"{c} {t}" for c, t in carried.items())]))


def manifest(docs: DataFrame, fan: int = FAN, height: int = HEIGHT, other: Column | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, lang, n_chars, text): doc_id, source, leaf, subroot, root, path, other.

    ``path`` holds the siblings on the way to the root: before and after the node, level by
    level, ``source``'s tree first and then that over the sources, a null source first.
    ``subroot`` is the root of the source's tree. ``other``, a string for each row (such as
    the leaf of another version of it), is handed through. A null in any column has a mark of
    its own in the leaf. In a source a null id comes first; rows of one id follow each other by
    leaf, and repeated rows hold the same leaf at different places. An empty table gives
    no rows; a table of one row has its leaf as root and an empty path. Other columns
    are ignored, whatever their names.
    """
    c = [F.col(k) for k in ("doc_id", "source", "lang", "n_chars", "text")]
    rows = docs.select(
        c[1].isNotNull().alias("known"), F.coalesce(c[1], F.lit("")).alias("name"), leaf(*c).alias("node"), c[0].alias("id"), (F.lit(None) if other is None else other).cast("string").alias("other")
    )
    # kept, as ranges are drawn from a first reading; the number parts repeated rows
    rows = saved(rows).withColumn("row", F.monotonically_increasing_id())
    blocks, above = trees(rows, ["id", "node", "row"], ["id", "other"], fan, height)

    # the sources' roots are the leaves of one more tree
    tops = above.where("block = 0").select(F.lit(True).alias("known"), F.lit("").alias("name"), F.col("known").alias("is_named"), F.col("name").alias("source"), "node")
    source_blocks, over = trees(tops, ["is_named", "source"], ["is_named", "source"], fan, height)
    key = [*_TREE, "block"]
    over = opened(source_blocks.join(over.select(*key, "path", F.col("node").alias("top")), key), {"is_named": "boolean", "source": "string"}, fan, height)
    over = saved(over.select(F.col("is_named").alias("known"), F.col("source").alias("name"), F.col("node").alias("subroot"), F.col("path").alias("over"), F.col("top").alias("root")))

    # by source, only one short row a block; what a row of the result shares with its block goes in as one string
    shared = F.concat("subroot", "root", F.when(F.col("known"), F.concat(F.lit("+"), "name")).otherwise("-"))
    above = above.join(over, _TREE).select(*key, F.concat("path", "over").alias("path"), shared.alias("top"))
    rows = opened(blocks.join(above, key), {"id": "long", "other": "string"}, fan, height)
    source = F.when(F.substring("top", 129, 1) == "+", F.substring(F.col("top"), F.lit(130), F.length("top")))
    return rows.select(
        F.col("id").alias("doc_id"), source.alias("source"), F.col("node").alias("leaf"), F.substring("top", 1, 64).alias("subroot"), F.substring("top", 65, 64).alias("root"), "path", "other"
    )


def check(rows: DataFrame, node: Column) -> DataFrame:
    """A manifest's rows with proof_sha256 (of the siblings in a row), folded_root (from ``node`` and the siblings) and verified."""
    out = rows.withColumns({"proof_sha256": F.sha2(siblings(F.col("path")), 256), "folded_root": folded(node, F.col("path"))})
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(t: str, nodes: str, levels: int) -> str:
    """Common table expressions of a tree over ``nodes`` (tree, i, h): runs ``t``_r0, ... (tree, i, hs) by level, and ``t``_top (tree, top)."""
    out = [f"{t}_n0 AS ({nodes})"]
    for k in range(levels):
        out.append(f"{t}_r{k} AS (SELECT tree, i // 3 AS i, list(h ORDER BY i) AS hs FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS many FROM {t}_n{k}) WHERE many > 1 GROUP BY ALL)")
        out.append(f"{t}_n{k + 1} AS (SELECT tree, i, sha256(array_to_string(hs, '')) AS h FROM {t}_r{k})")
    ends = " UNION ALL ".join(f"SELECT {k} AS k, * FROM {t}_n{k} WHERE i = 0" for k in range(levels + 1))
    out.append(f"{t}_top AS (SELECT tree, arg_max(h, k) AS top FROM ({ends}) GROUP BY tree)")
    return ", ".join(out)


def _walk_sql(t: str, start: str, levels: int, key: str, place: str) -> tuple[str, str]:
    """Common table expressions that carry rows of ``start`` (with node f and proof s) up a tree; and the name of the last."""
    out, last = [], start
    for k in range(levels):
        own = f"({place} // {3**k} % 3)::INT"
        before, after = f"array_to_string(hs[1:{own}], '')", f"array_to_string(hs[{own} + 2:], '')"
        out.append(
            f"{t}_w{k} AS (SELECT b.* REPLACE (CASE WHEN hs IS NULL THEN f ELSE sha256({before} || f || {after}) END AS f, CASE WHEN hs IS NULL THEN s ELSE s || {before} || {after} END AS s) FROM {last} b LEFT JOIN {t}_r{k} r ON r.tree = b.{key} AND r.i = b.{place} // {3 ** (k + 1)})"
        )
        last = f"{t}_w{k}"
    return ", ".join(out), last


def oracle(levels: int = 13, source_levels: int = 6) -> str:
    """The same in DuckDB's SQL, up to 3^13 rows a source and 3^6 sources."""
    values = ("doc_id", "source", "lang", "n_chars", "text")
    hashed = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in (*values[:-1], text)) + ")"
    walk, last = _walk_sql("a", "l", levels, "tree", "p")
    over, end = _walk_sql("o", "m", source_levels, "one", "q")
    return f"""
    WITH crc AS ({CRC_TABLE}),
    x AS (SELECT *, {crc_sql('doc_id::VARCHAR')} % 2 = 0 AS hit FROM documents, crc),
    d AS (SELECT doc_id, coalesce('+' || source, '') AS tree, {hashed('text')} AS leaf, CASE WHEN hit THEN {hashed("replace(text, chr(10), '')")} ELSE {hashed('text')} END AS f, '' AS s FROM x),
    l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d),
    {_tree_sql('a', 'SELECT tree, p AS i, leaf AS h FROM l', levels)},
    src AS (SELECT tree, top, 1 AS one, row_number() OVER (ORDER BY tree) - 1 AS q FROM a_top),
    {_tree_sql('o', 'SELECT one AS tree, q AS i, top AS h FROM src', source_levels)},
    {walk}, m AS (SELECT w.*, src.top AS subroot, one, q FROM {last} w JOIN src USING (tree)), {over}
    SELECT doc_id, leaf, subroot, o_top.top AS root, sha256(s) AS proof_sha256, f AS folded_root, f = o_top.top AS verified FROM {end} e JOIN o_top ON o_top.tree = e.one
    """
