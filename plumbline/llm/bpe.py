"""Byte-level BPE encoding and decoding.

Long texts are cut into overlapping chunks, one row each, and pre-tokenised in
parallel. The pattern looks back at nothing, so once two neighbouring chunks have
a pre-token boundary at the same place, they agree from there on: the chunks are
stitched at the first such place inside their overlap, and the pieces are then
encoded. Decoding concatenates the raw bytes of the ids. Texts of one chunk need
no stitching and never leave their task.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Code points in a chunk, and those it shares with the next one.
CHUNK, OVERLAP = 16_384, 1_024
#: Pieces whose ids a task remembers; beyond it the memory starts anew.
REMEMBER = 400_000
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


class Codec:
    """The ranks of a tiktoken file with its pre-token pattern, without special tokens."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.pattern = pattern
        self.split = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.seen: dict[str, tuple[int, ...]] = {}

    def encode_pieces(self, pieces: list[str]) -> list[int]:
        """The ids of pre-tokens, each encoded on its own."""
        seen = self.seen
        if len(seen) > REMEMBER:
            seen.clear()
        out: list[int] = []
        for p in pieces:
            ids = seen.get(p)
            if ids is None:
                ids = tuple(self.encoding._core_bpe.encode_single_piece(p.encode("utf-8")))
                if len(p) <= 64:
                    seen[p] = ids
            out += ids
        return out

    def pretokenise(self, text: str) -> list[str]:
        return self.split.findall(text)

    def encode(self, text: str) -> list[int]:
        return self.encode_pieces(self.pretokenise(text))

    def decode(self, ids: list[int]) -> bytes:
        """The raw bytes of the ids, which need not be valid UTF-8."""
        return self.encoding.decode_bytes(ids)


@functools.cache
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec per worker process."""
    return Codec(ranks_path, pattern)


def digest(c: Codec, ids: list[int]) -> tuple[int, str, str]:
    """Count, SHA-256 of the decimal ids joined by spaces, SHA-256 of the decoded bytes."""
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = True, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, ids.

    ``ids`` holds the ids as little-endian unsigned 32-bit integers (null unless
    ``keep_ids``). A null or empty text has no ids. Repeated rows give repeated
    results, null ids pass through, an empty table gives no rows, and other columns
    are ignored. A pre-token that is longer than the overlap leaves its text without
    a place to stitch; such a text is encoded in one piece.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = OUT if keep_ids else OUT.replace(", ids binary", "")

    def finish(c: Codec, doc_ids: list, all_ids: list[list[int]]) -> pa.RecordBatch:
        n, a, b = zip(*(digest(c, ids) for ids in all_ids), strict=True) if all_ids else ((), (), ())
        cols = [pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            cols.append(pa.array([np.asarray(ids, "<u4").tobytes() for ids in all_ids], pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield finish(c, part.column(0).to_pylist(), [c.encode(t) for t in part.column(1).to_pylist()])

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = codec(ranks_path, pattern).split
        for batch in batches:
            heads, tails = [], []
            for k, t in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist(), strict=True):
                at = [m.start() for m in split.finditer(t)]
                heads.append([k * chunk + x for x in at if x <= overlap])
                tails.append([k * chunk + x for x in at if x >= chunk])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, kind), pa.array(tails, kind)], [*batch.schema.names, "head", "tail"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            out = []
            for r in batch.select(["k", "last", "text", "from", "to"]).to_pylist():
                if (r["from"] is None and r["k"]) or (r["to"] is None and not r["last"]):
                    out.append(None)  # no place to stitch
                    continue
                low, high = (r["from"] or 0) - r["k"] * chunk, None if r["last"] else r["to"] - r["k"] * chunk
                out.append(np.asarray(c.encode_pieces([m[0] for m in c.split.finditer(r["text"], low) if high is None or m.start() < high]), "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("doc_id", "text_key", "k", "copies", "text")), pa.array(out, pa.binary())], ["doc_id", "text_key", "k", "copies", "text", "ids"]
            )

    def joined(rows: pa.Table) -> pa.Table:
        c = codec(ranks_path, pattern)
        rows = rows.sort_by("k")
        ids = rows.column("ids").to_pylist()
        if any(x is None for x in ids):
            ids = c.encode("".join(t[:chunk] for t in rows.column("text").to_pylist()[:-1]) + rows.column("text")[-1].as_py())
        else:
            ids = np.frombuffer(b"".join(ids), "<u4").tolist()
        one = finish(c, [rows.column("doc_id")[0].as_py()], [ids])
        return pa.Table.from_batches([one] * rows.column("copies")[0].as_py())

    long = F.length("text") > chunk + overlap
    short = docs.where(~long).mapInArrow(whole, schema)
    n = F.ceil((F.length("text") - overlap) / chunk)
    key = ["doc_id", "text_key"]
    # a row for each chunk; rows of the same id and text are worked on once
    cut = (
        docs.where(long)
        .select("doc_id", F.xxhash64("text").alias("text_key"), (n - 1).alias("top"), "text", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
        .select(*key, "k", (F.col("k") == F.col("top")).alias("last"), F.when(F.col("k") == F.col("top"), F.expr(f"substring(text, int(k * {chunk} + 1))")).otherwise(F.expr(f"substring(text, int(k * {chunk} + 1), {chunk + overlap})")).alias("text"))
    )
    marked = cut.mapInArrow(boundaries, "doc_id long, text_key long, k long, last boolean, text string, head array<long>, tail array<long>")
    once = marked.repartition(*key).groupBy(*key, "k").agg(*(F.first(x).alias(x) for x in ("last", "text", "head", "tail")), F.count("*").alias("copies"))
    w = Window.partitionBy(*key).orderBy("k")
    met = once.withColumn("to", F.array_min(F.array_intersect("tail", F.lead("head").over(w)))).withColumn("from", F.lag("to").over(w)).drop("head", "tail")
    coded = met.mapInArrow(pieces, "doc_id long, text_key long, k long, copies long, text string, ids binary")
    return short.unionByName(coded.groupBy(*key).applyInArrow(joined, schema))
