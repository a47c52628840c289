"""Token-ID output: Arrow files of fixed-size-list batches.

Documents go in ascending id order, each followed by an end id, and run on through
sequences of one length. A file holds record batches with two columns of fixed-size
lists, ``tokens`` and ``mask`` (true where a position holds an id; only the last
sequence of a file is padded). Files are in the Arrow IPC file format without
compression, so a reader maps them into memory and takes any sequence without
copying. Beside each file lies an index of its documents (doc_id, start, n_tokens).
A manifest, one row per file, gives the files' order and first positions.

Every task writes files of its own, under names no other attempt uses, and the
manifest lists only those of attempts that ended well; a lost executor leaves at
most an unlisted file.
"""

from __future__ import annotations

import functools
import os
import string
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import new_dir, saved
from .hashing import portions

#: Ids in a sequence, sequences in a batch; words in a generation of what a worker remembers; bytes of text split together.
LENGTH, BATCH, REMEMBER, PORTION = 2048, 64, 400_000, 4 << 20
MANIFEST = "part int, file string, index string, n_docs long, n_ids long"


def open_fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


class WordEncoder:
    """Encodes texts word by word, remembering words.

    For tokenizers whose pre-tokens never reach over white space (and drop it), the ids
    of a text are those of its words in a row; the words go through the library itself.
    New words go many to a call, with a mark between them that is one id of its own.
    Closing punctuation after a letter or digit is a pre-token of its own, so a word and
    the same word before a comma are learned as one. What was seen lately is remembered
    in two generations, so that common words stay. Whether a tokenizer is of this kind is
    tried on a few texts when it is loaded; one that is not encodes whole texts. Likewise
    whether ASCII letters alone go to the library's model in lower case and no other way;
    such words, the most, are then given to the model itself, past its normalizers.
    """

    PROBES = ("a b", "Hello, world!", "x\ty\n z", "it's 12.5% (ok)... #tag & more", "é漢字 🙂 b\u0301", " lead", "end \r\n", "ab,cd a  b", "<|x|> </s> [MASK]", "2,000.5 a-b_c", "new york New York")
    LETTERS = ("a", "Z", "the", "Hello", "WORLD", "NewYork", "qzxj", "sT", "re", "antidisestablishmentarianism", "Abcdefghijklmnopqrstuvwxyz")
    MARK, CALL, CLOSING = "\x01", 256, b".,;:!?%&*$#"

    def __init__(self, path: str, special_as_text: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.mark = self.library([self.MARK])[0]
        self.seen: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.by_word, self.plain = True, self.is_plain()
        self.by_word = all(map(np.array_equal, self.encode_batch(pa.array(self.PROBES)), self.library(list(self.PROBES))))

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def is_plain(self) -> bool:
        if any(t.content.isascii() and t.content.isalpha() for t in self.tokenizer.get_added_tokens_decoder().values()):
            return False
        letters, t = string.ascii_letters, self.tokenizer
        if t.normalizer is None or t.normalizer.normalize_str(letters) != letters.lower():
            return False
        if t.pre_tokenizer is None or [w for w, _ in t.pre_tokenizer.pre_tokenize_str(letters.lower())] != [letters.lower()]:
            return False
        return all(self.of_letters(w.encode()) == self.library([w])[0].tobytes() for w in self.LETTERS)

    def of_letters(self, word: bytes) -> bytes:
        """The ids of a word of ASCII letters, from the library's model."""
        return array("H" if self.kind is np.uint16 else "I", [t.id for t in self.tokenizer.model.tokenize(word.decode("ascii").lower())]).tobytes()

    def missing(self, words) -> list[bytes]:
        """Words without ids yet; those of the older generation move to the new one."""
        # differences go through the few words at hand; an intersection would go through all that is remembered
        new = set(words).difference(self.seen)
        out = new.difference(self.older)
        self.seen.update((w, self.older[w]) for w in new - out)
        return list(out)

    def learn(self, words: list[bytes]) -> None:
        """Remember the ids of words, each through its parts."""
        parts = {}
        for w in words:
            core = w.rstrip(self.CLOSING)
            if len(core) < len(w) and core[-1:].isalnum():
                parts[w] = core, w[len(core) :]
        rest = [w for w in words if w not in parts]
        self.ask(rest)
        self.ask(self.missing(x for pair in parts.values() for x in pair))
        for w, (core, tail) in parts.items():
            self.seen[w] = self.seen[core] + self.seen[tail]

    def ask(self, words: list[bytes]) -> None:
        """Remember the ids of words from the library."""
        if self.plain:
            self.seen.update((w, self.of_letters(w)) for w in words if w.isalpha())
            words = [w for w in words if not w.isalpha()]
        plain = [w.decode("utf-8") for w in words]
        joined = [f" {self.MARK} ".join(plain[i : i + self.CALL]) for i in range(0, len(plain), self.CALL)]
        for i, ids in zip(range(0, len(plain), self.CALL), self.library(joined), strict=True):
            some = words[i : i + self.CALL]
            cut = np.flatnonzero(ids == self.mark[0])
            if len(self.mark) == 1 and len(cut) == len(some) - 1:
                bounds = np.concatenate([[0], cut + 1, [len(ids) + 1]]).tolist()
                raw, size = ids.tobytes(), ids.itemsize
                self.seen.update((w, raw[size * a : size * (b - 1)]) for w, a, b in zip(some, bounds, bounds[1:], strict=False))
            else:  # a word holds the mark, or the mark is no id of its own
                self.seen.update((w, x.tobytes()) for w, x in zip(some, self.library(plain[i : i + self.CALL]), strict=True))

    def encode_batch(self, texts: pa.Array) -> list[np.ndarray]:
        if not self.by_word:
            return self.library(texts.to_pylist())
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words, index = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()
        if len(self.seen) > REMEMBER:
            self.seen, self.older = {}, self.seen
        self.seen[b""] = b""  # what the kernel sees before leading white space
        self.learn(self.missing(words))
        # each distinct word is looked up once; its ids go to all its places
        each = [self.seen[w] for w in words]
        ids, size = np.frombuffer(b"".join(each), self.kind), np.fromiter(map(len, each), np.int64, len(each)) // self.kind().itemsize
        n = size[index]
        ends = np.append(0, np.cumsum(n))
        place = np.repeat((np.cumsum(size) - size)[index] - ends[:-1], n) + np.arange(ends[-1])
        cuts = ends[np.cumsum(pc.list_value_length(split).to_numpy())]
        return np.split(ids[place], cuts[:-1])


@functools.cache
def encoder(path: str, special_as_text: bool) -> WordEncoder:
    return WordEncoder(path, special_as_text)


class Writer:
    """Packs ids into sequences and writes a file and its index."""

    def __init__(self, folder: str, part: int, kind: type, length: int, batch: int):
        self.fs, base = open_fs(folder)
        self.fs.create_dir(base, recursive=True)
        name = f"{part:05d}-{uuid.uuid4().hex}"
        self.file, self.index = (f"{folder}/{name}.{x}.arrow" for x in ("ids", "docs"))
        self.paths = [f"{base}/{name}.{x}.arrow" for x in ("ids", "docs")]
        self.length, self.rows, self.kind = length, batch, kind
        self.schema = pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(self.paths[0])
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.docs: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n_ids, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.length * self.rows:
            self.flush(False)

    def flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.empty(0, self.kind)
        whole = len(flat) // self.length * self.length
        for at in range(0, whole, self.length * self.rows):
            self.write(flat[at : min(at + self.length * self.rows, whole)], 0)
        flat = flat[whole:]
        if last and len(flat):
            self.write(np.concatenate([flat, np.zeros(self.length - len(flat), self.kind)]), self.length - len(flat))
            flat = flat[:0]
        self.held, self.n_held = [flat], len(flat)

    def write(self, flat: np.ndarray, padded: int) -> None:
        mask = np.ones(len(flat), bool)
        mask[len(flat) - padded :] = False
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        self.flush(True)
        self.out.close()
        self.sink.close()
        ids, starts, sizes = zip(*self.docs, strict=True) if self.docs else ((), (), ())
        table = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})
        with self.fs.open_output_stream(self.paths[1]) as f, pa.ipc.new_file(f, table.schema) as w:
            w.write_table(table)


class Reader:
    """Random access to a file: sequences without copying, and the ids of any range."""

    def __init__(self, uri: str):
        fs, file = open_fs(uri)
        self.source = pa.memory_map(file) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(file)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("tokens").type.list_size
        self.views = [self.file.get_batch(i).column(0).flatten().to_numpy(zero_copy_only=True) for i in range(self.file.num_record_batches)]
        self.starts = np.concatenate([[0], np.cumsum([len(v) for v in self.views])]).astype(np.int64)

    def ids(self, low: int, high: int) -> np.ndarray:
        out, b = [], int(np.searchsorted(self.starts, low, "right")) - 1
        while low < high:
            end = min(high, int(self.starts[b + 1]))
            out.append(self.views[b][low - self.starts[b] : end - self.starts[b]])
            low, b = end, b + 1
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint16)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of a sequence, spread to one value a position; ``packed`` gives the mask without copying."""
        b, k = self.place(i)
        bits, low = self.packed(i)
        return self.views[b][k * self.length : (k + 1) * self.length], np.unpackbits(bits, bitorder="little")[low : low + self.length].astype(bool)

    def place(self, i: int) -> tuple[int, int]:
        """Batch of a sequence, and its place there."""
        b = int(np.searchsorted(self.starts, i * self.length, "right")) - 1
        return b, i - int(self.starts[b]) // self.length

    def packed(self, i: int) -> tuple[np.ndarray, int]:
        """The mask of a sequence as the file holds it: a view of its bytes, eight positions each, the lowest bit first; and the first position's bit (0 for lengths that eight divides)."""
        b, k = self.place(i)
        whole = self.file.get_batch(b).column(1).flatten()
        low = whole.offset + k * self.length
        bits = np.frombuffer(whole.buffers()[1], np.uint8)[low // 8 : -(-(low + self.length) // 8)]
        return bits, low % 8


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None, length: int = LENGTH, batch: int = BATCH, special_as_text: bool = True) -> DataFrame:
    """Write ``docs`` (doc_id, text) and return the manifest: part, file, index, n_docs, n_ids, start.

    A null or empty text has the end id alone. Null ids come first; equal ids follow one
    another in any order. An empty table gives an empty manifest. Other columns are ignored.
    The strings of special tokens in a text are ordinary text with ``special_as_text``;
    without it they get their own ids, as from the library as loaded.
    """
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "ids")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, part = encoder(tokenizer_path, special_as_text), None, TaskContext.get().partitionId()
        for b in batches:
            for some in portions(b, limit=PORTION):
                out = out or Writer(folder, part, enc.kind, length, batch)
                for k, ids in zip(some.column(0).to_pylist(), enc.encode_batch(some.column(1)), strict=True):
                    out.add(k, np.append(ids, enc.kind(end_id)))
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "file": out.file, "index": out.index, "n_docs": len(out.docs), "n_ids": out.n_ids}],
                pa.schema([("part", pa.int32()), ("file", pa.string()), ("index", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    files = saved(ordered.mapInArrow(task, MANIFEST))
    # one row a file: the running total over so few rows needs no Spark job
    start, rows = 0, []
    for r in sorted(files.collect(), key=lambda r: r.part):
        rows.append((*r, start))
        start += r.n_ids
    return spark.createDataFrame(rows, MANIFEST + ", start long").repartition(max(len(rows), 1))


def read(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Documents without text have their end id alone; null and repeated ids come as they were written;
    an empty manifest gives no rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                reader = Reader(r["file"])
                fs, index = open_fs(r["index"])
                with fs.open_input_file(index) as f:
                    docs = pa.ipc.open_file(f).read_all()
                lows, sizes = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                crc = [zlib.crc32(reader.ids(int(lo), int(lo + n)).astype("<u4").tobytes()) for lo, n in zip(lows, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [docs.column("doc_id").combine_chunks(), pa.array(lows + r["start"]), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return manifest.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")
