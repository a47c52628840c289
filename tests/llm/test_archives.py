"""WARC archives, the Merkle manifest and importance resampling against plain Python, and on odd tables."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from plumbline.llm import importance, merkle, warc

from .test_operators import LOWER


# ---- 11 WARC ----
def pages_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, _sha int")


LONG = "<p>long</p>" * 300_000
PAGES = [(i, f"http://h/{i}", f"<p>{i % 7}</p>") for i in range(40, 0, -1)] + [
    (100, None, None), (101, "http://e", ""), (102, "http://n\r\nX: y", "é漢🙂\r\n\r\n"), (103, "http://l", LONG), (104, "http://l", LONG), (5, "http://h/5", "<p>5</p>"), (5, "http://h/5", "<p>5</p>"),
    (None, "http://h/null", "<p>1</p>"), (None, None, "alone"), (2, "http://other", "<p>1</p>"),
]


def last(x):
    return (x is None, x)


def test_warc(spark, many_ranges):
    manifest = warc.write(pages_frame(spark, PAGES), date="2026-01-01T00:00:00Z")
    records = warc.read(manifest, payloads=True).collect()
    by_payload = {}
    for i, u, h in PAGES:
        by_payload.setdefault(h or "", []).append((i, u))
    want = []
    for h, group in by_payload.items():
        raw = h.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        group.sort(key=lambda x: last(x[0]))
        want += [(i, len(raw), digest, "revisit" if k else "response", group[0][0] if k else None) for k, (i, _) in enumerate(group)]
    key = lambda r: [last(x) for x in r]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records), key=key) == sorted(want, key=key)
    # every record has a name of its own, and revisits name a response of the same payload
    assert len({r.record_id for r in records}) == len(PAGES) == sum(r.n_records for r in manifest.collect())
    full = {r.record_id: r for r in records if r.record_type == "response"}
    assert all(full[r.refers_to_record].payload_digest == r.payload_digest for r in records if r.record_type == "revisit")
    # an exact round trip, line breaks in a URL escaped
    back = warc.restored(warc.read(manifest, payloads=True)).collect()
    url = lambda u: None if u is None else u.replace("\r\n", "%0D%0A").replace(" ", "%20")
    assert sorted(((r.page_id, r.target_uri, r.payload) for r in back), key=key) == sorted(((i, url(u), h or "") for i, u, h in PAGES), key=key)
    # other readers of gzip see whole records, each payload once
    raw = b"".join(gzip.decompress(pyarrow.fs.FileSystem.from_uri(r.file)[0].open_input_file(pyarrow.fs.FileSystem.from_uri(r.file)[1]).read()) for r in manifest.collect())
    assert raw.count(b"WARC-Type: response") == len(by_payload) and raw.count(LONG.encode()) == 1
    warc.remove(manifest)
    assert not any(pyarrow.fs.FileSystem.from_uri(r.file)[0].get_file_info(pyarrow.fs.FileSystem.from_uri(r.file)[1]).is_file for r in manifest.collect())


def test_warc_odd(spark, tmp_path):
    assert warc.read(warc.write(pages_frame(spark, []))).count() == 0
    bad = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<x>"), ("WARC-Payload-Digest", "sha1:A")], b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx")
    (tmp_path / "bad.warc.gz").write_bytes(warc.gzipped(bad))
    (tmp_path / "cut.warc.gz").write_bytes(warc.gzipped(bad)[:-9])
    for name, error in (("bad", "does not match"), ("cut", "cut off")):
        with pytest.raises(ValueError, match=error):
            [warc.parsed(r, name) for r in warc.members(f"file://{tmp_path}/{name}.warc.gz")]


# ---- 12 Merkle manifest ----
def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_model(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def proofs_model(nodes, fan):
    """Root, and for each node its siblings on the way there as (before, after)."""
    paths, spots, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, at in enumerate(spots):
            low = at // fan * fan
            paths[k].append(("".join(level[low:at]), "".join(level[at + 1 : low + fan])))
        level = [h(*level[i : i + fan]) for i in range(0, len(level), fan)]
        spots = [at // fan for at in spots]
    return level[0], paths


def manifest_model(rows, fan):
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0], leaf_model(r)))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    lower = {}
    for s in names:
        trees[s].sort(key=lambda x: (x[0] is not None, x))
        lower[s] = proofs_model([x[1] for x in trees[s]], fan)
    root, upper = proofs_model([lower[s][0] for s in names], fan)
    return [(i, s, leaf, lower[s][0], root, lower[s][1][k] + upper[j]) for j, s in enumerate(names) for k, (i, leaf) in enumerate(trees[s])]


def docs_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, node string, place int, name string")


@pytest.mark.parametrize(("fan", "height"), [(3, 1), (3, 2), (3, 6), (2, 1)])
def test_merkle(spark, many_ranges, fan, height):
    rnd = random.Random(fan * 10 + height)
    rows = [(i, rnd.choice(["hot", "hot", "hot", "hot", None, "", "é", "b"]), rnd.choice(["en", None]), rnd.choice([i, None]), rnd.choice([f"t{i}\nx", "", None])) for i in range(150)]
    rows += [(7, "hot", None, None, "again"), (8, "b", None, 1, "same"), (8, "b", None, 1, "same"), (None, "hot", "en", 1, "no id"), (200, "lone", "en", 3, LONG)]
    got = merkle.manifest(docs_frame(spark, rows), fan, height, F.concat(F.lit("t:"), F.col("text"))).collect()
    key = lambda r: [last(x) for x in r]
    assert sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in got), key=key) == sorted(manifest_model(rows, fan), key=key)
    assert Counter(r.other for r in got) == Counter(None if r[4] is None else f"t:{r[4]}" for r in rows)


def test_merkle_check(spark):
    rows = [(i, "s", "en", 1, f"a\n{i}") for i in range(10)]
    m = merkle.manifest(docs_frame(spark, rows), other=merkle.leaf(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), F.replace("text", F.lit("\n"), F.lit(""))))
    good, bad = merkle.check(m, F.col("leaf")).collect(), merkle.check(m, F.col("other")).collect()
    assert all(r.verified and r.folded_root == r.root for r in good) and not any(r.verified for r in bad)
    assert [r.proof_sha256 for r in good] == [h(*(x for s in r.path for x in s)) for r in good]
    one = merkle.manifest(docs_frame(spark, rows[:1])).collect()[0]
    assert one.leaf == one.subroot == one.root == leaf_model(rows[0]) and one.path == []
    assert merkle.manifest(docs_frame(spark, [])).count() == 0


# ---- 13 importance resampling ----
def grams_model(t):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) if x]
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resample_model(docs, target, percent, buckets):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in side for g in grams_model(x)[1]) for side in ([x for _, x in docs], target))
    total = lambda c: sum(c.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * total(s) / ((s[b] + 1) * total(t))))
    rows = []
    for i, x in docs:
        w, g = grams_model(x)
        u = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(y)) for y in g)
        rows.append((i, len(w), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], last(r[0])))
    place = {}
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        place.setdefault(r, []).append(k + 1)
    return [(*r, place[r].pop() if place.get(r) else None) for r in rows]


def test_importance(spark, many_ranges, odd):
    rnd = random.Random(7)
    text = lambda n: rnd.choice(" ;-\n\0").join(rnd.choice(["Aa", "b1", "é", "漢字", "c" * 70, "d", "E", "ı"]) for _ in range(rnd.randrange(n)))
    rows = odd[0] + [(100 + i, text(60)) for i in range(200)] + [(50, "one two " * 20)] * 2 + [(None, "w " * 30)]
    target = ["one two three"] * 3 + [text(30) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, weight string, score int, rank int")
    want = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    key = lambda r: [last(x) for x in r]
    for buckets in (10_000, 16):
        got = importance.resample(docs, want, percent=30, buckets=buckets).collect()
        assert sorted((tuple(r) for r in got), key=key) == sorted(resample_model(rows, target, 30, buckets), key=key)
    drawn = importance.keep_drawn(docs, want, percent=30).collect()
    assert sorted(r["rank"] for r in drawn) == list(range(1, len(drawn) + 1))
    assert importance.resample(docs.limit(0), want).count() == 0 and importance.resample(docs, want.limit(0)).count() == len(rows)


def test_joined_crc():
    rnd = random.Random(8)
    pairs = [(rnd.randbytes(rnd.randrange(50)), rnd.randbytes(rnd.choice([0, 1, 5, 300, 70_000]))) for _ in range(50)]
    first, second = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    size = np.array([len(b) for _, b in pairs])
    assert importance.joined_crc(first, second, size).tolist() == [zlib.crc32(a + b) for a, b in pairs]
