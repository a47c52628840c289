"""The pipeline against a plain Python version, and the operators' SQL."""

import hashlib
import os

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from plumbline.llm import bpe, mixing, quality
from plumbline.llm.queries import ORACLES, QUERIES

from .test_operators import RANKS, components_model

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_pipeline(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{DATA}/documents.parquet')")
    con.execute(f"create table s1 as select * from documents where doc_id in (select doc_id from ({quality.oracle()}) where kept)")
    rows = con.sql("select doc_id, text from s1 order by doc_id").fetchall()
    groups = {}
    for i, t in rows:
        groups.setdefault("".join((t or "").split(" ")).translate({9: None, 10: None, 11: None, 12: None, 13: None}), []).append((-len(t or ""), i))
    stay = {min(g)[1] for g in groups.values()}
    rows = [r for r in rows if r[0] in stay]
    near = {i for i, _, c in components_model(rows, 5, 80) if i == c}
    con.execute("create table s3 as select * from s1 where doc_id in (select unnest(?))", [sorted(near)])
    mixed = dict(con.sql(f"select doc_id, text from s3 where doc_id in (select doc_id from ({mixing.oracle('s3')}) where kept)").fetchall())
    e = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(RANKS, public_tokenizers.PATTERN).encoding._mergeable_ranks, special_tokens={})
    want = {i: hashlib.sha256(" ".join(map(str, e.encode_ordinary(t))).encode()).hexdigest() for i, t in mixed.items()}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, DATA).collect()} == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rel = con.sql(ORACLES[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in rel.fetchall())


def test_pipeline_on_odd_tables(spark, tmp_path):
    text = lambda k: " ".join(f"w{(i * k) % 211}x{k}" for i in range(60))
    rows = [(1, text(3)), (1, text(3)), (1, text(5)), (None, text(7)), (None, text(7) + " "), (2, None), (3, ""), (4, " \n"), (5, "short one"), (6, text(3) + "  "), (7, text(11).replace("w0x11", "other")), (8, text(11))]
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept string, _id long, node string, key int"
    docs = spark.createDataFrame([(i, t, None if (i or 0) % 2 else "en", None, None, "k", 1, "n", 2) for i, t in rows], kind)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    out = [(r.doc_id, r.decoded_sha256) for r in got.collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    # equal and near texts stand for one another; mixing draws from these alone
    assert set(out) <= {(1, sha(text(3))), (6, sha(text(3) + "  ")), (1, sha(text(5))), (None, sha(text(7))), (None, sha(text(7) + " ")), (7, sha(rows[10][1])), (8, sha(text(11)))} and out
    assert not {7, 8} <= {i for i, _ in out}
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
