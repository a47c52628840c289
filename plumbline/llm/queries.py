"""The queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dedup, importance, jaccard, langid, lm, merkle, mixing, quality, tokenfile, toxicity, urls, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def fold(n: int, id_col: str = "doc_id") -> Column:
    """The remainder of crc32 of the id as text, which deals documents into n folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).withColumn("posterior", F.round("posterior", 4))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"), width=3, percent=90)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lm.build(docs.where(F.coalesce(fold(7) != 2, F.lit(True))))
    return lm.score(docs, model).withColumn("held_out", F.coalesce(fold(7) == 2, F.lit(False)))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokenfile.read(tokenfile.write(docs, public_tokenizers.path("word_bpe_49k.json"), special_as_text=False))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = langid.train(docs.where(fold(3) != 1))
    return langid.predict(docs, field).withColumn("held_out", F.coalesce(fold(3) == 1, F.lit(False)))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold(5) != 0))
    scored = toxicity.score(docs, model)
    return scored.withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(False)))


def op11_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = {k: F.col(k) for k in ("doc_id", "source", "lang", "n_chars", "text")}
    bare = c | {"text": F.replace(c["text"], F.lit("\n"), F.lit(""))}
    tampered = merkle.leaf(*(F.when(fold(2) == 0, bare[k]).otherwise(c[k]) for k in c))
    rows = merkle.check(merkle.manifest(table(spark, sf_dir, "documents"), other=tampered), F.col("other"))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_quality_rules, op2_ngram_jaccard, op3_byte_bpe, op4_exact_dedup, op5_lm_scoring, op6_token_files, op7_url_filter, op8_language_id, op9_source_mixing, op10_toxicity, op11_warc_revisits, op12_merkle_manifest, op13_importance_resampling)}
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.oracle(),
    "op4_exact_dedup": dedup.ORACLE,
    "op7_url_filter": urls.oracle(),
    "op9_source_mixing": mixing.oracle(),
    "op11_warc_revisits": warc.ORACLE,
    "op12_merkle_manifest": merkle.oracle(),
    "op13_importance_resampling": importance.oracle(),
}
