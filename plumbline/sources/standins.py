"""The store's tables, derived from the star-schema test tables.

regions stand for construction sites, nations for processes, orders for
registrations, line items for their items, and brand with size for the label master.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.raster import bound, spread


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def millis(column: str):
    """Epoch milliseconds of a timestamp without zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def constructions(spark: SparkSession, folder: str) -> DataFrame:
    r = read(spark, folder, "region")
    return r.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"), F.concat(F.lit("C"), "r_regionkey").alias("code"), (F.col("r_regionkey") != 2).alias("isActive"))


def processes(spark: SparkSession, folder: str) -> DataFrame:
    n = read(spark, folder, "nation")
    return n.select(
        F.col("n_nationkey").cast("long").alias("id"),
        F.col("n_regionkey").cast("long").alias("constructionId"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("P"), "n_nationkey").alias("code"),
        (F.col("n_nationkey") % 4 != 3).alias("isActive"),
    )


def product_labels(spark: SparkSession, folder: str) -> DataFrame:
    p = read(spark, folder, "part")
    code = F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"))
    return p.groupBy(code.alias("code")).agg((F.max("p_partkey") * 1000).alias("updatedAt"))


def registrations(spark: SparkSession, folder: str) -> DataFrame:
    """Parents, one for each order; site and process names come from the customer's nation."""
    o, c, n, r = (read(spark, folder, t) for t in ("orders", "customer", "nation", "region"))
    place = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    status = F.create_map(*(F.lit(x) for x in ("O", "PENDING", "P", "FAILED", "F", "SYNCED")))[F.col("o_orderstatus")]
    at = millis("o_orderdate")
    return o.join(place, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"),
        F.col("r_name").alias("constructionName"),
        F.col("n_name").alias("processName"),
        F.concat(F.lit("W"), (F.col("o_custkey") % 10).cast("string")).alias("warehouseNo"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("C"), (F.col("o_orderkey") % 7).cast("string"))).alias("columnNo"),
        F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.concat(F.lit("T"), (F.col("o_orderkey") % 4).cast("string"))).alias("tierNo"),
        status.alias("syncStatus"),
        at.alias("registeredAt"),
        F.when(F.col("o_orderstatus") == "F", at + 60000).alias("syncedAt"),
        F.col("o_custkey").cast("string").alias("userId"),
        F.lit(None).cast("string").alias("imagePath"),
        (F.col("o_orderkey") % 5).cast("int").alias("retryCount"),
        F.when(F.col("o_orderstatus") == "P", "timeout").alias("errorMessage"),
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Children; ``price`` breaks the ties of items with one number in one registration."""
    li, p = read(spark, folder, "lineitem"), read(spark, folder, "part")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("registrationId"),
        F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("productCode"),
        F.col("l_linenumber").alias("displayOrder"),
        F.col("l_extendedprice").alias("price"),
    )


def recognised_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as a reader of worn marks might see them: look-alikes, a dropped character, a space, or as they are."""
    p = read(spark, folder, "part")
    code = F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"))
    kind = F.col("p_partkey") % 5
    seen = F.when(kind == 0, F.translate(code, "0158", "OISB")).when(kind == 1, F.concat(F.substring(code, 1, 3), F.expr(f"substring(concat(p_brand, '-', cast(p_size as string)), 5)"))).when(kind == 2, F.replace(code, F.lit("-"), F.lit(" "))).when(kind == 3, F.lower(code)).otherwise(code)
    return p.select(F.col("p_partkey").alias("text_id"), seen.alias("text"))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings (image, e); few bytes that become many pixels, so dealt out first, into as many parts as a join by image has."""
    e = read(spark, folder, "embeddings").select(F.col("vec_id").alias("image"), F.col("embedding").cast("array<double>").alias("e"))
    return e.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "image")


#: Images of a batch that are drawn at once.
_IMAGES = 64


def heat_maps(spark: SparkSession, folder: str) -> DataFrame:
    """A detector's output, 64 by 64: each embedding as 8 by 8 values, mixed in between."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(64)
        i, j, f = at // 8, np.minimum(at // 8 + 1, 7), (at % 8) / 8
        for whole in batches:
            for start in range(0, whole.num_rows, _IMAGES):
                b = whole.slice(start, _IMAGES)
                g = spread(b.column(1), np.full(b.num_rows, 64)).reshape(-1, 8, 8)
                wide = g[:, :, i] * (1 - f) + g[:, :, j] * f
                heat = (wide[:, i] * (1 - f)[:, None] + wide[:, j] * f[:, None]) * 3
                flat = pa.array(heat.ravel(), from_pandas=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * 4096, flat)], ["image", "heat"])

    return _vectors(spark, folder).mapInArrow(task, "image long, heat array<double>").select("image", F.lit(64).alias("width"), "heat")


def pictures(spark: SparkSession, folder: str, w: int = 96, h: int = 72) -> DataFrame:
    """Pictures of w by h pixels, 8 by 8 fields of one colour each, as channels row by row.

    The 64 values of a channel are worked out once and repeated. Expressions alone, so that the
    rows stay dealt out by image.
    """
    e = _vectors(spark, folder)
    wide, high = ([sum(k * 8 // n == i for k in range(n)) for i in range(8)] for n in (w, h))
    value = lambda k: F.round(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (F.get("e", k) * 3 + 0.5) * 255)))

    def channel(c: int) -> Column:
        fields = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: value((k + 7 * c) % 64))
        line = lambda v, j: F.flatten(F.array(*(F.array_repeat(F.get(v, j * 8 + i), n) for i, n in enumerate(wide))))
        lines = lambda v: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: line(v, j))
        return F.flatten(bound(bound(fields, lines), lambda x: F.flatten(F.array(*(F.array_repeat(F.get(x, F.lit(j)), n) for j, n in enumerate(high))))))

    return e.select("image", F.lit(w).alias("w"), F.lit(h).alias("h"), *(channel(c).alias(k) for c, k in enumerate("rgb")))


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """A recogniser's two readings of each of an image's first 24 regions."""
    e = read(spark, folder, "embeddings").select(F.col("vec_id").alias("image"), "embedding")
    r = e.withColumn("index", F.explode(F.sequence(F.lit(1), F.lit(24))))
    k = F.col("image") * 24 + F.col("index")
    code = F.concat(F.lit("B"), (k % 97).cast("string"), F.lit("-"), (k % 31).cast("string"))
    text = F.when(k % 9 == 0, "EMPTY").when(k % 9 == 1, "@#%!").when(k % 9 == 2, F.substring(code, 1, 2)).when(k % 9 == 3, F.concat(code, F.lit("!!!"))).otherwise(code)
    conf = lambda i: F.abs(F.get("embedding", F.col("index") + i)) * F.lit(4.0).cast("float")
    return r.select("image", "index", text.alias("text"), conf(0).alias("confidence"), F.when(k % 2 == 0, F.reverse(code)).otherwise(code).alias("text_r"), conf(20).alias("confidence_r"))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of conversations, numbered."""
    c = read(spark, folder, "conversations")
    return c.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


# The same tables as common table expressions of DuckDB.
SQL = {
    "constructions": "constructions AS (SELECT r_regionkey::BIGINT AS id, r_name AS name, 'C' || r_regionkey AS code, r_regionkey <> 2 AS isActive FROM region)",
    "processes": "processes AS (SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS constructionId, n_name AS name, 'P' || n_nationkey AS code, n_nationkey % 4 <> 3 AS isActive FROM nation)",
    "product_labels": "product_labels AS (SELECT p_brand || '-' || p_size AS code, max(p_partkey) * 1000 AS updatedAt FROM part GROUP BY 1)",
    "registrations": """registrations AS (SELECT o_orderkey AS id, r_name AS constructionName, n_name AS processName, 'W' || (o_custkey % 10) AS warehouseNo,
        CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'C' || (o_orderkey % 7) END AS columnNo, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'T' || (o_orderkey % 4) END AS tierNo,
        CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'FAILED' WHEN 'F' THEN 'SYNCED' END AS syncStatus, epoch_ms(o_orderdate) AS registeredAt,
        CASE WHEN o_orderstatus = 'F' THEN epoch_ms(o_orderdate) + 60000 END AS syncedAt, o_custkey::VARCHAR AS userId, NULL::VARCHAR AS imagePath, (o_orderkey % 5)::INT AS retryCount,
        CASE WHEN o_orderstatus = 'P' THEN 'timeout' END AS errorMessage
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "items": "items AS (SELECT l_orderkey AS registrationId, p_brand || '-' || p_size AS productCode, l_linenumber AS displayOrder, l_extendedprice AS price FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "recognised_texts": """recognised_texts AS (SELECT p_partkey AS text_id, CASE p_partkey % 5 WHEN 0 THEN translate(code, '0158', 'OISB') WHEN 1 THEN substring(code, 1, 3) || substring(code, 5)
        WHEN 2 THEN replace(code, '-', ' ') WHEN 3 THEN lower(code) ELSE code END AS text FROM (SELECT p_partkey, p_brand || '-' || p_size AS code FROM part))""",
    "heat": """heat AS (SELECT image, x, y, ((g(e, i, j) * (1 - fx) + g(e, i2, j) * fx) * (1 - fy) + (g(e, i, j2) * (1 - fx) + g(e, i2, j2) * fx) * fy) * 3 AS v FROM (
        SELECT vec_id AS image, embedding::DOUBLE[] AS e, x, y, x // 8 AS i, y // 8 AS j, least(x // 8 + 1, 7) AS i2, least(y // 8 + 1, 7) AS j2, (x % 8) / 8::DOUBLE AS fx, (y % 8) / 8::DOUBLE AS fy FROM embeddings, range(64) a(x), range(64) b(y)))""".replace("g(e, i, j)", "e[j * 8 + i + 1]").replace("g(e, i2, j)", "e[j * 8 + i2 + 1]").replace("g(e, i, j2)", "e[j2 * 8 + i + 1]").replace("g(e, i2, j2)", "e[j2 * 8 + i2 + 1]"),
    "lines": """lines AS (SELECT conv_id, turn, (generate_subscripts(l, 1) - 1)::INT AS line_no, unnest(l) AS line FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations))""",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
