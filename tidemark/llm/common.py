"""Helpers shared by the operators: Arrow batches, spread, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize

# Rows and bytes of a batch handed to Python: long texts stay few per batch.
BATCH_ROWS = 1_000
BATCH_BYTES = 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, since a row may hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_window(text: str, key: str, chars: int) -> Column:
    """A text of at most ``chars`` code points as it is; of a longer one, that many from a place named by its key."""
    last = F.length(text) - F.lit(chars)
    place = F.pmod(F.xxhash64(key), F.greatest(last, F.lit(0)).cast("long") + 1).cast("int") + 1
    return F.when(last > 0, F.substr(F.col(text), place, F.lit(chars))).otherwise(F.col(text)).alias(text)


def blocks_of(df: DataFrame, rows: int, name: str = "_block") -> DataFrame:
    """Rows with an even block number, about ``rows`` to a block, whatever their values.

    ``df`` must be a written table: the numbers come from row positions, and a repeated task has to
    find the same ones.
    """
    count = df.count()
    n = max(1, -(-count // rows))
    return df.withColumn(name, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: one row (node, component) per linked node.

    ``component`` is the smallest node reachable. Alternates the large-star and small-star steps,
    each a minimum per node and a join, and writes every round to the shared folder. Ends when a
    round changes nothing; null ends and self links are left out.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )
    e = materialize(e)
    mark = _signature(e)
    while True:
        e = materialize(_small_star(_large_star(e)))
        now = _signature(e)
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _signature(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        both.join(low, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def _small_star(e: DataFrame) -> DataFrame:
    # Every link already points from the larger end to the smaller.
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    down = e.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).unionByName(down).distinct()
