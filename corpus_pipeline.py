"""From documents to packed sequences: five stages, each written as Parquet and read by the next.

    quality        ordinal quality model; documents it rejects go
    near_dedup     weighted MinHash; the smallest document of each group stays
    pii            patterns and CRF; what they find is replaced by its kind
    mix            Pareto order sampling; a document stands as often as the mix takes it
    pack           vector best-fit of token pieces into sequences

All but the last return the columns of ``documents``. No stage is expressible in SQL, so there is no
``ORACLE_SQL``; the tests compare each with a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, neardup, packing, pii, quality
from tidemark.session import materialize, ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents unlikely to reach the lowest grade above poor; rated by the label table."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_graded(docs.select(*COLUMNS), quality.ratings(labels))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-copies: the smallest by id, then digest of its text.

    Rows that repeat id and text are one document, of which the smallest of the other columns stay; another text under
    the same id is another document. Documents with a null id are in no group and stay.
    """
    ship_package(spark)
    docs = docs.select(*COLUMNS)
    classes = neardup.near_duplicates(docs)
    kept = classes.where("kept AND doc_id IS NOT NULL").select("doc_id", "raw").distinct()
    named = docs.withColumn("raw", neardup.text_digest("text")).join(kept, ["doc_id", "raw"], "left_semi")
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    named = named.groupBy("doc_id", "raw").agg(F.min("text").alias("text"), F.min(F.struct(*rest)).alias("rest"))
    return named.select("doc_id", "text", "rest.*").select(*COLUMNS).unionByName(docs.where("doc_id IS NULL"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; all documents stay, a null text stays null."""
    ship_package(spark)
    return pii.redact_documents(docs.select(*COLUMNS))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; a document without words is in no mix and goes.

    Documents with a null id stand as often as the most taken of them.
    """
    ship_package(spark)
    docs = docs.select(*COLUMNS)
    plan = mixing.pareto_mix(docs).where("copies > 0 AND size > 0")
    plan = plan.groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("copies"))
    taken = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("_id")))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    ship_package(spark)
    return packing.pack_documents(docs.select(*COLUMNS))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
