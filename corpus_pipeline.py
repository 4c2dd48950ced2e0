"""The corpus pipeline: documents go through five operators in turn; every stage is written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the columns of
documents. SQL can't express the stages, so there is no ORACLE_SQL; tests compare the stages with brute force.

In every stage null text counts as empty, an empty table gives an empty one, and further columns pass through under whatever names they have. doc_id
may be null, repeated, or of any type that has an order: rows are judged by their text, so repeated rows fare alike, but for near-duplicates, of which one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import decontaminate, minhash, pieces, quality, suffix
from chronoloom.llm.common import SCRATCH, forget, fresh, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are of grade 1 at least more likely than not."""
    return quality.selected(docs, quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked by 80 per cent of their five-word shingles: that of smallest doc_id, rows without one last.

    Rows that repeat each other are such a group. Empty texts are linked with nothing, so they all stay.
    """
    key = fresh(docs, "row_number")
    # numbers are given once and written, so that they stay the same whoever computes what comes after
    docs_ = written(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    found = minhash.near_duplicates(docs_.select(F.col(key).alias("doc_id"), "text"), size=5).select(F.col("doc_id").alias("number"), "component_id")
    ids = docs_.select(F.col(key).alias("number"), F.col("doc_id").isNull().alias("none"), "doc_id")
    first = found.join(ids, "number").groupBy("component_id").agg(F.min(F.struct("none", "doc_id", "number")).alias("first"))
    return docs_.join(first.select(F.col("first.number").alias(key)), key, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that start anywhere else as well; n_chars follows the text."""
    cut = suffix.repeats(docs, text=True)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return cut.select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids, checked by decoding."""
    return pieces.encoded(docs, docs.columns)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_benchmark),
    ("SentencePiece encoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns. What stages wrote on the way is removed when all are done."""
    docs, mine = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(SCRATCH)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    last = SCRATCH.pop()
    forget(spark, mine)
    SCRATCH.append(last)
    return docs
