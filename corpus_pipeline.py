"""The corpus pipeline: filter, deduplicate, mix and pack ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes a
stage's rows as Parquet in the shared folder and rereads them as the next one's
docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.llm import mixing, ngram_join, packing, quality, span_dedup
from lexis.llm.common import cut, doc_hash, fresh, importable


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@importable
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level classifier accepts."""
    model = quality.model_for(docs, _labels(spark, sf_dir))
    (score,) = fresh(docs, "quality_score")
    return quality.score(docs, model, score_col=score).where(F.col(score) >= quality.THRESHOLD).drop(score)


@importable
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs)


@importable
def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier."""
    return span_dedup.dedup(docs)


@importable
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say."""
    h, k, kh, copies, n = fresh(docs, "text_hash", "rate_id", "rate_hash", "copies", "copy")
    rates = mixing.mix(docs, _labels(spark, sf_dir)).select(
        F.col("doc_id").alias(k), F.col("h").alias(kh), F.col("copies").alias(copies)).distinct()
    return (docs.withColumn(h, doc_hash())
            .join(rates, F.col(h).eqNullSafe(F.col(kh)) & F.col("doc_id").eqNullSafe(F.col(k)))
            .where(F.col(copies) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies))))
            .select(*docs.columns))


@importable
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality_filter), ("n-gram Jaccard join", near_duplicates),
          ("substring dedup", repeated_spans), ("mixing sources to target weights", mixture), ("packing", packed)]
#: A trained classifier decides the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage{n}")
    return docs
