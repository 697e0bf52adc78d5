"""Term vectors: tokens, term frequencies, feature hashing, L2 norms, cosine.

Long form is used throughout: one row per (key..., feature) with a double
``tf``.  Callers that hash-partition their input by a document column get
every aggregation below without another shuffle (the grouping keys always
contain the document key), and cosine scores become a broadcast join plus a
partition-local sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexis.functions.text import term_tokens

# Fixed value (reference vectoriser width): 2**18 unsigned hashed features.
NUM_FEATURES = 1 << 18


def feature_bucket(term, num_features: int = NUM_FEATURES) -> Column:
    """Term -> feature index in [0, num_features).

    First 32 bits of the MD5 digest, modulo the width: reproducible in any
    engine that has md5 (the oracle uses the same expression).
    """
    t = F.col(term) if isinstance(term, str) else term
    h = F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint")
    return (h % F.lit(num_features)).cast("int")


def explode_terms(df: DataFrame, keys: Sequence[str], text_col: str,
                  out: str = "term") -> DataFrame:
    """One row per vectoriser token, with its position."""
    return df.select(*keys, F.posexplode(term_tokens(text_col)).alias("pos", out)) \
             .withColumn("pos", F.col("pos").cast("bigint"))


def term_frequency(df: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """(keys..., term, tf) with tf the number of occurrences."""
    return (df.select(*keys, F.explode(term_tokens(text_col)).alias("term"))
              .groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf")))


def hashed_tf(df: DataFrame, keys: Sequence[str], text_col: str,
              num_features: int = NUM_FEATURES, lowercase: bool = True) -> DataFrame:
    """(keys..., feature, tf): hashed term counts, collisions add up."""
    return (df.select(*keys, F.explode(term_tokens(text_col, lowercase)).alias("term"))
              .select(*keys, feature_bucket("term", num_features).alias("feature"))
              .groupBy(*keys, "feature").agg(F.count(F.lit(1)).cast("double").alias("tf")))


def with_norm(tf: DataFrame, keys: Sequence[str], value: str = "tf",
              out: str = "norm") -> DataFrame:
    """Attach the Euclidean norm of each key's vector to each of its rows."""
    w = Window.partitionBy(*keys)
    return tf.withColumn(out, F.sqrt(F.sum(F.col(value) * F.col(value)).over(w)))


def vectors(df: DataFrame, keys: Sequence[str], text_col: str,
            num_features: int = NUM_FEATURES, lowercase: bool = True) -> DataFrame:
    """(keys..., feature, tf, norm)."""
    return with_norm(hashed_tf(df, keys, text_col, num_features, lowercase), keys)


def l2_normalize(vec: DataFrame) -> DataFrame:
    """(keys..., feature, weight) with weight = tf / norm (0 for empty rows)."""
    return vec.withColumn("weight", F.when(F.col("norm") > 0, F.col("tf") / F.col("norm"))
                                     .otherwise(F.lit(0.0)))


def cosine_from_dot(dot: Column, norm_a: Column, norm_b: Column) -> Column:
    """dot / (|a| |b|), 0.0 when either vector is empty.  Unrounded: rank on
    this value and round only what is shown."""
    denom = norm_a * norm_b
    return F.when(denom > 0, dot / denom).otherwise(F.lit(0.0))


def dense_cosine(a, b) -> Column:
    """Cosine of two equally long numeric arrays, computed element-wise."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    ad = F.transform(a, lambda x: x.cast("double"))
    bd = F.transform(b, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(ad, bd, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    na = F.sqrt(F.aggregate(ad, F.lit(0.0), lambda s, x: s + x * x))
    nb = F.sqrt(F.aggregate(bd, F.lit(0.0), lambda s, x: s + x * x))
    return cosine_from_dot(dot, na, nb)


def adjacent_cosine(pairs: DataFrame, doc: str, line: str, text: str,
                    num_features: int = NUM_FEATURES, lowercase: bool = True) -> DataFrame:
    """(doc, line, next_line, similarity): cosine of each line with the next
    stored line of the same document.

    ``pairs`` holds both texts of a pair in one row (``line_pairs``), which is scored where it is: no row
    a term, no shuffle.
    """
    from lexis.operators.packed import pair_cosines
    cos = pair_cosines(pairs, [doc, line, "next_line"], text, "_next", num_features, lowercase)
    return cos.select(doc, line, "next_line", F.round("similarity", 6).alias("similarity"))


def next_row_dense_cosine(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, next_id, similarity): each vector against the vector with id + 1."""
    a = df.select(F.col(id_col), F.col(vec_col).alias("_a"))
    b = df.select((F.col(id_col) - 1).alias(id_col), F.col(id_col).alias("next_id"),
                  F.col(vec_col).alias("_b"))
    return a.join(b, id_col).select(id_col, "next_id", F.round(dense_cosine("_a", "_b"), 6).alias("similarity"))


_ML_VECTOR = "struct<v:struct<type:int,size:int,indices:array<int>,values:array<double>>>"


def ml_hashed_tf(df: DataFrame, keys: Sequence[str], text_col: str,
                 num_features: int = NUM_FEATURES) -> DataFrame:
    """(keys..., feature, tf) from Spark ML's HashingTF (murmur3 buckets).

    The ML sparse vector is unpacked JVM-side through its struct form, so the
    long-form rows stay in the engine's format.
    """
    from pyspark.ml.feature import HashingTF
    toks = df.select(*keys, term_tokens(text_col).alias("_toks"))
    vec = HashingTF(inputCol="_toks", outputCol="_v", numFeatures=num_features).transform(toks)
    parsed = vec.select(*keys, F.from_json(F.to_json(F.struct(F.col("_v").alias("v"))),
                                           _ML_VECTOR)["v"].alias("_s"))
    return (parsed.select(*keys, F.explode(F.arrays_zip(F.col("_s.indices").alias("feature"),
                                                        F.col("_s.values").alias("tf"))).alias("_e"))
                  .select(*keys, F.col("_e.feature").alias("feature"), F.col("_e.tf").alias("tf")))
