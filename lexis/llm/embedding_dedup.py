"""Embedding near-dedup by Euclidean p-stable hashing.

1. Vectors equal in every component, with equal labels, are one class; only
   classes are compared.  Vectors that are null, zero or hold null or non-finite
   components, and those with a null label, link with nothing.
2. Vectors are normalised.  A table hashes one to floor((a . x + b) / WINDOW) for
   ``k`` Gaussian directions a and shifts b; equal hashes, label and length are a bucket.
3. Buckets are compared in tiles (see ``blocks``) by cosine in double precision; a
   pair that meets in several tables counts in the first.
4. ``k`` is chosen so that a vector meets FAR_MEETS orthogonal ones of the largest
   label in a table on average, and the number of tables so that a pair at the
   threshold meets with probability ``recall``; closer pairs meet more surely.

The result has a row for each vector: vec_id, n_links (other vectors linked
directly, copies included), component_id (the smallest vec_id reachable), kept
(vec_id = component_id).  Rows that share an id are separate vectors.  An empty
table gives no rows.  Only the id, vector and label columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexis.llm.blocks import bucket_sizes, link_rows, meets_first, pair_mask, per_tile, tiles
from lexis.llm.common import cut
from lexis.llm.components import components
from lexis.llm.vectors import finite_rows, stacked

THRESHOLD, RECALL, WINDOW, FAR_MEETS = 0.93, 0.9999, 2.0, 0.05


def meet_chance(distance: float, window: float = WINDOW) -> float:
    """Chance that two vectors at a distance agree in one p-stable hash."""
    r = window / max(distance, 1e-9)
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(hashes in a table, tables) for n vectors of one label."""
    far = meet_chance(math.sqrt(2.0))
    k = max(4, math.ceil(math.log(max(n, 1) / FAR_MEETS) / -math.log(far)))
    near = meet_chance(math.sqrt(max(2 - 2 * threshold, 1e-12))) ** k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near)))


def _base(vectors: DataFrame) -> DataFrame:
    """(vec_id, member, label, vec): member is null where nothing can link."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = b.column("label").to_pylist()
            member, blob = [None] * b.num_rows, [None] * b.num_rows
            for i, v in zip(*finite_rows(b.column("embedding"))):
                if labels[i] is not None and v.any():
                    blob[i] = (v + 0.0).tobytes()
                    member[i] = hashlib.blake2b(labels[i].encode() + b"\0" + blob[i], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array(member, pa.binary()), b.column("label"), pa.array(blob, pa.binary())],
                names=["vec_id", "member", "label", "vec"])

    return vectors.mapInArrow(task, f"vec_id {id_type}, member binary, label string, vec binary")


def _hashes(classes: DataFrame, k: int, tables: int, seed: int) -> DataFrame:
    """(key, member): a row for each class and table."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for b in batches:
            blobs, labels = b.column("vec").to_pylist(), b.column("label").to_pylist()
            salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in labels], np.uint64)
            size = np.array([len(x) // 8 for x in blobs])
            for dim in np.unique(size):
                if dim not in drawn:
                    rng = np.random.default_rng([seed, int(dim)])
                    drawn[dim] = (rng.normal(size=(dim, k * tables)), rng.uniform(0, WINDOW, k * tables),
                                  rng.integers(1, 1 << 63, k * tables, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
                direction, shift, odd = drawn[dim]
                own = np.flatnonzero(size == dim)
                for lo in range(0, len(own), 1024):
                    part = own[lo:lo + 1024]
                    x = stacked([blobs[i] for i in part])
                    x = x / np.sqrt((x * x).sum(axis=1))[:, None]
                    h = np.floor((x @ direction + shift) / WINDOW).astype(np.int64).view(np.uint64)
                    h = (h + np.uint64(1 << 20)) * odd
                    h ^= h >> np.uint64(29)
                    key = (h * odd[::-1]).reshape(len(part), tables, k).sum(axis=2) + salt[part][:, None]
                    key = (key ^ (key >> np.uint64(31))) * odd[:tables] + np.uint64(dim)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.ravel().view(np.int64)), b.column("member").take(pa.array(np.repeat(part, tables)))],
                        names=["key", "member"])

    return classes.select("member", "label", "vec").mapInArrow(task, "key long, member binary")


def _links(threshold: float):
    def work(t: pa.Table) -> pa.RecordBatch | None:
        x = stacked(t.column("vec").to_pylist())
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
        labels = np.unique(np.array(t.column("label").to_pylist(), object).astype(str), return_inverse=True)[1]
        linked = (x @ x.T >= threshold) & (labels[:, None] == labels[None, :])
        linked &= pair_mask(t.column("late").to_numpy(), t.column("own")[0].as_py())
        if not linked.any():
            return None
        linked &= meets_first(t.column("key")[0].as_py(), [np.array(k, np.int64) for k in t.column("keys").to_pylist()])
        return link_rows(t.column("member").combine_chunks(), t.column("copies").to_numpy(), linked)

    return work


def dedup(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 11,
          id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    base = cut(_base(vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding"),
                                    F.col(label_col).cast("string").alias("label"))), "vectors")
    classes = cut(base.where("member is not null").groupBy("member").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"),
        F.first("vec").alias("vec")), "classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    k, tables = plan(most or 1, threshold, recall)
    rows = cut(_hashes(classes, k, tables, seed), "hashes")
    rows = cut(rows.join(bucket_sizes(rows, "buckets"), "key"), "members")
    keys = rows.groupBy("member").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    payload = cut(keys.join(classes.select("member", "label", "vec", "copies"), "member"), "payload")
    found = cut(per_tile(tiles(rows).join(payload, "member"), _links(threshold), "a binary, b binary, links long"), "links")

    group = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("member")).agg(F.sum("links").alias("links"))
    own = (classes.select("member", "least", "copies").join(links, "member", "left")
           .join(group.select(F.col("id").alias("member"), "root"), "member", "left")
           .where("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "member")))
    own = cut(own, "grouped")
    heads = cut(own.groupBy("root").agg(F.min("least").alias("component_id")), "heads")
    own = cut(own.join(heads, "root").select("member", "component_id",
                                             (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "own")
    out = base.select("vec_id", "member").join(own, "member", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON e.vec_id = l.x LEFT JOIN counts c ON e.vec_id = c.x
"""
