"""Exact top-k search by MaxScore.

Vectors become integers, floor(scale * x); a term is a dimension and a sign, its
postings the candidates whose component has that sign.  A query's terms are
those of its own signs, so a posting adds to a score; a component of the other
sign only lowers it.  A term's bound is the query's component times the largest
in its postings.

Candidates are dealt into shards of about SHARD_ROWS by a hash of the row, queries into
blocks of about QUERY_BYTES, and every (shard, block) is one bounded task unit.  Within
it a query keeps its k best scores so far; the terms with the smallest bounds whose sum
stays below the k-th best are non-essential.  Only candidates in an essential
posting are looked at, and the non-essential terms are probed, largest bound
first, while a candidate can still reach the k-th best.  The shards' best are merged by rank.

Scores are exact: float64 arithmetic while every sum of products stays below 2^53, else
Python integers.  Ties go to the smaller vec_id, then the earlier row.  Vectors that are null,
empty or hold null or non-finite components take no part; shorter ones count as filled with zeros.
With fewer than k candidates all are returned.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexis.llm.blocks import per_tile
from lexis.llm.common import cut
from lexis.llm.vectors import finite_rows, stacked

SCALE, K = 1024, 10
SHARD_ROWS, QUERY_BYTES, STEP, PROBE = 8192, 8 << 20, 1024, 8


def _integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, vec): int64 components as bytes, of the vectors that take part."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = finite_rows(b.column("vec"))
            blobs = [np.floor(scale * v).astype(np.int64).tobytes() for v in found]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(rows)), pa.array(blobs, pa.binary())],
                                             names=["vec_id", "vec"])

    return vectors.mapInArrow(task, f"vec_id {id_type}, vec binary")


class Shard:
    """Postings of one shard's candidates, as columns with each term's largest component."""

    def __init__(self, matrix: np.ndarray, ids: np.ndarray, rows: np.ndarray, step: int = STEP):
        self.step, self.looked = step, 0  # candidates that a query has looked at so far
        order = np.lexsort((rows, ids))
        self.m, self.ids, self.rows = matrix[order], ids[order], rows[order]
        self.top = np.maximum(self.m.max(axis=0, initial=0), 0)
        self.low = np.maximum(-self.m.min(axis=0, initial=0), 0)

    def best(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best, in order of vec_id among equals."""
        terms = np.flatnonzero(q)
        bound = np.where(q[terms] > 0, q[terms] * self.top[terms], -q[terms] * self.low[terms])
        order = np.argsort(bound, kind="stable")  # smallest bounds first
        terms, bound = terms[order], bound[order]
        upto = np.cumsum(bound)  # what the terms up to here can add at most
        best_at, best = np.zeros(0, np.int64), np.zeros(0, self.m.dtype)
        for lo in range(0, len(self.m), self.step):
            part = self.m[lo:lo + self.step]
            full = len(best) >= k
            line = best[-1] if full else None
            # candidates come in order of vec_id, so a later one must beat the line
            split = int(np.searchsorted(upto, line, side="right")) if full else 0
            essential = terms[split:]
            if full and not len(essential):
                continue
            if full:
                hit = ((part[:, essential] * np.sign(q[essential])) > 0).any(axis=1) if split else np.ones(len(part), bool)
                at = np.flatnonzero(hit)
            else:
                at = np.arange(len(part))
            self.looked += len(at)
            score = part[at][:, essential] @ q[essential]
            hi = split
            while hi > 0 and len(at):
                keep = score + upto[hi - 1] > line
                at, score = at[keep], score[keep]
                nxt = max(0, hi - PROBE)
                probe = terms[nxt:hi]
                score = score + part[at][:, probe] @ q[probe]
                hi = nxt
            mine = self.rows[at + lo] != own
            at, score = at[mine] + lo, score[mine]
            if full:
                at, score = at[score > line], score[score > line]
            if len(at):
                best_at, best = np.concatenate([best_at, at]), np.concatenate([best, score])
                order = np.lexsort((best_at, -best))[:k]
                best_at, best = best_at[order], best[order]
        return best_at, best


def _search(k: int, step: int):
    def work(t: pa.Table) -> pa.RecordBatch | None:
        query = t.column("query").to_numpy(zero_copy_only=False)
        m = stacked(t.column("vec").to_pylist(), np.int64)
        ids, rows = t.column("vec_id").to_numpy(), t.column("row").to_numpy()
        if query.all() or not query.any():
            return None
        largest = np.abs(m.astype(np.float64))
        exact = largest[query].max(initial=0) * largest[~query].max(initial=0) * max(m.shape[1], 1) < 2.0 ** 53
        m = m.astype(np.float64) if exact else m.astype(object)
        shard = Shard(m[~query], ids[~query], rows[~query], step)
        out = [[], [], [], [], []]
        for i in np.flatnonzero(query):
            at, score = shard.best(m[i], rows[i], k)
            for col, v in zip(out, ([ids[i]] * len(at), [rows[i]] * len(at), shard.ids[at], shard.rows[at], score)):
                col += [int(x) for x in v]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out],
                                          names=["query_id", "query_row", "vec_id", "row", "score"])

    return work


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id",
           vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_bytes: int = QUERY_BYTES, step: int = STEP) -> DataFrame:
    """query_id, rank, vec_id, score: every query row's k best other rows.
    ``is_query`` is a condition on vec_id."""
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    rows = cut(_integers(slim, scale).withColumn("row", F.monotonically_increasing_id())
               .withColumn("is_query", F.coalesce(is_query, F.lit(False)))
               .withColumn("vec_id", F.coalesce("vec_id", F.lit(-(1 << 63)))), "vectors")
    n = rows.agg(F.count(F.lit(1)), F.sum(F.when(F.col("is_query"), F.length("vec")).otherwise(0))).first()
    shards, groups = -(-n[0] // shard_rows) or 1, -(-(n[1] or 0) // query_bytes) or 1
    deal = F.xxhash64("row")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>"))
    candidates = rows.select(F.pmod(deal, F.lit(shards)).alias("key"), every(groups).alias("tile"), "vec_id", "row", "vec",
                             F.lit(False).alias("query"))
    queries = rows.where("is_query").select(every(shards).alias("key"), F.pmod(deal, F.lit(groups)).alias("tile"),
                                            "vec_id", "row", "vec", F.lit(True).alias("query"))
    found = per_tile(candidates.unionByName(queries), _search(k, step),
                     "query_id long, query_row long, vec_id long, row long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    blank = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c)).alias(c)
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), blank("vec_id"), "score"))


def op7_maxscore(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
