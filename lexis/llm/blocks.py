"""Comparing the rows of each bucket pair by pair, in blocks of bounded size.

A bucket of n rows is dealt into ceil(n / BLOCK) parts by a hash of the member.
Every pair of parts is a tile, and a row goes to each tile of its own part, so
one huge bucket becomes many tasks of at most about 2 x BLOCK rows.  Tiles hand
on counts and spanning forests, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexis.llm.common import cut

BLOCK = 512


def bucket_sizes(rows: DataFrame, tag: str) -> DataFrame:
    """(key, n) of the buckets with two members or more, as a written table, so
    that joins with it can split a hot bucket's rows."""
    return cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), tag)


def tiles(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, member, n) to (key, tile, side, member): each row once for every tile of its part."""
    parts = F.ceil(F.col("n") / block)
    mine = F.pmod(F.xxhash64("member", "key"), F.col("parts"))
    first, second = F.least("mine", "other"), F.greatest("mine", "other")
    return (rows.withColumn("parts", parts.cast("long")).withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            .select("key", (first * F.col("parts") + second).alias("tile"),
                    F.when(F.col("mine") == second, 1).otherwise(0).cast("int").alias("late"),
                    (first == second).alias("own"), "member"))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, as tables; holds one batch and one run."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        if held and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, cols)):
            yield pa.Table.from_batches(held)
            held = []
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        lo = 0
        for hi in np.flatnonzero(change) + 1:
            yield pa.Table.from_batches([*held, batch.slice(lo, hi - lo)])
            held, lo = [], hi
        held.append(batch.slice(lo))
    if held:
        yield pa.Table.from_batches(held)


def per_tile(rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Run ``work`` on the rows of each (key, tile) of two rows or more."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["key", "tile"]):
            out = work(table) if table.num_rows > 1 else None
            if out is not None and out.num_rows:
                yield out

    return rows.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(task, schema)


def pair_mask(late: np.ndarray, own: bool) -> np.ndarray:
    """Which pairs (i, j) of a tile's rows count: i < j within one part, or one
    row of each of two parts (i in the first)."""
    if own:
        return np.triu(np.ones((len(late), len(late)), bool), 1)
    return (late[:, None] == 0) & (late[None, :] == 1)


def meets_first(key: int, keys: list[np.ndarray]) -> np.ndarray:
    """Pairs that share no bucket with a smaller key: a pair that meets in
    several buckets counts in the first of them only."""
    smaller = [k[k < key] for k in keys]
    flat = np.concatenate(smaller) if smaller else np.zeros(0, np.int64)
    if not len(flat):
        return np.ones((len(keys), len(keys)), bool)
    _, col = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(keys)), [len(s) for s in smaller])
    met = np.zeros((len(keys), len(keys)), bool)
    for lo in range(0, int(col.max()) + 1, 2048):
        part = (col >= lo) & (col < lo + 2048)
        member = np.zeros((len(keys), 2048), np.float32)
        member[row[part], col[part] - lo] = 1
        met |= member @ member.T > 0
    return ~met


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (parent, child) of a spanning forest of a symmetric link matrix."""
    n, out = len(linked), []
    free = np.ones(n, bool)
    for root in range(n):
        if not free[root]:
            continue
        free[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(linked[at] & free)
            free[new] = False
            out += [(at, int(x)) for x in new]
            queue += new.tolist()
    return out


def link_rows(member: pa.Array, mult: np.ndarray, linked: np.ndarray) -> pa.RecordBatch | None:
    """Rows (a, b, links): the copies that ``a`` links to in this tile (b null),
    and the forest's edges (links 0)."""
    linked = linked | linked.T
    links = linked @ mult
    rows = np.flatnonzero(links)
    if not len(rows):
        return None
    edges = forest(linked)
    a = member.take(pa.array([*rows.tolist(), *(p for p, _ in edges)]))
    b = pa.concat_arrays([pa.nulls(len(rows), member.type), member.take(pa.array([c for _, c in edges], pa.int64()))])
    n = np.concatenate([links[rows], np.zeros(len(edges))]).astype(np.int64)
    return pa.RecordBatch.from_arrays([a, b, pa.array(n)], names=["a", "b", "links"])
