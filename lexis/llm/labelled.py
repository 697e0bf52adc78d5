"""A bounded sample of labelled texts for fitting a classifier on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 6000
MAX_CHARS = 20_000


def fold(id_col, modulus: int):
    """crc32 of the id as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def within_budget(docs: DataFrame, drawn: DataFrame, max_rows: int, max_chars: int) -> DataFrame:
    """t, y of the documents (k, t) drawn (k, y): in order of a hash, each text whole if it
    fits what is left of max_rows x max_chars characters, whatever its own length."""
    found = (docs.where("t is not null").join(F.broadcast(drawn), "k")  # at most max_rows rows
             .withColumn("th", F.xxhash64("t")))
    sizes = (found.select("k", "th", F.length("t").alias("n")).distinct()
             .orderBy(F.xxhash64("k"), "th").limit(max_rows).collect())
    rest, kept = max_rows * max_chars, []
    for r in sizes:
        if r.n <= rest:
            rest -= r.n
            kept.append((r.k, r.th))
    key = docs.schema["k"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(kept, f"k {key}, th long")
    return (found.join(F.broadcast(chosen), ["k", "th"]).dropDuplicates(["k", "th"])
            .orderBy(F.xxhash64("k"), "th").limit(max_rows).select("t", "y"))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, trainable, max_rows: int = MAX_ROWS,
           max_chars: int = MAX_CHARS, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of at most ``max_rows`` labelled documents.

    ``trainable`` is a condition on the id column.  The ids are drawn from the
    label table in order of a hash; texts of any length are used whole, while at
    most max_rows x max_chars characters in all reach the driver.  Null labels are ignored; of several labels for an id the largest counts.
    """
    drawn = (labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y"))
             .where(F.col("y").isNotNull() & F.col("k").isNotNull())
             .groupBy("k").agg(F.max("y").alias("y"))
             .where(trainable("k")).orderBy(F.xxhash64("k"), "k").limit(max_rows))
    rows = within_budget(docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")), drawn, max_rows, max_chars).toArrow()
    return rows.column("t").to_pylist(), np.array(rows.column("y").to_pylist(), np.float64)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def best_cut(logits: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the fewest errors; within a gap, its middle."""
    order = np.argsort(logits, kind="stable")
    z, t = logits[order], y[order]
    errors = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0]])
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    errors[1:-1][z[1:] == z[:-1]] = len(z) + 1
    best = np.flatnonzero(errors == errors.min())
    return float(edges[best[len(best) // 2]])


class Adam:
    """Adam over a dictionary of arrays, in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.n = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.n += 1
        size = self.rate * np.sqrt(1 - 0.999 ** self.n) / (1 - 0.9 ** self.n)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= size * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)
