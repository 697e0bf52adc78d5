"""Quality: a byte-level convolutional network.

Bytes are embedded and filters of width ``WIDTH`` slide over every byte of the
document.  Each filter's responses are max-pooled in overlapping chunks of
2 x HALF bytes (a new chunk every HALF bytes), which together cover the whole
document; the mean, largest and smallest pooled response over the chunks feed a
small hidden layer and one logistic unit.  Trained in numpy on a bounded sample
of labelled rows (labelled.MAX_ROWS x MAX_CHARS).  A held-back part of it sets the
cut with the fewest errors, and scores are shifted so that the cut is at
``threshold``.

Scoring is a map over all rows, one scan without a shuffle.  Null and empty
texts are one chunk of padding.  Without labelled rows of both classes every
score is the share of positive labels (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexis.llm.common import entering, slices
from lexis.llm.labelled import MAX_CHARS, MAX_ROWS, Adam, best_cut, fold, sample, sigmoid

HALF, WIDTH, DIM, FILTERS, HIDDEN = 128, 6, 8, 16, 16
THRESHOLD = 0.7
BLOCK = 1 << 16  # bytes convolved at a time; a multiple of HALF


def layout(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All documents' bytes, each zero-padded to whole halves (by WIDTH - 1 bytes
    at least, so that no window from its bytes sees the next), and each one's
    number of halves."""
    halves = np.array([(len(r) + WIDTH - 1 + HALF - 1) // HALF for r in raw], np.int64)
    flat = b"".join(r.ljust(h * HALF, b"\0") for r, h in zip(raw, halves))
    return np.frombuffer(flat, np.uint8), halves


def crossing(halves: np.ndarray) -> np.ndarray:
    """Places in the padding whose windows would see the next document; they don't count."""
    return (np.cumsum(halves)[:, None] * HALF - 1 - np.arange(WIDTH - 1)).ravel()


def chunk_features(peaks: np.ndarray, halves: np.ndarray):
    """Mean, largest and smallest chunk response of each document, from the peaks
    of its halves.  Also what the gradient needs: which half made each."""
    end = np.cumsum(halves)
    begin = end - halves
    last = np.zeros(len(peaks), bool)
    last[end - 1] = True
    nxt = np.where((last & ~(np.isin(np.arange(len(peaks)), begin)))[:, None], -np.inf, np.roll(peaks, -1, axis=0))
    single = np.repeat(halves == 1, halves)
    nxt[single] = -np.inf
    chunk = np.maximum(peaks, nxt)
    count = np.maximum(halves - 1, 1)
    keep = ~last | single  # the last half belongs to the chunk before it
    inner = chunk[keep]
    at = np.cumsum(count) - count
    act = np.maximum(inner, 0)
    mean = np.add.reduceat(act, at, axis=0) / count[:, None]
    top = np.maximum.reduceat(act, at, axis=0)
    low = np.minimum.reduceat(act, at, axis=0)
    return np.concatenate([mean, top, low], axis=1), (keep, nxt, inner, at, count, act, top, low)


def fit(texts: list[str], y: np.ndarray, epochs: int = 5, rate: float = 0.01, seed: int = 1,
        threshold: float = THRESHOLD, most_bytes: int = 12_000_000) -> dict:
    """Train on the sample; an epoch sees documents of ``most_bytes`` in all."""
    if len(y) < 20 or y.min() == y.max():
        return {"constant": min(max(float(y.mean()) if len(y) else 0.5, 0.0), 1.0)}
    rng = np.random.default_rng(seed)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    order = rng.permutation(len(y))
    train, held = np.split(order, [len(y) * 3 // 4])
    p = {"emb": rng.normal(0, 0.5, (256, DIM)), "filters": rng.normal(0, 0.25, (WIDTH, DIM, FILTERS)),
         "fb": np.full(FILTERS, 0.1), "w1": rng.normal(0, 0.2, (3 * FILTERS, HIDDEN)), "b1": np.zeros(HIDDEN),
         "w2": rng.normal(0, 0.3, HIDDEN), "b2": np.array([float(np.log(y.mean() / (1 - y.mean())))])}
    adam = Adam(p, rate)

    def peaks_of(flat, halves):
        table = np.einsum("bd,jdk->jbk", p["emb"], p["filters"]).astype(np.float32)
        z = np.zeros((len(flat), FILTERS), np.float32) + p["fb"].astype(np.float32)
        for j in range(WIDTH):
            z[:len(flat) - j] += table[j][flat[j:]]
        z[crossing(halves)] = -np.inf
        z = z.reshape(-1, HALF, FILTERS)
        at = z.argmax(axis=1)
        return np.take_along_axis(z, at[:, None], axis=1)[:, 0].astype(np.float64), at + np.arange(len(z))[:, None] * HALF

    def head(feat):
        hid = np.tanh(feat @ p["w1"] + p["b1"])
        return hid, hid @ p["w2"] + p["b2"][0]

    for _ in range(max(epochs, 1000 * 16 // len(train))):  # a small sample gets more rounds
        docs = rng.permutation(train)
        docs = docs[np.cumsum([len(raw[d]) for d in docs]) <= max(most_bytes, len(raw[docs[0]]))]
        for part in np.array_split(docs, max(1, len(docs) // 16)):
            flat, halves = layout([raw[d] for d in part])
            peaks, where = peaks_of(flat, halves)
            feat, (keep, nxt, inner, at, count, act, top, low) = chunk_features(peaks, halves)
            hid, logit = head(feat)
            g = (sigmoid(logit) - y[part]) / len(part)
            dh = np.outer(g, p["w2"]) * (1 - hid * hid)
            dfeat = dh @ p["w1"].T
            dmean, dtop, dlow = np.split(dfeat, 3, axis=1)
            of = np.repeat(np.arange(len(part)), count)
            is_top, is_low = act == top[of], act == low[of]
            ties = lambda m: np.maximum(np.add.reduceat(m, at, axis=0, dtype=float), 1)[of]
            dact = (dmean / count[:, None])[of] + dtop[of] * is_top / ties(is_top) + dlow[of] * is_low / ties(is_low)
            dinner = dact * (inner > 0)
            dpeaks = np.zeros_like(peaks)
            rows = np.flatnonzero(keep)
            from_next = nxt[rows] > peaks[rows]
            dpeaks[rows] += np.where(from_next, 0, dinner)
            np.add.at(dpeaks, np.minimum(rows + 1, len(peaks) - 1), np.where(from_next, dinner, 0))
            dtable = np.empty((WIDTH, 256, FILTERS))
            k = np.arange(FILTERS)[None, :]
            for j in range(WIDTH):
                byte = flat[np.minimum(where + j, len(flat) - 1)].astype(np.int64)
                dtable[j] = np.bincount((byte * FILTERS + k).ravel(), dpeaks.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            adam.step({"emb": np.einsum("jbk,jdk->bd", dtable, p["filters"]),
                       "filters": np.einsum("bd,jbk->jdk", p["emb"], dtable), "fb": dpeaks.sum(axis=0),
                       "w1": feat.T @ dh + 1e-4 * p["w1"], "b1": dh.sum(axis=0),
                       "w2": hid.T @ g + 1e-4 * p["w2"], "b2": np.array([g.sum()])})

    out = []
    for part in np.array_split(held, max(1, len(held) // 64)):
        flat, halves = layout([raw[d] for d in part])
        out.append(head(chunk_features(peaks_of(flat, halves)[0], halves)[0])[1])
    cut = best_cut(np.concatenate(out), y[held])
    table = np.einsum("bd,jdk->jbk", p["emb"], p["filters"])
    pairs = (table[0::2, :, None] + table[1::2, None, :]).reshape(WIDTH // 2, 1 << 16, FILTERS)
    return {"pairs": pairs.astype(np.float32), "fb": p["fb"].astype(np.float32), "w1": p["w1"], "b1": p["b1"],
            "w2": p["w2"], "b2": p["b2"][0] - cut + float(np.log(threshold / (1 - threshold)))}


class Scorer:
    """Scores whole texts: one table row for each pair of bytes replaces two
    steps of the convolution."""

    def __init__(self, model: dict):
        self.m = model

    def _peaks(self, flat: np.ndarray, halves: np.ndarray) -> np.ndarray:
        out = np.empty((len(flat) // HALF, FILTERS), np.float32)
        skip = np.zeros(len(flat), bool)
        skip[crossing(halves)] = True
        wide = np.concatenate([flat, np.zeros(WIDTH, np.uint8)]).astype(np.int32)
        pair = (wide[:-1] << 8) + wide[1:]
        for lo in range(0, len(flat), BLOCK):
            hi = min(lo + BLOCK, len(flat))
            z = np.take(self.m["pairs"][0], pair[lo:hi], axis=0)
            for j in range(1, WIDTH // 2):
                z += np.take(self.m["pairs"][j], pair[lo + 2 * j:hi + 2 * j], axis=0)
            z[skip[lo:hi]] = -np.inf
            out[lo // HALF:hi // HALF] = z.reshape(-1, HALF, FILTERS).max(axis=1)
        return out + self.m["fb"]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if "constant" in self.m:
            return np.full(len(texts), self.m["constant"])
        score = np.empty(len(texts))
        for lo, hi in slices(texts, 1_000_000):
            flat, halves = layout([(t or "").encode("utf-8", "surrogatepass") for t in texts[lo:hi]])
            feat, _ = chunk_features(self._peaks(flat, halves).astype(np.float64), halves)
            score[lo:hi] = sigmoid(np.tanh(feat @ self.m["w1"] + self.m["b1"]) @ self.m["w2"] + self.m["b2"])
        return score


def score(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score.  The model (12 MB) goes to each executor once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index(text_col), [*docs.columns, score_col]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("quality")
        run = Scorer(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(run(b.column(at).to_pylist()))], names=names)

    return docs.mapInArrow(task, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def model_for(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 4, held_out: int = 2,
              max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> dict:
    """Fit on labelled rows outside the held-out fold."""
    return fit(*sample(docs, labels, label_col, lambda k: fold(k, folds) != held_out, max_rows, max_chars))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = model_for(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
