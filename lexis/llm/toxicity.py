"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the mean of the embeddings of a few hash buckets: the word,
its prefixes and its suffix, so that inflected forms share weight.  Filters of
width 1, 2 and 3 slide over the whole text, each filter's largest response
(rectified) is kept, and a logistic unit combines them.  Everything is trained
in numpy on a bounded sample of labelled rows (labelled.MAX_ROWS x MAX_CHARS):
some of them set a threshold for each language, all others train all weights.
The first embedding dimension starts at a bucket's shrunk log odds; while the
weights are trained, a text meets those of the parts that it is not in.  The language is guessed from the text's own stop words; the
language, source and id columns are never read.  A text's score is the logistic
of its logit minus its language's threshold, so 0.5 is the threshold.

Scoring is a map over all rows, one scan without a shuffle.  Null and empty
texts have no words and get the score of an all-zero text.  Without labelled
rows of both classes every score is the share of positive labels (0.5 without any).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexis.llm.common import entering, slices
from lexis.llm.labelled import MAX_CHARS, MAX_ROWS, Adam, best_cut, fold, sample, sigmoid

# fixed values: frequent function words that tell the languages apart
STOP_WORDS = {
    "en": "the of and to in is it that was for with as this be are from by an",
    "de": "der die das und den ist mit zu von für ein eine nicht auf sich des dem im",
    "fr": "le la les des et est une dans pour que sur avec pas un au en du ce",
    "es": "el los las y una por con para del se su al lo un es en que como",
}
LANGS = [*STOP_WORDS, "other"]
_STOPS = {w: [w in v.split() for v in STOP_WORDS.values()] for w in {w for v in STOP_WORDS.values() for w in v.split()}}
_WORD = re.compile(r"\w+")
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 16, 8, (1, 2, 3)
PARTS = 5  # of the training texts
CACHE_WORDS = 200_000


def buckets(word: str) -> list[int]:
    """Five hash buckets of a word: itself, prefixes of 3, 4 and 5, suffix of 3."""
    parts = (f"={word}", f"<{word[:3]}", f"<{word[:4]}", f"<{word[:5]}", f">{word[-3:]}")
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


class Words(dict):
    """word -> row of (bucket ids, stop-word flags); row 0 is padding."""

    def __init__(self):
        super().__init__()
        self.buckets: list[list[int]] = [[0] * 5]
        self.flags: list[list[bool]] = [[False] * len(STOP_WORDS)]

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self.buckets)
        self.buckets.append(buckets(word))
        self.flags.append(_STOPS.get(word, self.flags[0]))
        return row

    def rows(self, text: str | None) -> np.ndarray:
        found = _WORD.findall(text.lower()) if text else []
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def _language(counts: np.ndarray) -> np.ndarray:
    """Per row of stop-word counts the language's place in LANGS."""
    return np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), len(STOP_WORDS))


def _layout(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All word rows, every text followed by padding, and where texts begin."""
    size = np.array([len(r) + max(WIDTHS) for r in rows])
    begin = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), np.int64)
    for r, b in zip(rows, begin):
        flat[b:b + len(r)] = r
    return flat, begin


def fit(texts: list[str], y: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 1) -> dict:
    """Train; returns the weights as arrays."""
    if len(y) < 20 or y.min() == y.max():
        prior = float(y.mean()) if len(y) else 0.5
        return {"constant": min(max(prior, 0.0), 1.0)}
    rng = np.random.default_rng(seed)
    words = Words()
    rows = [words.rows(t) for t in texts]
    sub, flags = np.array(words.buckets), np.array(words.flags, np.float32)
    order = rng.permutation(len(y))
    train, third = np.split(order, [len(y) * 85 // 100])

    emb = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
    emb[:, 0] = 0  # beside the start value
    part = np.full(len(y), PARTS)
    part[train] = np.arange(len(train)) % PARTS
    seen, many = np.zeros((PARTS, 2, BUCKETS)), np.zeros((PARTS, 2))
    for d in train:
        seen[part[d], int(y[d]), np.unique(sub[np.unique(rows[d])])] += 1
        many[part[d], int(y[d])] += 1
    start, shrink = np.zeros((PARTS + 1, BUCKETS), np.float32), 4.0
    for k in range(PARTS + 1):  # the last one from all parts
        s, m = (seen.sum(axis=0), many.sum(axis=0)) if k == PARTS else (seen.sum(axis=0) - seen[k], many.sum(axis=0) - many[k])
        share = np.maximum(m, 1) / m.sum()
        start[k] = np.log((s[1] / share[1] + shrink) / (s[0] / share[0] + shrink))
    del seen
    p = {"out": np.full(len(WIDTHS) * FILTERS, 0.1), "bias": np.array([-2.0])}
    for w in WIDTHS:
        f = rng.normal(0, 0.05, (w, DIM, FILTERS))
        f[:, 0, : FILTERS // 2] += 1.0 / w
        p[f"f{w}"], p[f"b{w}"] = f, np.full(FILTERS, -0.1)
    adam = Adam(p, rate)
    emb_sq = np.full(BUCKETS, 1e-2)

    def forward(docs):
        flat, begin = _layout([rows[d] for d in docs])
        x = emb[sub[flat]].mean(axis=1)
        own = np.repeat(part[docs], np.diff(np.append(begin, len(flat))))
        x[:, 0] += start[own[:, None], sub[flat]].mean(axis=1)
        x[flat == 0] = 0
        pooled, where = [], []
        for w in WIDTHS:
            n = len(flat) - w + 1
            z = sum(x[j:n + j] @ p[f"f{w}"][j] for j in range(w)) + p[f"b{w}"]
            ends = np.append(begin[1:], len(flat)) - max(WIDTHS)
            at = np.stack([b + z[b:max(e, b + 1)].argmax(axis=0) for b, e in zip(begin, ends)])
            where.append(at)
            pooled.append(np.take_along_axis(z, at, axis=0))
        pooled = np.concatenate(pooled, axis=1)
        act = np.maximum(pooled, 0)
        return flat, x, where, pooled, act, act @ p["out"] + p["bias"][0]

    for _ in range(max(epochs, 200 * 32 // len(train))):  # a small sample gets more rounds
        for docs in np.array_split(rng.permutation(train), max(1, len(train) // 32)):
            flat, x, where, pooled, act, logit = forward(docs)
            g = (sigmoid(logit) - y[docs]) / len(docs)
            grads = {"out": act.T @ g + 1e-4 * p["out"], "bias": np.array([g.sum()])}
            back = np.outer(g, p["out"]) * (pooled > 0)
            dx = np.zeros_like(x)
            for n, w in enumerate(WIDTHS):
                gw = back[:, n * FILTERS:(n + 1) * FILTERS]
                grads[f"b{w}"] = gw.sum(axis=0)
                df = np.empty_like(p[f"f{w}"])
                for j in range(w):
                    df[j] = np.einsum("dk,dke->ek", gw, x[where[n] + j])
                    np.add.at(dx, (where[n] + j).ravel(),
                              (gw[:, :, None] * p[f"f{w}"][j].T[None]).reshape(-1, DIM))
                grads[f"f{w}"] = df
            adam.step(grads)
            hit = np.flatnonzero(np.abs(dx).sum(axis=1) * (flat > 0))
            if len(hit):
                which, gx = sub[flat[hit]].ravel(), np.repeat(dx[hit] / sub.shape[1], sub.shape[1], axis=0)
                np.add.at(emb_sq, which, (gx * gx).sum(axis=1))
                np.add.at(emb, which, (-0.05 * gx / np.sqrt(emb_sq[which])[:, None]).astype(np.float32))

    logit = np.concatenate([forward(d)[-1] for d in np.array_split(third, max(1, len(third) // 64))])
    lang = _language(np.stack([flags[rows[d]].sum(axis=0) for d in third]))
    cuts = np.full(len(LANGS), best_cut(logit, y[third]))
    for k in range(len(LANGS)):
        own = lang == k
        if own.sum() >= 20 and y[third][own].sum() >= 5:
            cuts[k] = best_cut(logit[own], y[third][own])
    emb[:, 0] += start[PARTS]
    proj = np.concatenate([(emb @ p[f"f{w}"][j]) for w in WIDTHS for j in range(w)], axis=1)
    return {"proj": proj.astype(np.float32), "out": p["out"], "bias": p["bias"], "cuts": cuts,
            **{f"b{w}": p[f"b{w}"] for w in WIDTHS}}


class Scorer:
    """Scores texts; keeps each known word's projections, a bounded number of words."""

    def __init__(self, model: dict):
        self.m = model
        self._reset()

    def _reset(self) -> None:
        self.words, self.proj, self.flags = Words(), None, None

    def _extend(self) -> None:
        have = 0 if self.flags is None else len(self.flags)
        new = np.array(self.words.buckets[have:])
        if len(new):
            proj = sum(self.m["proj"][new[:, i]] for i in range(new.shape[1])) / new.shape[1]
            flags = np.array(self.words.flags[have:], np.int32)
            parts = [np.ascontiguousarray(proj[:, c:c + FILTERS]) for c in range(0, proj.shape[1], FILTERS)]
            if have:
                parts = [np.concatenate([old, new]) for old, new in zip(self.proj, parts)]
                flags = np.concatenate([self.flags, flags])
            else:
                for part in parts:
                    part[0] = 0
            self.proj, self.flags = parts, flags

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > CACHE_WORDS:
            self._reset()
        flat, begin = _layout([self.words.rows(t) for t in texts])
        self._extend()
        pooled, col = [], 0
        pad = flat == 0
        for w in WIDTHS:
            z = np.take(self.proj[col], flat, axis=0)
            for j in range(1, w):
                z[:-j] += np.take(self.proj[col + j], flat[j:], axis=0)
            z[pad] = -np.inf  # windows begin at a word, as in training
            best = np.maximum.reduceat(z, begin, axis=0)
            pooled.append(np.where(np.isfinite(best), best, 0) + self.m[f"b{w}"])
            col += w
        act = np.maximum(np.concatenate(pooled, axis=1), 0)
        lang = _language(np.add.reduceat(self.flags[flat], begin, axis=0))
        return act @ self.m["out"] + self.m["bias"][0], lang

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
        if "constant" in self.m:
            return np.full(len(texts), self.m["constant"]), ["other"] * len(texts)
        score, lang = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for lo, hi in slices(texts, 1_000_000):
            z, k = self.logits(texts[lo:hi])
            score[lo:hi], lang[lo:hi] = sigmoid(z - self.m["cuts"][k]), k
        return score, [LANGS[k] for k in lang]


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, language (guessed) of every row.  The model is 25 MB of
    weights at most, sent to each executor once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("toxicity")
        run = Scorer(shared.value)
        for b in batches:
            got, lang = run(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got), pa.array(lang)],
                                             names=["doc_id", "score", "language"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        task, f"doc_id {id_type}, score double, language string")


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 5, held_out: int = 0,
             max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Fit on labelled rows outside the held-out fold and score every document."""
    texts, y = sample(docs, labels, label_col, lambda k: fold(k, folds) != held_out, max_rows, max_chars)
    return score(docs, fit(texts, y)).select(
        "doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "language")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
