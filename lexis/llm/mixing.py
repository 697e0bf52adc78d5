"""Mixing sources to target weights by soft membership.

1. A linear classifier, fitted on a labelled table (a bounded sample of
   labelled.MAX_ROWS x MAX_CHARS), gives every document a posterior over the domains.
   Its features are hashed words; a document's logit for a domain is a weighted
   sum of the mean and the largest word weight, so one telling word can count.
2. With t_d tokens (words at white space, one at least) and posterior p_d, a
   document adds r_d t_d p_d to the domains' expected totals at rate r_d.  Rates minimise
   sum_k (total_k - target_k)^2 / target_k over r >= 0 by accelerated projected
   gradient from r = 1, in the metric sum_d t_d r_d^2, with the acceleration begun anew where the sum rises.  A
   round is one distributed aggregation of 2 K sums; the driver keeps the rounds' K residuals,
   and tasks recompute a document's rate from them, so no rates are shuffled or collected.  Rounds
   go on until every domain is within TOLERANCE of its own target, or is at rest: ten rounds bring it less than AT_REST of that.
3. ``copies`` turns a rate into a whole number: its integer part, and one more
   if a hash of the document falls below the rest.

Null or empty texts get the posterior of a text without words.  Targets are
weights (normalised) times a budget, by default the table's token total.  A
domain that no document can serve keeps its shortfall; if nothing is labelled the
posteriors are uniform.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from lexis.llm.common import cut, doc_hash, entering, slices
from lexis.llm.labelled import MAX_CHARS, MAX_ROWS, Adam, within_budget

_WORD = re.compile(r"\w+|[^\w\s]+")
BUCKETS, CACHE_WORDS = 1 << 16, 300_000
TOLERANCE, AT_REST = 1e-3, 1e-2  # of a domain's own target: what may be missing, and what ten rounds must bring


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        b = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return b


def _features(texts: list[str | None], known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of all texts (a text without words has bucket 0), where each begins."""
    rows = []
    for t in texts:
        found = _WORD.findall(t.lower()) if t else []
        rows.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)) if found else np.zeros(1, np.int64))
    size = np.array([len(r) for r in rows], np.int64)
    return (np.concatenate(rows) if rows else np.zeros(0, np.int64)), np.cumsum(size) - size


def fit(texts: list[str], y: list, domains: list, epochs: int = 40, seed: int = 1) -> dict:
    """Word weights (shrunk log odds, from one half) and a softmax on pooled weights (from the other)."""
    k = len(domains)
    if len(texts) < 20 or len(set(y)) < 2:
        return {"weights": np.zeros((BUCKETS, k)), "mix": np.zeros((2 * k, k)), "bias": np.zeros(k)}
    label = np.array([domains.index(v) for v in y])
    order = np.random.default_rng(seed).permutation(len(texts))
    first, second = np.split(order, [len(order) * 6 // 10])
    known, seen = _Buckets(), np.zeros((BUCKETS, k))
    for d in first:
        seen[np.unique(_features([texts[d]], known)[0]), label[d]] += 1
    share = np.maximum(np.bincount(label[first], minlength=k), 0.5) / len(first)
    shrink = 4.0
    own, rest = seen / share, (seen.sum(axis=1, keepdims=True) - seen) / (1 - share + 1e-9)
    weights = np.log((own + shrink) / (rest + shrink))
    x = _pool(weights, *_features([texts[d] for d in second], known))
    p = {"mix": np.zeros((2 * k, k)), "bias": np.log(share)}
    p["mix"][np.arange(k), np.arange(k)] = p["mix"][k + np.arange(k), np.arange(k)] = 0.5
    adam, t = Adam(p, 0.03), np.eye(k)[label[second]]
    for _ in range(epochs * 5):
        g = (_softmax(x @ p["mix"] + p["bias"]) - t) / len(x)
        adam.step({"mix": x.T @ g + 1e-3 * p["mix"], "bias": g.sum(axis=0)})
    return {"weights": weights, "mix": p["mix"], "bias": p["bias"]}


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _pool(weights: np.ndarray, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    if not len(begin):
        return np.zeros((0, 2 * weights.shape[1]))
    w = weights[flat]
    size = np.diff(np.append(begin, len(flat)))[:, None]
    return np.concatenate([np.add.reduceat(w, begin, axis=0) / size, np.maximum.reduceat(w, begin, axis=0)], axis=1)


def posteriors(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """All columns but the text, the posterior (array) and tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != text_col]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("mixing")
        m, known = shared.value, _Buckets()
        k = len(m["bias"])
        for b in batches:
            if len(known) > CACHE_WORDS:
                known = _Buckets()
            texts = b.column(text_col).to_pylist()
            p = [np.zeros((0, k))]
            for lo, hi in slices(texts, 1_000_000):
                p.append(_softmax(_pool(m["weights"], *_features(texts[lo:hi], known)) @ m["mix"] + m["bias"]))
            p = np.concatenate(p)
            tokens = [max(len(t.split()), 1) if t else 1 for t in texts]
            post = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * k, pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), post, pa.array(tokens, pa.int64())],
                                             names=[*rest, "posterior", "tokens"])

    fields = [f for f in docs.schema.fields if f.name != text_col]
    return docs.mapInArrow(task, StructType([*fields, StructField("posterior", ArrayType(DoubleType())),
                                             StructField("tokens", LongType())]))


def _rates(p: np.ndarray, history: list[tuple[np.ndarray, bool]], step: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the rounds so far, and the point ahead of them at which the next residual is taken,
    unless the round starts the acceleration afresh from the rates."""
    r = y = np.ones(len(p))
    t = 1.0
    for h, afresh in history:
        if afresh:
            y, t = r, 1.0
        new = np.maximum(0, y - step * (p @ h))
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y, r, t = new + (t - 1) / nt * (new - r), new, nt
    return r, y


def fit_rates(members: DataFrame, weights: list[float], budget: float | None = None, tolerance: float = TOLERANCE,
              report: list | None = None) -> DataFrame:
    """``members`` (posterior, tokens, ...) with a ``rate`` for each row.  ``report`` receives the totals of each round."""
    w = np.array(weights, float) / sum(weights)
    k = len(w)

    def sums(values):
        cols = [F.sum(v).alias(f"s{i}") for i, v in enumerate(values)]
        return [float(v or 0.0) for v in members.agg(*cols).first()]

    p = [F.col("posterior")[i] for i in range(k)]
    total, *rest = sums([F.col("tokens").cast("double"),
                         *(F.col("tokens") * p[i] * p[j] for i in range(k) for j in range(i, k))])
    target = w * (total if budget is None else budget)
    scale = 1.0 / np.maximum(target, 1e-9)
    gram = np.zeros((k, k))
    gram[np.triu_indices(k)] = rest
    gram = gram + np.triu(gram, 1).T
    root = np.sqrt(scale)
    top = np.linalg.eigvalsh(gram * root[:, None] * root[None, :])[-1] if total else 1.0
    step, history = 1.0 / max(top, 1e-12), []

    def totals() -> np.ndarray:
        """The domains' totals at the rates (first row) and at the point ahead."""
        shared = list(history)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = np.zeros((2, k))
            for b in batches:
                post, tokens = b.column("posterior").flatten().to_numpy().reshape(-1, k), b.column("tokens").to_numpy()
                s += np.stack([post.T @ (x * tokens) for x in _rates(post, shared, step)])
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in s.ravel()], names=[f"s{i}" for i in range(2 * k)])

        part = members.select("posterior", "tokens").mapInArrow(task, ", ".join(f"s{i} double" for i in range(2 * k)))
        row = part.agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(2 * k))).first()
        return np.array([float(v or 0.0) for v in row]).reshape(2, k)

    least, seen = math.inf, []
    while total:
        found = totals()
        if report is not None:
            report.append(found[0])
        off, ahead = found - target
        seen.append(off)
        met = np.abs(off) <= tolerance * target
        # targets that are out of reach, or hardly come nearer: the totals are at rest
        still = len(seen) > 10 and np.abs(off - seen[-11]) <= AT_REST * target
        if (met | still).all():
            break
        missed = float((off * off * scale).sum())
        afresh = missed > least  # it went past the valley: accelerate anew
        history.append(((off if afresh else ahead) * scale, afresh))
        least = math.inf if afresh else missed

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            post = b.column("posterior").flatten().to_numpy().reshape(-1, k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_rates(post, history, step)[0])],
                                             names=[*b.schema.names, "rate"])

    return members.mapInArrow(rate, StructType([*members.schema.fields, StructField("rate", DoubleType())]))


def copies(rate, *key):
    """A whole number of copies whose mean over documents is the rate."""
    u = F.pmod(F.xxhash64(*key), F.lit(1 << 20)) / float(1 << 20)
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("int")


# --- the registered mixture: domains from the table of labels -----------------
#: domain -> weight of its tokens in the mixture
TARGETS = {"clean": 0.97, "toxic": 0.02, "junk": 0.01}


def labelled_domains(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS,
                     max_chars: int = MAX_CHARS) -> tuple[list[str], list[str]]:
    """Texts and domains of a bounded sample of labelled documents."""
    name = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")
    drawn = (labels.select(F.col("doc_id").alias("k"), name.alias("y")).where("y is not null and k is not null")
             .groupBy("k").agg(F.min("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(max_rows))
    rows = within_budget(docs.select(F.col("doc_id").alias("k"), F.col("text").alias("t")), drawn, max_rows, max_chars).toArrow()
    return rows.column("t").to_pylist(), rows.column("y").to_pylist()


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None,
        budget: float | None = None, keep_text: bool = False) -> DataFrame:
    """doc_id, h, tokens, posterior, rate, copies of every document."""
    targets = targets or TARGETS
    domains = list(targets)
    model = fit(*labelled_domains(docs, labels), domains)
    slim = docs.select("doc_id", "text").withColumn("h", doc_hash())
    members = cut(posteriors(slim, model), "members")
    return fit_rates(members, list(targets.values()), budget).withColumn(
        "copies", copies(F.col("rate"), "doc_id", "h"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    rates = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rates.select("doc_id", "tokens", *(F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(TARGETS)),
                        "rate", "copies")
