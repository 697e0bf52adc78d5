"""Quality rules by robust multivariate outliers (minimum covariance determinant).

1. Every text is counted: words, characters in words, symbols, repeated lines, words
   in repeated three-word windows.  Texts that fail the base rule (too few words, or
   too much repetition) are rejected and take no part in what follows.
2. The counts become a vector: log of the mean word length, and the square roots of symbols a word,
   repeated lines a line and repeated words a word (``transformed``).
3. A group is a language and source.  Groups of fewer than MIN_ROWS texts are pooled by
   language, pools that are still smaller are pooled together, and a last pool of fewer
   texts rejects nothing.  Equal vectors of a group count once, so copies don't pull an estimate.
4. For each group the minimum covariance determinant is sought from three
   deterministic starts around the median (scaled by the median deviation: plain,
   hyperbolic tangent, spatial sign) by concentration steps: distances of all
   vectors, the mean and covariance of the SUPPORT share with the smallest, and again until no
   group's determinant falls any more.  A step is one distributed pass: vectors are summed by (group, start, bin of
   distance), with bins 1 % wide, and the bins up to the one that holds the share's last vector are added up.
   Models are tables, so there may be any number of groups.
5. The start with the least determinant gives the estimate, corrected for
   the share; LEAST spreads are added to it, since most texts have no symbols at all.  A text is
   rejected if its squared Mahalanobis distance exceeds the chi-square point with tail TAIL.

Null and empty texts have no words and fail the base rule.  A null language or source is a value of its own.
Repeated rows and ids get the same result each.  An empty table gives no rows.  Only the
id, text, language and source columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexis.llm.common import cut, entering, forget, slices

MIN_WORDS, MOST_REPEATED = 50, 50  # words; percent of words in repeated windows
MIN_ROWS, SUPPORT, TAIL, SETTLED = 64, 0.75, 1e-6, 1e-3
#: Least standard deviation of each transformed statistic.
LEAST = (0.03, 0.05, 0.2, 0.12)
BINS = 64  # to a doubling of a squared distance
SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
P = len(LEAST)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more, the first ones included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    size = len(number)
    if size < 1 << 20:
        key = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:  # pairs first, so that the product stays below 2^63
        key = np.unique(ids[:-2] * size + ids[1:-1], return_inverse=True)[1] * size + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= again
    return int(covered.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    blanks = len(raw) - len(raw.translate(None, SPACE))
    return (len(words), len(text or "") - blanks, len(raw) - len(raw.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines))


def statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """doc_id, lang, source and the COUNTS."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
                       F.col(text_col).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("outliers")
        for b in batches:
            texts = b.column("text")
            for lo, hi in slices(texts.to_pylist()):
                found = np.array([counts(t) for t in texts.slice(lo, hi - lo).to_pylist()], np.int64).reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(lo, hi - lo) for c in ("doc_id", "lang", "source")), *(pa.array(c) for c in found.T.copy())],
                    names=["doc_id", "lang", "source", *COUNTS])

    kind = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    return slim.mapInArrow(task, ", ".join([f"{c} {kind[c]}" for c in ("doc_id", "lang", "source")] + [f"{c} long" for c in COUNTS]))


def transformed():
    """The vector of a text's counts, as an array of doubles."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return F.array(F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.sqrt(F.col("n_symbols") / n),
                   F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), F.sqrt(F.col("n_repeat_words") / n))


# --- chi square with an even number of degrees of freedom ------------------------
def chi2_cdf(x: float, dof: int) -> float:
    term = total = 1.0
    for k in range(1, dof // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_point(p: float, dof: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dof) < p else (lo, mid)
    return hi


def correction(share: float) -> float:
    """What a covariance of the nearest share of normal vectors is multiplied by."""
    return share / chi2_cdf(chi2_point(share, P), P + 2)


# --- models: per group, the starts' centres and covariances -----------------------
MODEL = "g string, start int, mu array<double>, cov array<double>, logdet double"


def _full(flat: np.ndarray) -> np.ndarray:
    """Symmetric matrices of their PAIRS."""
    m = np.zeros((len(flat), P, P))
    for k, (i, j) in enumerate(PAIRS):
        m[:, i, j] = m[:, j, i] = flat[:, k]
    return m


def regular(cov: np.ndarray) -> np.ndarray:
    """Covariances with the least spreads added."""
    return cov + np.diag(np.square(LEAST))


def distances(x: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distances of rows to a centre and covariance each."""
    d = x - mu
    return np.einsum("ni,ni->n", d, np.linalg.solve(cov, d[:, :, None])[:, :, 0])


def bins(d2: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(d2, 1e-6)) * BINS).astype(np.int64)


def _lists(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _moments(key: list[np.ndarray], x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows with equal keys added up: their number, sums and products (PAIRS)."""
    order = np.lexsort(key[::-1])
    key, x = [k[order] for k in key], x[order]
    first = np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in key])) if len(x) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    wide = np.concatenate([np.ones((len(x), 1)), x, np.stack([x[:, i] * x[:, j] for i, j in PAIRS], 1)], axis=1)
    return [k[at] for k in key], (np.add.reduceat(wide, at, axis=0) if len(at) else wide)


M = 1 + P + len(PAIRS)


def _sums() -> list:
    return [F.sum(F.col("m")[i]).alias(f"m{i}") for i in range(M)]


_PART = "g string, start int, bin long, m array<double>"


def _part(names: pa.Array, key: list[np.ndarray], m: np.ndarray) -> pa.RecordBatch:
    g, start, b = key
    return pa.RecordBatch.from_arrays(
        [names.take(pa.array(g)), pa.array(start.astype(np.int32)), pa.array(b),
         pa.ListArray.from_arrays(pa.array(np.arange(len(g) + 1) * M, pa.int32()), pa.array(m.ravel()))], names=["g", "start", "bin", "m"])


def _groups(column) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def middle(rows: DataFrame, width: float = 1 / 512) -> DataFrame:
    """(g, pos, v) to (g, pos, med): medians, to half a width, from counts in bins."""
    binned = rows.groupBy("g", "pos", F.floor(F.col("v") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("g", "pos").orderBy("bin")
    return (binned.withColumn("upto", F.sum("n").over(upto)).withColumn("n", F.sum("n").over(Window.partitionBy("g", "pos")))
            .where(F.col("upto") * 2 >= F.col("n")).groupBy("g", "pos").agg(((F.min("bin") + 0.5) * width).alias("med")))


def _rowwise(med: DataFrame, name: str) -> DataFrame:
    """(g, pos, med) to (g, array)."""
    return med.groupBy("g").agg(*(F.max(F.when(F.col("pos") == i, F.col("med"))).alias(f"c{i}") for i in range(P))).select(
        "g", F.array(*(F.col(f"c{i}") for i in range(P))).alias(name))


def starts(vectors: DataFrame) -> DataFrame:
    """Three first models for each group."""
    long = vectors.select("g", F.posexplode("x").alias("pos", "v"))
    med = cut(_rowwise(middle(long), "med"), "mcd-median")
    off = vectors.join(med, "g").select("g", F.posexplode("x").alias("pos", "v"), "med").select(
        "g", "pos", F.abs(F.col("v") - F.element_at("med", F.col("pos") + 1)).alias("v"))
    scale = cut(_rowwise(middle(off), "mad").join(med, "g"), "mcd-scale")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            g, names = _groups(b.column("g"))
            x, mid, mad = (_lists(b.column(c), P) for c in ("x", "med", "mad"))
            z = (x - mid) / np.maximum(1.4826 * mad, LEAST)
            sign = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
            zero = np.zeros(2 * len(g), np.int64)
            key, m = _moments([np.tile(g, 2), np.repeat([1, 2], len(g)), zero], np.concatenate([np.tanh(z), sign]))
            yield _part(names, key, m)

    sums = vectors.join(scale, "g").mapInArrow(task, _PART).groupBy("g", "start").agg(*_sums())

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mid, mad = (_lists(b.column(c), P) for c in ("med", "mad"))
            s = np.maximum(1.4826 * mad, LEAST)
            start = b.column("start").to_numpy()
            m = np.stack([b.column(f"m{i}").to_numpy() for i in range(M)], 1)
            mean = m[:, 1:P + 1] / m[:, :1]
            cov = _full(m[:, P + 1:] / m[:, :1]) - mean[:, :, None] * mean[:, None, :]
            spread = np.sqrt(np.maximum(np.einsum("nii->ni", cov), 1e-9))
            corr = cov / spread[:, :, None] / spread[:, None, :]
            corr[:, range(P), range(P)] = 1.0
            yield _models(b.column("g"), start, mid, corr * s[:, :, None] * s[:, None, :])
            first = np.flatnonzero(start == 1)
            yield _models(b.column("g").take(pa.array(first)), np.zeros(len(first), np.int64), mid[first],
                          np.eye(P) * np.square(s[first])[:, :, None])

    return sums.join(scale, "g").mapInArrow(model, MODEL)


def _models(g: pa.Array, start: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> pa.RecordBatch:
    n = len(start)
    logdet = np.linalg.slogdet(regular(cov))[1] if n else np.zeros(0)
    flat = np.stack([cov[:, i, j] for i, j in PAIRS], 1) if n else np.zeros((0, len(PAIRS)))
    return pa.RecordBatch.from_arrays(
        [g, pa.array(start.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * P, pa.int32()), pa.array(mu.ravel())),
         pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(PAIRS), pa.int32()), pa.array(flat.ravel())), pa.array(logdet)],
        names=["g", "start", "mu", "cov", "logdet"])


def _as_one(models: DataFrame) -> DataFrame:
    """(g, mu, cov) with a group's models side by side, in order of start."""
    return models.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("start", "mu", "cov"))).alias("k")).select(
        "g", F.flatten("k.mu").alias("mu"), F.flatten("k.cov").alias("cov"))


def concentrate(vectors: DataFrame, models: DataFrame, share: float) -> DataFrame:
    """One concentration step for every group and start."""
    c = correction(share)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            g, names = _groups(b.column("g"))
            x = _lists(b.column("x"), P)
            mu = _lists(b.column("mu"), P).reshape(len(g), -1, P)
            cov = _lists(b.column("cov"), len(PAIRS)).reshape(len(g), -1, len(PAIRS))
            for k in range(mu.shape[1]):
                at = bins(distances(x, mu[:, k], regular(_full(cov[:, k]))))
                yield _part(names, *_moments([g, np.full(len(g), k), at], x))

    parts = vectors.join(_as_one(models), "g").mapInArrow(task, _PART).groupBy("g", "start", "bin").agg(*_sums())
    whole, upto = Window.partitionBy("g", "start"), Window.partitionBy("g", "start").orderBy("bin")
    total = parts.select("g", "start", "bin", F.sum("m0").over(whole).alias("all"), *(F.sum(f"m{i}").over(upto).alias(f"m{i}") for i in range(M)))
    nearest = (total.where(F.col("m0") >= F.ceil(F.col("all") * share))
               .groupBy("g", "start").agg(*(F.min_by(f"m{i}", "bin").alias(f"m{i}") for i in range(M))))

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.stack([b.column(f"m{i}").to_numpy() for i in range(M)], 1)
            mean = m[:, 1:P + 1] / m[:, :1]
            cov = (_full(m[:, P + 1:] / m[:, :1]) - mean[:, :, None] * mean[:, None, :]) * c
            yield _models(b.column("g"), b.column("start").to_numpy(), mean, cov)

    return nearest.mapInArrow(model, MODEL)


def estimate(vectors: DataFrame, share: float = SUPPORT) -> DataFrame:
    """(g, mu, cov): each group's estimate with the least determinant.  Steps go on until none
    lowers a determinant by more than SETTLED of its logarithm; as determinants are
    bounded below by the least spreads, they end."""
    best = cut(starts(vectors), "mcd-start")
    first = True
    while True:
        step = concentrate(vectors, best, share)
        both = cut(step.join(best.select("g", "start", F.col("logdet").alias("was"), F.col("mu").alias("mu0"), F.col("cov").alias("cov0")),
                             ["g", "start"]), "mcd-step")
        falls = F.lit(True) if first else F.col("logdet") < F.col("was") - SETTLED
        moved = both.where(falls).limit(1).count()
        pick = lambda new, old: F.when(falls, F.col(new)).otherwise(F.col(old)).alias(new)
        new = cut(both.select("g", "start", pick("mu", "mu0"), pick("cov", "cov0"), pick("logdet", "was")), "mcd-model")
        forget(both, best)
        best, first = new, False
        if not moved:
            return best.groupBy("g").agg(F.min_by(F.struct("mu", "cov"), F.struct("logdet", "start")).alias("m")).select("g", "m.mu", "m.cov")


def grouped(rows: DataFrame, usable, min_rows: int) -> DataFrame:
    """``rows`` with ``g``: language and source, or the pool that its small groups go to."""
    name = lambda level, *cols: F.to_json(F.struct(F.lit(level).alias("level"), *cols))
    sizes = rows.where(usable).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < min_rows
    pool = Window.partitionBy("lang")
    named = sizes.withColumn("pool", F.sum(F.when(small, F.col("n")).otherwise(0)).over(pool)).select(
        F.col("lang").alias("gl"), F.col("source").alias("gs"),
        F.when(~small, name(0, "lang", "source")).when(F.col("pool") >= min_rows, name(1, "lang")).otherwise(name(2)).alias("g"))
    named = cut(named, "mcd-groups")
    return rows.join(named, F.col("lang").eqNullSafe(F.col("gl")) & F.col("source").eqNullSafe(F.col("gs")), "left").drop("gl", "gs")


def rules(docs: DataFrame, min_words: int = MIN_WORDS, most_repeated: int = MOST_REPEATED, min_rows: int = MIN_ROWS,
          share: float = SUPPORT, tail: float = TAIL, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source") -> DataFrame:
    """doc_id, the COUNTS, base_failed, distance (squared; null where there is no estimate) and kept."""
    rows = cut(statistics(docs, id_col, text_col, lang_col, source_col), "mcd-counts")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    rows = grouped(rows.withColumn("base_failed", failed).withColumn("x", transformed()), ~failed, min_rows)
    vectors = cut(rows.where("not base_failed").select("g", "x").groupBy("g", "x").agg(F.count(F.lit(1)).alias("copies")), "mcd-vectors")
    enough = vectors.groupBy("g").agg(F.sum("copies").alias("n")).where(F.col("n") >= min_rows).select("g")
    model = cut(estimate(cut(vectors.join(enough, "g", "left_semi").select("g", "x"), "mcd-used"), share), "mcd-estimate")
    scored = rows.join(model, "g", "left")
    cutoff = chi2_point(1 - tail, P)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            has = b.column("mu").is_valid().to_numpy(zero_copy_only=False)
            d2 = np.full(b.num_rows, np.nan)
            if has.any():
                at = pa.array(np.flatnonzero(has))
                x, mu, cov = (_lists(b.column(c).take(at), w) for c, w in (("x", P), ("mu", P), ("cov", len(PAIRS))))
                d2[has] = distances(x, mu, regular(_full(cov)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(d2, from_pandas=True)], names=[*keep, "distance"])

    keep = ["doc_id", *COUNTS, "base_failed"]
    id_type = rows.schema["doc_id"].dataType.simpleString()
    out = scored.mapInArrow(task, f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, distance double")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))


def op12_outliers(spark, sf_dir: str) -> DataFrame:
    found = rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
