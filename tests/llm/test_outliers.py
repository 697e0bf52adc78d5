"""Base rules against loops, estimates against a plain minimum covariance determinant."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexis.llm import outliers as O
from tests.conftest import SF001

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    again = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(i, i + 3)}
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), len(lines))


ODD = [None, "", " ", "one", "a b c", "a a a a", "a b c a b c", "x\n\nx\n x\nx", "#*$% &|<> é🙂 漢字\x0b\x0c\r\n", "the the the the the the",
       "w " * 5000, "a\nb\na\nb\n", "\n \t\n"]


@pytest.mark.parametrize("text", ODD)
def test_counts(text):
    assert O.counts(text) == plain_counts(text)


def test_many_distinct_words(monkeypatch):
    words = [f"w{i % 3000}".encode() for i in range(7000)]
    text = b" ".join(words).decode()
    assert O.counts(text) == plain_counts(text)


def plain_mcd(x, share=O.SUPPORT):
    """Concentration steps in memory from the same three starts, with whole distances for bins."""
    med = np.median(x, axis=0)
    s = np.maximum(1.4826 * np.median(np.abs(x - med), axis=0), O.LEAST)
    z = (x - med) / s
    first = [np.eye(O.P)]
    for y in (np.tanh(z), z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)):
        c = np.cov(y.T, bias=True)
        spread = np.sqrt(np.maximum(np.diag(c), 1e-9))
        c = c / np.outer(spread, spread)
        np.fill_diagonal(c, 1.0)
        first.append(c)
    best = None
    for c in first:
        mu, cov = med, c * np.outer(s, s)
        for _ in range(100):
            d = x - mu
            d2 = np.einsum("ni,ij,nj->n", d, np.linalg.inv(O.regular(cov)), d)
            near = x[np.argsort(d2)[:int(np.ceil(share * len(x)))]]
            mu, cov = near.mean(axis=0), np.cov(near.T, bias=True) * O.correction(share)
        det = np.linalg.slogdet(O.regular(cov))[1]
        if best is None or det < best[0]:
            best = det, mu, cov
    return best


def test_estimates_equal_a_plain_version(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for g, n in (("a", 400), ("b", 90)):
        x = rng.normal(size=(n, O.P)) @ np.diag([0.05, 0.1, 0.3, 0.2]) + [1.6, 0.2, 0.1, 0.1]
        x[: n // 5] += [0.5, 1.5, 0.0, 0.4]  # a fifth lies elsewhere
        x[:, 2] = np.where(rng.random(n) < 0.8, 0, x[:, 2])  # mostly one value
        rows += [(g, [float(v) for v in r]) for r in x]
        want[g] = plain_mcd(x)
    vectors = spark.createDataFrame(rows, "g string, x array<double>").repartition(3)
    for r in O.estimate(vectors).collect():
        det, mu, cov = want[r.g]
        got = O._full(np.array([r.cov]))[0]
        assert np.allclose(r.mu, mu, atol=0.02) and np.allclose(got, cov, atol=0.15 * np.abs(cov).max())
        assert np.linalg.slogdet(O.regular(got))[1] == pytest.approx(det, abs=0.2)
        x = np.array([v for g, v in rows if g == r.g])
        far = lambda m, c: np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(O.regular(c)), x - m) > O.chi2_point(1 - O.TAIL, O.P)
        assert (far(np.array(r.mu), got) == far(mu, cov)).mean() > 0.99


def test_chi_square():
    # fixed values of the distribution with 4 degrees of freedom
    assert O.chi2_point(0.95, 4) == pytest.approx(9.487729, abs=1e-5) and O.chi2_point(0.5, 4) == pytest.approx(3.356694, abs=1e-5)
    assert O.chi2_cdf(9.487729, 4) == pytest.approx(0.95, abs=1e-6)


def _docs(spark, junk=0.1, n=1400, seed=2):
    rng = np.random.default_rng(seed)
    vocab = ["table", "river", "green", "walking", "music", "stone", "paper", "light", "house", "under", "cold", "evening", "winter", "road"]
    rows = []
    for i in range(n):
        words = [str(w) for w in rng.choice(vocab, rng.integers(60, 200))]
        bad = rng.random() < junk
        if bad:
            words = [w + "#$%"[: rng.integers(1, 4)] for w in words]
        source = None if i % 7 == 0 else f"s{i % 3}" if i % 50 else f"rare{i}"
        rows.append((i, " ".join(words) + ".", "en" if i % 4 else None, source, bad, "z"))
    return rows


def test_outliers_are_rejected_and_clean_texts_stay(spark):
    rows = _docs(spark)
    rows += [(9000, None, "en", "s1", None, "z"), (9001, "", "en", "s1", None, "z"), (9002, "short text", "en", "s1", None, "z"),
             (9003, "so it goes on " * 40, "en", "s1", None, "z"), (None, next(r[1] for r in rows if not r[4]), "xx", "alone", None, "z"), (5, rows[5][1], "en", "s2", None, "z")]
    rows += [(2000 + i, rows[1][1], "en", "s1", False, "z") for i in range(300)]  # many copies in one group
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, g boolean, x string").repartition(4)
    out = O.rules(df).collect()
    assert len(out) == len(rows)
    bad = {r[0]: r[4] for r in rows}
    for r in out:
        if bad.get(r.doc_id) is not None:
            assert r.kept != bad[r.doc_id], r
    special = {r.doc_id: r for r in out}
    assert all(special[i].base_failed and not special[i].kept for i in (9000, 9001, 9002, 9003))
    assert special[None].kept and not special[None].base_failed


def test_small_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "word " + " ".join(f"v{j}" for j in range(60)), "en", "s") for i in range(5)], "doc_id long, text string, lang string, source string")
    out = O.rules(docs).collect()
    assert [r.kept for r in out] == [True] * 5 and all(r.distance is None for r in out)  # too few for an estimate
    assert O.rules(docs.limit(0)).collect() == []


def test_query_counts_equal_loops(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    out = O.op12_outliers(spark, SF001).collect()
    assert len(out) == len(docs)
    for r in out:
        c = plain_counts(docs[r.doc_id])
        assert tuple(r)[1:6] == c[:5] and r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0]) and not (r.kept and r.base_failed)
