import numpy as np
import pytest

from pyspark.sql import functions as F

from lexis.llm import labelled, mixing, quality, toxicity
from tests.conftest import SF001

RNG = np.random.default_rng(5)
PLAIN = ["table", "river", "green", "walk", "music", "the", "and", "of", "stone", "paper", "light", "house"]
RUDE = ["idiot", "moronic", "trashy"]


def texts(n, share, spoil):
    out, y = [], []
    for i in range(n):
        words = [str(w) for w in RNG.choice(PLAIN, RNG.integers(20, 200))]
        bad = RNG.random() < share
        if bad:
            words = spoil(words)
        out.append(" ".join(words) + ".")
        y.append(int(bad))
    return out, np.array(y, float)


def rude(words):
    at = int(RNG.integers(len(words)))
    return [*words[:at], str(RNG.choice(RUDE)), *words[at:]]


def auc(score, y):
    rank = np.empty(len(y))
    rank[np.argsort(score)] = np.arange(len(y))
    p = y.sum()
    return (rank[y == 1].sum() - p * (p - 1) / 2) / (p * (len(y) - p))


def test_toxicity_learns_single_words():
    x, y = texts(600, 0.2, rude)
    score, lang = toxicity.Scorer(toxicity.fit(x[:400], y[:400]))(x[400:])
    assert auc(score, y[400:]) > 0.97
    assert ((score >= 0.5) == y[400:]).mean() > 0.95
    assert set(lang) == {"en"}


def test_toxicity_edges():
    x, y = texts(300, 0.3, rude)
    run = toxicity.Scorer(toxicity.fit(x, y))
    score, _ = run([None, "", "  ", "idiot " * 50_000, "x"])
    assert np.isfinite(score).all() and score[0] == score[1] == score[2]
    one = run(["idiot table"])[0][0]
    assert run(["table", "idiot table", ""])[0][1] == pytest.approx(one)  # neighbours don't matter
    assert toxicity.Scorer(toxicity.fit([], np.zeros(0)))(["a", None])[0].tolist() == [0.5, 0.5]


def junk(words):
    return [w + "###" for w in words]


def test_quality_learns_byte_patterns():
    x, y = texts(500, 0.2, junk)
    y = 1 - y
    score = quality.Scorer(quality.fit(x[:350], y[:350]))(x[350:])
    assert auc(score, y[350:]) > 0.97
    assert ((score >= 0.7) == y[350:]).mean() > 0.95


def test_quality_scorer_equals_plain_convolution():
    x, y = texts(80, 0.3, junk)
    m = quality.fit(x, 1 - y, epochs=1)
    run = quality.Scorer(m)
    some = ["", "a", "b" * 127, "c" * 128, "d e f " * 300, "é" * 700]
    for text, got in zip(some, run(some)):
        raw = text.encode()
        halves = (len(raw) + quality.WIDTH - 1 + quality.HALF - 1) // quality.HALF
        data = raw.ljust(halves * quality.HALF + quality.WIDTH, b"\0")
        peaks = np.full((halves, quality.FILTERS), -np.inf)
        for i in range(halves * quality.HALF - quality.WIDTH + 1):
            z = sum(m["pairs"][j][data[i + 2 * j] * 256 + data[i + 2 * j + 1]] for j in range(quality.WIDTH // 2)) + m["fb"]
            peaks[i // quality.HALF] = np.maximum(peaks[i // quality.HALF], z)
        chunks = np.maximum(peaks[:-1], peaks[1:]) if halves > 1 else peaks
        act = np.maximum(chunks, 0)
        feat = np.concatenate([act.mean(axis=0), act.max(axis=0), act.min(axis=0)])
        want = labelled.sigmoid(np.tanh(feat @ m["w1"] + m["b1"]) @ m["w2"] + m["b2"])
        assert got == pytest.approx(want, abs=1e-5)
    assert run([None])[0] == run([""])[0]


def test_best_cut():
    assert 1 < labelled.best_cut(np.array([0.0, 1, 2, 3]), np.array([0.0, 0, 1, 1])) < 2


def test_classify_tables(spark):
    x, y = texts(300, 0.3, rude)
    docs = spark.createDataFrame([(i, t, "score") for i, t in enumerate(x)] + [(7, None, ""), (None, "idiot", "")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(0, None), (None, 1), (5, 1)],
                                   "doc_id long, toxic int")
    out = toxicity.classify(docs, labels).collect()
    assert len(out) == 302 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert toxicity.classify(docs.limit(0), labels).collect() == []
    assert {r.score for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.5}
    scored = quality.score(docs, {"constant": 0.25}, score_col="_q")
    assert scored.columns == ["doc_id", "text", "score", "_q"] and scored.count() == 302


def test_mixing_meets_targets(spark):
    posterior = RNG.dirichlet([1, 1, 1], 400)
    tokens = RNG.integers(1, 500, 400)
    rows = [(i, [float(v) for v in p], int(t)) for i, (p, t) in enumerate(zip(posterior, tokens))]
    members = spark.createDataFrame(rows, "doc_id long, posterior array<double>, tokens long")
    out = mixing.fit_rates(members, [0.5, 0.3, 0.2]).orderBy("doc_id").collect()
    r = np.array([x.rate for x in out])
    total = (r * tokens) @ posterior
    assert (r >= 0).all()
    assert np.allclose(total / tokens.sum(), [0.5, 0.3, 0.2], atol=2e-3)
    # brute force: plain projected gradient with all rates in memory reaches the same totals
    w, target = tokens[:, None] * posterior, np.array([0.5, 0.3, 0.2]) * tokens.sum()
    gram = (w / tokens[:, None]).T @ w / np.sqrt(np.outer(target, target))
    step, x = 1 / np.linalg.eigvalsh(gram)[-1], np.ones(400)
    for _ in range(3000):
        x = np.maximum(0, x - step * posterior @ ((x @ w - target) / target))
    assert np.allclose(x @ w, total, rtol=5e-3)


def test_mixing_target_out_of_reach(spark):
    members = spark.createDataFrame([(1, [1.0, 0.0], 10), (2, [0.9, 0.1], 20)], "doc_id long, posterior array<double>, tokens long")
    out = {r.doc_id: r.rate for r in mixing.fit_rates(members, [0.0001, 0.9999]).collect()}
    w, target = np.array([[10.0, 0.0], [18.0, 2.0]]), np.array([0.003, 29.997])
    grid = min(((((np.array([a, b]) @ w - target) ** 2 / target).sum(), a, b)
                for a in (0, 0.1, 1) for b in np.linspace(0, 3, 601)), key=lambda g: g[0])
    assert out[1] == pytest.approx(grid[1], abs=0.02) and out[2] == pytest.approx(grid[2], abs=0.02)


def test_mixing_edges(spark):
    none = spark.createDataFrame([], "doc_id long, posterior array<double>, tokens long")
    assert mixing.fit_rates(none, [0.5, 0.5]).collect() == []
    docs = spark.createDataFrame([(1, None, "r"), (2, "", "r"), (2, "a b", "r"), (2, "a b", "r"), (None, "c", "r")],
                                 "doc_id long, text string, rate string")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, labels).collect()
    assert len(out) == 5 and all(r.rate >= 0 and r.copies >= 0 for r in out)
    assert sorted(r.tokens for r in out) == [1, 1, 1, 2, 2]


def test_rare_domains_meet_their_own_targets(spark):
    """A domain at a ten-thousandth of the tokens is served as closely as the others; a target out of reach ends too."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.dirichlet([8, 0.6, 0.05])], int(rng.integers(20, 900))) for i in range(600)]
    members = spark.createDataFrame(rows, "doc_id long, posterior array<double>, tokens long").coalesce(1)
    weights, report = [0.95, 0.0499, 0.0001], []
    out = mixing.fit_rates(members, weights, report=report).collect()
    got = np.sum([np.array(r.posterior) * r.rate * r.tokens for r in out], axis=0)
    assert 5 < len(report) < 200 and all(r.rate >= 0 for r in out)
    assert np.abs(got / (np.array(weights) * sum(r.tokens for r in out)) - 1).max() < 2e-3
    impossible = spark.createDataFrame([(1, [1.0, 0.0], 100), (2, [1.0, 0.0], 50)], "doc_id long, posterior array<double>, tokens long")
    out = mixing.fit_rates(impossible, [0.5, 0.5]).collect()
    assert sum(r.rate * r.tokens for r in out) == pytest.approx(75, rel=1e-3)


def test_pipeline_stages_with_clashing_columns(spark):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(40)
    more = ["_k", "_kh", "_copies", "_n", "_h", "text_hash", "copies", "copy", "rate_id", "kept_id", "kept_hash", "mark_id", "_text_hash", "quality_score", "TEXT_hash2"]
    wide = docs.select("*", *(F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in more))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, wide, SF001)
        assert out.columns == wide.columns, name
        for r in out.collect():
            assert all(r[c] == f"{c}-{r['doc_id']}" for c in more), name


def test_toxicity_weights_see_every_training_text(monkeypatch):
    """All labelled texts but those that set thresholds are trained on, and those only set thresholds."""
    x, y = texts(200, 0.3, rude)
    kept, trained, steps = [], set(), []
    layout, step = toxicity._layout, toxicity.Adam.step

    def seen(rows):
        kept.append(rows)
        return layout(rows)

    def stepped(self, grads):
        trained.update(id(r) for r in kept[-1])
        steps.append(1)
        step(self, grads)
    monkeypatch.setattr(toxicity, "_layout", seen)
    monkeypatch.setattr(toxicity.Adam, "step", stepped)
    toxicity.fit(x, y)
    everything = {id(r) for rows in kept for r in rows}
    assert steps and len(everything) == 200 and len(trained) == 170
