import math
import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexis.llm import maxscore, ppm
from lexis.llm.queries import ORACLE, QUERIES
from tests.conftest import SF001


def brute_top(rows, k=10):
    good = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows
            if v and None not in v and np.isfinite(v).all()]
    dim = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, dim - len(v)))) for i, v in good]
    out = set()
    for n, (i, q) in enumerate(good):
        if i is not None and i % 100 == 0:
            best = sorted((-int(q @ v), j) for m, (j, v) in enumerate(good) if m != n)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("spread", [1.0, 30.0])
def test_maxscore_equals_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=12) * spread * rng.choice([0, 1], 12)]) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(1100, None), (1200, [float("inf")] * 12), (1300, [None] + [1.0] * 11), (1400, []), (1500, [0.0] * 12), (1601, [1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, row int")
    got = {tuple(r) for r in maxscore.search(df, F.col("vec_id") % 100 == 0, shard_rows=300, query_bytes=400, step=16).collect()}
    assert got == brute_top(rows)


def test_maxscore_passes_candidates_over():
    """Over many steps of one shard: sparse vectors whose best matches share rare, heavy terms."""
    rng = np.random.default_rng(9)
    m = np.zeros((4000, 40))
    for i in range(4000):
        m[i, rng.choice(40, 5, replace=False)] = rng.integers(1, 30, 5)
    m[:60, 3] = 900
    ids = rng.permutation(4000)
    shard = maxscore.Shard(m, ids, np.arange(4000), step=100)
    order = np.argsort(ids)
    looked = 0
    for q, few in ((m[5], True), (m[10], True), (m[3000], False), (-m[7], False), (np.zeros(40), False)):
        before = shard.looked
        at, score = shard.best(q, -1, 10)
        want = np.lexsort((ids[order], -(m[order] @ q)))[:10]
        assert score.tolist() == (m[order] @ q)[want].tolist() and shard.ids[at].tolist() == ids[order][want].tolist()
        looked = shard.looked - before
        assert not few or looked < 0.7 * 4000, looked


def test_maxscore_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert maxscore.search(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).collect() == []
    three = [(100, [1.0, 2.0]), (5, [3.0, -1.0]), (6, [3.0, -1.0])]
    got = [tuple(r) for r in maxscore.search(spark.createDataFrame(three, schema), F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(100, 1, 5, 1024 * 1024), (100, 2, 6, 1024 * 1024)]
    huge = [(100, [1e12, 1.0]), (1, [1e12, -1.0]), (2, [1e12, 1.0])]
    df = spark.createDataFrame(huge, "vec_id long, embedding array<double>").where("vec_id > 0")
    with pytest.raises(Exception):  # beyond 64 bits a score can't be returned: no silent overflow
        maxscore.search(df, F.col("vec_id") % 100 == 0).collect()


class Trie:
    """PPM with escape method C and exclusion, one dictionary a context."""

    def __init__(self, bodies):
        self.node = defaultdict(Counter)
        for b in bodies:
            s = [ppm.START] * ppm.ORDER + list(b) + [ppm.END]
            for i in range(ppm.ORDER, len(s)):
                for k in range(ppm.ORDER + 1):
                    self.node[tuple(s[i - k:i])][s[i]] += 1

    def log10(self, body):
        s, total = [ppm.START] * ppm.ORDER + list(body) + [ppm.END], 0.0
        for i in range(ppm.ORDER, len(s)):
            gone = set()
            for k in range(ppm.ORDER, -1, -1):
                left = {x: c for x, c in self.node[tuple(s[i - k:i])].items() if x not in gone}
                if not left:
                    continue
                whole = sum(left.values()) + len(left)
                if s[i] in left:
                    total += math.log10(left[s[i]] / whole)
                    break
                total += math.log10(len(left) / whole)
                gone |= set(left)
            else:
                total -= math.log10(ppm.SYMBOLS - len(gone))
        return total


def test_ppm_equals_a_trie(spark):
    texts = ["the cat sat on the mat", "The cat ate.", "", None, "a\tb\nc", "zebra quartz", "the bat sat", "ünïcode ünï", "the the the"] * 2
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "again the cat"), (None, "no id")]
    held = F.col("doc_id") % 4 == 1
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int")
    got = sorted(ppm.score(df, held).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.score))
    body = [((t or "").encode().lower(), i is not None and i % 4 == 1, i) for i, t in rows]
    trie = Trie([b for b, h, _ in body if not h])
    words = Counter(w for b, h, _ in body if not h for w in [*b.split(), "end"])
    n, v = sum(words.values()), len(words)
    want = []
    for b, h, i in body:
        t = [*b.split(), "end"]
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want.append((i, h, len(t), sum(words[w] > 0 for w in t), n, base, trie.log10(b)))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[6]))
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g.base_score == pytest.approx(w[5]) and g.score == pytest.approx(w[6])


def test_trie_without_a_table(monkeypatch):
    bodies = [b"the cat", b"", b"at the hat" * 9]
    want = ppm.trie(bodies)
    monkeypatch.setattr(ppm, "MOST_SLOTS", 0)
    assert all(np.array_equal(a, b) for a, b in zip(want, ppm.trie(bodies)))


def test_ppm_without_training_or_rows(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.score(df, F.lit(True)).collect()}
    assert got[1].score == pytest.approx(-3 * math.log10(257)) and got[2].train_tokens == 0 and got[2].n_known == 0
    assert ppm.score(df.limit(0), F.lit(False)).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_duckdb(spark, name):
    con = duckdb.connect()
    for t in ["documents", "embeddings", "labels"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = QUERIES[name](spark, SF001)
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)


def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet(os.path.join(SF001, "documents.parquet"))
    before = docs
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF001)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
            assert [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
        before = corpus_pipeline.cut(after, "test")
    rows = before.collect()
    assert rows and len({r.sequence_id for r in rows}) == len(rows)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF001)
    assert empty.collect() == []
