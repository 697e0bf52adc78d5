"""Cosine invariants and ranking/answer edge cases."""

from pyspark.sql import functions as F

from lexis.operators import retrieve as R
from lexis.operators import vectorize as V


def _store(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, line_no long, content string")


def _questions(spark, rows):
    return spark.createDataFrame(rows, "query_id long, query string")


def test_cosine_self_and_empty(spark):
    store = _store(spark, [(1, 0, "alpha beta beta"), (2, 0, "")])
    q = _questions(spark, [(7, "Alpha beta, beta!")])
    scored = R.score_candidates(q, store, ["doc_id", "line_no"], n=10)
    got = {r["doc_id"]: round(r["similarity"], 9) for r in scored.collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_dense_cosine_bounds(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 2.0], [0.0, 0.0]), ([1.0, 0.0], [0.0, 3.0])],
                               "a array<double>, b array<double>")
    got = [r["c"] for r in df.select(V.dense_cosine("a", "b").alias("c")).collect()]
    assert got == [1.0, 0.0, 0.0]


def test_fewer_candidates_than_k(spark):
    store = _store(spark, [(1, 0, "red fish"), (2, 0, "blue fish"), (3, 0, "green tree")])
    q = _questions(spark, [(1, "one fish"), (2, "nothing matches here")])
    ranked = R.rank_content(q, store).orderBy("query_id", "rank").collect()
    per_q = {}
    for r in ranked:
        per_q.setdefault(r["query_id"], []).append((r["doc_id"], r["similarity"]))
    assert len(per_q[1]) == 3 and per_q[1][0][1] > 0 and per_q[1][2] == (3, 0.0)
    assert per_q[2] == [(1, 0.0), (2, 0.0), (3, 0.0)]


def test_answer_format_and_apology(spark):
    store = _store(spark, [(1, 0, "red fish"), (1, 1, "blue fish")])
    q = _questions(spark, [(1, "Fish?")])
    info = spark.createDataFrame([(1, 2, "blue fish"), (1, 1, "red fish")],
                                 "query_id long, rank long, content string")
    ans = R.generate_response(q, info).first()["answer"]
    assert ans == (R.HEADER_PREFIX + "Fish?" + R.HEADER_SUFFIX + "- red fish\n- blue fish\n")
    empty = info.filter(F.lit(False))
    assert R.generate_response(q, empty).first()["answer"] == R.NO_INFO
    assert R.answer_queries(q, store.filter(F.lit(False))).first()["answer"] == R.NOT_TRAINED


def test_whole_store_top_k_matches_brute_force(spark):
    import math
    from collections import Counter
    docs = ["the cat sat", "the dog sat down", "cats and dogs", "a cat and a dog", "down the road",
            "road trip", "cat cat cat", "the the the"]
    store = _store(spark, [(i, 0, d) for i, d in enumerate(docs)])
    q = _questions(spark, [(1, "the cat"), (2, "dog road")])
    ranked = R.rank_content(q, store, k=5).collect()

    def vec(s):
        return Counter(w for w in s.split() if len(w) >= 2)

    def cos(a, b):
        dot = sum(a[t] * b[t] for t in a)
        na = math.sqrt(sum(v * v for v in a.values()))
        nb = math.sqrt(sum(v * v for v in b.values()))
        return dot / (na * nb) if na * nb else 0.0

    for qid, text in [(1, "the cat"), (2, "dog road")]:
        scores = sorted(((-cos(vec(text), vec(d)), i) for i, d in enumerate(docs)))[:5]
        got = sorted(((-r["similarity"], r["doc_id"]) for r in ranked if r["query_id"] == qid))
        assert got == scores


def test_ranks_on_raw_values(spark):
    """Similarities that agree to six digits still rank by their true order."""
    store = _store(spark, [(1, 0, "aa " * 10_000 + "bb bb"), (2, 0, "aa " * 10_000 + "bb")])
    ranked = R.rank_content(_questions(spark, [(1, "aa")]), store).orderBy("rank").collect()
    assert [r["doc_id"] for r in ranked] == [2, 1]
    assert [round(r["similarity"], 6) for r in ranked] == [1.0, 1.0]


def test_clusters_give_the_full_ranking(spark):
    """Topics with words of their own: most clusters are passed over, and the hits are those of the whole store."""
    import numpy as np

    from lexis.operators import cluster as K
    from lexis.operators.vectorize import l2_normalize, vectors
    rng = np.random.default_rng(12)
    words = [[f"t{t}w{i}" for i in range(12)] for t in range(10)]
    lines = [(i, " ".join([*words[i % 10][:6], rng.choice(words[i % 10][6:]), "the"])) for i in range(300)] + [(900 + i, "") for i in range(3)]
    store = spark.createDataFrame(lines, "id long, content string")
    qs = [(t, " ".join([*rng.choice(words[t][:6], 4, replace=False), "the"])) for t in range(10)] + [(50, "the"), (51, "nothing known"), (52, ""), (53, "t1w1 t2w2 t3w3")]
    questions = spark.createDataFrame(qs, "query_id long, query string")
    docs = vectors(store, ["id"], "content", 1 << 18, lowercase=False)
    weights = l2_normalize(docs).select("id", "feature", "weight")
    centres = K.sparse_init(weights, ["id"], 40)
    report = []
    got = R.rank_by_clusters(questions, store, ["id"], docs, *R.cluster_cells(docs, ["id"], centres), report=report)
    want = R.rank_content(questions, store, ["id"], doc_vectors=docs)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["similarity"], 9)) for r in df.collect())
    assert rows(got) == rows(want)
    ranked, every = report[0]
    assert ranked < 0.7 * every, report


def test_members_are_written_by_cluster_once(spark):
    """A cluster's members lie side by side in every file, and ranking reads that table and writes no other one."""
    import os

    from lexis.operators import cluster as K
    from lexis.operators import packed as P
    from lexis.session import checkpoint_root
    lines = [(i, f"cats and {['dogs', 'birds', 'fish'][i % 3]} number {i % 7}") for i in range(200)]
    store = spark.createDataFrame(lines, "id long, content string").repartition(2)
    docs = P.vector_table(store, ["id"], "content", lowercase=False)
    cells = R.cluster_cells(docs, ["id"], K.sparse_init(docs, ["id"], 9))
    for part in cells[0].select("cluster_id").rdd.glom().collect():
        own = [r["cluster_id"] for r in part]
        assert own == sorted(own)
    tables = lambda: {f for f in os.listdir(checkpoint_root(spark)) if f.startswith("members-")}
    before = tables()
    questions = spark.createDataFrame([(1, "fish number 3"), (2, "birds")], "query_id long, query string")
    got = R.rank_by_clusters(questions, store, ["id"], docs, *cells)
    assert got.count() == 10 and tables() == before
