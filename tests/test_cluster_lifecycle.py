"""K-means steps, store ids and lifecycle metrics."""

import numpy as np
from pyspark.sql import functions as F

from lexis.operators import cluster as K
from lexis.operators import lifecycle as L
from lexis.operators.store import assign_ids


def _points(spark, n=60, d=4, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    return spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n)],
                                 "vec_id long, embedding array<double>"), x


def test_assign_matches_numpy_and_expression(spark):
    pts, x = _points(spark)
    init = K.init_centroids(pts, "vec_id", "embedding", k=5)
    cents = {r["cluster_id"]: np.array(r["center"]) for r in init.collect()}
    c = np.stack([cents[i] for i in range(5)])
    expect = {i: int(np.argmin(((x[i] - c) ** 2).sum(axis=1))) for i in range(len(x))}
    vec = {r["vec_id"]: r["cluster_id"] for r in K.assign_points(pts, "vec_id", "embedding", init).collect()}
    expr = {r["vec_id"]: r["cluster_id"] for r in
            K.assign(pts, "vec_id", "embedding", K.model_literal(init)).collect()}
    assert vec == expect == expr


def test_update_is_running_mean(spark):
    pts, x = _points(spark)
    init = K.init_centroids(pts, "vec_id", "embedding", k=4)
    model = K.update(pts, "vec_id", "embedding", init)
    rows = model.collect()
    assert sum(r["weight"] for r in rows) == len(x)
    asg = {r["vec_id"]: r["cluster_id"] for r in K.assign_points(pts, "vec_id", "embedding", init).collect()}
    for r in rows:
        members = [x[i] for i, c in asg.items() if c == r["cluster_id"]]
        if members:
            assert np.allclose(r["center"], np.mean(members, axis=0))


def test_sparse_kmeans_step(spark):
    w = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0), (3, 1, 1.0), (4, 1, 0.6), (4, 2, 0.8)],
                              "doc long, feature int, weight double")
    docs = spark.createDataFrame([(i,) for i in range(1, 6)], "doc long")  # doc 5 is empty
    cents = K.sparse_init(w, ["doc"], k=2)
    asg = {r["doc"]: r["cluster_id"] for r in K.sparse_assign(docs, w, ["doc"], cents).collect()}
    assert asg[1] == asg[2] and asg[3] == asg[4] and asg[1] != asg[3] and asg[5] is not None
    new_c, new_w = K.sparse_update(w, K.sparse_assign(docs, w, ["doc"], cents), ["doc"], cents, None)
    assert sum(r["weight"] for r in new_w.collect()) == 5


def test_assign_ids_consecutive(spark):
    df = spark.createDataFrame([(d, l) for d in range(30) for l in range(d % 4)],
                               "doc_id long, line_no long").repartition(5)
    rows = assign_ids(df, ["doc_id", "line_no"], start=10).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(11, 11 + len(rows)))
    keys = [(r["doc_id"], r["line_no"]) for r in rows]
    assert keys == sorted(keys)


def test_snapshots(spark):
    man = spark.createDataFrame([(1, 10, True), (2, 20, True), (3, 30, False)],
                                "version long, processed long, valid boolean")
    row = L.latest_snapshot(man).first()
    assert (row["found"], row["version"], row["processed"]) == (True, 2, 20)
    five = spark.createDataFrame([(v,) for v in range(1, 6)], "version long")
    drop = sorted(r["version"] for r in L.snapshot_retention(five, 3).filter(~F.col("keep")).collect())
    assert drop == [1, 2]
    none = L.latest_snapshot(man.filter(F.lit(False))).first()
    assert none["found"] is False and none["version"] is None


def test_progress_zero_total(spark):
    b = spark.createDataFrame([(1, 0, 5.0, 5.0)], "batch_id long, n long, started double, ended double")
    r = L.batch_progress(b).first()
    assert (r["percent"], r["docs_per_second"], r["remaining_seconds"]) == (0.0, 0.0, 0.0)


def test_store_ids_follow_order(spark):
    """Ids must be 1..N in (doc_id, line_no) order however the rows arrive."""
    from lexis.operators.store import build_store
    from tests.conftest import SF01
    docs = spark.read.parquet(f"{SF01}/documents.parquet").repartition(8)
    rows = assign_ids(build_store(docs, ordered=True), ["doc_id", "line_no"], partitioned=True) \
        .select("id", "doc_id", "line_no").collect()
    by_key = sorted(rows, key=lambda r: (r["doc_id"], r["line_no"]))
    assert [r["id"] for r in by_key] == list(range(1, len(rows) + 1))


def test_equal_centres_tie_to_the_lowest(spark):
    x = [[0.1 * i, 0.3, -0.7 * i] for i in range(40)]
    pts = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    cents = spark.createDataFrame([(c, x[c % 5]) for c in range(20)], "cluster_id int, center array<double>")
    got = K.assign_points(pts, "vec_id", "embedding", cents).collect()
    assert all(r["cluster_id"] < 5 for r in got)


def test_append_documents_continues_ids(spark, scratch):
    import os
    from lexis.operators.store import append_documents
    path = os.path.join(scratch, "store")
    first = spark.createDataFrame([(1, 0, "a b"), (1, 1, "c"), (2, 0, "d")],
                                  "doc_id long, line_no long, content string")
    second = spark.createDataFrame([(3, 0, "e"), (3, 1, "f")], "doc_id long, line_no long, content string")
    assert append_documents(spark, path, first, ["doc_id", "line_no"]) == 3
    assert append_documents(spark, path, second, ["doc_id", "line_no"]) == 5
    got = sorted((r["id"], r["content"]) for r in spark.read.parquet(path).collect())
    assert got == [(1, "a b"), (2, "c"), (3, "d"), (4, "e"), (5, "f")]
    # a replayed micro-batch overwrites its own partition instead of duplicating
    bpath = os.path.join(scratch, "bstore")
    append_documents(spark, bpath, first, ["doc_id", "line_no"], batch_id=0)
    append_documents(spark, bpath, second, ["doc_id", "line_no"], batch_id=1)
    append_documents(spark, bpath, second, ["doc_id", "line_no"], batch_id=1)
    ids = sorted(r["id"] for r in spark.read.parquet(bpath).collect())
    assert ids == [1, 2, 3, 4, 5]


def test_lloyd_equals_plain_rounds(spark):
    """Whole numbers throughout, so the plain version's clusters and centres are the very same."""
    rng = np.random.default_rng(8)
    topics = [rng.choice(40, 8, replace=False) for _ in range(6)]
    docs = []
    for i in range(240):
        f = np.unique(np.concatenate([rng.choice(topics[i % 6], 5), rng.choice(40, 2)]))
        w = rng.random(len(f)) + 0.1
        docs.append(dict(zip(f.tolist(), (w / np.linalg.norm(w)).tolist())))
    rows = [(i, f, w) for i, d in enumerate(docs) for f, w in d.items()]
    wvec = spark.createDataFrame(rows, "doc long, feature int, weight double")
    cents = K.sparse_init(wvec, ["doc"], k=9)
    x = np.zeros((240, 40), object)
    for i, f, w in rows:
        x[i, f] = int(np.floor(w * (1 << 30) + 0.5))
    c = np.zeros((9, 40), object)
    for r in cents.collect():
        c[r["cluster_id"], r["feature"]] = int(np.floor(r["value"] * (1 << 30) + 0.5))
    for rounds in (1, 3, 50):
        want_c = c.copy()
        for n in range(rounds):
            d = (want_c * want_c).sum(axis=1)[None, :] - 2 * (x @ want_c.T)
            near = np.array([min(range(9), key=lambda k: (d[i, k], k)) for i in range(240)])
            before = want_c.copy()
            for k in range(9):
                own = x[near == k]
                if len(own):
                    want_c[k] = [int(np.floor(s / len(own) + 0.5)) for s in own.sum(axis=0)]
            if (want_c == before).all():
                break
        report = []
        got, centres = K.lloyd(wvec, ["doc"], cents, rounds, report)
        assert {r["doc"]: r["cluster_id"] for r in got.collect()} == dict(enumerate(near.tolist()))
        made = np.zeros((9, 40))
        for r in centres.collect():
            made[r["cluster_id"], r["feature"]] = r["value"]
        assert np.allclose(made, want_c.astype(float) / (1 << 30), atol=1e-12)
    assert report[0] == 240 and sum(report[1:]) < 0.8 * 240 * (len(report) - 1), report


def test_parallel_seeds(spark):
    """Drawn by distance, the same however the rows are dealt; copies of a seed are never drawn."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(300):
        group = i % 5 if i < 290 else 5  # the last ten are far from all others
        f = [group * 10 + int(j) for j in rng.choice(10, 4, replace=False)]
        rows += [(i, j, 0.5) for j in f]
    rows += [(1000 + i, j, w) for i in range(50) for d, j, w in rows[:4]]  # copies of document 0
    wvec = spark.createDataFrame(rows, "doc long, feature int, weight double")
    got = [tuple(r) for r in K.parallel_seeds(wvec, ["doc"], k=12).orderBy("cluster_id").collect()]
    assert got == [tuple(r) for r in K.parallel_seeds(wvec.repartition(5), ["doc"], k=12).orderBy("cluster_id").collect()]
    assert [g[1] for g in got] == list(range(12)) and [g[2] for g in got] == sorted((g[2] for g in got), reverse=True)
    assert len({g[0] for g in got}) == 12 and sum(g[0] >= 1000 or g[0] == 0 for g in got) <= 1
    everyone = K.parallel_seeds(wvec, ["doc"], k=5000)
    assert everyone.agg(F.sum("weight")).first()[0] == 350
    assert K.seed_centres(wvec, ["doc"], everyone).select("cluster_id").distinct().count() == everyone.count()
    assert K.parallel_seeds(wvec.limit(0), ["doc"], k=3).collect() == []
