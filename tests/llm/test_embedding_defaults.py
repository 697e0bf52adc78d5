"""Embedding links with the parameters of production, against brute force."""

import numpy as np

from lexis.llm import embedding_dedup


def test_links_at_the_threshold_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=(600, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = rng.uniform(0.925, 0.94, 600)[:, None]  # many pairs joined by one link close to 0.93
    x = np.concatenate([a, cos * a + np.sqrt(1 - cos * cos) * side])
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.component_id, r.n_links) for r in embedding_dedup.dedup(df).collect()}

    linked = x @ x.T >= 0.93 * np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(x, axis=1)
    np.fill_diagonal(linked, False)
    least = np.arange(len(x))
    while True:
        new = np.minimum(least, np.where(linked, least[None, :], len(x)).min(axis=1))
        if (new == least).all():
            break
        least = new
    assert got == {i: (int(least[i]), int(linked[i].sum())) for i in range(len(x))}
