import itertools
import random

import numpy as np

from lexis.llm import blocks, embedding_dedup, ngram_join, span_dedup
from lexis.llm.components import components

RND = random.Random(9)
VOCAB = [f"w{i}" for i in range(400)]


def words(n):
    return [RND.choice(VOCAB) for _ in range(n)]


def groups(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (300, 200)]
    got = {r.id: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = groups({x for p in pairs for x in p}, pairs)
    assert got == {k: v for k, v in want.items()}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_tiles_meet_every_pair_once(spark):
    rows = [(k, f"{k}-{i}") for k, n in ((1, 2), (2, 40), (3, 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "key long, member string")
    df = df.join(blocks.bucket_sizes(df, "t"), "key")
    seen = []
    for (key, _), part in itertools.groupby(sorted(blocks.tiles(df, 6).collect(), key=lambda r: (r.key, r.tile)),
                                            key=lambda r: (r.key, r.tile)):
        part = list(part)
        ok = blocks.pair_mask(np.array([r.late for r in part]), part[0].own)
        seen += [(key, *sorted((part[i].member, part[j].member))) for i, j in zip(*np.nonzero(ok))]
    want = [(k, *sorted((a, b))) for k in (1, 2, 3) for a, b in itertools.combinations([m for x, m in rows if x == k], 2)]
    assert sorted(seen) == sorted(want)


def near_copies():
    docs = []
    for _ in range(12):
        base = words(120)
        docs.append(" ".join(base))
        for _ in range(RND.randrange(4)):
            other = list(base)
            for _ in range(RND.randrange(4)):
                other[RND.randrange(120)] = RND.choice(VOCAB)
            docs.append(" ".join(other))
    hot = words(100)
    docs += [" ".join(hot)] * 15 + [" ".join([*hot, f"tail{i}"]) for i in range(15)]
    docs += [" ".join(words(30) + hot[:40]) for _ in range(20)]  # share a passage only
    docs += ["Short one", "short  ONE", "", "   ", None, "x", "x"]
    return list(enumerate(docs))


def jaccard_links(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    return [(a, b) for a, b in itertools.combinations(sets, 2)
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def check_join(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, member string")
    got = ngram_join.join(df, **options).collect()
    pairs = jaccard_links(rows)
    want = groups([i for i, _ in rows], pairs)
    assert {r.doc_id: r.class_id for r in got} == want
    n = dict.fromkeys(want, 0)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    assert {r.doc_id: r.n_links for r in got} == n
    assert {r.doc_id for r in got if r.kept} == set(want.values())


def test_join_equals_brute_force(spark):
    check_join(spark, near_copies())


def test_join_with_splitting(spark):
    # small limit: buckets are split along longer paths
    check_join(spark, near_copies(), limit=8, recall=0.999999)


def test_join_edges(spark):
    schema = "doc_id long, text string"
    assert ngram_join.join(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (2, "other text")]
    got = ngram_join.join(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.n_links for r in got) == [0, 0, 2, 2, 2]
    assert sum(r.kept for r in got) == 3
    kept = ngram_join.keep_one(spark.createDataFrame(rows, schema)).collect()
    assert len(kept) == 3 and len({r.text for r in kept}) == 3
    assert 1 - (1 - ngram_join.run_recall()) ** ngram_join.runs_for(0.9999) >= 0.9999


def test_units_join_to_the_text():
    for t in ["", "a", " a. b!\n\nc d? e", "x" * 9, "\n\n.", ". . .", " ".join(map(str, range(50))), "a b\tc \n d." * 9]:
        for n in (1, 3, 12):
            parts, count = span_dedup.units(t, n)
            assert "".join(parts) == t and max(count, default=0) <= n
            assert count == [len(x.split()) for x in parts]


def brute_spans(rows, run=3, least=12):
    """Spans from every unit, lengthened to ``least`` words, with plain loops."""
    seen, out = set(), {}
    for _, i, h, t in sorted({(i is not None, i or 0, h, t) for i, h, t in rows if t is not None}):
        parts, count = span_dedup.units(t)
        gone = set()
        for p in range(len(parts)):
            end = p + run
            while end <= len(parts) and sum(count[p:end]) < least:
                end += 1
            if end <= len(parts):
                s = tuple(x.strip() for x in parts[p:end])
                if s in seen:
                    gone.update(range(p, end))
                seen.add(s)
        out[i, h] = "".join(x for n, x in enumerate(parts) if n not in gone)
    return out


def test_spans_equal_brute_force(spark):
    def sentence(n):
        return " ".join(words(n)).capitalize() + "."
    passage = " ".join(sentence(9) for _ in range(7))
    unbroken = " ".join(words(70))  # no full stop
    rows = []
    for i in range(40):
        body = [sentence(RND.randrange(1, 20)) for _ in range(RND.randrange(1, 15))]
        if i % 3 == 0:
            body.insert(RND.randrange(len(body) + 1), passage)
        if i % 4 == 0:
            body.insert(RND.randrange(len(body) + 1), unbroken + ".")
        if i % 5 == 0:  # very short sentences, so spans are lengthened
            body.insert(RND.randrange(len(body) + 1), "Oh. No! Yes? Well. So. And. Then. Go. On. Up. To. It. Now.")
        rows.append((i, " ".join(body), len(body), "h"))
    rows += [(50, None, 0, ""), (51, "", 0, ""), (3, rows[3][1], 0, ""), (None, rows[4][1], 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, h string")
    got = span_dedup.dedup(df)
    assert got.columns == df.columns
    from lexis.llm.common import doc_hash
    hashed = [(r.doc_id, r.hh, r.text) for r in df.withColumn("hh", doc_hash()).collect()]
    want = brute_spans([(i, h, t) for i, h, t in hashed if i is not None])
    out = got.collect()
    assert len(out) == len(rows)
    assert sum(passage in (r.text or "") for r in out) == 1
    assert sum(unbroken in (r.text or "") for r in out) == 1
    assert all(r.n_chars == len(r.text) for r in out if r.text is not None)
    # the row without an id comes first, so the others are compared without it
    no_null = {r.doc_id: r.text for r in span_dedup.dedup(df.where("doc_id is not null")).where("text is not null").collect()}
    assert no_null == {i: t for (i, _), t in want.items()}
    assert span_dedup.dedup(df.limit(0)).collect() == []


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for _ in range(30):
        v = rng.normal(size=16)
        for _ in range(rng.integers(1, 5)):
            rows.append((n, [float(x) for x in v + rng.normal(size=16) * 0.05], int(rng.integers(2)) if n % 9 else None))
            n += 1
    rows += [(n + i, rows[5][1], 1) for i in range(20)]
    n += 20
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] + [1.0] * 15, 1),
             (n + 4, [], 1), (n + 5, [2 * x for x in rows[5][1]], 1), (n + 6, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, "m") for r in rows], "vec_id long, embedding array<double>, label int, member string")
    got = embedding_dedup.dedup(df, recall=0.999999).collect()

    def good(v):
        return v and None not in v and np.isfinite(v).all() and any(v)
    pairs = [(a, b) for (a, x, p), (b, y, q) in itertools.combinations(rows, 2)
             if p is not None and p == q and good(x) and good(y) and len(x) == len(y)
             and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93]
    want = groups([r[0] for r in rows], pairs)
    links = dict.fromkeys(want, 0)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    assert {r.vec_id: (r.component_id, r.n_links) for r in got} == {i: (want[i], links[i]) for i in want}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.dedup(df.limit(0)).collect() == []


def test_embedding_plan_reaches_recall():
    for n in (1, 100, 10 ** 6, 10 ** 9):
        k, tables = embedding_dedup.plan(n, 0.93, 0.98)
        near = embedding_dedup.meet_chance((2 - 2 * 0.93) ** 0.5) ** k
        assert 1 - (1 - near) ** tables >= 0.98


def test_spans_with_clashing_columns(spark):
    passage = " ".join(words(70))
    names = ["doc_id", "text", "k", "kh", "_pos", "_h", "mark_id", "gone", "h", "LO", "hi"]
    rows = [(i, f"Own {i}. {passage}. End.", *range(9)) for i in range(4)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"{c} int" for c in names[2:])]))
    out = span_dedup.dedup(df)
    assert out.columns == names
    got = sorted(map(tuple, out.collect()))
    assert [passage in r[1] for r in got] == [True, False, False, False] and all(r[2:] == tuple(range(9)) for r in got)


def test_few_links_take_few_tasks(spark, monkeypatch):
    from lexis.llm import components as module

    parts, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df, tag: (parts.append(df.rdd.getNumPartitions()), cut(df, tag))[1])
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = {r.id: r.root for r in components(spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")).collect()}
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert set(got.values()) == {0} and len(got) == 31
    assert max(parts[1:]) <= module.FEWEST
