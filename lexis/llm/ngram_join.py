"""N-gram Jaccard join by chosen paths.

Documents are sets of word shingles (``width`` words, lower-cased, split at
white space; a shorter text is one shingle; a text without words has none and
links with nothing).  Two documents link if the Jaccard similarity of their sets
is ``threshold`` or more.

1. Equal sets are one class (a 128-bit digest); only classes are compared.
2. Each class has SLOTS minhash values.  A run extends a path by every slot whose
   value a hash of (path, slot, value) picks, BRANCH / (threshold x SLOTS) of all
   values, so a pair at the threshold shares BRANCH extensions on average.
   Classes with equal paths form a bucket.  A bucket over ``limit`` classes is
   split again by longer paths, unless it keeps most of its parent's classes
   (then they resemble each other, and splitting gains nothing).
3. Buckets are compared in tiles (see ``blocks``): first minhash estimates far
   below the threshold drop rows without a partner, then the sets themselves
   decide.  A pair that meets in several buckets counts in the first.
4. With BRANCH = 2.5, a pair at the threshold shares some path of any length with
   a probability of 0.89 in a run (``run_recall``); runs repeat until
   1 - (1 - run_recall)^runs reaches ``recall``, which defaults to 0.9999.
   Pairs above the threshold are found with a higher probability.

The result has a row for each document: id, class_id (the smallest document id
in its group, groups being connected by links), n_links (other documents linked
directly, copies included) and kept (one document of each group).  Rows equal in
id and text are copies; the first of them counts as kept.  Null ids sort first.
Only the id and text columns are read.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexis.llm.blocks import bucket_sizes, link_rows, meets_first, pair_mask, per_tile, tiles
from lexis.llm.common import cut, doc_hash, entering, forget, fresh
from lexis.llm.components import components

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.9999
SLOTS, BRANCH, LIMIT, DEPTH, DENSE = 64, 2.5, 4096, 4, 0.8
#: A pair may be dropped before the sets are read if fewer slots agree; at the
#: threshold the number is binomial, and this bound fails for one pair in a million.
SLACK = 5.0
CACHE_WORDS = 300_000
_MASK = (1 << 64) - 1
_ODD = np.random.default_rng(7).integers(1, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.random.default_rng(8).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(text: str | None, width: int, known: dict) -> np.ndarray:
    """The sorted set of 64-bit hashes of a text's shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(len(h) - width + 1, 1)
    total = np.zeros(n, np.uint64)
    for j in range(min(width, len(h))):
        total += mix(h[j:j + n] + np.uint64(j + 1)) * _STEP[j % 64]
    return np.unique(mix(total))


def signature(values: np.ndarray) -> np.ndarray:
    """SLOTS minhash values of 32 bits."""
    low = np.full(SLOTS, _MASK, np.uint64)
    for lo in range(0, len(values), 4096):
        low = np.minimum(low, (values[None, lo:lo + 4096] * _ODD[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32)


def run_recall(branch: float = BRANCH) -> float:
    """Chance that a pair at the threshold shares a path of any length: the
    survival of a branching process with Poisson(branch) children."""
    die = 0.0
    for _ in range(200):
        die = math.exp(-branch * (1 - die))
    return 1 - die


def runs_for(recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - run_recall())))


def _base(docs: DataFrame, width: int) -> DataFrame:
    """One row per document: doc_id, h (text hash), member (digest of its set,
    null without words), size, sig."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("ngram_join")
        known = _Hashes()
        for b in batches:
            if len(known) > CACHE_WORDS:
                known = _Hashes()
            member, size, sig = [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, width, known)
                size.append(len(s))
                if len(s):
                    one, two = mix(s + np.uint64(1)).sum(), np.bitwise_xor.reduce(mix(s * _ODD[0] + np.uint64(len(s))))
                    member.append(int(one).to_bytes(8, "big") + int(two).to_bytes(8, "big"))
                    sig.append(signature(s).tobytes())
                else:
                    member.append(None)
                    sig.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("h"), pa.array(member, pa.binary()), pa.array(size, pa.int64()),
                 pa.array(sig, pa.binary())], names=["doc_id", "h", "member", "size", "sig"])

    return docs.withColumn("h", doc_hash()).select("doc_id", "h", "text").mapInArrow(
        task, f"doc_id {id_type}, h long, member binary, size long, sig binary")


def _paths(classes: DataFrame, runs: int, chance: float) -> DataFrame:
    """First extensions of every run: (key, used, member)."""
    bound = np.uint64(min(int(chance * 2.0 ** 64), _MASK))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, SLOTS).astype(np.uint64)
            token = mix((sig << np.uint64(8)) + np.arange(1, SLOTS + 1, dtype=np.uint64))
            for r in range(runs):
                pick = mix(token + np.uint64((r + 1) * 0x9E3779B97F4A7C15 & _MASK))
                row, slot = np.nonzero(pick < bound)
                key = mix(pick[row, slot] * _STEP[r % 64] + np.uint64(r))
                yield _path_batch(b.column("member"), row, key, np.int64(1) << slot)

    return classes.select("member", "sig").mapInArrow(task, "key long, used long, member binary")


def _path_batch(member, row, key, used) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(used.astype(np.int64)), member.take(pa.array(row))],
        names=["key", "used", "member"])


def _longer(rows: DataFrame, chance: float) -> DataFrame:
    """Next extensions: (key, used, member, parent's n)."""
    bound = np.uint64(min(int(chance * 2.0 ** 64), _MASK))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, SLOTS).astype(np.uint64)
            token = mix((sig << np.uint64(8)) + np.arange(1, SLOTS + 1, dtype=np.uint64))
            old, used = b.column("key").to_numpy().view(np.uint64), b.column("used").to_numpy()
            pick = mix(token ^ mix(old + np.uint64(1))[:, None])
            free = (used[:, None] >> np.arange(SLOTS)) & 1 == 0
            row, slot = np.nonzero((pick < bound) & free)
            out = _path_batch(b.column("member"), row, mix(pick[row, slot] + old[row]), used[row] | np.int64(1) << slot)
            yield pa.RecordBatch.from_arrays([*out.columns, b.column("n").take(pa.array(row))],
                                             names=[*out.schema.names, "parent"])

    return rows.mapInArrow(task, "key long, used long, member binary, parent long")


def _buckets(classes: DataFrame, runs: int, threshold: float, limit: int) -> DataFrame:
    """(key, member, n) of all final buckets with two classes or more."""
    chance = BRANCH / (threshold * SLOTS)
    rows, final = _paths(classes, runs, chance).withColumn("parent", F.lit(1 << 62)), None
    for depth in range(1, DEPTH + 1):
        sizes = bucket_sizes(rows, "buckets")
        sized = rows.join(sizes, "key")
        more = F.lit(False) if depth == DEPTH else (F.col("n") > limit) & (F.col("n") < DENSE * F.col("parent"))
        done = cut(sized.where(~more).select("key", "member", "n"), "final")
        final = done if final is None else final.unionByName(done)
        if depth == DEPTH or not sizes.where(F.col("n") > limit).take(1):
            break
        big = cut(sized.where(more), "big")
        rows = cut(_longer(big.join(classes.select("member", "sig"), "member"), chance), "paths")
    return final


def _keys_of(table: pa.Table) -> list[np.ndarray]:
    return [np.array(k, np.int64) for k in table.column("keys").to_pylist()]


def _likely(threshold: float):
    """Rows of a tile that have a partner whose minhash estimate is near the threshold."""
    least = SLOTS * threshold - SLACK * math.sqrt(SLOTS * threshold * (1 - threshold))

    def work(t: pa.Table) -> pa.RecordBatch | None:
        late = t.column("late").to_numpy()
        ok = pair_mask(late, t.column("own")[0].as_py())
        size = t.column("size").to_numpy().astype(np.float64)
        ok &= np.minimum.outer(size, size) >= threshold * np.maximum.outer(size, size) - 1e-9
        if not ok.any():
            return None
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, SLOTS)
        same = np.zeros(ok.shape, np.uint8)
        for s in range(SLOTS):
            same += sig[:, s][:, None] == sig[:, s][None, :]
        ok &= same >= least
        if ok.any():
            ok &= meets_first(t.column("key")[0].as_py(), _keys_of(t))
        rows = np.flatnonzero(ok.any(axis=0) | ok.any(axis=1))
        if not len(rows):
            return None
        return t.select(["key", "tile", "late", "own", "member"]).take(pa.array(rows)).combine_chunks().to_batches()[0]

    return work


def overlap(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    dense = np.cumsum(shared) - 1
    keep = shared[col]
    row, col = row[keep], dense[col[keep]]
    out = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = int(shared.sum())
    for lo in range(0, width, 4096):
        a, b = np.searchsorted(col, [lo, lo + 4096])
        m = np.zeros((len(sets), min(4096, width - lo)), np.float32)
        m[row[a:b], col[a:b] - lo] = 1
        out += m @ m.T
    return out


def _exact(threshold: float):
    """Links of a tile's rows, decided on the sets."""
    def work(t: pa.Table) -> pa.RecordBatch | None:
        sets = [np.frombuffer(s, np.uint64) for s in t.column("set").to_pylist()]
        size = np.array([len(s) for s in sets], np.float64)
        both = overlap(sets)
        linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
        linked &= pair_mask(t.column("late").to_numpy(), t.column("own")[0].as_py())
        if not linked.any():
            return None
        linked &= meets_first(t.column("key")[0].as_py(), _keys_of(t))
        return link_rows(t.column("member").combine_chunks(), t.column("copies").to_numpy(), linked)

    return work


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(member, set) of the wanted classes, from the text of one document of each."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            if len(known) > CACHE_WORDS:
                known = _Hashes()
            sets = [shingles(x, width, known).tobytes() for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("member"), pa.array(sets, pa.binary())], names=["member", "set"])

    texts = docs.withColumn("h", doc_hash()).join(
        wanted.select(F.col("doc_id").alias("wanted_id"), F.col("h").alias("wanted_h"), "member").hint("merge"),
        F.col("h").eqNullSafe(F.col("wanted_h")) & F.col("doc_id").eqNullSafe(F.col("wanted_id")))
    # rows equal in id and text are copies: one is enough
    return texts.groupBy("member").agg(F.first("text").alias("text")).mapInArrow(task, "member binary, set binary")


def join(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, recall: float = RECALL,
         limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (64-bit hash of the text), class_id, n_links, kept."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = cut(_base(docs, width).withColumn("row", F.monotonically_increasing_id()), "base")
    classes = cut(base.where("member is not null").groupBy("member").agg(
        F.min(F.struct("doc_id", "h", "row")).alias("first"), F.count(F.lit(1)).alias("copies"),
        F.first("size").alias("size"), F.first("sig").alias("sig")), "classes")
    final = cut(_buckets(classes, runs_for(recall), threshold, limit), "members")
    keys = cut(final.groupBy("member").agg(F.sort_array(F.collect_list("key")).alias("keys")), "keys")

    # minhash estimates leave the rows worth reading sets for
    rows = tiles(final).join(keys.join(classes.select("member", "size", "sig"), "member"), "member")
    likely = cut(per_tile(rows, _likely(threshold), "key long, tile long, late int, own boolean, member binary"), "likely")
    wanted = cut(likely.select("member").distinct().join(classes, "member")
                 .select("member", "first.doc_id", "first.h", "copies"), "wanted")
    sets = cut(_sets(docs, wanted, width), "sets")
    rows = likely.join(sets.join(keys, "member").join(wanted.select("member", "copies"), "member"), "member")
    found = cut(per_tile(rows, _exact(threshold), "a binary, b binary, links long"), "links")
    forget(sets, likely)

    group = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("member")).agg(F.sum("links").alias("links"))
    own = (classes.select("member", "first", "copies").join(links, "member", "left")
           .join(group.select(F.col("id").alias("member"), "root"), "member", "left")
           .where("copies > 1 or root is not null")
           .withColumn("root", F.coalesce("root", "member")))
    own = cut(own, "grouped")
    heads = cut(own.groupBy("root").agg(F.min("first").alias("head")), "heads")
    own = cut(own.join(heads, "root").select("member", F.col("head.doc_id").alias("class_id"), F.col("head.row").alias("head"),
                                             (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
              "own")
    return base.select("doc_id", "h", "row", "member").join(own, "member", "left").select(
        "doc_id", "h", F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce(F.col("head") == F.col("row"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group, all columns.  Of rows equal in id
    and text any one stays."""
    own, h, k = fresh(docs, "text_hash", "kept_hash", "kept_id")
    kept = cut(join(docs, id_col=id_col, text_col=text_col, **options).where("kept")
               .select(F.col("doc_id").alias(k), F.col("h").alias(h)).distinct(), "kept")
    return (docs.withColumn(own, doc_hash(text_col)).dropDuplicates([id_col, own])
            .join(kept, F.col(own).eqNullSafe(F.col(h)) & F.col(id_col).eqNullSafe(F.col(k)), "left_semi").drop(own))


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "kept")


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE c >= 0.8 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT d.doc_id, l.class_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, d.doc_id = l.class_id AS kept
FROM documents d JOIN least l ON d.doc_id = l.x LEFT JOIN counts c ON d.doc_id = c.x
"""
