"""Language-model scoring by prediction by partial matching (PPM, escape method C).

The model is a trie of byte contexts of up to ORDER bytes: a node for each
context, with the count of every symbol (a byte, or the end of the text) that
followed it in the training texts.  A symbol's probability in a context that
saw it is c / (n + d) (c times the symbol, n symbols, d distinct ones); else the
model escapes with d / (n + d) to the context that is one byte shorter, where
all symbols of the longer one are excluded, and last to a uniform choice among
the symbols never seen.  A text is preceded by ORDER start marks, so the
probabilities of all texts sum to one.

The trie is a distributed table, not an object: nodes are keyed by 9 bits a symbol.
Texts are grouped in blocks of bounded size in the order read.  A block
names its distinct (context, symbol) pairs and words with their training counts;
counts are added up (map-side first) and written, and joined back to what the blocks hold, so that a
word or context of every block is no group of one task, and the join can split it.  A task needs its own
block's share of the model only, and shuffled
rows are a block's distinct pairs, not its bytes.  A block's share comes first, then its texts, which are
scored slice by slice.  Symbols that need an escape (a few) pass through one join for each order.

Beside it the unigram word model of ``base_score``: log10((c + 0.1) / (N + 0.1 (V + 1)))
over words and one end token, from the same blocks.

A-Z are lower-cased, white space is [\\x20\\x09-\\x0D].  Null text counts as empty.
Rows with equal ids are scored one by one.  A null id belongs to the training
texts.  Without training texts every symbol is uniform.  Only the id and text
columns are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexis.llm.common import cut, entering, forget, release
from lexis.llm.labelled import fold

ORDER = 4
BITS, END, START, SYMBOLS = 9, 256, 257, 257
BLOCK_CHARS, SLICE_BYTES, MOST_SLOTS, MOST_PAIRS = 32_000_000, 1_000_000, 1 << 24, 2_000_000


def _dense(slot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct slots in order, and each slot's place among them."""
    if size > MOST_SLOTS:
        return np.unique(slot, return_inverse=True)
    seen = np.zeros(size, np.bool_)
    seen[slot] = True
    distinct = np.flatnonzero(seen)
    place = np.empty(size, np.int32)
    place[distinct] = np.arange(len(distinct), dtype=np.int32)
    return distinct, place[slot]


def trie(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Walk the texts down a trie of contexts, one symbol deeper at a time.

    Gives for each byte and end of the texts the number of its leaf (context and
    symbol), the leaves' codes (context and symbol as one integer), and
    the number of symbols of each text.
    """
    n = np.array([len(b) + 1 for b in bodies], np.int64)
    size = n + ORDER
    flat = np.full(int(size.sum()), START, np.int64)
    real = np.ones(len(flat), bool)
    begin = np.cumsum(size) - size
    for b, at in zip(bodies, begin):
        flat[at + ORDER:at + ORDER + len(b)] = np.frombuffer(b, np.uint8)
        flat[at + ORDER + len(b)] = END
        real[at:at + ORDER] = False
    code, symbol = _dense(flat, START + 1)
    width, leaf, letters = len(code), symbol, code
    for depth in range(1, ORDER + 1):
        slot = leaf[:-1].astype(np.int64) * width + symbol[depth:]
        if depth == ORDER:
            slot = slot[real[depth:]]
        distinct, leaf = _dense(slot, len(code) * width)
        code = code[distinct // width] << BITS | letters[distinct % width]
    return leaf, code, n


def _blocks(docs: DataFrame, id_col: str, text_col: str, held_out: Column) -> DataFrame:
    """(doc_id, held_out, block, text), a block's rows side by side.  A scan
    partition's rows are dealt at random into as many blocks as its text has BLOCK_CHARS,
    so a block is bounded in bytes (a longer document fills one alone)."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       F.col(text_col).alias("text"), F.spark_partition_id().alias("part"),
                       F.monotonically_increasing_id().alias("row"))
    # a row for each scan partition, as small as a file listing
    sizes = slim.groupBy("part").agg(F.ceil(F.sum(F.length("text")) / BLOCK_CHARS).alias("many"))
    block = F.shiftleft(F.col("part").cast("long"), 20) + F.pmod(F.xxhash64("row"), F.greatest(F.coalesce("many", F.lit(1)), F.lit(1)))
    return (slim.join(F.broadcast(sizes), "part", "left").select("doc_id", "held_out", block.alias("block"), "text")
            .sortWithinPartitions("block"))


def _bodies(column) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in column.to_pylist()]


def _slices(bodies: list[bytes]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, b in enumerate(bodies):
        size += len(b) + 1
        if size >= SLICE_BYTES:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(bodies):
        yield lo, len(bodies)


def _add(code: list[np.ndarray], count: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their added counts."""
    c, n = np.concatenate(code), np.concatenate(count)
    if not len(c):
        return c.astype(np.int64), n.astype(np.int64)
    order = np.argsort(c, kind="stable")
    c, n = c[order], n[order]
    at = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    return c[at], np.add.reduceat(n, at)


def _parts(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.RecordBatch]:
    """The batches, cut where a key changes."""
    for b in batches:
        if b.num_rows:
            cols = [b.column(k).to_numpy() for k in keys]
            change = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            for lo, hi in pairwise([0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]):
                yield b.slice(lo, hi - lo)


class _Names:
    """A block's distinct pairs and words, with their counts in training texts."""

    def __init__(self, block: int):
        self.block, self.words, self.unseen = block, Counter(), set()
        self.code, self.count, self.rows_held = [], [], 0

    def add(self, bodies: list[bytes], held: np.ndarray) -> None:
        for part, weight in (([b for b, h in zip(bodies, held) if not h], 1), ([b for b, h in zip(bodies, held) if h], 0)):
            for lo, hi in _slices(part):
                leaf, found, _ = trie(part[lo:hi])
                self.code.append(found)
                self.count.append(np.bincount(leaf, minlength=len(found)) * weight)
                self.rows_held += len(found)
                if self.rows_held > MOST_PAIRS:
                    self._merge()
            for b in part:
                if weight:
                    self.words.update(b.split())
                else:
                    self.unseen.update(b.split())

    def _merge(self) -> None:
        code, count = _add(self.code, self.count)
        self.code, self.count, self.rows_held = [code], [count], 0  # counted from here, so merging stays rare

    def rows(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        code, count = self.code[0], self.count[0]
        self.unseen.difference_update(self.words)
        for lo in range(0, len(code), 200_000):
            k = len(code[lo:lo + 200_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, self.block)), pa.nulls(k, pa.binary()), pa.array(code[lo:lo + k]), pa.array(count[lo:lo + k])],
                names=["block", "word", "code", "n"])
        keys = chain(self.words, self.unseen)
        while some := list(islice(keys, 50_000)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), self.block)), pa.array(some, pa.binary()), pa.nulls(len(some), pa.int64()),
                 pa.array([self.words.get(w, 0) for w in some], pa.int64())], names=["block", "word", "code", "n"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    entering("ppm")
    names = None
    for t in _parts(batches, "block"):
        block = t.column("block")[0].as_py()
        if names is None or names.block != block:
            if names is not None:
                yield from names.rows()
            names = _Names(block)
        names.add(_bodies(t.column("text")), np.array(t.column("held_out").to_pylist(), bool))
    if names is not None:
        yield from names.rows()


def _low(code: Column, symbols: int) -> Column:
    """The last symbols of a code."""
    return code.bitwiseAND(F.lit((1 << BITS * symbols) - 1))


def _escapes(unseen: DataFrame, seen: DataFrame) -> DataFrame:
    """(code, value): log10 probability of pairs whose full context never had the
    symbol.  unseen: code, n, d of its context; seen: code, c.

    The symbols of a context are among those of every shorter one, so at order k
    exactly the symbols of the order k + 1 context are excluded; ``below`` is
    their count in the order k context.
    """
    grams = {ORDER: seen}
    for k in range(ORDER - 1, -1, -1):
        grams[k] = cut(grams[k + 1].groupBy(_low(F.col("code"), k + 1).alias("code")).agg(F.sum("c").alias("c")), f"order{k}")
    nodes = {}
    for k in range(ORDER + 1):
        rows = grams[k]
        if k:
            shorter = grams[k - 1].select(F.col("code").alias("s"), F.col("c").alias("cs"))
            rows = rows.join(shorter, _low(F.col("code"), k) == F.col("s"))
        else:
            rows = rows.withColumn("cs", F.lit(0).cast("long"))
        nodes[k] = cut(rows.groupBy(F.shiftrightunsigned("code", BITS).alias("ctx")).agg(
            F.sum("c").alias("n"), F.count(F.lit(1)).alias("d"), F.sum("cs").alias("below")), f"nodes{k}")

    def small(df: DataFrame, k: int) -> DataFrame:
        return F.broadcast(df) if k <= 1 else df  # 258 contexts x 257 symbols at most

    top = nodes[ORDER].select(F.col("ctx").alias("x"), F.col("below").alias("below"))
    left = (unseen.join(top, F.shiftrightunsigned("code", BITS) == F.col("x"), "left").drop("x")
            .select("code", F.col("d").alias("gone"), F.coalesce("below", F.lit(0)).alias("below"),
                    F.when(F.col("d") > 0, F.log10(F.col("d") / (F.col("n") + F.col("d")))).otherwise(0.0).alias("value"),
                    F.lit(False).alias("found")))
    for k in range(ORDER - 1, -1, -1):
        node = nodes[k].select(F.col("ctx").alias("x"), "n", "d", F.col("below").alias("next"))
        gram = grams[k].select(F.col("code").alias("g"), "c")
        rest, kinds = F.col("n") - F.col("below"), F.col("d") - F.col("gone")
        step = (F.when(F.col("found") | F.col("n").isNull() | (kinds <= 0), 0.0)
                .otherwise(F.log10(F.coalesce("c", kinds) / (rest + kinds))))
        left = (left.join(small(node, k), F.shiftrightunsigned(_low(F.col("code"), k + 1), BITS) == F.col("x"), "left")
                .join(small(gram, k), _low(F.col("code"), k + 1) == F.col("g"), "left")
                .select("code", F.coalesce("d", F.lit(0)).alias("gone"), F.coalesce("next", F.lit(0)).alias("below"),
                        (F.col("value") + step).alias("value"), (F.col("found") | F.col("c").isNotNull()).alias("found")))
    never = F.greatest(F.lit(SYMBOLS) - F.col("gone"), F.lit(1))
    return left.select("code", (F.col("value") - F.when(F.col("found"), 0.0).otherwise(F.log10(never.cast("double")))).alias("value"))


class _Share:
    """A block's share of the model: its pairs' values, and its words' counts."""

    def __init__(self):
        self.code, self.value, self.number, self.count, self.ready = [], [], {}, [], False

    def pairs(self, t: pa.RecordBatch) -> None:
        self.code.append(t.column("code").to_numpy().copy())
        self.value.append(t.column("value").to_numpy().copy())

    def words(self, t: pa.RecordBatch) -> None:
        for w, c in zip(t.column("word").to_pylist(), t.column("value").to_numpy()):
            if self.number.setdefault(w, len(self.count)) == len(self.count):
                self.count.append(c)

    def whole(self) -> None:
        if not self.ready:
            code = np.concatenate([*self.code, np.zeros(0, np.int64)])
            order = np.argsort(code, kind="stable")
            self.code, self.value = code[order], np.concatenate([*self.value, np.zeros(0)])[order]
            self.count, self.ready = np.array(self.count, np.float64), True
            self.log = np.log10(self.count + 0.1)

    def score(self, t: pa.RecordBatch) -> pa.RecordBatch:
        self.whole()
        bodies = _bodies(t.column("text"))
        model, base, n_words, known = [], [], [], []
        for lo, hi in _slices(bodies):
            leaf, found, n = trie(bodies[lo:hi])
            at = np.searchsorted(self.code, found)
            if not len(self.code) or not np.array_equal(self.code[np.minimum(at, len(self.code) - 1)], found):
                raise RuntimeError("a block's share of the model is incomplete")
            model.append(np.add.reduceat(self.value[at][leaf], np.cumsum(n) - n))
        for b in bodies:
            w = b.split()
            i = np.fromiter(map(self.number.__getitem__, w), np.int64, len(w))
            base.append(float(self.log[i].sum()))
            known.append(int((self.count[i] > 0).sum()))
            n_words.append(len(w))
        return pa.RecordBatch.from_arrays(
            [t.column("doc_id"), t.column("held_out"), pa.array(n_words, pa.int64()), pa.array(known, pa.int64()),
             pa.array(base, pa.float64()), pa.array(np.concatenate(model))], names=["doc_id", "held_out", "words", "known", "base", "score"])


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Score a block's texts, as they come, with the block's share of the model, which comes first."""
    entering("ppm")
    block, share = None, None
    for t in _parts(batches, "block", "kind"):
        now, kind = t.column("block")[0].as_py(), t.column("kind")[0].as_py()
        if share is None or now != block:
            block, share = now, _Share()
        if kind == 2:
            yield share.score(t)
        else:
            (share.words if kind else share.pairs)(t)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    texts = cut(_blocks(docs, id_col, text_col, held_out), "texts", "zstd")
    named = texts.select("block", "held_out", "text").mapInArrow(_named, "block long, word binary, code long, n long")
    named = cut(named, "named")

    held_words = named.where("word is not null").select("block", "word", "n")
    held_pairs = named.where("code is not null").select("block", "code", "n")
    words = cut(held_words.groupBy("word").agg(F.sum("n").alias("c")), "words")
    context = F.shiftrightunsigned("code", BITS)
    codes = cut(held_pairs.groupBy("code").agg(F.sum("n").alias("c")), "codes")
    contexts = cut(codes.where("c > 0").groupBy(context.alias("ctx")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d")), "contexts")
    full = codes.join(contexts, context == F.col("ctx"), "left")
    escaped = _escapes(full.where("c = 0").select("code", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("d", F.lit(0)).alias("d")),
                       codes.where("c > 0"))
    log = F.log10(F.col("c") / (F.col("n") + F.col("d"))).alias("value")
    values = cut(full.where("c > 0").select("code", log).unionByName(escaped), "values")
    release(docs.sparkSession)

    total = words.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    train_docs = texts.where(~F.col("held_out")).count()
    n_train = (total["n"] or 0) + train_docs
    log_z = float(np.log10(n_train + 0.1 * ((total["v"] or 0) + (train_docs > 0) + 1)))

    id_type = texts.schema["doc_id"].dataType.simpleString()
    shape = ["block", "kind", "doc_id", "held_out", "text", "word", "code", "value"]
    kinds = {"doc_id": id_type, "held_out": "boolean", "text": "string", "word": "binary", "code": "long", "value": "double"}

    def row(df: DataFrame, kind: int, *cols) -> DataFrame:
        df = df.select("block", F.lit(kind).alias("kind"), *cols)
        return df.select(*(c if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in shape))

    together = (row(held_pairs.select("block", "code").join(values, "code"), 0, "code", "value")
                .unionByName(row(held_words.select("block", "word").join(words, "word"), 1, "word", F.col("c").cast("double").alias("value")))
                .unionByName(row(texts, 2, "doc_id", "held_out", "text"))
                .repartition("block").sortWithinPartitions("block", "kind"))
    scored = together.mapInArrow(
        _scores, f"doc_id {id_type}, held_out boolean, words long, known long, base double, score double")
    end = float(np.log10(train_docs + 0.1))
    n_tokens = F.col("words") + 1
    return scored.select("doc_id", "held_out", n_tokens.alias("n_tokens"),
                         (F.col("known") + int(train_docs > 0)).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
                         (F.col("base") + end - n_tokens * log_z).alias("base_score"), "score")


def op9_ppm(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold("doc_id", 10) == 0)
