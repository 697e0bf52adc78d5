"""Hard negatives from Hilbert-curve-ordered candidate blocks with zone maps.

1. Vectors become integers, floor(scale * x).  Rows are ordered by label and by their place on
   a Hilbert curve through the CURVE dimensions that vary most, and written as Parquet
   blocks of at most BLOCK rows of one label: ids, integers, and a zone map (least and greatest
   component in every dimension, smallest id).  Anchors are ordered and blocked alike.
2. An anchor wants the best rows of a window of scores: its positives are the best of its own label
   with any score, its negatives the best of other labels between low and high percent of
   each positive's score.  By interval arithmetic a zone map bounds the scores of its block's rows from
   above and below.  A block is read for an anchor only if its bounds reach into a window and can still
   beat the worst row that the window holds.
3. Two readings for each kind of window: first the NEAREST blocks with the greatest bound below the
   window's top for each anchor, which give every window a line to beat, then all blocks that can
   still beat it.  Blocks reach an anchor block in chunks, best bound first, and a chunk hands on a
   window's best rows only; these are merged by rank.  Only zone maps are read to choose.

The work units are (anchor block, chunk of candidate blocks), of bounded size, however many rows
share a label or are copies of each other: a block of equals is skipped by the smallest id in its zone map.

Scores are exact: float64 while every sum of products stays below 2^53, else 64-bit integers.  Ties go to the
smaller vec_id, then the earlier row.  Rows with a null label, or a vector that is null, empty or holds null or
non-finite components, take no part; shorter vectors count as filled with zeros.  Rows that share
an id are separate rows; a null id sorts first and is no anchor.  An empty table gives no rows.
Only the id, vector and label columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexis.llm.blocks import per_tile
from lexis.llm.common import cut, forget
from lexis.llm.vectors import finite_rows, stacked

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
BLOCK, ANCHORS, CHUNK, PAGE, NEAREST = 512, 128, 32, 1024, 2
CURVE, CURVE_BITS = 8, 7
NO_ID = -(1 << 63)
FLOOR, CEILING = -(1 << 63) + 1, (1 << 63) - 1  # a window without a lower or an upper end


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells (rows of coordinates below 2^bits) on the Hilbert curve."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    for b in range(bits - 1, 0, -1):  # undo the curve's turns, from the largest cube inwards
        q = 1 << b
        low = q - 1
        for i in range(n):
            far = (x[:, i] & q) > 0
            swap = np.where(far, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(far, low, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, n - 1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn[:, None]
    place = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | (x[:, i] >> b & 1)
    return place


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, vec): int64 components as bytes, of the rows that take part."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = finite_rows(b.column("vec"))
            at = pa.array(rows)
            blobs = [np.floor(scale * v).astype(np.int64).tobytes() for v in found]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("label").take(at), pa.array(blobs, pa.binary())],
                                             names=["vec_id", "label", "vec"])

    return vectors.where("label is not null").mapInArrow(task, "vec_id long, label long, vec binary")


def curve(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The dimensions that vary most, their means and spreads."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, 2))
        n = 0
        for b in batches:
            if b.num_rows:
                m = stacked(b.column("vec").to_pylist(), np.int64).astype(np.float64)
                if m.shape[1] > len(total):
                    total = np.concatenate([total, np.zeros((m.shape[1] - len(total), 2))])
                total[:m.shape[1]] += np.stack([m.sum(axis=0), np.square(m).sum(axis=0)], 1)
                n += len(m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total[:, 0]), pa.array(total[:, 1]),
                                          pa.array(np.full(len(total), n))], names=["dim", "s", "s2", "n"])

    # a row for each dimension
    sums = (rows.select("vec").mapInArrow(task, "dim long, s double, s2 double, n long")
            .groupBy("dim").agg(F.sum("s").alias("s"), F.sum("s2").alias("s2"), F.sum("n").alias("n")).orderBy("dim").toPandas())
    if not len(sums):
        return np.zeros(0, np.int64), np.zeros(0), np.ones(0)
    n = max(float(sums["n"].max()), 1.0)
    mean = sums["s"].to_numpy() / n
    spread = np.sqrt(np.maximum(sums["s2"].to_numpy() / n - mean ** 2, 0))
    dims = np.sort(np.argsort(-spread, kind="stable")[:CURVE])
    return dims, mean[dims], np.maximum(spread[dims], 1e-9)


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with their place on the curve."""
    dims, mean, spread = curve(rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = np.zeros(b.num_rows, np.int64)
            if b.num_rows:
                m = stacked(b.column("vec").to_pylist(), np.int64)
                have = m[:, dims[dims < m.shape[1]]]
                x = np.zeros((len(m), len(dims)))
                x[:, :have.shape[1]] = have
                cells = np.clip(((x - mean) / spread + 3) / 6 * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1)
                place = hilbert(cells.astype(np.int64), CURVE_BITS)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place)], names=[*b.schema.names, "place"])

    return rows.mapInArrow(task, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", place long")


def _packed(m: np.ndarray) -> tuple[bytes, str]:
    small = m.size and np.abs(m).max() < 1 << 15
    return m.astype("<i2" if small else "<i8").tobytes(), "<i2" if small else "<i8"


def _matrix(blob: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(blob, kind).reshape(n, -1).astype(np.int64)


_BLOCK = ("block long, label long, n int, kind string, first_id long, lo binary, hi binary, vec_ids binary, row_ids binary, "
          "labels binary, m binary")


def blocked(rows: DataFrame, size: int, one_label: bool) -> DataFrame:
    """Rows in curve order, ``size`` at most to a block."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def block(part: pa.Table) -> dict:
            nonlocal number
            m = stacked(part.column("vec").to_pylist(), np.int64)
            blob, kind = _packed(m)
            ids = part.column("vec_id").to_numpy()
            number += 1
            return {"block": number - 1, "label": part.column("label")[0].as_py(), "n": len(m), "kind": kind, "first_id": int(ids.min()),
                    "lo": m.min(axis=0).tobytes(), "hi": m.max(axis=0).tobytes(), "vec_ids": ids.astype(np.int64).tobytes(),
                    "row_ids": part.column("row").to_numpy().astype(np.int64).tobytes(),
                    "labels": part.column("label").to_numpy().astype(np.int64).tobytes(), "m": blob}

        def blocks(t: pa.Table, last: bool) -> tuple[list[dict], pa.Table]:
            out, lo, label = [], 0, t.column("label").to_numpy()
            ends = [*(np.flatnonzero(label[1:] != label[:-1]) + 1).tolist(), len(label)] if one_label else [len(label)]
            for end in ends:
                while end - lo >= size or (lo < end and (last or end < len(label))):
                    hi = min(lo + size, end)
                    out.append(block(t.slice(lo, hi - lo)))
                    lo = hi
            return out, t.slice(lo)

        schema = pa.schema([(f, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[k])
                            for f, k in (c.split() for c in _BLOCK.split(", "))])
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= size:
                found, rest = blocks(pa.Table.from_batches(held), False)
                held = rest.to_batches()
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema)
        if sum(x.num_rows for x in held):
            yield pa.RecordBatch.from_pylist(blocks(pa.Table.from_batches(held), True)[0], schema)

    order = ["label", "place", "vec_id", "row"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(task, _BLOCK)


# --- bounds ------------------------------------------------------------------------
def _wide(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor (row) with any vector between lo and hi (rows)."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return product(up, lo) + product(down, hi), product(up, hi) + product(down, lo)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exact below 2^63."""
    size = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if size < 2.0 ** 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Windows:
    """The windows of one anchor block's anchors, each with its k best rows so far."""

    def __init__(self, state: dict, k: int, same: bool):
        self.k, self.same = k, same
        self.m = _matrix(state["m"], state["kind"], state["n"])
        self.ids, self.rows, self.labels = (np.frombuffer(state[c], np.int64) for c in ("vec_ids", "row_ids", "labels"))
        w = state["windows"] or []
        self.anchor = np.array([x["anchor"] for x in w], np.int64)
        self.lo, self.hi, self.of, self.line, self.line_id = (
            np.array([x[c] for x in w], np.int64) for c in ("lo", "hi", "of", "line", "line_id"))
        self.found = np.zeros((4, 0), np.int64)  # window, score, vec_id, row

    def wants(self, least: np.ndarray, most: np.ndarray, label: np.ndarray, first_id: np.ndarray) -> np.ndarray:
        """Which windows (rows) a block (column) can still serve, by its bounds for every anchor."""
        least, most = least[self.anchor], most[self.anchor]
        fits = (self.labels[self.anchor][:, None] == label[None, :]) == self.same
        beats = (most > self.line[:, None]) | ((most == self.line[:, None]) & (first_id[None, :] <= self.line_id[:, None]))
        return fits & beats & (most >= self.lo[:, None]) & (least <= self.hi[:, None])

    def read(self, b: dict) -> None:
        """Take the rows of a block into the windows that it can serve."""
        lo, hi = (np.frombuffer(b[c], np.int64)[None, :] for c in ("lo", "hi"))
        width = max(lo.shape[1], self.m.shape[1])
        mine = _wide(self.m, width)
        w = np.flatnonzero(self.wants(*bounds(mine, _wide(lo, width), _wide(hi, width)), np.array([b["label"]]), np.array([b["first_id"]]))[:, 0])
        if not len(w):
            return
        ids, rows = np.frombuffer(b["vec_ids"], np.int64), np.frombuffer(b["row_ids"], np.int64)
        who, at = np.unique(self.anchor[w], return_inverse=True)
        score = product(mine[who], _wide(_matrix(b["m"], b["kind"], b["n"]), width))
        score_of = score[at]
        good = (score_of >= np.maximum(self.lo, self.line)[w][:, None]) & (score_of <= self.hi[w][:, None])
        good &= rows[None, :] != self.rows[self.anchor[w]][:, None]
        i, j = np.nonzero(good)
        if len(i):
            new = np.stack([w[i], score_of[i, j], ids[j], rows[j]])
            self.found = np.concatenate([self.found, new], axis=1)
            self.settle()

    def settle(self) -> None:
        """Keep each window's k best and raise its line."""
        f = self.found
        f = f[:, np.lexsort((f[3], f[2], -f[1], f[0]))]
        first = np.flatnonzero(np.append(True, f[0][1:] != f[0][:-1]))
        nth = np.arange(f.shape[1]) - np.repeat(first, np.diff(np.append(first, f.shape[1])))
        self.found = f[:, nth < self.k]
        last = f[:, nth == self.k - 1]
        better = (last[1] > self.line[last[0]]) | ((last[1] == self.line[last[0]]) & (last[2] < self.line_id[last[0]]))
        last = last[:, better]
        self.line[last[0]], self.line_id[last[0]] = last[1], last[2]

    def best(self) -> pa.RecordBatch:
        w, score, ids, rows = self.found
        a = self.anchor[w]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.ids[a], self.rows[a], self.of[w], ids, rows, score)],
                                          names=["anchor_id", "anchor_row", "of", "vec_id", "row", "score"])


_ANCHOR = ["n", "kind", "vec_ids", "row_ids", "labels", "m"]
_WINDOW = "array<struct<anchor: int, of: long, lo: long, hi: long, line: long, line_id: long>>"


def choose(states: DataFrame, zones: DataFrame, n_states: int, n_zones: int, k: int, same: bool, nearest: int | None) -> DataFrame:
    """(state, block, most): the blocks that an anchor block's windows must read; with
    ``nearest`` only so many for each window, those with the greatest bound up to the window's top."""
    pages, groups = -(-n_zones // PAGE) or 1, -(-n_states // (PAGE // 16)) or 1
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>"))
    zone = zones.select(F.pmod(F.xxhash64("block"), F.lit(pages)).alias("key"), every(groups).alias("tile"), F.lit(None).cast("long").alias("state"),
                        "block", "label", "first_id", "lo", "hi", *(F.lit(None).cast(states.schema[c].dataType).alias(c) for c in [*_ANCHOR, "windows"]))
    state = states.select(every(pages).alias("key"), F.pmod(F.xxhash64("state"), F.lit(groups)).alias("tile"), "state",
                          *(F.lit(None).cast(t).alias(c) for c, t in (("block", "long"), ("label", "long"), ("first_id", "long"), ("lo", "binary"), ("hi", "binary"))),
                          *_ANCHOR, "windows")

    def work(t: pa.Table) -> pa.RecordBatch | None:
        is_state = t.column("state").is_valid()
        z, s = t.filter(pc.invert(is_state)), t.filter(is_state)
        if not z.num_rows or not s.num_rows:
            return None
        lo, hi = (stacked(z.column(c).to_pylist(), np.int64) for c in ("lo", "hi"))
        block, label, first = (z.column(c).to_numpy() for c in ("block", "label", "first_id"))
        out = []
        for x in s.select(["state", *_ANCHOR, "windows"]).to_pylist():
            win = Windows(x, k, same)
            if not len(win.anchor):
                continue
            width = max(lo.shape[1], win.m.shape[1])
            least, most = bounds(_wide(win.m, width), _wide(lo, width), _wide(hi, width))
            wants = win.wants(least, most, label, first)
            reach = np.minimum(most[win.anchor], win.hi[:, None])
            if nearest and wants.shape[1] > nearest:
                near = np.where(wants, reach, FLOOR)
                at = np.argpartition(-near, nearest - 1, axis=1)[:, :nearest]
                few = np.zeros_like(wants)
                np.put_along_axis(few, at, True, axis=1)
                wants &= few
            at = np.flatnonzero(wants.any(axis=0))
            out.append((np.full(len(at), x["state"]), block[at], np.where(wants, reach, FLOOR).max(axis=0)[at]))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["state", "block", "most"])

    return per_tile(zone.unionByName(state), work, "state long, block long, most long")


def read_blocks(states: DataFrame, pairs: DataFrame, blocks: DataFrame, n_blocks: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, anchor_row, of, vec_id, row, score): the windows' best rows in the chosen blocks."""
    chunks = -(-n_blocks // CHUNK) or 1
    pairs = pairs.withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks)))
    cols = ["label", "first_id", "lo", "hi", "n", "kind", "vec_ids", "row_ids", "labels", "m"]
    part = pairs.join(blocks, "block").select("state", "chunk", F.lit(1).alias("is_block"), "most", *cols, F.lit(None).cast(_WINDOW).alias("windows"))
    head = pairs.select("state", "chunk").distinct().join(states, "state").select(
        "state", "chunk", F.lit(0).alias("is_block"), F.lit(CEILING).cast("long").alias("most"),
        *(F.col(c) if c in _ANCHOR else F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in cols), "windows")
    units = part.unionByName(head).repartition("state", "chunk").sortWithinPartitions("state", "chunk", "is_block", F.desc("most"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = None
        for b in batches:
            for i in range(b.num_rows):  # a row is an anchor block or a candidate block
                row = b.slice(i, 1).to_pylist()[0]
                if not row["is_block"]:
                    if win is not None:
                        yield win.best()
                    win = Windows(row, k, same)
                else:
                    win.read(row)
        if win is not None:
            yield win.best()

    return units.mapInArrow(task, "anchor_id long, anchor_row long, of long, vec_id long, row long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """Each window's k best rows, ranked from 1."""
    rank = F.row_number().over(Window.partitionBy("anchor_row", "of").orderBy(F.desc("score"), "vec_id", "row"))
    return found.dropDuplicates(["anchor_row", "of", "row"]).withColumn("rank", rank).where(F.col("rank") <= k)


def with_windows(anchors: DataFrame, windows: DataFrame) -> DataFrame:
    """Anchor blocks with their anchors' windows (a bounded number for each anchor)."""
    each = anchors.select("state", "row_ids").mapInArrow(_unrolled, "state long, anchor int, anchor_row long")
    w = (windows.join(each, "anchor_row").groupBy("state")
         .agg(F.collect_list(F.struct("anchor", "of", "lo", "hi", "line", "line_id")).cast(_WINDOW).alias("windows")))
    return anchors.join(w, "state")


def _unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for state, blob in zip(b.column("state").to_pylist(), b.column("row_ids").to_pylist()):
            rows = np.frombuffer(blob, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), state)), pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(rows)],
                                             names=["state", "anchor", "anchor_row"])


def search(anchors: DataFrame, windows: DataFrame, blocks: DataFrame, zones: DataFrame, k: int, same: bool, nearest: int = NEAREST,
           report: list | None = None) -> DataFrame:
    """The k best rows of every window (anchor_row, of, lo, hi): two readings of the blocks."""
    n_states, n_blocks = anchors.count(), zones.count()
    open_windows = windows.withColumn("line", F.lit(FLOOR).cast("long")).withColumn("line_id", F.lit(NO_ID).cast("long"))
    states = cut(with_windows(anchors, open_windows), "hard-states")
    pairs = cut(choose(states, zones, n_states, n_blocks, k, same, nearest), "hard-near")
    first = cut(_best(read_blocks(states, pairs, blocks, n_blocks, k, same), k), "hard-first")
    line = first.where(F.col("rank") == k).select("anchor_row", "of", F.col("score").alias("line"), F.col("vec_id").alias("line_id"))
    raised = windows.join(line, ["anchor_row", "of"], "left").withColumn(
        "line", F.coalesce("line", F.lit(FLOOR).cast("long"))).withColumn("line_id", F.coalesce("line_id", F.lit(NO_ID).cast("long")))
    states = cut(with_windows(anchors, raised), "hard-states")
    rest = cut(choose(states, zones, n_states, n_blocks, k, same, None).join(pairs.select("state", "block"), ["state", "block"], "left_anti"), "hard-rest")
    if report is not None:
        report.append((pairs.count() + rest.count(), n_states * n_blocks))
    return cut(_best(read_blocks(states, rest, blocks, n_blocks, k, same).unionByName(first.drop("rank")), k), "hard-found")


def mine(vectors: DataFrame, is_anchor: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
         high: int = HIGH, block: int = BLOCK, anchor_block: int = ANCHORS, nearest: int = NEAREST, id_col: str = "vec_id",
         vec_col: str = "embedding", label_col: str = "label", report: list | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    ``is_anchor`` is a condition on vec_id; low and high are percent of the positive's
    score.  ``report`` receives (blocks read, blocks times anchor blocks) of either search."""
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vec"))
    rows = cut(integers(slim, scale).withColumn("row", F.monotonically_increasing_id())
               .withColumn("anchor", F.coalesce(is_anchor, F.lit(False)) & F.col("vec_id").isNotNull())
               .withColumn("vec_id", F.coalesce("vec_id", F.lit(NO_ID))), "hard-rows")
    rows = cut(placed(rows), "hard-placed")
    blocks = cut(blocked(rows, block, True), "hard-blocks")
    zones = blocks.select("block", "label", "first_id", "lo", "hi")
    anchors = cut(blocked(rows.where("anchor"), anchor_block, False), "hard-anchors").select(F.col("block").alias("state"), *_ANCHOR)

    all_rows = rows.where("anchor").select(F.col("row").alias("anchor_row"), F.lit(0).cast("long").alias("of"),
                                           F.lit(FLOOR).cast("long").alias("lo"), F.lit(CEILING).cast("long").alias("hi"))
    best = search(anchors, all_rows, blocks, zones, positives, True, nearest, report)
    pos = best.select("anchor_id", "anchor_row", F.col("row").alias("of"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # whole numbers from low to high percent of the positive's score
    floor = lambda x: F.expr(f"({x} - pmod({x}, 100)) div 100")
    score = "cast(positive_score as decimal(20, 0))"  # its percent may pass 64 bits
    ends = [(-floor(f"(-{low} * {score})")).alias("lo"), floor(f"({high} * {score})").alias("hi")]
    windows = pos.select("anchor_row", "of", *ends).where("lo <= hi")
    found = search(anchors, windows, blocks, zones, negatives, False, nearest, report)
    blank = lambda c, name: F.when(F.col(c) != NO_ID, F.col(c)).alias(name)
    out = (found.select("anchor_row", "of", F.col("vec_id").alias("neg"), "rank", F.col("score").alias("negative_score")).join(pos, ["anchor_row", "of"])
           .select("anchor_id", blank("positive_id", "positive_id"), F.col("rank").cast("int").alias("rank"), blank("neg", "negative_id"),
                   "positive_score", "negative_score"))
    forget(rows)
    return out


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", "embedding", noisy.alias("label")), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""
