"""Line documents, the document store and its id assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexis.functions.text import non_blank, preprocess_text, split_lines
from lexis.session import checkpoint_root, once, read_if_written

DOC_KEYS = ("doc_id", "line_no")


def line_documents(documents: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line): one row per line (str.splitlines boundaries)."""
    return (documents.select(F.col(id_col).alias("doc_id"),
                             F.posexplode(split_lines(text_col)).alias("line_no", "line"))
                     .withColumn("line_no", F.col("line_no").cast("bigint")))


PAIR_LINES = 64  # lines that a row of ``line_pairs`` moves together


def line_pairs(documents: DataFrame) -> DataFrame:
    """(doc_id, part, line_no, content, next_line, _next): each stored line with the one
    after it.  Raw lines move in parts of PAIR_LINES and one more, so a long document is spread, and
    are tokenised after that, once each; partitioned by (doc_id, part)."""
    numbered = F.transform(split_lines("text"), lambda line, i: F.struct(
        i.cast("bigint").alias("line_no"), line.alias("line")))
    kept = documents.select("doc_id", F.filter(numbered, lambda s: non_blank(s["line"])).alias("lines"))
    starts = F.when(F.size("lines") > 1, F.sequence(F.lit(1), F.size("lines") - 1, F.lit(PAIR_LINES)))
    parts = (kept.select("doc_id", "lines", F.explode(starts).alias("part"))
             .select("doc_id", "part", F.slice("lines", F.col("part"), PAIR_LINES + 1).alias("lines"))
             .repartition("doc_id", "part"))
    lines = (parts.select("doc_id", "part", F.explode("lines").alias("l"))
             .select("doc_id", "part", F.col("l.line_no").alias("line_no"), preprocess_text("l.line").alias("content")))
    after = Window.partitionBy("doc_id", "part").orderBy("line_no")
    return lines.select("*", F.lead("line_no").over(after).alias("next_line"),
                        F.lead("content").over(after).alias("_next")).where("next_line is not null")


def process_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Strip, drop blank lines, tokenise: the store's ``content``.

    A line of pure punctuation is kept as an empty document.  (Stripping
    before tokenising cannot change the tokens, so only blankness is tested.)
    """
    return lines.filter(non_blank(line_col)) \
                .withColumn("content", preprocess_text(line_col)).drop(line_col)


def build_store(documents: DataFrame, id_col: str = "doc_id",
                text_col: str = "text", ordered: bool = False) -> DataFrame:
    """(doc_id, line_no, content), partitioned by the line key.

    Lines are split where the documents are read; the one shuffle moves raw
    line text, hash-partitioned by (doc_id, line_no), so a huge document is
    spread over many tasks.  Every later per-line, per-(line, term) or
    per-(question, line) aggregation is partition-local because its keys
    contain the line key.  ``ordered=True`` range-partitions by the line key
    instead, so partitions follow store order and ids can be assigned
    without a second shuffle (see ``assign_ids(partitioned=True)``).
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lines = line_documents(docs)
    if ordered:
        lines = lines.repartitionByRange(id_partitions(documents), "doc_id", "line_no")
    else:
        lines = lines.repartition("doc_id", "line_no")
    return process_lines(lines)


# ---------------------------------------------------------------------------
# Store ids (S10): id = start + position in a total order, computed without a
# global window: range partition + local positions + per-partition offsets.
# ---------------------------------------------------------------------------

_LOCAL_BITS = 33  # monotonically_increasing_id(): partition index << 33 | row


def id_partitions(df: DataFrame) -> int:
    """Partition count for the range shuffle of id assignment."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def assign_ids(df: DataFrame, order_cols: Sequence[str], start=0,
               id_col: str = "id", partitioned: bool = False) -> DataFrame:
    """Consecutive ids ``start + 1 ..`` following ``order_cols`` (must be unique).

    ``partitioned=True`` when ``df`` is already range-partitioned by
    ``order_cols`` (e.g. ``build_store(ordered=True)``): no shuffle then.
    The per-partition count table has one row per partition, so the offset
    window runs over (#partitions) rows, never over the data.
    """
    src = df if partitioned else df.repartitionByRange(id_partitions(df), *order_cols)
    ordered = (src.sortWithinPartitions(*order_cols)
                  .withColumn("_mid", F.monotonically_increasing_id()))
    # The rows are needed twice (per-partition counts, then the rows): they
    # are materialised once in the shared checkpoint folder, so both uses
    # see the very same partitions even if a stage is recomputed.
    checkpoint_root(df.sparkSession)
    ordered = ordered.checkpoint(eager=True)
    ordered = ordered.withColumn("_part", F.shiftright("_mid", _LOCAL_BITS)) \
                     .withColumn("_pos", F.col("_mid") - F.shiftleft("_part", _LOCAL_BITS))
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_part")
                                            .rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    start_col = start if hasattr(start, "alias") else F.lit(start)
    return (ordered.join(F.broadcast(offsets.select("_part", "_off")), "_part")
                   .withColumn(id_col, (start_col + F.col("_off") + F.col("_pos") + 1)
                               .cast("bigint"))
                   .drop("_mid", "_part", "_pos", "_off"))


CHUNK_LINES = 1024  # lines that are numbered together


def number_lines(lines: DataFrame, start: int = 0) -> tuple[DataFrame, DataFrame]:
    """(``lines`` where ``kept``, with ids ``start + 1 ..`` in the order of path, block, seq and pos; their chunks).

    A chunk is CHUNK_LINES physical lines of a block.  Chunks are counted where the lines are read, and the window over
    all of them has a row a chunk: (path, block, chunk, kept, physical, first).  Lines are shuffled once, by
    chunk, so a large file is spread.  ``lines`` is read twice and must be a written table."""
    at = lines.withColumn("chunk", F.floor(F.col("seq") / CHUNK_LINES))
    counts = at.groupBy("path", "block", "chunk").agg(F.count_if("kept").alias("kept"), F.count_if(F.col("pos") == 0).alias("physical"))
    before = Window.orderBy("path", "block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = once(counts.withColumn("first", F.coalesce(F.sum("kept").over(before), F.lit(0)) + start), "chunks")
    own = Window.partitionBy("path", "block", "chunk").orderBy("seq", "pos")
    rows = (at.where("kept").withColumn("_n", F.row_number().over(own))
            .join(chunks.select("path", "block", "chunk", "first"), ["path", "block", "chunk"]))
    return rows.withColumn("id", (F.col("first") + F.col("_n")).cast("bigint")).drop("chunk", "first", "kept", "_n"), chunks


def next_ids(store: DataFrame, new_docs: DataFrame, order_cols: Sequence[str]) -> DataFrame:
    """Ids for appended documents: current max id + position in insert order."""
    current = store.agg(F.max("id")).first()[0] or 0  # one scalar
    return assign_ids(new_docs, order_cols, start=int(current))


def append_documents(spark: SparkSession, store_path: str, new_docs: DataFrame,
                     order_cols: Sequence[str], batch_id: int | None = None) -> int:
    """Append processed documents to the Parquet store, ids continuing max+1.

    With ``batch_id`` the rows land in partition ``batch=<id>`` written with
    dynamic partition overwrite, so a replayed micro-batch replaces itself.
    """
    store = read_if_written(spark, store_path)
    if store is not None and batch_id is not None and "batch" in store.columns:
        store = store.filter(F.col("batch") != batch_id)
    if store is None:
        out = assign_ids(new_docs, order_cols)
    else:
        out = next_ids(store.select("id"), new_docs, order_cols)
    out = out.select("id", "content", *[c for c in order_cols if c != "id"])
    if batch_id is None:
        out.write.mode("append").parquet(store_path)
    else:
        (out.withColumn("batch", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch").parquet(store_path))
    return spark.read.parquet(store_path).count()
