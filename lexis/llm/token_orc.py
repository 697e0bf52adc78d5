"""Token ids as ORC files.

Texts are range-partitioned by document id, encoded in order and written as
ORC: an ``array<int>`` column (integer run-length encoding), a row index every
``row_index_stride`` rows and a Bloom filter on ``doc_id``.  Spark reads the
files stripe by stripe in parallel; ``lookup`` filters by id, which the reader
answers from stripe statistics, row indexes and Bloom filters.  A side table
holds the number of tokens before each file, so a document's global position
is its position in the file plus one small addition, without a global window.

Rows are in ascending doc_id order, nulls first; rows that share an id are
ordered by a hash of their text.  Null text counts as empty (the end id alone).
An empty table gives an empty table.  Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexis.llm.common import doc_hash, entering, give_back, scratch, slices
from lexis.llm.tokens import END_ID, encoder, public_path


def write_orc(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
              id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 64 << 20,
              row_index_stride: int = 10_000, bloom_fpp: float = 0.01) -> None:
    """Write ``path/data`` (ORC) and ``path/offsets`` (a row per file)."""
    tokens = tokenizer or public_path("word_bpe_49k.json")
    id_type = docs.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("tokens")
        enc, part, before = encoder(tokens), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                ids, ends = enc.encode(texts[lo:hi], end_id)
                upto = np.concatenate([[0], ends])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)),
                    pa.array(before + upto[:-1]), pa.array(np.diff(upto)),
                    pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids.astype(np.int32)))],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"])
                before += int(ends[-1])
        give_back()

    spark = docs.sparkSession
    # the last key only splits a crowd of rows equal in id and text
    (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
     .withColumn("h", doc_hash()).withColumn("n", F.monotonically_increasing_id())
     .repartitionByRange(F.col("doc_id").asc_nulls_first(), "h", "n")
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "n")
     .select("doc_id", "text")
     .mapInArrow(task, f"doc_id {id_type}, part int, local_start long, n_tokens long, ids array<int>")
     .write.option("compression", "zstd").option("orc.stripe.size", str(stripe_bytes))
     .option("orc.row.index.stride", str(row_index_stride))
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(bloom_fpp))
     .orc(f"{path}/data"))
    per_file = spark.read.orc(f"{path}/data").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per written file: the window's single partition holds file counts, never documents
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    per_file.select("part", F.coalesce(before, F.lit(0)).alias("before")).write.orc(f"{path}/offsets")


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids."""
    rows, offsets = spark.read.orc(f"{path}/data"), spark.read.orc(f"{path}/offsets")
    # a row per file of the data: as small as a file listing
    return (rows.join(F.broadcast(offsets), "part")
            .select("doc_id", (F.col("local_start") + F.col("before")).alias("start"), "n_tokens", "ids"))


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The documents with these ids; other stripes and row groups are pruned."""
    return read_orc(spark, path).where(F.col("doc_id").isin(list(doc_ids)))


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (over little-endian unsigned 32-bit ids)."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            raw = memoryview(np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), "<u4")).cast("B")
            upto = np.concatenate([[0], np.cumsum(b.column("n_tokens").to_numpy())]) * 4
            crc = [zlib.crc32(raw[upto[i]:upto[i + 1]]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(task, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def op5_token_orc(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-orc")
    write_orc(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return digest(read_orc(spark, path))
