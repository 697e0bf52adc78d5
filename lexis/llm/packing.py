"""Packing by power-of-two decomposition.

Every document's token ids (with an end id) are cut into pieces whose lengths
are powers of two: as many of ``max_len`` as fit, then the binary digits of the
rest, longest first.  Each piece is a sequence of its own, so no sequence
crosses documents and none needs padding.  Sequences of equal length form a
bucket (``write_buckets`` lays buckets out as folders), from which a trainer
draws batches.  The work is row-local: one scan, no shuffle.

Null text counts as empty (one piece: the end id).  Repeated rows are packed
once each.  An empty table gives no rows.  Only the id and text columns are
read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexis.llm.common import entering, give_back, slices
from lexis.llm.tokens import END_ID, encoder, public_path

MAX_LEN = 2048
TASK_BITS = 40  # sequence_id: the task's number, then its own running number


def piece_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """The powers of two a document of n tokens is cut into."""
    full, rest = divmod(n, max_len)
    return [max_len] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset (always 0)."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    path = tokenizer or public_path("byte_bpe_50k.json")
    id_type = docs.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("tokens")
        enc = encoder(path)
        number = TaskContext.get().partitionId() << TASK_BITS
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                ids, ends = enc.encode(texts[lo:hi], end_id)
                sizes = np.diff(ends, prepend=0)
                cuts = [piece_lengths(int(n), max_len) for n in sizes]
                of_doc = np.repeat(np.arange(hi - lo), [len(c) for c in cuts])
                length = np.array([x for c in cuts for x in c], np.int64)
                upto = np.concatenate([[0], np.cumsum(length)])
                start = upto[:-1] - (ends - sizes)[of_doc]
                raw = pa.Array.from_buffers(pa.binary(), len(length), [
                    None, pa.py_buffer((upto * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo).take(pa.array(of_doc)), pa.array(start), pa.array(length),
                    raw, pa.array(sizes[of_doc]), pa.array(number + np.arange(len(length))),
                    pa.array(np.zeros(len(length), np.int64))],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
                number += len(length)
        give_back()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        task, f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Parquet with a folder for each sequence length."""
    pieces.write.partitionBy("length").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
