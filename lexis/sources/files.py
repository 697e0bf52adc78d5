"""File-shaped inputs as DataFrames (S1, S4, S6-S8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.functions.text import split_lines

# Output naming of the folder normaliser.
PROCESSED_PREFIX = "processed_"

# Fixture convention used to give documents a file extension (a document's
# language decides its original format).
EXT_BY_LANG = {"en": ".txt", "fr": ".pdf", "de": ".txt", "es": ".html"}


def dataset_catalog(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """(path, length, modified): files in ``folder`` ending in ``suffix``.

    Only file metadata is read (the content column is pruned).  A missing
    folder yields an empty result, like the reference's empty list.
    """
    schema = "path string, length bigint, modified timestamp"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    df = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return df.select("path", F.col("length").cast("bigint").alias("length"),
                     F.col("modificationTime").alias("modified"))


def read_line_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Text files -> (path, line_no, line) with str.splitlines boundaries.

    Files are read by split, so one large file is many tasks.  ``line_no``
    ascends in reading order and is unique in the result; it is not a file's own
    line number (read_whole_files and line_documents give that).
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    parts = F.when(F.col("value") == "", F.array(F.lit(""))).otherwise(split_lines("value"))
    return (rows.select("path", F.explode(parts).alias("line"))
            .select("path", F.monotonically_increasing_id().alias("line_no"), "line"))


def read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per file, UTF-8 (S6)."""
    return (spark.read.text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def as_text_files(documents: DataFrame, ext_by_lang: dict | None = None) -> DataFrame:
    """Documents as (path, text, n_chars) file records, path = source/doc_id.ext."""
    if ext_by_lang:
        ext = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ext_by_lang.items()
                                                     for x in kv]), F.col("lang")), F.lit(".bin"))
    else:
        ext = F.lit(".txt")
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), ext)
    return documents.select(path.alias("path"), "text",
                            F.length("text").cast("bigint").alias("n_chars"))


def ordered_concat(df: DataFrame, key: str, order_col: str, value: Column, sep: str = "",
                   chunk: int = 4096) -> DataFrame:
    """(key, text): ``value`` strings of each key joined in ``order_col``
    order.  Two levels: first per (key, order // chunk), then per key, so a
    key holding a large share of all rows is concatenated by many tasks and
    the last step sorts only (rows / chunk) pieces.  That last step holds one
    key's whole string in one task, as a string value must."""
    part = (df.select(key, F.col(order_col).alias("_o"), value.alias("_v"))
              .groupBy(key, F.floor(F.col("_o") / chunk).alias("_c"))
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_v"))),
                                            lambda s: s["_v"]), sep).alias("_p")))
    whole = part.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_c", "_p"))).alias("_ps"))
    pieces = F.filter(F.transform("_ps", lambda s: s["_p"]), lambda p: p != "")
    return whole.select(key, F.array_join(pieces, sep).alias("text"))


def assemble_pages(pages: DataFrame, sep: str = "\n") -> DataFrame:
    """(doc, page, text) -> (doc, text): pages in order, ``sep`` after each."""
    return ordered_concat(pages, "doc", "page", F.concat(F.col("text"), F.lit(sep)))


def route_files(files: DataFrame, path_col: str = "path", carry=()) -> DataFrame:
    """(path, name, kind, output_filename, *carry): .pdf -> paged, .txt ->
    text, anything else skipped.  ``carry`` columns (e.g. the text) ride
    along, so routing never needs a join back to the files."""
    name = F.element_at(F.split(F.col(path_col), "/"), -1)
    kind = (F.when(name.endswith(".pdf"), F.lit("pdf"))
             .when(name.endswith(".txt"), F.lit("txt")))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    out = F.when(kind == "pdf", F.concat(F.lit(PROCESSED_PREFIX), stem, F.lit(".txt"))) \
           .otherwise(F.concat(F.lit(PROCESSED_PREFIX), name))
    return (files.select(F.col(path_col).alias("path"), name.alias("name"), kind.alias("kind"),
                         *carry)
                 .filter(F.col("kind").isNotNull())
                 .withColumn("output_filename", out))
