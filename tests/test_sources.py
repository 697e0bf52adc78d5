"""File sources and sinks: catalog, whole-file and line readers, per-file sink,
progress from a live stream."""

import os

import pytest

from lexis.sources.named_files import write_per_file
from lexis.sources import files as SF


def test_catalog_and_missing_folder(spark, scratch):
    for name in ("a.txt", "b.txt", "c.csv"):
        with open(os.path.join(scratch, name), "w") as f:
            f.write("x\n")
    got = sorted(os.path.basename(r["path"]) for r in SF.dataset_catalog(spark, scratch).collect())
    assert got == ["a.txt", "b.txt"]
    assert SF.dataset_catalog(spark, os.path.join(scratch, "nope")).count() == 0


def test_whole_files_and_lines(spark, scratch):
    with open(os.path.join(scratch, "d.txt"), "w", encoding="utf-8") as f:
        f.write("first\u2028second\n\nthird\n")
    whole = SF.read_whole_files(spark, scratch).collect()
    assert [r["text"] for r in whole] == ["first\u2028second\n\nthird\n"]
    lines = SF.read_line_corpus(spark, scratch).orderBy("line_no").collect()  # line_no ascends in reading order
    assert [r["line"] for r in lines] == "first\u2028second\n\nthird\n".splitlines()


def test_route_and_per_file_sink(spark, scratch):
    files = spark.createDataFrame([("in/a.pdf",), ("in/b.txt",), ("in/c.md",)], "path string")
    routed = {r["name"]: r["output_filename"] for r in SF.route_files(files).collect()}
    assert routed == {"a.pdf": "processed_a.txt", "b.txt": "processed_b.txt"}
    out = os.path.join(scratch, "out")
    df = spark.createDataFrame([("processed_a.txt", "alpha"), ("processed_b.txt", "beta")],
                               "output_filename string, text string")
    write_per_file(df, out, "output_filename", "text")
    assert {n: open(os.path.join(out, n)).read() for n in os.listdir(out)} == {"processed_a.txt": "alpha", "processed_b.txt": "beta"}


def test_one_file_a_row(spark, scratch):
    out = os.path.join(scratch, "out")
    names = "name string, text string"
    rows = [(f"d{i % 3}/f{i}.txt", f"täxt {i}\n" if i % 4 else None) for i in range(50)]
    write_per_file(spark.createDataFrame(rows, names).repartition(7), out, "name", "text")
    found = {os.path.relpath(os.path.join(d, f), out) for d, _, fs in os.walk(out) for f in fs}
    assert found == {n for n, _ in rows} and not any(x.startswith("_") for x in os.listdir(out))
    assert open(os.path.join(out, "d1/f1.txt"), encoding="utf-8").read() == "täxt 1\n" and os.path.getsize(os.path.join(out, "d1/f4.txt")) == 0
    # written again: replaced; a failing task, two rows with a name, or a name outside leave nothing new
    write_per_file(spark.createDataFrame([("d1/f1.txt", "new")], names), out, "name", "text")
    assert open(os.path.join(out, "d1/f1.txt")).read() == "new"
    for bad in ([("x.txt", "1"), ("y.txt", "1"), ("../z.txt", "2")], [("x.txt", "1"), ("y.txt", "2"), ("x.txt", "3")], [("x.txt", "1"), (None, "2")]):
        with pytest.raises(Exception):
            write_per_file(spark.createDataFrame(bad, names).repartition(3), out, "name", "text")
        assert {os.path.relpath(os.path.join(d, f), out) for d, _, fs in os.walk(out) for f in fs} == found


def test_assemble_pages_order(spark):
    pages = spark.createDataFrame([(1, 2, "two"), (1, 1, "one"), (2, 1, "solo")],
                                  "doc long, page long, text string")
    got = {r["doc"]: r["text"] for r in SF.assemble_pages(pages).collect()}
    assert got == {1: "one\ntwo\n", 2: "solo\n"}


def test_ordered_concat_many_chunks(spark):
    from pyspark.sql import functions as F
    rows = [(1, i, f"w{i}") for i in range(1, 30)] + [(2, 0, None)]
    df = spark.createDataFrame(rows, "k long, pos long, v string")
    got = {r["k"]: r["text"] for r in SF.ordered_concat(df, "k", "pos", F.col("v"), " ", chunk=4).collect()}
    assert got == {1: " ".join(f"w{i}" for i in range(1, 30)), 2: ""}
