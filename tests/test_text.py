"""Edge rows for cleaning, line splitting and tokenisation (FIXTURES §3)."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexis.functions import text as T
from lexis.operators import cleaning as C
from lexis.operators.store import line_documents, process_lines
from tests.conftest import one_col


def _apply(spark, fn, values):
    df = one_col(spark, values).select(fn(F.col("t")).alias("r"))
    return [r["r"] for r in df.collect()]


def test_clean_line_edges(spark):
    raw = "  a\u200bb\x00c\td\x1ce\x85f\ufeffgh\u2028i\xadj \x1f"
    assert _apply(spark, T.clean_line, [raw]) == ["abc\td\x1ce\x85fgh\u2028ij"]


def test_clean_lines_drops_blank(spark):
    lines = one_col(spark, ["\x07\x08", " \u3000 ", "ok"], "line")
    assert [r["line"] for r in C.clean_lines(lines).collect()] == ["ok"]


def test_page_numbers_non_overlapping(spark):
    assert _apply(spark, T.strip_page_numbers, ["a\n1\n2\nb"]) == ["a 2\nb"]


def test_clean_text_edges(spark):
    cases = {
        "a\n1\n2\nb": "a 2 b",
        "x Cap\u00edtulo 1\ny\nCap\u00edtulo fim": "y Cap\u00edtulo fim",
        "l1\rCap\u00edtulo 2\nz": "z",
        "ver http://x.y/z?q=1, ok \u00e9_1 C++": "ver ok \u00e9_1 C",
        "e\u0301 x": "e x",
    }
    got = _apply(spark, T.clean_text, list(cases))
    assert got == list(cases.values())


def test_split_lines_like_python(spark):
    text = "a b\x0bc\x85d\r\ne\n"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [r["line"] for r in line_documents(df).orderBy("line_no").collect()]
    assert got == text.splitlines() == ["a", "b", "c", "d", "e"]


def test_count_lines_universal_newlines(spark):
    text = "a\n\nb\r\nc\rd"
    got = _apply(spark, T.count_lines, [text])
    assert got == [len(text.splitlines())]  # only \n, \r, \r\n occur here


def test_decode_repair(spark):
    df = spark.createDataFrame([(bytes([0x61, 0x62, 0xFF, 0x63]),)], "b binary")
    row = df.select(C.decode_utf8("b").alias("s"), C.utf8_valid("b").alias("v")).first()
    assert row["s"] == "ab�c" and row["v"] is False


def test_process_batch_keeps_punctuation_line(spark):
    df = spark.createDataFrame([(1, 0, "..."), (1, 1, "   "), (1, 2, "Hello, World!")],
                               "doc_id long, line_no long, line string")
    got = {r["line_no"]: r["content"] for r in process_lines(df).collect()}
    assert got == {0: "", 2: "hello world"}


def _py_preprocess(text: str) -> str:
    """Independent Python rendering of the tokenizer rules (standard re)."""
    ws = {ch for ch in map(chr, range(0x3001)) if ch.isspace()}
    t = "".join(" " if ch in ws else ch for ch in text)
    t = re.sub(r"[;@#$%&?!*\"“”«»‘’„`(){}<>\[\]]|--|\.{2,}", " ", t)
    t = re.sub(r"([:,])([^0-9])", r" \2", t)
    t = re.sub(r"[:,]\Z", " ", t)
    t = re.sub(r"([^.])\.([' ]|\Z)", r"\1 \2", t)
    t = re.sub(r"(?i)([^' ])('s|'m|'d|'ll|'re|'ve|n't|')( |\Z)", r"\1 \2 \3", t)
    return " ".join(w.lower() for w in t.split(" ") if w and w.isalnum())


def test_preprocess_examples(spark):
    cases = ["Don't stop: it's 10,000 C++ guarda-chuva.", "Hello world. Bye...", "x,y:z; (a) [b]"]
    got = _apply(spark, T.preprocess_text, cases)
    assert got == [_py_preprocess(c) for c in cases]
    assert got[0] == "do stop it"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab1é .,:;'-!?\"\tÉ_()")), max_size=30),
                min_size=1, max_size=8))
def test_preprocess_string_and_array_forms_agree(spark, texts):
    df = one_col(spark, texts).select(
        T.preprocess_text("t").alias("s"), F.array_join(T.word_tokens("t"), " ").alias("a"))
    for r, text in zip(df.collect(), texts):
        assert r["s"] == r["a"] == _py_preprocess(text)


def test_term_tokens_two_or_more_word_chars(spark):
    got = _apply(spark, T.term_tokens, ["A bc d_e f1 Ünï x"])
    assert got == [["bc", "d_e", "f1", "ünï"]]


def test_contractions_by_hand(spark):
    cases = {"I cannot go": "i can not go", "gonna, gotta wanna": "gon na got ta wan na", "Lemme! gimme?": "lem me gim me",
             "cannot cannot": "can not can not", "'Tis d'ye more'n": "is d more", "Ñcannot cannots": "ñcannot cannots",
             "wannabe wanna": "wannabe wan na"}
    assert _apply(spark, T.preprocess_text, list(cases)) == list(cases.values())


def test_unassigned_code_points_go(spark):
    assert _apply(spark, T.clean_line, ["a\u0378b\U000e0080c"]) == ["abc"]


def test_outcome_of_a_failed_pass(spark):
    lines = lambda: spark.read.text("/nonexistent/folder").withColumnRenamed("value", "line")
    row = C.run_outcome(lines, spark, "in.txt").first()
    assert row["success"] is False and "nonexistent" in row["error"] and row["output_file"] is None


def test_outcome_files(spark):
    ok = spark.createDataFrame([("a", False), ("", False)], "line string, repaired boolean")
    row = C.cleaning_outcome(ok, "in.txt").first()
    assert (row["output_file"], row["cleaned_lines"], row["total_lines"]) == ("in.txt", 1, 2)
    assert C.cleaning_outcome(ok, "in.txt", clean=False).first()["output_file"] == "in.txt.clean"


def test_folder_job_keeps_files_apart(spark):
    from lexis.operators import normalize as NZ
    files = spark.createDataFrame([("x/a.pdf", "processed_a.txt", "alpha one beta two", "en"),
                                   ("y/a.txt", "processed_a.txt", "gamma three four", "en")],
                                  "path string, output_filename string, text string, lang string")
    rows = NZ.preprocess_files(files, [], []).collect()
    assert [(r["path"], r["text"]) for r in rows] == [("y/a.txt", "gamma three four")]


def test_one_lemma_a_surface(spark):
    from lexis.operators import normalize as NZ
    lex = [("pt", "casas", "casar"), ("pt", "casas", "casa"), ("es", "casas", "x")]
    docs = spark.createDataFrame([(1, "Casas grandes", "pt"), (2, "Casas", "fr"), (3, "", "pt"), (4, None, "pt")],
                                 "doc_id long, text string, lang string")
    for out in (NZ.normalize_text(docs, "doc_id", "text", None, lex, "lang"),
                NZ.normalize_with_table(docs, "doc_id", "text", None,
                                        spark.createDataFrame(lex, "lang string, surface string, lemma string"), "lang")):
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        assert (got[1], got[2], got[3]) == ("casa grandes", "casas", "")


def test_table_lexicon_with_repeated_ids(spark):
    """Rows are told apart even where ids repeat or are null."""
    from lexis.operators import normalize as NZ
    lex = spark.createDataFrame([("pt", "casas", "casa"), ("es", "casas", "x"), ("", "dogs", "dog")], "lang string, surface string, lemma string")
    docs = spark.createDataFrame([(1, "Casas casas", "pt"), (1, "casas dogs", "es"), (None, "dogs casas", None), (None, "dogs", None), (1, "Casas casas", "pt")],
                                 "doc_id long, text string, lang string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in NZ.normalize_with_table(docs, "doc_id", "text", None, lex, "lang").collect())
    assert got == [(0, "dog"), (0, "dog casas"), (1, "casa casa"), (1, "casa casa"), (1, "x dogs")]
