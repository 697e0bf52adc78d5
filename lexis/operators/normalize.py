"""Linguistic normalisation (T5-T9): alphabetic filter, stop words, lexicon
lemmas, and the folder job that chains routing, cleaning and normalisation.

Everything is array work inside a row, with the stop list and the lexicon as
constants of the expression; a lexicon that is a large table is joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexis.functions.text import ALPHA_TOKEN, clean_text, to_spaces
from lexis.session import once

# Default Portuguese stop list (function words), lower case.
PORTUGUESE_STOP_WORDS = """
a à ao aos aquela aquelas aquele aqueles aquilo as às até com como da das de dela delas
dele deles depois do dos e é ela elas ele eles em entre era eram essa essas esse esses
esta está estamos estão estas estava estavam este estes eu foi fomos for foram fosse há
isso isto já lhe lhes mais mas me mesmo meu meus minha minhas muito na não nas nem no
nos nós nossa nossas nosso nossos num numa o os ou para pela pelas pelo pelos por qual
quando que quem se seja sem ser seu seus só sua suas também te tem têm tinha tu tua tuas
um uma umas uns você vocês vos
""".split()

# A small default lexicon (language, surface form, lemma) used
# when no lexicon is given; deployments pass their own.
DEFAULT_LEXICON = [
    ("pt", "são", "ser"), ("pt", "é", "ser"), ("pt", "foi", "ser"), ("pt", "era", "ser"),
    ("pt", "tem", "ter"), ("pt", "tinha", "ter"), ("pt", "teve", "ter"),
    ("fr", "est", "être"), ("fr", "sont", "être"), ("fr", "était", "être"),
    ("fr", "les", "le"), ("fr", "la", "le"), ("fr", "des", "de"), ("fr", "du", "de"),
    ("en", "is", "be"), ("en", "are", "be"), ("en", "was", "be"), ("en", "were", "be"),
    ("en", "has", "have"), ("en", "had", "have"),
    ("de", "ist", "sein"), ("de", "sind", "sein"), ("de", "war", "sein"),
    ("de", "die", "der"), ("de", "das", "der"), ("de", "den", "der"), ("de", "dem", "der"),
    ("es", "es", "ser"), ("es", "son", "ser"), ("es", "fue", "ser"),
    ("es", "los", "el"), ("es", "las", "el"),
]


def alpha_tokens(text: Column) -> Column:
    """Whitespace tokens made only of letters, in order."""
    return F.filter(F.split(to_spaces(text), " ", -1), lambda t: t.rlike(ALPHA_TOKEN))


def drop_stopwords(tokens: Column, stop: Sequence[str]) -> Column:
    words = sorted({w.lower() for w in stop})
    return F.filter(tokens, lambda t: ~F.lower(t).isin(words)) if words else tokens


def one_lemma(lexicon: Iterable[tuple[str, str, str]]) -> dict[tuple[str, str], str]:
    """A lexicon with one lemma a (language, surface): the first in order."""
    out: dict[tuple[str, str], str] = {}
    for lang, surface, lemma in sorted(lexicon):
        out.setdefault((lang, surface), lemma)
    return out


def lemmatize(tokens: Column, lexicon: Iterable[tuple[str, str, str]], lang: Column) -> Column:
    """Lower-cased lemmas; a token without an entry in its language is itself."""
    pairs = one_lemma(lexicon)
    if not pairs:
        return F.transform(tokens, lambda t: F.lower(t))
    table = F.create_map(*[F.lit(x) for (la, s), v in pairs.items() for x in (f"{la} {s}", v.lower())])
    return F.transform(tokens, lambda t: F.coalesce(
        F.element_at(table, F.concat(lang, F.lit(" "), F.lower(t))), F.lower(t)))


def normalize(text: Column, stop: Sequence[str] | None, lexicon, lang: Column) -> Column:
    """Alphabetic tokens, stop words removed, lemmatised, lower case, joined by
    single spaces in original order.  Row-local: no shuffle, one document a row."""
    tokens = alpha_tokens(text)
    if stop is not None:
        tokens = drop_stopwords(tokens, stop)
    return F.array_join(lemmatize(tokens, lexicon or (), F.coalesce(lang, F.lit(""))), " ")


def normalize_text(docs: DataFrame, key: str, text_col: str, stop: Sequence[str] | None,
                   lexicon, lang_col: str | None = None, text_fn=None) -> DataFrame:
    """(key, text).  ``lexicon`` is a list of (language, surface, lemma), looked
    up in each row's language; ``text_fn`` (e.g. clean_text) is applied first."""
    text = F.col(text_col) if text_fn is None else text_fn(F.col(text_col))
    lang = F.col(lang_col) if lang_col else F.lit("")
    return docs.select(key, normalize(text, stop, lexicon, lang).alias("text"))


def normalize_with_table(docs: DataFrame, key: str, text_col: str, stop: Sequence[str] | None,
                         lexicon: DataFrame, lang_col: str) -> DataFrame:
    """``normalize_text`` for a lexicon too large for an expression: a table
    (lang, surface, lemma), reduced to one lemma (the smallest) a surface.

    The distinct words of all documents are joined to it first, which leaves the entries that occur and
    change a word; these go to each row's distinct words, whose lemmas come back as a map.  Rows
    are told apart by a number of their own, so ids may repeat or be null.
    """
    lower = lambda t: F.lower(t)
    table = (lexicon.select(F.coalesce("lang", F.lit("")).alias("lang"), "surface", "lemma")
             .groupBy("lang", "surface").agg(F.min("lemma").alias("lemma")))
    tokens = alpha_tokens(F.col(text_col))
    if stop is not None:
        tokens = drop_stopwords(tokens, stop)
    rows = once(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"),
                            F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), tokens.alias("_tokens")), "tokens")
    words = rows.select("_row", "lang", F.explode(F.array_distinct(F.transform("_tokens", lower))).alias("surface"))
    known = once(words.select("lang", "surface").distinct().join(table, ["lang", "surface"])
                 .select("lang", "surface", F.lower("lemma").alias("lemma")).where("lemma <> surface"), "lemmas")
    maps = words.join(known, ["lang", "surface"]).groupBy("_row").agg(
        F.map_from_entries(F.collect_list(F.struct("surface", "lemma"))).alias("_map"))
    lemma = lambda t: F.coalesce(F.element_at("_map", F.lower(t)), F.lower(t))
    return rows.join(maps, "_row", "left").select(
        F.col("_key").alias(key), F.array_join(F.transform("_tokens", lemma), " ").alias("text"))


def preprocess_files(files: DataFrame, stop: Sequence[str], lexicon) -> DataFrame:
    """Folder job over routed files (path, output_filename, text, lang):
    (output_filename, path, text), each file cleaned and normalised by itself.
    Where several files have one output name the greatest path's stays, as the
    last file written would; only that choice is a shuffle (pre-aggregated)."""
    done = files.select("output_filename", "path", normalize(
        clean_text(F.col("text")), stop, lexicon, F.col("lang")).alias("text"))
    last = done.groupBy("output_filename").agg(F.max_by(F.struct("path", "text"), "path").alias("_f"))
    return last.select("output_filename", F.col("_f.path").alias("path"), F.col("_f.text").alias("text"))
