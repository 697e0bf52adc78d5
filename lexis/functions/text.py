"""Text cleaning, tokenisation and line splitting as native Column expressions.

All patterns are written in the regex subset shared by Java (Spark) and RE2 so
the same constant can be rendered for the DuckDB oracle.  Replacement strings
use ``$n`` group references (Java style).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Character classes (Python ``str`` semantics reproduced explicitly, because
# Java's ``\s``/``\w`` and RE2's differ from Python's Unicode-aware ones).
# ---------------------------------------------------------------------------

# Characters for which Python's str.isspace() is true.
WS = (r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
# Python's Unicode \w: letters, numbers and underscore (marks are excluded).
WORD = r"\p{L}\p{N}_"
# Line boundaries of str.splitlines().
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
# Universal newlines used when a text file is opened in text mode.
UNIVERSAL_NEWLINE = r"\r\n|[\n\r]"

# Non-printable, non-space characters removed by the line cleaner:
# Cc except whitespace, Cf, Co, and unassigned code points (Cn).  (Cs cannot
# occur in valid strings.)  RE2 knows no Cn, so the oracle's pattern leaves it out.
NON_PRINTABLE_RE2 = r"[\p{Cf}\p{Co}\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f]"
NON_PRINTABLE = NON_PRINTABLE_RE2[:-1] + r"\p{Cn}]"

STRIP = rf"\A[{WS}]+|[{WS}]+\z"

# Folder-normaliser cleaning chain, applied in this order.
PAGE_NUMBER = r"\n\p{Nd}+\n"
CHAPTER_MARKER = "Capítulo"
URL = rf"http[^{WS}]+"
NON_WORD = rf"[^{WORD}{WS}]"
WS_RUN = rf"[{WS}]+"

# Word tokenizer: Treebank-style punctuation splitting.  Only token
# boundaries matter, because tokens that are not purely alphanumeric are
# dropped afterwards.  (pattern, replacement), applied in order.
TOKENIZE_RULES: list[tuple[str, str]] = [
    # punctuation marks, double dashes and ellipses become separators
    # (independent replacements, so one alternation pass is exact)
    (r"[;@#$%&?!*\"“”«»‘’„`(){}<>\[\]]|--|\.{2,}", " "),
    (r"([:,])([^0-9])", " $2"),
    (r"[:,]\z", " "),
    (rf"([^.])\.(['{WS}]|\z)", "$1 $2"),
    (rf"(?i)([^' ])('s|'m|'d|'ll|'re|'ve|n't|')([{WS}]|\z)", "$1 $2 $3"),
]
# Words that are two tokens (and the apostrophe forms d'ye,
# more'n, 'tis, 'twas).  A boundary character is consumed, so a rule runs twice to
# catch neighbours; texts without any of the words skip the passes.
CONTRACTED = r"(?i)cannot|gimme|gonna|gotta|lemme|wanna|d'ye|more'n|'tis|'twas"
CONTRACTION_RULES: list[tuple[str, str]] = 2 * [
    (rf"(?i)(\A|[^{WORD}])(?:(can)(not)|(gim)(me)|(gon)(na))([^{WORD}]|\z)", "$1$2$4$6 $3$5$7$8"),
    (rf"(?i)(\A|[^{WORD}])(?:(got)(ta)|(lem)(me))([^{WORD}]|\z)", "$1$2$4 $3$5$6"),
    (rf"(?i)(\A|[^{WORD}])(?:(d)('ye)|(more)('n))([^{WORD}]|\z)", "$1$2$4 $3$5$6"),
    (rf"(?i)(\A|[^{WORD}])(wan)(na)([{WS}]|\z)", "$1$2 $3$4"),
    (rf"(?i)(\A|[{WS}])('t)(is|was)([^{WORD}]|\z)", "$1$2 $3$4"),
]
ALNUM_TOKEN = r"^[\p{L}\p{N}]+$"
# Whitespace other than the ASCII space.
OTHER_WS = (r"[\t-\r\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# The tokenizer rules once all whitespace is a plain space (same matches).
SPACE_TOKENIZE_RULES = [(p.replace(WS, " "), r) for p, r in TOKENIZE_RULES]
# A space-delimited token holding a character that is not a letter or number,
# matched with the space before it: a match can only start at a token
# boundary and the alphanumeric prefix never backtracks far (linear time).
SPACE_NON_ALNUM_TOKEN = r"(\A| )[\p{L}\p{N}]*[^\p{L}\p{N} ][^ ]*"
ALPHA_TOKEN = r"^\p{L}+$"
# Vectoriser token pattern: maximal runs of two or more word characters.
TERM = rf"[{WORD}]{{2,}}"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------------------
# Line handling
# ---------------------------------------------------------------------------

def split_lines(col, boundary: str = LINE_BREAK) -> Column:
    """str.splitlines(): split on line boundaries, no trailing empty piece."""
    parts = F.split(_c(col), boundary, -1)
    n = F.size(parts)
    last_empty = F.element_at(parts, -1) == F.lit("")
    return F.slice(parts, 1, n - F.when(last_empty, 1).otherwise(0))


def count_lines(col) -> Column:
    """Number of physical lines under universal newlines (blank lines count)."""
    return F.size(split_lines(col, UNIVERSAL_NEWLINE)).cast("bigint")


# ---------------------------------------------------------------------------
# Line cleaner
# ---------------------------------------------------------------------------

def py_strip(col) -> Column:
    """Python str.strip() (Unicode whitespace at both ends)."""
    return F.regexp_replace(_c(col), STRIP, "")


def remove_non_printable(col) -> Column:
    return F.regexp_replace(_c(col), NON_PRINTABLE, "")


def clean_line(col) -> Column:
    """Drop non-printable characters, then strip."""
    return py_strip(remove_non_printable(col))


# ---------------------------------------------------------------------------
# Folder normaliser cleaning chain
# ---------------------------------------------------------------------------

def strip_page_numbers(col) -> Column:
    return F.regexp_replace(_c(col), PAGE_NUMBER, " ")


def strip_headers(col, marker: str = CHAPTER_MARKER) -> Column:
    # (?d): only \n terminates a line, as in Python's re; (?m): ^ after \n.
    return F.regexp_replace(_c(col), rf"(?md)^.*?{marker}.*?\n", "")


def strip_urls(col) -> Column:
    return F.regexp_replace(_c(col), URL, "")


def strip_symbols(col) -> Column:
    return F.regexp_replace(_c(col), NON_WORD, " ")


def collapse_ws(col) -> Column:
    return py_strip(F.regexp_replace(_c(col), WS_RUN, " "))


def clean_text(col, marker: str = CHAPTER_MARKER) -> Column:
    """Page numbers -> headers -> URLs -> symbols -> whitespace.

    After the two line-sensitive steps every whitespace character is mapped
    to a space (1:1); the remaining steps treat all whitespace alike, so the
    result is the same while the patterns become plain-space ones.
    """
    c = to_spaces(strip_headers(strip_page_numbers(col), marker))
    c = F.regexp_replace(c, "http[^ ]+", "")
    c = F.regexp_replace(c, rf"[^{WORD} ]", " ")
    return F.trim(F.regexp_replace(c, " {2,}", " "))


# ---------------------------------------------------------------------------
# Tokenizer
# ---------------------------------------------------------------------------

def word_split(col) -> Column:
    """Apply the punctuation rules and split on whitespace (array<string>)."""
    c = _c(col)
    for pattern, repl in TOKENIZE_RULES + CONTRACTION_RULES:
        c = F.regexp_replace(c, pattern, repl)
    return F.split(c, WS_RUN, -1)


def word_tokens(col) -> Column:
    """Lower-cased alphanumeric word tokens, in order."""
    toks = F.filter(word_split(col), lambda t: t.rlike(ALNUM_TOKEN))
    return F.transform(toks, lambda t: F.lower(t))


def to_spaces(col) -> Column:
    """Every Python whitespace character -> one ASCII space (1:1, so all
    positions are kept).  Later patterns can then use a literal space, which
    Java matches far faster than the full whitespace class."""
    return F.regexp_replace(_c(col), OTHER_WS, " ")


def preprocess_text(col) -> Column:
    """Tokenise, keep all-alphanumeric tokens, lower-case, join by one space.

    Same result as ``array_join(word_tokens(col), ' ')`` but as whole-string
    passes (no per-token lambdas): whitespace -> space, punctuation rules,
    drop every token holding a non-alphanumeric character, squeeze spaces,
    lower-case once.
    """
    c = to_spaces(col)
    for pattern, repl in SPACE_TOKENIZE_RULES:
        c = F.regexp_replace(c, pattern, repl)
    two = c
    for pattern, repl in CONTRACTION_RULES:
        two = F.regexp_replace(two, pattern.replace(WS, " "), repl)
    c = F.when(_c(col).rlike(CONTRACTED), two).otherwise(c)
    c = F.regexp_replace(c, SPACE_NON_ALNUM_TOKEN, "$1")
    return F.lower(F.trim(F.regexp_replace(c, " {2,}", " ")))


def non_blank(col) -> Column:
    """True when the text has a non-whitespace character (str.strip() != '')."""
    return _c(col).rlike(f"[^{WS}]")


def term_tokens(col, lowercase: bool = True) -> Column:
    """Vectoriser tokens: lower-case, runs of >= 2 word characters.
    ``lowercase=False`` skips the lower-casing pass for text that is already
    lower case (the store's preprocessed content)."""
    c = F.lower(_c(col)) if lowercase else _c(col)
    return F.regexp_extract_all(c, F.lit(TERM), F.lit(0))
