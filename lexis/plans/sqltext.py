"""Render the engine's fixed text patterns as DuckDB SQL expressions.

The oracle must compute the same values as the Spark operators from the same
constants, so every builder here mirrors one in ``lexis.functions.text``.
DuckDB regexes are RE2: same pattern text, ``\\n`` group references and the
``'g'`` flag for global replacement.
"""

from __future__ import annotations

import re

from lexis.functions import text as T


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _repl(r: str) -> str:
    return re.sub(r"\$(\d)", r"\\\1", r)


def rr(expr: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(_repl(repl))}, 'g')"


def strip(expr: str) -> str:
    return rr(expr, T.STRIP, "")


def clean_line(expr: str) -> str:
    return strip(rr(expr, T.NON_PRINTABLE_RE2, ""))


def split_lines(expr: str, boundary: str = T.LINE_BREAK) -> str:
    parts = f"string_split_regex({expr}, {q(boundary)})"
    return (f"(CASE WHEN {parts}[-1] = '' THEN {parts}[1:len({parts})-1] "
            f"ELSE {parts} END)")


def strip_page_numbers(expr: str) -> str:
    return rr(expr, T.PAGE_NUMBER, " ")


def strip_headers(expr: str, marker: str = T.CHAPTER_MARKER) -> str:
    return rr(expr, rf"(?m)^.*?{marker}.*?\n", "")


def strip_urls(expr: str) -> str:
    return rr(expr, T.URL, "")


def strip_symbols(expr: str) -> str:
    return rr(expr, T.NON_WORD, " ")


def collapse_ws(expr: str) -> str:
    return strip(rr(expr, T.WS_RUN, " "))


def clean_text(expr: str, marker: str = T.CHAPTER_MARKER) -> str:
    return collapse_ws(strip_symbols(strip_urls(strip_headers(strip_page_numbers(expr), marker))))


def word_split(expr: str) -> str:
    e = expr
    for pattern, repl in T.TOKENIZE_RULES:
        e = rr(e, pattern, repl)
    two = e
    for pattern, repl in T.CONTRACTION_RULES:
        two = rr(two, pattern, repl)
    e = f"(CASE WHEN regexp_matches({expr}, {q(T.CONTRACTED)}) THEN {two} ELSE {e} END)"
    return f"string_split_regex({e}, {q(T.WS_RUN)})"


def word_tokens(expr: str) -> str:
    toks = f"list_filter({word_split(expr)}, lambda t: regexp_matches(t, {q(T.ALNUM_TOKEN)}))"
    return f"list_transform({toks}, lambda t: lower(t))"


def preprocess_text(expr: str) -> str:
    return f"array_to_string({word_tokens(expr)}, ' ')"


def term_tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {q(T.TERM)}, 0)"


def feature_bucket(expr: str, num_features: int = 1 << 18) -> str:
    return f"CAST((('0x' || substr(md5({expr}), 1, 8))::BIGINT % {num_features}) AS INTEGER)"


def raw_cosine(dot: str, na: str, nb: str) -> str:
    return f"(CASE WHEN ({na}) * ({nb}) > 0 THEN ({dot}) / (({na}) * ({nb})) ELSE 0.0 END)"


def cosine(dot: str, na: str, nb: str, digits: int = 6) -> str:
    return f"round({raw_cosine(dot, na, nb)}, {digits})"


# ---------------------------------------------------------------------------
# HTML (mirrors lexis.functions.html)
# ---------------------------------------------------------------------------

from lexis.functions import html as H  # noqa: E402


def decode_entities(expr: str) -> str:
    e = expr
    for ent, ch in H.ENTITIES:
        e = f"replace({e}, {q(ent)}, {q(ch)})"
    body = "substr(r, 2)"
    code = (f"(CASE WHEN lower(r[1]) = 'x' THEN CAST('0x' || {body} AS BIGINT) ELSE CAST(r AS BIGINT) END)")
    good = f"({code} > 0 AND {code} < 1114112 AND {code} NOT BETWEEN 55296 AND 57343 AND {code} <> 38)"
    refs = f"list_distinct(regexp_extract_all({e}, {q(H.NUMERIC)}, 1))"
    e = (f"list_reduce({refs}, lambda t, r: CASE WHEN {good} THEN replace(t, '&#' || r || ';', "
         f"chr(CAST({code} AS INTEGER))) ELSE t END, {e})")
    return rr(e, H.AMP, "&")


def scan(expr: str) -> str:
    pattern = H.SCAN.replace("*+", "*").replace("?+", "?")
    clean = f"translate({expr}, chr(1), chr(65533))"
    return f"string_split(regexp_replace({clean}, {q(pattern)}, chr(1) || {q(chr(92) + '1')} || chr(1), 'g'), chr(1))"


def _place(nodes: str, tag: str) -> str:
    return f"coalesce(list_position(list_transform({nodes}, lambda n, i: i % 2 = 0 AND regexp_matches(n, {q(tag)})), true), 0)"


def _after(nodes: str, tag: str) -> str:
    at = _place(nodes, tag)
    return f"CASE WHEN {at} > 0 THEN ({nodes})[{at} + 1:] ELSE [] END"


def has_body(expr: str) -> str:
    return f"({_place(scan(expr), H.BODY_OPEN)} > 0)"


def body_nodes(expr: str) -> str:
    inner = f"({_after(scan(expr), H.BODY_OPEN)})"
    end = _place(inner, H.BODY_CLOSE)
    return f"(CASE WHEN {end} > 0 THEN {inner}[1:{end} - 1] ELSE {inner} END)"


def body_text(expr: str) -> str:
    texts = f"list_filter({body_nodes(expr)}, lambda n, i: i % 2 = 1)"
    texts = f"list_transform({texts}, lambda n: {rr(decode_entities('n'), T.STRIP, '')})"
    return f"array_to_string(list_filter({texts}, lambda n: n <> ''), chr(10))"


def page_title(expr: str) -> str:
    rest = f"({_after(scan(expr), H.TITLE_OPEN)})"
    t = decode_entities(f"{rest}[1]")
    return (f"(CASE WHEN {_place(scan(expr), H.TITLE_OPEN)} = 0 THEN {q(H.DEFAULT_TITLE)} "
            f"WHEN {t} <> '' AND regexp_matches({rest}[2], {q(H.TITLE_CLOSE)}) THEN {t} END)")


def sanitize_filename(expr: str) -> str:
    return strip(f"replace({rr(expr, H.FILENAME_BAD, '')}, ' ', '_')")


def page_filename(expr: str) -> str:
    return f"({sanitize_filename(page_title(expr))} || '.txt')"


def anchor_hrefs(expr: str) -> str:
    tags = f"list_filter({body_nodes(expr)}, lambda n, i: i % 2 = 0 AND regexp_matches(n, {q(H.ANCHOR)}))"
    inside = f"list_transform({tags}, lambda t: regexp_extract_all(t[3:length(t) - 1], {q(H.ATTRIBUTE)}, 0))"
    hrefs = f"list_transform({inside}, lambda a: list_filter(a, lambda x: regexp_matches(x, {q(H.HREF)})))"
    raw = f"regexp_extract(h[-1], {q(H.VALUE)}, 1)"
    val = f"CASE WHEN regexp_matches({raw}, {q(H.QUOTED)}) THEN ({raw})[2:length({raw}) - 1] ELSE {raw} END"
    return f"list_transform(list_filter({hrefs}, lambda h: len(h) > 0), lambda h: {decode_entities(f'({val})')})"


def _remove_dots(segs: str) -> str:
    folded = (f"list_reduce({segs}, lambda acc, s: CASE WHEN s = '..' THEN acc[1:len(acc)-1] "
              f"WHEN s = '.' THEN acc ELSE list_append(acc, s) END, []::VARCHAR[])")
    folded = (f"(CASE WHEN {segs}[-1] IN ('.', '..') THEN list_append({folded}, '') "
              f"ELSE {folded} END)")
    path = f"array_to_string({folded}, '/')"
    return (f"(CASE WHEN {path} = '' THEN '/' WHEN NOT starts_with({path}, '/') "
            f"THEN '/' || {path} ELSE {path} END)")


def resolve_url(base: str, href: str) -> str:
    b, h = base, href
    site = f"regexp_extract({b}, {q(H.SITE)}, 1)"
    scheme = f"regexp_extract({b}, {q('^([a-zA-Z][a-zA-Z0-9+.-]*):')}, 1)"
    b_nofrag = f"regexp_replace({b}, '#.*$', '')"
    b_noquery = f"regexp_replace({b_nofrag}, {q(chr(92) + '?.*$')}, '')"
    b_path = f"regexp_extract({b}, {q(H.URL_PATH)}, 1)"
    h_path = f"regexp_extract({h}, {q(H.REF_PATH)}, 1)"
    h_rest = f"substr({h}, length({h_path}) + 1)"
    b_parts0 = f"string_split({b_path}, '/')"
    b_parts = (f"(CASE WHEN {b_parts0}[-1] <> '' THEN {b_parts0}[1:len({b_parts0})-1] "
               f"ELSE {b_parts0} END)")
    rel0 = f"list_concat({b_parts}, string_split({h_path}, '/'))"
    rel = f"list_filter({rel0}, lambda x, i: i = 1 OR i = len({rel0}) OR x <> '')"
    return (f"(CASE WHEN {h} = '' THEN {b} "
            f"WHEN regexp_matches({h}, {q(H.SCHEME)}) THEN {h} "
            f"WHEN starts_with({h}, '//') THEN {scheme} || ':' || {h} "
            f"WHEN starts_with({h}, '#') THEN {b_nofrag} || {h} "
            f"WHEN starts_with({h}, '?') THEN {b_noquery} || {h} "
            f"WHEN starts_with({h}, '/') THEN {site} || {_remove_dots(f'string_split({h_path}, {q(chr(47))})')} || {h_rest} "
            f"ELSE {site} || {_remove_dots(rel)} || {h_rest} END)")


def site_root(expr: str) -> str:
    return f"(regexp_extract({expr}, {q(H.SITE)}, 1) || '/')"


def has_fragment(expr: str) -> str:
    return f"regexp_matches({expr}, {q(H.FRAGMENT)})"
