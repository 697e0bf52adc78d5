"""Web-page extraction as one regex scan and column expressions (no DOM parser).

``scan`` reads a page once, by ONE leftmost alternation over comments, script and style
elements, declarations and tags (whose quoted attribute values may hold ``>``), and gives an array in which
texts and tags take turns: a text, a tag, a text, ...  Comments, scripts and styles are empty tags; a ``<``
that begins none of these is text.  Title, body text and links are read from that array.

Approximations of an HTML parser, documented: an unclosed comment, script, style or tag runs to the end; a
title that holds markup is no usable title; numeric character references and a small
fixed set of named entities are decoded, each once (``&amp;`` last); U+0001 becomes U+FFFD.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexis.functions.text import STRIP

SPACE = r"[ \t\n\r\f]"
_ATTRIBUTES = rf"""(?:[ \t\n\r\f/](?:[^>=]*+={SPACE}*+(?:"[^"]*"|'[^']*')?+)*+[^>=]*+)?+"""


def _element(name: str) -> str:
    return rf"<{name}{_ATTRIBUTES}>.*?(?:</{name}(?:[ \t\n\r\f/][^>]*)?>|\z)"


#: Group 1 is a tag or declaration; comments, scripts and styles have none.  What is not closed
#: runs to the end, so no place is tried twice; possessive quantifiers keep Java's matcher
#: linear (the other engine's is so without them).
SCAN = (rf"(?is)<!--(?:-?>|.*?(?:-->|\z))|{_element('script')}|{_element('style')}"
        rf"|(<[!?][^>]*+(?:>|\z)|</?[a-z][^ \t\n\r\f/>]*+{_ATTRIBUTES}(?:>|\z))")
MARK = "\u0001"


def _tag(name: str) -> str:
    return rf"(?i)^<{name}[ \t\n\r\f/>]"


BODY_OPEN, BODY_CLOSE, TITLE_OPEN, TITLE_CLOSE, ANCHOR = map(_tag, ("body", "/body", "title", "/title", "a"))
#: An attribute inside a tag, its name, and its value (quotes kept).
ATTRIBUTE = rf"""[^ \t\n\r\f/>=]+(?:{SPACE}*={SPACE}*(?:"[^"]*"|'[^']*'|[^ \t\n\r\f>]*))?"""
HREF = rf"(?i)^href(?:{SPACE}*=|$)"
VALUE = rf"""(?s)^[^=]*={SPACE}*(.*)$"""
QUOTED = r"""(?s)^(?:"(.*)"|'(.*)')$"""
FILENAME_BAD = r'[\\/*?:"<>|]'
FRAGMENT = r"#."

# Fixed values of the reference: crawl base URL and default title.
BASE_URL = "https://devguide.python.org/"
DEFAULT_TITLE = "Sem título"

# Named entities decoded in text (fixed list); "&amp;" is decoded last so
# that "&amp;lt;" becomes "&lt;".
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"),
    ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"),
]
AMP = r"&(?:amp|#0*38|#[xX]0*26);"
# Numeric references but those of the ampersand, which is decoded last.
NUMERIC = r"&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def decode_entities(col) -> Column:
    c = _c(col)
    for ent, ch in ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    c = F.when(F.contains(c, F.lit("&#")), decode_numeric(c)).otherwise(c)
    return F.regexp_replace(c, AMP, "&")


def decode_numeric(c: Column) -> Column:
    """Numeric references replaced by their characters (each distinct one once);
    those that name no character stay."""
    def put(text, ref):
        hexa = ref.rlike("^[xX]")
        code = F.conv(F.regexp_replace(ref, "^[xX]", ""), 10, 16)
        code = F.when(hexa, F.regexp_replace(ref, "^[xX]", "")).otherwise(code)
        number = F.conv(code, 16, 10).cast("bigint")
        good = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF) & (number != 38)
        char = F.decode(F.unhex(F.lpad(F.when(good, code).otherwise("20"), 8, "0")), "UTF-32")
        return F.when(good, F.replace(text, F.concat(F.lit("&#"), ref, F.lit(";")), char)).otherwise(text)
    refs = F.array_distinct(F.regexp_extract_all(c, F.lit(NUMERIC), F.lit(1)))
    return F.aggregate(refs, c, put)


def scan(html) -> Column:
    """array<string>: texts and tags of a page in turn, beginning and ending with a text."""
    clean = F.translate(_c(html), MARK, "\ufffd")
    return F.split(F.regexp_replace(clean, SCAN, f"{MARK}$1{MARK}"), MARK, -1)


def _place(nodes: Column, tag: str) -> Column:
    """Place (from 1) of the first tag of a kind; 0 without one."""
    return F.array_position(F.transform(nodes, lambda n, i: (i % 2 == 1) & n.rlike(tag)), True)


def _after(nodes: Column, tag: str) -> Column:
    """What follows the first tag of a kind; nothing without one."""
    at = _place(nodes, tag)
    return F.when(at > 0, F.slice(nodes, at.cast("int") + 1, F.size(nodes))).otherwise(F.array().cast("array<string>"))


def has_body(nodes) -> Column:
    return _place(_c(nodes), BODY_OPEN) > 0


def body_nodes(nodes) -> Column:
    """Texts and tags of the first <body> up to </body> (or the end)."""
    inner = _after(_c(nodes), BODY_OPEN)
    end = _place(inner, BODY_CLOSE)
    return F.when(end > 0, F.slice(inner, 1, F.greatest(end.cast("int") - 1, F.lit(0)))).otherwise(inner)


def body_text(nodes) -> Column:
    """Text nodes of the body, entity-decoded, stripped, empties dropped,
    joined by newlines."""
    texts = F.filter(body_nodes(nodes), lambda n, i: i % 2 == 0)
    texts = F.transform(texts, lambda n: F.regexp_replace(decode_entities(n), STRIP, ""))
    return F.array_join(F.filter(texts, lambda n: n != ""), "\n")


def page_title(nodes, default: str = DEFAULT_TITLE) -> Column:
    """Title text; the default when the page has no <title>; NULL when the
    title is empty, unclosed or holds markup (the page cannot be named)."""
    rest = _after(_c(nodes), TITLE_OPEN)
    text = decode_entities(F.get(rest, F.lit(0)))
    return (F.when(~has_title(nodes), F.lit(default))
             .when((text != "") & F.get(rest, F.lit(1)).rlike(TITLE_CLOSE), text))


def has_title(nodes) -> Column:
    return _place(_c(nodes), TITLE_OPEN) > 0


def sanitize_filename(col) -> Column:
    s = F.replace(F.regexp_replace(_c(col), FILENAME_BAD, ""), F.lit(" "), F.lit("_"))
    return F.regexp_replace(s, STRIP, "")


def page_filename(nodes) -> Column:
    return F.concat(sanitize_filename(page_title(nodes)), F.lit(".txt"))


def anchor_hrefs(nodes) -> Column:
    """array<string>: href of every <a href> in the body, in order (entity-decoded).
    Of several href attributes the last counts; one without a value is empty."""
    tags = F.filter(body_nodes(nodes), lambda n, i: (i % 2 == 1) & n.rlike(ANCHOR))
    inside = F.transform(tags, lambda t: F.regexp_extract_all(F.substr(t, F.lit(3), F.length(t) - 3), F.lit(ATTRIBUTE), F.lit(0)))
    hrefs = F.transform(inside, lambda a: F.filter(a, lambda x: x.rlike(HREF)))

    def value(found):
        raw = F.regexp_extract(F.element_at(found, -1), VALUE, 1)
        return decode_entities(F.when(raw.rlike(QUOTED), F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw))
    return F.transform(F.filter(hrefs, lambda h: F.size(h) > 0), value)


# ---------------------------------------------------------------------------
# URL resolution (RFC 3986 style, matching urllib's urljoin on common forms)
# ---------------------------------------------------------------------------

SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"
SITE = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"
URL_PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"
REF_PATH = r"^([^?#]*)"


def _remove_dots(segments: Column) -> Column:
    folded = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
                                        .otherwise(acc))
                        .when(s == ".", acc)
                        .otherwise(F.concat(acc, F.array(s))))
    last = F.element_at(segments, -1)
    folded = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    path = F.array_join(folded, "/")
    return F.when(path == "", F.lit("/")).when(~path.startswith("/"), F.concat(F.lit("/"), path)) \
            .otherwise(path)


def resolve_url(base, href) -> Column:
    """urljoin(base, href) for absolute, network-path, absolute-path,
    relative-path, query-only, fragment-only and empty references."""
    b = F.lit(base) if isinstance(base, str) else base  # a URL literal or a Column
    h = _c(href)
    site = F.regexp_extract(b, SITE, 1)
    scheme = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    b_nofrag = F.regexp_replace(b, "#.*$", "")
    b_noquery = F.regexp_replace(b_nofrag, r"\?.*$", "")
    b_path = F.regexp_extract(b, URL_PATH, 1)
    h_path = F.regexp_extract(h, REF_PATH, 1)
    h_rest = F.substring(h, F.length(h_path) + 1, 1 << 30)
    b_parts = F.split(b_path, "/", -1)
    b_parts = F.when(F.element_at(b_parts, -1) != "", F.slice(b_parts, 1, F.size(b_parts) - 1)) \
               .otherwise(b_parts)
    rel = F.concat(b_parts, F.split(h_path, "/", -1))
    rel = F.filter(rel, lambda x, i: (i == 0) | (i == F.size(rel) - 1) | (x != ""))
    return (F.when(h == "", b)
             .when(h.rlike(SCHEME), h)
             .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
             .when(h.startswith("#"), F.concat(b_nofrag, h))
             .when(h.startswith("?"), F.concat(b_noquery, h))
             .when(h.startswith("/"), F.concat(site, _remove_dots(F.split(h_path, "/", -1)), h_rest))
             .otherwise(F.concat(site, _remove_dots(rel), h_rest)))


def site_root(url) -> Column:
    """scheme://host/ of a URL (the crawl base for per-page resolution)."""
    return F.concat(F.regexp_extract(_c(url), SITE, 1), F.lit("/"))


def has_fragment(url) -> Column:
    return _c(url).rlike(FRAGMENT)
