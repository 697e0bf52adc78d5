"""Substring dedup over sliding sentence spans.

A text is cut into units: sentences, which end at '.', '!', '?' or a line feed
(with the white space that follows); a sentence of more than UNIT_WORDS words is
cut further, so that a passage without full stops has several units too.  These
cuts are chosen by the words around them, so the same words are cut alike wherever
they stand in a sentence; where content asks for none in UNIT_WORDS words, there
is one after so many from the last cut.  From every unit starts a span: RUN consecutive
units, and as many more as it takes to hold MIN_WORDS words, so that passages of
very short sentences have spans too.  Spans are hashed once (128 bits, white space at a
unit's ends left out), written, and joined globally; the first one in (doc_id, text hash,
position) order stays, and every other occurrence marks its characters.  Marked
characters are removed from the text, without cutting it again; all else is kept to the byte.

Rows equal in id and text are one document and get the same result.  Null ids
sort first.  Null texts stay null, empty ones empty.  All columns of ``docs`` are
returned; ``n_chars`` is brought up to date where it exists.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexis.llm.common import cut, doc_hash, entering, forget, fresh, keeps, release, slices

RUN, UNIT_WORDS, MIN_WORDS = 3, 12, 12
NEAR = 3  # words on either side that a cut inside a sentence looks at
CACHE_WORDS = 200_000
_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?\n]+[ \t\r\n]*|$)")
_WORD = re.compile(r"\s*\S+\s*")
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(f, -1, 1 << 64) for f in _FACTORS)
# a place's number, by which cuts are chosen: (sum of factor x number of a word) modulo PRIME,
# over the word before, the word and the word after; small enough for 64-bit integers
PRIME = (1 << 31) - 1
NEIGHBOURS = (1103515245, 1664525, 69069069)


class _Numbers(dict):
    """word -> 1 to PRIME - 1, from the first 32 bits of its MD5; no word is 0."""

    def __missing__(self, word: str) -> int:
        h = int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % (PRIME - 1) + 1
        h = self[word] = h if word else 0
        return h


_numbers = _Numbers()
keeps("span_dedup", _numbers.clear)


def _inner_cuts(words: list[str]) -> list[int]:
    """The places of the words after which the content asks for a cut: those whose number is the least
    of NEAR words on either side (ties count).  Empty words are no words."""
    if len(_numbers) > CACHE_WORDS:
        _numbers.clear()
    own = np.fromiter(map(_numbers.__getitem__, words), np.int64, len(words))
    mixed = own * NEIGHBOURS[1] % PRIME
    mixed[1:] += own[:-1] * NEIGHBOURS[0] % PRIME
    mixed[:-1] += own[1:] * NEIGHBOURS[2] % PRIME
    mixed %= PRIME
    mixed[own == 0] = PRIME
    least = own != 0
    for j in range(1, NEAR + 1):
        least[j:] &= mixed[j:] <= mixed[:-j]
        least[:-j] &= mixed[:-j] <= mixed[j:]
    return np.flatnonzero(least).tolist()


def units(text: str | None, unit_words: int = UNIT_WORDS) -> tuple[list[str], list[int]]:
    """The units of a text, which joined give the text again, and their numbers of words."""
    parts, words, apart = [], [], [""] * (NEAR + 1)
    split, flat = [], list(apart)
    for s in _SENTENCE.findall(text or ""):
        if s:
            w = s.split()
            split.append((s, w, len(flat)))
            if len(w) > unit_words:
                flat += w
                flat += apart
    cuts = _inner_cuts(flat) if len(flat) > len(apart) else []
    cuts.append(len(flat))
    k = 0
    for s, w, begin in split:
        n = len(w)
        if n <= unit_words:
            parts.append(s)
            words.append(n)
            continue
        plain, lo = " ".join(w), 0
        spaced = s.startswith(plain)  # single spaces, which is quicker
        pieces = w if spaced else _WORD.findall(s)
        while lo < n:
            hi = cuts[k] + 1 - begin
            end = min(lo + unit_words, hi, n)
            k += end == hi
            if spaced:
                parts.append(" ".join(w[lo:end]) + (" " if end < n else s[len(plain):]))
            else:
                parts.append("".join(pieces[lo:end]))
            words.append(end - lo)
            lo = end
    return parts, words


def span_ends(words: list[int], run: int, min_words: int) -> np.ndarray:
    """For each unit the end of the span that starts there; past the last unit if the text ends before."""
    w = np.cumsum([0, *words])
    end = np.maximum(np.arange(len(words)) + run, np.searchsorted(w, w[:-1] + min_words))
    return np.minimum(end, len(words) + 1)


def span_hashes(parts: list[str], words: list[int], run: int, min_words: int):
    """First character of each span, the one behind its last, and its hash as two 64-bit integers."""
    end = span_ends(words, run, min_words)
    at = np.flatnonzero(end <= len(parts))
    if not len(at):
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros((0, 2), np.int64)
    raw = b"".join(xxhash.xxh3_128_digest(p.strip().encode("utf-8", "surrogatepass")) for p in parts)
    one = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    # order matters: counted from a span's end, each place has its own odd factors; sums from the text's
    # start, with the factors' inverses, give a span of any length in one step
    up, down = (np.cumprod(np.broadcast_to(np.array(f, np.uint64), one.shape), axis=0) for f in (_FACTORS, _INVERSES))
    total = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(one * down, axis=0, dtype=np.uint64)])
    char = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return char[at], char[end[at]], ((total[end[at]] - total[at]) * up[end[at] - 1]).view(np.int64)


def spans(docs: DataFrame, run: int = RUN, unit_words: int = UNIT_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h, text) to (doc_id, h, at, s1, s2): all spans, ``at`` being first character << 32 | the one behind the last."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("span_dedup")
        for b in batches:
            texts = b.column("text").to_pylist()
            for first, last in slices(texts, 1_000_000):
                rows, at, key = [], [], []
                for i in range(first, last):
                    begin, end, h = span_hashes(*units(texts[i], unit_words), run, min_words)
                    rows.append(np.full(len(begin), i))
                    at.append(begin.astype(np.int64) << 32 | end)
                    key.append(h)
                take, key = pa.array(np.concatenate(rows)), np.concatenate(key)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(take), b.column("h").take(take), pa.array(np.concatenate(at)),
                     pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy())], names=["doc_id", "h", "at", "s1", "s2"])

    return docs.mapInArrow(task, f"doc_id {id_type}, h long, at long, s1 long, s2 long")


def without(text: str, gone: list[dict]) -> str:
    """The text without the characters of some ranges (lo, hi)."""
    out, at = [], 0
    for r in sorted(gone, key=lambda r: r["lo"]):
        if r["lo"] > at:
            out.append(text[at:r["lo"]])
        at = max(at, r["hi"])
    return "".join([*out, text[at:]])


def dedup(docs: DataFrame, run: int = RUN, unit_words: int = UNIT_WORDS, min_words: int = MIN_WORDS,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated spans removed from the texts."""
    slim = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", doc_hash())
            .select("doc_id", "h", "text"))
    every = cut(spans(slim, run, unit_words, min_words), "spans", "zstd")
    # most spans occur once: half a hash, counted first, leaves the few that whole hashes are compared for
    often = cut(every.groupBy("s1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("s1"), "often")
    release(docs.sparkSession)
    # joins have plain shuffles on both sides, so a hot passage's rows can be split
    some = cut(every.join(often, "s1", "left_semi"), "some", "zstd")
    forget(every, often)
    release(docs.sparkSession)
    # pre-aggregated, so a passage that very many documents share is one row a task
    first = F.min(F.struct("doc_id", "h", "at"))
    repeated = cut(some.groupBy("s1", "s2").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
                   .where("n > 1").select("s1", "s2", "first"), "repeated")
    later = (some.join(repeated, ["s1", "s2"]).where(~F.struct("doc_id", "h", "at").eqNullSafe(F.col("first")))
             .select("doc_id", "h", "at"))
    k, kh, h, at = fresh(docs, "mark_id", "mark_hash", "text_hash", "gone")
    marks = cut(later.groupBy(F.col("doc_id").alias(k), F.col("h").alias(kh)).agg(F.collect_set("at").alias(at)), "marks")
    forget(some, repeated)
    release(docs.sparkSession)

    names = docs.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("span_dedup")
        for b in batches:
            out = [without(text, [{"lo": x >> 32, "hi": x & 0xFFFFFFFF} for x in gone]) if gone else text
                   for text, gone in zip(b.column(text_col).to_pylist(), b.column(at).to_pylist())]
            cols = [pa.array(out, pa.string()) if n == text_col else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    joined = docs.withColumn(h, doc_hash(text_col)).join(marks, F.col(h).eqNullSafe(F.col(kh)) & F.col(id_col).eqNullSafe(F.col(k)), "left")
    out = joined.select(*names, at).mapInArrow(task, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def op3_span_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    return dedup(docs)


OP3_SQL = rf"""
WITH sentences AS (
  SELECT doc_id, sent, s, regexp_extract_all(s, '\s*\S+\s*') AS pieces FROM (
    SELECT doc_id, unnest(s) AS s, unnest(range(len(s))) AS sent FROM (
      SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^.!?\n]*(?:[.!?\n]+[ \t\r\n]*|$)'), lambda s: s <> '') AS s
      FROM documents))),
words AS (
  SELECT doc_id, sent, i, p, CAST('0x' || substr(md5(trim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), 1, 8) AS BIGINT) % {PRIME - 1} + 1 AS own
  FROM (SELECT doc_id, sent, unnest(pieces) AS p, unnest(range(len(pieces))) AS i FROM sentences WHERE len(pieces) > {UNIT_WORDS})),
places AS (
  SELECT *, (own * {NEIGHBOURS[1]} % {PRIME} + coalesce(lag(own) OVER w, 0) * {NEIGHBOURS[0]} % {PRIME}
             + coalesce(lead(own) OVER w, 0) * {NEIGHBOURS[2]} % {PRIME}) % {PRIME} AS place
  FROM words WINDOW w AS (PARTITION BY doc_id, sent ORDER BY i)),
cuts AS (
  SELECT *, CAST(place = min(place) OVER (PARTITION BY doc_id, sent ORDER BY i ROWS BETWEEN {NEAR} PRECEDING AND {NEAR} FOLLOWING) AS BIGINT) AS ends
  FROM places),
parts AS (
  SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id, sent ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM cuts),
stretches AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id, sent, part ORDER BY i) - 1) // {UNIT_WORDS} AS stretch FROM parts),
units AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sent, part, stretch) AS u, x, n FROM (
    SELECT doc_id, sent, part, stretch, string_agg(p, '' ORDER BY i) AS x, count(*) AS n FROM stretches GROUP BY ALL
    UNION ALL SELECT doc_id, sent, 0, 0, s, len(pieces) FROM sentences WHERE len(pieces) <= {UNIT_WORDS})),
counted AS (SELECT doc_id, u, regexp_replace(x, '^\s+|\s+$', '', 'g') AS k, n, sum(n) OVER w AS upto, count(*) OVER (PARTITION BY doc_id) AS many
  FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY u)),
least AS (SELECT doc_id, upto, min(u) AS u FROM counted GROUP BY doc_id, upto),
spans AS (
  SELECT c.doc_id, c.u AS i, greatest(c.u + {RUN}, l.u + 1) AS e
  FROM counted c ASOF JOIN least l ON c.doc_id = l.doc_id AND c.upto - c.n + {MIN_WORDS} <= l.upto WHERE greatest(c.u + {RUN}, l.u + 1) <= many + 1),
keys AS (SELECT s.doc_id, i, e, list(k ORDER BY u) AS k FROM spans s JOIN counted c ON s.doc_id = c.doc_id AND c.u >= i AND c.u < e GROUP BY ALL),
later AS (SELECT doc_id, i, e FROM keys QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, e)) AS u FROM later),
kept AS (SELECT doc_id, string_agg(x, '' ORDER BY u) AS text FROM units ANTI JOIN gone USING (doc_id, u) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       CAST(CASE WHEN d.text IS NOT NULL THEN length(coalesce(k.text, '')) END AS BIGINT) AS n_chars
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
