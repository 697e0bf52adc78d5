"""Cross-tokenizer alignment of two public tokenizers, with corpus-wide counts of id pairs.

A text with a space before it is encoded by A (byte-level BPE) and by B (pieces with byte fallback,
which adds the space itself).  Token ends are byte offsets; where tokens of both end, a group ends.
Two tokens are linked if their byte ranges overlap, so there is one link for each distinct end of a token.

1. Tasks hold token ids as Arrow lists.  Flattened, with parent indices, they give a table of ends
   for A and one for B (a segmented cumulative sum of token lengths); an Acero full outer hash join on
   (segment, end) has a row for each link, and both sides filled where a group ends.
   ``Table.group_by`` counts each document's id pairs, and a block's.
2. Blocks are of bounded size (BLOCK_CHARS).  Spark adds up the blocks' partial counts, finds each B id's
   highest, and hands every block the counts of the pairs it holds; documents wait as compressed lists of
   places in their block's pairs, so neither texts nor links are shuffled.

A text longer than SEGMENT_CHARS is aligned in segments, cut before a space between two letters a-z, where
a token of both ends for sure, so its arrays stay small; only its ids (8 bytes a character) are held whole.
Without such a place a segment is as long as need be.

Special tokens' strings in texts are plain text.  Texts that are null or empty, or whose joined token
bytes differ from space + text, have no tokens: zeros, and '' for the digest of groups.  Rows with equal
ids are scored one by one and all count.  An empty table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexis.llm.common import cut, entering, forget, keeps, release, slices
from lexis.llm.tokens import Encoder, _Index, public_path

SLICE_CHARS, SEGMENT_CHARS, BLOCK_CHARS = 1_000_000, 500_000, 16_000_000
CACHE_UNITS = 300_000
_PLACE = re.compile(r"[a-z](?= [a-z])")


# --- tokens and their bytes ----------------------------------------------------------
class Pieces:
    """Encodes texts that begin with a space by a sentencepiece file, unit by unit: a run of spaces
    and what follows it.  No piece of the vocabulary goes on past a space, so units are encoded
    on their own, and their ids kept; else whole texts are encoded."""

    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.by_unit = not any(re.search("[^▁]▁", p) for p in pieces)
        self.space = np.array([self.sp.piece_to_id("▁")], np.uint32)
        self.bytes = pa.array([bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode()
                               for i, p in enumerate(pieces)], pa.binary())
        self.cache_units = cache_units
        self.index, self.ids = _Index(), []

    def _encode(self, bodies: list[str]) -> list[np.ndarray]:
        """ids of texts to which the library adds the space."""
        found = self.sp.encode(bodies, num_threads=1)
        return [np.array(x, np.uint32) if b else self.space for b, x in zip(bodies, found)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_unit:
            return self._encode([t[1:] for t in texts])
        if len(self.index) > self.cache_units:
            self.index, self.ids = _Index(), []
        look, numbers = self.index.__getitem__, []
        for t in texts:
            body = t[1:]
            if "  " in body or body[:1] == " " or body[-1:] == " ":
                units = [u[1:] for u in re.findall(" +[^ ]*", t)]
            else:
                units = body.split(" ")
            numbers.append(list(map(look, units)))
        queue, self.index.queue = self.index.queue, []
        self.ids += self._encode(queue)
        return [np.concatenate([self.ids[k] for k in n]) for n in numbers]


def byte_entries(path: str) -> pa.Array:
    """The bytes of a byte-level vocabulary's entries, by id."""
    from tokenizers import Tokenizer
    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    # fixed values: bytes that stand for themselves; the others are the characters from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    out = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        out[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
    return pa.array(out, pa.binary())


class Aligner:
    """This worker's two tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Encoder(path_a, CACHE_UNITS), Pieces(path_b)
        self.bytes = (byte_entries(path_a), self.b.bytes)
        self.length = [pc.binary_length(x).cast(pa.int64()) for x in self.bytes]
        self.name = [pa.array([str(i) for i in range(len(x))]) for x in self.bytes]

    def tokens(self, segments: list[str]) -> tuple[pa.ListArray, pa.ListArray, np.ndarray]:
        """ids of A and B for each segment, and whether both give the segment's bytes."""
        ids, ends = self.a.encode(segments, None)
        lists = [pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32)))]
        rows = self.b.encode(segments)
        upto = np.cumsum([0, *map(len, rows)])
        lists.append(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(np.concatenate(rows).astype(np.int32))))
        raw, same = pa.array([s.encode("utf-8", "surrogatepass") for s in segments], pa.binary()), np.ones(len(segments), bool)
        for x, entry in zip(lists, self.bytes):
            joined = pc.binary_join(pa.ListArray.from_arrays(x.offsets, entry.take(x.flatten())), b"")
            same &= pc.equal(joined, raw).to_numpy(zero_copy_only=False)
        return *lists, same

    def _ends(self, ids: pa.ListArray, which: int, side: str) -> pa.Table:
        """(segment, end, id): a segmented cumulative sum of token lengths."""
        parent = pc.list_parent_indices(ids).cast(pa.int64())
        flat = ids.flatten()
        total = pc.cumulative_sum(self.length[which].take(flat))
        first = np.append(0, total.to_numpy())[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
        return pa.table({"segment": parent, "end": pc.subtract(total, pa.array(first).take(parent)), side: flat})

    def align(self, a: pa.ListArray, b: pa.ListArray) -> tuple[pa.Table, list[str], np.ndarray]:
        """Links (segment, a, b) in order, and each segment's groups as text and their number."""
        links = self._ends(a, 0, "a").join(self._ends(b, 1, "b"), ["segment", "end"], join_type="full outer", use_threads=False)
        place = pc.bit_wise_or(pc.shift_left(links["segment"], 40), links["end"])
        links = links.take(pc.sort_indices(place)).combine_chunks()
        has_a, has_b = (links[c].is_valid().to_numpy() for c in ("a", "b"))
        closes = has_a & has_b
        parts = []
        for has, ids, name in ((has_a, a, self.name[0]), (has_b, b, self.name[1])):
            at = np.append(0, np.cumsum(has)[closes]).astype(np.int32)
            parts.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(at), name.take(ids.flatten())), ","))
        groups = pc.binary_join_element_wise(*parts, "|")
        many = np.bincount(links["segment"].to_numpy()[closes], minlength=len(a))
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), groups), ";")
        whole = pa.table({"segment": links["segment"], "a": pc.fill_null_backward(links["a"]), "b": pc.fill_null_backward(links["b"])})
        return whole, text.to_pylist(), many


_ALIGNERS: dict[tuple, Aligner] = {}
keeps("token_alignment", _ALIGNERS.clear)


def aligner(*paths: str) -> Aligner:
    if paths not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


# --- blocks ----------------------------------------------------------------------------
def segments(text: str, size: int = SEGMENT_CHARS) -> list[str]:
    """Space + text, cut where both tokenizers end a token."""
    s, out, lo = " " + text, [], 0
    while len(s) - lo > size:
        found = _PLACE.search(s, lo + size - 1)
        if not found:
            break
        out.append(s[lo:found.end()])
        lo = found.end()
    return [*out, s[lo:]]


def _shrunk(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _grown(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, n * 4, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class _Block:
    """The documents of one block: counts of their own, and the id pairs of each."""

    def __init__(self, number: int):
        self.number, self.chars = number, 0
        self.ids, self.counts, self.digests, self.pairs = [], [], [], []

    def add(self, ids: pa.Array, texts: list[str | None], al: Aligner) -> None:
        cuts = [segments(t) if t else [] for t in texts]
        of = np.repeat(np.arange(len(texts)), [len(c) for c in cuts])
        counts, begun = np.zeros((len(texts), 4), np.int64), np.zeros(len(texts), bool)
        hashes = [hashlib.sha256() if c else None for c in cuts]
        if len(of):
            a, b, same = al.tokens([s for c in cuts for s in c])
            good = np.ones(len(texts), bool)
            good[of[~same]] = False
            use = np.flatnonzero(good[of])
            a, b, of = a.take(pa.array(use)), b.take(pa.array(use)), of[use]
            size = np.cumsum(pc.list_value_length(a).to_numpy(zero_copy_only=False)) // (SLICE_CHARS // 2)
            starts = [*np.flatnonzero(np.append(True, size[1:] != size[:-1])), len(of)] if len(of) else []
            for lo, hi in pairwise(starts):
                links, groups, many = al.align(a.slice(lo, hi - lo), b.slice(lo, hi - lo))
                doc = of[lo:hi]
                for d, g in zip(doc, groups):
                    hashes[d].update((";" + g if begun[d] else g).encode())
                    begun[d] = True
                self._count(doc, links, many, a.slice(lo, hi - lo), b.slice(lo, hi - lo), counts, len(self.counts))
        self.ids.append(ids)
        self.counts += counts.tolist()
        self.digests += [h.hexdigest() if ok else "" for h, ok in zip(hashes, begun)]
        self.chars += sum(len(t or "") for t in texts)

    def _count(self, doc, links, many, a, b, counts, before: int) -> None:
        segment = links["segment"].to_numpy()
        for col, x in enumerate((pc.list_value_length(a).to_numpy(zero_copy_only=False), pc.list_value_length(b).to_numpy(zero_copy_only=False), many,
                                 np.bincount(segment, minlength=len(doc)))):
            np.add.at(counts[:, col], doc, x)
        code = pc.bit_wise_or(pc.shift_left(links["a"].cast(pa.int64()), 32), links["b"].cast(pa.int64()))
        table = pa.table({"doc": pa.array(doc[segment] + before), "code": code})
        self.pairs.append(table.group_by(["doc", "code"], use_threads=False).aggregate([([], "count_all")]))

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The block's id pairs with their counts, then its documents."""
        n = len(self.counts)
        if not n:
            return
        payload, size = [b""] * n, np.zeros(n, np.int64)
        if self.pairs:
            pairs = pa.concat_tables(self.pairs)
            total = pairs.group_by("code", use_threads=False).aggregate([("count_all", "sum")])
            codes, sums = total["code"].to_numpy(), total["count_all_sum"].to_numpy()
            order = np.argsort(codes)
            codes, sums = codes[order], sums[order]
            doc, place, each = pairs["doc"].to_numpy(), np.searchsorted(codes, pairs["code"].to_numpy()), pairs["count_all"].to_numpy()
            order = np.lexsort((place, doc))
            doc, place, each = doc[order], place[order], each[order]
            at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            for lo, hi in pairwise([*at, len(doc)]):
                gaps = np.diff(place[lo:hi], prepend=0)
                payload[doc[lo]], size[doc[lo]] = _shrunk(np.concatenate([gaps, each[lo:hi]])), hi - lo
            for lo in range(0, len(codes), 50_000):
                k = len(codes[lo:lo + 50_000])
                yield _rows(k, self.number, {"code": pa.array(codes[lo:lo + k]), "n": pa.array(sums[lo:lo + k])}, self.ids[0].type)
        ids = pa.concat_arrays(self.ids)
        for lo in range(0, n, 2000):
            hi = min(lo + 2000, n)
            own = np.array(self.counts[lo:hi], np.int64)
            yield _rows(hi - lo, self.number, {"doc_id": ids.slice(lo, hi - lo), **{c: pa.array(own[:, i]) for i, c in enumerate(_COUNTS)},
                                               "sha": pa.array(self.digests[lo:hi]), "many": pa.array(size[lo:hi]),
                                               "payload": pa.array(payload[lo:hi], pa.binary())}, ids.type)


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_KINDS = {"code": pa.int64(), "n": pa.int64(), **{c: pa.int64() for c in _COUNTS}, "sha": pa.string(), "many": pa.int64(), "payload": pa.binary()}
_SQL = "code long, n long, n_a long, n_b long, n_groups long, n_links long, sha string, many long, payload binary"


def _rows(k: int, block: int, cols: dict, id_type) -> pa.RecordBatch:
    kinds = {"doc_id": id_type} | _KINDS
    return pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), *(cols.get(c, pa.nulls(k, t)) for c, t in kinds.items())], names=["block", *kinds])


def align(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None, block_chars: int = BLOCK_CHARS,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    paths = tokenizer_a or public_path("byte_bpe_50k.json"), tokenizer_b or public_path("piece_bpe_32k.model")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("token_alignment")
        al, number = aligner(*paths), TaskContext.get().partitionId() << 24
        block = _Block(number)
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts.to_pylist(), SLICE_CHARS):
                block.add(batch.column("doc_id").slice(lo, hi - lo), texts.slice(lo, hi - lo).to_pylist(), al)
                if block.chars >= block_chars:
                    yield from block.rows()
                    number += 1
                    block = _Block(number)
        yield from block.rows()

    named = cut(slim.mapInArrow(tokenise, f"block long, doc_id {id_type}, {_SQL}"), "aligned", "zstd")
    pairs = named.where("code is not null").select("block", "code", "n")
    total = cut(pairs.groupBy("code").agg(F.sum("n").alias("c")), "pair-counts")
    b_id = F.col("code").bitwiseAND(F.lit((1 << 32) - 1))
    highest = cut(total.groupBy(b_id.alias("b")).agg(F.max("c").alias("top")), "pair-top")
    counts = cut(total.join(highest, b_id == F.col("b")).select("code", "c", (F.col("c") == F.col("top")).alias("best")), "pair-best")
    back = pairs.select("block", "code").join(counts, "code")
    blank = lambda c, t: F.lit(None).cast(t).alias(c)
    doc_cols = ["doc_id", *_COUNTS, "sha", "many", "payload"]
    documents = named.where("code is null").select("block", F.lit(1).alias("kind"), *doc_cols, blank("code", "long"), blank("c", "long"), blank("best", "boolean"))
    weights = back.select("block", F.lit(0).alias("kind"), *(blank(c, named.schema[c].dataType) for c in doc_cols), "code", "c", "best")
    together = weights.unionByName(documents).repartition("block").sortWithinPartitions("block", "kind", "code")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, fresh, c, best = None, False, [], []
        for t in batches:
            at, kind = t.column("block").to_numpy(), t.column("kind").to_numpy()
            edges = np.flatnonzero((at[1:] != at[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in pairwise([0, *edges, t.num_rows] if t.num_rows else []):
                part = t.slice(lo, hi - lo)
                if at[lo] != block:
                    block, fresh, c, best = at[lo], False, [], []
                if kind[lo] == 0:  # a block's counts come first, in order of code
                    c.append(part.column("c").to_numpy())
                    best.append(part.column("best").to_numpy(zero_copy_only=False))
                    continue
                if not fresh:
                    c, best, fresh = [np.concatenate([*c, np.zeros(0, np.int64)])], [np.concatenate([*best, np.zeros(0, bool)])], True
                n_best, total = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                for i, (blob, many) in enumerate(zip(part.column("payload").to_pylist(), part.column("many").to_pylist())):
                    if many:
                        both = _grown(blob, 2 * many)
                        place, n = np.cumsum(both[:many]), both[many:]
                        n_best[i], total[i] = n[best[0][place]].sum(), (n * c[0][place]).sum()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(x) for x in _COUNTS), pa.array(n_best), pa.array(total), part.column("sha")],
                                                 names=["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])

    forget(total, highest)
    release(docs.sparkSession)
    return together.mapInArrow(score, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
