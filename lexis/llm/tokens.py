"""Exact, cached encoding of whole texts with a public `tokenizers` file.

Both public BPE files cut a text into pre-tokens that are encoded on their
own, so a text may be cut wherever a pre-token is sure to end, and the pieces'
ids joined.  Pieces repeat, so each worker keeps their ids in a bounded cache
and hands only new pieces to the library, many at a time.  The result equals
``Tokenizer.encode(text, add_special_tokens=False)`` with
``encode_special_tokens`` on: a special token's string in a text is ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Sequence
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexis.llm.common import keeps

END_ID = 1
#: Pieces a worker remembers; beyond it those seen once or long ago are forgotten (results don't change).
CACHE_PIECES = 700_000


class _Index(dict):
    """piece -> number; an unknown piece gets the next number and is queued."""

    def __init__(self):
        super().__init__()
        self.queue: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.queue.append(piece)
        return n


class Encoder:
    """Encodes texts to uint32 id arrays."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = self._kind(spec)
        self.bare = self._bare(spec)
        self.cache_pieces = cache_pieces
        self.mark = "\n" if self.kind == "bytes" else "\0"
        self.mark_ids = self.tok.encode(self.mark, add_special_tokens=False).ids
        if len(self.mark_ids) != 1:
            self.kind = "plain"
        self._reset()

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return "bytes"
        steps = pre.get("pretokenizers") or [{}]
        if steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert"):
            return "words"
        return "plain"

    def _bare(self, spec: dict) -> Callable[[str], tuple[str, str] | None] | None:
        """How the model alone is given a piece: as (a pre-token, one more or ""), or None for a piece where that might
        differ from the whole way; None for all of them where it might."""
        model = spec.get("model") or {}
        if model.get("type") != "BPE" or model.get("dropout") or not all(t["special"] for t in spec.get("added_tokens") or []):
            return None
        if self.kind == "bytes":
            return lambda k: ("\u0120" + k, "") if k.isalpha() and k.isascii() else None
        steps = ((spec.get("normalizer") or {}).get("normalizers") or []) if self.kind == "words" else []
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex", "") if self.kind == "words" else ""
        if [(x.get("type"), x.get("pattern")) for x in steps] == [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)] \
                and "|[\\p{L}]+|" in split and split.endswith(r"|[^\s\p{L}\p{N}]+") \
                and [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"][1:]] == ["ByteLevel"]:
            return self._word
        return None

    # A word of Latin letters is one pre-token, and so are the signs that end its piece (an apostrophe may begin another).
    _SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
    _LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    #: Bytes as the byte-level alphabet writes them.
    _LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}

    @classmethod
    def _word(cls, key: str) -> tuple[str, str] | None:
        word = key.rstrip(cls._SIGNS)
        if not word.isalpha():
            return None
        if word.isascii():
            return word.lower(), key[len(word):]
        if cls._LATIN.fullmatch(word):
            return word.lower().encode().decode("latin-1").translate(cls._LETTERS), key[len(word):]
        return None

    def _reset(self) -> None:
        self.index = _Index()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.seen = np.zeros(1 << 14, np.int64)

    def _forget(self) -> None:
        """Keep the pieces seen twice or more, half the cache at most; what they were seen counts half from now on."""
        n, most = len(self.index), self.cache_pieces // 2
        seen, count = self.seen[:n], self.count[:n]
        kept = np.flatnonzero(seen > 1)
        if len(kept) > most:
            kept = np.sort(kept[np.argsort(-seen[kept], kind="stable")[:most]])
        old, start, count, seen = list(self.index), self.start[kept], count[kept], seen[kept] // 2
        flat = self.flat[np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())]
        self._reset()
        for i in kept.tolist():
            self.index[old[i]]
        self.index.queue = []
        self._grow()
        self._keep(np.arange(len(kept)), flat, count)
        self.seen[:len(kept)] = seen

    # -- cutting ----------------------------------------------------------
    # "bytes": pieces begin at a space or newline that follows a non-space, or
    # at a comma or full stop that follows a letter or digit.  A piece's key
    # leaves out the leading space; other beginnings are marked by a control
    # character.  Texts where such a cut might not be a pre-token's end, or
    # that hold a mark, go by the slower pattern.
    # (the pattern begins with one class of characters, which re finds several times faster than alternatives)
    _UNSURE = re.compile(r"[\s.,\x01-\x05](?:(?<=\s\s)|(?<=[.,])(?<![^\W_].)|(?<=[\x01-\x05]))")
    _PIECES = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*|\s+")
    _LEAD = {"\x01": "", "\x02": "\n", "\x03": ",", "\x05": "."}

    def _cut(self, text: str) -> list[str]:
        if self._UNSURE.search(text):
            return ["\x01" + p for p in self._PIECES.findall(text)]
        pieces = text.replace("\n", " \x02").replace(",", " \x03").replace(".", " \x05").split(" ")
        if pieces[0]:
            pieces[0] = "\x01" + pieces[0]
        else:
            del pieces[0]
        return pieces

    def _text(self, key: str) -> str:
        if self.kind == "words":
            return key
        lead = self._LEAD.get(key[:1])
        return " " + key if lead is None else lead + key[1:]

    # -- new pieces -------------------------------------------------------
    def _odd(self, pieces: list[str]) -> np.ndarray:
        """Pieces that can't stand between marks: blank ones, those with white space at an end or with a mark."""
        if self.kind == "words":
            joined = " ".join(pieces)
            if self.mark not in joined and joined.split() == pieces:  # the usual case, at once
                return np.zeros(len(pieces), bool)
        return np.array([self.mark in p or not p.strip() or p[-1:].isspace() or p[:2].isspace() for p in pieces], bool)

    def _keep(self, numbers: np.ndarray, flat: np.ndarray, count: np.ndarray) -> None:
        """Store the ids of pieces, which stand in a row in ``flat``."""
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(flat)] = flat
        self.start[numbers] = self.used + np.cumsum(count) - count
        self.count[numbers] = count
        self.used += len(flat)

    def _grow(self) -> None:
        """Room for all pieces of the index."""
        while len(self.index) > len(self.start):
            self.start, self.count, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.seen))

    def _learn(self) -> None:
        keys, self.index.queue = self.index.queue, []
        if not keys:
            return
        self._grow()
        first, plain = len(self.index) - len(keys), np.zeros(len(keys), bool)
        if self.bare:
            self._learn_bare(keys, first, plain)
        numbers = first + np.flatnonzero(~plain)
        pieces = [self._text(keys[i]) for i in (numbers - first).tolist()]
        odd = self._odd(pieces)
        alone, together = np.flatnonzero(odd).tolist(), np.flatnonzero(~odd)
        sep = self.mark if self.kind == "bytes" else f" {self.mark} "
        for lo in range(0, len(together), 4096):
            part = together[lo:lo + 4096]
            text = sep.join([pieces[i] for i in part])
            got = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            marks = got == self.mark_ids[0]
            cuts = np.concatenate([[-1], np.flatnonzero(marks), [len(got)]])
            if len(cuts) == len(part) + 1:
                self._keep(numbers[part], got[~marks], np.diff(cuts) - 1)
            else:
                alone += part.tolist()
        ids = [e.ids for e in self.tok.encode_batch_fast([pieces[i] for i in alone], add_special_tokens=False)]
        self._keep(numbers[np.array(alone, np.int64)], np.array([x for i in ids for x in i], np.uint32), np.array([len(i) for i in ids], np.int64))

    def _learn_bare(self, keys: list[str], first: int, plain: np.ndarray) -> None:
        """Hand pieces to the model alone where that gives the same ids, and mark them in ``plain``."""
        one, bare, ends = self.tok.model.tokenize, self.bare, {"": []}
        for lo in range(0, len(keys), 4096):
            at, got = [], []
            for i, k in enumerate(keys[lo:lo + 4096], lo):
                parts = bare(k)
                if parts is not None:
                    word, end = parts
                    if end not in ends:
                        ends[end] = one(end)
                    at.append(i)
                    got.append(one(word) + ends[end] if end else one(word))
            plain[at] = True
            self._keep(first + np.array(at, np.int64), np.fromiter(map(attrgetter("id"), chain.from_iterable(got)), np.uint32),
                       np.fromiter(map(len, got), np.int64, len(got)))

    # -- use --------------------------------------------------------------
    def _numbers(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all pieces in a row, and how many a text has."""
        look = self.index.__getitem__
        if self.kind == "words":  # cut by Arrow, and a piece is looked up once; an empty one has no ids
            lists = pc.split_pattern(pa.array([(t or "").replace("\n", " ") for t in texts], pa.large_string()), " ")
            coded = lists.flatten().dictionary_encode()
            known = np.fromiter(map(look, coded.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))
            return known[coded.indices.to_numpy()], pc.list_value_length(lists).to_numpy()
        numbers, pieces_of = [np.zeros(0, np.int64)], []
        for text in texts:
            cut = self._cut(text) if text else []
            numbers.append(np.fromiter(map(look, cut), np.int64, len(cut)))
            pieces_of.append(len(cut))
        return np.concatenate(numbers), np.array(pieces_of, np.int64)

    def encode(self, texts: Sequence[str | None], end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in a row (uint32), and the places where each ends."""
        if self.kind == "plain":
            rows = [np.array(e.ids + ([end_id] if end_id is not None else []), np.uint32)
                    for e in self.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
            return (np.concatenate(rows) if rows else np.zeros(0, np.uint32),
                    np.cumsum([len(r) for r in rows], dtype=np.int64))
        if len(self.index) > self.cache_pieces:
            self._forget()
        numbers, pieces_of = self._numbers(texts)
        self._learn()
        self.seen[:len(self.index)] += np.bincount(numbers, minlength=len(self.index))
        count = self.count[numbers]
        upto = np.concatenate([[0], np.cumsum(count)])
        total = int(upto[-1])
        ids = self.flat[np.repeat(self.start[numbers] - upto[:-1], count) + np.arange(total)]
        ends = upto[np.cumsum(pieces_of, dtype=np.int64)]
        if end_id is not None and len(ends):
            ids = np.insert(ids, ends, np.uint32(end_id))
            ends = ends + np.arange(1, len(ends) + 1)
        return ids, ends


_ENCODERS: dict[str, Encoder] = {}
keeps("tokens", _ENCODERS.clear)


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def public_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
