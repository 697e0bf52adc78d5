"""Cross-tokenizer alignment against a plain version on offsets."""

import hashlib
from collections import Counter

import pytest

from lexis.llm import token_alignment as T
from lexis.llm.tokens import public_path

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    """(text) to (A ids, A bytes, B ids, B bytes), with the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    entry = T.byte_entries(public_path("byte_bpe_50k.json")).to_pylist()

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def tokens(text):
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        return ia, [entry[i] for i in ia], ib, [piece(i) for i in ib]

    return tokens


def brute(rows, plain):
    """The contract, row by row, over (doc_id, text)."""
    docs, count = [], Counter()
    for doc_id, text in rows:
        links, groups = [], []
        ia, ba, ib, bb = plain(text) if text else ([], [], [], [])
        if not text or not (b"".join(ba) == b"".join(bb) == (" " + text).encode()):
            ia = ib = ()
        else:
            ends = [[], []]
            for side, parts in enumerate((ba, bb)):
                at = 0
                for p in parts:
                    at += len(p)
                    ends[side].append(at)
            i = j = 0
            ga, gb = [ia[0]], [ib[0]]
            while True:
                links.append((ia[i], ib[j]))
                ea, eb = ends[0][i], ends[1][j]
                i, j = i + (ea <= eb), j + (eb <= ea)
                if ea == eb:
                    groups.append((ga, gb))
                    ga, gb = [], []
                if i == len(ia):
                    break
                if ea <= eb:
                    ga.append(ia[i])
                if eb <= ea:
                    gb.append(ib[j])
        count.update(links)
        docs.append((doc_id, len(ia), len(ib), groups, links))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    text = lambda g: ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
    return sorted(((d, na, nb, len(g), len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x),
                    hashlib.sha256(text(g).encode()).hexdigest() if g else "") for d, na, nb, g, x in docs), key=repr)


def test_query_equals_brute_force(spark, plain):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in T.op11_token_alignment(spark, SF001).collect()), key=repr)
    assert got == brute([tuple(r) for r in docs], plain)


ODD = ["a b", "", None, " lead", "trail ", "  two  spaces   three", "line\nbreaks\n\n x", "tab\tand\r\n", "ünïcödé 漢字 🙂 b🙂", "<|endoftext|> <s> </s> <unk>",
       "<0x41>", "a▁b", "▁", "don't we'll", "1234567 89", "NUL\x00x", "​﻿x", "é é", "ﬁ Ⅳ ①", " ", "   ", "\n", "a b", "x" * 3000, "  y"]


def test_odd_texts_columns_and_blocks(spark, plain):
    rows = [(i % 20 if i % 7 else None, t) for i, t in enumerate(ODD * 2)]
    df = spark.createDataFrame([(i, t, "k", 1, "z") for i, t in rows], "doc_id int, text string, code string, block int, _pos string").repartition(3)
    want = brute(rows, plain)
    assert sorted((tuple(r) for r in T.align(df).collect()), key=repr) == want
    assert sorted((tuple(r) for r in T.align(df, block_chars=1).collect()), key=repr) == want


def test_long_text_in_segments(spark, plain, monkeypatch):
    text = "the quick brown fox, jumped over 12 lazy dogs.  And then\nit slept a while " * 40
    assert "".join(T.segments(text, 100)) == " " + text and len(T.segments(text, 100)) > 20
    assert T.segments("x" * 1000, 100) == [" " + "x" * 1000]
    al = T.aligner(public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))
    import pyarrow as pa
    blocks = []
    for size in (100, 10**9):
        monkeypatch.setattr(T, "segments", lambda t, size=size, cut=T.segments: cut(t, size))
        monkeypatch.setattr(T, "SLICE_CHARS", 200 if size == 100 else 1_000_000)
        b = T._Block(0)
        b.add(pa.array([1, 2]), [text, "short one"], al)
        blocks.append((b.counts, b.digests))
        monkeypatch.undo()
    assert blocks[0] == blocks[1]
    (row, _) = brute([(1, text), (2, "short one")], plain)
    assert blocks[0][0][0] == list(row[1:5]) and blocks[0][1][0] == row[-1]


def test_empty_table(spark):
    df = T.align(spark.createDataFrame([], "doc_id long, text string"))
    assert df.count() == 0 and df.columns[-1] == "groups_sha256"
