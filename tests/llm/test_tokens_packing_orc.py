import random
import zlib

import numpy as np
import pytest

from lexis.llm import packing, token_orc
from lexis.llm.tokens import Encoder, public_path

ODD = ["", "a  b", "a\t b", "a \n b", " a", "a ", "\n\na.b,c...d", "x\x02y", "don't we're ., ,", "<|endoftext|> hi",
       "_,a 5,6 ١,٢", "á, é.", "中文,字。", "\x1c a \x85b", "", "​ ,", "a\xa0b, \xa0c", None]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_encoding_is_exact(name):
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice("ab A1,.!'\n\t _é́\xa0") for _ in range(30)) for _ in range(500)]
    enc = Encoder(public_path(name), cache_pieces=200)  # small, so that it starts afresh on the way
    for lo in range(0, len(texts), 40):
        part = texts[lo:lo + 40]
        ids, ends = enc.encode(part)
        begin = 0
        for text, end in zip(part, ends):
            want = enc.tok.encode(text or "", add_special_tokens=False).ids + [1]
            assert ids[begin:end].tolist() == want, text
            begin = end


def test_piece_lengths():
    assert packing.piece_lengths(0) == []
    assert packing.piece_lengths(2048) == [2048]
    assert packing.piece_lengths(4099) == [2048, 2048, 2, 1]


ROWS = [(3, "the cat sat on the mat. " * 300, "x"), (1, None, "x"), (1, "", "y"), (2, "one two", None), (2, "one two", None),
        (None, "no id", "z")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumnRenamed("ids", "length")


def test_packing_round_trip(spark):
    enc = Encoder(public_path("byte_bpe_50k.json"))
    pieces = packing.pack(frame(spark)).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    assert all(p.offset == 0 and p.length & (p.length - 1) == 0 and p.length <= 2048 for p in pieces)
    by_doc = {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        by_doc.setdefault(p.doc_id, []).append(p)
    long = sorted(by_doc[3], key=lambda p: p.start)
    want = enc.tok.encode(ROWS[0][1], add_special_tokens=False).ids + [1]
    assert [p.start for p in long] == np.cumsum([0, *(p.length for p in long)])[:-1].tolist()
    assert np.frombuffer(b"".join(p.ids for p in long), "<u4").tolist() == want
    assert all(p.doc_tokens == len(want) for p in long)
    assert [p.length for p in by_doc[1]] == [1, 1]  # null and empty: the end id
    assert sum(p.length for p in by_doc[2]) == 2 * 3  # repeated rows are packed once each
    d = {(r.doc_id, r.start, r.ids_crc32) for r in packing.digest(packing.pack(frame(spark))).collect()}
    assert d == {(p.doc_id, p.start, zlib.crc32(p.ids)) for p in pieces}
    assert packing.pack(frame(spark, [])).collect() == []


def test_bucket_folders(spark, scratch):
    packing.write_buckets(packing.pack(frame(spark)), f"{scratch}/buckets")
    back = spark.read.parquet(f"{scratch}/buckets")
    assert back.where("length = 1").where("octet_length(ids) <> 4").count() == 0
    assert back.count() == packing.pack(frame(spark)).count()


def test_orc_round_trip_and_pruned_lookup(spark, scratch):
    enc = Encoder(public_path("word_bpe_49k.json"))
    token_orc.write_orc(frame(spark), f"{scratch}/orc")
    rows = token_orc.read_orc(spark, f"{scratch}/orc").collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 2, 3]
    start = 0
    for r in rows:
        assert r.start == start and r.n_tokens == len(r.ids)
        start += r.n_tokens
    assert rows[-1].ids == enc.tok.encode(ROWS[0][1], add_special_tokens=False).ids + [1]
    assert sorted(r.doc_id for r in token_orc.lookup(spark, f"{scratch}/orc", [2, 9]).collect()) == [2, 2]
    plan = token_orc.lookup(spark, f"{scratch}/orc", [2, 9])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan
    got = token_orc.digest(token_orc.read_orc(spark, f"{scratch}/orc")).collect()
    assert {(r.start, r.ids_crc32) for r in got} == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in rows}


def test_orc_has_bloom_filters_and_empty_table(spark, scratch):
    token_orc.write_orc(frame(spark), f"{scratch}/orc")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    file = next(f for f in spark.read.orc(f"{scratch}/orc/data").inputFiles())
    opts = jvm.org.apache.orc.OrcFile.readerOptions(conf)
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), opts)
    assert reader.getRowIndexStride() == 10_000
    stripe = reader.getStripes().get(0)
    footer = reader.rows().readStripeFooter(stripe) if hasattr(reader.rows(), "readStripeFooter") else None
    if footer is not None:
        assert "BLOOM_FILTER" in footer.toString()
    token_orc.write_orc(frame(spark, []), f"{scratch}/none")
    assert token_orc.read_orc(spark, f"{scratch}/none").collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_seen_often_are_not_learned_again(name):
    enc, learned = Encoder(public_path(name), cache_pieces=200), []
    learn = enc._learn
    enc._learn = lambda: (learned.extend(enc.index.queue), learn())
    usual = " ".join(f"w{chr(97 + i)}x" for i in range(26))
    for n in range(40):
        text = f"{usual} " + " ".join(f"q{chr(97 + n % 26)}{chr(97 + n // 26)}{chr(97 + i)}" for i in range(26))
        ids, ends = enc.encode([text, usual])
        plain = enc.tok.encode_batch([text, usual], add_special_tokens=False)
        assert ids.tolist() == [*plain[0].ids, 1, *plain[1].ids, 1] and int(ends[-1]) == len(ids)
        assert len(enc.index) <= 200 + 60
    assert max(learned.count(p) for p in set(learned)) == 1


def test_words_with_signs_and_accents_by_the_model_alone():
    rnd = random.Random(6)
    enc = Encoder(public_path("word_bpe_49k.json"))
    assert enc.bare("Cats,") == ("cats", ",") and enc.bare("\u00c9t\u00e9!?") == ("\u00c3\u00a9t\u00c3\u00a9", "!?") and enc.bare("don't") is None
    assert enc.bare("a1") is None and enc.bare("e\u0301a") is None and enc.bare("\u0130") is None and enc.bare("...") is None
    latin = [chr(c) for c in range(0xA0, 0x180)] + ["\u0301", "\u03a3", "\u4e2d"]
    for n in range(600):
        words = ["".join(rnd.choice("aeinstRE") if rnd.random() < 0.7 else rnd.choice(latin) for _ in range(rnd.randint(0, 9)))
                 + "".join(rnd.choice("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~7") for _ in range(rnd.randint(0, 3))) for _ in range(8)]
        text = rnd.choice((" ", "\n", "  ")).join(words) + rnd.choice(("", "<|endoftext|>", "\n\n", "\0", "\t"))
        got, ends = enc.encode([text, None, "", text], None)
        want = enc.tok.encode(text, add_special_tokens=False).ids
        assert got.tolist() == want * 2 and ends.tolist() == [len(want)] * 3 + [2 * len(want)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_plain_words_by_the_model_alone(name):
    rnd = random.Random(5)
    enc = Encoder(public_path(name))
    assert enc.bare
    for n in range(300):
        text = " ".join("".join(rnd.choice("abdeilnorstABIN") for _ in range(rnd.randint(1, 12))) for _ in range(8))
        assert enc.encode([text], None)[0].tolist() == enc.tok.encode(text, add_special_tokens=False).ids
