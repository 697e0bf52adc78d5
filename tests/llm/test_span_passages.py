"""Passages that spans of three units of 12 words would miss."""

import random

from lexis.llm import span_dedup

RND = random.Random(21)
VOCAB = [f"v{i}" for i in range(500)]


def windows(texts, n=50):
    """Windows of n words that occur more than once."""
    seen, twice = set(), set()
    for t in texts:
        w = (t or "").split()
        for j in range(len(w) - n + 1):
            k = tuple(w[j:j + n])
            (twice if k in seen else seen).add(k)
    return twice


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def removed(spark, texts):
    return [r.text for r in span_dedup.dedup(table(spark, texts)).orderBy("doc_id").collect()]


def restated(texts, run=3, least=12):
    """The rule with plain loops and texts as keys."""
    seen, out = set(), []
    for t in texts:
        parts, count = span_dedup.units(t)
        gone = set()
        for i in range(len(parts)):
            end = i + run
            while end <= len(parts) and sum(count[i:end]) < least:
                end += 1
            if end <= len(parts):
                key = tuple(p.strip() for p in parts[i:end])
                if key in seen:
                    gone.update(range(i, end))
                seen.add(key)
        out.append("".join(p for i, p in enumerate(parts) if i not in gone))
    return out


def test_passage_of_one_word_sentences(spark):
    passage = " ".join(w.upper() + "!!" for w in RND.sample(VOCAB, 60))
    lines = "\n".join(RND.choice(VOCAB) + "." * (i % 3) for i in range(80))
    texts = []
    for i in range(8):
        own = [" ".join(RND.sample(VOCAB, RND.randrange(1, 12))) + "." for _ in range(9)]
        own.insert(i, (passage if i % 2 else lines) + ("\n" if i % 3 else ". "))
        texts.append(" ".join(own))
    assert windows(texts)
    got = removed(spark, texts)
    assert got == restated(texts)
    assert windows(got) == set()
    assert sum(passage in t for t in got) == 1 and sum(lines in t for t in got) == 1


def test_loop_of_short_sentences_keeps_one_round(spark):
    round_ = "One. Two! Three? Four. Five! "
    text = "Words before the loop are here and stay. " + round_ * 30
    assert removed(spark, [text]) == restated([text])
    assert removed(spark, [text])[0].count("Three?") == 1


def test_units_without_words(spark):
    texts = ["\x0b\n" * 300 + "A. B. C.", "\x0b\n" * 3 + " ".join(f"{w}." for w in VOCAB[:20]), ". . .", "a. b."]
    assert removed(spark, texts) == restated(texts)


def test_passage_at_every_offset_in_a_sentence(spark):
    passage = " ".join(RND.sample(VOCAB, 60))
    texts = []
    for offset in range(12):
        before, after = RND.sample(VOCAB, 20 + offset), RND.sample(VOCAB, 20)
        texts.append(" ".join(["Start.", *before, passage, *after]) + ". End.")
        texts.append(" ".join(before[:offset] + [passage] + after[:5]))
    assert windows(texts)
    got = removed(spark, texts)
    assert got == restated(texts)
    assert windows(got) == set()
    assert sum(passage in t for t in got) == 1


def test_passage_after_an_inserted_and_a_dropped_word(spark):
    words = RND.sample(VOCAB, 200)
    texts = [" ".join(words), " ".join([*words[:70], "inserted", *words[70:]]), " ".join(words[:65] + words[66:])]
    assert windows(texts)
    got = removed(spark, texts)
    assert got == restated(texts)
    assert windows(got) == set() and got[0] == texts[0]


def test_cuts_follow_the_words():
    words = RND.sample(VOCAB, 80)
    whole = [p.strip() for p in span_dedup.units(" ".join(words))[0]]
    for drop in range(1, 25):
        rest = [p.strip() for p in span_dedup.units(" ".join(words[drop:]))[0]]
        assert rest[-4:] == whole[-4:]
    for text in ["na " * 500, "na na hey " * 200, "a  b\tc\n" * 3 + "d\x0be " * 40, " x y" * 30, "\u00a0x y" * 30]:
        parts, count = span_dedup.units(text)
        assert "".join(parts) == text and count == [len(p.split()) for p in parts] and max(count) <= 12


def test_spans_are_written_small(spark, monkeypatch):
    """The tables that hold most spans take the stronger compression: they and a shuffle are on disk at once."""
    from lexis.llm import span_dedup

    codecs, cut = {}, span_dedup.cut
    monkeypatch.setattr(span_dedup, "cut", lambda df, tag, codec="snappy": (codecs.setdefault(tag, codec), cut(df, tag, codec))[1])
    docs = spark.createDataFrame([(1, "one two three four five six. " * 4), (2, "one two three four five six. " * 4)], "doc_id long, text string")
    assert span_dedup.dedup(docs).count() == 2
    assert codecs["spans"] == codecs["some"] == "zstd"
