"""The training sample holds texts of all lengths."""

from lexis.llm import labelled, mixing


def test_long_labelled_texts_are_used(spark):
    texts = ["a b " * (6000 if i % 5 == 0 else 10) + str(i) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got, y = labelled.sample(docs, labels, "quality", lambda k: labelled.fold(k, 1) == 0)
    assert sorted(got) == sorted(texts) and all(int(t.split()[-1]) % 2 == v for t, v in zip(got, y))
    assert sorted(mixing.labelled_domains(docs, labels)[0]) == sorted(texts)
    some, _ = labelled.sample(docs, labels, "quality", lambda k: labelled.fold(k, 1) == 0, 40, 2000)
    assert sum(map(len, some)) <= 80_000 and 0 < sum(len(t) > 20_000 for t in some) < 8
