import random

from brute import contamination
from pyspark.sql import functions as F

from ocutide.llm import decontaminate as D


def check(spark, docs, texts, items, **options):
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in D.decontamination_digests(D.decontaminate(docs(texts), table, **options)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == contamination(t, items), t


def test_against_plain_python(spark, docs, monkeypatch):
    rng = random.Random(7)
    vocabulary = ["the", "of", "Écho", "écho", "x1", "lorem", "ipsum", "İx", "ΣΑΣ"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(10, sentence(25)), (2, sentence(12)), (3, "the"), (4, ""), (5, None), (6, sentence(12)), (7, "the of the of the of the of the of the of"), (8, "Only-Here words")]
    items.append((9, items[1][1]))
    t = ["", None, "THE", items[0][1].upper(), "a, " + items[1][1].replace(" ", ", ") + "!", "only here words", sentence(300), "the of " * 40, items[0][1] + " z " + items[0][1][:60]]
    check(spark, docs, t, items)
    monkeypatch.setattr(D, "FILTER_BITS", 64)  # nearly all words pass
    check(spark, docs, t, items)


def test_empty_tables_and_repeats(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    rows = D.decontamination_digests(D.decontaminate(docs(["a b c", None]), none)).collect()
    assert [r.n_hit for r in rows] == [0, 0] and sorted(r.n_words for r in rows) == [0, 3]
    one = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert D.decontaminate(docs([]), one).count() == 0
    same = docs([(1, "a b"), (1, "a b"), (None, "a b")]).withColumn("word", F.lit("x")).withColumn("win", F.lit(1))
    assert [r.n_hit for r in D.decontaminate(same, one).collect()] == [2, 2, 2]
