"""Of each class one row stays, also where ids are null or repeated."""

from signalloom.llm import ngram_join


def test_classes_that_share_an_id(spark):
    texts = [" ".join(f"{name}{k}" for k in range(40)) for name in "abcdef"]
    a, b, c, d, e, f = texts
    rows = [(None, a), (None, b), (None, b.upper()), (7, c), (7, d), (9, d + " end"), (3, e), (None, e), (None, f), (1, f)]
    kept = [(r.doc_id, r.text) for r in ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    key = {t: t[0].lower() for _, t in rows}
    assert sorted(key[t] for _, t in kept) == list("abcdef")
    assert {key[t]: i for i, t in kept} == {"a": None, "b": None, "c": 7, "d": 7, "e": 3, "f": 1}
