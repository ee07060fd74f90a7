"""Stacks are of all words of a text."""

from signalloom import plans


def test_stack_ids_of_whole_texts(spark, tmp_path):
    rows = [(1, "a b c d e f", "en", "s"), (2, "a b c d e g", "en", "s"), (4, "a b c d e f", "en", "s"), (5, "a b c d e", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = {r.seq: r.stack_id for r in plans.QUERIES["f6_stack_ids"](spark, str(tmp_path)).collect()}
    assert ids[1] == ids[4] and len({ids[1], ids[2], ids[5]}) == 3
