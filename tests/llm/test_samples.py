"""What the classifiers are fitted on: bounded whatever is repeated, and calibration rows that the models haven't seen."""

from signalloom.llm import language_id, quality


def labelled(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("lang is not null")


def test_calibration_rows_are_unseen(spark):
    rows = language_id.dealt(labelled(spark)).collect()
    models, unseen = ({r.text for r in rows if r.unseen == u} for u in (False, True))
    assert models and unseen and not models & unseen
    for lang in {r.lang for r in rows}:
        mine = [r for r in rows if r.lang == lang]
        assert 0.15 < sum(r.unseen for r in mine) / len(mine) < 0.4


def test_a_language_of_few_rows_is_learned(spark):
    rows = language_id.dealt(spark.createDataFrame([(k, t, "xx") for k, t in enumerate(["a b", "a b", "c d", "e f"])] + [(9, "z", "yy")], "doc_id long, text string, lang string")).collect()
    assert len(rows) == 5 and {r.lang for r in rows if not r.unseen} == {"xx", "yy"}
    assert not any(r.unseen for r in rows)  # fewer than four texts all go to the models


def test_repeated_ids_don_t_make_the_sample_larger(spark):
    hot = spark.range(30_000).selectExpr("7 AS doc_id", "concat('word ', if(id < 20000, 0, id)) AS text", "'en' AS lang")
    assert language_id.dealt(hot).count() <= language_id.TRAIN_DOCS + language_id.CALIBRATION_DOCS
    assert language_id.dealt(hot, bytes_each=200).count() <= 40
    assert language_id.dealt(hot.limit(0)).count() == 0
    docs = hot.select("doc_id", "text")
    assert len(quality._collected(docs, 100)) == 100
    assert len(quality._collected(quality._some(docs, 30_000, 500, 2), 500)) <= 500


def test_samples_are_the_same_again(spark):
    first, again = (sorted(map(tuple, language_id.dealt(df, 50).collect())) for df in (labelled(spark), labelled(spark).repartition(7)))
    assert first == again and len(first) > 50
