"""The training sample of language identification where one text is copied very often."""

from collections import Counter

from pyspark.sql import functions as F

from cuelake.llm import language_id


def test_copies_take_no_place(spark):
    rows = [(f"text {lang} {i} " + "word " * (i % 7), lang) for lang in ("aa", "bb", "cc") for i in range(200)] + [("only one", "dd")]
    hot = spark.range(30_000).select(F.lit("the hot text").alias("text"), F.lit("aa").alias("lang"))
    frame = spark.createDataFrame(rows, "text string, lang string").unionByName(hot)
    plain = lambda f: [(ids.tolist(), counts.tolist(), lang) for ids, counts, lang in language_id.bounded_sample(f, "text", "lang", 80)]
    got = plain(frame)
    assert len({str(x) for x in got}) == len(got) and Counter(lang for *_, lang in got) == {"aa": 20, "bb": 20, "cc": 20, "dd": 1}
    assert got == plain(frame.repartition(7))
    assert got == plain(frame.filter("text <> 'the hot text'").unionByName(hot.limit(1)))


def test_more_languages_than_texts(spark):
    rows = [(f"text {i} word", f"l{i:03}") for i in range(120)]
    got = language_id.bounded_sample(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", 80)
    assert sorted(lang for *_, lang in got) == sorted(lang for _, lang in rows)


def test_whole_texts_count(spark):
    text = " ".join(f"w{i}" for i in range(5000))
    (ids, counts, _), = language_id.bounded_sample(spark.createDataFrame([(text, "aa")], "text string, lang string"), "text", "lang")
    want = language_id.bucket_counts(text.encode())
    assert counts.sum() == want.sum() and (want[ids] == counts).all()
