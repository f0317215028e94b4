"""Columns whose names clash with the operators' own, repeated rows and repeated ids."""

import random

from pyspark.sql import functions as F

from cuelake.llm import jaccard, language_id, mixing, passages, pii, simhash


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def clashing(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return frame.withColumns({c: F.lit(7) for c in ("id", "fp", "hash", "text_hash", "key", "bands", "size", "rate", "copies", "target", "first", "root", "row", "flagged", "score")})


def test_clashing_columns_and_repeated_rows(spark):
    rng = random.Random(40)
    rows = [(i, words(rng, 30), "en", f"s{i % 2}") for i in range(20)]
    rows += [rows[3], rows[3], (20, rows[4][1], "en", "s0"), (21, None, None, None), (22, "call +1 (234) 567-8901", "en", "s1")]
    frame = clashing(spark, rows)
    found = simhash.near_duplicates(frame)
    assert found.columns == ["doc_id", "fp", "component_id"] and found.count() == len(rows)
    mixed = mixing.mix(frame).collect()
    assert len(mixed) == len(rows) and len({r.copies for r in mixed if r.doc_id == 3}) == 1
    model = language_id.train(language_id.bounded_sample(frame, "text", "lang"))
    told = language_id.predict(frame, model).collect()
    assert len(told) == len(rows) and len({(r.lang_pred, r.score) for r in told if r.doc_id == 3}) == 1
    for out in (mixing.expand(frame), pii.sanitise(frame), jaccard.keep_one(frame), simhash.keep_one(frame)):
        assert out.columns == frame.columns and {r.size for r in out.collect()} <= {7}
    clean = {r.doc_id: r.text for r in pii.sanitise(frame).collect()}
    assert clean[22] == "call [PHONE]" and clean[21] is None and clean[3] == rows[3][1]
    kept = sorted(r.doc_id for r in jaccard.keep_one(frame).collect())
    assert kept == [*range(20), 21, 22]


def test_passages_of_repeated_ids(spark):
    rng = random.Random(41)
    passage = words(rng, 60)
    rows = [(1, passage), (2, "x y\n" + passage), (2, "x y\n" + passage), (3, words(rng, 50)), (None, passage)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeated_passages(frame)
    assert {(r.doc_id, r.removed) for r in found.collect()} == {(1, False), (2, True)}
    left = passages.without_repeats(frame, found).filter("doc_id = 2").collect()
    assert len(left) == 2 and sum(passage[-40:] in r.text for r in left) == 0
