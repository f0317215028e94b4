"""Folds that take many groups a batch, against plain loops."""

import random

import numpy as np
import pyarrow as pa

from cuelake.operators import cues
from cuelake.operators.grouped import by_group, key_changes, whole_groups


def explained(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_key_changes():
    rows = pa.table({"a": [None, None, 1, 1, 2, 2], "b": ["x", "x", "x", "y", "y", "y"]})
    assert key_changes(rows, ["a", "b"]).tolist() == [False, False, True, True, True, False]


def test_whole_groups_at_any_batch_size():
    rng = random.Random(5)
    keys = [k for k in range(40) for _ in range(rng.choice([1, 1, 2, 30]))]
    for size in (1, 3, 7, 1000):
        for least in (1, 20):
            batches = pa.table({"k": keys}).to_batches(max_chunksize=size)
            tables = [t.column("k").to_pylist() for t in whole_groups(iter(batches), lambda t: key_changes(t, ["k"]), least)]
            assert sum(tables, []) == keys and all(a[-1] != b[0] for a, b in zip(tables, tables[1:], strict=False))
            assert all(len(t) >= least for t in tables[:-1])
    assert list(whole_groups(iter([]), lambda t: key_changes(t, ["k"]))) == []


def test_by_group(spark):
    rows = [(None if k == 3 else k, i) for k in range(9) for i in range(k)]
    random.Random(1).shuffle(rows)

    def fold(table):
        assert table.column("i").to_pylist() == sorted(table.column("i").to_pylist()) or len(set(table.column("k").to_pylist())) > 1
        return table.group_by("k", use_threads=False).aggregate([("i", "sum")]).select(["k", "i_sum"])

    got = by_group(spark.createDataFrame(rows, "k long, i long"), ["k"], ["i"], fold, "k long, i_sum long").collect()
    assert sorted((r.k or 3, r.i_sum) for r in got) == [(k, k * (k - 1) // 2) for k in range(1, 9)]


def test_sentences_split_together(spark):
    """As one after another by break_scores."""
    rng = random.Random(8)
    said = [[rng.choice(["the ", "quick ", "です。", "は", "12 ", "word, ", "x" * 50 + " ", "end. "]) for _ in range(rng.choice([1, 2, 9, 9, 30]))] for _ in range(80)]
    texts = sum(said, [])
    ends = np.cumsum([rng.choice([0.2, 0.4, 3]) for _ in texts])
    starts = ends - 0.15
    firsts = np.cumsum([0, *map(len, said)])
    expected = []
    for a, b in zip(firsts, firsts[1:], strict=False):
        todo = [(a, b)]
        while todo:
            i, j = todo.pop()
            if j - i < 2 or sum(map(cues.width_of, texts[i:j])) <= 42.05 and ends[j - 1] - starts[i] <= cues.MAX_DURATION:
                expected.append(i)
            else:
                k = i + 1 + int(cues.break_scores(texts[i:j], starts[i:j], ends[i:j]).argmax())
                todo += [(k, j), (i, k)]
    got = cues._split_all(np.array([cues._marks_of(t) for t in texts]).T, starts, ends, firsts[:-1], 42.05)
    assert got.tolist() == expected


def test_build_cues_reads_words_once(spark):
    """No stream a group, and no second reading of the words for cues that are polished by columns; two items with stretches in many batches."""
    rows = [(m, i, f"word{i % 7}. " if i % 5 == 4 else f"w{i % 11} ", i * 0.4 + (i // 50) * 2, i * 0.4 + (i // 50) * 2 + 0.3) for m in (1, 2) for i in range(300)]
    df = cues.build_cues(spark.createDataFrame(rows, "media_id long, ix long, text string, s double, e double"))
    plan = explained(df)
    assert "FlatMapGroups" not in plan and "CoGroup" not in plan and plan.split("== Initial Plan ==")[-1].count("MapInArrow") == 2
    whole = [(r.media_id, r.ix, r.start, r.end, r.src) for r in df.orderBy("media_id", "ix").collect()]
    before, most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), cues.WORDS
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        cues.WORDS = 1
        again = cues.build_cues(spark.createDataFrame(rows, "media_id long, ix long, text string, s double, e double"))
        assert [(r.media_id, r.ix, r.start, r.end, r.src) for r in again.orderBy("media_id", "ix").collect()] == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        cues.WORDS = most
    assert [x[1] for x in whole if x[0] == 2] == list(range(sum(x[0] == 2 for x in whole)))


def test_clusters_and_batches_share_streams(spark, tmp_path):
    """Neither clusters of edits nor batches of a job are a stream each, and windows are timed without a shuffle."""
    from cuelake.operators import jobs, replay

    rows = spark.createDataFrame([(m, i, i * 2.0, i * 2 + 1.5, f"text {m} {i}") for m in range(3) for i in range(12)], "media_id long, ix long, start double, end double, src string")
    edits = spark.createDataFrame([(m, n, "delete", ix) for m in range(2) for n, ix in enumerate((1, 2, 9, 10))], "media_id long, edit_ix long, kind string, ix long")
    found, refused = replay.apply_edits(rows, edits)
    assert "FlatMap" not in explained(found)
    assert [(r.media_id, r.old_ix) for r in found.orderBy("media_id", "ix").collect()] == [(m, i) for m in range(3) for i in range(12) if m == 2 or i not in (1, 2, 9, 10)]
    assert refused.count() == 0

    job = jobs.translate(rows, lambda b: {x["id"]: "x " + x["src"] for x in b}, f"{tmp_path}/ledger", size=1, rounds=1, waves=1)
    assert sorted((r.media_id, r.ix, r.tgt) for r in job.cues.collect()) == sorted((m, i, f"x text {m} {i}") for m in range(3) for i in range(12))
    assert {(r.media_id, r.requests) for r in job.usage.collect()} == {(m, 12) for m in range(3)}

    windows = spark.createDataFrame([(1, 1, "ab  c\td", 0.0, 4.0), (1, 2, "a long-er word, 12", 0.0, 13.0), (1, 3, None, 0.0, 1.0), (1, 4, "", 0.0, 1.0)], "media_id long, win_ix long, text string, s double, e double")
    timed = cues.proportional_words(windows)
    assert "Exchange" not in explained(timed)
    assert [(r.win_ix, r.text, round(r.s, 6), round(r.e, 6)) for r in timed.orderBy("win_ix", "ix").collect() if r.win_ix == 2] == [(2, "a ", 0.0, 1.0), (2, "long-er ", 1.0, 7.0), (2, "word, ", 7.0, 11.0), (2, "12", 11.0, 13.0)]
    assert {r.win_ix for r in timed.collect()} == {1, 2}


def test_stored_tables_leave_no_shuffle_files(spark):
    import glob

    from cuelake.llm.common import materialize

    local = spark.conf.get("spark.local.dir")
    held = lambda: set(glob.glob(f"{local}/**/shuffle_*.data", recursive=True))
    before = held()
    stored = materialize(spark.range(1000).repartition(4), "numbers")
    assert not held() - before
    assert stored.count() == 1000
