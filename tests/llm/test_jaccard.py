"""Near-duplicate texts against brute-force Jaccard."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cuelake.llm import jaccard, mixing, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b) and min(len(a), len(b)) > 0


def want(rows):
    """The ids that lead, by brute force: least id of each component, null last."""
    sets, label = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and similar(sets[i], sets[j]):
                label = [label[i] if x == label[j] else x for x in label]
    lead = {}
    for x, r in zip(label, rows, strict=True):
        lead[x] = min(lead.get(x, (True, 0, "")), (r[0] is None, r[0] or 0, r[1] or ""))
    return sorted((i if not none else None, t) for none, i, t in lead.values())


def edited(rng, text, n):
    w = text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = "".join(rng.choice("uvwxyz") for _ in range(6))
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    texts = [words(rng.randint(20, 300)) for _ in range(60)]
    near = [edited(rng, t, rng.randint(1, max(1, len(t.split()) // 30))) for t in texts for _ in range(2)]
    template = words(200)
    variants = [edited(rng, template, rng.randint(2, 12)) for _ in range(120)]  # on either side of 0.8 of each other
    return [(i, t, "en", "s", 1) for i, t in enumerate([*texts, *near, *variants, "a b", "A  b", "a c", "", None, texts[0].upper()])]


def test_stage_takes_jaccard(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = pipeline.near_duplicates(spark, frame, "")
    assert got.columns == frame.columns and sorted(r.doc_id for r in got.collect()) == [i for i, _ in want(rows)]
    assert len(want(rows)) < len(rows) - 100 and jaccard.keep_one(frame.limit(0)).count() == 0


@pytest.mark.parametrize(("block_rows", "listed", "stars"), [(256, 8, 3), (7, 8, 1), (7, 0, 1), (256, 0, 1), (7, 0, 2)])
def test_blocks_change_nothing(spark, rows, block_rows, listed, stars):
    sets = {i: shingles(t) for i, t, *_ in rows[180:300]}
    table = spark.createDataFrame([(i, sorted(hash(x) % 2**62 for x in s)) for i, s in sets.items()], "hash long, shingles array<long>")
    found = jaccard.links(table.select(F.lit(1).cast("long").alias("key"), "hash"), lambda hashes: table.join(hashes, "hash"), 0.8, block_rows, listed, stars)
    pairs = {(r.a, r.b) for r in found.collect()}
    assert all(similar(sets[a], sets[b]) for a, b in pairs)
    join = lambda ps: _components(sets, ps)
    assert join(pairs) == join([(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])])


def _components(nodes, pairs):
    label = {x: x for x in nodes}
    for a, b in pairs:
        old, new = label[a], label[b]
        label = {x: new if v == old else v for x, v in label.items()}
    groups = {}
    for x, v in label.items():
        groups.setdefault(v, set()).add(x)
    return sorted(map(sorted, groups.values()))


def test_null_and_repeated_ids(spark):
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b, c, d, e = (words(40) for _ in range(5))
    rows = [(None, a), (None, b), (None, b + " more"), (7, c), (7, d), (7, d), (8, e), (None, e), (9, None)]
    got = jaccard.keep_one(spark.createDataFrame([(*r, "en", None, None) for r in rows], SCHEMA))
    assert sorted(((r.doc_id or 0), r.text or "") for r in got.collect()) == sorted([(0, a), (0, min(b, b + " more", key=lambda t: spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0])), (7, c), (7, d), (8, e), (9, "")])


def test_simhash_keeps_null_and_repeated_ids(spark):
    rng = random.Random(7)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b, c, d, e = (words(40) for _ in range(5))
    rows = [(None, a), (None, b), (7, c), (7, d), (7, d), (8, e), (None, e)]
    got = simhash.keep_one(spark.createDataFrame([(*r, "en", None, None) for r in rows], SCHEMA))
    assert sorted(((r.doc_id or 0), r.text) for r in got.collect()) == sorted([(0, a), (0, b), (7, c), (7, d), (8, e)])


def test_mixing_keeps_null_and_repeated_ids(spark):
    rows = [(None if i % 3 == 0 else i // 3, "w " * (i + 5), "en", f"s{i % 2}" if i % 5 else None, None) for i in range(60)]
    rows += [(2, "x " * 200, "en", "s1", None), (2, "y " * 300, "en", "s0", None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    copies = {(r.doc_id, r.size): r.copies for r in mixing.mix(frame).collect()}
    got = {}
    for r in mixing.expand(frame).collect():
        at = (r.doc_id, len(r.text.split()))
        got[at] = got.get(at, 0) + 1
    assert len(copies) == len(rows) and got == {k: n for k, n in copies.items() if n} and any(i is None for i, _ in got)
