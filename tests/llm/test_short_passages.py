"""Paragraphs of any length against brute-force Jaccard."""

import random

from cuelake.llm import passages


def shingles(line):
    w = line.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_short_and_straddling_paragraphs(spark):
    rng = random.Random(14)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)]
    lines = []
    for n in [*range(5, 60)] * 2:
        line = words(n)
        lines.append((line, line[: n - 1] + ["last"] if n > 20 else line))  # short ones are copied, others end otherwise
        lines.append((line + ["and", "more"], words(n)))
    rows = [(2 * k + side, " ".join(words(3)) + "\n" + " ".join(pair[side])) for k, pair in enumerate(lines) for side in (0, 1)]
    got = {r.doc_id for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t.split("\n")[1]) for i, t in rows}
    want = {i for i in sets if any(i != j and 5 * len(sets[i] & s) >= 4 * len(sets[i] | s) for j, s in sets.items())}
    blocks = {i for i, s in sets.items() if any(i != j and len(s & x) >= 30 for j, x in sets.items())}  # 34 equal words may be a block
    assert want <= got <= want | blocks and len([i for i in want if len(sets[i]) < 46]) > 100


def test_crowded_template(spark):
    rng = random.Random(15)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    base = words(30)
    rows = []
    for i in range(700):  # more than one block of rows, half of them mostly under 0.8 of each other
        line = list(base)
        for k in rng.sample(range(30) if i % 2 else (0, 1, 2, 27, 28, 29), 2):
            line[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(line)))
    sets = {i: shingles(t) for i, t in rows}
    want = {i for i in sets if any(i != j and 5 * len(sets[i] & s) >= 4 * len(sets[i] | s) for j, s in sets.items())}
    got = {r.doc_id for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(want) > 20
