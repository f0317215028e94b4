"""Small cases, random cases against plain loops, and invariants."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators import align, cues, edits, ranges, signal, translate
from cuelake.sources import subtitles
from cuelake.sources.export import ass_colour, ass_header, export_subtitles, safe_names
from cuelake.sources.subtitles import ingest_subtitles, media_info, parse_glossary, read_projects
from cuelake.streaming import streams


def test_sentence_ends(spark):
    cases = {"Hello.": True, 'He said "yes."': True, "Wait...": True, "Mr.": False, "J.": False, "It costs 3.": True, "e.g.": False, "はい。": True, "هل؟": True, "नमस्ते।": True, "comma,": False, "": False}
    rows = spark.createDataFrame(list(cases.items()), "text string, expected boolean")
    assert {r.text: r.x for r in rows.select("text", T.ends_sentence(F.col("text")).alias("x")).collect()} == cases
    assert {t: cues.sentence_ends(t) for t in cases} == cases


def test_times_and_width(spark):
    row = spark.createDataFrame([("01:02:03,5", "12:34.250", "x")], "a string, b string, c string")
    got = row.select(*[T.parse_time(F.col(c)) for c in "abc"]).first()
    assert tuple(got) == (3723.5, 754.25, None)
    assert spark.range(1).select(T.format_time(F.lit(3723.5)), T.display_width(F.lit("漢字 ab!"))).first() == ("01:02:03,500", 7.6)


def regions_by_loop(p):
    out, on, start = [], False, 0
    for i, x in enumerate([*p, -1]):
        if not on and x >= 0.45:
            on, start = True, i
        elif on and x < 0.3:
            on = False
            out.append([start * 0.032, i * 0.032])
    merged = []
    for s, e in out:
        if merged and s - merged[-1][1] < 0.2:
            merged[-1][1] = e
        else:
            merged.append([s, e])
    total = len(p) * 0.032
    return [(round(max(0, s - 0.06), 6), round(min(total, e + 0.06), 6)) for s, e in merged if e - s >= 0.08]


def test_regions_like_a_loop(spark):
    rng = random.Random(3)
    series = {m: [rng.random() if rng.random() < 0.3 else rng.choice([0.05, 0.9]) for _ in range(200)] for m in range(8)}
    frames = spark.createDataFrame([(m, i, p) for m, ps in series.items() for i, p in enumerate(ps)], "media_id long, frame_ix long, p double")
    got = {}
    for r in signal.speech_regions(frames).orderBy("media_id", "region_ix").collect():
        got.setdefault(r.media_id, []).append((round(r.s, 6), round(r.e, 6)))
    assert got == {m: x for m, ps in series.items() if (x := regions_by_loop(ps))}


def test_windows_tile(spark):
    rng = random.Random(5)
    frames = spark.createDataFrame([("a", i, float(rng.random() < 0.7)) for i in range(3000)], "media_id string, frame_ix long, p double")
    wins = signal.plan_windows(frames, max_len=10.0).orderBy("win_ix").collect()
    assert wins[0].s == 0 and abs(wins[-1].e - 96) < 1e-6
    assert all(abs(a.e - b.s) < 1e-9 for a, b in zip(wins, wins[1:], strict=False)) and all(0 < w.e - w.s <= 15 for w in wins)
    chunks = signal.group_windows(signal.plan_windows(frames, max_len=10.0), 20, 30).orderBy("chunk_ix").collect()
    assert chunks[0].w_from == 0 and chunks[-1].w_to == len(wins) and all(a.w_to == b.w_from for a, b in zip(chunks, chunks[1:], strict=False))


def test_polish(spark):
    """Cases by hand, then what must hold of any cues: no overlap, a tenth of a second at least, nothing cut short that had room."""
    by_hand = {
        0: ([(10.0, 10.2), (20.0, 26.0)], [(9.95, 10.85), (19.95, 26.3)]),  # each lingers; the short one grows to 0.9 s
        1: ([(1.0, 1.3), (1.5, 4.0)], [(0.65, 1.39), (1.45, 4.3)]),  # no room after: it begins 0.3 s earlier
        2: ([(0.0, 0.02), (0.02, 0.04)], [(0.0, 0.1), (0.1, 0.9)]),  # both begin at zero: the second is pushed
        3: ([(5.0, 8.0), (6.0, 9.0)], [(4.95, 5.95), (5.95, 9.3)]),  # an overlap is trimmed
    }
    rng = random.Random(7)
    items = {m: x for m, (x, _) in by_hand.items()}
    for m in range(10, 50):
        t, items[m] = 0.0, []
        for _ in range(rng.randint(1, 40)):
            t += rng.choice([0.0, 0.01, 0.4, 2.0])
            items[m].append((round(t, 3), round(t + rng.choice([0.02, 0.5, 6.0]), 3)))
            t = items[m][-1][1]
    rows = spark.createDataFrame([(m, i, s, e) for m, x in items.items() for i, (s, e) in enumerate(x)], "media_id long, ix long, start double, end double")
    got = {}
    for r in cues.polish(rows).orderBy("media_id", "ix").collect():
        got.setdefault(r.media_id, []).append((round(r.start, 3), round(r.end, 3)))
    for m, (_, wanted) in by_hand.items():
        assert got[m] == wanted, m
    for m, x in items.items():
        assert len(got[m]) == len(x) and all(e - s >= 0.0995 for s, e in got[m]) and all(a[1] <= b[0] for a, b in zip(got[m], got[m][1:], strict=False)), m
        for k, ((s, e), (s2, e2)) in enumerate(zip(x, got[m], strict=True)):
            alone = (k == 0 or s - x[k - 1][1] >= 2) and (k + 1 == len(x) or x[k + 1][0] - e >= 2)
            assert not alone or (s2, e2) == (round(max(0.0, s - 0.05), 3), round(max(e + 0.3, max(0.0, s - 0.05) + 0.9), 3))


def test_polish_in_chains(spark):
    """Folding over chains gives what one pass over the whole item gives, and few cues are in a chain of several."""
    rng, rows, t = random.Random(8), [], 0.0
    for i in range(3000):
        t += rng.choice([0.02, 0.05, 0.9, 1.5, 4.0, 4.0, 4.0])
        rows.append(("m", i, round(t, 3), round(t + rng.choice([0.05, 0.4, 1.0, 2.5]), 3)))
    df = spark.createDataFrame(rows, "media_id string, ix long, start double, end double")
    local = cues.polished(df).orderBy("ix").collect()
    starts, ends = cues.without_overlap(np.array([r.start for r in local]), np.array([r.end for r in local]))
    got = cues.polish(df).orderBy("ix").collect()
    assert np.allclose([r.start for r in got], starts) and np.allclose([r.end for r in got], ends) and got[0].__fields__ == df.columns


def test_build_cues(spark):
    text = "Hello there, this is quite a long sentence that will have to be split somewhere because it does not fit. Mr. Smith said no. Yes!"
    words = [("a", i, w + " ", i * 0.32, i * 0.32 + 0.3) for i, w in enumerate(text.split())]
    got = cues.build_cues(spark.createDataFrame(words, "media_id string, ix long, text string, s double, e double")).orderBy("ix").collect()
    assert " ".join(r.src for r in got).split() == text.split() and [r.ix for r in got] == list(range(len(got)))
    assert all(cues.width_of(r.src) <= 42 for r in got) and all(r.start < r.end for r in got)


def cue(start, end, text):
    return cues.Cue(start, end, text, cues.width_of(text))


def test_random_words_keep_their_text(spark):
    rng = random.Random(21)
    rows = []
    for m in range(6):
        t = 0.0
        for i in range(300):
            word, n = rng.choice(["uh ", "yes. ", "the ", "quick ", "はい", "です。", "Mr. ", "12 ", "ah, ", "compound "]), rng.choice([0.05, 0.2, 0.4])
            rows.append((m, i, word, t, t + n))
            t += n + rng.random() * 1.5
    got = {}
    for r in cues.build_cues(spark.createDataFrame(rows, "media_id long, ix long, text string, s double, e double"), 20).orderBy("media_id", "ix").collect():
        got.setdefault(r.media_id, []).append(r)
    for m, found in got.items():
        assert all(a.end <= b.start for a, b in zip(found, found[1:], strict=False)) and all(r.start < r.end for r in found)
        kept = "".join("".join(c for c in r.src if c.isalnum()) for r in found)
        words = ["".join(c for c in w if c.isalnum()) for x, _, w, *_ in rows if x == m]
        rest = iter(kept)
        assert all(any(c == x for x in rest) for c in "".join(w for w in words if w not in ("uh", "ah")))  # interjections alone may go


def test_tiny_cues():
    join = lambda *cs: [(c.start, c.end, c.text) for c in cues.join_tiny([cue(*c) for c in cs], 42)]
    assert join((0, 0.2, "a "), (0.3, 2, "longer one")) == [(0, 2, "a longer one")]
    assert join((0, 2, "longer one "), (2.1, 2.3, "a "), (5, 7, "another long one")) == [(0, 2.3, "longer one a "), (5, 7, "another long one")]
    assert join((0, 0.2, "a "), (2, 4, "far from it")) == [(0, 0.2, "a "), (2, 4, "far from it")]
    assert join((0, 0.2, "a "), (0.25, 0.4, "b "), (0.5, 0.6, "c")) == [(0, 0.6, "a b c")]
    assert join((0, 2, "x" * 40), (2.1, 2.2, "yes"), (2.3, 4, "z" * 40)) == [(0, 2, "x" * 40), (2.1, 2.2, "yes"), (2.3, 4, "z" * 40)]


def test_vocal_cues():
    tidy = lambda *cs: [(c.start, c.end, c.text) for c in cues.tidy_vocal([cue(*c) for c in cs], 42)]
    assert tidy((0, 0.2, "あっ"), (5, 5.2, "はい")) == [(5, 5.2, "はい")]
    assert tidy((0, 0.2, "uh"), (0.3, 2, "what is it")) == [(0, 2, "uh what is it")]
    assert tidy((0, 2, "what is it"), (2.1, 2.3, "uh"), (2.5, 4, "well")) == [(0, 2.3, "what is it uh"), (2.5, 4, "well")]
    assert tidy((0, 1, "ah,"), (1.1, 2, "Ah"), (2.1, 3, "ah"), (9, 10, "so")) == [(0, 3, "ah, Ah ah"), (9, 10, "so")]
    assert [cues.is_vocal(x) for x in ("oh, ah!", "ohm", "啊啊", "ah 3", "...", "mm 嗯", "a")] == [True, False, True, False, False, True, False]
    assert [cues.is_answer(x) for x in ("はいっ", "oh, yes!", "yesterday", "OK", "嗯")] == [True, True, False, True, True]
    assert cues.compressed("ah, ah, ah, ah, ah, ah") == "ah, ah, ah, ah…" and cues.compressed("ah, ah, ah, ah, ah") == "ah, ah, ah, ah, ah"


def test_best_breaks():
    def score(texts, times, k):
        widths = [cues.width_of(t) for t in texts]
        left, total, gap = sum(widths[:k]), sum(widths), max(0, times[k][0] - times[k - 1][1])
        before, after = texts[k - 1].strip(), texts[k].strip()
        x = -3 * abs(2 * left - total) / total + 3 * min(gap, 1)
        x += 4 if cues.sentence_ends(texts[k - 1]) else 2.2 if before[-1:] in cues.WEAK else 0
        x -= 1.5 * (before.lower() in cues.GLUE_WORDS) + 2.5 * (after in cues.PARTICLES)
        return x - 3 * (round(min(left, total - left), 6) < 6 and gap < 0.6)

    rng = random.Random(22)
    for _ in range(200):
        texts = [rng.choice(["the ", "house, ", "end. ", "は", "今日", "wonderful ", "a ", "て"]) for _ in range(rng.randint(2, 15))]
        times, t = [], 0.0
        for _ in texts:
            times.append((t, t + 0.2))
            t += 0.2 + rng.choice([0, 0.1, 0.7, 1.5])
        starts, ends = (np.array(x) for x in zip(*times, strict=True))
        got = cues.break_scores(texts, starts, ends)
        assert got == pytest.approx([score(texts, times, k) for k in range(1, len(texts))])


def test_intervals(spark):
    rng = random.Random(2)
    make = lambda n: [("m", i, s := rng.uniform(0, 100), s + rng.choice([0.5, 5, 50, 5000, 4e5])) for i in range(n)]
    a, b = make(40), make(40)
    got = ranges.overlaps(spark.createDataFrame(a, "media_id string, a_ix long, s double, e double"), spark.createDataFrame(b, "media_id string, b_ix long, s double, e double"), 7.0)
    want = {(x[1], y[1]) for x in a for y in b if x[3] > y[2] and x[2] < y[3]}
    rows = [(r.a_ix, r.b_ix) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_edits(spark):
    rows = spark.createDataFrame([("m", i, i * 2.0, i * 2.0 + 1, f"text {i}") for i in range(5)], "media_id string, ix long, start double, end double, src string")
    assert edits.delete(rows, rows.filter("ix = 1")).count() == 4
    moved = edits.retime(rows, spark.createDataFrame([("m", 2, 0.0, 99.0)], "media_id string, ix long, new_start double, new_end double")).filter("ix = 2").first()
    assert (moved.start, moved.end) == (3.0, 6.0)
    assert edits.insert_after(rows, spark.createDataFrame([("m", 0, "new")], "media_id string, ix long, src string")).filter("src = 'new'").first().ix == 1
    commits = edits.commit_revision(spark.createDataFrame([("p", 3)], "id string, rev int"), spark.createDataFrame([("p", 3, False), ("p", 2, False), ("p", 1, True), ("q", 0, False)], "id string, base_rev int, force boolean"))
    assert sorted((r.id, r.base_rev, r.accepted, r.rev) for r in commits.collect()) == [("p", 1, True, 4), ("p", 2, False, 3), ("p", 3, True, 4), ("q", 0, True, 1)]


def test_fix_guard(spark):
    good = [("I sea the ship", "I see the ship"), ("今日は天汽がいい", "今日は天気がいい"), ("きょうはいい天気", "今日はいい天気")]
    bad = [("I love you", "I hate you"), ("at 8 today", "at 9 today"), ("I do", "I do not"), ("same", "same"), ("a b c", ""), ("三人来了", "二人来了"), ("我去", "我不去"), ("one two three four", "five six seven eight"), (None, "x"), ("x", None)]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(good + bad)], "ix long, old string, new string")
    assert [r.ok for r in translate.guard_fixes(rows).orderBy("ix").collect()] == [True] * len(good) + [False] * len(bad)
    fixed = spark.createDataFrame([("m", 0, "I sea the ship", None), ("m", 1, "I love you", "I luv you"), ("m", 2, None, None)], "media_id string, ix long, src string, src_orig string")
    fixes = spark.createDataFrame([("m", 0, "I see the ship"), ("m", 1, "I hate you"), ("m", 2, "x")], "media_id string, ix long, new string")
    assert [(r.src, r.src_orig) for r in translate.apply_fixes(fixed, fixes).orderBy("ix").collect()] == [("I see the ship", "I sea the ship"), ("I love you", "I luv you"), (None, None)]


def collapsed_by_loop(text, keep=2):
    """The shortest unit of up to twelve characters that comes four times or more, from left to right, until nothing changes."""
    while True:
        out, i = "", 0
        while i < len(text):
            for n in range(1, 13):
                unit, times = text[i : i + n], 1
                while len(unit) == n and text[i + times * n : i + (times + 1) * n] == unit:
                    times += 1
                if times >= 4:
                    out += (unit * keep).rstrip("、，,。. ") + "…" if any(c.isalpha() for c in unit) else unit * times
                    i += times * n
                    break
            else:
                out, i = out + text[i], i + 1
        if out == text:
            return out
        text = out


def test_collapse_repeats(spark):
    rng = random.Random(23)
    cases = ["no " * 16, "哈" * 16, "no no", "1111111", "-a-a-a-a-a", "aaaa aaaa aaaa aaaa aaaa", "ha, " * 5 + "ho, " * 5, "\n\n\n\n\nx\nx\nx\nx\n"]
    cases += ["".join(rng.choice(["a", "b", " ", ",", "ab", "1", "哈"]) * rng.choice([1, 1, 2, 4, 6]) for _ in range(12)) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)] + [(9999, None)], "ix long, text string")
    got = {r.ix: r.text for r in translate.collapse_repeats(rows).collect()}
    assert got.pop(9999) is None and got == {i: collapsed_by_loop(t) for i, t in enumerate(cases)}
    assert got[0] == "no no…" and got[1] == "哈哈…" and got[3] == "1111111"


def test_replies(spark):
    body = spark.createDataFrame([("m", '```json\n{"t": {"1": "one", "[2]": "two", "3": 5, "x": "no"}}\n```'), ("n", 'Sure! {"1": "eins"} done'), ("o", "nothing")], "media_id string, body string")
    assert sorted((r.media_id, r.ix, r.text) for r in translate.parse_replies(body).collect()) == [("m", 1, "one"), ("m", 2, "two"), ("n", 1, "eins")]


def test_translate_retries(spark, tmp_path):
    rows = spark.createDataFrame([("m", i, f"line number {i}") for i in range(6)] + [("m", 6, "...")], "media_id string, ix long, src string")
    fn = lambda batch: {x["id"]: x["src"] if x["src"].endswith("3") else "t " + x["src"] for x in batch if not (len(batch) > 3 and x["src"].endswith("5"))}
    got = {r.ix: (r.tgt, r.attempts) for r in translate.translate_corpus(rows, fn, f"file://{tmp_path}", size=6).collect()}
    assert got[0] == ("t line number 0", 1) and got[5] == ("t line number 5", 2) and got[3] == ("line number 3", 3) and got[6] == ("", 0)


def test_align():
    long, shorts = "Hello there my friend. How are you today? Fine.", ["hello their my frend", "how are you", "fine"]
    parts = align.distribute(long, shorts)
    assert "".join("".join(parts).split()) == "".join(long.split()) and all(w in long.split() for p in parts for w in p.split())
    assert align.distribute("今日はいい天気ですね。散歩に行きましょう。はい。", ["今日はいい天気", "散歩に行きま", "はい"]) == ["今日はいい天気ですね。", "散歩に行きましょう。", "はい。"]
    assert align.distribute("abc", []) == [] and align.distribute("", ["a", "b"]) == ["", ""]


def test_long_texts_are_tied_together():
    """An hour of speech against a version with errors: the blocks are increasing, true, and nearly all of what is equal."""
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(9000)]
    other = [w if rng.random() > 0.05 else rng.choice(["", w + "x", w[::-1]]) for w in words]
    other[3000:3100] = []
    a, b = "".join(words), "".join(other)
    blocks = align._matching(a, b)
    assert all(a[i : i + n] == b[j : j + n] for i, j, n in blocks)
    assert all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in zip(blocks, blocks[1:], strict=False))
    assert sum(n for *_, n in blocks) > 0.93 * len(b)
    shorts = [" ".join(other[k : k + 30]) for k in range(0, len(other), 30)]
    parts = align.distribute(" ".join(words), shorts)
    assert "".join("".join(parts).split()) == a and sum(abs(len(p) - len(s)) < 25 for p, s in zip(parts, shorts, strict=True)) > 0.95 * len(shorts)
    assert align._matching("ab" * 5000, "xy" * 5000) == [(10000, 10000, 0)]


def test_attach_times(spark):
    """A token owns the text from its first letter to the next one's; marks of its own don't count, and lost letters move nothing."""
    texts = [("m", 0, "“Hi, you there!”"), ("m", 1, "今日は、いい天気"), ("m", 2, "one two three"), ("m", 3, None), ("m", 4, "no tokens")]
    tokens = [("m", 0, 0, "Hi", 0.0, 1.0), ("m", 0, 1, "...", 1.0, 1.1), ("m", 0, 2, "you", 1.0, 2.0), ("m", 0, 3, "there", 2.0, 3.0), ("m", 0, 4, "more", 3.0, 4.0)]
    tokens += [("m", 1, k, t, k * 1.0, k + 1.0) for k, t in enumerate(["今日", "は", "いい", "天気"])]
    tokens += [("m", 2, 0, "one", 0.0, 1.0), ("m", 2, 1, "xyz", 1.0, 2.0), ("m", 2, 2, "three", 2.0, 3.0), ("m", 3, 0, "x", 0.0, 1.0)]
    found = align.attach_times(spark.createDataFrame(texts, "media_id string, win_ix long, text string"), spark.createDataFrame(tokens, "media_id string, win_ix long, token_ix long, token string, s double, e double"))
    got = {}
    for r in found.orderBy("win_ix", "ix").collect():
        got.setdefault(r.win_ix, []).append((r.text, r.s, r.e))
    assert got[0] == [("“Hi, ", 0.0, 1.0), ("you ", 1.0, 2.0), ("there!”", 2.0, 3.0)]
    assert [t for t, *_ in got[1]] == ["今日", "は、", "いい", "天気"] and got[1][3][1:] == (3.0, 4.0)
    assert got[2] == [("one ", 0.0, 1.0), ("two ", 1.0, 2.0), ("three", 2.0, 3.0)] and set(got) == {0, 1, 2}


def test_pick(spark):
    cases = [
        ("hello world", "hello word", 2.0, "hello world"), ("", "abc", 1.0, "abc"), (None, None, 1.0, ""), ("x" * 100, "", 1.0, ""), ("a few words", "", 2.0, "a few words"),
        ("Before it all. Hello dear world! And after", "Hello dear world", 3.0, "Hello dear world!"), ("hi", "something else entirely", 3.0, "something else entirely"), ("z" * 60, "abc", 1.0, "abc"), ("z" * 60, "abc", 9.0, "z" * 60),
    ]
    rows = spark.createDataFrame([(i, a, b, 0.0, e) for i, (a, b, e, _) in enumerate(cases)], "ix long, long string, local string, s double, e double")
    assert [r.text for r in align.pick(rows).orderBy("ix").collect()] == [x[3] for x in cases]


def test_wrap():
    rng = random.Random(24)
    text = "the quick brown fox jumps over the lazy dog and a verylongwordindeedthatmustbreak"
    lines = align.wrap(text, 20, True)
    assert all(cues.width_of(x) <= 20 for x in lines) and "".join(lines).replace(" ", "") == text.replace(" ", "")
    for _ in range(150):
        words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 25))]
        plain, even = align.wrap(" ".join(words), 20), align.wrap(" ".join(words), 20, True)
        assert len(even) == len(plain) and " ".join(even) == " ".join(words) and max(map(cues.width_of, even)) <= max(map(cues.width_of, plain))
        widest = max(map(cues.width_of, even))
        if len(plain) > 1:  # no narrower limit does
            assert len(align.wrap(" ".join(words), widest - 0.05)) > len(plain) or any(cues.width_of(w) > widest - 0.05 for w in words)
    assert all(x[0] not in align.NO_START for x in align.wrap("「今日は、いい天気ですね。」と言った。「そうですね。」", 12)) and align.wrap(" \n ", 10) == []


def test_repair_timings(spark):
    """Cases by hand over two stretches of speech, [0, 1.024) and [2.944, 4.0); `abcd` takes 0.55 s."""
    frame = [(k, 0.9 if k <= 30 or 93 <= k <= 123 else 0.0) for k in range(320)]
    cases = {
        0: ([("abcd", 0.0, 4.1), ("ab", 4.2, 4.4)], [(3.285, 4.0), (4.2, 4.4)]),  # the next word is near: the last stretch
        1: ([("ab", 0.0, 0.1), ("abcd", 0.2, 4.1), ("ab", 9.0, 9.2)], [(0.0, 0.1), (0.2, 0.915), (9.0, 9.2)]),  # the word before is near: the first one
        2: ([("abcd", 0.0, 4.1)], [(2.944, 3.769)]),  # neither is: the longest one
        3: ([("abcd", 4.5, 6.0)], [(4.5, 5.05)]),  # no speech inside: what the text takes
        4: ([("abcd", 1.0, 1.4), ("ab", 0.5, 0.7), ("ab", 2.0, 2.0)], [(1.0, 1.4), (1.0, 1.24), (2.0, 2.24)]),  # a start going back, and a word without length
    }
    rng = random.Random(25)
    words = {m: w for m, (w, _) in cases.items()}
    for m in range(10, 22):
        t, words[m] = 0.0, []
        for _ in range(40):
            n = rng.choice([0.0, 0.2, 0.4, 3.0, 5.0])
            words[m].append(("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9))), round(max(0.0, t), 3), round(t + n, 3)))
            t += n + rng.choice([-0.2, 0.0, 0.1, 0.5])
    frames = spark.createDataFrame([(m, k, p) for m in cases for k, p in frame] + [(m, k, rng.choice([0.0, 0.9])) for m in words if m >= 10 for k in range(3000)], "media_id long, frame_ix long, p double")
    given = spark.createDataFrame([(m, i, *w) for m, ws in words.items() for i, w in enumerate(ws)] + [(99, 0, "alone", 1.0, 1.2)], "media_id long, ix long, text string, s double, e double")
    got = {}
    for r in align.repair_timings(given, frames).orderBy("media_id", "ix").collect():
        got.setdefault(r.media_id, []).append((r.s, r.e))
    assert got.pop(99) == [(1.0, 1.2)]
    for m, (_, wanted) in cases.items():
        assert np.allclose(got[m], wanted, atol=0.0011), (m, got[m])
    for m, ws in words.items():
        assert len(got[m]) == len(ws) and all(a[0] <= b[0] for a, b in zip(got[m], got[m][1:], strict=False)), m
        for (text, s, e), (s2, e2) in zip(ws, got[m], strict=True):
            longest = 1.6 * (0.075 * len(text) + 0.25) + 0.6
            assert e2 > s2 and s2 >= s - 1e-9 and (e - s > longest or e2 <= max(e, s2 + max(0.12, 0.6 * (0.075 * len(text) + 0.25))) + 0.0011)


def worth_of_cuts(p, begin, max_len):
    """What each place between a fifth of max_len and max_len after begin is worth as a cut: seconds, worth."""
    level = np.convolve(p, np.ones(5), "same") / 5
    low, high, goal = (int((begin + share * max_len) / 0.032) for share in (0.2, 1.0, 0.6))
    high = min(high, len(p) - 1)
    runs = np.split(np.arange(len(p)), np.flatnonzero(np.diff(level < 0.2)) + 1)
    found = [(f, -30 - 20 * level[f]) for f in range(low, high) if level[f] >= 0.2]
    for run in (r for r in runs if level[r[0]] < 0.2 and r[-1] >= low and r[0] < high):
        inside = run[(run >= low) & (run < high)]
        place = goal if goal in inside else inside[len(inside) // 2]
        found.append((place, 10 * min(len(run) * 0.032, 3.0)))
    return [((f + 0.5) * 0.032, w - 0.12 * 0.032 * abs(f - goal)) for f, w in found]


def test_best_cuts(spark):
    rng = random.Random(26)
    series = {m: [rng.random() if rng.random() < 0.8 else 0.0 for _ in range(2500)] for m in range(4)}
    for m in series:
        for _ in range(6):
            k = rng.randrange(2400)
            series[m][k : k + rng.randint(3, 15)] = [0.0] * rng.randint(3, 15)
    rows = spark.createDataFrame([(m, 0.0, len(p) * 0.032, k, x) for m, p in series.items() for k, x in enumerate(p)], "media_id long, s double, e double, frame_ix long, p double")
    places = {}
    for r in signal.cut_places(rows).collect():
        places.setdefault(r.media_id, []).append((r.first, r.stop, r.worth))
    for m, p in series.items():
        got = signal.best_cuts(*(np.array(x) for x in zip(*sorted(places[m]), strict=True)), len(p) * 0.032, 20.0)
        assert len(p) * 0.032 - got[-1] <= 20.0
        for begin, cut in zip([0.0, *got[:-1]], got, strict=True):  # of all places, none is worth more than the one taken
            every = dict(worth_of_cuts(p, begin, 20.0))
            assert min(every, key=lambda x: abs(x - cut)) == pytest.approx(cut) and every[min(every, key=lambda x: abs(x - cut))] >= max(every.values()) - 1e-9


def test_batches(spark):
    rng = random.Random(27)
    items = {m: [rng.random() < 0.2 for _ in range(n)] for m, n in enumerate((1, 5, 39, 40, 41, 130, 200, 400))}
    rows = spark.createDataFrame([(m, i * 3, "so." if e else "so") for m, x in items.items() for i, e in enumerate(x)], "media_id long, ix long, src string")
    got = {}
    for r in translate.plan_batches(rows).orderBy("media_id", "ix").collect():
        got.setdefault(r.media_id, []).append(r.batch_ix)
    for m, ends in items.items():
        n = len(ends)
        cuts = [k for k in range(1, n + 1) if k == n or got[m][k] != got[m][k - 1]]
        assert got[m] == sorted(got[m]) and got[m][0] == 0 and got[m][-1] == len(cuts) - 1
        for begin, cut in zip([0, *cuts[:-1]], cuts, strict=True):
            stops = {k: abs(k - begin - 40) for k in range(begin + 32, min(begin + 48, n) + 1) if ends[k - 1]}
            if n - begin <= 40:
                assert cut == n  # what is left is one batch
            elif stops:
                assert stops.get(cut) == min(stops.values()) and cut == max(k for k in stops if stops[k] == stops[cut])
            else:
                assert cut == begin + 40


SRT = "1\n00:00:01,000 --> 00:00:02,000\n<i>Hello</i>\n\n2\n00:00:03,000 --> 00:00:04,000\n你好\nWorld\n"


def test_subtitle_files(spark):
    ass = "[Script Info]\n[Events]\nFormat: Layer, Start, End, Style, Text\nDialogue: 0,0:00:01.00,0:00:02.50,D,Hi, you\\Nthere\nComment: 0,0:00:05.00,0:00:06.00,D,no\n"
    vtt = "WEBVTT\n\nNOTE a remark\n\n00:01.000 --> 00:02.000\na &lt; b\n\n00:01.500 --> 00:03.000\nnext\n"
    files = [("a.srt", SRT.encode("utf-8-sig")), ("b.ass", ass.encode()), ("c.vtt", vtt.encode()), ("d.srt", SRT.replace("Hello", "世界上的人們都很好").encode("big5")), ("e.srt", SRT.encode("utf-16-le")), ("f.srt", b"")]
    got, stats = ingest_subtitles(spark.createDataFrame(files, "path string, content binary"))
    texts = {}
    for r in got.orderBy("path", "ix").collect():
        texts.setdefault(r.path, []).append((r.start, r.end, r.src, r.tgt))
    assert texts["a.srt"] == [(1.0, 2.0, "Hello", ""), (3.0, 4.0, "World", "你好")]
    assert texts["b.ass"] == [(1.0, 2.5, "Hi, you there", "")]
    assert texts["c.vtt"] == [(1.0, 1.5, "a < b", ""), (1.5, 3.0, "next", "")]
    assert texts["d.srt"][0][2] == "世界上的人們都很好" and texts["e.srt"] == texts["a.srt"]
    assert {r.path: r.trimmed for r in stats.collect()}["c.vtt"] == 1


def test_exports(spark):
    """Cases of the formats: numbers after the filter, texts that would break a cue, both tracks, an hour and more."""
    given = [("m", 0, 1.0, 2.5, "Hello", "你好"), ("m", 1, 3661.2345, 3662.0, "a --> b\n\n  c", ""), ("m", 2, 5.0, 6.0, "", "")]
    rows = spark.createDataFrame(given, "media_id string, ix long, start double, end double, src string, tgt string")
    text = lambda fmt, content, order="tgt-top", of=rows, **more: export_subtitles(of, fmt, content, order, **more).first().document
    assert text("srt", "dual") == "1\n00:00:01,000 --> 00:00:02,500\n你好\nHello\n\n2\n01:01:01,235 --> 01:01:02,000\na → b\nc\n"
    assert text("srt", "tgt") == "1\n00:00:01,000 --> 00:00:02,500\n你好\n"
    assert text("srt", "dual", "src-top").startswith("1\n00:00:01,000 --> 00:00:02,500\nHello\n你好\n")
    marked = spark.createDataFrame([("m", 0, 0.0, 1.0, " a < b & c\r\n \t\n d\u3000", "")], rows.schema)
    assert text("vtt", "src", of=marked) == "WEBVTT\n\n1\n00:00:00.000 --> 00:00:01.000\na &lt; b &amp; c\nd\n"
    assert text("txt", "src", "src-top") == "[00:01] Hello\n[1:01:01] a --> b\n        \n          c"
    long_one = spark.createDataFrame([("m", 0, 0.0, 1.0, "one two three four", "")], rows.schema)
    assert text("srt", "src", of=long_one, width=9).endswith("\none two\nthree\nfour\n")


def test_ass_export(spark):
    """Both tracks are told apart by style, so that what is written is read back as it was."""
    rows = spark.createDataFrame([("m", 0, 1.0, 2.5, "He{llo}\nyou", "你好"), ("m", 1, 3725.456, 3726.0, "\\b", "")], "media_id string, ix long, start double, end double, src string, tgt string")
    found = export_subtitles(rows, "ass", header=ass_header("T\nx", 3840, 2160, {"Tgt": {"font": "Noto Sans TC", "bold": True}}))
    document = found.first().document
    assert "Title: T x\n" in document and "PlayResX: 1920\nPlayResY: 1080" in document and "Style: Tgt,Noto Sans TC,60,&H00FFFFFF," in document
    assert "Dialogue: 0,0:00:01.00,0:00:02.50,Tgt,,0,0,0,,{\\rTgt}你好\\N{\\rSrc}He｛llo｝\\Nyou\n" in document
    assert "Dialogue: 0,1:02:05.46,1:02:06.00,Tgt,,0,0,0,,{\\rSrc}＼b\n" in document
    assert ass_colour("#ff8000") == "&H000080FF" and ass_colour("#0b1a2e", 0.45) == "&H732E1A0B"
    back = ingest_subtitles(found.select(F.lit("x.ass").alias("path"), F.encode("document", "utf-8").alias("content")), True)[0].orderBy("ix").collect()
    assert [(r.src, r.tgt) for r in back] == [("He｛llo｝ you", "你好"), ("＼b", "")]


def test_safe_names(spark):
    names = safe_names(spark.createDataFrame([(1, "a/b"), (2, "a:b"), (3, " ")], "media_id long, name string"))
    assert [r.file_name for r in names.orderBy("media_id").collect()] == ["a_b", "a_b (2)", "untitled"]
    names = safe_names(spark.createDataFrame([(1, "a"), (2, "a (2)"), (3, "a"), (4, "a"), (5, "a (4)"), (6, None)], "media_id long, name string"))
    assert [r.file_name for r in names.orderBy("media_id").collect()] == ["a", "a (2)", "a (3)", "a (5)", "a (4)", "untitled"]


def test_glossary_of_prompts(spark):
    """Terms that a batch's neighbourhood holds, whatever their length, case and script; inside words too."""
    cues_ = spark.createDataFrame([("m", i, t) for i, t in enumerate(["The Captain said", "nothing here", "今日はいい天気", "x"])] + [("n", 0, None)], "media_id string, ix long, src string")
    terms = spark.createDataFrame([("captain", "Kapitän"), ("apt", "geschickt"), ("a", "ein"), ("天気", "Wetter"), ("storm", "Sturm"), ("", "leer"), (None, "nichts"), ("nothing here and", "x")], "src string, tgt string")
    got = {(r.media_id, r.batch_ix): r.prompt for r in translate.prompts(cues_, "Rules.", size=2, before=0, after=0, glossary=terms).collect()}
    assert got["m", 0].split("\n\n")[1] == "a = ein\napt = geschickt\ncaptain = Kapitän"
    assert got["m", 1].split("\n\n")[1] == "天気 = Wetter" and "=" not in got["n", 0]


def test_catalogs(spark):
    glossary = parse_glossary(spark.createDataFrame([("a = b = c",), ("= x",), ("none",)], "value string"))
    assert [tuple(r) for r in glossary.collect()] == [("a", "b = c")]
    docs = spark.createDataFrame([("p", '{"id": 1}', None), ("q", "{bad", '{"id": 2}'), ("r", "{", None)], "path string, doc string, bak string")
    assert [(r.path, r.data.id if r.data else None, r.recovered, r.broken) for r in read_projects(docs, "id int").orderBy("path").collect()] == [("p", 1, False, False), ("q", 2, True, False), ("r", None, False, True)]
    probe = '{"format": {"format_name": "mov,mp4", "duration": "2.5"}, "streams": [{"codec_type": "video", "codec_name": "h264", "width": 640, "height": 360, "avg_frame_rate": "30000/1001", "side_data_list": [{"rotation": -90}]}]}'
    info = media_info(spark.createDataFrame([("m", probe)], "media_id string, probe string")).first()
    assert (info.width, info.height, info.safe, round(info.fps, 2)) == (360, 640, True, 29.97)


@pytest.fixture
def no_idle_batches(spark):
    """Processing-time timeouts ask for a batch without data whenever there is none, so a run to the end would have none."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def stream(spark, tmp_path, batches, schema, query, mode="append"):
    """The rows that a streaming query gives, one micro-batch for each list of rows."""
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        run = query(source).writeStream.outputMode(mode).foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert run.awaitTermination(120)
    return out


def test_regions_stream(spark, tmp_path, no_idle_batches):
    rng = random.Random(1)
    rows = [(m, i, rng.choice([0.1, 0.1, 0.4, 0.9])) for m in range(3) for i in range(80)]
    rows += [(m, i, 0.0) for m in range(3) for i in range(80, 100)]
    schema = "media_id long, frame_ix long, p double"
    got = stream(spark, tmp_path, [[r for r in rows if r[1] < 33], [r for r in rows if r[1] >= 33]], schema, streams.regions_stream)
    want = signal.speech_regions(spark.createDataFrame(rows, schema)).collect()
    short = lambda r: (r.media_id, round(r.s, 6), round(r.e, 6))
    assert sorted(map(short, got)) == sorted(map(short, want)) and len(want) > 3


def test_loop_stream(spark, tmp_path, no_idle_batches):
    rows = [(1, i, "ab"[i % 2]) for i in range(60)] + [(2, i, str(i)) for i in range(60)]
    got = stream(spark, tmp_path, [[r for r in rows if r[1] < 20], [r for r in rows if r[1] >= 20]], "media_id long, token_ix long, token string", streams.loop_stream)
    assert [tuple(r) for r in got] == [(1, 31)]
    assert streams.loops(["a", "b"] * 16) and not streams.loops(["a", "b"] * 15)


def at(minute):
    return datetime(2024, 5, 6, 7) + timedelta(minutes=minute)


def test_sessions_and_bins_stream(spark, tmp_path):
    rows = [(1, at(m), float(m)) for m in (0, 50, 100, 400, 420)] + [(2, at(m), 1.0) for m in (10, 200)]
    schema, late = "media_id long, ts timestamp, value double", [(9, at(5000), 0.0)]
    got = stream(spark, tmp_path / "s", [rows, late, [(9, at(9000), 0.0)]], schema, streams.sessions_stream)
    assert sorted((r.media_id, r.n) for r in got if r.media_id < 9) == [(1, 2), (1, 3), (2, 1), (2, 1)]
    got = stream(spark, tmp_path / "b", [rows, late, [(9, at(9000), 0.0)]], schema, lambda d: streams.bins_stream(d, "1 hour", "1 hour"))
    assert sorted((r.media_id, r.n, r.peak) for r in got if r.media_id < 9) == [(1, 1, 100.0), (1, 1, 400.0), (1, 1, 420.0), (1, 2, 50.0), (2, 1, 1.0), (2, 1, 1.0)]


def test_usage_and_progress_stream(spark, tmp_path):
    rows = [(at(0), 1, 10, 5, 0), (at(1), 2, 20, 6, 1), (at(2), 0, 99, 99, 99), (at(40 * 1440), 1, 7, 7, 7)]
    got = stream(spark, tmp_path / "u", [rows[:1], rows[1:]], "ts timestamp, requests long, prompt long, completion long, cache_hit long", streams.usage_stream, "update")
    last = {r.day: tuple(r)[2:] for r in got}
    assert sorted(last.values()) == [(1, 7, 7, 7), (3, 30, 11, 1)] and {r.month for r in got} == {"2024-05", "2024-06"}
    steps = [[("j", at(0), 0.2), ("k", at(0), 0.9)], [("j", at(1), 0.1)], [("j", at(2), 0.5)]]
    got = stream(spark, tmp_path / "p", steps, "job_id string, ts timestamp, progress double", streams.progress_stream, "update")
    assert sorted((r.job_id, r.progress) for r in got) == [("j", 0.2), ("j", 0.5), ("k", 0.9)]


def test_latest_reply_stream(spark, tmp_path):
    rows = spark.createDataFrame([("m", 0, "one"), ("m", 1, "two")], "media_id string, ix long, src string")
    steps = [[("m", 0, at(1), "one", "first"), ("m", 0, at(3), "one", "third"), ("m", 1, at(1), "old", "stale")], [("m", 0, at(2), "one", "second"), ("m", 1, at(2), "two", "zwei")], [("m", 0, at(4), "one", "fourth")]]
    got = stream(spark, tmp_path, steps, "media_id string, ix long, ts timestamp, sent_src string, text string", lambda d: streams.latest_by_id(d, rows), "update")
    assert [(r.ix, r.text) for r in sorted(got, key=lambda r: (r.ts, r.ix))] == [(1, "zwei"), (0, "third"), (0, "fourth")]


def test_wide_scripts(spark):
    """Columns that count CJK characters, against counts by hand."""
    rows = spark.createDataFrame([("今日は 3 人, ok!", 0), ("不要去没有", 1), ("𠀀a ｱ", 2), ("二十三个", 3), ("안 가요", 4)], "t string, i int")
    t = F.col("t")
    got = [tuple(r) for r in rows.select(T.display_width(t), T.estimated_tokens(t), T.negations(t), F.size(T.numbers(t)), t.rlike(T.CJK)).collect()]
    assert [(round(w, 1), *rest) for w, *rest in got] == [(8 + 1 + 1 + 2 + 1 + 0.6 * 3, 4 + 2 + 1, 0, 1, True), (10.0, 6, 2, 0, True), (2 + 1 + 0.6 + 2, 2 + 0 + 1, 0, 0, True), (8.0, 5, 0, 3, True), (6 + 0.6, 3 + 0 + 1, 1, 0, True)]
    lines = spark.createDataFrame([(["今日は", "晴れ", "ok", "then"],)], "l array<string>")
    assert lines.select(T.join_lines(F.col("l"))).first()[0] == "今日は晴れ ok then"
    rtl = spark.createDataFrame([("12 שלום",), ("hi שלום",), ("...",)], "t string").select(T.right_to_left(F.col("t")).alias("x"))
    assert [bool(r.x) for r in rtl.collect()] == [True, False, False]
    out = spark.range(1).select(translate.postprocess(F.lit(' "好的...。" '), True), translate.postprocess(F.lit('"a "b" c"')), translate.postprocess(F.lit("x\n y"))).first()
    assert tuple(out) == ("好的…", '"a "b" c"', "x y")


def test_redo_and_lost(spark):
    chunks = spark.createDataFrame([("m", 0, "English", "a" * 100), ("m", 1, "Japanese", "hello there you"), ("m", 2, "Japanese", "こ" * 90), ("n", 0, "Russian", "да"), ("n", 1, "English", "yes")], "media_id string, chunk_ix long, lang string, text string")
    assert [(r.media_id, r.chunk_ix) for r in align.redo_candidates(chunks.filter("media_id = 'm' AND chunk_ix < 2")).collect()] == [("m", 1)]
    windows = spark.createDataFrame([("m", 0, "b" * 150), ("m", 1, "hello there you"), ("m", 2, "x")], "media_id string, chunk_ix long, text string")
    assert [(r.media_id, r.chunk_ix) for r in align.lost_content(chunks, windows).collect()] == [("m", 0)]


def test_bands(spark):
    x = np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000)
    rows = [("a", i, [float(v) for v in x[i * 4000 : (i + 1) * 4000]]) for i in range(4)]
    got = align.band_energies(spark.createDataFrame(rows, "media_id string, block_ix long, x array<float>")).groupBy("band").agg(F.count("*").alias("n"), F.avg("v").alias("v")).collect()
    edges = np.geomspace(90, 7200, 29)
    assert {r.n for r in got} == {30} and len(got) == 28 and max(r.v for r in got) <= 1
    assert np.searchsorted(edges, 1000) - 1 in {r.band for r in got if r.v > 0.5}


def test_files(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes(b"x" * 10)
    (tmp_path / "b.srt").write_bytes(b"y" * 50)
    (tmp_path / "one.f32").write_bytes(np.array([0.5, -2.0, 1.0] * 111, "<f4").tobytes() + b"\0")
    (tmp_path / "two.f32").write_bytes(np.array([0.5, -0.25], "<f4").tobytes())
    (tmp_path / "none.f32").write_bytes(b"")
    old, subtitles.MAX_BYTES = subtitles.MAX_BYTES, 20
    try:
        got = subtitles.read_files(spark, f"file://{tmp_path}", "*.srt").orderBy("path").collect()
        assert [(r.length, r.content and len(r.content), r.too_large) for r in got] == [(10, 10, False), (50, None, True)]
    finally:
        subtitles.MAX_BYTES = old
    got = {(r.path.rsplit("/")[-1], r.block_ix): r.x for r in subtitles.read_pcm(spark, f"file://{tmp_path}", 100).collect()}
    assert {k: len(v) for k, v in got.items()} == {("one.f32", 0): 100, ("one.f32", 1): 100, ("one.f32", 2): 100, ("one.f32", 3): 33, ("two.f32", 0): 2}
    assert got["one.f32", 0][:2] == [0.25, -1.0] and got["two.f32", 0] == [0.5, -0.25]


def test_encodings(spark):
    texts = {"gb18030": ["你好世界", "他说不知道", "这是一个测试字幕", "谢谢你的帮助"], "big5": ["世界上的人們都很好", "謝謝你的幫助"], "shift_jis": ["こんにちは世界", "日本語の字幕です"], "euc_kr": ["안녕하세요 세계"], "cp1251": ["Привет, мир"], "cp1252": ["déjà vu où ça"]}
    rows = [(f"{e}-{i}", t.encode(e)) for e, ts in texts.items() for i, t in enumerate(ts)] + [("utf16", "Hello there".encode("utf-16-le")), ("utf16be", "Hello there".encode("utf-16-be")), ("mark", "\ufeffé".encode("utf-16")), ("utf8", "né".encode()), ("none", None), ("empty", b"")]
    got = {r.path: r.text for r in subtitles.decode(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {f"{e}-{i}": t for e, ts in texts.items() for i, t in enumerate(ts)} | {"utf16": "Hello there", "utf16be": "Hello there", "mark": "é", "utf8": "né", "empty": ""}


def test_modes(spark):
    rows = spark.createDataFrame([("a", 0, 0.0, 1.0, ["你好", "hello"], None), ("b", 0, 0.0, 1.0, ["hello", "你好"], None), ("c", 0, 0.0, 1.0, ["one", "two"], None), ("d", 0, 0.0, 1.0, ["x"], {"src": "s", "tgt": "t"}), ("e", 0, 0.0, 1.0, ["你", "好", "hi", "there"], None)], "path string, ix long, start double, end double, lines array<string>, tagged map<string,string>")
    modes = {r.path: r.mode for r in subtitles.guess_modes(rows, True).collect()}
    assert modes == {"a": "tgt-top", "b": "src-top", "c": "src", "d": "tgt-top", "e": "tgt-top"}
    got = lambda m: {r.path: (r.src, r.tgt) for r in subtitles.assign_languages(rows, m).collect()}
    assert got("tgt-top") == {"a": ("hello", "你好"), "b": ("你好", "hello"), "c": ("two", "one"), "d": ("s", "t"), "e": ("hi there", "你好")}
    assert got("src-top")["a"] == ("你好", "hello") and got("tgt")["c"] == ("", "one two") and got("src")["a"] == ("你好 hello", "")


def test_more_edits(spark):
    rows = spark.createDataFrame([("m", i, i * 2.0, i * 2.0 + 1, f"new {i}", f"old {i}" if i < 2 else None) for i in range(4)], "media_id string, ix long, start double, end double, src string, src_orig string")
    back = edits.revert(rows, rows.filter("ix IN (1, 2)")).orderBy("ix").collect()
    assert [(r.src, r.src_orig) for r in back] == [("new 0", "old 0"), ("old 1", None), ("new 2", None), ("new 3", None)]
    jobs = spark.createDataFrame([(1,), (2,), (3,)], "job_id long")
    assert sorted(r.job_id for r in edits.unacknowledged(jobs, jobs.filter("job_id = 2")).collect()) == [1, 3]
    near = edits.retime(rows, spark.createDataFrame([("m", 1, 2.5, 2.6)], "media_id string, ix long, new_start double, new_end double")).filter("ix = 1").first()
    assert (near.start, near.end) == (2.5, 2.7)
    chunks = spark.createDataFrame([("m", 0, 0, 2), ("m", 1, 2, 3)], "media_id string, chunk_ix long, w_from long, w_to long")
    windows = spark.createDataFrame([("m", i) for i in range(3)], "media_id string, win_ix long")
    assert [r.chunk_ix for r in ranges.windows_of_chunks(windows, chunks).orderBy("win_ix").collect()] == [0, 0, 1]
    issues = lambda end: [(r.ix, r.issue) for r in edits.qa_report(rows, spark.createDataFrame([("m", end)], "media_id string, duration double")).collect()]
    assert issues(6.0) == [(3, "beyond_end")] and issues(6.5) == []  # what begins at the end is beyond it, what ends later isn't
    split = edits.split_cues(spark.createDataFrame([("m", 0, 0.0, 4.0, "one two three four"), ("m", 1, 5.0, 5.3, "short")], "media_id string, ix long, start double, end double, src string"), spark.createDataFrame([("m", 0, 1.0), ("m", 1, 5.1)], "media_id string, ix long, t double"))
    assert [(r.start, r.end, r.src) for r in split.orderBy("ix").collect()] == [(0.0, 1.0, "one"), (1.0, 4.0, "two three four"), (5.0, 5.3, "short")]
