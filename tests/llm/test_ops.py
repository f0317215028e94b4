"""Operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows, no rows and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cuelake.llm import bpe, embeddings, language_id, mixing, passages, pii, quality_rules, simhash, url_filters, warc
from cuelake.llm.components import connected

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 20_000


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    base = [words(rng, rng.randint(1, 120)) for _ in range(60)]
    return [None, "", " \n\t", "A", *base, base[0], base[0].upper(), base[1] + " more", LONG, "x" * 50_000, "🙂 é\x85 " * 30, "a\nb\na\nb\na"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None][i % 3], None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[7]], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            root[find(a)] = find(b)
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    same = {}
    for node, r in got.items():
        assert same.setdefault(r, find(node)) == find(node)
    assert set(got) == {x for p in links if p[0] is not None and p[0] != p[1] for x in p} and len(same) == len({find(x) for x in got})
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_rules(docs, texts, none):
    got = {r.doc_id: r for r in quality_rules.judge(quality_rules.ledger(docs.withColumn("n_words", F.lit(9)))).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        seen = {}
        for k, g in enumerate(grams):
            seen.setdefault(g, []).append(k)
        covered = {x for ks in seen.values() if len(ks) > 1 for k in ks for x in range(k, k + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")) == want, i
        assert not got[i].kept or len(w) >= 20
    rows = quality_rules.ledger(docs)
    table = {r.rule: r for r in quality_rules.ablation(rows).collect()}
    bits = [r.failed_rules for r in rows.collect()]
    assert table["few_words"].n_rejected_alone == sum(b == 1 for b in bits) and table["few_words"].n_failed == sum(b & 1 for b in bits)
    assert quality_rules.ledger(none).count() == 0 and quality_rules.filter_documents(docs).columns == docs.columns


def test_simhash(docs, texts, none):
    fp = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        ones = sum((np.array([xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1 for b in range(64)]) for g in grams), np.zeros(64, int))
        fp.append(sum(1 << b for b in range(64) if 2 * ones[b] > len(grams)))
    label = list(range(len(fp)))
    for _ in fp:
        label = [min(label[j] for j in range(len(fp)) if bin(fp[i] ^ fp[j]).count("1") <= 3) for i in range(len(fp))]
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (fp[i], label[i]) for i in range(len(fp))}
    kept = simhash.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label)) and kept.columns == docs.columns
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("hot", "block_rows"), [(4096, 4096), (3, 4096), (3, 5), (4096, 5), (20, 7)])
def test_anchors_find_every_link(spark, hot, block_rows):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for x in list(fps):  # neighbours at 1 to 5 bits, and one crowded place
        for d in range(1, 6):
            fps.append(x ^ sum(1 << b for b in rng.sample(range(64), d)))
    fps += [fps[0] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(150)]
    fps = sorted(set(fps))
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    links = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"), hot_homes=hot, block_rows=block_rows)
    assert all(bin((r.a ^ r.b) % 2**64).count("1") <= 3 for r in links.collect())
    got = {}
    for r in connected(links).collect():
        got.setdefault(r.root, set()).add(r.node % 2**64)
    label = {x: x for x in fps}
    near = {x: [y for y in fps if bin(x ^ y).count("1") <= 3] for x in fps}
    changed = True
    while changed:
        changed = False
        for x in fps:
            if (m := min(label[y] for y in near[x])) < label[x]:
                label[x], changed = m, True
    want = {}
    for x, m in label.items():
        want.setdefault(m, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if not (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, docs, none):
    cases = [None, "", "a@b.c_x@d.e.f a@b.c@d.e", "1.2.3.4.5.6.7.8 0001.2.3.4 256.1.1.1", "4111 1111 1111 1111 +1 (234) 567-8901 +12", "🙂 é@é.fr a@b.fr 10.0.0.1", "9 " * 3000, "7" * 20_000, "x" * 2000 + "@", "0000000000000", "ask zorblax at bob@x.org now", "see zorblax of bob@x.org then", *["plain now then"] * 30]
    frame = spark.createDataFrame([(i, t, i) for i, t in enumerate(cases)], "doc_id long, text string, terms long")
    found = pii.find(frame).select("doc_id", pii._written(tuple(pii.PATTERNS)).alias("base"), pii._written(pii.KINDS).alias("spans"))
    got = {r.doc_id: r for r in found.collect()}
    for i, t in enumerate(cases):
        assert got[i].base == ",".join(base_spans(t or "")), i
    assert got[10].spans == got[11].spans == "email:15:24,term:4:11" and got[12].spans == ""
    clean = {r.doc_id: r for r in pii.sanitise(frame).collect()}
    assert clean[10].text == "ask  at [EMAIL] now" and clean[12].text == "plain now then" and clean[0].text is None and clean[10].terms == 10
    for i, t in enumerate(cases[:11]):
        spans = sorted((int(x.split(":")[1]), -int(x.split(":")[2]), x.split(":")[0]) for x in base_spans(t or ""))
        out, at = "", 0
        for start, stop, kind in spans:
            if start >= at:
                out, at = out + (t or "")[at:start] + pii.LABELS[kind], -stop
            elif -stop > at:
                at = -stop
        assert i == 10 or clean[i].text is None or clean[i].text == out + (t or "")[at:], i
    assert pii.find(none).count() == 0 and pii.sanitise(none).count() == 0


def disclosed(texts, support=pii.SUPPORT):
    """text -> the terms that disclose what it mentions, by counting sets."""
    texts = {t or "" for t in texts}
    entities, terms = {}, {}
    for t in texts:
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base_spans(t))]
        entities[t] = {f"{k}:{re.sub('[ ().-]', '', t[a:b].lower()) if k in ('card', 'phone') else t[a:b].lower()}" for k, a, b in spans}
        blank = list(t)
        for _, a, b in spans:
            blank[a:b] = " " * (b - a)
        terms[t] = {w.lower() for w in re.findall(r"[^\W_]{3,}", "".join(blank))}
    out, n = {}, len(texts)
    for t in texts:
        for e in entities[t]:
            df_e = sum(e in x for x in entities.values())
            if df_e < support:
                continue
            for w in terms[t]:
                df_w = sum(w in x for x in terms.values())
                both = sum(e in entities[x] and w in terms[x] for x in texts)
                carried = np.log2(n / df_e)
                share = np.log2(both * n / (df_e * df_w)) / carried if carried > 0 else 0
                if both >= support and share >= pii.GENERALISE:
                    out.setdefault(t, {})[w] = max(share, out.get(t, {}).get(w, 0))
    return out


def test_pii_terms(spark):
    rng = random.Random(16)
    vocabulary = [words(rng, 1) + "abc" for _ in range(60)]
    people = [(f"{n}@x.org", f"{n}son", f"{n}ville") for n in ("ann", "bob", "cat", "dan", "eve")]
    texts = []
    for i in range(90):
        line = [rng.choice(vocabulary) for _ in range(rng.randint(5, 40))]
        for mail, name, town in rng.sample(people, rng.choice([0, 0, 1, 2])):
            line[rng.randrange(len(line)) :] = [mail, *line[:2], name]
            line += [town] * rng.randint(0, 1)
        texts.append(" ".join(line))
    texts += [texts[0] + " Ann@X.org annson " + "far " * 100 + "annville", None, ""]
    want = disclosed(texts)
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 30 + [(500 + i, texts[8]) for i in range(40)]
    for row in (rows, rows[: len(texts)]):  # repeated rows and copies change nothing
        found = pii.find(spark.createDataFrame(row, "doc_id long, text string")).join(spark.createDataFrame([(t,) for t in {t or "" for t in texts}], "t string").withColumn("text_hash", F.xxhash64("t")), "text_hash").collect()
        assert len(found) == len(row)
        for r in found:
            assert {x.text for x in r.terms} == set(want.get(r.t, {})) and all(r.t[x.s : x.e].lower() == x.text and x.remove == (want[r.t][x.text] >= pii.REMOVE - 1e-9) for x in r.terms)
    assert sum(map(len, want.values())) > 40
    for support in (1, 3):
        want = disclosed(texts[:50], support)
        for r in pii.find(spark.createDataFrame(list(enumerate(texts[:50])), "doc_id long, text string"), support=support).collect():
            assert {x.text for x in r.terms} == set(want.get(texts[r.doc_id], {})), (support, r.doc_id)


def test_pii_directories(spark, monkeypatch):
    """Two copies of a directory, and a third one whose people have pages of their own: no pair of each person with each term."""
    n, made = 1500, {}
    plain = pii.materialize
    monkeypatch.setattr(pii, "materialize", lambda df, label: made.setdefault(label, plain(df, label)))
    page = lambda k: " ".join(f"p{i}@{k}.org {k}person{i}" for i in range(n))
    texts = [page("one"), page("one") + " again", page("two"), *[f"p{i}@two.org met twoperson{i} and others" for i in range(40)], *[f"nothing here {i}" for i in range(300)]]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all({x.text for x in got[d].terms} == {f"oneperson{i}" for i in range(n)} for d in (0, 1))
    assert {x.text for x in got[2].terms} == {f"twoperson{i}" for i in range(40)}
    assert all({x.text for x in got[3 + i].terms} == {f"twoperson{i}"} for i in range(40)) and not got[60].terms
    assert made["met-classes"].count() < 4 * n


def test_pii_many_matches(spark):
    for n in (700, 6000):
        text = "\U0001f642 " + " ".join(f"né a{i}@b{i}.org" for i in range(n))
        row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        assert ",".join(f"email:{x.s}:{x.e}" for x in row.email) == ",".join(x for x in base_spans(text) if x.startswith("email"))
        assert pii.sanitise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text == "\U0001f642 " + " ".join(["né [EMAIL]"] * n)


def test_bpe_round_trip(spark):
    """One pass gives what encoding and decoding one after the other give."""
    frame = spark.createDataFrame([(None, "Hello there"), (1, None), (1, "don't 中文 ひ"), (2, "")], "name long, body string")
    both = bpe.decode_tokens(bpe.encode_texts(frame, "name", "body"), "name")
    once = bpe.round_trip(frame, "name", "body")
    assert once.schema == both.schema and sorted(map(str, once.collect())) == sorted(map(str, both.collect()))


def test_bpe(docs, texts, none, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    t.no_truncation()
    t.no_padding()
    got = {r.doc_id: r for r in bpe.digests(docs.withColumn("ids", F.lit(1))).collect()}
    rng = random.Random(2)
    odd = ["".join(rng.choice("abcABCéΣςİß '’.,!01\n\x1c\x85　中文ひ한🙂́<|>") for _ in range(40)) for _ in range(200)] + ["a" * 4000, "hi<|endoftext|>there <|startoftext|>", "ΣΑΣ don't WE'LL"]
    more = {r.doc_id + 1000: r for r in bpe.digests(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")).collect()}
    for i, text in [*enumerate(texts), *((i + 1000, x) for i, x in enumerate(odd))]:
        ids = t.encode(text or "", add_special_tokens=False).ids
        r = (got | more)[i]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(none).count() == 0


def test_mixing(spark, docs, none):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs).collect()
    assert sorted(got) == sorted(again) and all(0 <= r.copies <= 2 for r in got)
    sources = {r.doc_id: r.source for r in docs.collect()}
    size, target, taken, largest = {}, {}, {}, {}
    for r in got:
        s = sources[r.doc_id]
        size[s] = size.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.size * r.copies
        largest[s] = max(largest.get(s, 0), r.size)
        target[s] = r.target
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want = dict.fromkeys(order, 0.0)
    rest, free = 1.5 * sum(size.values()), set(order)
    while free and rest > 1e-9:
        level = rest / sum(weight[s] for s in free)
        rest = 0.0
        for s in list(free):
            want[s] += level * weight[s]
        for s in list(free):
            if want[s] >= 2 * size[s]:
                rest += want[s] - 2 * size[s]
                want[s] = 2.0 * size[s]
                free.discard(s)
    for s in order:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= largest[s]
    copies = {r.doc_id: r.copies for r in got}
    assert mixing.expand(docs).filter("doc_id <> 7").count() == sum(c for i, c in copies.items() if i != 7)
    assert mixing.mix(none).count() == 0


def test_mixing_many(spark):
    rng = random.Random(6)
    rows = [(i, "w " * int(rng.paretovariate(1.2) * 20), f"s{min(rng.randrange(6), rng.randrange(6))}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source_size").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"), F.max("size").alias("largest"), F.sum(F.col("rate") * F.col("size")).alias("expected")).collect()
    for r in got:
        assert r.expected == pytest.approx(r.target, rel=1e-3) and abs(r.taken - r.target) <= r.largest


def test_warc(spark, tmp_path):
    big = "é" * 700
    rows = [(1, "http://a/x", big), (2, "http://b", big), (3, None, None), (4, "http://c\r\nX: y", "tiny"), (5, "http://d", "tiny"), (6, "http://e", "z" * 3_000_000), (6, "http://e", "z" * 3_000_000), (None, "http://f", "q")]
    pages = spark.createDataFrame([(*r, "other") for r in rows], "page_id long, url string, html string, digest string")
    index = warc.write_archives(pages, f"file://{tmp_path}/w")
    got = warc.read_records(index, f"file://{tmp_path}/w").collect()
    assert len(got) == len(rows)
    want = sorted((i or 0, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if i == 1 else "response", 2 if i == 1 else None) for i, _, h in rows)
    assert sorted(((r.page_id or 0), r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in got) == want
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.page_id in (2, 4)} == {2: big, 4: "tiny"}
    few = warc.read_records(index.filter("page_id IN (2, 5)"), f"file://{tmp_path}/w", max_gap=0)
    assert sorted(r.page_id for r in few.collect()) == [2, 5]
    assert warc.read_records(index, f"file://{tmp_path}/w").rdd.getNumPartitions() >= 4
    empty = warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read_records(empty, f"file://{tmp_path}/e").count() == 0


@pytest.mark.parametrize("limits", [{}, {"per_cell": 8, "max_cells": 4, "large": 16}, {"per_cell": 4, "max_cells": 6, "large": 8}])
def test_embeddings(spark, limits):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 32))
    rows = [list(map(float, c + rng.normal(size=32) * s)) for c in centres for s in (0, 0, 0.1, 0.15, 0.2, 0.25, 0.3)] + [list(map(float, rng.normal(size=32))) for _ in range(300)]
    odd = [None, [], [0.0] * 32, [None] * 32, [float("nan")] * 32, [float("inf")] + [1.0] * 31, [1.0, 2.0], [2.0, 4.0]]
    table = [(i, v, 0) for i, v in enumerate(rows + odd)]
    vectors = spark.createDataFrame([*table, table[3]], "vec_id long, embedding array<double>, n_links int")
    found = embeddings.near_duplicates(vectors, **limits).collect()
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    weight = np.ones(len(rows))
    weight[3] = 2
    want = near @ weight - 1
    got = {r.vec_id: r for r in found}
    assert sum(got[i].n_links for i in range(len(rows))) >= 0.99 * want.sum() and all(got[i].n_links <= want[i] for i in range(len(rows)))
    base = len(rows)
    assert [got[base + k].n_links for k in range(8)] == [0] * 6 + [1, 1] and got[base + 7].component_id == base + 6 and all(got[base + k].kept for k in range(7))
    assert len(found) == len(table) + 1 and embeddings.near_duplicates(vectors.limit(0)).count() == 0
    unnamed = embeddings.near_duplicates(spark.createDataFrame([(None, rows[0]), (1, rows[0]), (None, None)], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in unnamed) == [(0, 0, 0, True), (0, 0, 0, True), (1, 0, 1, True)]


def test_passages(spark, docs, none):
    rng = random.Random(8)
    passage, line = words(rng, 55), words(rng, 120)
    edited = line.split()
    edited[60] = "changed"
    rows = [(1, words(rng, 80) + " " + passage + " " + words(rng, 40)), (2, words(rng, 17) + " " + passage + " " + words(rng, 200)), (3, "a\n" + line), (4, words(rng, 60) + "\n" + " ".join(edited)), (5, words(rng, 300)), (6, None), (7, ""), (None, passage)]
    frame = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, start long")
    found = passages.repeated_passages(frame)
    got = found.collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4} and {r.doc_id for r in got if r.removed} == {2, 4}
    kept = {r.doc_id: r.text for r in passages.without_repeats(frame, found).collect()}
    assert kept[1] == rows[0][1] and len(kept[2].split()) <= 217 + 55 - 34 and kept[6] is None
    for r in got:
        if r.doc_id == 2:
            assert 17 <= r.start and r.stop <= 72 and r.stop - r.start >= 34
    assert passages.repeated_passages(none).count() == 0 and passages.repeated_passages(docs.withColumn("id", F.lit(1))).count() >= 2


def test_passages_no_miss(spark):
    rng = random.Random(10)
    rows = []
    for k in range(60):
        p = words(rng, 51)
        rows += [(2 * k, words(rng, rng.randint(0, 60)) + " " + p + " " + words(rng, rng.randint(0, 60))), (2 * k + 1, words(rng, rng.randint(0, 60)) + "\n" + p + " " + words(rng, rng.randint(0, 60)))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").distinct().count()
    assert got == 120


def test_url_filters(spark):
    assert url_filters.LINK
    link = lambda h: f'<p><a class=x href="https://{h}/y">t</a><a href="/rel">r</a>'
    rows = [(1, "http://bad.example.org/es/x", ""), (2, "http://friend.net/", link("bad.example.org")), (3, "http://ok.net/a?b#c", link("good.org")), (4, "http://good.org/z", link("friend.net") * 2), (5, None, None), (6, "nothing", ""), (7, "http://Sub.COM/fr/a", None), (8, "http://notorg/x", ""), (9, "http://a.org", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages).collect()}
    assert got[1] == ("bad.example.org", "/es/x", "example.org/es/", "block") and got[7] == ("sub.com", "/fr/a", "com/fr/", "allow")
    assert got[3] == ("ok.net", "/a", None, "allow") and got[2][3] == "allow" and got[5] == got[6] == ("", "", None, "allow") and got[8][2] is None and got[9] == ("a.org", "", None, "allow")
    edges, seeds = [("a", "b", 1), ("b", "a", 1), ("b", "c", 3)], [("a", 2), ("d", 2)]
    ranks = {r.host: r.score for r in url_filters.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, seed long"), tolerance=1e-9).collect()}
    want = dict.fromkeys("abcd", 0.0)
    for _ in range(200):
        want = {"a": 0.5 + 0.85 * 0.25 * want["b"], "b": 0.85 * want["a"], "c": 0.85 * 0.75 * want["b"], "d": 0.5}
    assert ranks == pytest.approx(want, rel=1e-6)
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_url_filters_are_scale_free(spark):
    link = lambda *hs: "".join(f'<a href="https://{h}/y">t</a>' for h in hs)
    rows = [(1, "http://bad.example.org/es/x", ""), (2, "http://friend.net/", link("bad.example.org")), (3, "http://mixed.net/", link("good.org", "ok.net")), (4, "http://good.org/z", link("mixed.net", "ok.net")), (5, "http://ok.net", link("good.org")), (6, "http://far.net/", link("friend.net"))]
    rows += [(10 + i, f"http://site{i}.net/", link("ok.net")) for i in range(12)]
    verdicts = []
    for times in (1, 10, 70):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").crossJoin(spark.range(times).toDF("k"))
        got = url_filters.judge(pages).groupBy("page_id").agg(F.collect_set("verdict").alias("v"), F.count("*").alias("n")).collect()
        assert all(r.n == times and len(r.v) == 1 for r in got)
        verdicts.append({r.page_id: r.v[0] for r in got})
    assert verdicts[0] == verdicts[1] == verdicts[2] and verdicts[0][2] == "block" and verdicts[0][5] == verdicts[0][4] == "allow"


def test_url_filters_like_sql(spark):
    import duckdb

    rng = random.Random(18)
    hosts = ["bad.example.org", "good.org", *[f"h{i}.net" for i in range(25)], "x.com"]
    rows = [(i, f"http://{rng.choice(hosts)}{rng.choice(['/es/a', '/en/1', '/fr/', '/de/b', '/'])}", "".join(f'<a  href=//{rng.choice(hosts[:-1])}/>x</a>' for _ in range(rng.randint(0, 4)))) for i in range(200)]
    rows += [(200, "http://w.net/", '<a href="http://y.com/de/">only here</a>'), *[(201 + i, "http://y.com/de/", "") for i in range(60)]]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = {(r[0], r[1], r[2], r[3], r[4]) for r in con.execute(url_filters.ORACLE_SQL).fetchall()}
    got = {tuple(r) for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want and {x[4] for x in got if x[3] is None} == {"allow", "block"}


def test_language_id(spark, none):
    rng = random.Random(12)
    make = lambda s: " ".join("".join(rng.choice(s) for _ in range(5)) for _ in range(rng.randint(3, 40)))
    rows = [(i, make(("abcdeé", "lmnopß")[i % 2]), ("xx", "yy")[i % 2]) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(language_id.bounded_sample(frame, "text", "lang", 120))
    odd = spark.createDataFrame([(1000, None), (1001, "12 .."), (1002, ""), (1003, "abc " * 300_000)], "doc_id long, text string").withColumn("lang", F.lit("zz"))
    got = {r.doc_id: r for r in language_id.predict(frame.unionByName(odd), model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 195 and [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "xx"]
    assert all(0 <= r.score <= 1 for r in got.values()) and language_id.predict(none, language_id.train(language_id.bounded_sample(none, "text", "lang"))).count() == 0
