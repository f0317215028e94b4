"""Every registered query of the subpackage on a small folder of its own, against plain Python."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cuelake.llm import bpe, quality_rules
from cuelake.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(31)
    lexicon = {"en": ["the", "house", "with", "many", "windows", "that", "she", "likes"], "de": ["das", "haus", "mit", "vielen", "fenstern", "und", "sie", "mag"]}
    text = lambda lang, n: " ".join(rng.choice(lexicon[lang]) + rng.choice(["", "", "s", "n"]) for _ in range(n))
    docs = []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        docs.append((i, text(lang, rng.randint(15, 90)), lang, f"s{i % 4}"))
    docs += [(120, docs[0][1], "en", "s0"), (121, docs[1][1] + " mail bob@x.org or +1 (234) 567-8901", "de", "s1"), (122, None, None, None), (123, "", "en", None), (124, "12 .. 4111 1111 1111 1111", "en", "s2"), (125, "word " * 300, "en", "s3")]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    page = lambda i: (i, f"http://h{i % 5}.org/{('es', 'fr')[i % 2]}/{i}", ("<p>" + "x" * 1200 + "</p>") if i % 7 == 0 else f"<p>{i}</p>")
    spark.createDataFrame([*map(page, range(40)), (40, None, None), (41, "nothing", "")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    g = np.random.default_rng(2)
    vectors = [g.normal(size=16) for _ in range(40)]
    vectors += [v + g.normal(size=16) * 0.05 for v in vectors[:20]]
    spark.createDataFrame([(i, [float(x) for x in v], "l") for i, v in enumerate(vectors)] + [(60, None, "l"), (61, [0.0] * 16, "l")], "vec_id long, embedding array<double>, label string").write.parquet(f"{path}/embeddings.parquet")
    return path, docs, np.array(vectors)


def run(spark, folder, name):
    return [r.asDict() for r in QUERIES[name](spark, folder[0]).collect()]


def keyed(rows):
    return sorted(repr(sorted(r.items())) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_like_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder[0]}/{t}.parquet/*.parquet')")
    found = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert keyed(run(spark, folder, name)) == keyed(dict(zip(columns, r, strict=True)) for r in found.fetchall())


def test_op1(spark, folder):
    from test_ops import base_spans

    got = {r["doc_id"]: r for r in run(spark, folder, "op1_pii")}
    for i, t, *_ in folder[1]:
        spans = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest() and set(spans) <= set(got[i]["spans"].split(",")) | {""}
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x.startswith(k) for x in spans) for k in ("email", "ip", "card", "phone")]


def test_op2(spark, folder):
    fp = {}
    for i, t, *_ in folder[1]:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    label = dict(zip(fp, fp, strict=True))
    for _ in range(20):
        label = {i: min(label[j] for j in fp if bin(fp[i] ^ fp[j]).count("1") <= 3) for i in fp}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, folder, "op2_simhash")} == {i: (f"{fp[i]:016x}", label[i]) for i in fp}


def test_op4(spark, folder):
    x = folder[2] / np.linalg.norm(folder[2], axis=1, keepdims=True)
    near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    label = np.arange(len(x))
    for _ in label:
        label = np.array([min([label[i], *label[near[i]]]) for i in range(len(x))])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in run(spark, folder, "op4_embeddings")}
    assert got == {i: (int(near[i].sum()), int(label[i]), bool(label[i] == i)) for i in range(len(x))} | {60: (0, 60, True), 61: (0, 61, True)}


def test_op5(spark, folder):
    shingles = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t, *_ in folder[1] for w in [(t or "").lower().split()]}
    alike = {i for i, s in shingles.items() if any(i != j and s and 5 * len(s & x) >= 4 * len(s | x) for j, x in shingles.items())}
    got = {r["doc_id"] for r in run(spark, folder, "op5_passages")}
    assert alike <= got and {0, 120} <= got and not {2, 3, 122, 123} & got


def test_op7(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    t.no_truncation()
    t.no_padding()
    got = {r["doc_id"]: r for r in run(spark, folder, "op7_bpe")}
    for i, text, *_ in folder[1]:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_op8(spark, folder):
    got = run(spark, folder, "op8_mixing")
    source = {i: s for i, _, _, s in folder[1]}
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in folder[1]}
    assert all(r["size"] == size[r["doc_id"]] and r["taken"] in (0, r["size"], 2 * r["size"]) for r in got) and len(got) == len(size)
    for s in {r["target"]: source[r["doc_id"]] for r in got}.values():
        mine = [r for r in got if source[r["doc_id"]] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine) and mine[0]["source_size"] == sum(r["size"] for r in mine)
    assert keyed(got) == keyed(run(spark, folder, "op8_mixing"))


def test_op9(spark, folder):
    got = {r["doc_id"]: r for r in run(spark, folder, "op9_language_id")}
    assert len(got) == len(folder[1]) and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert [got[i]["lang_pred"] for i in (122, 123)] == ["und", "und"] and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(r["lang_pred"], lang) for i, _, lang, _ in folder[1][:120] if (r := got[i])["held_out"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_pipeline(spark, folder):
    """run() as a whole: what is left, how it is sanitised, how often it comes and what it encodes to."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    good = {r.doc_id for r in quality_rules.judge(quality_rules.ledger(docs)).filter("kept").collect()}
    texts = {i: t for i, t, *_ in folder[1] if i in good}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in texts.items() for w in [t.lower().split()]}
    label = {i: i for i in texts}
    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    leaders = sorted(set(label.values()))
    t = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    t.no_truncation()
    t.no_padding()
    got = [r.asDict() for r in pipeline.run(spark, folder[0]).collect()]
    copies = {}
    for r in got:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert set(copies) <= set(leaders) and max(copies.values()) <= 2 and 120 not in copies
    for r in got:  # one document holds personal data; its text is known
        text = texts[r["doc_id"]].replace("bob@x.org", "[EMAIL]").replace("+1 (234) 567-8901", "[PHONE]")
        ids = t.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
    size = {i: len(WORD.findall(texts[i])) for i in leaders}
    assert sum(size[i] * n for i, n in copies.items()) == pytest.approx(1.5 * sum(size.values()), rel=0.1)
