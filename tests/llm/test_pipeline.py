"""The pipeline's stages against plain Python on a small table, each on its own input."""

import random

import numpy as np
import pytest

import corpus_pipeline as pipeline
from cuelake.llm import bpe, pii, quality_rules, simhash
from cuelake.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(20)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    texts = [words(rng.randint(5, 90)) for _ in range(80)]
    texts += [texts[0], texts[1], texts[40] + " mail me@x.org", None, "", "again " * 60, words(30) + " call +1 (234) 567-8901"]
    return spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs):
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == 5
    at, seen = docs, []
    for name, stage in pipeline.STAGES:
        out = materialize(stage(spark, at, ""), "test-stage")
        seen.append((at.collect(), out.collect()))
        if name != names[-1]:
            assert out.columns == COLUMNS
        at = out
    before, after = seen[0]
    kept = {r.doc_id for r in after}
    verdict = {r.doc_id: r.kept for r in quality_rules.judge(quality_rules.ledger(docs)).collect()}
    assert kept == {i for i, ok in verdict.items() if ok} and {r.doc_id: r for r in after} == {r.doc_id: r for r in before if r.doc_id in kept}

    before, after = seen[1]
    fp = {r.doc_id: simhash.fingerprint((r.text or "").encode(), 5) % 2**64 for r in before}
    label = {i: i for i in fp}
    for _ in fp:
        label = {i: min(label[j] for j in fp if bin(fp[i] ^ fp[j]).count("1") <= 3) for i in fp}
    assert sorted(r.doc_id for r in after) == sorted(set(label.values()))

    before, after = seen[2]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    assert not any("@x.org" in r.text or "567-8901" in r.text for r in after) and all(r.n_chars == len(r.text) for r in after)
    clean = {r.doc_id for r in before if "@" not in r.text and "+" not in r.text}
    assert {r.doc_id: r.text for r in before if r.doc_id in clean} == {r.doc_id: r.text for r in after if r.doc_id in clean}

    before, after = seen[3]
    copies = {}
    for r in after:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 2 and {tuple(r) for r in after} <= {tuple(r) for r in before}
    size = {r.doc_id: len(r.text.split()) for r in before}
    assert sum(size[i] * c for i, c in copies.items()) == pytest.approx(1.5 * sum(size.values()), rel=0.1)

    before, after = seen[4]
    encoder = bpe.Encoder(open(__import__("public_tokenizers").path(bpe.TOKENIZER), "rb").read())
    assert sorted((r.doc_id, r.n_tokens) for r in after) == sorted((r.doc_id, len(np.frombuffer(encoder.encode(r.text), "<u4"))) for r in before)


def test_entities_have_kinds():
    assert tuple(pii.PATTERNS) == ("email", "ip", "card", "phone")
