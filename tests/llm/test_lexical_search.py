"""op11 against brute force, with small visits, blocks and shards as well."""

import math
import random
import re
from collections import Counter

import pytest

from cuelake.llm import lexical_search


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_definition(docs, items, top=10):
    counted = [(i, c, sum(c.values())) for i, t in docs if (c := Counter(terms(t)))]
    n_docs, length, df = len(counted), sum(n for *_, n in counted), Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for doc, c, n in counted:
            m = 25 + (75 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0 and doc is not None:
                scores.append((-score, doc))
        out += [(item, k + 1, doc, -s) for k, (s, doc) in enumerate(sorted(scores)[:top])]
    return sorted(out)


def tables(spark):
    rnd = random.Random(3)
    words = ["a", "B", "b", "über", "É", "é", "x1", "zz", *(f"rare{k}" for k in range(40))]
    text = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", " ", "-", "."]) for _ in range(n))
    docs = [(rnd.choice([i, i, i, 5, None]), rnd.choice([None, "", " . "]) if i % 10 == 0 else text(rnd.choice([3, 8, 8, 8, 40, 300]))) for i in range(600)]
    docs += [(9000 + k, "hot text of many copies rare1") for k in range(300)]
    items = [(k, text(rnd.randint(0, 6))) for k in range(30)] + [(1, None), (2, "..."), (3, "a A"), (3, "a A"), (4, "hot copies")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("visit, block, shard", [(512, 400_000, 40_000), (8, 60, 100)])
def test_like_brute_force(spark, monkeypatch, visit, block, shard):
    docs, items, d, i = tables(spark)
    for name, value in (("FIRST_VISIT", visit), ("BLOCK_TERMS", block), ("SHARD_DOCUMENTS", shard)):
        monkeypatch.setattr(lexical_search, name, value)
    d = d.withColumns({"n": d.doc_id, "terms": d.text, "m": d.text, "item_id": d.text})
    found = lexical_search.search(d, i.withColumn("rank", i.text))
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, found.collect())) == by_definition(docs, items)


def test_nothing(spark):
    _, _, d, i = tables(spark)
    assert lexical_search.search(d.limit(0), i).count() == 0
    assert lexical_search.search(d, i.limit(0)).count() == 0
    assert lexical_search.search(d.filter("text is null"), i).count() == 0
