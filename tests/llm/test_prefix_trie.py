"""op13 against brute force: shared beginnings, long conversations over several shards, nulls, repeats, negative ids."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from cuelake.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_definition(rows):
    given = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            given[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    sequence = {}
    for conv, turns in given.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = sorted(given.get(conv - int(math.fmod(conv, 100)), []))
        sequence[conv] = tuple((r, t) for _, r, t in base[:h] + sorted(turns)[h:])
    members = defaultdict(list)
    for conv in sorted(sequence):
        for d in range(len(sequence[conv]) + 1):
            members[sequence[conv][:d]].append(conv)
    children, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(convs) - 1) * (len(node[-1][1]) if node else 0)
            leaves[node[:d]] += not children[node]
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(sequence[c]) == len(node))
        out.append((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("bits, span", [(9, 64), (3, 4)])
def test_like_brute_force(spark, monkeypatch, bits, span):
    monkeypatch.setattr(prefix_trie, "SHARD_BITS", bits)
    monkeypatch.setattr(prefix_trie, "SPAN", span)
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["u", "a", None]), rnd.choice(["", "x", "yy", None, "zzz"])) for c in [*range(-120, 300, 3), 10**12, 10**12 + 5] for t in range(rnd.randint(1, 7))]
    rows += [(200, None, "u", "n"), (None, 1, "u", "q"), (205, None, "u", "n")]
    rows += [(c, t, "u", f"k{t % 3}") for c in (600, 601, 602, 633) for t in range(150)]
    rows += [(c, t, "u", "copy") for c in range(700, 760) for t in range(8)]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conversations = conversations.withColumns({"position": conversations.text, "conv": conversations.text, "shard": conversations.text, "size": conversations.text})
    assert found(prefix_trie.trie(conversations)) == by_definition(rows)


def test_small_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], schema)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "u", "x")], schema)).count() == 0
    short = [(5, 0, None, None)]  # h is 4 here: the conversation becomes turnless
    assert found(prefix_trie.trie(spark.createDataFrame(short, schema))) == by_definition(short)
    twice = [(100, 1, "u", "same"), (100, 1, "u", "same"), (100, 2, "a", "ä" * 50_000)]
    assert found(prefix_trie.trie(spark.createDataFrame(twice, schema))) == by_definition(twice)
