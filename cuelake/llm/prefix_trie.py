"""A trie of conversations' common beginnings, by vertical bitmaps.

Conversations are dealt into shards of neighbouring ids and neighbouring positions. A shard's index gives, for each
(position, turn), the bitset of the conversations that have that turn there. Depth first, a node's bitset is
intersected with the postings of the next position: what is left are its children, their bits counted give the
members, and the bits that end there its end list. Nodes of several shards meet by their prefix key; sums over
subtrees are sums over members, since every node is counted with its smallest member alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

#: Bits of an id that a shard spans, and positions in a shard: bound what a task holds at once, whatever the data.
SHARD_BITS, SPAN = 9, 64
#: Conversations of one base are those whose ids lie in one hundred; a rebuilt one has up to five turns of its base.
FAMILY, HEADS = 100, 6
KEY = ["depth", "k1", "k2"]
_NODE = "depth long, k1 long, k2 long, p1 long, p2 long, conv_id long, n_convs long, size long, n_ends long, shard long, ends binary"


def numbered(turns: DataFrame) -> DataFrame:
    """Add position (from 1) within conv by turn, null first, to conv, turn, t1, t2, size; equal turns go by their hashes.

    A conversation is ordered in buckets of 64 turn numbers, each sorted on its own and shifted by what lies before it,
    so one that holds most of the rows is many window partitions.
    """
    turns = turns.withColumn("bucket", F.expr(f"turn div {SPAN}"))
    before = Window.partitionBy("conv").orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    counts = turns.groupBy("conv", "bucket").agg(F.count("*").alias("n")).withColumn("shift", F.sum("n").over(before)).filter("shift > 0")
    counts = counts.select(F.col("conv").alias("c"), F.col("bucket").alias("b"), "shift")
    local = turns.withColumn("nth", F.row_number().over(Window.partitionBy("conv", "bucket").orderBy(F.col("turn").asc_nulls_first(), "t1", "t2", "size")))
    out = local.join(counts, (F.col("conv") == F.col("c")) & F.col("bucket").eqNullSafe(F.col("b")), "left")
    return out.select("conv", (F.col("nth") + F.coalesce("shift", F.lit(0))).cast("long").alias("position"), "t1", "t2", "size")


def rebuilt(own: DataFrame) -> DataFrame:
    """conv, position, t1, t2, size of each conversation: turns of its base first, then its own. A turnless one has a row of position 0.

    The base of c is c - c % 100, of which come the first h turns; c's own first h turns go; h is crc32(c) % 6.
    """
    h, base = F.crc32(F.col("conv").cast("string")) % HEADS, F.col("conv") - F.col("conv") % FAMILY
    heads = own.filter((F.col("conv") % FAMILY == 0) & (F.col("position") < HEADS)).withColumnRenamed("conv", "base")
    size = heads.groupBy("base").agg(F.max("position").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = own.groupBy("conv").agg(F.max("position").alias("n")).withColumns({"h": h, "base": base})
    first = convs.join(heads, "base").filter("position <= h").select("conv", "position", "t1", "t2", "size")
    rest = own.withColumns({"h": h, "base": base}).filter("position > h").join(size, "base", "left").withColumn("position", F.col("position") - F.col("h") + taken)
    none = convs.filter("n <= h").join(size, "base", "left").filter(taken == 0).select("conv", F.lit(0).cast("long").alias("position"), *[F.lit(0).cast("long").alias(c) for c in ("t1", "t2", "size")])
    return first.unionByName(rest.select("conv", "position", "t1", "t2", "size")).unionByName(none)


def prefixes(turns: DataFrame) -> DataFrame:
    """Add block, k1, k2 (the key of the turns up to here), p1, p2 (of those before) and last (whether the conversation ends here).

    A key is 128 bits: the exclusive or of hashes of (position, turn). It runs within blocks of positions; what comes
    before a block is carried in from the blocks' own totals.
    """
    turns = turns.withColumns({"block": F.expr(f"greatest(position - 1, 0) div {SPAN}"), "x1": F.when(F.col("position") > 0, F.xxhash64("position", "t1", "t2", F.lit(1))).otherwise(0), "x2": F.when(F.col("position") > 0, F.xxhash64("position", "t2", "t1", F.lit(2))).otherwise(0)})
    by_block = Window.partitionBy("conv").orderBy("block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    totals = turns.groupBy("conv", "block").agg(F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"))
    totals = totals.withColumns({"c1": F.bit_xor("y1").over(earlier), "c2": F.bit_xor("y2").over(earlier), "more": F.lead("block").over(by_block).isNotNull()}).filter("more or block > 0")
    local = Window.partitionBy("conv", "block").orderBy("position")
    turns = turns.withColumns({"r1": F.bit_xor("x1").over(local), "r2": F.bit_xor("x2").over(local), "closes": F.lead("position").over(local).isNull()})
    out = turns.join(totals.select("conv", "block", "c1", "c2", "more"), ["conv", "block"], "left")
    key = {k: F.col(r).bitwiseXOR(F.coalesce(c, F.lit(0))) for k, r, c in (("k1", "r1", "c1"), ("k2", "r2", "c2"))}
    out = out.withColumns(key | {"last": F.col("closes") & ~F.coalesce("more", F.lit(False))})
    return out.select("conv", "position", "block", "t1", "t2", "size", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "last")


def _walk(shard: pa.Table, bits: int, span: int) -> pa.Table:
    """The nodes of one shard: its conversations' index of bitsets, walked depth first."""
    cols = shard.to_pydict()
    number, low = cols["shard"][0], cols["shard"][0] << bits
    first = cols["block"][0] * span
    postings: dict[tuple[int, int, int], int] = {}
    row_at: dict[tuple[int, int], int] = {}
    ends_at: dict[int, int] = {}
    roots: dict[tuple[int, int], int] = {}
    for i, (conv, position, t1, t2, last) in enumerate(zip(cols["conv"], cols["position"], cols["t1"], cols["t2"], cols["last"], strict=True)):
        bit = 1 << (conv - low)
        if last:
            ends_at[position] = ends_at.get(position, 0) | bit
        if position:
            postings[position, t1, t2] = postings.get((position, t1, t2), 0) | bit
            row_at[position, conv - low] = i
        if position <= first + 1:
            start = (cols["p1"][i], cols["p2"][i])
            roots[start] = roots.get(start, 0) | bit
    out: list[tuple] = []

    def note(depth: int, members: int, key: tuple, parent: tuple, size: int) -> int:
        ends = members & ends_at.get(depth, 0)
        packed = ends.to_bytes((ends.bit_length() + 7) // 8, "little") if ends else None
        out.append((depth, *key, *parent, low + (members & -members).bit_length() - 1, members.bit_count(), size, ends.bit_count(), number, packed))
        return members & ~ends

    for start, members in roots.items():
        stack = [(first, note(0, members, (0, 0), (None, None), 0) if first == 0 else members)]
        while stack:
            depth, open_ = stack.pop()
            while open_ and depth < first + span:
                i = row_at[depth + 1, (open_ & -open_).bit_length() - 1]
                child = open_ & postings[depth + 1, cols["t1"][i], cols["t2"][i]]
                goes_on = note(depth + 1, child, (cols["k1"][i], cols["k2"][i]), (cols["p1"][i], cols["p2"][i]), cols["size"][i])
                open_ ^= child
                if goes_on:
                    stack.append((depth + 1, goes_on))
    names = [f.split()[0] for f in _NODE.split(", ")]
    kinds = [pa.binary() if n == "ends" else pa.int64() for n in names]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _end_hashes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ends, whose bitsets arrive by node and shard in order: one hash is open at a time."""
    key, digest, comma = None, None, b""
    for batch in batches:
        done: list[tuple] = []
        for depth, k1, k2, shard, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (depth, k1, k2) != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest, comma = (depth, k1, k2), hashlib.sha256(), b""
            bits, low = int.from_bytes(ends, "little"), shard << width
            while bits:
                bit = bits & -bits
                digest.update(comma + str(low + bit.bit_length() - 1).encode())
                comma, bits = b",", bits ^ bit
        yield _hashes(done)
    if key is not None:
        yield _hashes([(*key, digest.hexdigest())])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], [*KEY, "sha"])


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node of the trie of rebuilt conversations; columns as op13_prefix_trie lists them.

    A null role or text is an empty one; rows of a null conversation belong to none and are left out; equal turn
    numbers of one conversation, repeated rows included, are turns of their own in the order of their hashes. Texts
    count whole, by two 64-bit hashes of role and text. Other columns are not read. No rows give none. One
    conversation, or one turn, may hold most rows: nothing gathers more than a shard, and the ids of a long end list
    stream through one hash, as its definition asks, from bitsets.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    turns = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.xxhash64(F.lit(3), role, text).alias("t1"), F.xxhash64(F.lit(4), role, text).alias("t2"), F.length(text).cast("long").alias("size"),
    )
    own = materialize(numbered(turns), "turns")
    paths = materialize(prefixes(rebuilt(own)), "paths")
    bits, span = SHARD_BITS, SPAN
    found = paths.withColumn("shard", F.shiftright("conv", SHARD_BITS)).groupBy("shard", "block").applyInArrow(lambda shard: _walk(shard, bits, span), _NODE)
    parts = materialize(found, "trie-shards")
    nodes = parts.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_ends").alias("n_ends"), F.first("size").alias("size"), F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    nodes = nodes.withColumns({"saved": (F.col("n_convs") - 1) * F.col("size"), "leaf": (F.col("n_ends") == F.col("n_convs")).cast("long")})
    return _report(materialize(nodes, "trie-nodes"), paths, parts)


def _report(nodes: DataFrame, paths: DataFrame, parts: DataFrame) -> DataFrame:
    """What a subtree sums is the sum over its members of the nodes that each member is the smallest one of.

    Those nodes are the tail of the member's path. Of the node's own smallest member, what lies above the node is taken off.
    """
    nodes = nodes.withColumn("part", F.expr(f"depth div {SPAN}"))
    over_parts = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = nodes.groupBy("conv_id", "part").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"), F.max("depth").alias("d"))
    carried = carried.withColumns({"s": F.sum("s").over(over_parts), "l": F.sum("l").over(over_parts), "d": F.max("d").over(over_parts)}).filter("d is not null")
    local = Window.partitionBy("conv_id", "part").orderBy("depth")
    above = local.rowsBetween(Window.unboundedPreceding, -1)
    chains = nodes.join(carried, ["conv_id", "part"], "left").withColumns({
        "above_saved": F.coalesce(F.sum("saved").over(above), F.lit(0)) + F.coalesce("s", F.lit(0)), "above_leaf": F.coalesce(F.sum("leaf").over(above), F.lit(0)) + F.coalesce("l", F.lit(0)),
        "heads": ~F.coalesce(F.coalesce(F.lag("depth").over(local), F.col("d")) == F.col("depth") - 1, F.lit(False)),
    })
    heads = chains.filter("heads and depth > 0").select(F.col("conv_id").alias("c"), "depth", F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("up"))
    parents = nodes.select(F.col("depth").alias("up"), "k1", "k2", F.col("conv_id").alias("parent"))
    heads = heads.join(parents, ["up", "k1", "k2"]).select("c", "depth", "parent")

    totals = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    members = paths.filter("position > 0").join(totals.withColumnRenamed("conv_id", "conv"), "conv").groupBy(F.col("position").alias("depth"), "k1", "k2").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    root = nodes.groupBy().agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf")).filter("leaf is not null").select(*[F.lit(0).cast("long").alias(k) for k in KEY], "saved", "leaf")
    hashed = parts.filter("ends is not null").select(*KEY, "shard", "ends").repartition("k1", "k2").sortWithinPartitions(*KEY, "shard").mapInArrow(lambda batches, bits=SHARD_BITS: _end_hashes(batches, bits), "depth long, k1 long, k2 long, sha string")

    sums = ("conv_id", "n_convs", "saved", "leaf", "children")

    def piece(df: DataFrame, **columns: Column) -> DataFrame:
        empty = {c: F.lit(None).cast("long") for c in sums} | {"sha": F.lit(None).cast("string")}
        return df.select(*[columns.get(k, F.col(k)).alias(k) for k in KEY], *[columns.get(c, e).alias(c) for c, e in empty.items()])

    pieces = [
        piece(chains, conv_id=F.col("conv_id"), n_convs=F.col("n_convs"), saved=-F.col("above_saved"), leaf=-F.col("above_leaf")),
        piece(nodes.filter("depth > 0"), depth=F.col("depth") - 1, k1=F.col("p1"), k2=F.col("p2"), children=F.lit(1).cast("long")),
        piece(members, saved=F.col("saved"), leaf=F.col("leaf")),
        piece(root, saved=F.col("saved"), leaf=F.col("leaf")),
        piece(hashed, sha=F.col("sha")),
    ]
    whole = reduce(DataFrame.unionByName, pieces).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in sums], F.max("sha").alias("sha"))
    out = whole.join(heads.withColumnRenamed("c", "conv_id"), ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_convs", F.coalesce("children", F.lit(0)).alias("n_children"),
        F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id (the node's smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (all long), ends_sha256."""
    return trie(read_table(spark, sf_dir, "conversations"))


ORACLE_SQL = """
WITH src AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, c - c % 100 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
           lambda a, d: list_reduce(list_prepend(xor(a, d), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END + z))) % 6 AS h
  FROM (SELECT DISTINCT c FROM src)),
heads AS (SELECT i.c, s.p, s.role, s.text FROM ids i JOIN src s ON s.c = i.base AND s.p <= i.h),
there AS (SELECT c, count(*) AS n FROM heads GROUP BY c),
turns AS (
  SELECT * FROM heads
  UNION ALL
  SELECT i.c, s.p - i.h + coalesce(t.n, 0), s.role, s.text
  FROM ids i JOIN src s ON s.c = i.c AND s.p > i.h LEFT JOIN there t ON t.c = i.c),
steps AS (
  SELECT c, p, text, list(md5(role) || md5(text)) OVER (PARTITION BY c ORDER BY p) AS prefix,
         p = max(p) OVER (PARTITION BY c) AS stops FROM turns),
paths AS (
  SELECT c, p AS depth, md5(array_to_string(prefix, ',')) AS k, length(text) AS size, stops FROM steps
  UNION ALL
  SELECT c, 0, 'root', 0, c NOT IN (SELECT c FROM turns) FROM ids),
nodes AS (
  SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs, min(size) AS size,
         coalesce(sha256(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE stops)), sha256('')) AS ends_sha256
  FROM paths GROUP BY depth, k),
edges AS (SELECT DISTINCT a.depth, a.k, b.k AS up FROM paths a JOIN paths b ON a.c = b.c AND b.depth = a.depth - 1),
kids AS (SELECT up AS k, depth - 1 AS depth, count(*) AS n FROM edges GROUP BY up, depth),
below AS (SELECT DISTINCT b.depth, b.k, a.depth AS d, a.k AS u FROM paths a JOIN paths b ON a.c = b.c AND a.depth >= b.depth),
sums AS (
  SELECT b.depth, b.k, sum((n.n_convs - 1) * n.size) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
  FROM below b JOIN nodes n ON n.depth = b.d AND n.k = b.u LEFT JOIN kids ON kids.k = n.k AND kids.depth = n.depth
  GROUP BY b.depth, b.k)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       coalesce(kids.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.k = n.k LEFT JOIN kids ON kids.depth = n.depth AND kids.k = n.k
LEFT JOIN edges e ON e.depth = n.depth AND e.k = n.k LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.k = e.up
"""
