"""SimHash near-duplicates by anchor-point covering.

Two fingerprints that differ in at most three of 64 bits differ in at most one bit of one of their
halves. The first 31 bits of a half are covered by the perfect Hamming code: each value lies within
one bit of exactly one codeword, its home anchor. A fingerprint goes to every anchor within the
covering radius plus that one bit, sixteen at most, and meets there each fingerprint that is at
home. So every link is found at an anchor. An anchor with very many homes is cut once more in the
same way, by the halves of the other half. What is crowded still, by homes or by guests, is dealt to
block pairs of a bounded number of rows: some homes against some members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_rows, materialize, read_table
from .components import connected

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Anchors with more homes than this are cut again; groups of more members than BLOCK_ROWS become block pairs. They move work between tasks and change no result.
HOT_HOMES, BLOCK_ROWS = 4096, 4096
#: Groups up to this size are compared all at once, many groups in one numpy call.
SMALL_GROUP = 32


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, as a signed 64-bit integer; zero for a text without words or none."""
    words = (text or b"").lower().split()  # of bytes: A-Z alone, and parted at space and \t \n \v \f \r
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        hashes = [digest(join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)), strict=False)]
    bits = np.zeros(64, dtype=np.int64)
    all_hashes = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(all_hashes), 1 << 16):
        bits += np.unpackbits(all_hashes[i : i + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: its id and fp (long). Whole texts; a null text counts as empty; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["id", "fp"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


def _anchors(values: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For values of 2**order - 1 bits: the codewords within two bits of each, home first, and which of them exist."""
    n = (1 << order) - 1
    syndrome = np.zeros(len(values), dtype=np.int64)
    for b in range(order):
        mask = np.uint64(sum(1 << (p - 1) for p in range(1, n + 1) if p >> b & 1))
        syndrome |= (np.bitwise_count(values & mask).astype(np.int64) & 1) << b
    flips = np.zeros((n + 1, (n + 1) // 2), dtype=np.uint64)
    for s in range(1, n + 1):
        flips[s] = [1 << (s - 1), *(1 << (j - 1) | 1 << ((j ^ s) - 1) for j in range(1, n + 1) if j < j ^ s)]
    codewords = values[:, None] ^ flips[syndrome]
    exist = np.ones(codewords.shape, dtype=bool)
    exist[syndrome == 0, 1:] = False
    return codewords, exist


def _placed(fps: DataFrame) -> DataFrame:
    """key, fp, home: each fingerprint at each of its anchors, of either half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(all_values), 1 << 14):
                values = all_values[i : i + (1 << 14)]
                for half in (0, 1):
                    codewords, exist = _anchors(values >> np.uint64(32 * half) & np.uint64((1 << 31) - 1), 5)
                    row, column = np.nonzero(exist)
                    key = codewords[row, column].astype(np.int64) | half << 31
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(values[row].view(np.int64)), pa.array(column == 0)], ["key", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "key long, fp long, home boolean")


def _placed_again(rows: DataFrame) -> DataFrame:
    """The same for rows of hot anchors: key becomes the anchor and, of the other half, a quarter's anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            other = np.where(key >> 31 & 1 == 0, fp.view(np.uint64) >> np.uint64(32), fp.view(np.uint64))
            for quarter in (0, 1):
                codewords, exist = _anchors(other >> np.uint64(16 * quarter) & np.uint64((1 << 15) - 1), 4)
                row, column = np.nonzero(exist)
                new = key[row] << 16 | quarter << 15 | codewords[row, column].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(new), pa.array(fp[row]), pa.array(home[row] & (column == 0))], ["key", "fp", "home"])

    return rows.select("key", "fp", "home").mapInArrow(run, "key long, fp long, home boolean")


def _forest(fp: np.ndarray, home: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join what one large group joins: one fewer than its members at most."""
    label, found, values = np.arange(len(fp)), [], fp.view(np.uint64)
    for i in np.nonzero(home)[0]:
        near = np.nonzero(np.bitwise_count(values ^ values[i]) <= distance)[0]
        labels, first = np.unique(label[near], return_index=True)
        if len(labels) > 1:
            found += [(int(fp[i]), int(fp[near[j]])) for j, x in zip(first, labels, strict=True) if x != label[i]]
            label[np.isin(label, labels)] = labels[0]
    return found


def _links(placed: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a, b: links between fingerprints that meet at an anchor where one is at home, enough of them to join all that are linked."""

    def compare(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1, [len(key)]])
        sizes = np.diff(starts)
        large = np.repeat(sizes > SMALL_GROUP, sizes)
        a, b = [], []
        for k in range(1, int(min(SMALL_GROUP, sizes.max()))):
            i = np.nonzero((key[:-k] == key[k:]) & ~large[k:] & (home[:-k] | home[k:]))[0]
            i = i[np.bitwise_count(fp[i].view(np.uint64) ^ fp[i + k].view(np.uint64)) <= distance]
            a.append(fp[i])
            b.append(fp[i + k])
        for start, size in zip(starts[:-1], sizes, strict=True):
            if size > SMALL_GROUP and (found := _forest(fp[start : start + size], home[start : start + size], distance)):
                pairs = np.array(found, dtype=np.int64)
                a.append(pairs[:, 0])
                b.append(pairs[:, 1])
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if not len(new[0]):
                continue
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if held[0][0] != held[0][-1]:  # the last group may go on in the next batch
                cut = int(np.searchsorted(held[0], held[0][-1]))
                yield compare(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield compare(*held)

    return placed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _counted(placed: DataFrame, block_rows: int) -> DataFrame:
    """key, homes, members of the crowded groups."""
    crowded = placed.groupBy("key").agg(F.count_if("home").alias("homes"), F.count("*").alias("members"))
    return materialize(crowded.filter((F.col("members") > block_rows) & (F.col("homes") > 0)), "crowded-anchors")


def _dealt(placed: DataFrame, crowded: DataFrame, block_rows: int) -> DataFrame:
    """The members of crowded groups as block pairs: key becomes a key of the group, a block of its homes and one of its members."""
    rows = placed.join(crowded, "key")
    blocks = lambda c: F.ceil(F.col(c) / block_rows).cast("int")
    own = lambda c: F.pmod(F.xxhash64("fp"), blocks(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    homes = rows.filter("home").select("key", "fp", "home", own("homes").alias("i"), every("members").alias("j"))
    members = rows.select("key", "fp", F.lit(False).alias("home"), every("homes").alias("i"), own("members").alias("j"))
    return homes.unionByName(members).select(F.xxhash64("key", "i", "j").alias("key"), "fp", "home")


def _all_links(placed: DataFrame, crowded: DataFrame, distance: int, block_rows: int) -> DataFrame:
    if crowded.isEmpty():
        return _links(placed, distance)
    return _links(placed.join(crowded, "key", "left_anti").unionByName(_dealt(placed, crowded, block_rows)), distance)


def link_fingerprints(fps: DataFrame, distance: int = DISTANCE, hot_homes: int = HOT_HOMES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """a, b: links between the distinct fingerprints in fps.fp, enough to join all that are within distance (3 at most).

    A task holds one group at a time: block_rows members, or as many homes and members of a block pair.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError("anchors cover up to three differing bits")
    placed = _placed(fps)
    crowded = _counted(placed, min(block_rows, hot_homes))
    hot = crowded.filter(F.col("homes") > hot_homes)
    if hot.isEmpty():
        return _all_links(placed, crowded, distance, block_rows)
    usual = placed.join(hot, "key", "left_anti")
    again = materialize(_placed_again(placed.join(hot, "key", "left_semi")), "hot-anchors")
    return _all_links(usual, crowded.filter(F.col("homes") <= hot_homes), distance, block_rows).unionByName(_all_links(again, _counted(again, block_rows), distance, block_rows))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE, hot_homes: int = HOT_HOMES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of docs: id, fp (long), component_id, the least id reachable over links, its own included.

    Texts without words, null ones included, have fingerprint zero and link like any other. Copies share a
    fingerprint and are counted once in the search, so their number costs nothing there. Repeated rows give
    repeated results; a null id stays null and is least in no component. An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle).toDF("id", "fp"), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    roots = connected(link_fingerprints(distinct, distance, hot_homes, block_rows)).toDF("fp", "root")
    rooted = materialize(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component, columns unchanged: the least id leads, null last.

    A row is its id and text: rows that share an id and hold unrelated texts all stay, and a row with a null id stays
    unless its component has another.
    """
    row = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    found = near_duplicates(docs.select(row.alias("row"), F.col(text_col).alias("text")), "row", "text", distance, shingle)
    return keep_rows(docs, found.select("component_id.*").distinct(), id_col, text_col)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
