"""Links between sets of Jaccard similarity, and near-duplicate texts by them.

Sets that agree in a band of MinHash values meet at the band's key. Every member is first compared with
one of its key, then those left outside with one of them, so a crowd of near copies is joined in a few
times as many comparisons as it has members. What is in different components at one key even then is
compared pair by pair: few pairs are listed, many are dealt to block pairs (key, block, block) of a
bounded number of rows, which give the links that join them, so that no key is one task and no crowd
becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, materialize
from .components import connected
from .simhash import fingerprint, link_fingerprints

SIMILARITY = 0.8
#: Bands of MinHash values of a whole text: of pairs at similarity 0.8, all but 6 in 10 million meet.
BANDS, ROWS = 20, 3
#: Rows of one side of a block pair, and up to how many pairs a member a key's pairs are listed. They change no result.
BLOCK_ROWS, LISTED = 256, 8
#: Up to this many candidate pairs they are broadcast to the sets; beyond it, sets are joined by shuffle.
BROADCAST_PAIRS = 200_000
#: Rounds in which the members of a key are compared with one of them. It changes no result.
STARS = 3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 12


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def seeds(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _MIX) | np.uint64(1)


_SEEDS = seeds(BANDS * ROWS)


def band_keys(shingles: np.ndarray) -> list[int]:
    """The keys of a set's bands; of an empty set: none."""
    if not len(shingles):
        return []
    least = np.full(len(_SEEDS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), _CHUNK):
        least = np.minimum(least, mixed(shingles[None, i : i + _CHUNK] * _SEEDS[:, None]).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mixed((keys + column) * _MIX)
    return keys.view(np.int64).tolist()


def _similar(a: Column, b: Column, similarity: float) -> Column:
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(small >= similarity * large, both >= similarity * (small + large - both)).otherwise(False)


def sent(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_PAIRS else rows


def _block_links(table: pa.Table, similarity: float) -> pa.Table:
    """Links between members outside the largest component (left) and members in general, one block each: those that join what is similar."""
    left = table.column("left").to_numpy()
    order = np.argsort(~left, kind="stable")
    n = int(left.sum())
    hashes, labels = (table.column(c).to_numpy()[order] for c in ("hash", "label"))
    sets = table.column("shingles").combine_chunks().take(pa.array(order))
    sizes = sets.value_lengths().to_numpy()
    values, of = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    in_both = (np.bincount(of[row < n], minlength=len(values)) > 0) & (np.bincount(of[row >= n], minlength=len(values)) > 0)
    column = (np.cumsum(in_both) - 1)[of]
    keep = in_both[of]
    row, column = row[keep], column[keep]
    by_column = np.argsort(column, kind="stable")
    row, column = row[by_column], column[by_column]
    both = np.zeros((n, len(sizes) - n), dtype=np.float32)
    for start in range(0, int(in_both.sum()), _CHUNK):
        i, j = np.searchsorted(column, [start, start + _CHUNK])
        held = np.zeros((len(sizes), _CHUNK), dtype=np.float32)
        held[row[i:j], column[i:j] - start] = 1
        both += held[:n] @ held[n:].T
    near = (both >= similarity * (sizes[:n, None] + sizes[None, n:] - both)) & (labels[:n, None] != labels[None, n:])
    a, b = [], []
    for i in np.nonzero(near.any(axis=1))[0]:
        others = n + np.nonzero(near[i])[0]
        found, first = np.unique(labels[others], return_index=True)
        for other, at in zip(found, others[first], strict=True):
            if other != labels[i]:
                a.append(int(hashes[i]))
                b.append(int(hashes[at]))
                labels = np.where(labels == other, labels[i], labels)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def links(keyed: DataFrame, fetch: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY, block_rows: int = BLOCK_ROWS, listed: int = LISTED, stars: int = STARS, pairs: DataFrame | None = None) -> DataFrame:
    """keyed: key, hash, both long: the keys at which each set meets others. fetch(hashes) gives hash, shingles (array of distinct longs).

    Returns a, b: links between sets that meet at a key and are similar, enough of them to join all that are.
    pairs: a, b: further candidates, from another search.
    """
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("hash").alias("leader")).filter("n > 1")
    members = materialize(keyed.join(groups, "key"), "band-members")
    wanted = members.select("hash")
    star = members.filter("hash <> leader").select(F.col("leader").alias("a"), F.col("hash").alias("b"))
    if pairs is not None:
        star, wanted = star.unionByName(pairs.select("a", "b")), wanted.union(pairs.select(F.explode(F.array("a", "b"))))
    if wanted.isEmpty():
        return star
    sets = materialize(fetch(wanted.distinct()).select("hash", "shingles"), "shingle-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        # only the sets that a pair names move
        pairs = materialize(pairs.distinct(), "pairs")
        left = sets.toDF("a", "set_a").join(sent(pairs.select("a").distinct()), "a")
        both = sets.toDF("b", "set_b").join(sent(pairs), "b").join(left, "a")
        return both.filter(_similar(F.col("set_a"), F.col("set_b"), similarity)).select("a", "b")

    found = materialize(verified(star), "star-links")
    n, inside = F.col("n"), F.col("major")["n"]
    for nth in range(1, stars + 1):
        labelled = members.select("key", "hash").join(connected(found).toDF("hash", "root"), "hash", "left").select("key", "hash", F.coalesce("root", "hash").alias("label"))
        # of a key with several labels, the members outside the largest label meet all the others
        per_label = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
        per_key = per_label.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("major"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares")).filter("n > major.n")
        per_key = per_key.select(
            "key", F.col("major")["label"].alias("major"), F.ceil(n / block_rows).cast("int").alias("blocks"), F.ceil((n - inside) / block_rows).cast("int").alias("outside_blocks"),
            (n.cast("double") * n - F.col("squares") <= 2.0 * listed * n).alias("few"),
        )
        rest = materialize(labelled.join(per_key, "key"), "open-members")
        if rest.isEmpty():
            return found
        if nth < stars:
            leaders = rest.filter("NOT few AND label <> major").groupBy("key").agg(F.min(F.struct(F.xxhash64("hash", F.lit(nth)).alias("rank"), "hash", "label")).alias("leader"))
            star = rest.join(leaders, "key").filter(F.col("label") != F.col("leader.label")).select(F.col("leader.hash").alias("a"), F.col("hash").alias("b"))
            found = materialize(found.unionByName(verified(star)), "star-links")

    block = lambda of: F.pmod(F.xxhash64("hash"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    few = rest.filter("few")
    pair = few.filter("label <> major").select("key", F.col("hash").alias("a"), F.col("label").alias("label_a")).join(few.select("key", F.col("hash").alias("b"), F.col("label").alias("label_b"), "major"), "key")
    pair = pair.filter((F.col("label_a") != F.col("label_b")) & ((F.col("label_b") == F.col("major")) | (F.col("a") < F.col("b")))).select("a", "b")
    many = rest.filter("NOT few").join(sets, "hash")
    left = many.filter("label <> major").select("key", "hash", "label", "shingles", F.lit(True).alias("left"), block("outside_blocks").alias("i"), every("blocks").alias("j"))
    right = many.select("key", "hash", "label", "shingles", F.lit(False).alias("left"), every("outside_blocks").alias("i"), block("blocks").alias("j"))
    dealt = left.unionByName(right).groupBy("key", "i", "j").applyInArrow(lambda table: _block_links(table, similarity), "a long, b long")
    return found.unionByName(verified(pair)).unionByName(dealt)


def _set_of(text: bytes | None) -> tuple[np.ndarray, bool]:
    """The set of a whole text: of its five-word shingles, or of all its words together where there are fewer than five."""
    from .passages import Text

    t = Text(text)
    if len(t.shingles):
        return np.unique(t.shingles), True
    return np.array([xxhash.xxh64_intdigest(t.words.tobytes(), 2)], dtype=np.uint64)[: len(t.words)], False


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component of texts whose Jaccard similarity over five-word shingles is enough, columns unchanged.

    A row is its id and text: rows that share an id and hold unrelated texts all stay, and a row with a null id stays
    unless its component has another. The least id leads, null last. A text of fewer than five words is one shingle;
    texts without words, null ones included, are equal. Words are lower-cased (A-Z) and parted at ASCII white space.
    An empty table gives no rows; other columns are carried along and may have any name.

    Candidates are what SimHash anchors link, by fingerprints over the same shingles, and what meets in a MinHash band:
    texts of similarity 0.8 differ in 4 to 14 of 64 bits, which no covering radius reaches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            nodes, bands, fps = [], [], []
            for raw in batch.column(2):
                found, long = _set_of(raw.as_py())
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), 3))
                bands.append(band_keys(found) if long else [])
                fps.append(fingerprint(raw.as_py(), 5) if long else None)
            node = pa.array(np.array(nodes, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), node, pa.array(bands, pa.list_(pa.int64())), pa.array(fps, pa.int64())], ["id", "text_hash", "hash", "bands", "fp"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    rows = source.mapInArrow(run, f"id {id_type}, text_hash long, hash long, bands array<long>, fp long")
    row = F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_hash")
    nodes = materialize(rows.groupBy("hash").agg(F.min(row).alias("first"), F.min("bands").alias("bands"), F.min("fp").alias("fp")), "distinct-texts")

    def fetch(hashes: DataFrame) -> DataFrame:
        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
                found = [_set_of(raw.as_py())[0].view(np.int64) for raw in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["hash", "shingles"])

        at = materialize(nodes.join(hashes, "hash").select("hash", F.col("first")["id"].alias("at_id"), F.col("first")["text_hash"].alias("at_hash")), "wanted-texts")
        found = source.join(sent(at), F.col("id").eqNullSafe(F.col("at_id")) & (F.col("text_hash") == F.col("at_hash")))
        return found.select("hash", "text").mapInArrow(sets, "hash long, shingles array<long>").dropDuplicates(["hash"])

    # of one fingerprint the least set stands for all, and each of them is a candidate with it
    lead = nodes.filter("fp IS NOT NULL").groupBy("fp").agg(F.min("hash").alias("lead"))
    near = link_fingerprints(lead.select("fp")).join(lead.toDF("a", "lead_a"), "a").join(lead.toDF("b", "lead_b"), "b").select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))
    near = near.unionByName(nodes.join(lead, "fp").select(F.col("lead").alias("a"), F.col("hash").alias("b"))).filter("a <> b").distinct()
    near = materialize(near, "simhash-links")
    roots = connected(links(nodes.select("hash", F.explode("bands").alias("key")), fetch, similarity, pairs=near)).toDF("hash", "root")
    leads = nodes.join(roots, "hash", "left").groupBy(F.coalesce("root", "hash").alias("root")).agg(F.min("first").alias("first"))
    return keep_rows(docs, leads.select("first.*"), id_col, text_col)
