"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one kept per component.

A vector is at home in the cell of its nearest centroid and a guest in lower-numbered cells across whose
border a partner may lie. A pair is compared in the lower of its two home cells alone, and homes there
with members, not guests with guests. Cells of many homes are cut again in the same way, by centroids of
their own, level by level, wherever that saves comparisons; a pair is compared where, at each level, one
of the two is at home. How far guests reach across a border is three standard deviations of a random
partner's offset, and never more than the largest offset that any partner can have; tests measure the
recall against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table
from .components import connected

THRESHOLD = 0.95
#: The bound of the sample that centroids are fitted on, and of their number, at each level: both bound what the driver, a task and a broadcast hold.
SAMPLE, MAX_CELLS, ITERATIONS = 20_000, 1024, 8
#: Vectors at home in a cell, as planned; cells of more than LARGE homes are cut again. A vector is compared with as many at every size.
PER_CELL, LARGE = 128, 4096
#: Vectors of a large cell that its centroids are fitted on, and that a task places among them at a time.
CELL_SAMPLE, PLACED_ROWS = 2048, 8192
#: Vectors at home in a cell that a task compares, with eight times as many of its members.
BLOCK = 1024


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def fit_cells(sample: np.ndarray, cells: int, seed: int = 4) -> np.ndarray:
    """Spherical k-means: unit centroids. An empty cell keeps its centroid."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(ITERATIONS):
        home = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        norms = np.linalg.norm(sums, axis=1)
        centres[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centres


def _valid(vector: Column) -> Column:
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _cells_of(vectors: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unit vectors: row, cell, and whether it is at home there; each row at home and as a guest."""
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 1e-12))
    reach = np.sqrt(2 - 2 * threshold) * min(1.0, 3 / np.sqrt(centres.shape[1]))
    dots = vectors @ centres.T
    home = dots.argmax(axis=1)
    margin = (dots[np.arange(len(vectors)), home][:, None] - dots) / apart[home]
    at = (margin <= reach) & (np.arange(len(centres)) < home[:, None])
    at[np.arange(len(vectors)), home] = True
    row, cell = np.nonzero(at)
    return row, cell, home[row] == cell


def _assign(distinct: DataFrame, centres: np.ndarray, threshold: float) -> DataFrame:
    """cell, at, id, weight, vector: each vector at home (at is 1) and as a guest (0). Other lengths than the centroids' are cells of their own, below zero."""
    kind = distinct.schema["vector"].dataType.simpleString()
    sent = distinct.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for batch in (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK)):
            vectors = batch.column(2)
            sizes = vectors.value_lengths().to_numpy()
            other, of_dim = np.nonzero(sizes != centres.shape[1])[0], np.nonzero(sizes == centres.shape[1])[0]
            rows, cells, homes = [other], [-sizes[other]], [np.ones(len(other), dtype=bool)]
            if len(of_dim):
                row, cell, home = _cells_of(unit(_matrix(vectors.take(pa.array(of_dim)))), centres, threshold)
                rows, cells, homes = [*rows, of_dim[row]], [*cells, cell], [*homes, home]
            take = pa.array(np.concatenate(rows))
            cell, at = pa.array(np.concatenate(cells).astype(np.int64)), pa.array(np.concatenate(homes).astype(np.int32))
            yield pa.RecordBatch.from_arrays([cell, at, *(batch.column(k).take(take) for k in range(3))], ["cell", "at", "id", "weight", "vector"])

    return distinct.select("id", "weight", "vector").mapInArrow(run, f"cell long, at int, id long, weight long, vector {kind}")


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return unit(np.concatenate([_matrix(x) for x in column.chunks if len(x)]))


def _cut(placed: DataFrame, level: int, threshold: float, large: int, per_cell: int) -> DataFrame | None:
    """placed with its large cells cut by centroids of their own: bit `level` of at tells who is at home there, and is set of all in other cells. None if no cell is cut.

    A cell is cut if, by its sample, that halves its comparisons at least. One in which everything lies near everything stays whole: its links are as many.
    """
    kind, bit = placed.schema["vector"].dataType.simpleString(), 1 << level
    sizes = placed.groupBy("cell").agg(F.count_if(F.col("at") % 2 == 1).alias("homes"), F.count("*").alias("members")).filter(F.col("homes") > large)
    sizes = materialize(sizes, "large-cells")
    if sizes.isEmpty():
        return None
    drawn = (F.xxhash64("vector", F.lit(level)).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)) < CELL_SAMPLE / F.col("homes")

    def fit(table: pa.Table) -> pa.Table:
        sample, cells = _vectors(table.column("vector")), int(min(MAX_CELLS, max(2, table.column("homes")[0].as_py() // per_cell)))
        centres = fit_cells(sample, min(cells, len(sample)))
        places = len(_cells_of(sample, centres, threshold)[0]) / len(sample)
        n = len(centres) if 2 * places * places < len(centres) else 0
        return pa.table({"cell": pa.array([table.column("cell")[0].as_py()] * n, pa.int64()), "k": pa.array(range(n), pa.int32()), "centre": pa.array(list(centres[:n]), pa.list_(pa.float64()))})

    sample = placed.filter(F.col("at") == bit - 1).join(sizes, "cell").filter(drawn).select("cell", "homes", "vector")
    centres = materialize(sample.groupBy("cell").applyInArrow(fit, "cell long, k int, centre array<double>"), "cell-centroids")
    if centres.isEmpty():
        return None
    parts = sizes.join(centres.select("cell").distinct(), "cell").select("cell", F.ceil(F.col("members") / PLACED_ROWS).cast("int").alias("parts"))
    rows = placed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    sent = centres.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "k", "centre")

    def place(members: pa.Table, centres: pa.Table) -> pa.Table:
        if not len(members):
            return pa.table({c: pa.array([], t) for c, t in zip(("cell", "k", "at", "id", "weight", "vector"), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), members.schema.field("vector").type), strict=True)})
        centres = centres.sort_by("k")
        row, k, home = _cells_of(_vectors(members.column("vector")), np.concatenate([_matrix(x) for x in centres.column("centre").chunks if len(x)]), threshold)
        found = members.select(["cell", "at", "id", "weight", "vector"]).take(pa.array(row))
        at = found.column("at").to_numpy() | np.where(home, bit, 0)
        return pa.table({"cell": found.column("cell"), "k": pa.array(k.astype(np.int32)), "at": pa.array(at.astype(np.int32)), **{c: found.column(c) for c in ("id", "weight", "vector")}})

    again = rows.groupBy("cell", "part").cogroup(sent.groupBy("cell", "part")).applyInArrow(place, f"cell long, k int, at int, id long, weight long, vector {kind}")
    again = again.select(F.xxhash64("cell", "k", F.lit(level)).alias("cell"), "at", "id", "weight", "vector")
    rest = placed.join(parts, "cell", "left_anti").withColumn("at", F.col("at").bitwiseOR(F.lit(bit)))
    return materialize(rest.select("cell", "at", "id", "weight", "vector").unionByName(again), "cells")


def _compare(level: int, homes: tuple[np.ndarray, ...], members: tuple[np.ndarray, ...], threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Some homes of a cell against some of its members, each given as ids, at, weights and unit vectors.

    Returns the links of each home, those of each guest, both by weight, and links that join what these join. A member
    that is at home here gets its count where it is among the homes.
    """
    (a, a_at, a_weight, x), (b, b_at, b_weight, y) = homes, members
    near = (x @ y.T >= threshold) & (a[:, None] != b[None, :])
    if level > 1:
        near &= (a_at[:, None] | b_at[None, :]) == (1 << level) - 1
    of_guests = np.where(b_at & 1, 0, a_weight @ near)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, forest = np.arange(len(nodes)), []
    for i in np.nonzero(near.any(axis=1))[0]:
        others = at[len(a) :][near[i]]
        labels, first = np.unique(label[others], return_index=True)
        own = label[at[i]]
        forest += [(int(a[i]), int(nodes[others[j]])) for j, k in zip(first, labels, strict=True) if k != own]
        label[np.isin(label, [*labels, own])] = min(labels[0], own)
    return near @ b_weight, of_guests, forest


def link_vectors(distinct: DataFrame, threshold: float = THRESHOLD, per_cell: int = PER_CELL, max_cells: int = MAX_CELLS, large: int = LARGE) -> DataFrame:
    """distinct: id, weight, vector. Returns id, n (partial counts of links, by weight), to (null, or the other end of a link)."""
    by_size = distinct.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    n = distinct.count()
    cells = int(min(max_cells, max(1, np.ceil(n / per_cell))))
    rows = distinct.filter(F.size("vector") == (by_size["d"] if by_size else 0)).orderBy(F.xxhash64("vector", F.lit(4))).limit(SAMPLE).select("vector").collect()
    centres = fit_cells(unit(np.array([r["vector"] for r in rows])), cells) if rows else np.zeros((1, 1))
    placed, level = materialize(_assign(distinct, centres, threshold), "cells"), 1
    while (cut := _cut(placed, level, threshold, large, per_cell)) is not None:
        placed, level = cut, level + 1
    at_home = F.col("at") % 2 == 1
    blocks = placed.groupBy("cell").agg(F.ceil(F.count_if(at_home) / BLOCK).cast("int").alias("home_blocks"), F.ceil(F.count("*") / (8 * BLOCK)).cast("int").alias("member_blocks"))
    rows = placed.join(blocks, "cell")
    block = lambda n: F.pmod(F.xxhash64("id"), F.greatest(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["cell", "at", "id", "weight", "vector"]
    homes = rows.filter(at_home).select(*columns, F.lit(True).alias("as_home"), block("home_blocks").alias("a"), every("member_blocks").alias("b"))
    members = rows.filter("home_blocks > 0").select(*columns, F.lit(False).alias("as_home"), every("home_blocks").alias("a"), block("member_blocks").alias("b"))

    def run(table: pa.Table) -> pa.Table:
        ids, at, weight, as_home = (table.column(c).to_numpy() for c in ("id", "at", "weight", "as_home"))
        vectors = _vectors(table.column("vector"))
        h, m = (tuple(c[side] for c in (ids, at, weight, vectors)) for side in (as_home, ~as_home))
        if not len(h[0]) or not len(m[0]):
            return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
        of_homes, of_guests, forest = _compare(level, h, m, threshold)
        n = np.concatenate([of_homes, of_guests, np.zeros(len(forest), np.int64)]).astype(np.int64)
        who = np.concatenate([h[0], m[0], np.array([x for x, _ in forest], dtype=np.int64)])
        to = np.array([None] * (len(h[0]) + len(m[0])) + [x for _, x in forest], dtype=object)
        some = (n > 0) | (np.arange(len(n)) >= len(n) - len(forest))
        return pa.table({"id": pa.array(who[some], pa.int64()), "n": pa.array(n[some], pa.int64()), "to": pa.array(to[some].tolist(), pa.int64())})

    return homes.unionByName(members).groupBy("cell", "a", "b").applyInArrow(run, "id long, n long, to long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, **limits: int) -> DataFrame:
    """One row per row of vectors: id, n_links (others linked directly), component_id (least id reachable), kept.

    A vector that is null, empty, zero or holds a null or non-finite component links with nothing. Vectors of
    different lengths don't link. Copies are compared once, as one vector with a weight; rows that repeat an id
    are vectors of their own. A row without an id links with nothing: no links, a null component, kept. Other columns
    are not read; no rows give none. limits: per_cell, max_cells and large of link_vectors(), for tests.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    # a vector's number is its own, since rows that repeat an id may hold different ones; it is written once and read from then on
    distinct = rows.filter(_valid(F.col("vector")) & F.col("id").isNotNull()).groupBy("vector").agg(F.min("id").alias("first"), F.count("*").alias("weight"))
    distinct = materialize(distinct.withColumn("id", F.monotonically_increasing_id()), "vectors")
    found = materialize(link_vectors(distinct, threshold, **limits), "vector-links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = connected(found.filter("to IS NOT NULL").select(F.col("id").alias("a"), F.col("to").alias("b"))).toDF("id", "root")
    known = distinct.join(counts, "id", "left").join(roots, "id", "left").select("vector", "first", "weight", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "id").alias("root"))
    known = materialize(known, "rooted-vectors")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    of_vector = known.join(least, "root").select("vector", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id")
    named = F.col("id").isNotNull()
    out = rows.join(of_vector, "vector", "left").select(F.col("id").alias(id_col), F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"), F.when(named, F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
