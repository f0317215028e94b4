"""Repeated passages: MinHash banding of paragraphs, and of blocks cut where the content says.

A paragraph is a line of LINE_WORDS words or more: every line that has a five-word shingle. Paragraphs that agree
in a band of MinHash values meet, and those of Jaccard SIMILARITY or more over five-word shingles are linked. A passage that recurs inside
other text shares no paragraph with its copies, so texts are also cut into blocks of BLOCK_WORDS words that
begin at the least shingle hash of any WINDOW: a run of WINDOW + BLOCK_WORDS - 1 equal words holds an equal
block. Blocks match exactly. Classes are components over both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table
from .components import connected
from .jaccard import links

SHINGLE, SIMILARITY = 5, 0.8
LINE_WORDS, BLOCK_WORDS, WINDOW = SHINGLE, 34, 17
#: Bands of two MinHash values: of pairs at similarity 0.8, all but 4 in 100,000 meet in one of ten.
BANDS, ROWS = 10, 2
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 16


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


_SEEDS = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _MIX) | np.uint64(1)


class Text:
    """The words of a text as hashes, its five-word shingles as hashes, and where its lines lie, in words."""

    def __init__(self, text: bytes | None):
        lines = [line.split() for line in (text or b"").lower().split(b"\n")]
        digest = xxhash.xxh64_intdigest
        self.words = np.array([digest(w) for line in lines for w in line], dtype=np.uint64)
        ends = np.cumsum([len(line) for line in lines])
        self.lines = [(int(e) - len(line), int(e)) for line, e in zip(lines, ends, strict=True) if len(line) >= LINE_WORDS]
        n = max(0, len(self.words) - SHINGLE + 1)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(SHINGLE):
            h = (h + self.words[k : k + n]) * _MIX
        self.shingles = _mixed(h)

    def line_hash(self, start: int, stop: int) -> int:
        return int(np.uint64(xxhash.xxh64_intdigest(self.words[start:stop].tobytes(), 1)).view(np.int64))

    def set_of(self, start: int, stop: int) -> np.ndarray:
        return np.unique(self.shingles[start : stop - SHINGLE + 1])

    def bands(self, start: int, stop: int) -> list[int]:
        least = _mixed(self.set_of(start, stop)[None, :] * _SEEDS[:, None]).min(axis=1).reshape(BANDS, ROWS)
        keys = _mixed(least[:, 0] * _MIX + least[:, 1] + np.arange(BANDS, dtype=np.uint64))
        return keys.view(np.int64).tolist()

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Where blocks start, and their hashes."""
        last = len(self.words) - BLOCK_WORDS
        if last < 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        width, found = min(WINDOW, len(self.shingles)), []
        for at in range(0, len(self.shingles) - width + 1, _CHUNK):
            windows = np.lib.stride_tricks.sliding_window_view(self.shingles[at : at + _CHUNK + width - 1], width)
            found.append(np.unique(windows.argmin(axis=1) + np.arange(at, at + len(windows))))
        starts = np.unique(np.concatenate(found))
        starts = starts[starts <= last]
        h = np.zeros(len(starts), dtype=np.uint64)
        for k in (*range(0, BLOCK_WORDS - SHINGLE, SHINGLE), BLOCK_WORDS - SHINGLE):
            h = (h + self.shingles[starts + k]) * _MIX
        return starts, _mixed(h).view(np.int64)


def units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, start, stop (words), hash, bands (null of blocks): a row for every paragraph and block, over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
            ids, starts, stops, hashes, bands = [], [], [], [], []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = Text(raw.as_py())
                at, h = text.blocks()
                n = len(at) + len(text.lines)
                ids.append(np.full(n, doc, dtype=np.int64))
                starts += [at, np.array([a for a, _ in text.lines], dtype=np.int64)]
                stops += [at + BLOCK_WORDS, np.array([b for _, b in text.lines], dtype=np.int64)]
                hashes += [h, np.array([text.line_hash(*x) for x in text.lines], dtype=np.int64)]
                bands += [None] * len(at) + [text.bands(*x) for x in text.lines]
            joined = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (ids, starts, stops, hashes)]
            columns = [pa.array(joined[0]), pa.array(joined[1].astype(np.int32)), pa.array(joined[2].astype(np.int32)), pa.array(joined[3])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bands, pa.list_(pa.int64()))], ["id", "start", "stop", "hash", "bands"])

    source = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, "id long, start int, stop int, hash long, bands array<long>")


def _line_links(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """a, b: hashes of different paragraphs that meet in a band and are similar, enough of them to join all that are."""
    lines = rows.filter("bands IS NOT NULL").groupBy("hash").agg(F.min(F.struct("id", "start", "stop")).alias("at"), F.min("bands").alias("bands"))
    lines = materialize(lines, "lines")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
            hashes, found = [], []
            for raw, places in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = Text(raw.as_py())
                for p in places:
                    if text.line_hash(p["start"], p["stop"]) == p["hash"]:  # rows may share an id
                        hashes.append(p["hash"])
                        found.append(text.set_of(p["start"], p["stop"]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["hash", "shingles"])

    def fetch(hashes: DataFrame) -> DataFrame:
        wanted = lines.join(hashes, "hash").groupBy("at.id").agg(F.collect_list(F.struct("hash", "at.start", "at.stop")).alias("wanted"))
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
        return texts.join(wanted, "id").select("text", "wanted").mapInArrow(sets, "hash long, shingles array<long>").dropDuplicates(["hash"])

    return links(lines.select("hash", F.explode("bands").alias("key")), fetch, similarity)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row for every stretch of a document that recurs in another: id, start, stop (words, stop exclusive), removed, kept_in.

    Of every class the least id keeps its paragraph or block; elsewhere it is removed. Stretches that touch are one
    row, kept and removed ones apart; kept_in is the least id that keeps any of it. Null and short texts, documents
    that share nothing and rows with a null id have no rows; rows that share an id are one document. Extra columns
    are not read.
    """
    rows = materialize(units(docs, id_col, text_col), "units")
    exact = materialize(rows.groupBy("hash").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.col("bands").isNotNull()).alias("line")).filter("line OR first < last"), "unit-hashes")
    roots = connected(_line_links(docs, rows, id_col, text_col, similarity)).toDF("hash", "root")
    rooted = exact.join(roots, "hash", "left").select("hash", F.coalesce("root", "hash").alias("root"), "first", "last")
    rooted = materialize(rooted, "rooted-units")
    classes = rooted.groupBy("root").agg(F.min("first").alias("kept_in"), F.max("last").alias("last")).filter("kept_in < last").select("root", "kept_in")
    of_hash = rooted.join(classes, "root").select("hash", "kept_in")
    hits = rows.join(of_hash, "hash").select("id", "start", "stop", (F.col("id") != F.col("kept_in")).alias("removed"), "kept_in")
    by_doc = Window.partitionBy("id", "removed").orderBy("start", "stop")
    reached = F.max("stop").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.withColumn("opens", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
    stretch = marked.withColumn("stretch", F.sum("opens").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    merged = stretch.groupBy("id", "removed", "stretch").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("kept_in").alias("kept_in"))
    return merged.select(F.col("id").alias(id_col), "start", "stop", "removed", "kept_in")


def without_repeats(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the removed stretches of repeated_passages() cut out of the texts; a null text stays null.

    Equal rows are cut alike. A stretch is known by id and words alone, so rows that share an id must share their text;
    what lies beyond the end of a text cuts nothing.
    """
    spans = passages.filter("removed").groupBy(F.col(id_col).alias("__id")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("__spans"))

    @F.pandas_udf("string")
    def cut(texts, spans):  # noqa: ANN001, ANN202
        def one(text: str | None, found) -> str | None:  # noqa: ANN001
            if text is None or found is None:
                return text
            words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
            out, at = [], 0
            for s in (x for x in found if x["stop"] <= len(words)):
                out.append(text[at : max(at, words[s["start"]][0])])
                at = max(at, words[s["stop"] - 1][1])
            return "".join([*out, text[at:]])

        import pandas as pd

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)])

    joined = docs.join(spans, F.col(id_col) == F.col("__id"), "left")
    return joined.select(*[(cut(text_col, "__spans") if c == text_col else F.col(c)).alias(c) for c in docs.columns])


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"))
