"""Ranked lexical search over an index that is stratified by document length.

Documents of one normaliser m are a stratum. In it a term's postings lie by term frequency, and since the impact of a
posting depends on m and frequency alone, it is computed once for each frequency of a stratum. The largest impact of
each term bounds what a stratum can give a query: strata are visited in the order of these bounds, and what is left
when the bound falls below the tenth best score is never scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

#: Best documents of an item.
TOP = 10
#: Terms, repeats included, of one block of items: bounds what is broadcast. Each further block reads the documents once more.
BLOCK_TERMS = 400_000
#: Documents, and postings, of one shard of the index: bound what a task holds.
SHARD_DOCUMENTS, SHARD_POSTINGS = 40_000, 4_000_000
#: Documents of the first strata that an item visits; each later visit is of four times as many.
FIRST_VISIT = 512
#: Rows handled at once: bounds what a worker holds beside the batch that it reads.
ROWS_AT_ONCE = 500
_TERM = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def terms_of(text: str | None) -> list[str]:
    """Maximal runs of ASCII letters and digits and of what is not ASCII; only A-Z are lower-cased."""
    return _TERM.findall(text.translate(_LOWER)) if text else []


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Items, each once, in blocks of about BLOCK_TERMS terms: (item, text). One block is on the driver at a time."""
    size = F.regexp_count(F.col("text"), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    each = materialize(items.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct().withColumn("size", size), "items")
    n_blocks = -(-(each.agg(F.sum("size")).first()[0] or 0) // BLOCK_TERMS)
    for k in range(n_blocks):
        if rows := each.filter(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == k).select("item", "text").collect():
            yield [tuple(r) for r in rows]


def index(docs: DataFrame, lexicon: Broadcast, id_col: str, text_col: str) -> DataFrame:
    """One row per document with a term: id, n (its terms, repeats included), terms and tfs (of the lexicon's terms, by number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lexicon.value
        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            keep, n, terms, tfs = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if found := terms_of(text):
                    counted = Counter(filter(number.__contains__, found))
                    keep.append(i)
                    n.append(len(found))
                    terms.append([number[t] for t in counted])
                    tfs.append(list(counted.values()))
            columns = [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, terms array<int>, tfs array<int>")


class Shard:
    """Some documents' postings: by term, stratum and frequency."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        self.ids = ids
        self.m, stratum_of = np.unique(m, return_inverse=True)
        self.documents = np.bincount(stratum_of, minlength=len(self.m))
        doc = np.repeat(np.arange(len(ids)), counts)
        stratum = stratum_of[doc]
        order = np.lexsort((-tfs, stratum, terms))
        self.doc, term, stratum, tf = doc[order], terms[order], stratum[order], tfs[order].astype(np.int64)
        pair, at = np.unique(stratum * (int(tf.max(initial=0)) + 1) + tf, return_inverse=True)
        of, f = np.divmod(pair, int(tf.max(initial=0)) + 1)
        self.impact = ((1_000_000_000 * f) // (1000 * f + 8 * self.m[of]))[at]  # once for each (stratum, tf)
        new = np.append(True, (term[1:] != term[:-1]) | (stratum[1:] != stratum[:-1])) if len(term) else np.zeros(0, dtype=bool)
        self.begin = np.flatnonzero(new)  # of a run of postings of one term in one stratum; its first impact is the largest
        self.length = np.diff(np.append(self.begin, len(term)))
        self.stratum, run_term = stratum[self.begin], term[self.begin]
        self.most = self.impact[self.begin]
        known, first = np.unique(run_term, return_index=True)
        self.runs = dict(zip(known.tolist(), zip(first.tolist(), np.append(first[1:], len(run_term)).tolist(), strict=True), strict=True))

    def best(self, weights: list[tuple[int, int]], top: int, first: int) -> list[tuple[int, int]]:
        """The top (score, id) of a query given as (term, weight) pairs, best first, equal scores by id; first: documents of the first visit."""
        spans = [(*self.runs[t], w) for t, w in weights if t in self.runs]
        if not spans:
            return []
        run = np.concatenate([np.arange(a, b) for a, b, _ in spans])
        weight = np.repeat(np.array([w for *_, w in spans], dtype=np.int64), [b - a for a, b, _ in spans])
        stratum = self.stratum[run]
        bound = np.zeros(len(self.m), dtype=np.int64)
        np.add.at(bound, stratum, weight * self.most[run])
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        reached = np.cumsum(self.documents[order])
        visit = np.full(len(self.m), -1)
        visit[order] = np.searchsorted(first * 4 ** np.arange(16), reached)
        found_score, found_doc = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for k in np.unique(visit[order]).tolist():
            now = visit == k
            if len(found_score) == top:
                now &= bound >= found_score[-1]  # an equal score may still win by its id
            chosen = now[stratum]
            if not chosen.any():
                continue
            begin, length = self.begin[run[chosen]], self.length[run[chosen]]
            done = np.cumsum(length)
            postings = np.repeat(begin - (done - length), length) + np.arange(done[-1])
            docs, local = np.unique(self.doc[postings], return_inverse=True)
            scores = np.zeros(len(docs), dtype=np.int64)
            np.add.at(scores, local, np.repeat(weight[chosen], length) * self.impact[postings])
            score, doc = np.concatenate([found_score, scores]), np.concatenate([found_doc, docs])
            if len(score) > 4 * top:
                high = score >= np.partition(score, -top)[-top]
                score, doc = score[high], doc[high]
            rank = np.lexsort((self.ids[doc], -score))[:top]
            found_score, found_doc = score[rank], doc[rank]
        return [(s, i) for s, i in zip(found_score.tolist(), self.ids[found_doc].tolist(), strict=True) if s > 0]


def _ranked(batches: Iterator[pa.RecordBatch], queries: Broadcast, top: int, first: int, most: int) -> Iterator[pa.RecordBatch]:
    """Each query's best documents among the rows of a partition, which are strata one after the other, in shards of bounded size."""
    held: list[pa.RecordBatch] = []
    documents = postings = 0
    for batch in batches:
        held.append(batch)
        documents += batch.num_rows
        postings += len(batch.column(2).flatten())
        if documents >= most or postings >= SHARD_POSTINGS:
            yield _best_of(held, queries.value, top, first)
            held, documents, postings = [], 0, 0
    if held:
        yield _best_of(held, queries.value, top, first)


def _best_of(batches: list[pa.RecordBatch], queries: list[tuple[int, list[tuple[int, int]]]], top: int, first: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    column = lambda k: table.column(k).combine_chunks()
    lists, numbers = column(2), lambda x: x.to_numpy(zero_copy_only=False)
    shard = Shard(numbers(column(0)), numbers(column(1)), np.diff(numbers(lists.offsets)), numbers(lists.flatten()).astype(np.int64), numbers(column(3).flatten()))
    rows = [(q, score, doc) for q, weights in queries for score, doc in shard.best(weights, top, first)]
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "score", "doc_id"])


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long): each item's best documents with a score above 0.

    Equal scores go by ascending doc_id. Every document counts in the statistics, copies included, and may be returned;
    rows that share an id are documents of their own; a null text has no terms, and a document of a null id counts but
    isn't returned. An item with no terms has no rows; of repeated items with one text one is ranked, and items that share
    an id but not the text are ranked apart. Other columns are not read; empty tables give no rows.
    """
    spark, out = docs.sparkSession, None
    for block in _blocks(items, item_col, item_text_col):
        words = [Counter(terms_of(text)) for _, text in block]
        lexicon = {t: i for i, t in enumerate(dict.fromkeys(t for c in words for t in c))}
        rows = materialize(index(docs, spark.sparkContext.broadcast(lexicon), id_col, text_col), "index")
        total, length = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect()) if total else {}
        weight = {t: int(np.floor(1000 * np.log((2 * total + 2) / (2 * n + 1)))) for t, n in df.items()}
        asked = [(q, [(lexicon[t], weight[lexicon[t]] * n) for t, n in c.items() if weight.get(lexicon[t], 0) > 0]) for q, c in enumerate(words)]
        queries = spark.sparkContext.broadcast([(q, terms) for q, terms in asked if terms])
        stratum = F.expr(f"25 + (75 * n * {total}L) div {max(length, 1)}L")
        parts = max(1, min(-(-total // SHARD_DOCUMENTS) * 2, 100_000), min(total // 2_000, spark.sparkContext.defaultParallelism))
        strata = rows.filter("id is not null and size(terms) > 0").select("id", stratum.alias("m"), "terms", "tfs").repartitionByRange(parts, "m", F.xxhash64("id")).sortWithinPartitions("m")
        best = strata.mapInArrow(lambda batches, queries=queries, first=FIRST_VISIT, most=SHARD_DOCUMENTS: _ranked(batches, queries, top, first, most), "query long, score long, doc_id long")
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], f"query long, item_id {items.schema[item_col].dataType.simpleString()}")
        found = materialize(ranked.join(names, "query").select("item_id", "rank", "doc_id", "score"), "ranked")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"item_id {items.schema[item_col].dataType.simpleString()}, rank int, doc_id long, score long")
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score of each benchmark item's ten best documents."""
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
qtf AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term),
stats AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS length FROM d WHERE len(terms) > 0),
sized AS (SELECT doc_id, 25 + (75 * len(terms) * n_docs) // length AS m FROM d, stats WHERE len(terms) > 0),
postings AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, stats GROUP BY term, n_docs),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM qtf JOIN weights USING (term) JOIN postings USING (term) JOIN sized USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0)
SELECT item_id, place::INT AS rank, doc_id, score FROM ranked WHERE place <= 10
"""
