"""Language identification: averaged hashed subword embeddings under a linear softmax.

A word's features are its hashed character n-grams, edges marked; a text's vector is the mean of
their embeddings. The model is trained by stochastic gradient descent in numpy on a bounded sample
of labelled texts, of which tasks count the n-grams; a temperature and a rejection threshold are then
fitted on a part held back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

UNDETERMINED = "und"
#: The bound of the sample in texts. They are counted whole, where they lie; what the driver gets is BUCKETS numbers a text at most.
SAMPLE_TEXTS = 2000
BUCKETS, DIMENSION, ORDERS = 1 << 15, 16, (1, 2, 3, 4)
EPOCHS, RATE = 6, 0.5
#: Bytes of a text that are hashed at a time.
BLOCK = 1 << 20
_LETTER = regex.compile(r"\p{L}")


def bucket_counts(text: bytes) -> np.ndarray:
    """How often each bucket occurs among the byte n-grams of a text's words; a blank at either end is part of a word."""
    whole = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", dtype=np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS)
    for at in range(0, len(whole), BLOCK):
        data = whole[at : at + BLOCK + max(ORDERS) - 1]
        blank = data == 0x20
        for n in ORDERS:
            m = min(BLOCK, len(data) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, 2166136261 + n, dtype=np.uint32)
            for k in range(n):
                h = (h ^ data[k : m + k]) * np.uint32(16777619)
            inside = blank[:m].copy() if n == 1 else np.zeros(m, dtype=bool)
            for k in range(1, n - 1):
                inside |= blank[k : m + k]
            counts += np.bincount(((h ^ h >> np.uint32(15)) % np.uint32(BUCKETS))[~inside], minlength=BUCKETS)
    return counts


@dataclass
class Model:
    languages: list[str]
    #: BUCKETS x DIMENSION numbers, and DIMENSION numbers a language.
    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, ids: np.ndarray, share: np.ndarray) -> np.ndarray:
        return share @ self.embedding[ids] @ self.weights + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], seed: int = 7) -> Model:
    """rows: (buckets, counts, language), in a fixed order. Every fifth is held back to calibrate. No rows: one language, und."""
    languages = sorted({lang for *_, lang in rows}) or [UNDETERMINED]
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSION))
    weights, bias = np.zeros((DIMENSION, len(languages))), np.zeros(len(languages))
    place = {lang: i for i, lang in enumerate(languages)}
    data = [(ids, counts / counts.sum(), place[lang]) for ids, counts, lang in rows if len(ids)]
    fitted, held = [x for i, x in enumerate(data) if i % 5], data[::5]
    steps, total = 0, max(1, EPOCHS * len(fitted))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fitted)):
            ids, share, y = fitted[i]
            rate = RATE * (1 - steps / total)
            steps += 1
            hidden = share @ embedding[ids]
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = weights @ p
            weights -= rate * 10 * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            embedding[ids] -= rate * 10 * np.outer(share, back)
    model = Model(languages, embedding, weights, bias)
    if held:
        logits = np.array([model.logits(ids, share) for ids, share, _ in held])
        truth = np.array([y for *_, y in held])

        def loss(t: float) -> float:
            z = logits / t - (logits / t).max(axis=1, keepdims=True)
            return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean())

        model.temperature = float(min(np.geomspace(0.2, 5, 40), key=loss))
        best = np.array([model.probabilities(x).max() for x in logits])
        model.reject_below = float(np.quantile(best[logits.argmax(axis=1) == truth], 0.005)) if (logits.argmax(axis=1) == truth).any() else 0.0
    return model


def bounded_sample(docs: DataFrame, text_col: str, lang_col: str, limit: int = SAMPLE_TEXTS) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """Buckets and counts of the n-grams of labelled texts, and the language: whole texts, chosen and ordered by hash, the same each time.

    At most `limit` texts, or one a language where there are more languages than that. Equal texts of a language count
    once. Every language has its quota, limit by the number of languages, or all its texts where it has fewer.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    # equal texts of a language are one, however often they come
    labelled = labelled.withColumn("text_hash", F.xxhash64("text", F.lit(12)))
    texts = materialize(labelled.select("text_hash", "lang").distinct(), "labelled-texts")
    sizes = texts.groupBy("lang").agg(F.count("*").alias("n"))
    each = max(1, limit // max(1, sizes.count()))
    # thinned to a few times the quota, so that the ranking below sees a bounded number of rows; a scarce language is thinned little or not
    draw = F.xxhash64("text_hash", F.lit(11)).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    thinned = texts.join(F.broadcast(sizes), "lang").filter(draw <= (2.0 * each + 60) / F.col("n"))  # a row a language
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("text_hash"))
    picked = thinned.withColumn("nth", nth).filter(F.col("nth") <= each).select("text_hash", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts = bucket_counts(batch.column(2)[i].as_py())
                ids = np.nonzero(counts)[0]
                arrays = [pa.array([x], pa.list_(t)) for x, t in ((ids.astype(np.int32), pa.int32()), (counts[ids].astype(np.float32), pa.float32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *arrays], ["text_hash", "lang", "ids", "counts"])

    drawn = labelled.join(F.broadcast(picked), ["text_hash", "lang"]).groupBy("text_hash", "lang").agg(F.min("text").cast("binary").alias("text"))
    found = drawn.mapInArrow(count, "text_hash long, lang string, ids array<int>, counts array<float>").orderBy("text_hash", "lang").drop("text_hash").toArrow()
    columns = (found.column("ids").combine_chunks(), found.column("counts").combine_chunks())
    return [(*(c[i].values.to_numpy() for c in columns), lang) for i, lang in enumerate(found.column("lang").to_pylist())]


def predict_one(model: Model, text: bytes | None) -> tuple[str, float, bool]:
    if not text or not _LETTER.search(text.decode("utf-8", "replace")):
        return UNDETERMINED, 0.0, True
    counts = bucket_counts(text)
    ids = np.nonzero(counts)[0]
    p = model.probabilities(model.logits(ids, counts[ids] / counts[ids].sum()))
    best = int(p.argmax())
    return model.languages[best], float(p[best]), bool(p[best] < model.reject_below)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score (its calibrated probability), rejected (score below the fitted threshold).

    Texts are read whole. A text that is null, empty or has no letter is und, scores 0 and is rejected.
    Only the text is an input. Repeated rows give repeated results; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIMENSION numbers and DIMENSION a language, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict_one(sent.value, t.as_py()) for t in batch.column(1)]
            lang, score, rejected = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    remainder = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3, F.lit(0))
    held_out = remainder == 1
    model = train(bounded_sample(docs.filter(~held_out), "text", "lang"))
    out = predict(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
