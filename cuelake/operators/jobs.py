"""A translation job that outlives bad batches and killed drivers: attempts are rows of a ledger on shared storage.

A round plans batches as a table, sends those that the ledger doesn't have, wave by wave, and commits each wave as a
table of its own. What a killed job had committed is never asked for again: started anew with the same cues and ledger,
it plans the same batches, finds their keys, and goes on with the others. A batch whose call raises is a failed batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .grouped import by_group
from .translate import BATCH, apply_fixes, plan_batches, postprocess, untranslated

#: What a call may count; a request is one call.
USAGE = ("requests", "prompt", "completion", "cache_hit")


class Fatal(Exception):
    """Raised by a caller's function where no further call can succeed: the job ends, and its ledger stays."""


class Truncated(Exception):
    """Raised by a caller's function whose reply was cut off: the batch was too big and is halved."""


@dataclass
class Job:
    """cues: the given ones with tgt and attempts. failed: media_id, ix, src, attempts, error. usage: media_id and USAGE, of all runs on the ledger. waves: what this run has sent, a dictionary a wave."""

    cues: DataFrame
    failed: DataFrame
    usage: DataFrame
    waves: list[dict] = field(default_factory=list)


class Ledger:
    """Tables under one folder, each written once and whole; a table without its mark of success is a killed write and is not read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._dir = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._dir.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = jvm.org.apache.hadoop.fs.Path

    def tables(self, label: str) -> list[str]:
        if not self._fs.exists(self._dir):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._dir)]
        return sorted(f"{self.path}/{n}" for n in names if n.startswith(f"{label}-") and self._fs.exists(self._path(f"{self.path}/{n}/_SUCCESS")))

    def write(self, df: DataFrame, label: str) -> str:
        path = f"{self.path}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def read(self, label: str, schema: str) -> DataFrame:
        found = self.tables(label)
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)


def _asked(fn: Callable[[list[dict]], dict], rows: list[dict]) -> list[dict]:
    """One batch, in order, as ledger rows, a row a cue; usage stands in the first. Ids are 1-based within the batch, `7` or `[7]`."""
    said, error, truncated = {}, None, False
    try:
        said = fn([{"id": str(k + 1), "src": r["src"]} for k, r in enumerate(rows)])
        if not isinstance(said, dict):
            said, error = {}, "the reply is no object"
    except Fatal:
        raise
    except Exception as e:  # a bad batch is a failed batch: it shows in the ledger, and its cues are asked for again
        error, truncated = f"{type(e).__name__}: {e}"[:200], isinstance(e, Truncated)
    used = said.get("usage") if isinstance(said.get("usage"), dict) else {}
    text, fix = (_by_id(x, len(rows)) for x in (said["t"] if isinstance(said.get("t"), dict) else said, said.get("fix")))
    common = {"attempt": rows[0]["attempt"], "batch": rows[0]["batch"], "error": error, "truncated": truncated}
    counts = {c: int(used.get(c) or 0) for c in USAGE} | {"requests": 1}
    return [{"media_id": r["media_id"], "ix": r["ix"], "src": r["src"], "text": text.get(k + 1), "fix": fix.get(k + 1), **common, **(counts if k == 0 else dict.fromkeys(USAGE, 0))} for k, r in enumerate(rows)]


def _by_id(said: object, n: int) -> dict[int, str]:
    out = {}
    for key, value in said.items() if isinstance(said, dict) else ():
        bare = str(key).removeprefix("[").removesuffix("]")
        if isinstance(value, str) and bare.isdigit() and 1 <= int(bare) <= n:
            out[int(bare)] = value
    return out


def _key(*of: Column) -> Column:
    """A batch's key: what it asks, in which round."""
    return F.xxhash64(*of, F.col("texts"))


def translate(cues: DataFrame, fn: Callable[[list[dict]], dict], ledger: str, size: int = BATCH, rounds: int = 3, waves: int = 4, proofread: bool = False, cjk: bool = False) -> Job:
    """cues: media_id, ix, src and more. fn: one batch [{id, src}] to {id: text}, or to {t, fix, usage} with maps by id and counts.

    Cues that have letters or numbers and no usable reply are asked for again, within what was their batch: all of them at
    first, halves of a batch that was Truncated, and halves in the last round. A copy of the source is usable in the last
    round alone. With proofread, fixes that pass guard_fixes change src and keep the text before in src_orig. fn runs in
    tasks; a task that Spark repeats calls it again, and one reply counts. It should wait by itself where its service asks to.
    """
    spark = cues.sparkSession
    media = cues.schema["media_id"].dataType.simpleString()
    plan_kind = f"media_id {media}, ix long, src string, attempt int, batch long"
    kind = f"{plan_kind}, text string, fix string, error string, truncated boolean, {', '.join(f'{c} long' for c in USAGE)}"
    arrow, book, sent = to_arrow_schema(StructType.fromDDL(kind)), Ledger(spark, ledger), []
    rows = cues.select("media_id", F.col("ix").cast("long").alias("ix"), F.coalesce("src", F.lit("")).alias("src"))
    worth = F.col("src").rlike(r"[\p{L}\p{N}]")

    def keyed(parts: DataFrame, attempt: int, *by: str) -> DataFrame:
        texts = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ix", "src"))).alias("texts")).select("media_id", _key(F.lit(attempt), *map(F.col, by)).alias("batch"), "texts")
        return texts.select("media_id", F.explode("texts").alias("x"), "batch").select("media_id", "x.ix", "x.src", F.lit(attempt).alias("attempt"), "batch")

    def asked(table: pa.Table) -> pa.Table:
        batches = groupby(table.to_pylist(), key=itemgetter("media_id", "batch"))
        return pa.Table.from_pylist([reply for _, batch in batches for reply in _asked(fn, list(batch))], schema=arrow)

    for attempt in range(1, rounds + 1):
        name = f"attempt{attempt}"
        if attempt == 1:
            planned = keyed(rows.join(plan_batches(rows, size), ["media_id", "ix"]), 1, "media_id", "batch_ix")
        else:
            last = book.read(f"attempt{attempt - 1}", kind)
            usable = (F.trim(F.coalesce("text", F.lit(""))) != "") & ~untranslated(F.col("src"), F.col("text"))
            again = last.filter(worth & ~usable).withColumnRenamed("batch", "parent")
            of = Window.partitionBy("media_id", "parent")
            n = F.count("*").over(of)
            step = F.when(F.lit(attempt == rounds) | F.col("truncated"), F.greatest(F.lit(1), F.floor(n / 2))).otherwise(n)
            planned = keyed(again.withColumn("piece", F.floor((F.row_number().over(of.orderBy("ix")) - 1) / step)), attempt, "media_id", "parent", "piece")
        plan = spark.read.schema(plan_kind).parquet(book.write(planned, f"plan{attempt}"))
        done = book.read(name, kind).select("batch").distinct()
        rest = plan.join(done, "batch", "left_anti").withColumn("wave", F.pmod(F.col("batch"), F.lit(waves)))
        for wave in sorted(r[0] for r in rest.select("wave").distinct().collect()):
            seen = Observation(f"{name}-wave{wave}")
            replies = by_group(rest.filter(F.col("wave") == wave), ["media_id", "batch"], ["ix"], asked, kind)
            counted = replies.observe(seen, *[F.sum(c).alias(c) for c in USAGE], F.count_if(F.col("text").isNull()).alias("unanswered"), F.count("*").alias("cues"))
            book.write(counted, name)
            sent.append({"attempt": attempt, "wave": wave, **seen.get})
        if not book.read(name, kind).filter(worth).limit(1).collect():
            break

    every = None
    for attempt in range(1, rounds + 1):
        part = book.read(f"attempt{attempt}", kind)
        every = part if every is None else every.unionByName(part)
    fine = (F.trim(F.coalesce("text", F.lit(""))) != "") & (~untranslated(F.col("src"), F.col("text")) | (F.col("attempt") == rounds))
    best = every.groupBy("media_id", "ix").agg(
        F.max_by(F.when(fine, F.col("text")), F.when(fine, F.col("attempt"))).alias("__text"), F.max("attempt").alias("attempts"), F.max_by("error", "attempt").alias("error"), F.max_by("fix", F.when(F.col("fix").isNotNull(), F.col("attempt"))).alias("new"),
    )
    out = cues.drop("tgt", "attempts").join(best, ["media_id", "ix"], "left").withColumns({"tgt": F.coalesce(postprocess(F.col("__text"), cjk), F.lit("")), "attempts": F.coalesce("attempts", F.lit(0))})
    failed = out.filter(F.col("src").rlike(r"[\p{L}\p{N}]") & (F.col("tgt") == "")).select("media_id", "ix", "src", "attempts", "error")
    if proofread:
        out = apply_fixes(out.drop("new"), best.filter("new is not null").select("media_id", "ix", "new"))
    usage = every.groupBy("media_id").agg(*[F.sum(c).alias(c) for c in USAGE])
    return Job(out.drop("__text", "error", "new"), failed, usage, sent)
