"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, exp(tilt * size / mean size) up to a cap, whose tilt per source is the
dual of "stay as near to rate 1 as relative entropy allows, but make the source's expected words its
target". Rates become whole copies by one uniform draw per document and one shift per source, which
is solved so that the words taken come to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, word_count

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
NARROWING_ROUNDS, CELLS = 2, 1024
#: Newton steps go on until every source's expected words are as near to its target as this share of it.
RESIDUAL = 1e-7
#: Up to this many sources, what is known of each is broadcast to the documents; beyond it, it is joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Sums of rates go through decimals, so that they don't depend on the order in which Spark adds them.
_EXACT = "decimal(38,12)"


def ranked(sizes: DataFrame) -> DataFrame:
    """Adds rank, from zero: sources by code point, null last. Each range of sources is counted by itself and moved by what comes before it."""
    order = [F.col("source").isNull(), F.col("source")]
    rows = sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    rows = materialize(rows, "ranges")
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a partition
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return rows.withColumn("nth", nth).join(F.broadcast(before), "part").select(*sizes.columns, (F.col("before") + F.col("nth") - 1).alias("rank"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes: source, source_size, one row per source. Adds weight and target.

    Sources are ranked by code point, null last; weights repeat in that order. The share of all sizes is dealt
    by weight; what exceeds cap times a source's size is dealt again, by weight, until none exceeds it. A round of
    dealing is one aggregate over the sources: it raises the level, words a weight, until it fills no further source.
    """
    table = F.array(*map(F.lit, weights))
    rows = ranked(sizes).withColumns({"weight": F.element_at(table, (F.col("rank") % len(weights)).cast("int") + 1).cast("double"), "most": cap * F.col("source_size").cast("double")})
    rows = materialize(rows.drop("rank"), "weights")
    level, filled = float("-inf"), F.col("most") / F.col("weight")
    while True:
        full = filled <= level
        words, capped, free = rows.agg(F.sum("source_size"), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not free:  # nothing is left to be dealt to
            return rows.select("source", "source_size", "weight", F.col("most").alias("target"))
        new = (share * words - (capped or 0.0)) / free
        if new <= level:
            return rows.select("source", "source_size", "weight", F.least("most", F.lit(level) * F.col("weight")).alias("target"))
        level = new


def _rate(tilt: Column, size: Column, mean: Column, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(F.lit(50.0), tilt * size / mean)))


def tilts(groups: DataFrame, goal: DataFrame, cap: float = CAP, residual: float = RESIDUAL) -> DataFrame:
    """groups: source_key, size, n (documents of that size). goal: source_key, target. Returns source_key, tilt, mean.

    Safeguarded Newton steps on the dual of each source: its gradient is the expected words less the target, and
    grows with the tilt. Every round is one aggregate over (source, size) groups, for all sources together. A source
    is done where its residual is small or its bracket closed. A target of all that the cap allows has the greatest tilt.
    """
    mean = groups.groupBy("source_key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.sum(F.col("size") * F.col("n")).alias("all"))
    whole = F.col("target") >= cap * F.col("all") * (1 - 1e-12)
    state = goal.join(mean, "source_key").select("source_key", "target", F.greatest("mean", F.lit(1e-9)).alias("mean"), F.when(whole, 60.0).otherwise(0.0).alias("tilt"), F.lit(-60.0).alias("low"), F.lit(60.0).alias("high"), whole.alias("done"))
    while True:
        for _ in range(3):
            size = F.col("size").cast("double")
            rate = _rate(F.col("tilt"), size, F.col("mean"), cap)
            slope = F.when(rate < cap, rate * size * size / F.col("mean")).otherwise(0.0)
            sums = groups.join(state, "source_key").groupBy("source_key").agg(
                F.sum((rate * size * F.col("n")).cast(_EXACT)).cast("double").alias("words"), F.sum((slope * F.col("n")).cast(_EXACT)).cast("double").alias("slope")
            )
            over = F.col("words") > F.col("target")
            low, high = F.when(over, F.col("low")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("high"))
            newton = F.col("tilt") - (F.col("words") - F.col("target")) / F.nullif("slope", F.lit(0.0))
            inside = F.coalesce((newton > low) & (newton < high) & (F.col("slope") > 0), F.lit(False))
            done = F.col("done") | (F.abs(F.col("words") - F.col("target")) <= residual * F.col("target")) | (high - low < 1e-8)
            step = F.when(done, F.col("tilt")).when(inside, newton).otherwise((low + high) / 2)
            state = state.join(sums, "source_key").select("source_key", "target", "mean", F.round(step, 12).alias("tilt"), low.alias("low"), high.alias("high"), done.alias("done"))
        state = materialize(state, "tilts")
        if state.filter("NOT done").isEmpty():
            break
    return state.select("source_key", "tilt", "mean")


def _source_key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null"))


def _draw(id_col: Column, size: Column, seed: int) -> Column:
    return (F.xxhash64(id_col, size, F.lit(seed)).bitwiseAND(F.lit((1 << 40) - 1)) + 0.5) / float(1 << 40)


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, cap: int, seed: int) -> DataFrame:
    """__of (the source's key), source_size, target, tilt, mean, limit: what decides a document's copies, one row a source."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _source_key(source_col).alias("source_key"), word_count(F.col(text_col)).alias("size"))
    rows = materialize(rows.select("source", "source_key", "size", _draw(F.col("id"), F.col("size"), seed).alias("draw")), "sizes")
    groups = materialize(rows.groupBy("source", "source_key", "size").agg(F.count("*").alias("n")), "size-groups")
    sizes = groups.groupBy("source", "source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    named = targets(sizes.select("source", "source_size"), weights, share, cap)
    goal = materialize(named.select(_source_key("source").alias("source_key"), "source_size", "target"), "targets")
    tilt = tilts(groups.filter("size > 0"), goal.select("source_key", "target"), cap)
    plan = goal.join(tilt, "source_key", "left").select("source_key", "source_size", "target", F.coalesce("tilt", F.lit(0.0)).alias("tilt"), F.coalesce("mean", F.lit(1.0)).alias("mean"))

    # A document gains its k-th copy once the shift of its source reaches k - rate - draw. The words gained at each
    # shift are a histogram per source; the cell in which they reach the target is cut again.
    of = rows.filter("size > 0").join(_sent(plan), "source_key").select("source_key", "size", "draw", _rounded_rate(cap).alias("rate"))
    flips = F.explode(F.array(*[F.lit(float(k)) - F.col("rate") - F.col("draw") for k in range(1, cap + 1)]))
    span = float(cap + 2)
    shift = plan.select("source_key", "target", F.lit(-span / 2).alias("from"), F.lit(0).cast("long").alias("taken"))
    width = span
    for i in range(NARROWING_ROUNDS):
        cell = F.floor((F.col("flip") - F.col("from")) / (width / CELLS))
        inside = of.select("source_key", "size", flips.alias("flip")).join(_sent(shift), "source_key").filter((F.col("flip") >= F.col("from")) & (F.col("flip") < F.col("from") + width))
        cells = inside.groupBy("source_key", cell.cast("int").alias("cell")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        reach = cells.withColumn("total", F.sum("words").over(run)).join(shift, "source_key")
        passed = reach.groupBy("source_key").agg(
            F.max(F.when(F.col("taken") + F.col("total") <= F.col("target"), F.struct("cell", F.col("total")))).alias("last"),
            F.min(F.when(F.col("taken") + F.col("total") > F.col("target"), F.struct("cell", F.col("total")))).alias("next"),
        )
        below, above = F.coalesce(F.col("last")["total"], F.lit(0)), F.col("next")["total"]
        start = F.coalesce(F.col("next")["cell"], F.lit(CELLS))
        if i == NARROWING_ROUNDS - 1:  # the cell that passes the target is taken if that comes nearer
            start += F.coalesce(F.abs(F.col("taken") + above - F.col("target")) < F.abs(F.col("taken") + below - F.col("target")), F.lit(False)).cast("int")
        shift = shift.join(passed, "source_key", "left").select("source_key", "target", (F.col("from") + start * (width / CELLS)).alias("from"), (F.col("taken") + below).alias("taken"))
        shift = materialize(shift, "shifts")
        width /= CELLS
    whole = plan.join(shift.select("source_key", F.col("from").alias("limit")), "source_key")
    return materialize(whole.withColumnRenamed("source_key", "__of"), "mixing-plan")


def _sent(per_source: DataFrame) -> DataFrame:
    return F.broadcast(per_source) if per_source.count() <= BROADCAST_SOURCES else per_source


def _rounded_rate(cap: float) -> Column:
    return F.round(_rate(F.col("tilt"), F.col("size").cast("double"), F.col("mean"), cap), 9)


def _dealt(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, cap: int, seed: int) -> DataFrame:
    """__row (all columns of docs), size, source_size, target, rate, copies: a document's copies follow from itself and its source's plan."""
    plan = _plan(docs, id_col, text_col, source_col, weights, share, cap, seed)
    row = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(row.alias("__row"), _source_key(source_col).alias("__of"), word_count(F.col(text_col)).alias("size"))
    rows = rows.withColumn("__draw", _draw(F.col(f"__row.`{id_col}`"), F.col("size"), seed)).join(_sent(plan), "__of").withColumn("rate", _rounded_rate(cap))
    copies = sum(((F.lit(float(k)) - F.col("rate") - F.col("__draw") < F.col("limit")).cast("int") for k in range(1, cap + 1)), F.lit(0))
    return rows.select("__row", "size", "source_size", "target", "rate", copies.alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = 8) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, rate (double), copies (int: 0 to cap).

    size is the number of words of the text (null: 0). A document of no words has rate 1. A null source is a
    source of its own. The draw of a document hashes its id, size and the seed, so reruns agree, and repeated
    rows, or rows without an id of one size, fall alike. An empty table gives no rows; a source without words has target 0.
    """
    dealt = _dealt(docs, id_col, text_col, source_col, weights, share, cap, seed)
    return dealt.select(F.col(f"__row.`{id_col}`").alias(id_col), "size", "source_size", "target", "rate", "copies")


def expand(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = 8) -> DataFrame:
    """The mix itself: the rows of docs, columns unchanged, each as often as its copies. Nulls, repeats and no rows as in mix().

    Documents don't move: the plan, one row a source, is joined to them.
    """
    dealt = _dealt(docs, id_col, text_col, source_col, weights, share, cap, seed)
    each = F.explode_outer(F.slice(F.sequence(F.lit(1), F.lit(cap)), F.lit(1), F.col("copies")))
    return dealt.select("__row", each.alias("__copy")).filter("__copy IS NOT NULL").select("__row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")
