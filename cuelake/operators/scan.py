"""Running values over one long ordered series, in two levels.

A window over a whole item is one task. Here an item is cut into blocks of its order: each block is a window partition
of its own and gives one summary row; a window over the summaries, which are as many fewer as a block is long, finds what
is carried into each block; then the block's own running values are combined with it. That works for whatever is
associative: the last known value, a sum, a maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block by default.
BLOCK = 200_000


def running(rows: DataFrame, order: str, block: int, *, key: str = "media_id", before: dict[str, Column] | None = None, last: dict[str, Column] | None = None, total: dict[str, Column] | None = None, most: dict[str, Column] | None = None) -> DataFrame:
    """Adds columns of running values by `order` within `key`; order is whole numbers, unique within key.

    before: the value of the row before, null in the first row. last: the last value that isn't null, this row's included.
    total, most: the sum and the maximum up to this row. The same as windows over the whole key give, nulls included.
    """
    own = Window.partitionBy(key, "__block").orderBy(order)
    upto, first_to_before = own.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__block", F.floor(F.col(order) / block))
    local, summary, carried, joined = {}, [], {}, {}
    for name, value in (before or {}).items():
        local[name] = F.lag(F.struct(value.alias("v"))).over(own)
        summary.append(F.max_by(F.struct(value.alias("v")), order).alias(f"__{name}"))
        carried[f"__{name}"] = F.last(f"__{name}").over(first_to_before)
        joined[name] = F.coalesce(F.col(name), F.col(f"__{name}"))["v"]
    for name, value in (last or {}).items():
        local[name] = F.last(value, ignorenulls=True).over(upto)
        summary.append(F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias(f"__{name}"))
        carried[f"__{name}"] = F.last(f"__{name}", ignorenulls=True).over(first_to_before)
        joined[name] = F.coalesce(name, f"__{name}")
    for name, value in (total or {}).items():
        local[name] = F.sum(value).over(upto)
        summary.append(F.sum(value).alias(f"__{name}"))
        carried[f"__{name}"] = F.sum(f"__{name}").over(first_to_before)
        joined[name] = F.coalesce(F.col(name) + F.col(f"__{name}"), name, f"__{name}")
    for name, value in (most or {}).items():
        local[name] = F.max(value).over(upto)
        summary.append(F.max(value).alias(f"__{name}"))
        carried[f"__{name}"] = F.max(f"__{name}").over(first_to_before)
        joined[name] = F.greatest(name, f"__{name}")
    names = [*local]
    carry = rows.groupBy(key, "__block").agg(*summary).withColumns(carried)
    carry = carry.filter(F.coalesce(*[F.col(f"__{n}").isNotNull() for n in names[:1]]) if len(names) == 1 else F.array_contains(F.array(*[F.col(f"__{n}").isNotNull() for n in names]), True))
    out = rows.withColumns(local).join(carry, [key, "__block"], "left").withColumns(joined)
    return out.drop("__block", *[f"__{n}" for n in names])


def centred_sum(rows: DataFrame, order: str, block: int, value: str, half: int, name: str, key: str = "media_id") -> DataFrame:
    """Adds name: the sum of value over `half` rows on either side. order counts rows one by one.

    Rows within reach of a border are listed in the block beyond it as well, and only there to be summed.
    """
    if block <= half:
        raise ValueError("a block must be longer than the reach")
    own = F.floor(F.col(order) / block)
    beyond = F.array_compact(F.array(own, F.when(F.floor((F.col(order) - half) / block) < own, own - 1), F.when(F.floor((F.col(order) + half) / block) > own, own + 1)))
    listed = rows.withColumn("__own", own).withColumn("__block", F.explode(beyond))
    by = Window.partitionBy(key, "__block").orderBy(order).rowsBetween(-half, half)
    return listed.withColumn(name, F.sum(value).over(by)).filter("__own = __block").drop("__own", "__block")


def percentile(rows: DataFrame, value: str, share: float, name: str, keys: tuple[str, ...] = ("media_id",), rounds: int = 2, buckets: int = 1024) -> DataFrame:
    """keys, name: the exact percentile of value, as F.percentile() gives it, without gathering a key's values anywhere.

    Two places are looked for, the ranks on either side of it. A histogram of a key's range tells the bucket of each, the
    bucket's own range is cut again, and what is left after some rounds, a millionth of the rows unless they crowd, is ranked
    by a sort that may spill. Counts are summed before they move. Nulls don't count; a key without values has no row.
    """
    rows = rows.select(*keys, F.col(value).cast("double").alias("__v")).filter("__v is not null")
    stats = rows.groupBy(*keys).agg((F.count("*") - 1).alias("__top"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")).withColumn("__at", F.col("__top") * F.lit(share))
    places = stats.select(*keys, "__at", F.posexplode(F.array(F.floor("__at"), F.ceil("__at"))).alias("__side", "__rank"), "__lo", "__hi")
    for _ in range(rounds):
        open_ = places.filter("__lo < __hi")
        inside = rows.join(open_, list(keys)).filter("__v BETWEEN __lo AND __hi")
        bucket = F.least(F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * buckets), F.lit(buckets - 1))
        counted = inside.groupBy(*keys, "__side", bucket.alias("__b")).agg(F.count("*").alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), F.first("__rank").alias("__rank"), F.first("__at").alias("__at"))
        upto = F.sum("__n").over(Window.partitionBy(*keys, "__side").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))
        found = counted.withColumn("__upto", upto).filter("__upto > __rank AND __upto - __n <= __rank")
        narrowed = found.select(*keys, "__at", "__side", F.col("__min").alias("__lo"), F.col("__max").alias("__hi"), (F.col("__rank") - F.col("__upto") + F.col("__n")).alias("__rank"))
        places = narrowed.unionByName(places.filter("__lo >= __hi"))
    left = rows.join(places.filter("__lo < __hi"), list(keys)).filter("__v BETWEEN __lo AND __hi")
    nth = F.row_number().over(Window.partitionBy(*keys, "__side").orderBy("__v")) - 1
    last = left.withColumn("__nth", nth).filter("__nth = __rank").select(*keys, "__at", "__side", F.col("__v").alias("__lo"))
    both = last.unionByName(places.filter("__lo >= __hi").select(*keys, "__at", "__side", "__lo"))
    ends = both.groupBy(*keys).agg(F.max("__at").alias("__at"), F.max(F.when(F.col("__side") == 0, F.col("__lo"))).alias("__a"), F.max(F.when(F.col("__side") == 1, F.col("__lo"))).alias("__z"))
    at = F.col("__at")
    between = F.when(F.floor(at) == F.ceil(at), F.col("__a")).otherwise((F.ceil(at) - at) * F.col("__a") + (at - F.floor(at)) * F.col("__z"))
    return ends.select(*keys, between.alias(name))
