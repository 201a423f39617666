"""Bucketed running sums: exact ranks / prefix counts without putting a whole
group into one task.

``Window.partitionBy(label).orderBy(x)`` puts every row of a class into one
task, so one class holding a third of the data holds a third of the job. Here
rows carry bucket columns that are monotone in the order key; the running
sum is assembled from per-bucket totals (small tables, at most ``B`` rows
per window partition) plus a window inside the finest bucket only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner",
                   broadcast_right: bool = False) -> DataFrame:
    """Equi-join on ``cols`` treating NULL = NULL, keeping one copy of the keys.
    ``broadcast_right`` only for right sides whose size is bounded by design."""
    r = F.broadcast(right) if broadcast_right else right
    for c in cols:
        r = r.withColumnRenamed(c, f"__r_{c}")
    cond = None
    for c in cols:
        e = left[c].eqNullSafe(r[f"__r_{c}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"__r_{c}" for c in cols])


def exclusive_prefix(df: DataFrame, group_cols: Sequence[str], bucket_cols: Sequence[str],
                     order_cols: Sequence[Column | str], value_col: str, out: str = "prefix",
                     broadcast_levels: int = 0) -> DataFrame:
    """Per row: sum of ``value_col`` over rows of the same group that come
    strictly before it in ``(bucket_cols..., order_cols...)`` order.

    ``bucket_cols`` must be non-decreasing in the order key. Each level adds
    one aggregate whose window partitions hold at most one row per bucket
    value; only the last window runs over rows, inside the finest bucket."""
    group_cols = list(group_cols)
    out_df = df
    offsets = []
    for k, b in enumerate(bucket_cols):
        parent = group_cols + list(bucket_cols[:k])
        tot = df.groupBy(*parent, b).agg(F.sum(value_col).alias("__s"))
        w = Window.partitionBy(*parent).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
        off = tot.select(*parent, b, F.coalesce(F.sum("__s").over(w), F.lit(0)).alias(f"__off{k}"))
        out_df = null_safe_join(out_df, off, parent + [b], broadcast_right=k < broadcast_levels)
        offsets.append(F.col(f"__off{k}"))
    wf = (
        Window.partitionBy(*group_cols, *bucket_cols)
        .orderBy(*order_cols)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = F.coalesce(F.sum(value_col).over(wf), F.lit(0))
    total = local
    for o in offsets:
        total = total + o
    return out_df.withColumn(out, total).drop(*[f"__off{k}" for k in range(len(bucket_cols))])


def hex_buckets(key: Column, digits: Sequence[int] = (3, 3)) -> list[Column]:
    """Bucket columns from a uniform hex key: ``16**d`` buckets per level."""
    cols, pos = [], 1
    for d in digits:
        cols.append(F.substring(key, pos, d))
        pos += d
    return cols


def quantile_cuts(x: Column, buckets: int, accuracy: int | None = None) -> Column:
    """Aggregate: ``buckets - 1`` ascending cut points that split the values of
    ``x`` into buckets of about as many rows each. From a mergeable quantile
    sketch: each cut's rank is off by ``rows / accuracy`` at most. NaN, which
    Spark orders last, is left to the last bucket."""
    known = F.when(~F.isnan(x), x)
    return F.percentile_approx(known, [k / buckets for k in range(1, buckets)], accuracy or 8 * buckets)


def cut_bucket(x: Column, cuts: Column, buckets: int) -> Column:
    """How many of the ascending ``cuts`` (fewer than ``buckets``, a power of two) are at or
    below ``x``: a binary search, so non-decreasing in ``x``, whatever the cuts."""
    steps = [1 << k for k in range((buckets - 1).bit_length() - 1, -1, -1)]
    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0),
                        lambda at, s: F.when(F.get(cuts, at + s - 1) <= x, at + s).otherwise(at))
    return F.when(cuts.isNull(), F.lit(0)).otherwise(found)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, name: str = "numbered") -> DataFrame:
    """``df`` with ``out``: a row's number (from 0) among the rows of its
    ``keys`` (NULL = NULL) in ``order``, however many rows a key has.

    Rows are range-partitioned by keys and order, so that a hot key lies in many
    partitions; a row's number is its place in its partition plus the key's
    rows in earlier partitions. The sorted rows are written once, with their
    places, to the shared checkpoint folder: a task that runs again can't
    number them otherwise."""
    from labelforge.sources.files import materialize

    keys = list(keys)
    by = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__place", F.monotonically_increasing_id())
    placed = materialize(placed, name).withColumn("__part", F.shiftright("__place", 33))
    spans = placed.groupBy(*keys, "__part").agg(F.min("__place").alias("__lo"), F.count(F.lit(1)).alias("__n"))
    if keys:  # a key's rows here are its number of partitions
        w = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        spans = spans.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    else:  # one row for each partition
        rows, before = [], 0
        for r in sorted(spans.collect(), key=lambda r: r["__part"]):
            rows.append((r["__part"], r["__lo"], before))
            before += r["__n"]
        spans = df.sparkSession.createDataFrame(rows, "__part long, __lo long, __before long")
    got = null_safe_join(placed, spans, [*keys, "__part"], broadcast_right=not keys)
    return got.withColumn(out, F.col("__place") - F.col("__lo") + F.col("__before")).drop("__place", "__part", "__lo", "__before")
