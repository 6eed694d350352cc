"""Order-dependent building blocks that never put a whole key into one task.

A plain window function partitioned by a key sorts all rows of that key in one task; with one
key holding a third of the data that task decides the run time. The helpers here first split the
key's axis into buckets (time chunks, value quantiles, index blocks), do the ordered work inside
each bucket, and carry only one summary row per bucket across bucket borders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapspark.session import materialize

SPLIT = 256  # parts into which one round cuts a bucket that is too large
BUCKET_ABOVE = 100_000  # rows of one key that one window may order


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches NULL keys and keeps the left copy of the key columns."""
    if not keys:
        # the right side is a keyless aggregate, i.e. exactly one row
        return left.crossJoin(F.broadcast(right))
    renamed = right.select(
        *[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns]
    )
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Repartitions few rows that each stand for much work (a range to enumerate or to draw).

    The explicit number keeps adaptive execution from merging them back into one task.
    """
    spark = df.sparkSession
    tasks = max(
        2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    return df.repartition(tasks, *cols)


def quantile_bucket(df: DataFrame, keys: list[str], value: str, name: str = "_bucket") -> DataFrame:
    """Adds an order-preserving bucket per key, so that no bucket holds more than ``BUCKET_ABOVE`` rows
    but those of one value.

    A bucket is a path of numbers. Every round splits only the buckets that are still too large, each by
    approximate quantiles of its own values (and its least one, so every round splits), until none is left;
    the sketch merges map-side and only spreads the work, so its approximation never reaches a result. Keys that fit from the start cost one
    count. ``df`` is read in every round, so it should be a written table.
    """
    out = df.withColumn(name, F.array().cast("array<int>"))
    while True:
        sizes = out.groupBy(*keys, name).agg(
            F.count(F.lit(1)).alias("_size"), (F.min(value) < F.max(value)).alias("_varied")
        ).where((F.col("_size") > BUCKET_ABOVE) & F.col("_varied"))
        if not sizes.limit(1).count():
            return out
        large = materialize(sizes.drop("_varied"), "large-buckets")
        probs = [i / SPLIT for i in range(1, SPLIT)]
        bounds = join_on(out, large, [*keys, name]).groupBy(*keys, name).agg(
            F.array_union(F.array(F.min(value)), F.percentile_approx(value, probs, 10 * SPLIT)).alias("_bounds"))
        below = F.size(F.filter("_bounds", lambda b: b < F.col(value)))
        out = materialize(
            join_on(out, bounds, [*keys, name], "left").withColumn(
                name, F.when(F.col("_bounds").isNotNull(), F.concat(name, F.array(below))).otherwise(F.col(name))
            ).drop("_bounds"), "buckets")


def running_totals(
    df: DataFrame, keys: list[str], order: str, measures: dict[str, Column],
    bucket: str = "_bucket",
) -> DataFrame:
    """Exact inclusive running sums of ``measures`` along ``order`` within ``keys``.

    ``bucket`` is a column that never decreases along ``order``; rows of one (keys, bucket) are
    summed in one window, and bucket totals are carried over a table of one row per bucket.
    """
    # Keys travel as one struct: it is never NULL itself and compares NULL fields as equal, so
    # grouping, window and join share one hash partitioning on (key, bucket).
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    packed = df.withColumn("_key", key)
    local = Window.partitionBy("_key", bucket).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = Window.partitionBy("_key").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        packed.groupBy("_key", bucket)
        .agg(*[F.sum(c).alias(f"_t_{n}") for n, c in measures.items()])
        .select(
            "_key", bucket,
            *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}")
              for n in measures],
        )
    )
    inside = packed.select("*", *[F.sum(c).over(local).alias(f"_w_{n}") for n, c in measures.items()])
    joined = inside.join(offsets, ["_key", bucket])
    return joined.select(
        *df.columns, *[(F.col(f"_w_{n}") + F.col(f"_o_{n}")).alias(n) for n in measures]
    )


def value_counts(df: DataFrame, keys: list[str], value: str, n: str = "n", weight: str | None = None) -> DataFrame:
    """One row per (keys, value) with its multiplicity; equal values collapse map-side.

    ``weight``: a column that says how many samples a row stands for, one if there is none.
    """
    times = F.sum(weight) if weight else F.count(F.lit(1))
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(times.alias(n))


def midranks(counts: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """Adds ``midrank`` to a table of one row per (keys, value) with multiplicity ``n``.

    The counts are written once: bounds, rows and offsets of the buckets all read them.
    """
    counts = materialize(counts, "value-counts")
    bucketed = quantile_bucket(counts, keys, value)
    ranked = running_totals(bucketed, keys, value, {"_through": F.col(n)})
    return ranked.withColumn(
        "midrank", F.col("_through") - (F.col(n) - 1) / F.lit(2.0)
    ).drop("_through", "_bucket")


def quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], method: str = "linear",
) -> DataFrame:
    """Exact quantiles per key from cumulated value counts.

    ``linear`` interpolates at ``(n-1)*p``; ``nearest`` takes the sorted element at index
    ``min(floor(n*p), n-1)``. Both read at most two order statistics per probability, found by
    comparing positions, so no group is ever gathered into an array.
    """
    counts = materialize(value_counts(df, keys, value), "value-counts")
    ranked = running_totals(
        quantile_bucket(counts, keys, value), keys, value, {"_through": F.col("n")}
    )
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    placed = join_on(ranked, totals, keys).withColumn("_below", F.col("_through") - F.col("n"))
    aggs = []
    for name, p in probs.items():
        if method == "nearest":
            lo = F.least(F.floor(F.col("_total") * F.lit(p)), F.col("_total") - 1)
            hi = lo
        else:
            at = (F.col("_total") - 1) * F.lit(p)
            lo, hi = F.floor(at), F.ceil(at)
        aggs += [
            F.max(F.when(F.col("_below") <= lo, F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when(F.col("_below") <= hi, F.col(value))).alias(f"_hi_{name}"),
        ]
    picked = placed.groupBy(*keys).agg(F.max("_total").alias("n_values"), *aggs)
    out = [*keys, "n_values"]
    for name, p in probs.items():
        at = (F.col("n_values") - 1) * F.lit(p)
        frac = F.lit(0.0) if method == "nearest" else at - F.floor(at)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * frac).alias(name))
    return picked.select(*out)


def next_in_time(
    df: DataFrame, keys: list[str], ts: str, out: str = "next_ts", chunk: str = "DAY",
) -> DataFrame:
    """Adds the following timestamp per key to a table of distinct (keys, ts) rows."""
    chunked = df.withColumn("_chunk", F.date_trunc(chunk, F.col(ts)))
    inner = Window.partitionBy(*keys, "_chunk").orderBy(ts)
    outer = Window.partitionBy(*keys).orderBy("_chunk")
    heads = (
        chunked.groupBy(*keys, "_chunk").agg(F.min(ts).alias("_head"))
        .select(*keys, "_chunk", F.lead("_head").over(outer).alias("_next_head"))
    )
    local = chunked.withColumn("_next", F.lead(ts).over(inner))
    return (
        join_on(local, heads, [*keys, "_chunk"])
        .withColumn(out, F.coalesce("_next", "_next_head"))
        .drop("_chunk", "_next", "_next_head")
    )


def positions(df: DataFrame, keys: list[str], ts: str, out: str = "idx", chunk: str = "DAY"):
    """Adds a 0-based position along ``ts`` per key, counted chunk by chunk."""
    chunked = df.withColumn("_chunk", F.date_trunc(chunk, F.col(ts)))
    counted = running_totals(chunked, keys, ts, {out: F.lit(1)}, bucket="_chunk")
    return counted.withColumn(out, F.col(out) - 1).drop("_chunk")


def halo_blocks(
    df: DataFrame, keys: list[str], idx: str, before: int, after: int, block: int = 4096,
) -> tuple[DataFrame, Window]:
    """Splits an indexed series into blocks with overlap, for row-frame windows.

    Each row goes to its own block and, near a border, also to the neighbour whose frames reach
    it. Use the returned window with ``rowsBetween`` inside [-before, after], then keep ``_own``.
    """
    i = F.col(idx)
    lo = F.floor((i - after) / F.lit(block))
    hi = F.floor((i + before) / F.lit(block))
    spread = df.withColumn("_block", F.explode(F.sequence(lo, hi))).withColumn(
        "_own", F.floor(i / F.lit(block)) == F.col("_block")
    )
    return spread, Window.partitionBy(*keys, "_block").orderBy(idx)
