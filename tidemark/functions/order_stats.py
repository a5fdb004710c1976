"""Exact order statistics that do not gather a group into one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer. Here a first pass
summarises each group and column in a KLL sketch, whose quantiles a little below and above each wanted
share are a bracket that holds the exact value. A second pass counts what lies between the brackets, one row
a gap, and ships only the values inside them, counted. If a bracket misses its value, which the counts show,
the whole column is its bracket.

The counted values are put in order by Spark's range partitioning. The totals of the ranges, one row per range
and group, give the offset of each range; only inside a range are values ranked by a window. Percentiles look
into the ranges that hold a wanted position and into no others. Ranks of all values take the second part alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def value_counts(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(keys, column, value, n): how often each non-null value occurs."""
    wide = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    return (
        wide.unpivot(keys, cols, "column", "value")
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "column", "value")
        .agg(F.count("*").alias("n"))
    )


#: Size of the sketches, and what a bracket reaches to both sides of its share: 1.7 times their rank error at 99 %.
SKETCH, REACH = 2048, 0.004
#: Columns with fewer values are their own bracket.
WHOLE = 10_000


def _profile(df: DataFrame, keys: list[str], cols: list[str], ps: list[float]) -> DataFrame:
    """(keys, column, count, mean, std, min, max, brackets) of columns with values, from one pass; written, as it is small.

    ``brackets`` is an ascending array of disjoint (lo, hi); NaN is the largest value.
    """
    wide = df.select(*keys, *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    summary = wide.groupBy(*keys).agg(
        *[
            F.struct(
                F.lit(c).alias("column"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"), F.max(v).alias("max"), F.kll_sketch_agg_double(v, SKETCH).alias("sketch"),
            ).alias(v)
            for c, v in ((c, f"v{i}") for i, c in enumerate(cols))
        ]
    )
    long = summary.select(*keys, F.inline(F.array(*[f"v{i}" for i in range(len(cols))]))).filter("count > 0")
    edge = lambda by: F.kll_sketch_get_quantile_double(
        "sketch", F.array(*[F.lit(min(1.0, max(0.0, p + by))) for p in sorted(ps)])
    )
    sketched = F.arrays_zip(edge(-REACH).alias("lo"), edge(REACH).alias("hi"))
    nothing = F.array().cast("array<struct<lo:double,hi:double>>")
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    everything = F.array(pair(F.lit(float("-inf")), F.lit(float("nan"))))

    def merge(done, b):
        last = F.try_element_at(done, F.lit(-1))
        wider = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(pair(last["lo"], F.greatest(last["hi"], b["hi"]))))
        return F.when(F.coalesce(b["lo"] <= last["hi"], F.lit(False)), wider).otherwise(F.concat(done, F.array(pair(b["lo"], b["hi"]))))

    # Sketches leave NaN out.
    simple = (F.col("count") <= WHOLE) | (F.kll_sketch_get_n_double("sketch") != F.col("count"))
    brackets = F.when(simple, everything).otherwise(F.aggregate(sketched, nothing, merge))
    return materialize(long.withColumn("brackets", brackets).drop("sketch"), "value-brackets")


def _bracketed(df: DataFrame, keys: list[str], cols: list[str], profile: DataFrame, parts: int | None) -> DataFrame:
    """Written counts (keys, column, slot, value, n, part) of the values inside brackets and, without a value, of each gap.

    Slots follow the values: gaps are even, brackets odd. ``part`` is the range that holds a row.
    """
    names = {c: f"v{i}" for i, c in enumerate(cols)}
    wide = df.select(*keys, *[F.col(c).cast("double").alias(v) for c, v in names.items()])
    known = F.map_from_entries(F.collect_list(F.struct("column", "brackets")))
    if keys:
        wide = wide.join(profile.groupBy(*keys).agg(known.alias("known")), keys)
    else:
        wide = wide.withColumn("known", profile.agg(known).scalar())

    def entry(c: str, v: str):
        brackets = F.col("known")[c]
        reached = F.size(F.filter(brackets, lambda b: b["lo"] <= F.col(v)))
        inside = F.coalesce(F.col(v) <= F.get(brackets, reached - 1)["hi"], F.lit(False))
        found = F.struct(F.lit(c).alias("column"), (2 * reached - inside.cast("int")).alias("slot"), F.when(inside, F.col(v)).alias("value"))
        return F.when(F.col(v).isNotNull(), found)

    entries = F.array_compact(F.array(*[entry(c, v) for c, v in names.items()]))
    counts = wide.select(*keys, F.inline(entries)).groupBy(*keys, "column", "slot", "value").agg(F.count("*").alias("n"))
    return _in_ranges(counts, [*keys, "column", "slot", "value"], parts)


def _in_ranges(counts: DataFrame, order: list[str], parts: int | None) -> DataFrame:
    """Written counts with the number of the range that holds them; ranges follow the order."""
    placed = counts.repartitionByRange(parts, *order) if parts else counts.repartitionByRange(*order)
    return materialize(placed.withColumn("part", F.spark_partition_id()), "value-ranges")


def _ranges(df: DataFrame, keys: list[str], cols: list[str], parts: int | None) -> DataFrame:
    """Counts of all values in ranges."""
    counts = value_counts(df, keys, cols).withColumn("slot", F.lit(1))
    return _in_ranges(counts, [*keys, "column", "value"], parts)


def _offsets(ranges: DataFrame, group: list[str]) -> DataFrame:
    """(group, part, part_n, offset): rows of each range, and of the ranges before it."""
    sums = ranges.groupBy(*group, "part").agg(F.sum("n").alias("part_n"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("offset", F.coalesce(F.sum("part_n").over(earlier), F.lit(0)))


def _ranked(ranges: DataFrame, offsets: DataFrame, group: list[str]) -> DataFrame:
    """(group, value, n, below) of the ranges that ``offsets`` names."""
    inside = Window.partitionBy(*group, "part").orderBy("slot", "value").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return ranges.join(offsets, [*group, "part"]).select(*group, "value", "n", below.alias("below"))


def value_positions(df: DataFrame, keys: list[str], cols: list[str], parts: int | None = None) -> DataFrame:
    """(keys, column, value, n, below): ``below`` counts the smaller entries of the group."""
    group = [*keys, "column"]
    ranges = _ranges(df, keys, cols, parts)
    return _ranked(ranges, _offsets(ranges, group).drop("part_n"), group)


def percentiles(
    df: DataFrame, keys: list[str], cols: list[str], ps: list[float], parts: int | None = None
) -> DataFrame:
    """(keys, column, p, quantile): linearly interpolated percentiles, exact."""
    return _exact(df, keys, cols, _profile(df, keys, cols, ps), ps, parts)


def _exact(df: DataFrame, keys: list[str], cols: list[str], profile: DataFrame, ps: list[float], parts: int | None) -> DataFrame:
    """Percentiles from the brackets of ``profile``, or from all values where a bracket missed."""
    group = [*keys, "column"]
    found = materialize(_quantiles(_bracketed(df, keys, cols, profile, parts), group, ps), "quantiles")
    if found.filter("quantile IS NULL").isEmpty():
        return found
    return _quantiles(_ranges(df, keys, cols, parts), group, ps)


def _quantiles(ranges: DataFrame, group: list[str], ps: list[float]) -> DataFrame:
    shares = F.array(*[F.lit(float(p)) for p in ps])
    offsets = _offsets(ranges, group)
    totals = offsets.groupBy(*group).agg(F.sum("part_n").alias("total"))
    wanted = totals.select(*group, "total", F.explode(shares).alias("p"))
    wanted = wanted.select(*group, "p", ((F.col("total") - 1) * F.col("p")).alias("target"))
    low, high = F.floor("target"), F.ceil("target")
    holds = lambda rank, begin, n: (F.col(begin) <= rank) & (rank < F.col(begin) + F.col(n))
    near = offsets.join(wanted, group).filter(holds(low, "offset", "part_n") | holds(high, "offset", "part_n"))
    ranked = _ranked(ranges, near.select(*group, "part", "offset").distinct(), group)
    hits = ranked.join(wanted, group).filter(holds(low, "below", "n") | holds(high, "below", "n"))
    picked = hits.groupBy(*group, "p", "target").agg(
        F.max(F.when(holds(low, "below", "n"), F.col("value"))).alias("lo"),
        F.max(F.when(holds(high, "below", "n"), F.col("value"))).alias("hi"),
    )
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("target") - F.floor("target"))
    return picked.select(*group, "p", value.alias("quantile"))


def _named(long: DataFrame, group: list[str], named: dict[str, float]) -> DataFrame:
    return long.groupBy(*group).agg(
        *[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(name) for name, p in named.items()]
    )


def quantile_table(
    df: DataFrame, keys: list[str], cols: list[str], named: dict[str, float], parts: int | None = None
) -> DataFrame:
    """(keys, column) with one column per named percentile."""
    return _named(percentiles(df, keys, cols, list(named.values()), parts), [*keys, "column"], named)


def distribution(
    df: DataFrame, keys: list[str], cols: list[str], named: dict[str, float], parts: int | None = None
) -> DataFrame:
    """(keys, column, count, mean, std, min, max, named percentiles) from two passes over the data."""
    group = [*keys, "column"]
    ps = list(named.values())
    profile = _profile(df, keys, cols, ps)
    return profile.drop("brackets").join(_named(_exact(df, keys, cols, profile, ps, parts), group, named), group)
