"""Correlation from merged central moments.

Built-in covariance and deviation merge partial moments without cancellation, and a
constant column divides by zero safely (null), where ``corr`` would fail in ANSI mode.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import col, ratio


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over the rows where both columns are known."""
    a, b = col(x).cast("double"), col(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return ratio(F.covar_pop(a, b), spread)


def correlation_table(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, row, column, correlation, n) for all ordered pairs, from one pass over the data.

    Rows are grouped by which columns they know, so each group needs plain moments only:
    one per column and one per pair. A pair then merges the few groups that know both.
    """
    keys = keys or []
    pairs = list(combinations(cols, 2))
    mask = sum(
        (F.col(c).isNotNull().cast("int") * (1 << i) for i, c in enumerate(cols)), F.lit(0)
    )
    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols], mask.alias("known"))
    groups = rows.groupBy(*keys, "known").agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in cols],
        *[F.var_pop(c).alias(f"c_{c}_{c}") for c in cols],
        *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs],
    )

    def entry(a: str, b: str) -> Column:
        x, y = (a, b) if (a, b) in pairs or a == b else (b, a)
        bits = (1 << cols.index(a)) | (1 << cols.index(b))
        both = F.col("known").bitwiseAND(F.lit(bits)) == bits
        part = lambda c: F.when(both, F.col(c)).otherwise(0.0)
        return F.struct(
            F.lit(a).alias("row"),
            F.lit(b).alias("column"),
            F.when(both, F.col("n")).otherwise(0).alias("n"),
            part(f"m_{a}").alias("mx"),
            part(f"m_{b}").alias("my"),
            part(f"c_{a}_{a}").alias("vx"),
            part(f"c_{b}_{b}").alias("vy"),
            part(f"c_{x}_{y}").alias("vxy"),
        )

    parts = groups.select(*keys, F.inline(F.array(*[entry(a, b) for a in cols for b in cols])))
    # At most 2 ** len(cols) parts per pair: their common means centre the merge.
    pair = Window.partitionBy(*keys, "row", "column")
    total = F.sum("n").over(pair)
    mean = lambda c: ratio(F.sum(F.col("n") * F.col(c)).over(pair), total)
    centred = parts.withColumns({"ax": mean("mx"), "ay": mean("my")}).withColumns(
        {"dx": F.col("mx") - F.col("ax"), "dy": F.col("my") - F.col("ay")}
    )
    n = F.col("n")
    merged = centred.groupBy(*keys, "row", "column").agg(
        F.sum("n").alias("n"),
        F.sum(n * (F.col("vx") + F.col("dx") * F.col("dx"))).alias("sxx"),
        F.sum(n * (F.col("vy") + F.col("dy") * F.col("dy"))).alias("syy"),
        F.sum(n * (F.col("vxy") + F.col("dx") * F.col("dy"))).alias("sxy"),
        F.max("ax").alias("ax"),
        F.max("ay").alias("ay"),
    )
    # A spread below the resolution of the mean is a constant column.
    varies = lambda s, a: F.col(s) > F.col("n") * F.pow(F.abs(F.col(a)) * 1e-10, F.lit(2))
    r = F.when(F.col("row") == F.col("column"), 1.0).otherwise(
        ratio(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy"))
    )
    return merged.select(
        *keys, "row", "column", F.when(varies("sxx", "ax") & varies("syy", "ay"), r).alias("correlation"), "n"
    )
