"""Documents drawn so that their features resemble a target's, by importance weights and Gumbel noise.

Features (runs of words) fall into hash buckets. Both corpora are counted by bucket in Spark; the gains of
the buckets, whose number is a parameter, come to the driver and go out again as one array literal, and a
document's weight is a fold of that array over its features. A seeded Gumbel variable of the doc_id is
added, so taking the highest scores draws without replacement in proportion to the weights.

The highest k are found by a distributed quickselect: scores are written once with a key that no two rows
share (score, doc_id, row); each round draws random pivot keys by a hash, counts the rows below, at and
above each pivot exactly, and goes on between the two pivots that enclose the k-th key. Only the winners are then
sorted, by range partitions whose counts give the offsets of the ranks. The driver holds pivots and counts.

Defined cases: a null or empty text has no features, weight 0 and a score (the noise alone). A null doc_id
is hashed as the empty text and loses ties. Rows of equal doc_id have equal noise; among rows equal in score and doc_id
the written row decides. An empty target adds 1 to every bucket as any other does; an empty table gives
no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import lower_ascii

#: What is between words of the lower-cased text: ASCII but letters and digits.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
SEED = 2024
#: Random keys that a round of the quickselect counts against.
PIVOTS = 32


def words(text: str = "text") -> Column:
    """Words of the text, none for null."""
    pieces = F.split(lower_ascii(F.coalesce(F.col(text).cast("string"), F.lit(""))), BETWEEN_WORDS)
    return F.filter(pieces, lambda w: w != "")


def features(words: Column, shortest: int, longest: int) -> Column:
    """All runs of ``shortest`` to ``longest`` words, joined by a space."""

    def runs(n: int) -> Column:
        if n == 1:
            return words
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    return F.concat(*map(runs, range(shortest, longest + 1)))


def hashed(features: Column, buckets: int) -> Column:
    return F.transform(features, lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int"))


def bucket_counts(df: DataFrame, shortest: int, longest: int, buckets: int) -> list[int]:
    """Features of the whole table in each bucket."""
    each = df.select(F.explode(hashed(features(words(), shortest, longest), buckets)).alias("bucket"))
    counts = [0] * buckets
    for bucket, n in each.groupBy("bucket").agg(F.count("*")).collect():  # at most ``buckets`` rows
        counts[bucket] = n
    return counts


def gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of the smoothed shares of each bucket."""
    m, s_all, t_all = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log((t + 1) * (s_all + m) / ((s + 1) * (t_all + m)))) for s, t in zip(source, target)]


def scored(docs: DataFrame, gains: list[int], shortest: int = 1, longest: int = 1, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    array = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words().alias("words"))
    rows = rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), hashed(features(F.col("words"), shortest, longest), len(gains)).alias("hashed")
    )
    weight = F.aggregate("hashed", F.lit(0).cast("long"), lambda total, b: total + F.element_at(array, b + 1))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    rows = rows.select("doc_id", "n_words", F.size("hashed").cast("long").alias("n_features"), weight.alias("weight"))
    return rows.withColumn("score", F.col("weight") + noise)


class Key(NamedTuple):
    """Order of the draw, ascending; ``row`` makes it unique."""

    below: int
    nameless: bool
    doc: int
    row: int

    def column(self) -> Column:
        return F.struct(*[F.lit(x).cast(t).alias(f) for f, x, t in zip(self._fields, self, ("long", "boolean", "long", "long"))])


def _key() -> Column:
    return F.struct(
        (-F.col("score")).alias("below"), F.col("doc_id").isNull().alias("nameless"),
        F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc"), F.col("row").alias("row"),
    )


def kth_key(rows: DataFrame, k: int, seed: int = SEED, pivots: int = PIVOTS) -> Key:
    """The k-th key (from 1) of written ``rows``, which hold at least k."""
    rows = rows.withColumn("key", _key())
    round_ = 0
    while True:
        drawn = rows.orderBy(F.xxhash64(F.lit(seed), F.lit(round_), "row"), "row").limit(pivots).select("key.*")
        tried = sorted(Key(*r) for r in drawn.collect())
        array = F.array(*[p.column() for p in tried])
        beaten = F.size(F.filter(array, lambda p: p < F.col("key")))
        at = F.exists(array, lambda p: p == F.col("key"))
        counts = {(r[0], r[1]): r[2] for r in rows.groupBy(beaten.alias("beaten"), at.alias("at")).agg(F.count("*")).collect()}
        for i in range(len(tried) + 1):
            between = counts.get((i, False), 0)
            if k <= between:
                break
            k -= between
            if i < len(tried):
                if k <= counts[i, True]:
                    return tried[i]
                k -= counts[i, True]
        if i:
            low = tried[i - 1]
            rows = rows.filter((F.col("score") <= -low.below) & (F.col("key") > low.column()))
        if i < len(tried):
            high = tried[i]
            rows = rows.filter((F.col("score") >= -high.below) & (F.col("key") < high.column()))
        round_ += 1


def ranked(winners: DataFrame) -> DataFrame:
    """``winners`` with their rank: sorted in range partitions, whose counts give offsets."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row"]
    placed = winners.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    placed = materialize(placed, "winners")
    counts, offsets, before = dict(placed.groupBy("range").agg(F.count("*")).collect()), [], 0  # a row a partition
    for r in sorted(counts):
        offsets.append((r, before))
        before += counts[r]
    known = winners.sparkSession.createDataFrame(offsets, "range int, before long")
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return placed.join(F.broadcast(known), "range").withColumn("rank", F.col("before") + inside).drop("range", "before")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, shortest: int = 1, longest: int = 1,
    buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; of those with ``least_words`` words, the
    highest ``percent`` of 100 are drawn and ranked from 1, the others' rank is null."""
    if not 1 <= shortest <= longest:
        raise ValueError(f"runs of {shortest} to {longest} words")
    gain = gains(*[bucket_counts(t, shortest, longest, buckets) for t in (docs, target)])
    rows = scored(docs, gain, shortest, longest, seed).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "scores")
    eligible = rows.filter(F.col("n_words") >= least_words)
    k = eligible.count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    undrawn = F.lit(None).cast("long").alias("rank")
    if not k:
        return rows.select(*columns[:-1], undrawn)
    last = kth_key(eligible, k, seed).column()
    is_drawn = (F.col("n_words") >= least_words) & (_key() <= last)
    return ranked(rows.filter(is_drawn)).select(*columns).union(rows.filter(~is_drawn).select(*columns[:-1], undrawn))
