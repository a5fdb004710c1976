"""Mixing sources to target weights by a min-cost flow over membership patterns.

A document may belong to several sources. Documents are first aggregated by membership pattern (the
set of sources they belong to). A flow then routes words from patterns to source quotas: a pattern
offers its words once at no cost and again at growing cost, so no document repeats while another of
use to the same quotas is unused. Patterns and sources, not documents, make the network; their number
is checked. The flow cuts each pass over a pattern's documents, laid out in seeded order, into one
interval for each source. Buckets of that order inside one interval are taken whole; a bucket that
a boundary cuts is filled greedily, document by document.

Defined cases: null or empty texts have size 0 and are never taken; a null source (or member) is a
source of its own, last in order; documents without any member are never taken; equal rows are
documents each. Ties in the seeded order go by doc_id and size. An empty table gives no rows. Other
columns of the input are ignored. ``mixed_documents`` knows each row by a key of its own, so rows with a null or repeated
doc_id are documents each; rows without a doc_id are placed, and further ties broken, by the text's hash.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import ASCII_SPACE_WORD

#: More membership patterns than this are an error: the network is solved on the driver.
MOST_PATTERNS = 100_000
SEED = 17


def in_order(sources: Iterable[str | None]) -> list[str | None]:
    """By code point, null last."""
    return sorted(set(sources), key=lambda s: (s is None, s or ""))


def filled_targets(sizes: dict, weights: dict, share: Fraction, most: int) -> dict:
    """Weighted shares of ``share`` of all sizes, at most ``most`` times each size, the excess reshared."""
    left, open_, done = share * sum(sizes.values()), in_order(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        above = [s for s in open_ if left * weights[s] / total > most * sizes[s]]
        if not above:
            return done | {s: left * weights[s] / total for s in open_}
        for s in above:
            done[s] = Fraction(most * sizes[s])
        left -= sum(done[s] for s in above)
        open_ = [s for s in open_ if s not in done]
    return done


class Network:
    """Directed arcs with capacities and costs; flow by successive cheapest paths."""

    def __init__(self):
        self.ends, self.room, self.cost, self.out = [], [], [], {}

    def arc(self, a, b, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.ends))
            self.ends.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.ends) - 2

    def _cheapest(self, a, b) -> list[int]:
        reach, via, queue, waiting = {a: 0}, {}, deque([a]), {a}
        while queue:
            x = queue.popleft()
            waiting.discard(x)
            for e in self.out.get(x, ()):
                y = self.ends[e]
                if self.room[e] and reach[x] + self.cost[e] < reach.get(y, float("inf")):
                    reach[y], via[y] = reach[x] + self.cost[e], e
                    if y not in waiting:
                        waiting.add(y)
                        queue.append(y)
        path = []
        while b in via and b != a:
            path.append(via[b])
            b = self.ends[via[b] ^ 1]
        return path

    def fill(self, a, b) -> None:
        while path := self._cheapest(a, b):
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount


def routed(patterns: dict[tuple, int], quotas: dict, most: int) -> dict[tuple, dict]:
    """Words that each pattern gives to each of its sources."""
    net, arcs = Network(), {}
    for p, size in sorted(patterns.items(), key=lambda x: str(x[0])):
        for again in range(most):
            net.arc("from", ("pattern", p), size, again * again)
        for s in in_order(p):
            arcs[p, s] = net.arc(("pattern", p), ("source", s), most * size, 0)
    for s, words in quotas.items():
        net.arc(("source", s), "to", words, 0)
    net.fill("from", "to")
    found: dict[tuple, dict] = {}
    for (p, s), e in arcs.items():
        if net.room[e ^ 1]:
            found.setdefault(p, {})[s] = net.room[e ^ 1]
    return found


def intervals(size: int, shares: dict) -> list[tuple]:
    """(pass, lo, hi, source) of a pattern's passes over its documents, in the sources' order."""
    at, found = 0, []
    for s in in_order(shares):
        end = at + shares[s]
        while at < end:
            stop = min(end, (at // size + 1) * size)
            found.append((at // size, at % size, at % size + stop - at, s))
            at = stop
    return found


def sized(docs: DataFrame, members: str | None = None, row: str | None = None) -> DataFrame:
    """doc_id, size in words, and the pattern (distinct members in order, null last) of each document; with
    the column ``row`` of keys also the text's hash and the key."""
    pattern = F.array("source") if members is None else F.sort_array(F.array_distinct(members))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.regexp_count("text", F.lit(ASCII_SPACE_WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(pattern, F.array().cast("array<string>")).cast("array<string>").alias("pattern"),
        *([F.xxhash64("text").alias("text_hash"), F.col(row).alias("row")] if row else []),
    )


def pattern_totals(rows: DataFrame) -> dict[tuple, tuple[int, int]]:
    """(words, documents) of each pattern; an error beyond MOST_PATTERNS."""
    totals = rows.groupBy("pattern").agg(F.sum("size"), F.count("*"))
    found = totals.limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    return {tuple(r[0]): (r[1], r[2]) for r in found}


def greedy(rows, parts: list[tuple]) -> list[list]:
    """Sources that take each document of a cut bucket; ``parts``: (pass, source, words to take)."""
    taken: list[list] = [[] for _ in rows]
    for turn in sorted({p[0] for p in parts}):
        left = [[s, words] for t, s, words in parts if t == turn]
        free = []
        for k, size in enumerate(rows):
            fit = next((x for x in left if size <= x[1]), None)
            if fit:
                fit[1] -= size
                taken[k].append(fit[0])
            else:
                free.append(k)
        for x in left:  # one document over, where that comes nearer
            best = min(free, key=lambda k: abs(x[1] - rows[k]), default=None)
            if best is not None and abs(x[1] - rows[best]) < x[1]:
                taken[best].append(x[0])
                free.remove(best)
    return taken


def mix(rows: DataFrame, quotas: Callable[[dict], dict], most: int = 2, seed: int = SEED) -> tuple[DataFrame, dict]:
    """(doc_id, size, pattern, takers: the source of every use, and the key if it has one) of each row of
    ``sized``, and the quotas.

    ``quotas`` turns the words of each source into the words wanted of it.
    """
    spark = rows.sparkSession
    keys = [c for c in ("text_hash", "row") if c in rows.columns]
    rows = materialize(rows, "sizes")
    totals = pattern_totals(rows)
    words: dict = {}
    for p, (size, _) in totals.items():
        for s in p:
            words[s] = words.get(s, 0) + size
    wanted = quotas(words)
    whole = {s: int(w + Fraction(1, 2)) for s, w in wanted.items()}
    flows = routed({p: t[0] for p, t in totals.items() if t[0]}, whole, most)
    cuts = [
        (list(p), max(1, -(-int(totals[p][1] ** 0.5) // 4)), turn, lo, hi, s)
        for p, shares in flows.items() for turn, lo, hi, s in intervals(totals[p][0], shares)
    ]
    plan = spark.createDataFrame(cuts, "pattern array<string>, buckets int, turn int, lo long, hi long, taker string")

    drawn = F.coalesce("doc_id", *keys[:1])
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), drawn, "size"), 11) / float(1 << 53)
    kinds = plan.select("pattern", "buckets").distinct()
    # At most MOST_PATTERNS short rows; a shuffle by pattern would send a hot source to one task.
    dealt = rows.join(F.broadcast(kinds), "pattern", "left").withColumn("place", place)
    dealt = dealt.withColumn("bucket", F.coalesce(F.floor(F.col("place") * F.col("buckets")).cast("int"), F.lit(-1)))
    sums = dealt.filter("bucket >= 0 AND size > 0").groupBy("pattern", "bucket").agg(F.sum("size").alias("words"))
    end = F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket"))
    spans = sums.withColumn("end", end).withColumn("begin", F.col("end") - F.col("words"))
    part = F.least("hi", "end") - F.greatest("lo", "begin")
    met = (
        spans.join(plan, "pattern")
        .filter((F.col("lo") < F.col("end")) & (F.col("hi") > F.col("begin")))
        .groupBy("pattern", "bucket")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "taker", part.alias("part"), "words"))).alias("parts"))
    )
    is_whole = lambda x: x["part"] == x["words"]
    of_bucket = met.select(
        "pattern", "bucket",
        F.transform(F.filter("parts", is_whole), lambda x: x["taker"]).alias("takers"),
        F.transform(F.filter("parts", lambda x: ~is_whole(x)), lambda x: F.struct(x["turn"], x["taker"], x["part"])).alias("cut"),
    )
    joined = dealt.join(of_bucket, ["pattern", "bucket"], "left").select(
        "doc_id", "size", "pattern", *keys, "bucket", "place",
        F.when(F.col("size") > 0, F.coalesce("takers", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("takers"),
        F.when(F.col("size") > 0, F.col("cut")).alias("cut"),
    )
    is_cut = F.coalesce(F.size("cut") > 0, F.lit(False))

    def fill(bucket):
        import pyarrow as pa

        # Python's integers: in pandas a null doc_id would turn the others into doubles.
        found = bucket.to_pylist()
        found.sort(key=lambda r: (r["place"], r["doc_id"] is None, r["doc_id"] or 0, r["size"], *[r[k] for k in keys]))
        parts = [(p["turn"], p["taker"], p["part"]) for p in found[0]["cut"]]
        for r, more in zip(found, greedy([r["size"] for r in found], parts)):
            r["takers"] = r["takers"] + more
        kinds = {"doc_id": pa.int64(), "size": pa.int64(), "pattern": pa.list_(pa.string()), "takers": pa.list_(pa.string()), "row": pa.string()}
        return pa.table({c: pa.array([r[c] for r in found], kinds[c]) for c in names})

    names = ["doc_id", "size", "pattern", "takers", *keys[1:]]
    schema = "doc_id long, size long, pattern array<string>, takers array<string>" + ", row string" * bool(keys)
    filled = joined.filter(is_cut).groupBy("pattern", "bucket").applyInArrow(fill, schema)
    return joined.filter(~is_cut).select(*names).union(filled), {"words": words, "wanted": wanted}


def shared_quotas(share: Fraction = Fraction(3, 2), weights: tuple[int, ...] = (3, 1, 2), most: int = 2) -> Callable[[dict], dict]:
    """Quotas by weights that repeat over the sources in order."""

    def quotas(words: dict) -> dict:
        by = {s: weights[k % len(weights)] for k, s in enumerate(in_order(words))}
        return filled_targets(words, by, share, most)

    return quotas


def with_row_key(docs: DataFrame, name: str, written: bool) -> DataFrame:
    """``docs`` with a key of each row. The rows of a ``written`` table have one, their place in its files; others are
    written with one, as a row number is not the same in every run of a plan."""
    if not written:
        return materialize(docs.withColumn(name, F.monotonically_increasing_id().cast("string")), "mix-rows")
    place = F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    return docs.select("*", place.alias(name))


def mixed_documents(
    docs: DataFrame, quotas: Callable[[dict], dict], most: int = 2, seed: int = SEED, written: bool = False
) -> DataFrame:
    """The rows of ``docs`` once for every use in the mix; ``written``: ``docs`` is a Parquet table as it was read."""
    docs = with_row_key(docs, "_mix_row", written)
    taken, _ = mix(sized(docs, row="_mix_row"), quotas, most, seed)
    uses = taken.select(F.col("row").alias("_mix_id"), F.size("takers").alias("_mix_uses")).filter("_mix_uses > 0")
    rows = docs.join(uses, docs["_mix_row"] == uses["_mix_id"]).withColumn("_mix_use", F.explode(F.sequence(F.lit(1), "_mix_uses")))
    return rows.drop("_mix_row", "_mix_id", "_mix_uses", "_mix_use")


def mix_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, its source the only member."""
    taken, known = mix(sized(docs), shared_quotas())
    sources = spark.createDataFrame(
        [([s], int(known["words"][s]), float(known["wanted"][s])) for s in in_order(known["words"])],
        "pattern array<string>, source_size long, target double",
    )
    return taken.join(F.broadcast(sources), "pattern").select(
        "doc_id", "size", "source_size", "target", (F.size("takers") * F.col("size")).cast("long").alias("taken")
    )
