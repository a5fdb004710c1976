"""Audit of filters that run one after another: what each removes in every order they could run.

A document is reduced to a mask, one bit for each filter it fails. Documents are counted by part and
mask, so at most 2^k cells a part are left of k filters. Each cell then folds its mask across the array
of all k! orders with ``transform`` and ``aggregate``: a fold over the filters of one order carries whether
a document is gone already and emits one struct a step, weighted by the cell's counts. The k * k! structs
of a part's cells (600 for five filters) are merged by elementwise sums. The array of orders is a literal of
the plan, so Spark sends it to the executors with the task.

One filter may be about copies: a document fails it if a smaller doc_id has the same text (by SHA-256)
anywhere in the table. Copies have equal masks otherwise, so they are counted before they are compared:
no task holds the rows of a hot text, only its counts by part and label.

Defined cases: a null text is the empty text; a null part is the empty string. A null doc_id has no label, is
nobody's copy and has none. Rows that share doc_id and text are documents each, and no copies of one another.
Of several labels of a doc_id, any 1 counts; null labels are no labels. An empty table has no parts and
gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE_WORD

#: More filters than this are an error: the array of orders grows with their factorial.
MOST_FILTERS = 6
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_rules() -> dict[str, Column]:
    """Failure conditions A to D of the column ``text`` (null: empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(ASCII_SPACE_WORD), F.lit(0))
    n_words = F.size(words)
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n_words < 200,
        "B": F.size(F.array_distinct(words)) * F.lit(100).cast("long") < n_words * F.lit(50).cast("long"),
        "C": capitals * F.lit(100).cast("long") > F.char_length(text) * F.lit(3).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (with doc_id) and the booleans ``good`` and ``toxic`` of their labels."""
    marks = (
        labels.filter("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
        .filter("good OR toxic")
        .withColumn("label_spread", F.lit(0))
    )
    # Rows without a doc_id meet no label; spread, they do not all go to one task.
    spread = F.when(F.col("doc_id").isNull(), F.spark_partition_id() + 1).otherwise(0)
    met = (F.col("doc_id") == F.col("label_id")) & (F.col("spread") == F.col("label_spread"))
    return (
        rows.withColumn("spread", spread)
        .join(marks, met, "left")
        .drop("label_id", "label_spread", "spread")
        .fillna(False, ["good", "toxic"])
    )


def mask_cells(docs: DataFrame, labels: DataFrame, rules: dict[str, Column], copies: str | None, part: Column) -> DataFrame:
    """part, mask, n, good and toxic: documents by the filters they fail; bit i is the i-th letter in order."""
    letters = _letters(rules, copies)
    mask = F.lit(0)
    for letter, fails in rules.items():
        mask = mask + F.when(fails, 1 << letters.index(letter)).otherwise(0)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(part.cast("string"), F.lit("")).alias("part"),
        mask.alias("mask"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_key"),
    )
    keys = ["doc_id", "part", "mask", "text_key"]
    rows = _labelled(rows.groupBy(*keys).agg(F.count("*").alias("n")), labels)
    kinds = ["text_key", "part", "mask", "good", "toxic"]
    # doc_ids are distinct within a kind, so the least one's count comes with it.
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    kinds_of_text = rows.groupBy(*kinds).agg(F.sum("n").alias("n"), least.alias("least"), nameless.alias("nameless"))
    if copies is None:
        split = kinds_of_text
    else:
        # One row for each part and label that the copies of a text have.
        first = F.min("least.doc_id").over(Window.partitionBy("text_key"))
        own = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
        sides = F.array(
            F.struct(F.col("mask").alias("mask"), F.col("own").alias("n")),
            F.struct((F.col("mask") + (1 << letters.index(copies))).alias("mask"), (F.col("n") - F.col("own")).alias("n")),
        )
        split = (
            kinds_of_text.withColumn("first", first)
            .withColumn("own", own)
            .select("part", "good", "toxic", F.inline(sides))
            .filter("n > 0")
        )
    weigh = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), weigh("good"), weigh("toxic"))


def _letters(rules: dict[str, Column], copies: str | None) -> list[str]:
    letters = sorted([*rules, *([copies] if copies else [])])
    if not 0 < len(letters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {len(letters)}")
    return letters


def folded(orders: Column) -> Column:
    """The structs (bit, counts) of a cell's mask after every step of every order."""
    mask, n = F.col("mask"), F.col("n")
    fields = ["bit int", *[f"{c} bigint" for c in COUNTS]]
    nothing = F.array().cast(f"array<struct<{', '.join(f.replace(' ', ': ') for f in fields)}>>")

    def step(state: Column, bit: Column) -> Column:
        gone, fails = state["gone"], mask.bitwiseAND(bit) != 0
        here = fails & ~gone
        count = lambda on, of=n: F.when(on, of).otherwise(F.lit(0).cast("long"))
        row = F.struct(
            bit.alias("bit"),
            count(~fails & ~gone).alias("kept"),
            count(here).alias("removed"),
            count(fails & gone).alias("redundant"),
            count(mask == bit).alias("unique_fails"),
            count(here, F.col("good")).alias("good_lost"),
            count(here, F.col("toxic")).alias("toxic_lost"),
        )
        return F.struct((gone | fails).alias("gone"), F.concat(state["rows"], F.array(row)).alias("rows"))

    start = F.struct(F.lit(False).alias("gone"), nothing.alias("rows"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda state: state["rows"])))


def merged(lists: Column) -> Column:
    """Elementwise sums of arrays of structs (bit, counts)."""
    add = lambda a, b: F.struct(a["bit"].alias("bit"), *[(a[c] + b[c]).alias(c) for c in COUNTS])
    return F.aggregate(
        F.slice(lists, F.lit(2), F.size(lists)), F.element_at(lists, 1), lambda a, b: F.zip_with(a, b, add)
    )


def audit(docs: DataFrame, labels: DataFrame, rules: dict[str, Column], copies: str | None, part: Column) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``rules`` maps a filter's letter to the condition of a row of ``docs`` that fails it; ``copies`` is the letter
    of the filter of exact copies. Columns: part, filter_order, step, kept, removed, redundant (failing, removed
    earlier), unique_fails (failing this filter alone), good_lost and toxic_lost (removed here, so labelled) and
    shapley (what the step's filter removes, summed over all orders).
    """
    letters = _letters(rules, copies)
    names = ["".join(p) for p in permutations(letters)]
    orders = F.expr(f"array({', '.join('array(' + ', '.join(str(1 << letters.index(x)) for x in o) + ')' for o in names)})")
    cells = mask_cells(docs, labels, rules, copies, part).withColumn("rows", folded(orders))
    # At most 2^k cells of a part.
    parts = cells.groupBy("part").agg(merged(F.collect_list("rows")).alias("rows"))
    total = lambda bit: F.aggregate(
        "rows", F.lit(0).cast("long"), lambda a, r: a + F.when(r["bit"] == bit, r["removed"]).otherwise(F.lit(0).cast("long"))
    )
    by_letter = F.create_map(*[x for i in range(len(letters)) for x in (F.lit(1 << i), total(1 << i))])
    each = parts.withColumn("shapleys", by_letter).select("part", "shapleys", F.posexplode("rows").alias("place", "row"))
    order = F.element_at(F.array(*map(F.lit, names)), F.floor(F.col("place") / len(letters)).cast("int") + 1)
    return each.select(
        "part",
        order.alias("filter_order"),
        (F.col("place") % len(letters) + 1).cast("int").alias("step"),
        *[F.col("row")[c].alias(c) for c in COUNTS],
        F.element_at("shapleys", F.col("row")["bit"]).alias("shapley"),
    )
