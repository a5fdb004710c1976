"""Secrets in texts: pattern candidates, and a random forest that removes false positives.

A candidate is a run of 16 or more characters of keys (letters, digits, ``+ / _ -``) with a digit in it, with a
known issuer's form, or of 20 or more letters that change case often; or a value of any characters that is
assigned to a name for secrets. Patterns run once over a text and over each of its words, so time is linear in the
length of a run. Its features are length, shares and entropy of its characters, transitions between kinds of character,
the share of it that words of the corpus cover, its document's path, and the words around it, as flags for
names and as hashed words. A forest of
the labelled findings scores every candidate. Where no labels are given, findings that an issuer's format
or an assignment to a name for secrets settles are positive, and numbers or candidates mostly made of
words are negative; the rest stays unlabelled and only the forest judges it. All steps are DataFrame
operations and MLlib.

Defined cases: null and empty texts have no candidate; a null path is the empty path; labels of one kind
only, or none, give every candidate that kind's smoothed share as score; equal rows give equal findings
each, but teach once. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import lower_ascii

RUN = r"[A-Za-z0-9+/_-]{16,}+"
FORM = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}"
NAME = r"(?i)(?:password|passwd|pwd|secret|token|api.?key|credential|private.?key)"
#: A name for secrets, at most a quote and a blank, then the assignment; the value may open with a quote.
ASSIGNED = NAME + r"[\"']?\s?[=:]\s?[\"']?"
#: Shortest value of an assignment that is a candidate whatever its characters.
SHORTEST_VALUE = 6
#: Hash buckets of neighbouring words.
NEIGHBOURS = 24
ISSUED = f"^({FORM})$"
SECRET_NAME = NAME + r"\W*$"
HARMLESS_NAME = r"(?i)(sha|md5|checksum|hash|commit|digest|uuid|version|build|id|order|invoice|card|phone|tel)\W*$"
HARMLESS_PATH = r"(?i)(test|example|sample|fixture|doc)"
#: A word of the corpus counts for coverage from this many occurrences on.
WORD_COUNT = 5
#: Distinct parts of candidates that are sent to every task; more of them meet the words in a shuffle.
BROADCAST_PARTS = 500_000
#: Expected number of distinct labelled findings that the forest is fitted on at most.
MOST_LABELLED = 200_000
FEATURES = (
    "length", "digits", "upper", "lower", "entropy", "changes", "letter_digit", "case_changes", "coverage", "longest_word",
    "path_depth", "path_harmless", "path_kind", "secret_name", "harmless_name", "assigned", "quoted", "ends_line",
    *[f"near_{k}" for k in range(NEIGHBOURS)],
)


def keys_in(word: Column) -> Column:
    """Runs of a word that may be keys; a run without a digit by an issuer's form or by its changes of case."""
    runs = F.regexp_extract_all(word, F.lit(RUN), F.lit(0))
    mixed = lambda r: (F.char_length(r) >= 20) & (F.regexp_count(r, F.lit("[a-z][A-Z]")) >= 3)
    kept = F.filter(runs, lambda r: r.rlike("[0-9]") | mixed(r) | r.rlike(FORM))
    formed = lambda r: F.when(r.rlike("[0-9]") | mixed(r), r).otherwise(F.regexp_extract(r, FORM, 0))
    return F.transform(kept, formed)


def value_in(word: Column, before: Column) -> Column:
    """The value that a word assigns to a name for secrets, or that the words before it assign; else null."""
    own = F.regexp_extract(word, ASSIGNED + r"(.++)", 1)
    whole = F.when(F.concat_ws(" ", before, F.lit("")).rlike(ASSIGNED.removesuffix(r"[\"']?") + "$"), F.ltrim(word, F.lit("\"'")))
    value = F.rtrim(F.coalesce(F.nullif(own, F.lit("")), whole), F.lit("\"',;.)]}"))
    return F.when(F.char_length(value) >= SHORTEST_VALUE, value)


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, place (word number), candidate, the words before and after it, and its document's path."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"),
    ).filter(F.col("text").rlike(f"{RUN}|{NAME}"))
    words = rows.select("doc_id", "path", F.split("text", r"[\x20\x09-\x0D]+").alias("w"))
    # A value stands in the word of its name or behind one that ends in an assignment.
    behind = lambda k: F.get("w", k - 1).rlike("[=:]$")
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda k: F.get("w", k).rlike(f"{RUN}|{ASSIGNED}") | F.coalesce(behind(k), F.lit(False)))
    near = F.transform(at, lambda k: F.struct(
        k.alias("place"), F.get("w", k).alias("word"), F.get("w", k + 1).alias("after"),
        F.concat_ws(" ", F.get("w", k - 2), F.get("w", k - 1)).alias("before"),
    ))
    found = words.select("doc_id", "path", F.explode(near).alias("x")).select("doc_id", "path", "x.*")
    value = value_in(F.col("word"), F.col("before"))
    # A value that holds a key, or is one, is found once: as the key.
    keys = F.col("keys")
    both = F.when(value.isNotNull() & (F.size(keys) == 0), F.array(value)).otherwise(keys)
    found = found.withColumn("keys", keys_in(F.col("word"))).withColumn("candidate", F.explode(both)).drop("keys")
    left = F.substr("word", F.lit(1), F.position("candidate", "word") - 1)
    return found.select(
        "doc_id", "place", "candidate", F.concat_ws(" ", "before", left).alias("before"),
        F.coalesce("after", F.lit("")).alias("after"), "path",
    )


def coverage(found: DataFrame, docs: DataFrame) -> DataFrame:
    """candidate, and the shares of it that words of the corpus cover in all and at longest.

    A long candidate has many parts, so they carry its key and length, not itself.
    """
    key = F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_key")
    each = found.select("candidate").distinct().select("candidate", key)
    parts = each.select(
        "candidate_key", F.char_length("candidate").alias("size"),
        F.explode(F.regexp_extract_all(lower_ascii(F.col("candidate")), F.lit("[a-z]{3,}+"), F.lit(0))).alias("part"),
    )
    parts = parts.groupBy("candidate_key", "size", "part").agg(F.count("*").alias("times"))
    wanted = materialize(parts.select("part").distinct(), "parts")
    if wanted.count() <= BROADCAST_PARTS:
        wanted = F.broadcast(wanted)
    tokens = docs.select(F.explode(F.split(lower_ascii(F.col("text").cast("string")), r"[\x20\x09-\x0D]+")).alias("t"))
    plain = tokens.select(F.rtrim(F.col("t"), F.lit(",.!?;:")).alias("part"))
    known = plain.join(wanted, "part").groupBy("part").count().filter(F.col("count") >= WORD_COUNT).select("part")
    size = F.char_length("part") / F.col("size")
    covered = parts.join(known, "part").groupBy("candidate_key").agg(
        F.sum(size * F.col("times")).alias("coverage"), F.max(size).alias("longest_word")
    )
    return each.join(covered, "candidate_key").drop("candidate_key")


def _count(kinds: Column, pattern: str) -> Column:
    return F.regexp_count(kinds, F.lit(pattern)) / F.length(kinds)


def with_features(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The candidates with the columns of FEATURES."""
    c = F.col("candidate")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "#"), "[A-Z]", "A"), "[a-z]", "a")
    chars = F.split(c, "")
    share = lambda x: (F.length(c) - F.length(F.replace(c, x, F.lit("")))) / F.length(c)
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda total, x: total - share(x) * F.log2(share(x)))
    known = coverage(found, docs)
    return found.join(known, "candidate", "left").withColumns({
        "length": F.length(c).cast("double"),
        "digits": _count(kinds, "#"), "upper": _count(kinds, "A"), "lower": _count(kinds, "a"), "entropy": entropy,
        "changes": _count(kinds, "(?<=#)[^#]|(?<=A)[^A]|(?<=a)[^a]"),
        "letter_digit": _count(kinds, "(?<=[Aa])#|(?<=#)[Aa]"), "case_changes": _count(kinds, "(?<=A)a|(?<=a)A"),
        "coverage": F.coalesce("coverage", F.lit(0.0)), "longest_word": F.coalesce("longest_word", F.lit(0.0)),
        "path_depth": F.regexp_count("path", F.lit("/")).cast("double"),
        "path_harmless": F.col("path").rlike(HARMLESS_PATH).cast("double"),
        "path_kind": F.pmod(F.xxhash64(F.substring_index("path", "/", -1)), F.lit(8)).cast("double"),
        "secret_name": F.col("before").rlike(SECRET_NAME).cast("double"),
        "harmless_name": F.col("before").rlike(HARMLESS_NAME).cast("double"),
        "assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"),
        "quoted": F.col("before").rlike(r"[\"']$").cast("double"),
        "ends_line": (F.col("after") == "").cast("double"),
        "around": neighbours(F.concat_ws(" ", "before", "after")),
    }).withColumns({f"near_{k}": F.element_at("around", k + 1) for k in range(NEIGHBOURS)}).drop("around")


def neighbours(text: Column) -> Column:
    """Number of the text's words of letters in each hash bucket."""
    words = F.regexp_extract_all(lower_ascii(text), F.lit("[a-z]{2,}+"), F.lit(0))
    return F.aggregate(
        F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(NEIGHBOURS))),
        F.array_repeat(F.lit(0.0), NEIGHBOURS),
        lambda counts, b: F.transform(counts, lambda n, k: n + (k == b).cast("double")),
    )


def settled(rows: DataFrame) -> DataFrame:
    """The findings with ``label``: 1 or 0 where format, name or content settles them, else null."""
    c = F.col("candidate")
    secret = c.rlike(ISSUED) | ((F.col("secret_name") == 1) & (F.col("assigned") == 1) & (F.col("coverage") < 0.5))
    harmless = c.rlike("^[0-9]+$") | (F.col("coverage") >= 0.6)
    return rows.withColumn("label", F.when(secret, 1).when(harmless, 0).cast("double"))


def judged(rows: DataFrame, trees: int = 40, depth: int = 8, seed: int = 7) -> DataFrame:
    """The findings (with FEATURES and a nullable ``label``) with ``score``, the forest's share for a secret."""
    taught = rows.filter("label IS NOT NULL").select(*FEATURES, "label").distinct()
    kinds = {r[0]: r[1] for r in taught.groupBy("label").count().collect()}
    n = sum(kinds.values())
    if len(kinds) < 2:
        return rows.withColumn("score", F.lit((kinds.get(1.0, 0) + 1) / (n + 2)))
    draw = F.shiftrightunsigned(F.xxhash64(*FEATURES), 11) / float(1 << 53)
    taught = taught.filter(draw < min(1.0, MOST_LABELLED / n))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label")
    model = forest.fit(vectors.transform(taught))
    scored = model.transform(vectors.transform(rows))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def scan(docs: DataFrame, labels: DataFrame | None = None, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """doc_id, place, candidate, label, score and is_secret of every candidate.

    ``labels`` (candidate, label) are findings known to be secrets (1) or not (0); without it ``settled`` labels them.
    """
    found = materialize(candidates(docs, path), "candidates")
    rows = with_features(found, docs)
    if labels is None:
        rows = settled(rows)
    else:
        known = labels.groupBy("candidate").agg(F.max(F.col("label").cast("double")).alias("label"))
        rows = rows.join(known, "candidate", "left")
    rows = judged(materialize(rows, "findings"))
    return rows.select("doc_id", "place", "candidate", "label", "score", (F.col("score") >= threshold).alias("is_secret"))
