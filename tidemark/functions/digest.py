"""Content digests that do not depend on the order of rows and that merge.

A row becomes one text (its columns in order of name, each value behind its length, so no two rows share a
text), and the first 60 bits of the text's MD5 its hash. A digest is the number of rows, the sum of the hashes
modulo 2^60 and their exclusive or. Digests of disjoint parts add up to the digest of the whole, so a table that
grows is checked by reading what is new. The exclusive or alone would cancel repeated rows; the sum does not.

Doubles count with six digits after the point where they are below 9e12, others as written; null is a text of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODULUS = 1 << 60
SCALE = 1_000_000
LARGE = 9e12
PARTS = ["data_size", "hash_sum", "hash_xor"]
PARTS_SCHEMA = "data_size bigint, hash_sum bigint, hash_xor bigint"


def value_text(name: str, kind: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = c.cast("double")
        plain = F.abs(c) < LARGE  # false for infinite values, null for none
        whole = F.round(F.when(plain, c) * SCALE).cast("bigint").cast("string")
        text = F.when(plain & ~F.isnan(c), whole).otherwise(c.cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(kind, T.BinaryType):
        text = F.hex(c)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_hash(df: DataFrame) -> Column:
    """60-bit hash of a row of ``df`` over all its columns."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    text = F.concat(F.lit(""), *[value_text(name, kinds[name]) for name in sorted(kinds)])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _modulo(total: Column) -> Column:
    return F.coalesce((total % MODULUS).cast("bigint"), F.lit(0).cast("bigint"))


def digest(df: DataFrame, keys: dict[str, Column] | None = None) -> DataFrame:
    """(keys, data_size, hash_sum, hash_xor) of the rows of ``df``, by named expressions if there are any.

    All columns of ``df`` are hashed, the keys are not.
    """
    keys = keys or {}
    return (
        df.select(*[k.alias(name) for name, k in keys.items()], row_hash(df).alias("_hash"))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("data_size"),
            _modulo(F.sum(F.col("_hash").cast("decimal(38,0)"))).alias("hash_sum"),
            F.coalesce(F.bit_xor("_hash"), F.lit(0).cast("bigint")).alias("hash_xor"),
        )
    )


def merged(parts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Digests of disjoint parts as the digest of the whole."""
    return parts.groupBy(*(keys or [])).agg(*combined())


def extended(whole, part) -> tuple[int, int, int]:
    """The digest of a whole (a row, or None for nothing yet) and one part."""
    if whole is None:
        return part.data_size, part.hash_sum, part.hash_xor
    return whole.data_size + part.data_size, (whole.hash_sum + part.hash_sum) % MODULUS, whole.hash_xor ^ part.hash_xor


def combined(over=None) -> list[Column]:
    """Aggregates (or, over a window, running values) that merge digest columns."""
    placed = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return [
        F.coalesce(placed(F.sum("data_size")), F.lit(0).cast("bigint")).alias("data_size"),
        _modulo(placed(F.sum(F.col("hash_sum").cast("decimal(38,0)")))).alias("hash_sum"),
        F.coalesce(placed(F.bit_xor("hash_xor")), F.lit(0).cast("bigint")).alias("hash_xor"),
    ]


def named(digests: DataFrame) -> Column:
    """The digest as one text."""
    return F.concat_ws(":", *[digests[c].cast("string") for c in PARTS])


# The same in SQL, for the checks of results.


def row_hash_sql(columns: dict[str, str]) -> str:
    """Hash of a row; ``columns`` maps a column to double, time or any other kind."""
    texts = {
        "double": "CAST(CAST(round({0} * 1000000) AS BIGINT) AS VARCHAR)",
        "time": "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')",
    }
    parts = []
    for name in sorted(columns):
        text = texts.get(columns[name], "CAST({0} AS VARCHAR)").format(name)
        parts.append(f"coalesce(CAST(length({text}) AS VARCHAR) || ':' || {text}, '-')")
    return f"CAST('0x' || left(md5({' || '.join(parts)}), 15) AS BIGINT)"
