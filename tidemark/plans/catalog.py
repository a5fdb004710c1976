"""Catalogue of named queries, each with the SQL text that states the same result.

A query declares its output columns once. ``name:f`` is a double rounded to four
digits, ``name:i`` a bigint, and a bare name is kept as it is. The declaration shapes
both the DataFrame and the SQL, so the two always agree on names and types.

Means of four-digit values often lie exactly between two rounded values, where the order
of additions would decide the last digit. Both engines therefore round half up in decimal,
after nine digits have settled what addition left behind.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Tables
from . import views


DECIMAL = "decimal(38,9)"
#: Beyond this size a double has no nine digits to settle.
LARGE = 1e15


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.shape(self.build(Tables(spark, folder)))

    def shape(self, df: DataFrame) -> DataFrame:
        out = []
        for name, kind in self.columns:
            c = F.col(f"`{name}`")
            if kind == "f":
                c = c.cast("double")
                settled = F.round(c.cast(DECIMAL), 4).cast("double")
                c = F.when(F.abs(c) < LARGE, settled).otherwise(c) + F.lit(0.0)
            elif kind == "i":
                c = c.cast("bigint")
            out.append(c.alias(name))
        return df.select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        out = []
        for name, kind in self.columns:
            if kind == "f":
                c = f'CAST("{name}" AS DOUBLE)'
                settled = f"CAST(round(CAST({c} AS {DECIMAL}), 4) AS DOUBLE)"
                out.append(f'CASE WHEN abs({c}) < {LARGE} THEN {settled} ELSE {c} END + 0.0 AS "{name}"')
            elif kind == "i":
                out.append(f'CAST("{name}" AS BIGINT) AS "{name}"')
            else:
                out.append(f'"{name}"')
        body = self.sql.strip()
        local = ""
        match = re.match(r"WITH\s+(.*?)\n\s*RETURN\s+", body, re.S)
        if match:
            local, body = match.group(1), body[match.end():]
        ctes = views.needed(local + "\n" + body)
        if local:
            ctes = ctes + [local]
        prefix = "WITH " + ",\n".join(ctes) + "\n" if ctes else ""
        return f"{prefix}SELECT {', '.join(out)} FROM (\n{body}\n) AS result"


CATALOG: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register a function of ``Tables`` under ``name``.

    In ``sql`` the shared views may be used freely; text of the form
    ``WITH a AS (...) RETURN select`` adds local views.
    """
    parsed = tuple(
        (part.split(":")[0], part.split(":")[1] if ":" in part else "") for part in columns.split()
    )

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(name, parsed, fn, sql)
        return fn

    return register
