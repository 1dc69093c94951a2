"""Where the queries of the 3D engine and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuboid.plans.scene import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return register


def rounded(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Doubles rounded to 6 digits, without negative zeros."""
    todo = [n for n, t in df.dtypes if t == "double" and (names is None or n in names)]
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in todo})


def rounded_sql(names: str, **exprs: str) -> str:
    """SQL of rounded columns."""
    return ", ".join(f"round({exprs.get(n, n)}, 6) + 0.0 AS {n}" for n in names.split())


def uniform_sql(seed: int, purpose: str, *parts: str) -> str:
    """SQL of the number in [0, 1) that functions.geom.uniform gives."""
    text = "concat_ws('|', '" + f"{seed}', '{purpose}', " + ", ".join(f"{p}::VARCHAR" for p in parts) + ")"
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
