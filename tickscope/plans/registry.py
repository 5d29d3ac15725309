"""Registry of named queries: Spark builder + DuckDB oracle + rounded double columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ratios and scores are compared at 8 decimals, values on the scale of prices and volumes at 6, fitted values on that
# scale (sums over a whole series, in another order in each engine) at 4.
DIGITS, PRICE_DIGITS, FITTED_DIGITS = 8, 6, 4
PRICES = {"Open", "High", "Low", "Close", "Volume", "close", "ma_20", "ma_50", "norm_price", "period_return_pct",
          "daily_vol_pct", "rolling_rate_pct"}
FITTED = {"yhat", "yhat_lower", "yhat_upper", "residual", "t_mean", "y_mean", "sigma", "value"}


def digits_of(column: str) -> int:
    return FITTED_DIGITS if column in FITTED else PRICE_DIGITS if column in PRICES else DIGITS


@dataclass
class QuerySpec:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doubles: list[str] = field(default_factory=list)
    note: str = ""


REGISTRY: dict[str, QuerySpec] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column as round(x * 10^d) / 10^d, half away from zero.

    Written with the same floating steps as the oracle's ``round(x, d)`` so that
    half-way cases land on the same side in both engines; ``+ 0.0`` turns a
    negative zero into zero on both sides.
    """
    def half_away(c: str):
        scale = F.lit(float(10 ** digits_of(c)))
        return (F.round(F.col(c) * scale, 0) / scale + F.lit(0.0)).alias(c)
    return df.select(*[half_away(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def wrap_sql(sql: str, cols: list[str], doubles: list[str]) -> str:
    sel = ", ".join(f'round("{c}", {digits_of(c)}) + CAST(0.0 AS DOUBLE) AS "{c}"' if c in doubles else f'"{c}"'
                    for c in cols)
    return f"SELECT {sel} FROM (\n{sql}\n) AS q"


def register(name: str, cols: list[str], doubles: list[str], sql: str | None, note: str = ""):
    """Decorator: ``fn(spark, sf_dir) -> DataFrame`` with output columns ``cols``."""
    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir).select(*cols))
        full_sql = wrap_sql(sql, cols, doubles) if sql is not None else None
        REGISTRY[name] = QuerySpec(name, build, full_sql, list(doubles), note)
        return fn
    return deco
