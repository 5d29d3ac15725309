"""Scalar column expressions (all JVM-side built-ins, codegen-friendly)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER_GAMMA = 0.5772156649015329
TWO_POW_32 = 4294967296.0


def unit_hash(*parts) -> Column:
    """Deterministic uniform number in [0, 1) from the parts (first 32 bits of md5).

    The same formula is written in the DuckDB oracle, so both engines draw the
    same "random" numbers without sharing a random number generator.
    """
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    hexed = F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 8)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(TWO_POW_32)


def avg_path_length(n: Column) -> Column:
    """Average unsuccessful-search path length c(n) of a binary search tree."""
    nd = n.cast("double")
    return (F.when(nd <= 1, F.lit(0.0))
            .when(nd == 2, F.lit(1.0))
            .otherwise(2.0 * (F.log(nd - 1.0) + F.lit(EULER_GAMMA)) - 2.0 * (nd - 1.0) / nd))


def avg_path_length_py(n: int) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def ratio(num: Column, den: Column) -> Column:
    """num / den as floating point has it: x / 0 is infinite with the sign of x, 0 / 0 undefined (null)."""
    infinite = F.when(num > 0, F.lit(float("inf"))).when(num < 0, F.lit(float("-inf")))
    return F.when(den == 0, infinite).otherwise(F.try_divide(num, den))


def log_of(x: Column) -> Column:
    """Natural logarithm; of 0 it is minus infinity, of a negative number undefined (null)."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf")))


def finite(x: Column) -> Column:
    """x where it is a finite number, else null."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def row_key(ts: Column) -> Column:
    """A bar's time in microseconds as text: the hash key of its row (same text in the oracle)."""
    return F.unix_micros(ts.cast("timestamp")).cast("string")


def round_half_away(x: Column, digits: int) -> Column:
    """round(x * 10^d) / 10^d, half away from zero, in floating steps (same as SQL engines
    that round doubles this way, e.g. DuckDB)."""
    scale = float(10 ** digits)
    return F.round(x * F.lit(scale), 0) / F.lit(scale)
