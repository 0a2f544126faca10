"""Two-sided Student-t tail probability and its text form."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Executors get these functions with the task; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _log_gamma_step(a: float) -> float:
    """log of gamma(a + 1/2) / gamma(a): thirty steps up, then the series in 1 / a."""
    steps = np.arange(30.0)
    shifted = a + 30.0
    series = 0.5 * math.log(shifted) - 1 / (8 * shifted) + 1 / (192 * shifted**3) - 1 / (640 * shifted**5)
    return series - float(np.log1p(0.5 / (a + steps)).sum())


# Nodes and weights of exp-sinh quadrature over (0, inf).
_W = np.arange(-4.5, 4.5, 0.02)
_NODES = np.exp(0.5 * math.pi * np.sinh(_W))
_WEIGHTS = 0.02 * 0.5 * math.pi * np.cosh(_W) * _NODES


def _log_tail(t: float, df: float) -> float:
    """log P(|T| >= |t|) for ``df`` degrees of freedom.

    The density beyond t is integrated relative to its value at t, so neither a tiny tail nor a
    huge ``df`` costs digits.
    """
    if not (math.isfinite(df) and df > 0) or math.isnan(t):
        return math.nan
    if t == 0:
        return 0.0
    if math.isinf(t):
        return -math.inf
    t = abs(t)
    drop = _NODES / (df + t * t) * (2 * t + _NODES)
    with np.errstate(over="ignore", under="ignore"):
        inside = float((_WEIGHTS * np.exp(-(df + 1) / 2 * np.log1p(drop))).sum())
    at_t = _log_gamma_step(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * math.log1p(t / df * t)
    return min(0.0, math.log(2.0) + at_t + math.log(inside))


@F.pandas_udf(DoubleType())
def _log_p(t: pd.Series, df: pd.Series) -> pd.Series:
    out = [_log_tail(abs(a), b) for a, b in zip(t.to_numpy(float), df.to_numpy(float))]
    return pd.Series(np.array(out, dtype=float))


def log_p_value(t: Column, df: Column) -> Column:
    """log of the two-sided p value; null where t or df is missing.

    Runs on aggregated rows only (one per test), never on data rows.
    """
    ok = t.isNotNull() & ~F.isnan(t) & (df > 0)
    return F.when(ok, _log_p(F.coalesce(t, F.lit(0.0)), df.cast("double")))


def p_text(log_p: Column, min_exponent: int = -300) -> Column:
    """Scientific notation from log p, safe for p too small for a double."""
    log10_p = log_p / F.lit(math.log(10))
    exponent = F.floor(log10_p)
    mantissa = F.pow(F.lit(10.0), log10_p - exponent)
    finite = ~F.isnan(log_p) & (F.abs(log_p) != F.lit(math.inf))
    return (
        F.when(log_p.isNull(), F.lit(None).cast("string"))
        .when(~finite, F.lit(f"< 1e{min_exponent}"))
        .otherwise(F.format_string("%.2fe%d", mantissa, exponent))
    )
