"""Returns, carry proxies and the two-tenor residual.  All tables are day grain."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlab.functions.columns import by_day, ratio, whole
from termlab.operators.contracts import keep_first
from termlab.schema import DAY, TENORS, carries, px, returns

# Fixed value: rows after this day are used.
FIRST_DAY = datetime.date(2015, 12, 31)


def daily_rows(
    prices: DataFrame, keys: Sequence[str] = (), after: datetime.date | None = FIRST_DAY
) -> DataFrame:
    """Rows after a day, one per (keys, day).

    The filter reaches the Parquet scan.  Of several rows for one day the smallest
    by value is kept, so the choice does not depend on file order.
    """
    if after is not None:
        prices = prices.filter(F.col(DAY) > F.lit(after))
    rest = [c for c in prices.columns if c not in (*keys, DAY)]
    return keep_first(prices, [*keys, DAY], [], rest)


def log_returns(
    prices: DataFrame, tenors: Sequence[int] = TENORS, keys: Sequence[str] = ()
) -> DataFrame:
    """Add ``r_px_*``; days with any NULL are dropped, as is the first of a curve.

    The log of a price that is not positive is NULL, so its day and the next go.
    """
    partition = f"PARTITION BY {', '.join(keys)} " if keys else ""
    added = [
        F.expr(f"ln({p}) - lag(ln({p})) OVER ({partition}ORDER BY {DAY}) AS {r}")
        for p, r in zip(px(tenors), returns(tenors), strict=True)
    ]
    return prices.select("*", *added).dropna()


def add_carry(
    returned: DataFrame, tenors: Sequence[int] = TENORS, days: float = 30.0
) -> DataFrame:
    """Add ``carry_*``: slope to the next tenor over price and ``days`` between tenors.

    The last tenor has no next one and uses the one before it.
    """
    names = px(tenors)
    others = [*names[1:], names[-2]]
    slopes = [
        F.expr(f"try_divide({p} - {o}, {p}) / {float(days)!r}D AS {carry}")
        for p, o, carry in zip(names, others, carries(tenors), strict=True)
    ]
    return returned.select("*", *slopes)


def _slope_terms(y: str, x: str, ols: bool) -> tuple[Column, Column]:
    """Sample covariance and *population* variance, or both sample with ``ols``.

    The mixed divisors make the slope n/(n-1) times the least-squares one.
    """
    return F.covar_samp(y, x), F.var_samp(x) if ols else F.var_pop(x)


def _paired(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.filter(F.col(y).isNotNull() & F.col(x).isNotNull())


def pair_regression(
    returned: DataFrame, y: str, x: str, keys: Sequence[str] = (), ols: bool = False
) -> DataFrame:
    """(keys, n, beta, alpha) of the regression of ``y`` on ``x``: one aggregate."""
    beta = ratio(*_slope_terms(y, x, ols))
    return (
        _paired(returned, y, x)
        .groupBy(*keys)
        .agg(F.count("*").alias("n"), beta.alias("beta"), F.avg(y).alias("_y"), F.avg(x).alias("_x"))
        .select(*keys, "n", "beta", (F.col("_y") - F.col("beta") * F.col("_x")).alias("alpha"))
    )


def add_residual(
    returned: DataFrame, y: str, x: str, keys: Sequence[str] = (), ols: bool = False
) -> DataFrame:
    """Add ``residual`` = y - (alpha + beta x), coefficients over the whole curve."""
    curve = whole(keys)
    paired = _paired(returned, y, x).withColumns(
        {
            "_beta": ratio(*[term.over(curve) for term in _slope_terms(y, x, ols)]),
            "_my": F.avg(y).over(curve),
            "_mx": F.avg(x).over(curve),
        }
    )
    alpha = F.col("_my") - F.col("_beta") * F.col("_mx")
    fitted = alpha + F.col("_beta") * F.col(x)
    return paired.withColumn("residual", F.col(y) - fitted).drop("_beta", "_my", "_mx")


def residual_stats(residuals: DataFrame, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Variance ratio, population moments and lag-1 autocorrelation of ``residual``."""
    e = F.col("residual")
    lagged = residuals.withColumn("_lag", F.lag(e).over(by_day(keys)))
    return lagged.groupBy(*keys).agg(
        F.count("*").alias("n"),
        ratio(F.var_pop(e), F.var_pop(y)).alias("var_ratio"),
        F.avg(e).alias("mean"),
        F.stddev_pop(e).alias("std"),
        F.skewness(e).alias("skew"),
        F.kurtosis(e).alias("kurtosis"),
        F.corr(e, F.col("_lag")).alias("lag1_autocorr"),
    )


def residual_by_bucket(residuals: DataFrame, bucket: str, keys: Sequence[str] = ()) -> DataFrame:
    """Residual statistics per bucket, with the sample deviation.

    The lag runs over the days of one bucket, skipping the days in between.
    """
    e = F.col("residual")
    within = Window.partitionBy(*keys, bucket).orderBy(DAY)
    return (
        residuals.withColumn("_lag", F.lag(e).over(within))
        .groupBy(*keys, bucket)
        .agg(
            F.count("*").alias("n_obs"),
            F.avg(e).alias("mean"),
            F.stddev_samp(e).alias("std"),
            F.skewness(e).alias("skew"),
            F.kurtosis(e).alias("kurtosis"),
            F.corr(e, F.col("_lag")).alias("lag1_autocorr"),
        )
    )
