"""Rolling principal components and PC1-neutral hedge weights.

Window ``k`` of a curve covers its return rows ``[every*k, every*k + window)`` and
is used from row ``window + every*k`` on.  Components of z-scored returns are the
eigenvectors of their correlation matrix, so a window needs only its second
moments, which Spark aggregates; NumPy sees one small matrix per window, in Arrow
batches.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlab.functions.columns import by_day, dot
from termlab.schema import DAY, TENORS, carries, hedges, px, returns

# They decide the results.
WINDOW, EVERY, ANCHOR = 90, 5, -1.0


def _row_index(keys: Sequence[str]) -> Column:
    return F.row_number().over(by_day(keys)) - 1


def rolling_moments(
    returned: DataFrame,
    tenors: Sequence[int] = TENORS,
    keys: Sequence[str] = (),
    window: int = WINDOW,
    every: int = EVERY,
) -> DataFrame:
    """One row per rebalance: (keys, rebalance, day, sigma, cov, corr).

    ``sigma`` are population deviations (0 becomes 1); ``cov`` and ``corr`` are
    row-major square matrices.  Rows are reduced once to blocks of gcd(window, every) days, of which
    every window is a whole number: a row is read once, not once per window.  The covariance of a window is the
    mean of its blocks' covariances plus the covariance of their means, blocks being equally long.  Both are
    centred sums, so a level far from 0 costs no digits and a constant return has deviation 0 exactly.
    """
    names = returns(tenors)
    size = len(names)
    step = gcd(window, every)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]

    means = {f"m_{i}": f"avg({names[i]})" for i in range(size)}
    within = {f"c_{i}_{j}": f"covar_pop({names[i]}, {names[j]})" for i, j in pairs}
    blocks = (
        returned.withColumn("_block", F.floor(_row_index(keys) / step))
        .groupBy(*keys, "_block")
        .agg(F.min(DAY).alias(DAY), *[F.expr(f"{x} AS {m}") for m, x in (means | within).items()])
    )

    partition = f"PARTITION BY {', '.join(keys)} " if keys else ""
    frame = f"({partition}ORDER BY _block ROWS BETWEEN {window // step} PRECEDING AND 1 PRECEDING)"
    first_row = f"_block * {step}"
    total = [f"avg(c_{i}_{j}) OVER {frame} + covar_pop(m_{i}, m_{j}) OVER {frame} AS c_{i}_{j}" for i, j in pairs]
    framed = blocks.select(
        *keys,
        DAY,
        F.expr(f"({first_row} - {window}) DIV {every} AS rebalance"),
        F.expr(f"{first_row} >= {window} AND ({first_row} - {window}) % {every} = 0 AS _due"),
        *[F.expr(x) for x in total],
    ).filter("_due")

    cells = [(i, j) for i in range(size) for j in range(size)]
    deviations = ", ".join(f"coalesce(nullif(sqrt(c_{i}_{i}), 0D), 1D)" for i in range(size))
    covariances = ", ".join(f"c_{min(i, j)}_{max(i, j)}" for i, j in cells)
    correlations = ", ".join(f"cov[{i * size + j}] / (sigma[{i}] * sigma[{j}])" for i, j in cells)
    return (
        framed.select(
            *keys, "rebalance", DAY, F.expr(f"array({deviations}) AS sigma"), F.expr(f"array({covariances}) AS cov")
        )
        .withColumn("corr", F.expr(f"array({correlations})"))
    )


def _eigen_udf(size: int):
    """Eigenvalues and eigenvectors of a batch of symmetric matrices, largest first.

    The sign makes the entry of largest size in each vector positive.
    """

    @F.pandas_udf("values array<double>, vectors array<double>")
    def eigen(matrices: pd.Series) -> pd.DataFrame:
        import numpy as np

        if matrices.empty:
            return pd.DataFrame({"values": [], "vectors": []})
        batch = np.stack(matrices.to_numpy()).reshape(-1, size, size)
        values, vectors = np.linalg.eigh(batch)
        values = values[:, ::-1]
        vectors = vectors[:, :, ::-1].transpose(0, 2, 1)  # one component per row
        largest = np.abs(vectors).argmax(axis=2)[..., None]
        signs = np.sign(np.take_along_axis(vectors, largest, axis=2))
        vectors = (vectors * signs).reshape(len(batch), size * size)
        return pd.DataFrame({"values": list(values), "vectors": list(vectors)})

    return eigen


def principal_components(moments: DataFrame, tenors: Sequence[int] = TENORS) -> DataFrame:
    """Add ``values``, ``vectors`` (row-major, one component per row) and ``pc1``."""
    size = len(tenors)
    out = moments.withColumn("_eigen", _eigen_udf(size)("corr"))
    return out.select(
        *moments.columns,
        "_eigen.values",
        "_eigen.vectors",
        F.slice("_eigen.vectors", 1, size).alias("pc1"),
    )


def _loading(space: str) -> Column:
    """PC1 in ``standardised`` space, or scaled to raw returns for ``tradable``."""
    if space == "standardised":
        return F.col("pc1")
    if space == "tradable":
        return F.zip_with("pc1", "sigma", lambda e, s: e * s)
    raise ValueError(f"space must be 'standardised' or 'tradable', not {space!r}")


def hedge_weights(
    components: DataFrame,
    tenors: Sequence[int] = TENORS,
    keys: Sequence[str] = (),
    space: str = "tradable",
    anchor: float = ANCHOR,
) -> DataFrame:
    """(keys, rebalance, day, w_px_*): front tenor at ``anchor``, smallest neutral rest.

    The rest is parallel to PC1 without its front entry; if that is zero only the
    anchor remains.
    """
    names = hedges(tenors)
    norm = " + ".join(f"_v[{i}] * _v[{i}]" for i in range(1, len(names)))
    weights = [f"{float(anchor)!r}D AS {names[0]}"]
    weights += [f"coalesce(_k * _v[{i}], 0D) AS {name}" for i, name in enumerate(names[1:], start=1)]
    return (
        components.select(*keys, "rebalance", DAY, _loading(space).alias("_v"))
        .withColumn("_k", F.expr(f"try_divide(-(_v[0] * {float(anchor)!r}D), {norm})"))
        .select(*keys, "rebalance", DAY, *[F.expr(w) for w in weights])
    )


def attach_weights(
    returned: DataFrame,
    hedge: DataFrame,
    tenors: Sequence[int] = TENORS,
    keys: Sequence[str] = (),
    window: int = WINDOW,
    every: int = EVERY,
) -> DataFrame:
    """Carry each rebalance's weights to the day rows it covers; NULL before the first.

    A row's rebalance number follows from its position, so filling forward is an
    equi-join and one curve's weights cannot reach another.
    """
    number = F.floor((_row_index(keys) - window) / every)
    placed = returned.withColumn("rebalance", number)
    joined = placed.join(hedge.drop(DAY), [*keys, "rebalance"], "left")
    return joined.select(*returned.columns, *hedges(tenors))


def diagnostics(
    components: DataFrame, tenors: Sequence[int] = TENORS, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, rebalance, day, pc1_var, rotation, pc1_px_*).

    ``pc1_var`` is the explained share of PC1.  ``rotation`` is the angle to the
    previous PC1, NULL at the first rebalance.
    """
    order = Window.partitionBy(*keys).orderBy("rebalance")
    size = len(tenors)
    spread = " + ".join(f"values[{i}]" for i in range(size))
    cosine = " + ".join(f"pc1[{i}] * _prev[{i}]" for i in range(size))
    with_prev = components.withColumn("_prev", F.lag("pc1").over(order))
    return with_prev.select(
        *keys,
        "rebalance",
        DAY,
        F.expr(f"try_divide(values[0], {spread}) AS pc1_var"),
        F.expr(f"if(_prev IS NULL, NULL, acos(greatest(-1D, least(1D, {cosine})))) AS rotation"),
        *[F.expr(f"pc1[{i}] AS pc1_{name}") for i, name in enumerate(px(tenors))],
    )


def explained_variance(
    components: DataFrame, tenors: Sequence[int] = TENORS, keys: Sequence[str] = ()
) -> DataFrame:
    """Explained share of every component, one column per component."""
    spread = " + ".join(f"values[{i}]" for i in range(len(tenors)))
    shares = [F.expr(f"try_divide(values[{i}], {spread}) AS var_{i + 1}") for i in range(len(tenors))]
    return components.select(*keys, "rebalance", DAY, *shares)


def neutrality(
    components: DataFrame,
    hedge: DataFrame,
    tenors: Sequence[int] = TENORS,
    keys: Sequence[str] = (),
    space: str = "tradable",
) -> DataFrame:
    """Exposure of the hedge to PC1 at each rebalance, which should be 0."""
    loading = components.select(*keys, "rebalance", _loading(space).alias("_v"))
    exposure = F.expr(" + ".join(f"{w} * _v[{i}]" for i, w in enumerate(hedges(tenors))))
    return hedge.join(loading, [*keys, "rebalance"]).select(
        *keys, "rebalance", DAY, exposure.alias("neutrality")
    )


def describe_neutrality(checks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of the exposure."""
    x = F.col("neutrality")
    return checks.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        *[F.percentile(x, F.lit(q / 100)).alias(f"p{q}") for q in (25, 50, 75)],
        F.max(x).alias("max"),
    )


def attribution(weighted: DataFrame, tenors: Sequence[int] = TENORS) -> DataFrame:
    """Add ``port_total``, its carry part ``port_carry`` and the remainder ``port_shock``."""
    earned = dot(hedges(tenors), returns(tenors))
    carried = dot(hedges(tenors), carries(tenors))
    return weighted.withColumns(
        {"port_total": earned, "port_carry": carried, "port_shock": earned - carried}
    )


def gross_exposure(
    weighted: DataFrame, tenors: Sequence[int] = TENORS, keys: Sequence[str] = ()
) -> DataFrame:
    """Sum of absolute hedge weights per day."""
    size = " + ".join(f"abs({w})" for w in hedges(tenors))
    return weighted.select(*keys, DAY, F.expr(f"{size} AS gross"))
