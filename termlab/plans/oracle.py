"""The same results as plain SQL over the same tables, one statement per query.

Written from the definitions, not from the Spark plans: common table expressions
build the stages, and each statement includes the ones it needs.
"""

from __future__ import annotations

TENORS = (180, 360, 540, 720, 900, 1080)
FIXED = (-1.0, 0.2, 0.2, 0.2, 0.2, 0.2)
K = range(len(TENORS))
PX = [f"px_{t}d" for t in TENORS]
R = [f"r_px_{t}d" for t in TENORS]
C = [f"carry_{t}d" for t in TENORS]
W = [f"w_px_{t}d" for t in TENORS]
CODES = "FGHJKMNQUVXZ"

_STAGES: dict[str, tuple[tuple[str, ...], str]] = {}
_QUERIES: dict[str, str] = {}


def stage(name: str, needs: str, sql: str) -> None:
    _STAGES[name] = (tuple(needs.split()), sql)


def ordered(needs: str) -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        if name not in seen:
            for other in _STAGES[name][0]:
                visit(other)
            seen.append(name)

    for name in needs.split():
        visit(name)
    return seen


def answer(name: str, needs: str, sql: str) -> None:
    parts = [f"{s} AS ({_STAGES[s][1]})" for s in ordered(needs)]
    head = "WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else ""
    _QUERIES[name] = head + sql


def rd(expr: str, alias: str, digits: int = 6) -> str:
    scale = f"{float(10**digits):.1f}"
    return f"floor(({expr}) * {scale} + 0.5) / {scale} AS {alias}"


def sci(expr: str, alias: str) -> str:
    return f"printf('%.6e', {expr}) AS {alias}"


def text(expr: str, alias: str) -> str:
    return f"CAST({expr} AS VARCHAR) AS {alias}"


def big(expr: str, alias: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {alias}"


DAY = text("tradingDay", '"tradingDay"')
KEYS = f"curve_id, {DAY}"
BY_DAY = "OVER (PARTITION BY curve_id ORDER BY tradingDay)"
UPTO = "OVER (PARTITION BY curve_id ORDER BY tradingDay ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def nearest(column: str, q: float) -> str:
    """Value at rank round((n - 1) q) of the non-null values of a group."""
    values = f"list_sort(list({column}) FILTER (WHERE {column} IS NOT NULL))"
    count = f"count({column})"
    return f"{values}[CAST(floor(({count} - 1) * CAST({q} AS DOUBLE) + 0.5) AS BIGINT) + 1]"


def cuts(column: str, n: int) -> str:
    probs = ", ".join(f"CAST({i / n!r} AS DOUBLE)" for i in range(1, n))
    return f"quantile_cont({column}, [{probs}])"


def steady(x: str) -> str:
    """A number on its first 40 binary digits: equal values stay equal whatever rounding did to their last bits."""
    grid = f"pow(2.0::DOUBLE, floor(log2(abs({x}))) - 39)"
    return f"CASE WHEN abs({x}) > 1e-280 AND abs({x}) < 1e280 THEN floor({x} / {grid} + 0.5::DOUBLE) * {grid} ELSE {x} END"


def bucket(column: str, cut: str = "cut") -> str:
    below = f"{steady('c')} < {steady(f'{column}::DOUBLE')}"
    return f"CASE WHEN {column} IS NOT NULL THEN 1 + len(list_filter({cut}, lambda c: {below})) END"


def labelled(source: str, column: str, labels: list[str], out: str) -> str:
    """``source`` with a label column: quantile bucket of ``column`` within the curve."""
    names = ", ".join(f"'{x}'" for x in labels)
    return (
        f"SELECT * EXCLUDE (cut), ([{names}])[{bucket(column)}] AS {out} FROM ("
        f"SELECT s.*, b.cut FROM {source} s JOIN "
        f"(SELECT curve_id, {cuts(column, len(labels))} AS cut FROM {source} GROUP BY 1) b USING (curve_id))"
    )


# -- bars --------------------------------------------------------------------

stage(
    "bars",
    "",
    """SELECT user_id AS symbol, CAST(ts AS DATE) AS day, value AS close, event_type AS file_path,
       epoch_us(ts) AS at_us,
       epoch_us(timezone('America/Chicago', CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 895 MINUTE)) AS target
FROM events""",
)
_PICK = """SELECT symbol, CAST(day AS VARCHAR) AS "tradingDay", close, at_us FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY abs(at_us - target), at_us, close) AS rn FROM bars
) WHERE rn = 1"""
for _name in ("nearest_pick", "nearest_pick_any_times", "csv_bars"):
    answer(_name, "bars", _PICK.replace(" close,", f" {rd('close', 'close')},", 1))
# The five layouts of the mixed tree: what each file holds once it is written and read.
stage(
    "mixed",
    "",
    f"""SELECT event_type AS layout, value AS close,
       CASE WHEN event_type = 'error' THEN 'VI' || code || '24'
            WHEN event_type = 'signup' AND user_id % 3 = 0 THEN NULL ELSE 'VI' || code || yy END AS symbol,
       CASE WHEN event_type = 'view' AND user_id % 4 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day,
       CASE WHEN event_type = 'signup' AND user_id % 5 = 0 THEN NULL ELSE epoch_us(ts) END AS at_us,
       epoch_us(timezone('America/Chicago', CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 895 MINUTE)) AS target
FROM (SELECT *, ('{CODES}')[CAST(user_id % 12 AS INTEGER) + 1] AS code, lpad(CAST((user_id // 12) % 100 AS VARCHAR), 2, '0') AS yy
      FROM events) WHERE event_type <> 'purchase'""",
)
answer(
    "csv_bars_mixed",
    "mixed",
    f"""SELECT layout, symbol, CAST(day AS VARCHAR) AS "tradingDay", {rd('close', 'close')}, at_us FROM (
  SELECT *, row_number() OVER (PARTITION BY layout, symbol, day ORDER BY abs(at_us - target) NULLS LAST, at_us, close) AS rn
  FROM mixed WHERE day IS NOT NULL) WHERE rn = 1""",
)
answer(
    "csv_bar_quality",
    "mixed",
    """SELECT layout, count(*) AS n_bars, count(*) - count(at_us) AS n_bad_time, count(*) - count(day) AS n_bad_day,
       count(*) - count(symbol) AS n_no_symbol, count(*) - count(close) AS n_no_close,
       count(*) FILTER (WHERE close <= 0) AS n_nonpositive_close FROM mixed GROUP BY 1""",
)
answer(
    "keep_first",
    "bars",
    f"""SELECT symbol, CAST(day AS VARCHAR) AS "tradingDay", file_path, {rd('close', 'close')}, at_us FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, day
    ORDER BY file_path, abs(at_us - target), at_us, close) AS rn FROM bars
) WHERE rn = 1""",
)
answer(
    "bar_quality",
    "",
    """SELECT event_type AS file_path, count(*) AS n_bars, count(*) - count(ts) AS n_bad_time,
       count(*) - count(ts) AS n_bad_day, count(*) - count(user_id) AS n_no_symbol,
       count(*) - count(value) AS n_no_close, count(*) FILTER (WHERE value <= 0) AS n_nonpositive_close
FROM events GROUP BY 1""",
)

# -- contracts ---------------------------------------------------------------

stage(
    "rows",
    "",
    """SELECT l_returnflag AS curve_id, CAST(o_orderdate AS DATE) AS tradingDay, l_suppkey AS symbol,
       l_extendedprice AS close, CAST(l_shipdate AS DATE) AS expiry,
       CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS ttm_days, l_orderkey, l_linenumber
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
stage(
    "calendar",
    "rows",
    "SELECT year(expiry) AS y, month(expiry) AS m, max(expiry) AS last_day FROM rows GROUP BY 1, 2",
)
answer(
    "expiry_calendar",
    "calendar",
    f"SELECT {big('y', 'exp_year')}, {big('m', 'exp_month')}, {text('last_day', 'expiry')} FROM calendar",
)
answer(
    "contract_expiry",
    "rows calendar",
    f"""SELECT ' vi' || lower(('{CODES}')[month(r.expiry)]) || strftime(r.expiry, '%y') AS symbol,
       {text('c.last_day', 'expiry')}, count(*) AS n, {big('min(c.last_day - tradingDay)', 'min_ttm')},
       {big('max(c.last_day - tradingDay)', 'max_ttm')}, {big('sum(c.last_day - tradingDay)', 'sum_ttm')}
FROM rows r JOIN calendar c ON y = year(r.expiry) AND m = month(r.expiry)
WHERE c.last_day - tradingDay > 0 GROUP BY 1, 2""",
)
stage(
    "term",
    "rows",
    """SELECT curve_id, tradingDay, symbol, close, expiry, ttm_days FROM (
  SELECT *, row_number() OVER (PARTITION BY curve_id, symbol, tradingDay
    ORDER BY l_orderkey, l_linenumber, ttm_days, close, expiry) AS rn
  FROM rows WHERE ttm_days > 0) WHERE rn = 1""",
)
answer(
    "term_structure",
    "term",
    f"SELECT curve_id, symbol, {DAY}, {rd('close', 'close', 4)}, {text('expiry', 'expiry')}, "
    f"{big('ttm_days', 'ttm_days')} FROM term",
)
answer(
    "term_quality",
    "rows",
    """SELECT curve_id, count(*) AS n_rows, count(*) - count(ttm_days) AS n_no_maturity,
       count(*) FILTER (WHERE ttm_days <= 0) AS n_expired, count(*) - count(close) AS n_no_close
FROM rows GROUP BY 1""",
)

# -- constant maturity -------------------------------------------------------

stage(
    "bounds",
    "term",
    "SELECT curve_id, tradingDay, "
    + ", ".join(
        f"coalesce(max(ttm_days) FILTER (WHERE ttm_days <= {t}), min(ttm_days)) AS d1_{t}, "
        f"coalesce(min(ttm_days) FILTER (WHERE ttm_days >= {t}), max(ttm_days)) AS d2_{t}"
        for t in TENORS
    )
    + " FROM term GROUP BY 1, 2",
)
stage(
    "sides",
    "term bounds",
    "SELECT curve_id, tradingDay, "
    + ", ".join(
        f"any_value(d1_{t}) AS d1_{t}, any_value(d2_{t}) AS d2_{t}, "
        f"min(symbol) FILTER (WHERE ttm_days = d1_{t}) AS sym1_{t}, "
        f"min(symbol) FILTER (WHERE ttm_days = d2_{t}) AS sym2_{t}"
        for t in TENORS
    )
    + " FROM term JOIN bounds USING (curve_id, tradingDay) GROUP BY 1, 2",
)
answer(
    "bracket",
    "sides",
    f"SELECT {KEYS}, "
    + ", ".join(f"{big(f'{f}_{t}', f'{f}_{t}')}" for t in TENORS for f in ("d1", "d2", "sym1", "sym2"))
    + " FROM sides",
)
answer(
    "bracket_gaps",
    "term",
    " UNION ALL ".join(
        f"SELECT {KEYS}, {t}::BIGINT AS tenor, '{side}' AS side, {big(end, 'nearest')}, {big(f'abs({end} - {t})', 'gap_days')} "
        f"FROM (SELECT curve_id, tradingDay, min(ttm_days) AS short, max(ttm_days) AS long FROM term GROUP BY 1, 2) WHERE {test}"
        for t in TENORS
        for side, end, test in (("below", "short", f"short > {t}"), ("above", "long", f"long < {t}"))
    ),
)
stage(
    "weighted",
    "term sides",
    "SELECT term.*, "
    + ", ".join(
        f"""CASE WHEN d1_{t} = d2_{t} THEN CASE WHEN symbol = sym1_{t} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
WHEN symbol = sym1_{t} THEN (d2_{t} - {t}.0::DOUBLE) / (d2_{t} - d1_{t})
WHEN symbol = sym2_{t} THEN ({t}.0::DOUBLE - d1_{t}) / (d2_{t} - d1_{t}) ELSE 0.0::DOUBLE END AS weight_{t}d"""
        for t in TENORS
    )
    + " FROM term JOIN sides USING (curve_id, tradingDay)",
)
answer(
    "cm_weights",
    "weighted",
    f"SELECT curve_id, symbol, {DAY}, {big('ttm_days', 'ttm_days')}, "
    + ", ".join(rd(f"weight_{t}d", f"weight_{t}d", 9) for t in TENORS)
    + " FROM weighted",
)
stage(
    "prices",
    "weighted",
    "SELECT curve_id, tradingDay, "
    + ", ".join(f"coalesce(sum(close * weight_{t}d), 0.0) AS px_{t}d" for t in TENORS)
    + " FROM weighted GROUP BY 1, 2",
)
for _name in ("cm_prices", "cm_prices_from_weights", "parquet_stage"):
    answer(_name, "prices", f"SELECT {KEYS}, " + ", ".join(rd(p, p, 4) for p in PX) + " FROM prices")
answer(
    "weight_sum",
    "weighted",
    f"SELECT {KEYS}, "
    + " AND ".join(f"abs(sum(weight_{t}d) - 1) <= 1e-6" for t in TENORS)
    + " AS sums_to_one FROM weighted GROUP BY curve_id, tradingDay",
)
answer(
    "price_quality",
    "prices",
    "SELECT curve_id, count(*) AS n_days, "
    + ", ".join(
        f"count(*) - count({p}) AS null_{p}, count(*) FILTER (WHERE {p} <= 0) AS nonpositive_{p}" for p in PX
    )
    + " FROM prices GROUP BY 1",
)

# -- returns -----------------------------------------------------------------

answer(
    "daily_first",
    "term",
    f"""SELECT {KEYS}, {rd('close', 'close')}, {big('ttm_days', 'ttm_days')} FROM (
  SELECT *, row_number() OVER (PARTITION BY curve_id, tradingDay ORDER BY close, ttm_days) AS rn
  FROM term WHERE tradingDay > DATE '1995-12-31') WHERE rn = 1""",
)
stage(
    "carried",
    "prices",
    "SELECT *, "
    + ", ".join(
        f"({PX[i]} - {PX[i + 1] if i < 5 else PX[i - 1]}) / nullif({PX[i]}, 0) / 180.0 AS {C[i]}" for i in K
    )
    + " FROM prices",
)
stage(
    "ret",
    "carried",
    "SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY tradingDay) - 1 AS i FROM (SELECT *, "
    + ", ".join(
        f"CASE WHEN {p} > 0 AND lag({p}) {BY_DAY} > 0 THEN ln({p}) - ln(lag({p}) {BY_DAY}) END AS {r}"
        for p, r in zip(PX, R, strict=True)
    )
    + " FROM carried) WHERE "
    + " AND ".join(f"{x} IS NOT NULL" for x in R + C),
)
answer("log_returns", "ret", f"SELECT {KEYS}, " + ", ".join(rd(r, r, 9) for r in R) + " FROM ret")
answer("carry", "carried", f"SELECT {KEYS}, " + ", ".join(rd(c, c, 9) for c in C) + " FROM carried")
_Y, _X = R[0], R[2]
for _name, _var in (("pair_beta", "var_pop"), ("pair_beta_ols", "var_samp")):
    answer(
        _name,
        "ret",
        f"""SELECT curve_id, n, {rd('beta', 'beta', 9)}, {rd('my - beta * mx', 'alpha', 9)} FROM (
  SELECT curve_id, count(*) AS n, covar_samp({_Y}, {_X}) / {_var}({_X}) AS beta, avg({_Y}) AS my, avg({_X}) AS mx
  FROM ret GROUP BY 1)""",
    )
stage(
    "spot",
    "prices",
    """SELECT curve_id, tradingDay, spot FROM prices JOIN (
  SELECT CAST(o_orderdate AS DATE) AS tradingDay, avg(o_totalprice / 1000.0) AS spot FROM orders GROUP BY 1
) USING (tradingDay)""",
)
stage(
    "resid",
    "ret spot",
    f"""SELECT r.curve_id, r.tradingDay, {_Y} AS y, {_Y} - (my - beta * mx + beta * {_X}) AS e,
       {PX[2]} - {PX[0]} AS slope, spot
FROM ret r JOIN (SELECT curve_id, covar_samp({_Y}, {_X}) / var_pop({_X}) AS beta, avg({_Y}) AS my, avg({_X}) AS mx
  FROM ret GROUP BY 1) USING (curve_id) LEFT JOIN spot s ON s.curve_id = r.curve_id AND s.tradingDay = r.tradingDay""",
)
answer("residual", "resid", f"SELECT {KEYS}, {rd('e', 'residual', 9)} FROM resid")


def moments(x: str, mean: str) -> str:
    """Biased skewness and excess kurtosis from central moments."""
    return (
        f"avg(pow({x} - {mean}, 3)) / nullif(pow(avg(pow({x} - {mean}, 2)), 1.5), 0) AS g1, "
        f"avg(pow({x} - {mean}, 4)) / nullif(pow(avg(pow({x} - {mean}, 2)), 2), 0) - 3 AS g2"
    )


answer(
    "residual_stats",
    "resid",
    f"""SELECT curve_id, n, {rd('vr', 'var_ratio')}, {rd('mean', 'mean', 9)}, {rd('sd', 'std')},
       {rd('g1', 'skew')}, {rd('g2', 'kurtosis')}, {rd('ac', 'lag1_autocorr')} FROM (
  SELECT curve_id, count(*) AS n, var_pop(e) / var_pop(y) AS vr, avg(e) AS mean, stddev_pop(e) AS sd,
         {moments('e', 'm')}, corr(e, prev) AS ac
  FROM (SELECT *, avg(e) OVER (PARTITION BY curve_id) AS m, lag(e) {BY_DAY} AS prev FROM resid) GROUP BY 1)""",
)
for _col in ("slope", "spot"):
    stage(f"resid_{_col}", "resid", labelled("resid", _col, [f"Q{i + 1}" for i in range(5)], "label"))
    answer(
        f"residual_by_{_col}",
        f"resid_{_col}",
        f"""SELECT curve_id, label, n_obs, {rd('mean', 'mean')}, {rd('sd', 'std')}, {rd('g1', 'skew')},
       {rd('g2', 'kurtosis')}, {rd('ac', 'lag1_autocorr')} FROM (
  SELECT curve_id, label, count(*) AS n_obs, avg(e) AS mean, stddev_samp(e) AS sd, {moments('e', 'm')},
         corr(e, prev) AS ac
  FROM (SELECT *, avg(e) OVER (PARTITION BY curve_id, label) AS m,
               lag(e) OVER (PARTITION BY curve_id, label ORDER BY tradingDay) AS prev FROM resid_{_col})
  GROUP BY 1, 2)""",
    )

# -- principal components ----------------------------------------------------

_CELLS = [(i, j) for i in K for j in K if i <= j]


def _cov(i: int, j: int) -> str:
    return f"cov_{min(i, j) + 1}_{max(i, j) + 1}"


stage(
    "starts",
    "ret",
    "SELECT curve_id, CAST((i - 90) // 5 AS BIGINT) AS rebalance, i AS t, tradingDay FROM ret "
    "WHERE i >= 90 AND (i - 90) % 5 = 0",
)
stage(
    "windows",
    "starts ret",
    "SELECT s.curve_id, s.rebalance, any_value(s.tradingDay) AS tradingDay, "
    + ", ".join(f"covar_pop(r.{R[i]}, r.{R[j]}) AS cov_{i + 1}_{j + 1}" for i, j in _CELLS)
    + " FROM starts s JOIN ret r ON r.curve_id = s.curve_id AND r.i BETWEEN s.t - 90 AND s.t - 1 GROUP BY 1, 2",
)
stage(
    "scaled",
    "windows",
    "SELECT *, "
    + ", ".join(f"CASE WHEN cov_{i + 1}_{i + 1} = 0 THEN 1.0 ELSE sqrt(cov_{i + 1}_{i + 1}) END AS sd_{i + 1}" for i in K)
    + " FROM windows",
)
answer(
    "rolling_cov",
    "scaled",
    f"SELECT curve_id, rebalance, {DAY}, "
    + ", ".join(rd(f"sd_{i + 1}", f"sd_{i + 1}", 9) for i in K)
    + ", "
    + ", ".join(rd(_cov(i, j), _cov(i, j), 9) for i, j in _CELLS)
    + " FROM scaled",
)
stage(
    "corr",
    "scaled",
    "SELECT curve_id, rebalance, tradingDay, ["
    + ", ".join(f"sd_{i + 1}" for i in K)
    + "] AS sd, ["
    + ", ".join(f"{_cov(i, j)} / (sd_{i + 1} * sd_{j + 1})" for i in K for j in K)
    + "] AS c FROM scaled",
)
# Repeated squaring of the correlation matrix converges to the projection on PC1.
_TRACE = " + ".join(f"sq[{7 * i + 1}]" for i in K)
_PRODUCT = " + ".join(f"m[(x // 6) * 6 + {a + 1}] * m[{6 * a} + (x % 6) + 1]" for a in K)
stage(
    "powers",
    "corr",
    f"""SELECT curve_id, rebalance, 0 AS step, c AS m FROM corr
UNION ALL
SELECT curve_id, rebalance, step + 1, list_transform(sq, lambda v: v / ({_TRACE})) FROM (
  SELECT curve_id, rebalance, step, list_transform(range(36), lambda x: {_PRODUCT}) AS sq FROM powers WHERE step < 40)""",
)
_LARGEST = "list_position([{0}], greatest({0}))".format(", ".join(f"m[{7 * i + 1}]" for i in K))
stage(
    "pc",
    "powers corr",
    f"""SELECT *, list_transform(range(6), lambda a: m[a * 6 + big] / sqrt(m[(big - 1) * 7 + 1])) AS e FROM (
  SELECT curve_id, rebalance, tradingDay, sd, c, m, {_LARGEST} AS big
  FROM corr JOIN (SELECT * FROM powers WHERE step = 40) USING (curve_id, rebalance))""",
)
_LAMBDA = "list_sum(list_transform(range(36), lambda x: c[x + 1] * m[x + 1]))"
_DOT = " + ".join(f"e[{i + 1}] * prev[{i + 1}]" for i in K)
stage(
    "diag",
    "pc",
    f"""SELECT *, {_LAMBDA} / ({' + '.join(f'c[{7 * i + 1}]' for i in K)}) AS pc1_var,
       CASE WHEN prev IS NOT NULL THEN acos(greatest(-1.0, least(1.0, {_DOT}))) END AS rotation
FROM (SELECT *, lag(e) OVER (PARTITION BY curve_id ORDER BY rebalance) AS prev FROM pc)""",
)
answer(
    "pca_diag",
    "diag",
    f"SELECT curve_id, rebalance, {DAY}, {rd('pc1_var', 'pc1_var', 5)}, {rd('rotation', 'rotation', 5)}, "
    + ", ".join(rd(f"e[{i + 1}]", f"pc1_{PX[i]}", 5) for i in K)
    + " FROM diag",
)
answer(
    "pca_var_median",
    "diag",
    f"SELECT curve_id, {rd('median(pc1_var)', 'median_pc1_var', 5)}, count(*) AS n_rebalances FROM diag GROUP BY 1",
)
# Without PC1's part the same squaring converges to the projection on PC2.
stage(
    "deflated",
    "pc",
    f"""SELECT curve_id, rebalance, c, first_value, list_transform(range(36), lambda x: c[x + 1] - first_value * m[x + 1]) AS d
FROM (SELECT *, {_LAMBDA} AS first_value FROM pc)""",
)
stage(
    "powers_2",
    "deflated",
    f"""SELECT curve_id, rebalance, 0 AS step, d AS m FROM deflated
UNION ALL
SELECT curve_id, rebalance, step + 1, list_transform(sq, lambda v: v / ({_TRACE})) FROM (
  SELECT curve_id, rebalance, step, list_transform(range(36), lambda x: {_PRODUCT}) AS sq FROM powers_2 WHERE step < 40)""",
)
stage(
    "spectrum",
    "deflated powers_2",
    f"""SELECT *, CASE WHEN {' + '.join(f'd[{7 * i + 1}]' for i in K)} < 1e-9 THEN 0.0::DOUBLE
       ELSE {_LAMBDA.replace('c[x', 'd[x')} END AS second_value, {' + '.join(f'c[{7 * i + 1}]' for i in K)} AS power_1,
       list_sum(list_transform(range(36), lambda x: c[x + 1] * c[x + 1])) AS power_2,
       list_sum(list_transform(range(36), lambda x: ({_PRODUCT.replace('m[', 'c[')}) * c[x + 1])) AS power_3
FROM deflated JOIN (SELECT * FROM powers_2 WHERE step = 40) USING (curve_id, rebalance)""",
)
answer(
    "pca_spectrum_checks",
    "spectrum",
    "SELECT curve_id, rebalance, "
    + ", ".join(
        rd(e, n, 5)
        for e, n in [
            *[(f"power_{k}", f"power_{k}") for k in (1, 2, 3)],
            ("first_value", "value_1"),
            ("second_value", "value_2"),
            ("first_value / power_1", "var_1"),
            ("second_value / power_1", "var_2"),
            *[(f"c[{6 * i + j + 1}]", f"rebuilt_{i + 1}_{j + 1}") for i, j in _CELLS],
        ]
    )
    + " FROM spectrum",
)
for _space, _v in (("standardised", "e[{0}]"), ("tradable", "e[{0}] * sd[{0}]")):
    _v1 = _v.format(1)
    _rest = " + ".join(f"pow({_v.format(i + 1)}, 2)" for i in K if i)
    stage(
        f"hedge_{_space}",
        "pc",
        f"SELECT curve_id, rebalance, -1.0::DOUBLE AS {W[0]}, "
        + ", ".join(f"({_v1}) / nullif({_rest}, 0) * {_v.format(i + 1)} AS {W[i]}" for i in K if i)
        + " FROM pc",
    )
    stage(
        f"hedged_{_space}",
        f"ret hedge_{_space}",
        f"SELECT r.*, {', '.join(W)} FROM ret r LEFT JOIN hedge_{_space} h ON h.curve_id = r.curve_id "
        "AND r.i >= 90 AND h.rebalance = (r.i - 90) // 5",
    )
    stage(
        f"exposed_{_space}",
        f"pc hedge_{_space}",
        f"SELECT p.curve_id, p.rebalance, p.tradingDay, {' + '.join(f'{W[i]} * e[{i + 1}]' for i in K)} AS in_standardised, "
        f"{' + '.join(f'{W[i]} * e[{i + 1}] * sd[{i + 1}]' for i in K)} AS in_tradable "
        f"FROM pc p JOIN hedge_{_space} USING (curve_id, rebalance)",
    )
    answer(
        f"hedge_weights_{_space}",
        f"hedged_{_space}",
        f"SELECT {KEYS}, " + ", ".join(rd(w, w) for w in W) + f" FROM hedged_{_space}",
    )
answer(
    "pca_neutrality",
    "exposed_standardised exposed_tradable",
    f"SELECT curve_id, rebalance, {text('s.tradingDay', '"tradingDay"')}, "
    + ", ".join(
        rd(f"{x}.in_{space}", f"{hedge}_in_{space}")
        for x, hedge in (("s", "standardised"), ("t", "tradable"))
        for space in ("standardised", "tradable")
    )
    + " FROM exposed_standardised s JOIN exposed_tradable t USING (curve_id, rebalance)",
)
_DESCRIBED = {
    "mean": "avg(x)", "std": "stddev_samp(x)", "min": "min(x)", "max": "max(x)",
    **{f"p{q}": f"quantile_cont(x, {q / 100})" for q in (25, 50, 75)},
}
answer(
    "neutrality_summary",
    "exposed_tradable",
    "SELECT curve_id, count(*) AS n, "
    + ", ".join(rd(e, n) for n, e in _DESCRIBED.items())
    + " FROM (SELECT curve_id, in_standardised AS x FROM exposed_tradable) GROUP BY 1",
)
answer(
    "hedge_gross_exposure",
    "hedged_tradable",
    f"SELECT {KEYS}, {rd(' + '.join(f'abs({w})' for w in W), 'gross')} FROM hedged_tradable",
)

# -- strategy, once with fixed weights and once with the rolling hedge -------

stage("fixed", "ret", "SELECT ret.*, " + ", ".join(f"{w}::DOUBLE AS {n}" for w, n in zip(FIXED, W, strict=True)) + " FROM ret")
_LEGS = f"""SELECT *, w_contract * r_next AS pnl_leg FROM (
  SELECT t.curve_id, t.tradingDay, t.symbol, t.expiry, t.ttm_days, t.close, t.close_next, t.nextDay,
         {' + '.join(f'{w} * weight_{t}d' for w, t in zip(W, TENORS, strict=True))} AS w_contract,
         CASE WHEN t.close > 0 AND t.close_next > 0 THEN ln(t.close_next / t.close) END AS r_next
  FROM (SELECT *, lead(close) OVER s AS close_next, lead(tradingDay) OVER s AS nextDay FROM {{1}}
        WINDOW s AS (PARTITION BY curve_id, symbol ORDER BY tradingDay)) t
  JOIN {{0}} h ON h.curve_id = t.curve_id AND h.tradingDay = t.tradingDay
  WHERE t.close_next IS NOT NULL) WHERE w_contract <> 0"""
_ATTR = (
    f"SELECT curve_id, tradingDay, {' + '.join(f'{w} * {r}' for w, r in zip(W, R, strict=True))} AS port_total, "
    f"{' + '.join(f'{w} * {c}' for w, c in zip(W, C, strict=True))} AS port_carry FROM {{0}}"
)
ROTATION, PC1_VAR = ["STABLE", "TRANSITION", "UNSTABLE"], ["MULTI_DIM", "ONE_DIM"]
STD_R = ["LOW_DISPERSION", "LOWMID_DISPERSION", "MID_DISPERSION", "HIGHMID_DISPERSION", "HIGH_DISPERSION"]
_M = {
    "pca_rotation_state": "CASE pca_rotation_state WHEN 'STABLE' THEN 0.8 WHEN 'TRANSITION' THEN 1.1 "
    "WHEN 'UNSTABLE' THEN 1.1 ELSE 1.0 END::DOUBLE",
    "pc1_var_state": "CASE pc1_var_state WHEN 'MULTI_DIM' THEN 1.15 WHEN 'ONE_DIM' THEN 0.75 ELSE 1.0 END::DOUBLE",
    "std_r_state": "CASE std_r_state WHEN 'LOW_DISPERSION' THEN 0.8 WHEN 'LOWMID_DISPERSION' THEN 0.9 "
    "WHEN 'MID_DISPERSION' THEN 1.0 WHEN 'HIGHMID_DISPERSION' THEN 1.1 WHEN 'HIGH_DISPERSION' THEN 1.2 "
    "ELSE 1.0 END::DOUBLE",
    "spot_state": "CASE spot_state WHEN 'LOW' THEN 0.7 WHEN 'HIGH' THEN 1.3 ELSE 1.0 END::DOUBLE",
}

for _x, _w, _cw in (("", "fixed", "fixed"), ("_h", "hedged_tradable", "hedged_standardised")):
    stage(f"positions{_x}", f"weighted {_w}", _LEGS.format(_w, "weighted"))
    stage(f"legs{_x}", f"positions{_x}", f"SELECT * FROM positions{_x} WHERE r_next IS NOT NULL")
    stage(f"attr{_x}", _cw, _ATTR.format(_cw))
    stage(
        f"xs{_x}",
        f"legs{_x}",
        f"""SELECT curve_id, tradingDay, count(*) AS n_legs, avg(r_next) AS mean_r, stddev_samp(r_next) AS std_r,
       min(r_next) AS min_r, max(r_next) AS max_r, max(abs(r_next)) AS max_abs_r FROM legs{_x} GROUP BY 1, 2""",
    )
    stage(
        f"pnl{_x}",
        f"legs{_x}",
        f"""SELECT *, lead(strategy_ret) {BY_DAY} AS forward_ret FROM (
  SELECT curve_id, tradingDay, sum(pnl_leg) AS strategy_ret FROM legs{_x} GROUP BY 1, 2)""",
    )
    # Signal tables: value and forward return on profit days.
    _SOURCES = {
        "carry": ("attr", "port_carry", "port_carry"),
        "d_carry": ("attr", "port_carry", f"port_carry - lag(port_carry) {BY_DAY}"),
        "carry_vol": (
            "attr",
            "port_carry",
            "CASE WHEN count(port_carry) OVER v = 21 THEN stddev_samp(port_carry) OVER v END",
        ),
        "front_slope": ("prices", PX[0], f"{PX[1]} - {PX[0]}"),
        "back_slope": ("prices", PX[0], f"{PX[5]} - {PX[0]}"),
        "curvature": ("prices", PX[0], f"{PX[0]} - 2.0 * {PX[2]} + {PX[5]}"),
        "spot": ("spot", "spot", "spot"),
        "d_spot": ("spot", "spot", f"spot - lag(spot) {BY_DAY}"),
        "rotation": ("diag", "pc1_var", "rotation"),
        "pc1_var": ("diag", "pc1_var", "pc1_var"),
        "std_r": ("xs", "std_r", "std_r"),
        "max_abs_r": ("xs", "max_abs_r", "max_abs_r"),
    }
    for _sig, (_src, _extra, _value) in _SOURCES.items():
        _from = _src + (_x if _src in ("attr", "xs") else "")
        stage(
            f"sig_{_sig}{_x}",
            f"pnl{_x} {_from}",
            f"""SELECT * FROM (
  SELECT p.curve_id, p.tradingDay, p.forward_ret, s.{_extra} AS extra, {_value} AS signal
  FROM pnl{_x} p LEFT JOIN (SELECT * FROM {_from}) s USING (curve_id, tradingDay)
  WINDOW v AS (PARTITION BY p.curve_id ORDER BY p.tradingDay ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))
WHERE signal IS NOT NULL AND forward_ret IS NOT NULL""".replace(
                BY_DAY, "OVER (PARTITION BY p.curve_id ORDER BY p.tradingDay)"
            ),
        )
    # States.
    stage(f"pca0{_x}", f"sig_rotation{_x}", f"SELECT curve_id, tradingDay, signal AS pca_rotation, extra AS pc1_var FROM sig_rotation{_x}")
    stage(f"pca1{_x}", f"pca0{_x}", labelled(f"pca0{_x}", "pca_rotation", ROTATION, "pca_rotation_state"))
    stage(f"st_pca{_x}", f"pca1{_x}", labelled(f"pca1{_x}", "pc1_var", PC1_VAR, "pc1_var_state"))
    stage(f"disp0{_x}", f"xs{_x}", f"SELECT curve_id, tradingDay, std_r, max_abs_r FROM xs{_x}")
    stage(f"disp1{_x}", f"disp0{_x}", labelled(f"disp0{_x}", "std_r", STD_R, "std_r_state"))
    stage(f"st_disp{_x}", f"disp1{_x}", labelled(f"disp1{_x}", "max_abs_r", ["NORMAL", "STRESSED", "SHOCK"], "max_abs_r_state"))
    stage(
        f"carry0{_x}",
        f"sig_carry_vol{_x}",
        f"SELECT curve_id, tradingDay, extra AS carry, signal AS carry_vol, extra - lag(extra) {BY_DAY} AS d_carry "
        f"FROM sig_carry_vol{_x}",
    )
    stage(f"carry1{_x}", f"carry0{_x}", labelled(f"carry0{_x}", "carry", ["LOW", "MID", "HIGH"], "carry_state"))
    stage(f"carry2{_x}", f"carry1{_x}", labelled(f"carry1{_x}", "d_carry", ["FALL", "FLAT", "RISE"], "d_carry_state"))
    stage(f"st_carry{_x}", f"carry2{_x}", labelled(f"carry2{_x}", "carry_vol", ["STABLE", "MIXED", "UNSTABLE"], "carry_vol_state"))
    stage(
        f"spot0{_x}",
        f"sig_spot{_x}",
        f"SELECT * FROM (SELECT curve_id, tradingDay, signal AS spot, signal - lag(signal) {BY_DAY} AS d_spot "
        f"FROM sig_spot{_x}) WHERE d_spot IS NOT NULL",
    )
    stage(f"spot1{_x}", f"spot0{_x}", labelled(f"spot0{_x}", "spot", ["LOW", "HIGH"], "spot_state"))
    stage(f"st_spot{_x}", f"spot1{_x}", labelled(f"spot1{_x}", "d_spot", ["DOWN", "FLAT", "UP"], "d_spot_state"))
    stage(
        f"matrix{_x}",
        f"st_pca{_x} st_disp{_x} st_carry{_x} st_spot{_x}",
        f"""SELECT * FROM st_pca{_x} JOIN st_disp{_x} USING (curve_id, tradingDay)
JOIN st_carry{_x} USING (curve_id, tradingDay) LEFT JOIN st_spot{_x} USING (curve_id, tradingDay)""",
    )
    stage(f"mult{_x}", f"matrix{_x}", "SELECT *, " + ", ".join(f"{v} AS m_{s}" for s, v in _M.items()) + f" FROM matrix{_x}")
    stage(
        f"sized_states{_x}",
        f"mult{_x}",
        f"SELECT *, greatest(0.0, least(2.0, raw_scale)) AS scale FROM (SELECT *, "
        f"{' * '.join(f'm_{s}' for s in _M)} AS raw_scale FROM mult{_x})",
    )
    _filled = list(_M) + ["raw_scale", "scale"]
    _all = [
        "pca_rotation", "pc1_var", "pc1_var_state", "std_r", "max_abs_r", "max_abs_r_state", "carry", "carry_vol",
        "d_carry", "carry_state", "d_carry_state", "carry_vol_state", "spot", "d_spot", "d_spot_state",
    ]
    stage(
        f"strat{_x}",
        f"pnl{_x} sized_states{_x}",
        f"SELECT *, forward_ret * scale AS sized_ret FROM (SELECT p.curve_id, p.tradingDay, strategy_ret, forward_ret, "
        + ", ".join(f"last_value({c} IGNORE NULLS) OVER u AS {c}" for c in dict.fromkeys(_filled + _all))
        + f" FROM pnl{_x} p LEFT JOIN sized_states{_x} s USING (curve_id, tradingDay) "
        "WINDOW u AS (PARTITION BY p.curve_id ORDER BY p.tradingDay ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
        "WHERE forward_ret IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in dict.fromkeys(_filled + _all)),
    )

_ATTR_OUT = ("port_total", "port_carry", "port_total - port_carry")
for _name, _stage, _digits in (("attribution", "attr", 9), ("attribution_with_pca", "attr_h", 6)):
    _cols = ", ".join(rd(e, n, _digits) for e, n in zip(_ATTR_OUT, ("port_total", "port_carry", "port_shock"), strict=True))
    answer(_name, _stage, f"SELECT {KEYS}, {_cols} FROM {_stage}")

answer(
    "contract_weight",
    "weighted fixed",
    f"""SELECT t.curve_id, {text('t.tradingDay', '"tradingDay"')}, symbol, {big('ttm_days', 'ttm_days')},
       {rd(' + '.join(f'{w} * weight_{t}d' for w, t in zip(W, TENORS, strict=True)), 'w_contract', 9)}
FROM weighted t JOIN fixed h ON h.curve_id = t.curve_id AND h.tradingDay = t.tradingDay""",
)
stage(
    "nexts",
    "term",
    """SELECT *, ln(close_next / close) AS r_next FROM (
  SELECT *, lead(close) OVER s AS close_next, lead(tradingDay) OVER s AS nextDay FROM term
  WINDOW s AS (PARTITION BY curve_id, symbol ORDER BY tradingDay)) WHERE close_next IS NOT NULL""",
)
answer(
    "next_return",
    "nexts",
    f"SELECT {KEYS}, symbol, {rd('close_next', 'close_next', 9)}, {rd('r_next', 'r_next', 9)}, "
    f"{text('nextDay', '\"nextDay\"')} FROM nexts",
)
_LEG_OUT = f"SELECT {KEYS}, symbol, {text('nextDay', '\"nextDay\"')}, " + ", ".join(
    rd(c, c, 9) for c in ("w_contract", "close", "close_next", "r_next", "pnl_leg")
)
for _name in ("legs", "legs_joined"):
    answer(_name, "legs", f"{_LEG_OUT}, {text('expiry', 'expiry')}, {big('ttm_days', 'ttm_days')} FROM legs")
for _name, _order, _n in (
    ("worst_legs", "r_next", 5),
    ("best_legs", "r_next DESC", 5),
    ("latest_expiry_legs", "expiry DESC", 20),
):
    answer(_name, "legs", f"{_LEG_OUT} FROM (SELECT * FROM legs ORDER BY {_order}, curve_id, tradingDay, symbol LIMIT {_n})")
answer(
    "leg_return_quantiles",
    "legs",
    f"SELECT curve_id, {rd(nearest('abs(r_next)', 0.999), 'p999')}, {rd('max(abs(r_next))', 'max')} FROM legs GROUP BY 1",
)
_XS = ("mean_r", "std_r", "min_r", "max_r", "max_abs_r")
answer("daily_xs", "xs", f"SELECT {KEYS}, n_legs, " + ", ".join(rd(c, c) for c in _XS) + " FROM xs")
answer(
    "shock_days",
    "xs",
    f"SELECT {KEYS}, n_legs, " + ", ".join(rd(c, c) for c in _XS) + " FROM xs WHERE max_abs_r > 3.0 OR std_r > 2.0",
)
answer(
    "xs_quantiles",
    "xs",
    f"SELECT curve_id, {rd(nearest('std_r', 0.99), 'std_r_p99')}, {rd(nearest('max_abs_r', 0.99), 'max_abs_r_p99')}, "
    f"{rd('max(max_abs_r)', 'max_abs_r_max')} FROM xs GROUP BY 1",
)
stage("symbols", "nexts", "SELECT curve_id, symbol, count(*) AS n, max(abs(r_next)) AS max_abs_r FROM nexts GROUP BY 1, 2")
answer(
    "symbol_extremes",
    "symbols",
    f"SELECT curve_id, symbol, n, {rd('max_abs_r', 'max_abs_r')} FROM symbols "
    "ORDER BY symbols.max_abs_r DESC, curve_id, symbol LIMIT 10",
)
answer(
    "symbol_series",
    "symbols nexts",
    f"""SELECT curve_id, symbol, {DAY}, {rd('r_next', 'r_next', 9)} FROM nexts JOIN (
  SELECT curve_id, symbol FROM (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY max_abs_r DESC, symbol) AS rn
  FROM symbols) WHERE rn = 1) USING (curve_id, symbol)""",
)
stage(
    "expo",
    "legs",
    "SELECT curve_id, tradingDay, sum(abs(w_contract)) AS gross_w, sum(w_contract) AS net_w, count(*) AS n_legs "
    "FROM legs GROUP BY 1, 2",
)
answer("exposure", "expo", f"SELECT {KEYS}, {rd('gross_w', 'gross_w', 9)}, {rd('net_w', 'net_w', 9)}, n_legs FROM expo")
answer(
    "exposure_summary",
    "expo",
    "SELECT curve_id, "
    + ", ".join(
        rd(e, n, 9)
        for e, n in (
            (nearest("gross_w", 0.01), "gross_p01"),
            ("median(gross_w)", "gross_med"),
            (nearest("gross_w", 0.99), "gross_p99"),
            ("max(gross_w)", "gross_max"),
            ("max(abs(net_w))", "net_abs_max"),
            ("avg(net_w)", "net_mean"),
            ("stddev_samp(net_w)", "net_std"),
        )
    )
    + " FROM expo GROUP BY 1",
)
stage(
    "positions_shifted",
    "weighted fixed",
    _LEGS.format("fixed", "(SELECT * REPLACE (close - 20000.0 AS close) FROM weighted)"),
)
for _name, _positions in (("leg_quality", "positions"), ("leg_quality_nonpositive", "positions_shifted")):
    answer(
        _name,
        _positions,
        f"""SELECT curve_id, count(r_next) AS n_legs,
       count(*) FILTER (WHERE NOT coalesce(close > 0 AND close_next > 0, false)) AS n_bad_rows,
       count(*) FILTER (WHERE r_next IS NULL) AS n_no_return,
       count(*) FILTER (WHERE tradingDay > expiry) AS n_after_expiry FROM {_positions} GROUP BY 1""",
    )
answer(
    "daily_pnl_nonpositive",
    "positions_shifted",
    f"SELECT {KEYS}, {rd('sum(pnl_leg)', 'strategy_ret')} FROM positions_shifted WHERE r_next IS NOT NULL GROUP BY ALL",
)
answer(
    "legs_per_day",
    "xs",
    f"SELECT curve_id, min(n_legs) AS min_legs, {rd('median(n_legs)', 'median_legs')}, max(n_legs) AS max_legs "
    "FROM xs GROUP BY 1",
)
answer("daily_pnl", "pnl", f"SELECT {KEYS}, {rd('strategy_ret', 'strategy_ret')} FROM pnl")
stage("pnl_m", "pnl", "SELECT *, avg(strategy_ret) OVER (PARTITION BY curve_id) AS m FROM pnl")
stage(
    "pnl_mom",
    "pnl_m",
    f"SELECT curve_id, count(*)::DOUBLE AS n, avg(strategy_ret) AS mean, stddev_samp(strategy_ret) AS sd, "
    f"{moments('strategy_ret', 'm')} FROM pnl_m GROUP BY 1",
)
answer(
    "pnl_moments",
    "pnl_mom",
    f"SELECT curve_id, {rd('mean', 'mean')}, {rd('sd', 'std')}, {rd('g1', 'skew')}, {rd('g2', 'kurt')} FROM pnl_mom",
)
answer(
    "moments_adj",
    "pnl",
    f"SELECT curve_id, {rd('skewness(strategy_ret)', 'skew')}, {rd('kurtosis(strategy_ret)', 'kurtosis')} FROM pnl GROUP BY 1",
)
_PERIOD = {
    "1d": "tradingDay",
    "1w": "CAST(date_trunc('week', tradingDay) AS DATE)",
    "2w": "DATE '1970-01-05' + CAST(14 * floor((tradingDay - DATE '1970-01-05') / 14.0) AS INTEGER)",
    "1mo": "CAST(date_trunc('month', tradingDay) AS DATE)",
}
for _name, _h in (("resample_week", "1w"), ("resample_2week", "2w"), ("resample_month", "1mo")):
    answer(
        _name,
        "pnl",
        f"SELECT curve_id, {text('period', 'period')}, {rd('ret', 'ret')} FROM ("
        f"SELECT curve_id, {_PERIOD[_h]} AS period, sum(strategy_ret) AS ret FROM pnl GROUP BY 1, 2)",
    )
stage(
    "horizons",
    "pnl",
    " UNION ALL ".join(
        f"SELECT curve_id, '{h}' AS horizon, {n} AS per_year, {_PERIOD[h]} AS period, sum(strategy_ret) AS ret "
        "FROM pnl GROUP BY 1, 2, 3, 4"
        for h, n in (("1d", 252), ("1w", 52), ("2w", 26), ("1mo", 12))
    ),
)
answer(
    "horizon_stats",
    "horizons",
    f"""SELECT curve_id, horizon, n_periods, {rd('mean', 'mean')}, {rd('sd', 'std')},
       {rd('mean / nullif(sd, 0) * sqrt(per_year)', 'sharpe')}, {rd('g1', 'skew')}, {rd('g2', 'kurtosis')},
       {rd('hit', 'hit_rate')} FROM (
  SELECT curve_id, horizon, any_value(per_year) AS per_year, count(*) AS n_periods, avg(ret) AS mean,
         stddev_samp(ret) AS sd, {moments('ret', 'm')}, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS hit
  FROM (SELECT *, avg(ret) OVER (PARTITION BY curve_id, horizon) AS m FROM horizons) GROUP BY 1, 2)""",
)

# -- drawdown ----------------------------------------------------------------

stage(
    "equity",
    "pnl",
    f"""SELECT *, equity / peak_equity - 1.0 AS drawdown FROM (
  SELECT *, max(equity) {UPTO} AS peak_equity FROM (
    SELECT *, exp(cum_log) AS equity FROM (
      SELECT curve_id, tradingDay, strategy_ret, sum(strategy_ret) {UPTO} AS cum_log FROM pnl)))""",
)
answer(
    "drawdown",
    "equity",
    f"SELECT {KEYS}, {rd('strategy_ret', 'strategy_ret')}, {rd('cum_log', 'cum_log')}, {sci('equity', 'equity')}, "
    f"{sci('peak_equity', 'peak_equity')}, {rd('drawdown', 'drawdown')} FROM equity",
)
answer(
    "drawdown_summary",
    "equity",
    f"SELECT curve_id, {rd('min(drawdown)', 'max_drawdown')}, {rd('avg(drawdown)', 'avg_drawdown')} FROM equity GROUP BY 1",
)
stage(
    "trough",
    "equity",
    """SELECT curve_id, tradingDay AS trough_day, peak_equity AS top FROM (
  SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY drawdown, tradingDay) AS rn FROM equity) WHERE rn = 1""",
)
stage(
    "peak",
    "trough equity",
    """SELECT curve_id, any_value(trough_day) AS trough_day, max(tradingDay) AS peak_day FROM equity JOIN trough USING (curve_id)
WHERE tradingDay <= trough_day AND equity = top GROUP BY 1""",
)
stage("episode", "peak equity", "SELECT * FROM equity JOIN peak USING (curve_id) WHERE tradingDay BETWEEN peak_day AND trough_day")
answer(
    "dd_episode",
    "episode",
    f"SELECT curve_id, {text('min(tradingDay)', 'peak_day')}, {text('max(tradingDay)', 'trough_day')}, "
    f"{rd('min(drawdown)', 'max_dd_in_window')}, count(*) AS n_days_in_window FROM episode GROUP BY 1",
)
answer(
    "dd_trough",
    "episode",
    f"SELECT {KEYS}, {sci('equity', 'equity')}, {sci('peak_equity', 'peak_equity')}, {rd('drawdown', 'drawdown')}, "
    f"{text('peak_day', 'peak_day')} FROM episode WHERE tradingDay = trough_day",
)
stage(
    "losses",
    "episode",
    """SELECT *, cum_loss / total_loss AS pct FROM (SELECT *, -strategy_ret AS loss_mag,
  sum(-strategy_ret) OVER (PARTITION BY curve_id ORDER BY -strategy_ret DESC, tradingDay
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_loss,
  sum(-strategy_ret) OVER (PARTITION BY curve_id) AS total_loss FROM episode WHERE strategy_ret < 0)""",
)
answer(
    "loss_days",
    "losses",
    f"SELECT {KEYS}, {rd('strategy_ret', 'strategy_ret')}, {rd('loss_mag', 'loss_mag')}, {rd('cum_loss', 'cum_loss')}, "
    f"{rd('pct', 'pct_of_loss')} FROM losses WHERE pct <= 0.80",
)
answer(
    "loss_concentration",
    "losses",
    f"""SELECT curve_id, n_days, {rd('captured', 'loss_captured')}, {rd('total', 'total_loss')},
       {rd('captured / total', 'pct_captured')} FROM (
  SELECT curve_id, count(*) FILTER (WHERE pct <= 0.80) AS n_days,
         coalesce(sum(loss_mag) FILTER (WHERE pct <= 0.80), 0.0) AS captured, max(total_loss) AS total
  FROM losses GROUP BY 1)""",
)
stage(
    "regime",
    "prices spot",
    f"SELECT curve_id, tradingDay, spot, {PX[5]} - {PX[0]} AS slope FROM prices LEFT JOIN spot USING (curve_id, tradingDay)",
)
_REGIME = ", ".join(
    rd(f"{f}({c})", f"{n}_{c}", 4)
    for c, fs in (
        ("spot", (("avg", "avg"), ("median", "med"), ("min", "min"), ("max", "max"))),
        ("slope", (("avg", "avg"), ("median", "med"))),
    )
    for f, n in fs
)
answer(
    "loss_regime",
    "regime losses pnl",
    f"""SELECT curve_id, sample, {_REGIME} FROM (
  SELECT curve_id, 'loss_days' AS sample, spot, slope
  FROM (SELECT curve_id, tradingDay FROM losses WHERE pct <= 0.80) LEFT JOIN regime USING (curve_id, tradingDay)
  UNION ALL
  SELECT curve_id, 'all_days', spot, slope FROM pnl JOIN regime USING (curve_id, tradingDay)) GROUP BY 1, 2""",
)

# -- quantiles ---------------------------------------------------------------

DECILES = [f"D{i + 1}" for i in range(10)]
_NAMES10 = ", ".join(f"'{d}'" for d in DECILES)


def bucketed(source: str, column: str) -> str:
    return (
        f"SELECT *, ([{_NAMES10}])[bucket] AS label FROM (SELECT s.*, {bucket(column)} AS bucket FROM {source} s "
        f"JOIN (SELECT curve_id, {cuts(column, 10)} AS cut FROM {source} GROUP BY 1) USING (curve_id))"
    )


answer("qcut", "ret", f"SELECT {KEYS}, {big('bucket', 'bucket')}, label FROM ({bucketed('ret', R[0])})")
answer(
    "qcut_empty",
    "xs",
    f"SELECT curve_id, 10 - count(DISTINCT bucket) AS n_empty FROM ({bucketed('xs', 'n_legs')}) GROUP BY 1",
)
answer(
    "nearest_quantile",
    "",
    "SELECT event_type AS file_path, "
    + ", ".join(
        rd(nearest("value", q), n)
        for n, q in (("p01", 0.01), ("p05", 0.05), ("p50", 0.5), ("p95", 0.95), ("p999", 0.999), ("top", 1.0))
    )
    + " FROM events GROUP BY 1",
)
answer(
    "nearest_quantile_all",
    "",
    f"SELECT {rd(nearest('l_extendedprice', 0.25), 'p25')}, {rd(nearest('l_extendedprice', 0.99), 'p99')} FROM lineitem",
)
_HIST = """SELECT curve_id, CAST(least(50, coalesce(floor((x - lo) / nullif((hi - lo) / 50.0, 0)), 0) + 1) AS BIGINT) AS bin,
       count(*) AS n FROM (SELECT curve_id, {1} AS x, min({1}) OVER (PARTITION BY curve_id) AS lo,
       max({1}) OVER (PARTITION BY curve_id) AS hi FROM {0}) GROUP BY 1, 2"""
answer("histogram", "term", _HIST.format("term", "close"))
answer("scale_histogram", "sized_states_h", _HIST.format("sized_states_h", "scale"))

# -- signals -----------------------------------------------------------------


def study(signal: str) -> str:
    return f"""SELECT curve_id, {big('bucket', 'bucket')}, label, n_days, {rd('mean', 'mean_daily')}, {rd('sd', 'std_daily')},
       {rd('p05', 'p05')}, {rd('p01', 'p01')}, {rd('mean / nullif(sd, 0) * sqrt(252.0)', 'sharpe_ann')},
       {rd('mean * 252', 'mean_ann')} FROM (
  SELECT curve_id, bucket, label, count(*) AS n_days, avg(forward_ret) AS mean, stddev_samp(forward_ret) AS sd,
         {nearest('forward_ret', 0.05)} AS p05, {nearest('forward_ret', 0.01)} AS p01
  FROM ({bucketed(f'sig_{signal}', 'signal')}) GROUP BY 1, 2, 3)"""


for _sig in _SOURCES:
    answer(f"signal_{_sig}", f"sig_{_sig}", study(_sig))
answer(
    "signal_studies",
    " ".join(f"sig_{_sig}" for _sig in _SOURCES),
    " UNION ALL ".join(f"SELECT *, '{_sig}' AS signal FROM ({study(_sig)})" for _sig in _SOURCES),
)
stage(
    "vt",
    "pnl",
    """SELECT *, strategy_ret * scale AS vt FROM (
  SELECT *, coalesce(0.16 / sqrt(252.0) / nullif(rv, 0), 0.0) AS scale FROM (
    SELECT curve_id, tradingDay, strategy_ret, CASE WHEN count(strategy_ret) OVER v >= 10 THEN stddev_samp(strategy_ret) OVER v END AS rv
    FROM pnl WINDOW v AS (PARTITION BY curve_id ORDER BY tradingDay ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)))""",
)
answer(
    "vol_target",
    "vt",
    f"SELECT {KEYS}, {rd('strategy_ret', 'strategy_ret')}, {rd('rv', 'rv_daily')}, {rd('scale', 'scale')}, "
    f"{rd('vt', 'strategy_ret_vt')} FROM vt",
)
answer(
    "vol_target_summary",
    "vt",
    f"""SELECT curve_id, {rd('stddev_samp(vt) * sqrt(252.0)', 'realized_vol_ann_vt')},
       {rd('avg(vt) * 252', 'annualized_mean_ret_vt')}, {rd('stddev_samp(strategy_ret) * sqrt(252.0)', 'realized_vol_ann')},
       {rd('avg(strategy_ret) * 252', 'annualized_mean_ret')}, {rd('avg(scale)', 'avg_scale')},
       {rd('max(scale)', 'max_scale')} FROM vt GROUP BY 1""",
)

# -- sizing ------------------------------------------------------------------

_DISP = f"{rd('std_r', 'std_r')}, {rd('max_abs_r', 'max_abs_r')}, std_r_state, max_abs_r_state"
answer("states_dispersion", "st_disp", f"SELECT {KEYS}, {_DISP} FROM st_disp")
answer(
    "states_carry",
    "st_carry",
    f"SELECT {KEYS}, {rd('carry', 'carry', 9)}, {rd('carry_vol', 'carry_vol', 9)}, {rd('d_carry', 'd_carry', 9)}, "
    "carry_state, d_carry_state, carry_vol_state FROM st_carry",
)
answer(
    "states_spot",
    "st_spot",
    f"SELECT {KEYS}, {rd('spot', 'spot')}, {rd('d_spot', 'd_spot')}, spot_state, d_spot_state FROM st_spot",
)
answer(
    "states_pca",
    "st_pca",
    f"SELECT {KEYS}, {rd('pca_rotation', 'pca_rotation', 5)}, {rd('pc1_var', 'pc1_var', 5)}, "
    "pca_rotation_state, pc1_var_state FROM st_pca",
)
_NUMBERS = ("pca_rotation", "pc1_var", "std_r", "max_abs_r", "carry", "carry_vol", "d_carry", "spot", "d_spot")
answer(
    "state_matrix",
    "matrix",
    f"SELECT {KEYS}, " + ", ".join(f"{rd(c, c, 5)}, {c}_state" for c in _NUMBERS) + " FROM matrix",
)
answer(
    "state_counts",
    "matrix",
    " UNION ALL ".join(
        f"SELECT curve_id, '{s}' AS signal, {s} AS state, count(*) AS n_days FROM matrix GROUP BY 1, 2, 3"
        for s in ("pca_rotation_state", "pc1_var_state", "std_r_state", "max_abs_r_state", "spot_state", "d_spot_state")
    ),
)
answer("multipliers", "mult", f"SELECT {KEYS}, " + ", ".join(rd(f"m_{s}", f"m_{s}") for s in _M) + " FROM mult")
answer("scale", "sized_states", f"SELECT {KEYS}, {rd('raw_scale', 'raw_scale')}, {rd('scale', 'scale')} FROM sized_states")
answer(
    "scale_summary",
    "sized_states",
    f"SELECT curve_id, {rd('avg(scale)', 'avg_scale')}, {rd(nearest('scale', 0.5), 'med_scale')}, "
    f"{rd(nearest('scale', 0.95), 'p95_scale')}, {rd('max(scale)', 'max_scale')} FROM sized_states GROUP BY 1",
)
answer("boost", "sized_states", f"SELECT curve_id, {rd('1.25 / avg(raw_scale)', 'boost')} FROM sized_states GROUP BY 1")
answer(
    "calibrated_scale",
    "sized_states",
    f"""SELECT {KEYS}, {rd('boost', 'boost')}, {rd('boost * raw', 'raw_scale')},
       {rd('greatest(0.0, least(2.0, boost * raw))', 'scale')} FROM (
  SELECT curve_id, tradingDay, raw_scale AS raw, 1.25 / avg(raw_scale) OVER (PARTITION BY curve_id) AS boost
  FROM sized_states)""",
)
_RET = [rd(c, c) for c in ("strategy_ret", "forward_ret", "scale", "sized_ret")]
answer("sized", "strat", f"SELECT {KEYS}, {', '.join(_RET)}, {rd('raw_scale', 'raw_scale')}, {', '.join(_M)} FROM strat")
answer("sized_with_pca", "strat_h", f"SELECT {KEYS}, {', '.join(_RET)} FROM strat_h")

# -- report ------------------------------------------------------------------

stage(
    "compound",
    "strat",
    f"""SELECT *, equity / peak - 1.0 AS drawdown FROM (SELECT *, max(equity) {UPTO} AS peak FROM (
  SELECT curve_id, tradingDay, sized_ret, product(1.0 + sized_ret) {UPTO} AS equity FROM strat))""",
)
answer(
    "equity",
    "compound",
    f"SELECT {KEYS}, {rd('sized_ret', 'sized_ret')}, {sci('equity', 'equity')}, {sci('peak', 'peak')}, "
    f"{sci('drawdown', 'drawdown')} FROM compound",
)
stage(
    "yearly",
    "strat",
    "SELECT curve_id, year(tradingDay) AS y, avg(sized_ret) AS mean, stddev_samp(sized_ret) AS sd, count(sized_ret) AS n, "
    "avg(sized_ret) / nullif(stddev_samp(sized_ret), 0) * sqrt(252.0) AS sharpe, "
    "avg(forward_ret) / nullif(stddev_samp(forward_ret), 0) * sqrt(252.0) AS plain FROM strat GROUP BY 1, 2",
)
answer(
    "annual",
    "yearly",
    f"""SELECT curve_id, {big('y', 'year')}, {rd('mean', 'mean')}, {rd('sd', 'std')}, n AS "count", {rd('sharpe', 'sharpe')},
       {rd('avg(sharpe) OVER (PARTITION BY curve_id)', 'mean_sharpe')} FROM yearly""",
)
answer(
    "annual_sharpe_comparison",
    "yearly",
    f"SELECT curve_id, {big('y', 'year')}, {rd('plain', 'unscaled')}, {rd('sharpe', 'state_scaled')} FROM yearly",
)
_MEASURES = {
    "mean_annualized_return": "avg(sized_ret) * 252",
    "annualized_volatility": "stddev_samp(sized_ret) * sqrt(252.0)",
    "sharpe_ratio": "avg(sized_ret) / stddev_samp(sized_ret) * sqrt(252.0)",
    "win_rate": "avg(CASE WHEN sized_ret > 0 THEN 1.0 ELSE 0.0 END)",
    "average_win": "avg(sized_ret) FILTER (WHERE sized_ret > 0)",
    "average_loss": "avg(sized_ret) FILTER (WHERE sized_ret < 0)",
    "pct_win": "avg(CASE WHEN sized_ret > 0 THEN 1.0 ELSE 0.0 END) * 100",
    "skewness": "skewness(sized_ret)",
    "kurtosis": "kurtosis(sized_ret)",
    "max_drawdown": "min(drawdown)",
    "downside_vol_ann": "stddev_samp(sized_ret) FILTER (WHERE sized_ret < 0) * sqrt(252.0)",
    "sortino_ratio": "avg(sized_ret) / (stddev_samp(sized_ret) FILTER (WHERE sized_ret < 0)) * sqrt(252.0)",
}
answer(
    "summary",
    "compound",
    " UNION ALL ".join(
        f"SELECT curve_id, '{n}' AS measure, {sci(e, 'value')} FROM compound GROUP BY 1" for n, e in _MEASURES.items()
    ),
)
answer(
    "scaled_vs_unscaled",
    "strat",
    f"""SELECT {KEYS}, {rd('forward_ret', 'forward_ret')}, {rd('sized_ret', 'sized_ret')},
       {sci('eu', 'equity_unscaled')}, {sci('es', 'equity_scaled')} FROM (
  SELECT *, product(1.0 + forward_ret) {UPTO} AS eu, product(1.0 + sized_ret) {UPTO} AS es FROM strat)""",
)
stage(
    "by_state",
    "strat",
    " UNION ALL ".join(
        f"SELECT curve_id, '{s}' AS signal, {s} AS state, count(sized_ret) AS n, avg(sized_ret) AS mean, "
        f"stddev_samp(sized_ret) AS sd, sum(sized_ret) AS total FROM strat WHERE {s} IS NOT NULL GROUP BY 1, 2, 3"
        for s in _M
    ),
)
answer(
    "pnl_by_state",
    "by_state",
    f"""SELECT curve_id, signal, state, n AS n_days, {rd('mean', 'mean_daily')}, {rd('sd', 'vol_daily')},
       {rd('total', 'total_pnl')}, {rd('mean / nullif(sd, 0) * sqrt(252.0)', 'sharpe')},
       {rd('total / sum(total) OVER (PARTITION BY curve_id, signal)', 'pct_total_pnl')} FROM by_state""",
)


def oracle_sql() -> dict[str, str]:
    return dict(_QUERIES)
