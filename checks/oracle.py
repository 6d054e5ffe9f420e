"""SQL (DuckDB dialect) that recomputes the registered queries from the same tables.

The texts are built from column lists, but share no code with the operators they check.
"""

from __future__ import annotations

from collections.abc import Sequence

from checks import catalog as cat
from panelwright.operators.lags import OFFSETS
from panelwright.plans import supplier as sup
from panelwright.plans.supplier import SUPPLIER
from panelwright.sources.standin import (
    DISCOUNTS,
    QUANTITY_BANDS,
    SEGMENT_COUNTS,
    SEGMENTS,
    STATUSES,
)

Z975 = 1.959963984540054


def _list(items) -> str:
    return ", ".join(items)


def _round(expr: str, name: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0 AS {name}"


# Panels ------------------------------------------------------------------------------------

NATION = f"""
monthly AS (
  SELECT c_nationkey AS entity_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
         count(*) AS cases, count(*) FILTER (WHERE o_orderstatus = 'F') AS deaths
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
residents AS (
  SELECT c_nationkey AS entity_id, count(*) AS pop,
    {_list(f"count(*) FILTER (WHERE c_mktsegment = '{s}') AS {c}"
           for s, c in zip(SEGMENTS, SEGMENT_COUNTS))}
  FROM customer GROUP BY 1),
nation_panel AS (SELECT * FROM monthly JOIN residents USING (entity_id))"""

_COUNTS = [
    f"count(*) FILTER (WHERE l_linestatus = '{s}' AND l_quantity >= {lo} AND l_quantity < {hi + 1})"
    f" AS {s}_q{lo:02d}_{hi:02d}"
    for s in STATUSES
    for lo, hi in QUANTITY_BANDS
] + [
    f"count(*) FILTER (WHERE round(l_discount * 100) = {d}) AS disc_{d:02d}" for d in DISCOUNTS
]

SUPPLIERS = f"""
monthly AS (
  SELECT l_suppkey AS entity_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds,
         count(*) AS cases, count(*) FILTER (WHERE l_returnflag = 'R') AS deaths
  FROM lineitem GROUP BY 1, 2),
totals AS (
  SELECT l_suppkey AS entity_id, count(*) AS pop, {_list(_COUNTS)} FROM lineitem GROUP BY 1),
wide AS (
  SELECT m.entity_id, m.ds, s_name AS entity_name, m.cases, m.deaths,
         s_acctbal AS acctbal, s_nationkey AS nation_id, t.* EXCLUDE (entity_id)
  FROM monthly m JOIN totals t ON m.entity_id = t.entity_id
  JOIN supplier ON m.entity_id = s_suppkey),
filtered AS (SELECT * FROM wide WHERE acctbal > 0 AND deaths > 0)"""

SERIES = """
series AS (
  SELECT event_type AS entity_id, CAST(ts AS DATE) AS ds, count(*) AS y
  FROM events GROUP BY 1, 2)"""

TRAIN = f"{SERIES},\ntrain AS (SELECT * FROM series WHERE ds <= DATE '{cat.CUTOFF}')"

_OVER = "OVER (PARTITION BY entity_id ORDER BY ds)"


def _lag(name: str, expr: str, offsets: Sequence[int] = OFFSETS) -> list[str]:
    return [f"lag({expr}, {k}) {_OVER} AS {name}_{k}" for k in offsets]


def _ln(expr: str) -> str:
    return f"round(ln(nullif({expr}, 0)))"


def _ratio(num: str, den: str) -> str:
    return f"({num})::DOUBLE / nullif({den}, 0)"


_RATIOS = [
    f"{_ratio('cases', 'pop')} AS CC_PER_CAPITA",
    f"{_ratio('deaths', 'pop')} AS D_PER_CAPITA",
    f"{_ratio('deaths', 'cases')} AS D_PER_CC",
]
_LOG_BALANCE = "round(ln(CASE WHEN acctbal > 0 THEN acctbal END)) AS log_acctbal"
_BANDS = [
    " + ".join(_ratio(c, "pop") for c in fine) + f" AS {band}"
    for band, fine in SUPPLIER.bands.items()
]


def _shares(names: Sequence[str]) -> list[str]:
    return [f"{_ratio(SUPPLIER.shares[n], 'pop')} AS {n}" for n in names]


PANEL_LOG = f"""{SUPPLIERS},
panel AS (
  SELECT entity_id, ds, entity_name, {_ln('cases')} AS log_cases, {_ln('deaths')} AS log_deaths,
    {_ln('pop')} AS log_pop, {_list(_RATIOS)}, {_LOG_BALANCE}, acctbal,
    {_list(_lag('CCT', _ln('cases')))}, {_list(_lag('DT', 'deaths'))},
    {_list(_BANDS)}, {_list(_shares(SUPPLIER.shares))}, cases AS y
  FROM filtered)"""

PANEL_PERCAPITA = f"""{SUPPLIERS},
panel AS (
  SELECT entity_id, ds, entity_name, cases, deaths, pop, {_list(_RATIOS)}, {_LOG_BALANCE},
    acctbal, nation_id, {_list(_lag('CCT', _ratio('cases', 'pop')))},
    {_list(_lag('DT', _ratio('deaths', 'pop')))},
    {_list(_BANDS)}, {_list(_shares(SUPPLIER.percapita_shares))}, cases AS y
  FROM filtered)"""

_LOG_EXACT = ("entity_id", "ds", "entity_name", *SUPPLIER.lags_of("DT"), "y")
_LOG_DOUBLE = tuple(
    c for c in dict.fromkeys((*sup.SCALED, *sup.STATIC_TERMS)) if c not in _LOG_EXACT
)
_PC_EXACT = ("entity_id", "ds", "entity_name", "cases", "deaths", "pop", "nation_id", "y")
_PC_DOUBLE = (
    *SUPPLIER.ratios, "log_acctbal", "acctbal", *SUPPLIER.lags_of("CCT"),
    *SUPPLIER.lags_of("DT"), *SUPPLIER.bands, *SUPPLIER.percapita_shares,
)


def _project(ctes: str, exact: Sequence[str], doubles: Sequence[str], table: str = "panel"):
    return f"WITH {ctes}\nSELECT {_list([*exact, *doubles])} FROM {table}"


# Descriptions ------------------------------------------------------------------------------


def _describe(ctes: str, table: str, cols: Sequence[str]) -> str:
    parts = [
        f"""SELECT '{c}' AS variable, count({c}) AS count, {_round(f'avg({c})', 'mean')},
        {_round(f'stddev_samp({c})', 'std')}, {_round(f'min({c})::DOUBLE', 'min')},
        {_round(f'quantile_cont({c}::DOUBLE, 0.25)', 'p25')},
        {_round(f'quantile_cont({c}::DOUBLE, 0.5)', 'p50')},
        {_round(f'quantile_cont({c}::DOUBLE, 0.75)', 'p75')},
        {_round(f'max({c})::DOUBLE', 'max')} FROM {table}"""
        for c in cols
    ]
    return f"WITH {ctes}\n" + "\nUNION ALL ".join(parts)


def _skew_report() -> str:
    parts = [
        f"""SELECT '{c}' AS variable,
        {_round('avg(pow(d, 3)) / nullif(pow(avg(d * d), 1.5), 0)', 'skew')},
        {_round('quantile_cont(x, 0.75) / nullif(max(x), 0)', 'p75_over_max')},
        {_round('avg(x) / nullif(quantile_cont(x, 0.5), 0)', 'mean_over_p50')}
        FROM (SELECT {c}::DOUBLE AS x, {c} - avg({c}) OVER () AS d FROM logged)"""
        for c in cat.SKEWED
    ]
    return f"""WITH {SUPPLIERS},
logged AS (SELECT cases, deaths, {_ln('cases')} AS log_cases, {_ln('deaths')} AS log_deaths
           FROM filtered)
""" + "\nUNION ALL ".join(parts)


def _minmax(cols: Sequence[str]) -> str:
    return _list(f"min({c})::DOUBLE AS {c}_min, max({c})::DOUBLE AS {c}_max" for c in cols)


def _scaled_cte(cols: Sequence[str], keep: Sequence[str]) -> str:
    scaled = [
        f"CASE WHEN {c} IS NOT NULL THEN "
        f"coalesce(({c} - {c}_min)::DOUBLE / nullif({c}_max - {c}_min, 0), 0) END AS {c}"
        for c in cols
    ]
    return f"""params AS (SELECT {_minmax(cols)} FROM panel),
scaled AS (SELECT {_list([*keep, *scaled])} FROM panel, params)"""


# Correlation -------------------------------------------------------------------------------


def _corr(ctes: str, cols: Sequence[str], targets: Sequence[str], table: str = "panel") -> str:
    cells = [
        f"{{'var_x': '{x}', 'var_y': '{y}', 'n': count(*) FILTER "
        f"(WHERE {x} IS NOT NULL AND {y} IS NOT NULL), 'r': corr({x}::DOUBLE, {y}::DOUBLE)}}"
        for x in cols
        for y in targets
    ]
    return f"""WITH {ctes},
cells AS (SELECT unnest([{_list(cells)}], recursive := true) FROM {table})
SELECT var_x, var_y, n, {_round('CASE WHEN NOT isnan(r) THEN r END', 'r')} FROM cells"""


# Regression --------------------------------------------------------------------------------


def _ols_ctes(table: str, y: str, xs: Sequence[str], keys: Sequence[str] = ("entity_id", "ds")):
    """Sweep operator on the correlation-scaled cross products of the complete rows.

    After the sweep of the K predictors, ``a`` holds minus the inverse in its K x K block, the
    slopes in the last column and the residual sum of squares in its corner. A predictor with
    nothing left after the ones before it is skipped and gets the slope 0.
    """
    k = len(xs)
    cols = [*xs, y]
    not_null = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    z = [
        f"CASE WHEN s{i} > 1e-12 THEN (x{i} - m{i}) / s{i} ELSE 0 END AS z{i}"
        for i in range(1, k + 2)
    ]
    gram = _list(
        "[" + _list(f"sum(z{i} * z{j})" for j in range(1, k + 2)) + "]" for i in range(1, k + 2)
    )
    rows = [f"{c}::DOUBLE AS x{i}" for i, c in enumerate(cols, 1)]
    each = f"range(1, {k + 1})"
    return f"""complete AS (SELECT {_list([*keys, *rows])} FROM {table} WHERE {not_null}),
stats AS (SELECT count(*) AS n, {_list(f"avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}"
                                       for i in range(1, k + 2))} FROM complete),
z AS (SELECT {_list(z)} FROM complete, stats),
gram AS (SELECT [{gram}] AS a FROM z),
sweep AS (
  SELECT 1 AS k, a, []::BIGINT[] AS used FROM gram
  UNION ALL
  SELECT k + 1,
    CASE WHEN a[k][k] > 1e-9 * n THEN
      list_transform(range(1, {k + 2}), lambda i: list_transform(range(1, {k + 2}), lambda j:
        CASE WHEN i = k AND j = k THEN -1 / a[k][k]
             WHEN i = k THEN a[k][j] / a[k][k]
             WHEN j = k THEN a[i][k] / a[k][k]
             ELSE a[i][j] - a[i][k] * a[k][j] / a[k][k] END))
    ELSE a END,
    CASE WHEN a[k][k] > 1e-9 * n THEN list_append(used, k) ELSE used END
  FROM sweep, stats WHERE k <= {k}),
solved AS (
  SELECT a, used, n, len(used) + 1 AS rank, n - len(used) - 1 AS df, m{k + 1} AS my,
    s{k + 1} AS sy, s{k + 1} * s{k + 1} * n AS tss,
    [{_list(f"m{i}" for i in range(1, k + 1))}] AS m,
    [{_list(f"s{i}" for i in range(1, k + 1))}] AS s
  FROM sweep, stats WHERE k = {k + 1}),
slopes AS (
  SELECT *, list_transform({each}, lambda i:
      CASE WHEN list_contains(used, i) THEN a[i][{k + 1}] * sy / s[i] ELSE 0 END) AS b,
    list_transform({each}, lambda i: list_transform({each}, lambda j:
      CASE WHEN list_contains(used, i) AND list_contains(used, j)
           THEN -a[i][j] / (s[i] * s[j]) ELSE 0 END)) AS v
  FROM solved),
model AS (
  SELECT *, my - list_sum(list_transform({each}, lambda i: b[i] * m[i])) AS b0,
    1.0 / n + list_sum(list_transform({each}, lambda i:
      list_sum(list_transform({each}, lambda j: m[i] * m[j] * v[i][j])))) AS v0
  FROM slopes),
residuals AS (
  SELECT {_list([*keys, f"x{k + 1} - b0 - (" + " + ".join(f"b[{i}] * x{i}" for i in range(1, k + 1)) + ") AS e"])}
  FROM complete, model),
rss AS (SELECT sum(e * e) AS rss FROM residuals)"""


def _coef(ctes: str, table: str, y: str, xs: Sequence[str], columns) -> str:
    """Coefficient table. The t tail is integrated by Simpson's rule after t = sqrt(df) tan(u);
    the t quantile is the Cornish-Fisher series, exact to double precision for large df."""
    names = _list(f"'{x}'" for x in xs)
    places = columns if isinstance(columns, dict) else {c: 6 if c in ("t", "p") else 8 for c in columns}
    steps = 4000
    z = Z975
    return f"""WITH RECURSIVE {ctes},
{_ols_ctes(table, y, xs)},
terms AS (
  SELECT unnest(list_concat(['Intercept'], [{names}])) AS term,
    unnest(list_concat([b0], b)) AS coef,
    unnest(list_concat([v0], list_transform(range(1, {len(xs) + 1}), lambda i: v[i][i]))) AS v,
    rss / df AS sigma2, df
  FROM model, rss),
errors AS (SELECT term, coef, sqrt(sigma2 * v) AS se, df::DOUBLE AS d FROM terms),
tails AS (
  SELECT *, coef / nullif(se, 0) AS t, atan(abs(coef / nullif(se, 0)) / sqrt(d)) AS u0,
    least((pi() / 2 - atan(abs(coef / nullif(se, 0)) / sqrt(d))), 40 / sqrt(d)) / {steps} AS h
  FROM errors),
tested AS (
  SELECT *, 2 * exp(lgamma((d + 1) / 2) - lgamma(d / 2)) / sqrt(pi()) * h / 3
    * list_sum(list_transform(range(0, {steps + 1}), lambda i:
        CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
        * pow(abs(cos(u0 + i * h)), d - 1))) AS p,
    {z} + ({z**3 + z}) / (4 * d) + ({5 * z**5 + 16 * z**3 + 3 * z}) / (96 * d * d)
    + ({3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z}) / (384 * d * d * d) AS q
  FROM tails),
table_ AS (SELECT term, coef, se, t, p, CASE WHEN t IS NOT NULL THEN coef - q * se END AS lo,
                  CASE WHEN t IS NOT NULL THEN coef + q * se END AS hi FROM tested)
SELECT term, {_list(_round(c, c, places[c]) for c in columns)} FROM table_"""


def _fit(
    ctes: str, table: str, y: str, xs: Sequence[str], columns: Sequence[str], places: int = 6
) -> str:
    """Fit row; the omnibus statistic from the D'Agostino skewness and Anscombe-Glynn
    kurtosis tests."""
    exact = ("y", "n", "rank", "df_model", "df_resid")
    cols = [c if c in exact else _round(c, c, places) for c in columns]
    return f"""WITH RECURSIVE {ctes},
{_ols_ctes(table, y, xs)},
steps AS (SELECT e, e - lag(e) OVER (PARTITION BY entity_id ORDER BY ds) AS step FROM residuals),
shape AS (
  SELECT avg(pow(e, 3)) / pow(avg(e * e), 1.5) AS skew,
    avg(pow(e, 4)) / pow(avg(e * e), 2) AS kurtosis, sum(step * step) AS successive FROM steps),
basic AS (
  SELECT '{y}' AS y, n, rank::INTEGER AS rank, (rank - 1)::INTEGER AS df_model, df AS df_resid,
    rss, tss, 1 - rss / tss AS r2, 1 - rss / tss * (n - 1) / df AS adj_r2, rss / df AS sigma2,
    -n / 2.0 * (ln(2 * pi()) + ln(rss / n) + 1) AS llf, skew, kurtosis,
    successive / rss AS durbin_watson, n::DOUBLE AS f_n,
    model.m AS m, model.s AS s
  FROM model, rss, shape),
s1 AS (
  SELECT *, CASE WHEN df_model > 0 THEN (tss - rss) / df_model / sigma2 END AS f,
    -2 * llf + 2 * rank AS aic, -2 * llf + ln(f_n) * rank AS bic,
    f_n / 6 * (skew * skew + pow(kurtosis - 3, 2) / 4) AS jarque_bera,
    skew * sqrt((f_n + 1) * (f_n + 3) / (6 * (f_n - 2))) AS sy,
    sqrt(2 * (3 * (f_n * f_n + 27 * f_n - 70) * (f_n + 1) * (f_n + 3)
      / ((f_n - 2) * (f_n + 5) * (f_n + 7) * (f_n + 9)) - 1)) - 1 AS w2,
    (kurtosis - 3 * (f_n - 1) / (f_n + 1)) / sqrt(24 * f_n * (f_n - 2) * (f_n - 3)
      / (pow(f_n + 1, 2) * (f_n + 3) * (f_n + 5))) AS kx,
    6 * (f_n * f_n - 5 * f_n + 2) / ((f_n + 7) * (f_n + 9))
      * sqrt(6 * (f_n + 3) * (f_n + 5) / (f_n * (f_n - 2) * (f_n - 3))) AS kr
  FROM basic),
s2 AS (SELECT *, 6 + 8 / kr * (2 / kr + sqrt(1 + 4 / (kr * kr))) AS ka FROM s1),
s3 AS (SELECT *, 1 + kx * sqrt(2 / (ka - 4)) AS kd FROM s2),
s4 AS (
  SELECT *, pow(asinh(sy / sqrt(2 / (w2 - 1))) / sqrt(ln(w2) / 2), 2)
    + pow((1 - 2 / (9 * ka) - sign(kd) * pow((1 - 2 / ka) / abs(kd), 1.0 / 3))
      / sqrt(2 / (9 * ka)), 2) AS omnibus
  FROM s3),
s5 AS (SELECT *, exp(-omnibus / 2) AS omnibus_p, exp(-jarque_bera / 2) AS jarque_bera_p FROM s4)
SELECT {_list(cols)} FROM s5"""


def _fit_one_predictor() -> str:
    """The whole fit row: with one predictor F is t squared, so its tail is the t tail, and the
    singular values of the design follow from a 2 x 2 matrix."""
    y, xs = cat.SIMPLE_OLS
    base = _fit(PANEL_PERCAPITA, "panel", y, xs, cat.FIT_CHECKED)
    head, _, _ = base.rpartition("\nSELECT ")
    steps = 4000
    cols = [
        c if c in ("y", "n", "rank", "df_model", "df_resid") else _round(c, c)
        for c in (*cat.FIT_CHECKED, "f_p", "condition_number")
    ]
    return f"""{head},
s6 AS (
  SELECT *, atan(sqrt(f) / sqrt(df_resid)) AS u0, df_resid::DOUBLE AS d,
    least(pi() / 2 - atan(sqrt(f) / sqrt(df_resid)), 40 / sqrt(df_resid)) / {steps} AS h,
    f_n AS g00, f_n * m[1] AS g01, f_n * (m[1] * m[1] + s[1] * s[1]) AS g11 FROM s5),
s7 AS (
  SELECT *, 2 * exp(lgamma((d + 1) / 2) - lgamma(d / 2)) / sqrt(pi()) * h / 3
    * list_sum(list_transform(range(0, {steps + 1}), lambda i:
        CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
        * pow(abs(cos(u0 + i * h)), d - 1))) AS f_p,
    (g00 + g11 + sqrt(pow(g00 - g11, 2) + 4 * g01 * g01)) / 2 AS e1 FROM s6),
s8 AS (SELECT *, e1 / sqrt(f_n * f_n * s[1] * s[1]) AS condition_number FROM s7)
SELECT {_list(cols)} FROM s8"""


def _ols_two() -> str:
    """Two predictors by residuals on residuals (Frisch, Waugh & Lovell)."""
    y, (a, b) = cat.LINEITEM_OLS
    return f"""WITH on_b AS (
  SELECT regr_slope({y}, {b}) AS sy, regr_intercept({y}, {b}) AS iy,
         regr_slope({a}, {b}) AS sa, regr_intercept({a}, {b}) AS ia FROM lineitem),
on_a AS (
  SELECT regr_slope({y}, {a}) AS sy, regr_intercept({y}, {a}) AS iy,
         regr_slope({b}, {a}) AS sb, regr_intercept({b}, {a}) AS ib FROM lineitem),
coef_a AS (SELECT regr_slope({y} - iy - sy * {b}, {a} - ia - sa * {b}) AS c FROM lineitem, on_b),
coef_b AS (SELECT regr_slope({y} - iy - sy * {a}, {b} - ib - sb * {a}) AS c FROM lineitem, on_a),
means AS (SELECT avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb FROM lineitem)
SELECT 'Intercept' AS term, {_round('my - coef_a.c * ma - coef_b.c * mb', 'coef', 4)}
FROM means, coef_a, coef_b
UNION ALL SELECT '{a}', {_round('c', 'coef', 4)} FROM coef_a
UNION ALL SELECT '{b}', {_round('c', 'coef', 4)} FROM coef_b"""


def _ols_one() -> str:
    y, (x,) = cat.SIMPLE_OLS
    return f"""WITH {PANEL_PERCAPITA},
line AS (
  SELECT regr_slope({y}, {x}) AS b, regr_intercept({y}, {x}) AS a, regr_count({y}, {x}) AS n,
         avg({x}) AS mx, regr_sxx({y}, {x}) AS sxx,
         (regr_syy({y}, {x}) - pow(regr_sxy({y}, {x}), 2) / regr_sxx({y}, {x})) AS rss
  FROM panel),
terms AS (
  SELECT 'Intercept' AS term, a AS coef, sqrt(rss / (n - 2) * (1.0 / n + mx * mx / sxx)) AS se
  FROM line
  UNION ALL SELECT '{x}', b, sqrt(rss / (n - 2) / sxx) FROM line)
SELECT term, {_round('coef', 'coef', 8)}, {_round('se', 'se', 8)}, {_round('coef / se', 't')}
FROM terms"""


def _forward() -> str:
    """Greedy selection by sweeping the best candidate in, step by step."""
    y, xs = cat.SELECT_Y, cat.SELECT_X
    k = len(xs)
    ctes, _, _ = _ols_ctes("panel", y, xs).partition("sweep AS (")
    names = _list(f"'{x}'" for x in xs)
    return f"""WITH RECURSIVE {PANEL_PERCAPITA},
{ctes}
greedy AS (
  SELECT 0 AS step, a, []::BIGINT[] AS used, 0.0::DOUBLE AS score, ''::VARCHAR AS term,
         true AS better FROM gram
  UNION ALL
  SELECT step + 1,
    CASE WHEN best.score > score THEN
      list_transform(range(1, {k + 2}), lambda i: list_transform(range(1, {k + 2}), lambda j:
        CASE WHEN i = best.k AND j = best.k THEN -1 / a[best.k][best.k]
             WHEN i = best.k THEN a[best.k][j] / a[best.k][best.k]
             WHEN j = best.k THEN a[i][best.k] / a[best.k][best.k]
             ELSE a[i][j] - a[i][best.k] * a[best.k][j] / a[best.k][best.k] END))
    ELSE a END,
    list_append(used, best.k), best.score, best.term, best.score > score
  FROM (
    SELECT step, a, used, score,
      list_max(list_transform(
        list_filter(range(1, {k + 1}), lambda i: NOT list_contains(used, i)),
        lambda i: {{'score': round(1 - CASE WHEN a[i][i] > 1e-9 * n
              THEN (a[{k + 1}][{k + 1}] - a[i][{k + 1}] * a[i][{k + 1}] / a[i][i])
                   / n * (n - 1) / (n - len(used) - 2)
              ELSE a[{k + 1}][{k + 1}] / n * (n - 1) / (n - len(used) - 1) END, 12),
          'term': [{names}][i], 'k': i}})) AS best
    FROM greedy, stats WHERE better AND step < {k}))
SELECT step::INTEGER AS step, term, {_round('score', 'adj_r2')} FROM greedy
WHERE step > 0 AND better"""


def _forward_with_gaps() -> str:
    """Greedy selection where candidates have NULLs: cross products of each pattern of NULLs, added up for each
    candidate over the patterns that have it and the selected columns, and swept pivot by pivot."""
    y, xs = cat.SELECT_Y, cat.SELECT_LAGS
    k, m = len(xs), len(xs) + 2
    cols = [*xs, y]
    z = ["1.0::DOUBLE AS z1"] + [f"(x{i} - m{i}) / s{i} AS z{i + 1}" for i in range(1, k + 2)]
    gram = _list("[" + _list(f"sum(coalesce(z{i} * z{j}, 0))" for j in range(1, m + 1)) + "]" for i in range(1, m + 1))
    names = _list(f"'{x}'" for x in xs)

    def each(body: str) -> str:
        return f"list_transform(range(1, {m + 1}), lambda i: list_transform(range(1, {m + 1}), lambda j: {body}))"

    def summed(wanted: str) -> str:
        """A candidate's cross products over the patterns that lack none of ``wanted``."""
        fit = f"list_filter(p, lambda q: len(list_filter({wanted}, lambda w: q.lacks[w])) = 0)"
        return f"list_reduce(list_concat([{each('0.0::DOUBLE')}], list_transform({fit}, lambda q: q.a)), lambda s, t: {each('s[i][j] + t[i][j]')})"

    def start(used: str) -> str:
        left = f"list_filter(range(1, {k + 1}), lambda c: NOT list_contains({used}, c))"
        return (
            f"list_transform(list_transform({left}, lambda c: {{'c': c, 'a': {summed(f'list_append({used}, c)')}}}), "
            "lambda x: {'c': x.c, 'a': x.a, 'n': x.a[1][1], 't': 0.0::DOUBLE, 'r': 0::BIGINT})"
        )

    swept = each(
        """CASE WHEN i = x.v AND j = x.v THEN -1 / x.a[x.v][x.v] WHEN i = x.v THEN x.a[x.v][j] / x.a[x.v][x.v]
        WHEN j = x.v THEN x.a[i][x.v] / x.a[x.v][x.v] ELSE x.a[i][j] - x.a[i][x.v] * x.a[x.v][j] / x.a[x.v][x.v] END"""
    )
    return f"""WITH RECURSIVE {PANEL_PERCAPITA},
seen AS (SELECT {_list(f"{c}::DOUBLE AS x{i}" for i, c in enumerate(cols, 1))} FROM panel WHERE {y} IS NOT NULL),
stats AS (SELECT {_list(f"avg(x{i}) AS m{i}, CASE WHEN stddev_pop(x{i}) > 1e-12 THEN stddev_pop(x{i}) ELSE 1 END AS s{i}" for i in range(1, k + 2))} FROM seen),
z AS (SELECT {_list(z)}, [{_list(f"x{i} IS NULL" for i in range(1, k + 1))}] AS lacks FROM seen, stats),
patterns AS (SELECT lacks, [{gram}] AS a FROM z GROUP BY lacks),
held AS (SELECT list({{'lacks': lacks, 'a': a}}) AS p FROM patterns),
walk AS (
  SELECT 0 AS step, []::BIGINT[] AS used, 0.0::DOUBLE AS best, true AS better, 1::BIGINT AS k, {start('[]::BIGINT[]')} AS cs FROM held
  UNION ALL
  SELECT step + CASE WHEN k > len(used) + 2 THEN 1 ELSE 0 END,
    CASE WHEN k > len(used) + 2 AND top.score > best THEN list_append(used, top.c) ELSE used END,
    CASE WHEN k > len(used) + 2 AND top.score > best THEN top.score ELSE best END,
    k <= len(used) + 2 OR coalesce(top.score > best, false),
    CASE WHEN k > len(used) + 2 THEN 1 ELSE k + 1 END,
    CASE WHEN k > len(used) + 2 AND top.score > best THEN {start('list_append(used, top.c)')}
      WHEN k > len(used) + 2 THEN cs
      ELSE list_transform(
        list_transform(cs, lambda x: {{'c': x.c, 'a': x.a, 'n': x.n, 't': x.t, 'r': x.r,
          'v': CASE WHEN k = 1 THEN 1 WHEN k <= len(used) + 1 THEN used[k - 1] + 1 ELSE x.c + 1 END}}),
        lambda x: {{'c': x.c, 'a': CASE WHEN x.a[x.v][x.v] > 1e-9 * x.n THEN {swept} ELSE x.a END, 'n': x.n,
          't': CASE WHEN k = 1 THEN x.a[{m}][{m}] - x.a[1][{m}] * x.a[1][{m}] / x.a[1][1] ELSE x.t END,
          'r': x.r + CASE WHEN x.a[x.v][x.v] > 1e-9 * x.n THEN 1 ELSE 0 END}}) END
  FROM (
    SELECT walk.*, p, CASE WHEN k > len(used) + 2 THEN list_max(list_transform(
        list_filter(cs, lambda x: x.n > x.r AND x.t > 0),
        lambda x: {{'score': round(1 - x.a[{m}][{m}] / x.t * (x.n - 1) / (x.n - x.r), 12), 'term': [{names}][x.c], 'c': x.c}})) END AS top
    FROM walk, held WHERE better))
SELECT step::INTEGER AS step, [{names}][used[step]] AS term, {_round('best', 'adj_r2')} FROM walk
WHERE k = 1 AND better AND step > 0"""


# Predictions by a line ---------------------------------------------------------------------


def _line_ctes(table: str) -> str:
    day = "date_diff('day', DATE '2024-01-01', ds)"
    return f"""line AS (
  SELECT entity_id, regr_slope(y, {day}) AS slope, regr_intercept(y, {day}) AS start
  FROM {table} GROUP BY 1),
predicted AS (
  SELECT entity_id, ds, y, start + slope * {day} AS yhat FROM {table} JOIN line USING (entity_id))"""


# Forecasts ---------------------------------------------------------------------------------


def _forecast(train: str, select: str) -> str:
    """The additive model in SQL: a list of design values per date, cross products per entity,
    and the fixed-point iteration between ridge penalty and noise variance, in which each
    round inverts the penalised matrix pivot by pivot with the sweep operator."""
    dot = "list_sum(list_transform(range(1, m + 1), lambda i: {0} * {1}))"
    waves = _list(
        f"{f}(2 * pi() * {k} * (date_diff('day', DATE '1970-01-01', ds) % 7) / 7)"
        for k in (1, 2, 3)
        for f in ("sin", "cos")
    )
    return f"""WITH RECURSIVE {train},
daily AS (
  SELECT entity_id, ds, count(y)::DOUBLE AS n, sum(y)::DOUBLE AS sy, sum(y * y)::DOUBLE AS syy,
         max(abs(y))::DOUBLE AS top
  FROM train GROUP BY 1, 2),
info AS (
  SELECT entity_id, min(ds) AS start, max(ds) AS last, max(top) AS scale, sum(n) AS total,
    greatest(date_diff('day', min(ds), max(ds)), 1)::DOUBLE AS span, sum(syy) AS syy,
    floor(count(*) * 0.8) AS early, date_diff('day', min(ds), max(ds)) >= 14 AS weekly
  FROM daily GROUP BY 1),
wanted AS (
  SELECT *, least(25, (date_diff('day', start, last) + 1) // 7, early - 1) AS cnt FROM info),
places AS (
  SELECT DISTINCT entity_id, round_even(g * (early - 1.0) / cnt, 0)::BIGINT AS place
  FROM wanted, range(1, 26) AS r(g) WHERE g <= cnt),
ranked AS (
  SELECT entity_id, ds, row_number() OVER (PARTITION BY entity_id ORDER BY ds) - 1 AS place
  FROM daily),
points AS (
  SELECT entity_id, list(ds ORDER BY ds) AS cps
  FROM places JOIN ranked USING (entity_id, place) GROUP BY 1),
dates AS (
  SELECT entity_id, ds, false AS is_future FROM daily
  UNION ALL
  SELECT entity_id, CAST(last + CAST(i AS INTEGER) AS DATE), true FROM info, range(1, 15) AS r(i)),
design AS (
  SELECT d.entity_id, d.ds, is_future, cps, scale, span,
    greatest(date_diff('day', last, d.ds), 0) / span AS ahead,
    list_concat([1.0, date_diff('day', start, d.ds) / span],
      list_transform(cps, lambda c: greatest(date_diff('day', c, d.ds), 0) / span),
      CASE WHEN weekly THEN [{waves.replace('ds)', 'd.ds)')}] ELSE [] END) AS x
  FROM dates d JOIN info USING (entity_id) JOIN points USING (entity_id)),
seen AS (SELECT * FROM design JOIN daily USING (entity_id, ds) WHERE NOT is_future),
cells AS (
  SELECT entity_id, i, j, sum(x[i] * x[j] * n) AS v
  FROM seen, range(1, 34) AS a(i), range(1, 34) AS b(j) WHERE i <= len(x) AND j <= len(x)
  GROUP BY 1, 2, 3),
gram AS (
  SELECT entity_id, list(line ORDER BY i) AS g
  FROM (SELECT entity_id, i, list(v ORDER BY j) AS line FROM cells GROUP BY 1, 2) GROUP BY 1),
crossed AS (
  SELECT entity_id, list(v ORDER BY i) AS c
  FROM (SELECT entity_id, i, sum(x[i] * sy / scale) AS v
        FROM seen, range(1, 34) AS a(i) WHERE i <= len(x) GROUP BY 1, 2) GROUP BY 1),
ready AS (
  SELECT entity_id, g, c, len(c) AS m, len(cps) AS s, syy / (scale * scale) AS yy, total
  FROM gram JOIN crossed USING (entity_id) JOIN info USING (entity_id)
  JOIN points USING (entity_id)),
rounds AS (
  SELECT entity_id, g, c, m, s, yy, total, 0 AS done, 1::BIGINT AS k, 1.0::DOUBLE AS weight,
    NULL::DOUBLE AS sigma2, NULL::DOUBLE[][] AS p,
    list_transform(range(1, m + 1), lambda i: list_transform(range(1, m + 1), lambda j:
      g[i][j] + CASE WHEN i = j AND i > 2 AND i <= s + 2 THEN 1.0 ELSE 0.0 END)) AS a
  FROM ready
  UNION ALL
  SELECT entity_id, g, c, m, s, yy, total, done + (k > m)::INTEGER,
    CASE WHEN k > m THEN 1 ELSE k + 1 END, next_weight,
    CASE WHEN k > m THEN next_sigma2 ELSE sigma2 END, CASE WHEN k > m THEN q ELSE p END,
    list_transform(range(1, m + 1), lambda i: list_transform(range(1, m + 1), lambda j:
      CASE WHEN k > m THEN g[i][j]
             + CASE WHEN i = j AND i > 2 AND i <= s + 2 THEN next_weight ELSE 0.0 END
           WHEN i = k AND j = k THEN -1 / a[k][k]
           WHEN i = k THEN a[k][j] / a[k][k]
           WHEN j = k THEN a[i][k] / a[k][k]
           ELSE a[i][j] - a[i][k] * a[k][j] / a[k][k] END))
  FROM (
    SELECT *, CASE WHEN k > m THEN greatest(next_sigma2 / 0.25, 1e-12) ELSE weight END
      AS next_weight
    FROM (
      SELECT *, CASE WHEN k > m THEN
          greatest(yy - 2 * {dot.format('b[i]', 'c[i]')} + {dot.format('b[i]', 'gb[i]')}, 0)
          / (total - list_sum(list_transform(range(1, m + 1), lambda i:
               {dot.format('q[i][j]', 'g[j][i]').replace('lambda i', 'lambda j')}))) END
        AS next_sigma2
      FROM (
        SELECT *, list_transform(range(1, m + 1), lambda i:
          list_sum(list_transform(range(1, m + 1), lambda j: g[i][j] * b[j]))) AS gb
        FROM (
          SELECT *, list_transform(range(1, m + 1), lambda i:
            list_sum(list_transform(range(1, m + 1), lambda j: q[i][j] * c[j]))) AS b
          FROM (
            SELECT *, list_transform(a, lambda r: list_transform(r, lambda v: -v)) AS q
            FROM rounds WHERE done < 30)))))),
fitted AS (
  SELECT *, list_transform(range(1, m + 1), lambda i:
      list_sum(list_transform(range(1, m + 1), lambda j: p[i][j] * c[j]))) AS b
  FROM rounds WHERE done = 30 AND k = 1),
parts AS (
  SELECT d.*, f.b, f.s, f.sigma2, n.n, n.sy,
    list_sum(list_transform(range(1, s + 3), lambda i: x[i] * b[i])) AS trend,
    coalesce(list_sum(list_transform(range(s + 3, m + 1), lambda i: x[i] * b[i])), 0) AS weekly,
    sigma2 * (1 + list_sum(list_transform(range(1, m + 1), lambda i: x[i] * list_sum(
      list_transform(range(1, m + 1), lambda j: p[i][j] * x[j])))))
    + s * 2 * pow(list_avg(list_transform(range(3, s + 3), lambda i: abs(b[i]))), 2)
      * pow(ahead, 3) / 3 AS variance
  FROM design d JOIN fitted f USING (entity_id) LEFT JOIN daily n USING (entity_id, ds)),
frame AS (
  SELECT entity_id, ds, is_future, n::BIGINT AS n_obs, sy / n AS y, scale * (trend + weekly) AS yhat,
    scale * (trend + weekly - {Z975} * sqrt(variance)) AS yhat_lower,
    scale * (trend + weekly + {Z975} * sqrt(variance)) AS yhat_upper,
    scale * trend AS trend, scale * weekly AS weekly, 0.0::DOUBLE AS yearly,
    true AS converged, cps, b, scale, span FROM parts)
{select}"""


def _sweep(a: str, v: str, size: str) -> str:
    """The matrix ``a`` after the sweep of pivot ``v``."""
    return f"""list_transform(range(1, {size} + 1), lambda i: list_transform(range(1, {size} + 1), lambda j:
      CASE WHEN i = {v} AND j = {v} THEN -1 / {a}[{v}][{v}] WHEN i = {v} THEN {a}[{v}][j] / {a}[{v}][{v}]
           WHEN j = {v} THEN {a}[i][{v}] / {a}[{v}][{v}] ELSE {a}[i][j] - {a}[i][{v}] * {a}[{v}][j] / {a}[{v}][{v}] END))"""


def _monthly(train: str, rounds: int = 40) -> str:
    """CTEs of the additive model of monthly series, with yearly terms for two years or more.

    Level, slope and yearly terms are swept out once; the balance of noise and penalty then needs the hinges' block
    alone, swept anew each round; a last sweep of all under the balanced penalty gives coefficients and covariance.
    """
    dot = "list_sum(list_transform(range(1, m + 1), lambda i: {0} * {1}))"
    days = "date_diff('day', DATE '1970-01-01', d.ds)"
    waves = _list(f"{f}(2 * pi() * {k} * {days} / 365.25)" for k in range(1, 11) for f in ("sin", "cos"))
    return f"""{train},
daily AS (
  SELECT entity_id, ds, count(y)::DOUBLE AS n, sum(y)::DOUBLE AS sy, sum(y * y)::DOUBLE AS syy, max(abs(y))::DOUBLE AS top
  FROM train GROUP BY 1, 2),
gaps AS (SELECT entity_id, ds, date_diff('month', lag(ds) OVER (PARTITION BY entity_id ORDER BY ds), ds) AS gap FROM daily),
info AS (
  SELECT entity_id, min(ds) AS start, max(ds) AS last, max(top) AS scale, sum(n) AS total, min(gap) AS step,
    greatest(date_diff('day', min(ds), max(ds)), 1)::DOUBLE AS span, sum(syy) AS syy,
    floor(count(*) * 0.8) AS early, date_diff('day', min(ds), max(ds)) >= 730 AS yearly
  FROM daily JOIN gaps USING (entity_id, ds) GROUP BY 1),
wanted AS (
  SELECT *, least(25, (date_diff('day', start, last) + 1) // 7, early - 1) AS cnt FROM info),
places AS (
  SELECT DISTINCT entity_id, round_even(g * (early - 1.0) / cnt, 0)::BIGINT AS place
  FROM wanted, range(1, 26) AS r(g) WHERE g <= cnt),
ranked AS (
  SELECT entity_id, ds, row_number() OVER (PARTITION BY entity_id ORDER BY ds) - 1 AS place FROM daily),
points AS (
  SELECT entity_id, list(ds ORDER BY ds) AS cps
  FROM places JOIN ranked USING (entity_id, place) GROUP BY 1),
dates AS (
  SELECT entity_id, ds, false AS is_future FROM daily
  UNION ALL
  SELECT entity_id, CAST(last + to_months(CAST(step * i AS INTEGER)) AS DATE), true FROM info, range(1, 15) AS r(i)),
design AS (
  SELECT d.entity_id, d.ds, is_future, cps, scale, span, greatest(date_diff('day', last, d.ds), 0) / span AS ahead,
    list_concat([1.0, date_diff('day', start, d.ds) / span],
      list_transform(cps, lambda c: greatest(date_diff('day', c, d.ds), 0) / span),
      CASE WHEN yearly THEN [{waves}] ELSE [] END) AS x
  FROM dates d JOIN info USING (entity_id) JOIN points USING (entity_id)),
seen AS (SELECT entity_id, n, list_append(x, sy / n / scale) AS x FROM design JOIN daily USING (entity_id, ds) WHERE NOT is_future),
cells AS (
  SELECT entity_id, i, j, sum(x[i] * x[j] * n) AS v
  FROM seen, range(1, 49) AS a(i), range(1, 49) AS b(j) WHERE i <= len(x) AND j <= len(x) GROUP BY 1, 2, 3),
products AS (
  SELECT entity_id, list(line ORDER BY i) AS g
  FROM (SELECT entity_id, i, list(v ORDER BY j) AS line FROM cells GROUP BY 1, 2) GROUP BY 1),
ready AS (
  SELECT entity_id, g, len(g) - 1 AS m, len(cps) AS s, syy / (scale * scale) AS yy, total,
    list_concat([1, 2], range(len(cps) + 3, len(g))) AS plain
  FROM products JOIN info USING (entity_id) JOIN points USING (entity_id)),
freed AS (
  SELECT entity_id, m, s, yy, total, plain, 1::BIGINT AS k, g AS a FROM ready
  UNION ALL
  SELECT entity_id, m, s, yy, total, plain, k + 1, {_sweep('a', 'plain[k]', '(m + 1)')} FROM freed WHERE k <= len(plain)),
block AS (
  SELECT entity_id, s, total - len(plain) AS free, yy - a0 + a[m + 1][m + 1] AS unexplained,
    list_transform(range(3, s + 3), lambda i: list_transform(range(3, s + 3), lambda j: a[i][j])) AS h,
    list_transform(range(3, s + 3), lambda i: a[i][m + 1]) AS lean
  FROM freed JOIN (SELECT entity_id, g[len(g)][len(g)] AS a0 FROM ready) USING (entity_id) WHERE k = len(plain) + 1),
rounds AS (
  SELECT entity_id, s, free, unexplained, h, lean, 0 AS done, 1::BIGINT AS k, 1.0::DOUBLE AS weight, NULL::DOUBLE AS sigma2,
    list_transform(range(1, s + 1), lambda i: list_transform(range(1, s + 1), lambda j: h[i][j] + CASE WHEN i = j THEN 1.0 ELSE 0.0 END)) AS a
  FROM block
  UNION ALL
  SELECT entity_id, s, free, unexplained, h, lean, done + (k > s)::INTEGER, CASE WHEN k > s THEN 1 ELSE k + 1 END,
    CASE WHEN k > s THEN greatest(next_sigma2 / 0.25, 1e-12) ELSE weight END, CASE WHEN k > s THEN next_sigma2 ELSE sigma2 END,
    CASE WHEN k > s THEN list_transform(range(1, s + 1), lambda i: list_transform(range(1, s + 1), lambda j:
        h[i][j] + CASE WHEN i = j THEN greatest(next_sigma2 / 0.25, 1e-12) ELSE 0.0 END))
      ELSE {_sweep('a', 'k', 's')} END
  FROM (
    SELECT *, CASE WHEN k > s THEN greatest(unexplained - list_sum(list_transform(range(1, s + 1), lambda i: d[i] * (2 * lean[i] - list_sum(
          list_transform(range(1, s + 1), lambda j: h[i][j] * d[j]))))), 0)
        / (free - list_sum(list_transform(range(1, s + 1), lambda i: list_sum(list_transform(range(1, s + 1), lambda j: -a[i][j] * h[j][i]))))) END AS next_sigma2
    FROM (
      SELECT *, CASE WHEN k > s THEN list_transform(range(1, s + 1), lambda i: list_sum(list_transform(range(1, s + 1), lambda j: -a[i][j] * lean[j]))) END AS d
      FROM rounds WHERE done < {rounds}))),
settled AS (SELECT entity_id, weight, sigma2 FROM rounds WHERE done = {rounds} AND k = 1),
swept AS (
  SELECT entity_id, m, s, sigma2, 1::BIGINT AS k,
    list_transform(range(1, m + 2), lambda i: list_transform(range(1, m + 2), lambda j:
      g[i][j] + CASE WHEN i = j AND i > 2 AND i <= s + 2 THEN weight ELSE 0.0 END)) AS a
  FROM ready JOIN settled USING (entity_id)
  UNION ALL
  SELECT entity_id, m, s, sigma2, k + 1, {_sweep('a', 'k', '(m + 1)')} FROM swept WHERE k <= m),
fitted AS (
  SELECT entity_id, m, s, sigma2, list_transform(range(1, m + 1), lambda i: a[i][m + 1]) AS b, a FROM swept WHERE k = m + 1),
parts AS (
  SELECT d.*, f.s, f.sigma2, n.n, n.sy,
    list_sum(list_transform(range(1, s + 3), lambda i: x[i] * b[i])) AS trend,
    coalesce(list_sum(list_transform(range(s + 3, m + 1), lambda i: x[i] * b[i])), 0) AS yearly,
    sigma2 * (1 - list_sum(list_transform(range(1, m + 1), lambda i: x[i] * list_sum(
      list_transform(range(1, m + 1), lambda j: a[i][j] * x[j])))))
    + s * 2 * pow(list_avg(list_transform(range(3, s + 3), lambda i: abs(b[i]))), 2) * pow(ahead, 3) / 3 AS variance
  FROM design d JOIN fitted f USING (entity_id) LEFT JOIN daily n USING (entity_id, ds)),
frame AS (
  SELECT entity_id, ds, is_future, n::BIGINT AS n_obs, sy / n AS y, scale * (trend + yearly) AS yhat,
    scale * (trend + yearly - {Z975} * sqrt(variance)) AS yhat_lower,
    scale * (trend + yearly + {Z975} * sqrt(variance)) AS yhat_upper,
    scale * trend AS trend, 0.0::DOUBLE AS weekly, scale * yearly AS yearly, true AS converged FROM parts)"""


def _error_model() -> str:
    """The model of supplier errors. The rounded log of the population is one number here, so the term goes with the
    intercept; the shortest solution shares the intercept's coefficient between the two."""
    ctes = f"""{_monthly(f"{PANEL_LOG}, train AS (SELECT entity_id, ds, y FROM panel)")},
missed AS (SELECT p.*, p.y - f.yhat AS error FROM panel p JOIN frame f ON p.entity_id = f.entity_id AND p.ds = f.ds WHERE NOT f.is_future),
same AS (SELECT max(log_pop) AS c FROM panel)"""
    columns = ("coef", "se", "t", "p", "lo", "hi")
    head, _, _ = _coef(ctes, "missed", *cat.ERROR_OLS, columns).rpartition("\nSELECT ")
    size = ("coef", "se", "lo", "hi")
    shared = [f"{c} * f AS {c}" if c in size else c for c in columns]
    return f"""{head}
SELECT term, {_list(_round(c, c, 5 if c in size else 4 if c == "t" else 6) for c in columns)} FROM (
  SELECT term, {_list(shared)} FROM (SELECT table_.*, CASE WHEN term = 'Intercept' THEN 1 / (c * c + 1) ELSE 1 END AS f FROM table_, same)
  UNION ALL
  SELECT 'log_pop', {_list(shared)} FROM (SELECT table_.*, c / (c * c + 1) AS f FROM table_, same WHERE term = 'Intercept'))"""


_FRAME = ("y", "yhat", "yhat_lower", "yhat_upper", "trend", "weekly", "yearly")


def _frame(train: str, keys: str = "entity_id, ", where: str = "true") -> str:
    cols = _list(_round(c, c) for c in _FRAME)
    return _forecast(train, f"SELECT {keys}ds, is_future, n_obs, {cols}, converged FROM frame WHERE {where}")


def _union() -> str:
    first, *others = cat.ENTITIES
    parts = [
        f"SELECT entity_id, ds, y, (dayofweek(ds) + 1)::INTEGER AS weekday "
        f"FROM series WHERE entity_id = '{first}'",
        *[f"SELECT entity_id, ds, y, NULL FROM series WHERE entity_id = '{e}'" for e in others],
    ]
    return f"WITH {SERIES}\n" + "\nUNION ALL ".join(parts)


ORACLE: dict[str, str] = {
    "scan_panel": """SELECT o_orderkey AS order_id, o_custkey AS entity_id,
        o_orderstatus AS status, o_totalprice AS amount FROM orders WHERE o_totalprice > 150000""",
    "panel_filtered": f"""WITH {SUPPLIERS}
SELECT entity_id, ds, entity_name, cases, deaths, pop, acctbal, nation_id FROM filtered""",
    "panel_log": _project(PANEL_LOG, _LOG_EXACT, _LOG_DOUBLE),
    "panel_percapita": _project(PANEL_PERCAPITA, _PC_EXACT, _PC_DOUBLE),
    "log_transform": f"""WITH {NATION}
SELECT entity_id, ds, {_ln('cases')} AS log_cases, {_ln('deaths')} AS log_deaths,
       {_ln('pop')} AS log_pop FROM nation_panel""",
    "per_capita": f"""WITH {NATION}
SELECT entity_id, ds, {_ratio('cases', 'pop')} AS cc_per_capita,
  {_ratio('deaths', 'pop')} AS d_per_capita, {_ratio('deaths', 'cases')} AS d_per_cc
FROM nation_panel""",
    "population_shares": f"""WITH {NATION}
SELECT entity_id, ds, {_list(f"{_ratio(c, 'pop')} AS share_{s}"
                             for s, c in zip(SEGMENTS, SEGMENT_COUNTS))} FROM nation_panel""",
    "band_shares": f"WITH {SUPPLIERS}\nSELECT entity_id, ds, {_list(_BANDS)} FROM wide",
    "date_keys": f"""WITH {NATION}
SELECT entity_id, ds, strftime(ds, '%Y-%m-%d') AS ds_key, ds::VARCHAR AS ds_text
FROM nation_panel""",
    "numeric_view": f"WITH {SUPPLIERS}\nSELECT cases, deaths, pop, acctbal FROM filtered",
    "lags_log_cases": f"""WITH {SUPPLIERS}
SELECT entity_id, ds, {_list(_lag('CCT', _ln('cases')))} FROM filtered""",
    "lags_ranged": f"""WITH {SUPPLIERS}
SELECT entity_id, ds, {_list(_lag('CCT', _ln('cases')))} FROM filtered""",
    "lags_raw_deaths": f"""WITH {SUPPLIERS}
SELECT entity_id, ds, {_list(_lag('DT', 'deaths'))} FROM filtered""",
    "lags_unfiltered": f"""WITH {SUPPLIERS}
SELECT entity_id, ds, {_list(_lag('CCT', 'cases'))}, {_list(_lag('DT', 'deaths'))} FROM wide""",
    "lags_percapita": _project(
        f"""{SUPPLIERS}, lagged AS (SELECT entity_id, ds,
  {_list(_lag('CCT', _ratio('cases', 'pop')))}, {_list(_lag('DT', _ratio('deaths', 'pop')))}
  FROM filtered)""",
        ("entity_id", "ds"), (*SUPPLIER.lags_of("CCT"), *SUPPLIER.lags_of("DT")), "lagged",
    ),
    "lags_calendar": f"""WITH {SUPPLIERS}
SELECT f.entity_id, f.ds, a.cases AS cases_31, b.cases AS cases_61 FROM filtered f
LEFT JOIN filtered a ON a.entity_id = f.entity_id AND a.ds = f.ds - 31
LEFT JOIN filtered b ON b.entity_id = f.entity_id AND b.ds = f.ds - 61""",
    "lags_sliced": f"""WITH {SUPPLIERS}
SELECT entity_id, ds, {_list(_lag('cases', 'cases', (1, 7)))} FROM filtered""",
    "train_split": f"WITH {TRAIN}\nSELECT * FROM train",
    "future_dates": f"""WITH {TRAIN},
last AS (SELECT entity_id, max(ds) AS ds FROM train GROUP BY 1)
SELECT entity_id, ds, false AS is_future FROM train
UNION ALL SELECT entity_id, CAST(ds + CAST(i AS INTEGER) AS DATE), true
FROM last, range(1, 15) AS r(i)""",
    "union_entities": _union(),
    "describe_measures": _describe(PANEL_PERCAPITA, "panel", cat.DESCRIBED["measures"]),
    "describe_bands": _describe(PANEL_PERCAPITA, "panel", cat.DESCRIBED["bands"]),
    "describe_approx": f"WITH {PANEL_PERCAPITA}\n" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS variable, count({c}) AS count, true AS p25_near, true AS p50_near, true AS p75_near FROM panel"
        for c in cat.DESCRIBED["bands"]
    ),
    "describe_shares": _describe(PANEL_PERCAPITA, "panel", cat.DESCRIBED["shares"]),
    "describe_covariates": _describe(PANEL_PERCAPITA, "panel", cat.DESCRIBED["covariates"]),
    "skew_report": _skew_report(),
    "weekday_profile": f"""WITH {SERIES}
SELECT (dayofweek(ds) + 1)::INTEGER AS weekday, count(y) AS n, {_round('avg(y)', 'mean_y')}
FROM series GROUP BY 1""",
    "minmax_params": f"WITH {PANEL_LOG}\nSELECT {_minmax(sup.SCALED)} FROM panel",
    "minmax_scaled": _project(
        f"{PANEL_LOG},\n{_scaled_cte(sup.SCALED, ('entity_id', 'ds'))}",
        ("entity_id", "ds"), sup.SCALED, "scaled",
    ),
    "corr_matrix": _corr(PANEL_LOG, sup.CORRELATED, sup.CORRELATED),
    "corr_matrix_wide": f"""SELECT var_x, {_list(f"max(r) FILTER (WHERE var_y = '{c}') AS {c}" for c in sup.CORRELATED)}
FROM ({_corr(PANEL_LOG, sup.CORRELATED, sup.CORRELATED)}) GROUP BY var_x""",
    "corr_tiles": _corr(PANEL_LOG, sup.CORRELATED, sup.CORRELATED),
    "corr_targets": _corr(PANEL_LOG, sup.CORRELATED, ("log_cases", "log_deaths"))
    + " ORDER BY var_x, var_y",
    "autocorr_raw": _corr(
        f"""{SUPPLIERS}, panel AS (SELECT {_list(_lag('CCT', 'cases'))},
  {_list(_lag('DT', 'deaths'))} FROM wide)""",
        (*SUPPLIER.lags_of("CCT"), *SUPPLIER.lags_of("DT")),
        (*SUPPLIER.lags_of("CCT"), *SUPPLIER.lags_of("DT")),
    ),
    "cross_corr_lags": _corr(
        f"""{SUPPLIERS}, panel AS (SELECT cases, deaths, {_list(_lag('CCT', 'cases'))},
  {_list(_lag('DT', 'deaths'))} FROM wide)""",
        cat.CROSS_CORR, ("cases", "deaths"),
    ),
    "ols_simple": _ols_one(),
    "ols_multi": _ols_two(),
    "ols_summary_coef": _coef(
        PANEL_PERCAPITA, "panel", *cat.SIMPLE_OLS, ("coef", "se", "t", "p", "lo", "hi")
    ),
    "ols_summary_fit": _fit_one_predictor(),
    "forward_selection": _forward(),
    "forward_selection_lags": _forward_with_gaps(),
    "join_actual_pred": f"""WITH {TRAIN}, {_line_ctes('train')}
SELECT entity_id, ds, y, {_round('yhat', 'yhat')} FROM predicted""",
    "forecast_error": f"""WITH {PANEL_LOG}, {_line_ctes('panel')}
SELECT p.entity_id, p.ds, q.y, {_round('yhat', 'yhat', 4)}, {_round('q.y - yhat', 'error', 4)},
  {_round('log_pop', 'log_pop', 4)}, {_round('acctbal', 'acctbal', 4)}
FROM predicted p JOIN panel q ON p.entity_id = q.entity_id AND p.ds = q.ds""",
    "rmse_by_entity": f"""WITH {TRAIN}, {_line_ctes('train')}
SELECT entity_id, count(*) AS n, {_round('sqrt(sum(pow(y - yhat, 2)) / count(*))', 'rmse')}
FROM predicted GROUP BY 1""",
    "trend_concavity": f"""WITH {TRAIN},
bends AS (SELECT entity_id, y, y - 2 * lag(y, 1) {_OVER} + lag(y, 2) {_OVER} AS bend FROM train),
means AS (SELECT entity_id, avg(bend) AS m, avg(abs(y)) * 1e-9 AS noise FROM bends GROUP BY 1)
SELECT entity_id, {_round('m', 'mean_second_difference')},
  CASE WHEN m > noise THEN 'convex' WHEN m < -noise THEN 'concave'
       WHEN m IS NOT NULL THEN 'linear' END AS shape FROM means""",
}

_POOLED = f"""{SERIES},
train AS (SELECT 'all' AS entity_id, ds, y FROM series WHERE ds <= DATE '{cat.CUTOFF}')"""

ORACLE.update(
    {
        "forecast_entities": _frame(TRAIN),
        "forecast_insample": _frame(TRAIN, where="NOT is_future"),
        "forecast_pooled": _frame(_POOLED, keys=""),
        "forecast_pooled_rows": _forecast(
            _POOLED,
            f"""SELECT s.entity_id, s.ds, s.y, {_round('f.yhat', 'yhat')}, {_round('s.y - f.yhat', 'error')}
FROM series s JOIN frame f USING (ds) WHERE NOT f.is_future""",
        ),
        "forecast_pooled_rmse": _forecast(
            _POOLED,
            f"""SELECT s.entity_id, count(*) AS n, {_round('sqrt(avg(pow(s.y - f.yhat, 2)))', 'rmse')}
FROM series s JOIN frame f USING (ds) WHERE NOT f.is_future GROUP BY 1""",
        ),
        "forecast_components": _forecast(
            TRAIN,
            f"""SELECT entity_id, ds, is_future, {_round('trend', 'trend')},
  {_round('weekly', 'weekly')}, {_round('yearly', 'yearly')}, {_round('yhat', 'yhat')} FROM frame""",
        ),
        "forecast_changepoints": _forecast(
            TRAIN,
            f"""SELECT entity_id, cps[i] AS changepoint_ds,
  {_round('b[i + 2] * scale / span', 'delta')}
FROM (SELECT DISTINCT entity_id, cps, b, scale, span FROM frame), range(1, 26) AS r(i)
WHERE i <= len(cps)""",
        ),
        "forecast_rmse": _forecast(
            TRAIN,
            f"""SELECT entity_id, count(*) AS n,
  {_round('sqrt(sum(pow(y - yhat, 2)) / count(*))', 'rmse')}
FROM frame WHERE NOT is_future GROUP BY 1""",
        ),
        "forecast_trend_shape": _forecast(
            TRAIN,
            f""", bends AS (
  SELECT entity_id, trend, trend - 2 * lag(trend, 1) {_OVER} + lag(trend, 2) {_OVER} AS bend
  FROM frame),
means AS (SELECT entity_id, avg(bend) AS m, avg(abs(trend)) * 1e-9 AS noise FROM bends GROUP BY 1)
SELECT entity_id, {_round('m', 'mean_second_difference')},
  CASE WHEN m > noise THEN 'convex' WHEN m < -noise THEN 'concave' ELSE 'linear' END AS shape
FROM means""",
        ),
    }
)

ORACLE["forecast_suppliers"] = f"""WITH RECURSIVE {_monthly(f"{SUPPLIERS}, train AS (SELECT entity_id, ds, cases AS y FROM filtered)")}
SELECT entity_id, ds, is_future, n_obs, {_list(_round(c, c) for c in _FRAME)}, converged FROM frame"""
ORACLE["forecast_error_model"] = _error_model()
_ERRORS = f"""{PANEL_LOG},
pooled AS (SELECT regr_slope(y, t) AS slope, regr_intercept(y, t) AS start
           FROM (SELECT y, date_diff('day', DATE '2024-01-01', ds) AS t FROM panel)),
missed AS (SELECT panel.*, y - (start + slope * date_diff('day', DATE '2024-01-01', ds)) AS error
           FROM panel, pooled)"""
_HEAD = ("y", "n", "rank", "df_model", "df_resid")
ORACLE["ols_forecast_error"] = _coef(
    _ERRORS, "missed", *cat.ERROR_OLS,
    {"coef": 5, "se": 5, "t": 4, "p": 6, "lo": 5, "hi": 5},
)
ORACLE["ols_forecast_error_fit"] = _fit(
    _ERRORS, "missed", *cat.ERROR_OLS, (*_HEAD, "r2", "f", "rss"), 4
)

for _name, (_y, _xs) in sup.FORMULAS.items():
    if _name == "forecast_error":
        continue
    if _name == "percapita":
        _ctes, _table = PANEL_PERCAPITA, "panel"
    else:
        _ctes = f"{PANEL_LOG},\n{_scaled_cte((_y, *_xs), ('entity_id', 'ds'))}"
        _table = "scaled"
    ORACLE[f"ols_{_name}"] = _coef(
        _ctes, _table, _y, _xs, ("coef", "se", "t", "p", "lo", "hi")
    )
    ORACLE[f"ols_{_name}_fit"] = _fit(_ctes, _table, _y, _xs, cat.FIT_CHECKED)

_MODELS = ("cases", "deaths", "percapita")
ORACLE["ols_together"] = "\nUNION ALL ".join(f"SELECT '{m}' AS model, * FROM ({ORACLE[f'ols_{m}']})" for m in _MODELS)
ORACLE["ols_together_fit"] = "\nUNION ALL ".join(f"SELECT * FROM ({ORACLE[f'ols_{m}_fit']})" for m in _MODELS)
