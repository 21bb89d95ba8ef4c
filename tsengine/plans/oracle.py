"""DuckDB equivalents of the registered queries, written from the definitions."""

from __future__ import annotations

from itertools import permutations

from tsengine.functions import texts
from tsengine.functions.stats import AS241, NORMAL_975

VARS = ("temperature", "temperature_max", "temperature_min", "precipitation", "humidity", "solar_radiation", "wind_speed")
CORE = ("temperature", "precipitation", "humidity", "solar_radiation", "wind_speed")


def out(sql: str, d: str = "", i: str = "", digits: int = 6) -> str:
    """Round the doubles ``d`` and widen the integers ``i`` of a query."""
    parts = [f"round({c}, {digits}) + 0 AS {c}" for c in d.split()]
    parts += [f"CAST({c} AS BIGINT) AS {c}" for c in i.split()]
    replace = f" REPLACE ({', '.join(parts)})" if parts else ""
    return f"SELECT *{replace} FROM ({sql})"


def chain(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def panel_cte(series: str = "l_returnflag || l_linestatus", name: str = "panel") -> str:
    return f"""{name} AS (
 SELECT {series} AS series_id, CAST(l_shipdate AS DATE) AS date,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) * 1e1 / (999983e0 * count(*)) AS temperature,
  CAST(max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) * 1e1 / 999983e0 AS temperature_max,
  CAST(min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) * 1e1 / 999983e0 AS temperature_min,
  sum(l_quantity) AS precipitation,
  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS humidity,
  CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) AS solar_radiation,
  CAST(count(*) AS DOUBLE) AS wind_speed
 FROM lineitem GROUP BY ALL)"""


def disp(x: str, digits: int) -> str:
    """Export rounding, in decimal."""
    return f"CAST(round(CAST({x} AS DECIMAL(28, 9)), {digits}) AS DOUBLE)"


PANEL = panel_cte()
SPINE = """bounds AS (SELECT series_id, min(date) AS lo, max(date) AS hi FROM panel GROUP BY series_id),
days AS (SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM bounds),
spine AS (SELECT d.series_id, d.date, p.* EXCLUDE (series_id, date) FROM days d LEFT JOIN panel p USING (series_id, date))"""


def _reach(v: str) -> str:
    past = "(PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = "(PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    at = f"CASE WHEN {v} IS NOT NULL THEN pos END"
    return (
        f"last_value({at} IGNORE NULLS) OVER {past} AS pa_{v}, last_value({v} IGNORE NULLS) OVER {past} AS pv_{v}, "
        f"first_value({at} IGNORE NULLS) OVER {ahead} AS na_{v}, first_value({v} IGNORE NULLS) OVER {ahead} AS nv_{v}"
    )


def _interpolated(v: str) -> str:
    share = f"CAST(pos - pa_{v} AS DOUBLE) / nullif(na_{v} - pa_{v}, 0)"
    return f"coalesce({v}, pv_{v} + (nv_{v} - pv_{v}) * ({share}), nv_{v}, pv_{v}) AS {v}"


IMPUTED = f"""placed AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos FROM spine),
reached AS (SELECT *, {', '.join(_reach(v) for v in VARS)} FROM placed),
imputed AS (SELECT series_id, date, {', '.join(_interpolated(v) for v in VARS)} FROM reached)"""
BY_DATE = "PARTITION BY series_id ORDER BY date"


def ma(v: str, w: int, strict: bool = False) -> str:
    frame = f"OVER ({BY_DATE} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    mean = f"avg({v}) {frame}"
    return (f"CASE WHEN count({v}) {frame} = {w} THEN {mean} END" if strict else mean) + f" AS {v}_ma{w}"


RANKED = f"""obs AS (SELECT series_id, date, temperature AS y,
  row_number() OVER ({BY_DATE}) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n
 FROM panel WHERE temperature IS NOT NULL)"""

ORDER_PANEL = """order_days AS (
 SELECT o_orderstatus AS series_id, CAST(o_orderdate AS DATE) AS date,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) * 1e1 / (999983e0 * count(*)) AS temperature,
  CAST(count(*) AS DOUBLE) AS wind_speed
 FROM orders GROUP BY ALL),
order_panel AS (SELECT * REPLACE (CASE WHEN day(date) <> 13 THEN temperature END AS temperature) FROM order_days)"""
STATUS_PANEL = panel_cte("l_linestatus", "status_panel")
SUPPLIER_PANEL = panel_cte("CAST(l_suppkey AS VARCHAR)", "panel")

Q: dict[str, str] = {}
ALL = " ".join(VARS)
Q["daily_panel"] = chain(PANEL) + out("SELECT * FROM panel", ALL)
for name in ("csv_round_trip", "parse_map_payload", "parse_array_payload"):
    Q[name] = Q["daily_panel"]
Q["date_spine"] = chain(PANEL, SPINE) + out("SELECT * FROM spine", ALL)
Q["json_round_trip"] = Q["date_spine"]
Q["table_round_trip"] = chain(PANEL) + out(
    f"SELECT series_id, date, year(date) AS year, {', '.join(VARS)} FROM panel",
    ALL, "year",
)

Q["parse_variant_payload"] = chain(PANEL) + out(
    """SELECT series_id, date, 'T2M' AS parameter, temperature AS value, CAST(NULL AS VARCHAR) AS text FROM panel
 UNION ALL SELECT series_id, date, 'RAIN', precipitation, NULL FROM panel WHERE year(date) % 2 = 0
 UNION ALL SELECT series_id, date, 'WIND', wind_speed, NULL FROM panel WHERE year(date) % 2 = 0
 UNION ALL SELECT series_id, date, 'WIND', NULL, CAST(wind_speed AS VARCHAR) || ' m/s' FROM panel WHERE year(date) % 2 = 1
 UNION ALL SELECT series_id, date, 'RH2M', CASE WHEN day(date) <> 13 THEN humidity END, NULL FROM panel WHERE year(date) % 2 = 1""",
    "value",
)
Q["rename_columns"] = """SELECT o_orderstatus AS series_id, CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS BIGINT) AS orders
 FROM orders GROUP BY ALL"""

# -- quality ------------------------------------------------------------------------------

_broken = ", ".join(
    f"CASE WHEN day(date) % 7 = 3 OR day(date) % 11 = 5 THEN NULL ELSE {v} END AS {v}" for v in VARS
)
Q["convert_types"] = chain(PANEL) + out(f"SELECT series_id, date, {_broken} FROM panel", ALL)
Q["rejected_rows"] = chain(PANEL) + """SELECT series_id, count(*) AS total_rows,
 count(CASE WHEN day(date) = 13 THEN 1 END) AS rejected_rows FROM panel GROUP BY series_id"""
Q["date_bounds"] = chain(PANEL) + """SELECT series_id, min(date) AS first_date, max(date) AS last_date,
 min(date) > DATE '1995-01-02' AS starts_late, max(date) < DATE '2001-12-31' AS ends_early FROM panel GROUP BY series_id"""
_cols = ("date", *VARS)
_counts = " UNION ALL ".join(
    f"SELECT series_id, '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS missing FROM spine GROUP BY series_id"
    for c in _cols
)
Q["quality_report"] = chain(PANEL, SPINE, f"c AS ({_counts})") + out(
    """SELECT series_id, total_rows, 8 AS total_columns, total_rows * 8 AS total_cells, m AS missing_cells,
 round(m * 1e2 / (total_rows * 8), 2) AS missing_percentage, column_name, missing,
 round(missing * 1e2 / total_rows, 2) AS column_missing_percentage,
 CASE WHEN m * 1e2 / (total_rows * 8) < 5 THEN 'PASS' ELSE 'WARNING' END AS status
 FROM (SELECT *, sum(missing) OVER (PARTITION BY series_id) AS m FROM c)""",
    "missing_percentage column_missing_percentage",
    "total_rows total_columns total_cells missing_cells missing",
)
_texts = ", ".join(
    f"CASE WHEN day(date) % 7 = 3 THEN 'n/a' WHEN day(date) % 11 = 5 THEN 'NaN' ELSE CAST({v} AS VARCHAR) END AS {v}" for v in VARS
)
BROKEN = f"""broken AS (SELECT series_id, date AS day, CASE WHEN day(date) = 13 THEN 'x' ELSE CAST(date AS VARCHAR) END AS date, {_texts} FROM panel),
bad AS ({' UNION ALL '.join(
    f"SELECT series_id, '{v}' AS column_name, CASE WHEN {v} = 'NaN' THEN 'not a number' ELSE 'not numeric' END AS reason, {v} AS value FROM broken WHERE {v} IN ('n/a', 'NaN')" for v in VARS
)} UNION ALL SELECT series_id, 'date', 'no date', NULL FROM broken WHERE date = 'x'),
gone AS ({' UNION ALL '.join(
    f"SELECT '{v}' AS column_name, count(*) FILTER ({v} IS NULL OR {v} IN ('n/a', 'NaN', 'x')) AS missing, count(*) AS total_rows FROM broken" for v in ('date', *VARS)
)})"""
Q["validation_rejects"] = chain(PANEL, BROKEN) + "SELECT series_id, column_name, reason, value, count(*) AS cells FROM bad GROUP BY ALL"
Q["validation_issues"] = chain(PANEL, BROKEN) + """SELECT 'type_mismatch' AS issue_type,
 column_name || ': expected ' || CASE column_name WHEN 'date' THEN 'date' ELSE 'double' END || ', got string' AS detail, column_name, count(*) AS rejected_cells
 FROM bad GROUP BY ALL"""
Q["validation_bounds"] = chain(PANEL) + """SELECT min(date) AS first_date, max(date) AS last_date, min(date) > DATE '1995-01-02' AS starts_late,
 max(date) < DATE '2001-12-31' AS ends_early FROM panel WHERE day(date) <> 13"""
Q["validation_report"] = chain(PANEL, BROKEN) + out(
    """SELECT g.column_name, total_rows, 8 AS total_columns, total_rows * 8 AS total_cells, sum(missing) OVER () AS missing_cells, missing,
 coalesce(b.n, 0) AS rejected, round(sum(missing) OVER () * 1e2 / (total_rows * 8), 2) AS missing_percentage,
 round(missing * 1e2 / total_rows, 2) AS column_missing_percentage FROM gone g
 LEFT JOIN (SELECT column_name, count(*) AS n FROM bad GROUP BY column_name) b USING (column_name)""",
    "missing_percentage column_missing_percentage",
    "total_columns total_cells missing_cells missing rejected",
)
_outliers = " UNION ALL ".join(
    f"""SELECT series_id, count(*) AS total_rows, '{v}' AS column_name,
 count(*) FILTER (abs(({v} - m) / nullif(s, 0)) > 3) AS outliers FROM
 (SELECT series_id, {v}, avg({v}) OVER p AS m, stddev_samp({v}) OVER p AS s FROM spine WINDOW p AS (PARTITION BY series_id))
 GROUP BY series_id"""
    for v in VARS
)
OUTLIERS = f"outliers AS ({_outliers})"
Q["top_outlier_columns"] = chain(PANEL, SPINE, OUTLIERS) + out(
    """SELECT series_id, total_rows, column_name, outliers, rank, outliers * 1e2 / total_rows AS outlier_percentage FROM
 (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY outliers DESC, column_name) AS rank FROM outliers)
 WHERE rank <= 5 AND outliers > 0""",
    "outlier_percentage", "total_rows outliers rank",
)
_missing = " + ".join(f"count(*) - count({c})" for c in _cols)
Q["quality_score"] = chain(
    PANEL, SPINE, OUTLIERS,
    f"b AS (SELECT series_id, count(*) AS total_rows, {_missing} AS missing_cells, max(date) - min(date) AS span_days FROM spine GROUP BY series_id)",
    "du AS (SELECT series_id, sum(n - 1) AS duplicate_rows FROM (SELECT series_id, count(*) AS n FROM (SELECT * FROM spine) t "
    f"GROUP BY series_id, {', '.join(_cols)}) GROUP BY series_id)",
    "o AS (SELECT series_id, sum(outliers) AS outlier_cells FROM outliers GROUP BY series_id)",
    """m AS (SELECT *, greatest(0e0, 1e2 - missing_cells * 1e2 / (total_rows * 8)) AS completeness,
 greatest(0e0, 1e2 - duplicate_rows * 1e3 / total_rows) AS consistency,
 greatest(0e0, 1e2 - outlier_cells * 1e2 / (total_rows * 8)) AS validity,
 least(1e2, span_days * 1e2 / 3650) AS temporal_coverage
 FROM b JOIN du USING (series_id) JOIN o USING (series_id))""",
    """s AS (SELECT *, (completeness + consistency + validity) / 3 AS accuracy FROM m)""",
    """t AS (SELECT *, round(completeness * 0.3e0 + consistency * 0.2e0 + validity * 0.2e0 + temporal_coverage * 0.15e0
 + accuracy * 0.15e0, 1) AS quality_score FROM s)""",
) + out(
    "SELECT *, CASE WHEN quality_score >= 80 THEN 'PASS' ELSE 'REVIEW REQUIRED' END AS assessment FROM t",
    "completeness consistency validity temporal_coverage accuracy quality_score",
    "total_rows missing_cells span_days duplicate_rows outlier_cells",
)
_profile = " UNION ALL ".join(
    f"""SELECT series_id, count(*) AS total_rows, '{c}' AS column_name, count(*) - count({c}) AS missing,
 {f'min({c})' if c != 'date' else 'CAST(NULL AS DOUBLE)'} AS min, {f'max({c})' if c != 'date' else 'CAST(NULL AS DOUBLE)'} AS max,
 {f'avg({c})' if c != 'date' else 'CAST(NULL AS DOUBLE)'} AS mean FROM spine GROUP BY series_id"""
    for c in _cols
)
Q["column_profile"] = chain(PANEL, SPINE, f"c AS ({_profile})") + out(
    "SELECT *, missing * 1e2 / total_rows AS missing_percentage FROM c", "min max mean missing_percentage", "total_rows missing"
)
Q["duplicate_rows"] = out(
    """SELECT series_id, sum(n - 1) AS duplicate_rows FROM (SELECT l_returnflag || l_linestatus AS series_id, count(*) AS n
 FROM lineitem GROUP BY l_returnflag, l_linestatus, CAST(l_shipdate AS DATE), l_quantity) GROUP BY series_id""",
    i="duplicate_rows",
)
Q["normalize_names"] = out(
    """SELECT o_orderpriority, count(*) AS orders, regexp_replace(trim(lower(o_orderpriority)), '[ .-]', '_', 'g') AS normalized
 FROM orders GROUP BY o_orderpriority""",
    i="orders",
)
Q["impute_linear"] = chain(PANEL, SPINE, IMPUTED) + out("SELECT * FROM imputed", ALL)
Q["fill_gaps"] = chain(PANEL, SPINE) + out(
    f"""SELECT series_id, date,
 last_value(temperature IGNORE NULLS) OVER ({BY_DATE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS temperature,
 first_value(precipitation IGNORE NULLS) OVER ({BY_DATE} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS precipitation
 FROM spine""",
    "temperature precipitation",
)

# -- order and features -------------------------------------------------------------------

SEASON = """CASE WHEN month(date) IN (12, 1, 2) THEN 'Winter' WHEN month(date) <= 5 THEN 'Spring'
 WHEN month(date) <= 8 THEN 'Summer' ELSE 'Autumn' END AS season"""
Q["temporal_features"] = chain(PANEL) + out(
    f"SELECT series_id, date, temperature, year(date) AS year, month(date) AS month, dayofyear(date) AS day_of_year, {SEASON} FROM panel",
    "temperature", "year month day_of_year",
)
_mas = [ma("temperature", w) for w in (7, 30, 365)] + [ma("precipitation", w) for w in (7, 30)]
MA_COLUMNS = "temperature_ma7 temperature_ma30 temperature_ma365 precipitation_ma7 precipitation_ma30"
Q["rolling_means"] = chain(PANEL, SPINE, IMPUTED) + out(
    f"SELECT series_id, date, temperature, precipitation, {', '.join(_mas)} FROM imputed",
    f"temperature precipitation {MA_COLUMNS}",
)
Q["rolling_by_row"] = chain(PANEL) + out(
    f"SELECT series_id, date, humidity, solar_radiation, {ma('humidity', 30)}, {ma('humidity', 365)}, {ma('solar_radiation', 30)} FROM panel",
    "humidity solar_radiation humidity_ma30 humidity_ma365 solar_radiation_ma30",
)
Q["rolling_strict"] = chain(PANEL) + out(
    f"SELECT series_id, date, temperature, {ma('temperature', 30, True)} FROM panel", "temperature temperature_ma30"
)
Q["rolling_suppliers"] = chain(SUPPLIER_PANEL) + out(
    f"SELECT series_id, date, temperature, {', '.join(ma('temperature', w) for w in (7, 30, 365))} FROM panel",
    "temperature temperature_ma7 temperature_ma30 temperature_ma365",
)


def lagged(table: str, extra: str) -> str:
    lags = ", ".join(f"lag(temperature, {k}) OVER ({BY_DATE}) AS l{k}" for k in (1, 7, 30))
    filled = ", ".join(
        f"coalesce(l{k}, first_value(l{k} IGNORE NULLS) OVER ({BY_DATE} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS temperature_lag{k}"
        for k in (1, 7, 30)
    )
    return f"SELECT {extra}, {filled} FROM (SELECT *, {lags} FROM {table})"


LAG_COLUMNS = "temperature_lag1 temperature_lag7 temperature_lag30"
Q["lag_features"] = chain(PANEL, SPINE) + out(
    lagged("spine", "series_id, date, temperature"), f"temperature {LAG_COLUMNS}"
)
Q["preprocess"] = chain(
    PANEL, IMPUTED.replace("FROM spine", "FROM panel"),
    f"featured AS (SELECT *, year(date) AS year, month(date) AS month, dayofyear(date) AS day_of_year, {SEASON}, {', '.join(_mas)} FROM imputed)",
) + out(
    lagged("featured", "* EXCLUDE (l1, l7, l30)"), f"{ALL} {MA_COLUMNS} {LAG_COLUMNS}", "year month day_of_year"
)
_engineered = f"year month day_of_year season {MA_COLUMNS} {LAG_COLUMNS}".split()
Q["engineered_catalogue"] = chain(
    PANEL, IMPUTED.replace("FROM spine", "FROM panel"),
    f"featured AS (SELECT *, year(date) AS year, month(date) AS month, dayofyear(date) AS day_of_year, {SEASON}, {', '.join(_mas)} FROM imputed)",
    f"laid AS ({lagged('featured', '* EXCLUDE (l1, l7, l30)')})",
) + " UNION ALL ".join(
    f"""SELECT '{'lag' if '_lag' in c else 'rolling' if '_ma' in c else 'temporal'}' AS kind, '{c}' AS column_name, count({c}) AS filled FROM laid"""
    for c in _engineered
)
Q["elapsed_days"] = chain(PANEL) + out(
    "SELECT series_id, date, temperature, date - min(date) OVER (PARTITION BY series_id) AS elapsed FROM panel",
    "temperature", "elapsed",
)
Q["row_positions"] = chain(PANEL, RANKED) + out(
    "SELECT series_id, date, y AS temperature, n AS _n, pos FROM obs", "temperature", "_n pos"
)
_placed = "SELECT p.*, o.pos, o.n FROM panel p JOIN obs o USING (series_id, date)"
Q["head_rows"] = chain(PANEL, RANKED) + out(f"SELECT * EXCLUDE (pos, n) FROM ({_placed}) WHERE pos < 100", ALL)
Q["tail_rows"] = chain(PANEL, RANKED) + out(f"SELECT * EXCLUDE (pos, n) FROM ({_placed}) WHERE pos >= n - 365", ALL)
Q["systematic_sample"] = chain(PANEL, RANKED) + out(
    f"SELECT * EXCLUDE (pos, n) FROM ({_placed}) WHERE pos % greatest(1, n // least(1000, n)) = 0", ALL
)
Q["thin_rows"] = chain(PANEL, RANKED) + out(
    f"SELECT * EXCLUDE (pos, n) FROM ({_placed}) WHERE pos % greatest(1, n // 365) = 0", ALL
)
Q["date_range"] = chain(PANEL) + out(
    "SELECT * FROM panel WHERE date BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'", ALL
)

# -- joins --------------------------------------------------------------------------------

Q["merge_sources"] = chain(ORDER_PANEL, STATUS_PANEL) + out(
    """SELECT series_id, date, coalesce(p.temperature, f.temperature) AS temperature, f.temperature_max, f.temperature_min,
 f.precipitation, f.humidity, f.solar_radiation, coalesce(p.wind_speed, f.wind_speed) AS wind_speed
 FROM order_panel p FULL OUTER JOIN status_panel f USING (series_id, date)""",
    ALL,
)
Q["merge_buckets"] = Q["merge_sources"]
_aligned = """SELECT series_id, date, s.temperature AS actual, o.temperature AS predicted
 FROM status_panel s JOIN order_panel o USING (series_id, date)"""
Q["align_sources"] = chain(ORDER_PANEL, STATUS_PANEL) + out(_aligned, "actual predicted")


def accuracy(source: str, by: str, a: str = "actual", p: str = "predicted") -> str:
    both = f"{a} IS NOT NULL AND {p} IS NOT NULL"
    return f"""SELECT {by}, count(*) FILTER ({both}) AS rows, coalesce(sqrt(avg(({a} - {p}) * ({a} - {p}))), 0) AS rmse,
 coalesce(avg(abs({a} - {p})), 0) AS mae, coalesce(avg(abs(({a} - {p}) / nullif({a}, 0))) * 100, 0) AS mape,
 coalesce(1 - sum(({a} - {p}) * ({a} - {p})) / nullif(var_pop({a}) FILTER ({both}) * count(*) FILTER ({both}), 0), 0) AS r_squared
 FROM ({source}) GROUP BY {by}"""


METRICS = "rmse mae mape r_squared"
Q["align_accuracy"] = chain(ORDER_PANEL, STATUS_PANEL) + out(accuracy(_aligned, "series_id"), METRICS, "rows")

# -- exploration --------------------------------------------------------------------------

Q["summary_statistics"] = chain(PANEL) + out(
    " UNION ALL ".join(
        f"""SELECT series_id, '{v}' AS variable, avg({v}) AS mean, stddev_samp({v}) AS std, min({v}) AS min, max({v}) AS max,
 count({v}) AS count, quantile_cont({v}, 0.25) AS q25, quantile_cont({v}, 0.5) AS median, quantile_cont({v}, 0.75) AS q75
 FROM panel GROUP BY series_id"""
        for v in VARS
    ),
    "mean std min max q25 median q75", "count",
)
_month = "series_id, year(date) AS year, month(date) AS month"
Q["monthly_aggregates"] = chain(PANEL) + out(
    f"SELECT {_month}, {', '.join(f'avg({v}) AS {v}' for v in VARS)} FROM panel GROUP BY ALL", ALL, "year month"
)
_feed = ("temperature", "precipitation", "humidity", "solar_radiation")
Q["monthly_feed"] = chain(PANEL) + out(
    f"SELECT {_month}, {', '.join(f'{disp(f"avg({v})", 2)} AS {v}' for v in _feed)} FROM panel GROUP BY ALL",
    " ".join(_feed), "year month",
)
_stats = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
Q["annual_aggregates"] = chain(PANEL) + out(
    "SELECT series_id, year(date) AS year, "
    + ", ".join(f"{fn}({v}) AS {v}_{s}" for v in VARS for s, fn in _stats.items())
    + " FROM panel GROUP BY ALL",
    " ".join(f"{v}_{s}" for v in VARS for s in _stats), "year",
)
Q["correlation"] = chain(PANEL) + out(
    " UNION ALL ".join(
        f"SELECT series_id, '{x}' AS var_x, '{y}' AS var_y, "
        f"{'1e0' if x == y else f'CASE WHEN var_samp({x}) > 0 AND var_samp({y}) > 0 THEN corr({x}, {y}) END'} AS corr FROM panel GROUP BY series_id"
        for x, y in [*permutations(CORE, 2), *((c, c) for c in CORE)]
    ),
    "corr",
)
Q["annual_trends"] = chain(
    PANEL,
    "a AS (SELECT series_id, year(date) AS year, avg(temperature) AS t, avg(precipitation) AS p FROM panel GROUP BY ALL)",
    "o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY year) - 1 AS k FROM a)",
) + out(
    """SELECT series_id, count(*) AS years, regr_slope(t, k) AS temperature_trend_per_year, regr_slope(p, k) AS precipitation_trend_per_year,
 regr_slope(t, k) * 10 AS temperature_trend_per_decade FROM o GROUP BY series_id HAVING count(*) >= 2""",
    "temperature_trend_per_year precipitation_trend_per_year temperature_trend_per_decade", "years",
)
MONTH_TOTALS = "mt AS (SELECT series_id, month(date) AS month, coalesce(sum(precipitation), 0) AS total FROM panel GROUP BY ALL)"
Q["month_totals"] = chain(PANEL, MONTH_TOTALS) + out("SELECT * FROM mt", "total", "month")
Q["top_months"] = chain(PANEL, MONTH_TOTALS) + out(
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY total DESC, month) AS rank FROM mt) WHERE rank <= 3",
    "total", "month rank",
)
Q["wet_days"] = chain(
    PANEL, MONTH_TOTALS, "pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY total DESC, month) AS r FROM mt) WHERE r = 1)"
) + out(
    """SELECT series_id, avg(precipitation) AS mean, max(precipitation) AS max, count(*) FILTER (precipitation > 1) AS wet_days,
 any_value(pk.month) AS peak_month, any_value(pk.total) AS peak_total FROM panel JOIN pk USING (series_id) GROUP BY series_id""",
    "mean max peak_total", "wet_days peak_month",
)
PROFILE = """mp AS (SELECT series_id, month(date) AS month, avg(temperature) AS mean, min(temperature) AS min, max(temperature) AS max,
 stddev_samp(temperature) AS std FROM panel GROUP BY ALL)"""
Q["month_profile"] = chain(PANEL, PROFILE) + out("SELECT * FROM mp", "mean min max std", "month")
Q["season_card"] = chain(PANEL, PROFILE) + out(
    """SELECT series_id, arg_max(month, mean) AS warmest_month, max(mean) AS warmest, arg_min(month, mean) AS coldest_month, min(mean) AS coldest,
 arg_max(month, std) AS most_variable_month, avg(mean) AS mean_of_months, max(mean) - min(mean) AS seasonal_range FROM mp GROUP BY series_id""",
    "warmest coldest mean_of_months seasonal_range", "warmest_month coldest_month most_variable_month",
)
Q["month_means"] = chain(PANEL, PROFILE) + out(
    """SELECT s.series_id, m.month, coalesce(mp.mean, 0) AS mean FROM (SELECT DISTINCT series_id FROM panel) s
 JOIN (SELECT unnest(range(1, 13)) AS month) m ON true LEFT JOIN mp ON mp.series_id = s.series_id AND mp.month = m.month""",
    "mean", "month",
)
Q["sketch_quantiles"] = chain(
    PANEL, "l AS (" + " UNION ALL ".join(f"SELECT series_id, date, '{v}' AS variable, {v} AS v FROM panel" for v in VARS) + ")"
) + out(
    """SELECT * FROM (SELECT series_id, variable, count(v) AS count, min(v) AS min, max(v) AS max FROM l
 WHERE year(date) BETWEEN 1993 AND 1996 GROUP BY ALL), (VALUES (0.25e0, true), (0.5e0, true), (0.75e0, true)) AS p(point, rank_holds)""",
    "min max", "count",
)
Q["box_statistics"] = chain(
    PANEL,
    "l AS ("
    + " UNION ALL ".join(
        f"SELECT series_id, month(date) AS month, '{v}' AS variable, {v} AS v FROM panel" for v in ("temperature", "precipitation", "humidity")
    )
    + ")",
    """b AS (SELECT series_id, month, variable, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
 FROM l GROUP BY ALL)""",
    "j AS (SELECT *, q1 - 1.5e0 * (q3 - q1) AS lo, q3 + 1.5e0 * (q3 - q1) AS hi FROM l JOIN b USING (series_id, month, variable))",
) + out(
    """SELECT series_id, month, variable, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
 least(min(v) FILTER (v BETWEEN lo AND hi), any_value(q1)) AS whisker_low, greatest(max(v) FILTER (v BETWEEN lo AND hi), any_value(q3)) AS whisker_high,
 count(*) FILTER (v < lo OR v > hi) AS outliers FROM j GROUP BY ALL""",
    "q1 median q3 whisker_low whisker_high", "month outliers",
)
_card = ("temperature", "humidity", "solar_radiation")
Q["range_card"] = chain(
    PANEL,
    "c AS (SELECT series_id, "
    + ", ".join(f"{fn}({v}) AS {v}_{s}" for v in _card for s, fn in (("mean", "avg"), ("max", "max"), ("min", "min"), ("std", "stddev_samp")))
    + " FROM panel GROUP BY series_id)",
    "r AS (SELECT *, " + ", ".join(f"{v}_max - {v}_min AS {v}_range" for v in _card) + " FROM c)",
) + out(
    """SELECT *, CASE WHEN temperature_std > 5 THEN 'wide' WHEN temperature_std > 3 THEN 'moderate' ELSE 'narrow' END AS temperature_spread,
 CASE WHEN humidity_std > 15 THEN 'significant' WHEN humidity_std > 10 THEN 'moderate' ELSE 'mild' END AS humidity_spread,
 CASE WHEN humidity_mean > 55 THEN 'monsoon-influenced' ELSE 'semi-arid' END AS humidity_regime,
 CASE WHEN solar_radiation_range > 10 THEN 'wide' WHEN solar_radiation_range > 6 THEN 'moderate' ELSE 'narrow' END AS solar_spread,
 CASE WHEN solar_radiation_max > 22 THEN 'high' WHEN solar_radiation_max > 18 THEN 'moderate' ELSE 'low' END AS solar_peak FROM r""",
    " ".join(f"{v}_{s}" for v in _card for s in ("mean", "max", "min", "std", "range")),
)
SPAN = """span AS (SELECT series_id, min(year(date)) AS analysis_start_year, max(year(date)) AS analysis_end_year,
 count(DISTINCT year(date)) AS total_years FROM panel GROUP BY series_id)"""
Q["analysis_span"] = chain(PANEL, SPAN) + out(
    "SELECT * FROM span", i="analysis_start_year analysis_end_year total_years"
)
HALVES = """halves AS (SELECT series_id, any_value(mid) AS mid_year, avg(precipitation) FILTER (year(date) <= mid) AS first_half_mean,
 avg(precipitation) FILTER (year(date) > mid) AS second_half_mean
 FROM panel JOIN (SELECT series_id, quantile_cont(CAST(year(date) AS DOUBLE), 0.5) AS mid FROM panel GROUP BY series_id) USING (series_id)
 GROUP BY series_id)"""
Q["half_period_contrast"] = chain(PANEL, HALVES) + out(
    "SELECT * FROM halves", "mid_year first_half_mean second_half_mean"
)


def histogram(source: str, v: str) -> str:
    return f"""SELECT series_id, bin, lo + (bin - 1) * (hi - lo) / 50 AS bin_start, lo + bin * (hi - lo) / 50 AS bin_end, count(*) AS rows FROM
 (SELECT series_id, lo, hi, least(coalesce(CAST(floor(({v} - lo) * 50 / nullif(hi - lo, 0)) AS BIGINT), 0) + 1, 50) AS bin FROM
 (SELECT series_id, {v}, min({v}) OVER (PARTITION BY series_id) AS lo, max({v}) OVER (PARTITION BY series_id) AS hi FROM ({source}) WHERE {v} IS NOT NULL))
 GROUP BY ALL"""


Q["value_histogram"] = chain(PANEL) + out(histogram("SELECT * FROM panel", "temperature"), "bin_start bin_end", "bin rows")

# -- anomalies ----------------------------------------------------------------------------

_z = " OR ".join(
    f"coalesce(abs(({v} - avg({v}) OVER p) / nullif(stddev_samp({v}) OVER p, 0)) > 2.5e0, false)" for v in CORE
)
FLAGGED = f"flagged AS (SELECT *, {_z} AS anomaly_zscore FROM panel WINDOW p AS (PARTITION BY series_id))"
Q["zscore_flags"] = chain(PANEL, FLAGGED) + out("SELECT * FROM flagged", ALL)
Q["iqr_flags"] = chain(
    PANEL,
    "q AS (SELECT series_id, quantile_cont(precipitation, 0.25) AS a, quantile_cont(precipitation, 0.75) AS b FROM panel GROUP BY series_id)",
) + out(
    """SELECT panel.*, precipitation < a - 1.5e0 * (b - a) OR precipitation > b + 1.5e0 * (b - a) AS anomaly_iqr
 FROM panel JOIN q USING (series_id)""",
    ALL,
)
Q["standard_scale"] = chain(PANEL) + out(
    "SELECT * REPLACE ("
    + ", ".join(
        f"({v} - avg({v}) OVER p) / CASE WHEN stddev_pop({v}) OVER p = 0 THEN 1 ELSE stddev_pop({v}) OVER p END AS {v}"
        for v in ("temperature", "humidity")
    )
    + ") FROM panel WINDOW p AS (PARTITION BY series_id)",
    ALL,
)
Q["threshold_band"] = chain(PANEL) + out(
    """SELECT series_id, avg(temperature) AS mean, stddev_samp(temperature) AS std, avg(temperature) + 2.5e0 * stddev_samp(temperature) AS upper,
 avg(temperature) - 2.5e0 * stddev_samp(temperature) AS lower FROM panel GROUP BY series_id""",
    "mean std upper lower",
)
ANOMALIES = f"""an AS (SELECT series_id, count(*) AS total_rows, count(*) FILTER (anomaly_zscore) AS total_anomaly_days,
 avg(temperature) FILTER (anomaly_zscore) AS anomaly_mean, max(temperature) FILTER (anomaly_zscore) AS anomaly_max,
 min(temperature) FILTER (anomaly_zscore) AS anomaly_min, avg(temperature) AS overall_mean,
 count(*) FILTER (anomaly_zscore) AS zscore_days, {disp('count(*) FILTER (anomaly_zscore) * 1e2 / count(*)', 2)} AS anomaly_percentage
 FROM flagged GROUP BY series_id)"""
Q["anomaly_summary"] = chain(PANEL, FLAGGED, ANOMALIES) + out(
    """SELECT *, total_rows - total_anomaly_days AS normal_days,
 greatest(abs(anomaly_max - overall_mean), abs(anomaly_min - overall_mean)) AS largest_deviation,
 CASE WHEN total_anomaly_days * 1e2 / total_rows > 5 THEN 'frequent' WHEN total_anomaly_days * 1e2 / total_rows > 2 THEN 'occasional'
 ELSE 'rare' END AS frequency FROM an""",
    "anomaly_mean anomaly_max anomaly_min overall_mean anomaly_percentage largest_deviation",
    "total_rows total_anomaly_days zscore_days normal_days",
)
Q["anomaly_days"] = chain(PANEL, FLAGGED) + out(
    f"""SELECT series_id, date, {disp('temperature', 2)} AS temperature, {disp('precipitation', 2)} AS precipitation
 FROM flagged WHERE anomaly_zscore""",
    "temperature precipitation",
)
Q["observed_span"] = chain(SUPPLIER_PANEL, FLAGGED) + out(
    f"""SELECT series_id, count(*) AS data_points, {disp('avg(temperature)', 2)} AS avg_temp, {disp('sum(precipitation)', 2)} AS total_precip,
 count(CASE WHEN anomaly_zscore THEN 1 END) AS anomaly_days, min(date) AS start, max(date) AS "end" FROM flagged GROUP BY series_id""",
    "avg_temp total_precip",
)
Q["station_rollup"] = chain(SUPPLIER_PANEL, FLAGGED) + out(
    f"""SELECT r.*, n_name || ', ' || r_name AS name FROM (SELECT series_id, {disp('avg(temperature)', 2)} AS avg_temp, sum(precipitation) AS total_precip,
 count(*) FILTER (anomaly_zscore) AS anomaly_days FROM flagged GROUP BY series_id) r
 LEFT JOIN (supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) ON CAST(s_suppkey AS VARCHAR) = series_id""",
    "avg_temp total_precip", "anomaly_days",
)

# -- trends -------------------------------------------------------------------------------


def p_value(t: str, dof: str) -> str:
    """Two-sided Student-t p-value as a finite trigonometric sum (integer degrees of freedom)."""
    c2 = f"({dof} / ({dof} + ({t}) * ({t})))"
    even = f"""list_sum([exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4)) * pow({c2}, k) FOR k IN range(0, {dof} // 2)])"""
    odd = f"""list_sum([exp(k * ln(4) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * pow({c2}, k) FOR k IN range(0, ({dof} - 1) // 2)])"""
    sine = f"(abs({t}) / sqrt({dof} + ({t}) * ({t})))"
    return f"""(1 - CASE WHEN {dof} % 2 = 0 THEN {sine} * {even}
 ELSE 2 / pi() * (atan(abs({t}) / sqrt({dof})) + {sine} * sqrt({c2}) * {odd}) END)"""


def fit(source: str, by: str, y: str, x: str) -> str:
    """OLS columns of y on x per group."""
    return f"""SELECT *, slope * 365.25e0 AS trend_per_year, slope * 3652.5e0 AS trend_per_decade, {p_value('tt', 'dof')} AS p_value FROM
 (SELECT *, slope / nullif(std_err, 0) AS tt, n - 2 AS dof FROM
 (SELECT *, sqrt((1 - r_squared) * syy / sxx / (n - 2)) AS std_err FROM
 (SELECT *, sxy / sqrt(sxx * syy) AS r_value, sxy * sxy / (sxx * syy) AS r_squared FROM
 (SELECT {by}, avg({y}) AS mean, regr_count({y}, {x}) AS n, regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept,
  regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy FROM ({source}) GROUP BY {by}))))"""


TREND_LONG = """days_in AS (SELECT *, date - min(date) OVER (PARTITION BY series_id) AS x FROM panel),
long AS (SELECT series_id, 'temperature' AS variable, x, temperature AS y FROM days_in
 UNION ALL SELECT series_id, 'precipitation', x, precipitation FROM days_in),
""" + f"trends AS ({fit('SELECT * FROM long', 'series_id, variable', 'y', 'x')})"
Q["linear_trend"] = chain(PANEL, TREND_LONG) + out(
    """SELECT series_id, variable, mean, n, slope, intercept, r_value, r_squared, std_err, trend_per_year, trend_per_decade,
 false AS degenerate, p_value FROM trends""",
    "mean slope intercept r_value r_squared std_err trend_per_year trend_per_decade p_value", "n", 8,
)
Q["trend_line"] = chain(PANEL, TREND_LONG) + out(
    """SELECT d.series_id, d.date, d.temperature, t.slope * d.x + t.intercept AS trend FROM days_in d
 JOIN trends t ON t.series_id = d.series_id AND t.variable = 'temperature'""",
    "temperature trend",
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CATALOGUE = "rules(type, category, severity, interpretation, recommended_action) AS (VALUES " + ", ".join(
    "(" + ", ".join(quoted(v) for v in (k, *row)) + ")" for k, row in texts.WARNINGS.items()
) + ")"
Q["trend_warnings"] = chain(
    PANEL, TREND_LONG, CATALOGUE,
    """weak AS (SELECT series_id, variable, 'NON_SIGNIFICANT' AS type, printf('%s trend is not statistically significant (p=%.4f > 0.05). Trend may be due to random variation.',
 upper(variable[1]) || variable[2:], p_value) AS details FROM trends WHERE p_value > 0.05
 UNION ALL SELECT series_id, variable, 'LOW_R2', printf('%s trend explains very little variance (R²=%.6f). Linear model may be inappropriate.',
 upper(variable[1]) || variable[2:], r_squared) FROM trends WHERE r_squared < 0.01)""",
) + "SELECT series_id, variable, type, category, severity, details, interpretation, recommended_action FROM weak JOIN rules USING (type)"
HISTORY = """hist AS (SELECT series_id, mean AS mean_value, trend_per_year AS hist_trend_per_year, trend_per_decade AS hist_trend,
 r_squared AS hist_r2, p_value AS hist_p FROM trends WHERE variable = 'temperature')"""
Q["historical_trend"] = chain(PANEL, TREND_LONG, HISTORY) + out(
    "SELECT * FROM hist", "mean_value hist_trend_per_year hist_trend hist_r2 hist_p", digits=8
)

# -- evaluation ---------------------------------------------------------------------------

FOLDS = """splits AS (SELECT DISTINCT series_id, n, CASE WHEN n < 1095 THEN greatest(1, (n - 730) // 365) ELSE 3 END AS k FROM obs),
starts AS (SELECT series_id, n, k, greatest(n - k * 365, 730) AS start FROM splits),
fold_list AS (SELECT series_id, n, start, unnest(range(0, k)) AS f FROM starts),
folds AS (SELECT series_id, CAST(f + 1 AS BIGINT) AS fold, start + f * 365 AS train_end, start + (f + 1) * 365 AS test_end
 FROM fold_list WHERE start + (f + 1) * 365 <= n)"""
Q["fold_split"] = chain(PANEL, RANKED, FOLDS) + out(
    """SELECT series_id, fold, count(*) FILTER (pos < train_end) AS train_rows, count(*) FILTER (pos >= train_end) AS test_rows,
 min(date) FILTER (pos < train_end) AS train_start, max(date) FILTER (pos < train_end) AS train_end,
 min(date) FILTER (pos >= train_end) AS test_start, max(date) FILTER (pos >= train_end) AS test_end
 FROM obs JOIN folds USING (series_id) WHERE pos < test_end GROUP BY series_id, fold""",
    i="train_rows test_rows",
)
WALK = "walk AS (" + accuracy(
    """SELECT series_id, fold, y AS actual, slope * pos + intercept AS predicted FROM obs JOIN folds USING (series_id) JOIN
 (SELECT series_id, fold, regr_slope(y, pos) AS slope, regr_intercept(y, pos) AS intercept FROM obs JOIN folds USING (series_id)
 WHERE pos < train_end GROUP BY series_id, fold) USING (series_id, fold) WHERE pos >= train_end AND pos < test_end""",
    "series_id, fold",
) + ")"
Q["walk_forward_linear"] = chain(PANEL, RANKED, FOLDS, WALK) + out("SELECT * FROM walk", METRICS, "fold rows")
WALK_SUMMARY = """walked AS (SELECT series_id, coalesce(n_folds, 0) AS n_folds, coalesce(avg_rmse, 0) AS avg_rmse, coalesce(avg_mae, 0) AS avg_mae,
 coalesce(avg_mape, 0) AS avg_mape, coalesce(avg_r_squared, 0) AS avg_r_squared, coalesce(std_rmse, 0) AS std_rmse, coalesce(std_mae, 0) AS std_mae
 FROM (SELECT DISTINCT series_id FROM panel) LEFT JOIN (SELECT series_id, count(*) AS n_folds, avg(rmse) AS avg_rmse, avg(mae) AS avg_mae,
 avg(mape) AS avg_mape, avg(r_squared) AS avg_r_squared, stddev_pop(rmse) AS std_rmse, stddev_pop(mae) AS std_mae FROM walk GROUP BY series_id)
 USING (series_id))"""
Q["walk_forward_summary"] = chain(PANEL, RANKED, FOLDS, WALK, WALK_SUMMARY) + out(
    "SELECT * FROM walked", "avg_rmse avg_mae avg_mape avg_r_squared std_rmse std_mae", "n_folds"
)
BASELINES = """cut AS (SELECT *, n - CASE WHEN n <= 730 THEN greatest(30, n // 4) ELSE 365 END AS nt FROM obs),
base AS (SELECT series_id, arg_max(y, pos) AS naive, regr_slope(y, pos) AS slope, regr_intercept(y, pos) AS intercept FROM cut WHERE pos < nt GROUP BY series_id),
wide AS (SELECT t.series_id, t.date, t.pos, t.y AS actual, b.naive, e.y AS seasonal_naive, b.slope * t.pos + b.intercept AS linear_trend
 FROM cut t JOIN base b USING (series_id) LEFT JOIN cut e ON e.series_id = t.series_id AND e.pos < e.nt
 AND e.pos = t.nt - least(365, t.nt) + (t.pos - t.nt) % least(365, t.nt) WHERE t.pos >= t.nt),
pred AS (SELECT series_id, date, pos, actual, 'naive' AS model, naive AS predicted, 1 AS ord FROM wide
 UNION ALL SELECT series_id, date, pos, actual, 'seasonal_naive', seasonal_naive, 2 FROM wide
 UNION ALL SELECT series_id, date, pos, actual, 'linear_trend', linear_trend, 3 FROM wide)"""
Q["baseline_predictions"] = chain(PANEL, RANKED, BASELINES) + out(
    "SELECT * EXCLUDE (ord) FROM pred", "actual predicted", "pos"
)
RANKING = "scored AS (" + accuracy("SELECT * FROM pred", "series_id, model, ord") + """),
ranking AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY rmse, ord) AS rank FROM scored)"""
Q["model_ranking"] = chain(PANEL, RANKED, BASELINES, RANKING) + out(
    "SELECT * EXCLUDE (ord) FROM ranking", METRICS, "rows rank"
)


def choice(primary: str, named: str) -> str:
    """The best model, and whether ``primary`` is kept."""
    return f"""choice0 AS (SELECT series_id, arg_min(model, rank) AS best_model, min(rmse) AS best_rmse,
 max(CASE WHEN model = '{primary}' THEN rmse END) AS primary_rmse FROM ranking GROUP BY series_id),
choice1 AS (SELECT *, NOT (best_model <> '{primary}' AND best_rmse < primary_rmse * 0.9e0) AS use_primary FROM choice0),
choice AS (SELECT *, CASE WHEN use_primary THEN printf('{named} selected (RMSE: %.3f). Comparable or superior to baseline models.', primary_rmse)
 ELSE printf('%s outperformed {named} (RMSE: %.3f vs %.3f). Consider alternative model for this dataset.',
 CASE best_model WHEN 'naive' THEN 'Naive' WHEN 'linear_trend' THEN 'Linear Trend' WHEN 'holt_winters' THEN 'Holt-Winters' ELSE 'Seasonal Naive' END,
 best_rmse, primary_rmse) END AS recommendation FROM choice1)"""


CHOICE = choice("seasonal_naive", "Seasonal Naive")
Q["model_choice"] = chain(PANEL, RANKED, BASELINES, RANKING, CHOICE) + out("SELECT * FROM choice", "best_rmse primary_rmse")
FITTED = f"fitted AS (SELECT *, lag(y, 365) OVER ({BY_DATE}) AS fit FROM obs)"
Q["residual_histogram"] = chain(PANEL, RANKED, FITTED) + out(
    histogram("SELECT series_id, y - fit AS residual FROM fitted", "residual"), "bin_start bin_end", "bin rows"
)
Q["residual_autocorrelation"] = chain(
    PANEL, RANKED,
    "c AS (SELECT series_id, pos, n, y - avg(y) OVER (PARTITION BY series_id) AS c FROM obs)",
    "lags AS (SELECT unnest(range(0, 61)) AS lag)",
    """s AS (SELECT a.series_id, lag, any_value(a.n) AS n, sum(a.c * b.c) AS s FROM c a JOIN lags ON true
 JOIN c b ON b.series_id = a.series_id AND b.pos = a.pos - lag GROUP BY ALL)""",
    "r AS (SELECT s.series_id, s.lag, s.n, s.s / z.s AS acf FROM s JOIN s z ON z.series_id = s.series_id AND z.lag = 0 WHERE s.lag <= least(60, s.n // 2 - 1))",
) + out(
    f"""SELECT series_id, n, lag, acf, CASE WHEN lag = 0 THEN 0 ELSE {NORMAL_975!r}e0 * sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN acf * acf END)
 OVER (PARTITION BY series_id ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END AS band FROM r""",
    "acf band", "n lag",
)


def horner(key: str, x: str) -> str:
    values = [f"{v!r}" if "e" in repr(v) else f"{v!r}e0" for v in AS241[key]]
    text = values[-1]
    for v in reversed(values[:-1]):
        text = f"({text} * {x} + {v})"
    return text


Q["quantile_pairs"] = chain(
    PANEL, RANKED,
    "r AS (SELECT series_id, y AS sample, row_number() OVER (PARTITION BY series_id ORDER BY y) AS rank, n FROM obs)",
    "p AS (SELECT *, CAST(rank AS DOUBLE) / (n + 1) AS p FROM r)",
    "u AS (SELECT *, p - 0.5e0 AS q, 0.180625e0 - (p - 0.5e0) * (p - 0.5e0) AS m, sqrt(-ln(least(p, 1 - p))) AS t FROM p)",
) + out(
    f"""SELECT series_id, rank, sample, CASE WHEN abs(q) <= 0.425e0 THEN q * {horner('a', 'm')} / {horner('b', 'm')}
 ELSE sign(q) * {horner('c', '(t - 1.6e0)')} / {horner('d', '(t - 1.6e0)')} END AS theoretical FROM u""",
    "sample theoretical", "rank",
)

# -- forecasts ----------------------------------------------------------------------------

SPREAD = "spread AS (SELECT series_id, stddev_samp(y - fit) AS residual_std, max(date) AS last_date FROM fitted GROUP BY series_id)"
STEPS = "h AS (SELECT unnest(range(1, 1096)) AS step)"
SEASONAL = f"""{STEPS},
steps AS (SELECT o.series_id, h.step, o.y AS forecast FROM h JOIN obs o ON o.pos = o.n - least(365, o.n) + (h.step - 1) % least(365, o.n))"""


def bounded(source: str) -> str:
    margin = "1.96e0 * residual_std * sqrt(step / 365.25e0)"
    return f"""SELECT series_id, CAST(last_date + CAST(step AS INTEGER) AS DATE) AS date, forecast, forecast + {margin} AS forecast_upper,
 forecast - {margin} AS forecast_lower FROM ({source}) JOIN spread USING (series_id)"""


BOUNDS = "forecast forecast_upper forecast_lower"
Q["naive_forecast"] = chain(PANEL, RANKED, FITTED, SPREAD, STEPS) + out(
    bounded("SELECT series_id, step, y AS forecast FROM obs JOIN h ON true WHERE pos = n - 1"), BOUNDS
)
Q["seasonal_naive_forecast"] = chain(PANEL, RANKED, FITTED, SPREAD, SEASONAL) + out(bounded("SELECT * FROM steps"), BOUNDS)
_straight = """SELECT series_id, step, slope * (n + step - 1) + intercept AS forecast FROM (SELECT series_id, max(n) AS n,
 regr_slope(y, pos) AS slope, regr_intercept(y, pos) AS intercept FROM obs GROUP BY series_id) JOIN h ON true"""
Q["linear_forecast"] = chain(PANEL, RANKED, FITTED, SPREAD, STEPS) + out(bounded(_straight), BOUNDS)
Q["forecast_feed"] = chain(PANEL, RANKED, FITTED, SPREAD, SEASONAL) + out(
    f"""SELECT series_id, date, {', '.join(f'{disp(b, 2)} AS {b}' for b in BOUNDS.split())} FROM
 (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i FROM ({bounded('SELECT * FROM steps')})) WHERE i % 3 = 0""",
    BOUNDS,
)
Q["daily_feed"] = chain(PANEL, RANKED) + out(
    f"""SELECT series_id, date, {', '.join(f'{disp(v, 2)} AS {v}' for v in CORE)} FROM ({_placed})
 WHERE pos % greatest(1, n // least(1000, n)) = 0""",
    " ".join(CORE),
)
Q["forecast_overlay"] = chain(PANEL, RANKED, FITTED, SPREAD, SEASONAL) + out(
    f"""SELECT series_id, date, 'history' AS kind, temperature AS value, CAST(NULL AS DOUBLE) AS forecast_upper, CAST(NULL AS DOUBLE) AS forecast_lower FROM panel
 UNION ALL SELECT series_id, date, 'forecast', forecast, forecast_upper, forecast_lower FROM ({bounded('SELECT * FROM steps')})""",
    "value forecast_upper forecast_lower",
)
AHEAD = "ahead AS (SELECT series_id, trend_per_year AS fc_trend_per_year, trend_per_decade AS fc_trend, r_squared AS fc_r2, p_value AS fc_p FROM (" + fit(
    "SELECT series_id, step - 1 AS x, forecast FROM steps", "series_id", "forecast", "x"
) + "))"
Q["forecast_trend"] = chain(PANEL, RANKED, SEASONAL, AHEAD) + out(
    "SELECT * FROM ahead", "fc_trend_per_year fc_trend fc_r2 fc_p", digits=8
)


def filled(template: str, *args: str) -> str:
    return f"printf({quoted(template)}, {', '.join(args)})"


def listed(*rules: tuple[str, str]) -> str:
    """Texts whose condition holds, as a list in order."""
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in rules) + "], lambda x: x IS NOT NULL)"


_issue = texts.QUALITY_ISSUES
CHECKS = f"""bounds_rows AS ({bounded('SELECT * FROM steps')}),
shape AS (SELECT series_id, count(*) - count(forecast) AS missing_values, min(forecast) AS fc_min, max(forecast) AS fc_max, avg(forecast) AS fc_mean,
 count(*) FILTER (forecast_upper < forecast_lower) AS invalid_intervals, avg(forecast_upper - forecast_lower) AS mean_width FROM bounds_rows GROUP BY series_id),
checked AS (SELECT *, coalesce(abs((fc_mean - mean_value) / nullif(mean_value, 0)), 0) * 100 AS mean_deviation_pct, abs(fc_trend / nullif(hist_trend, 0)) AS q_ratio
 FROM shape JOIN hist USING (series_id) JOIN ahead USING (series_id)),
checks AS (SELECT *, {listed(
    ('missing_values > 0', filled(_issue['missing'], 'missing_values')),
    ('fc_min < -50 OR fc_max > 60', filled(_issue['range'], 'fc_min', 'fc_max', '-50e0', '60e0')),
    ('abs(fc_trend) > 10', filled(_issue['slope'], 'fc_trend')),
    ('invalid_intervals > 0', filled(_issue['interval'], 'invalid_intervals')),
    ('mean_width > 20', filled(_issue['width'], 'mean_width')),
    ('mean_deviation_pct > 20', filled(_issue['mean'], 'fc_mean', 'mean_deviation_pct', 'mean_value')),
    ('q_ratio > 6', filled(_issue['ratio'], 'q_ratio')),
)} AS quality_issues FROM checked)"""
_FORECAST = (PANEL, TREND_LONG, HISTORY, RANKED, FITTED, SPREAD, SEASONAL, AHEAD, CHECKS)
Q["forecast_quality"] = chain(*_FORECAST) + out(
    """SELECT series_id, missing_values, fc_min, fc_max, fc_mean, invalid_intervals, mean_width, mean_deviation_pct,
 array_to_string(quality_issues, ' | ') AS quality_issues, len(quality_issues) = 0 AS quality_passed FROM checks""",
    "fc_min fc_max fc_mean mean_width mean_deviation_pct", "missing_values invalid_intervals",
)
IN_SAMPLE = "in_sample AS (" + accuracy("SELECT series_id, y AS actual, fit AS predicted FROM fitted", "series_id") + ")"
SUMMARY = """summary AS (SELECT *, coalesce(abs(fc_trend / nullif(hist_trend, 0)), CAST('inf' AS DOUBLE)) AS trend_ratio,
 coalesce(abs(hist_trend / nullif(hist_trend, 0)), CAST('inf' AS DOUBLE)) AS linear_ratio
 FROM checks JOIN in_sample USING (series_id) JOIN walked USING (series_id) JOIN choice USING (series_id))"""


def closeness(error: str, undefined: str) -> str:
    return f"greatest(0e0, coalesce(1 - {error} * 1e2 / nullif(abs(mean_value), 0) / 2e1, {undefined}))"


def factors(p: str, ratio: str, r2: str, pv: str, issues: str, keep: str) -> str:
    return f"""CASE WHEN {ratio} >= 1 THEN greatest(0e0, 1 - ({ratio} - 1) / 2) ELSE 1e0 END AS {p}_consistency,
 least(1e0, {r2} / 0.5e0) AS {p}_r_squared, {closeness('rmse', '0e0')} AS {p}_rmse_accuracy, CASE WHEN {pv} < 0.05 THEN 1e0 ELSE 0.5e0 END AS {p}_significance,
 CASE WHEN n_folds > 0 THEN (least(greatest(avg_r_squared / 0.5e0, 0e0), 1e0) + {closeness('avg_rmse', '0.5e0')}) / 2 ELSE 0.5e0 END AS {p}_validation,
 greatest(0e0, 1 - {issues} * 0.25e0) AS {p}_quality, CASE WHEN {keep} THEN 0.8e0 ELSE 0.4e0 END AS {p}_benchmark"""


WEIGHTS = {"consistency": 0.2, "r_squared": 0.15, "rmse_accuracy": 0.15, "significance": 0.1, "validation": 0.2, "quality": 0.1, "benchmark": 0.1}


def weighted(p: str) -> str:
    return "round(" + " + ".join(f"{p}_{k} * {w}e0" for k, w in WEIGHTS.items()) + f", 3) AS {p}_score"


def label(score: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {limit} THEN '{name}'" for limit, name in texts.RELIABILITY[:-1]) + " ELSE 'Exploratory' END"


_why = texts.FORECAST_REASONS


def reasons(ratio: str, r2: str, trend: str, issues: str) -> str:
    checks = listed(
        ("avg_rmse > 5", filled(_why["validation_rmse"], "avg_rmse")),
        ("avg_r_squared < 0", filled(_why["validation_r2"], "avg_r_squared")),
    )
    others = listed(
        (f"{ratio} > 3", filled(_why["ratio"], ratio, "3e0")),
        (f"{r2} < 0.1", filled(_why["low_r2"], r2)),
        (f"hist_trend <> 0 AND {trend} <> 0 AND (hist_trend > 0) <> ({trend} > 0)", quoted(_why["direction"])),
    )
    return f"list_concat(list_concat({checks}, [printf('Quality check failed: %s', i) FOR i IN {issues}]), {others})"


def kind(score: str, why: str, issues: str) -> str:
    return f"""CASE WHEN {score} >= 0.6 AND len({why}) = 0 THEN 'reliable'
 WHEN {score} >= 0.4 AND NOT (avg_rmse > 5 OR avg_r_squared < 0) AND len({issues}) = 0 THEN 'low_confidence' ELSE 'exploratory' END"""


_action = "CASE forecast_class " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in texts.FORECAST_ACTIONS.items()) + " END"
_pick = "CASE WHEN used_linear_fallback THEN {} ELSE {} END AS {}"
ASSESSED = f"""a0 AS (SELECT *, {factors('p', 'trend_ratio', 'fc_r2', 'fc_p', 'len(quality_issues)', 'use_primary')},
 {factors('l', 'linear_ratio', 'hist_r2', 'hist_p', '0', 'false')} FROM summary),
a1 AS (SELECT *, {weighted('p')}, {weighted('l')}, {reasons('trend_ratio', 'fc_r2', 'fc_trend', 'quality_issues')} AS p_why,
 {reasons('linear_ratio', 'hist_r2', 'hist_trend', "list_filter([''], lambda x: x <> '')")} AS l_why FROM a0),
a2 AS (SELECT *, {kind('p_score', 'p_why', 'quality_issues')} AS p_class, {kind('l_score', 'l_why', "list_filter([''], lambda x: x <> '')")} AS l_class FROM a1),
a3 AS (SELECT *, p_class = 'exploratory' AND linear_ratio < trend_ratio AS used_linear_fallback FROM a2),
a4 AS (SELECT *, {_pick.format('l_score', 'p_score', 'score')}, {_pick.format('l_class', 'p_class', 'forecast_class')}, {_pick.format('l_why', 'p_why', 'why')},
 {_pick.format('hist_trend', 'fc_trend', 'original')}, {_pick.format('hist_trend_per_year', 'fc_trend_per_year', 'per_year')},
 {_pick.format('hist_r2', 'fc_r2', 'tr2')}, {_pick.format('hist_p', 'fc_p', 'tp')}, {_pick.format('linear_ratio', 'trend_ratio', 'ratio')},
 {', '.join(_pick.format('l_' + k, 'p_' + k, 'f_' + k) for k in WEIGHTS)} FROM a3),
a5 AS (SELECT *, ratio > 3 AND hist_trend <> 0 AS damp, CASE WHEN ratio > 3 THEN 3 / ratio ELSE 1e0 END AS factor FROM a4),
assessed AS (SELECT *, CASE WHEN damp THEN original * factor ELSE original END AS per_decade,
 CASE WHEN damp THEN original * factor / 10 ELSE per_year END AS a_year, {_action} AS action FROM a5)"""
_ASSESS = (*_FORECAST, FOLDS, WALK, WALK_SUMMARY, BASELINES, RANKING, CHOICE, IN_SAMPLE, SUMMARY, ASSESSED)
Q["reliability_score"] = chain(*_ASSESS) + out(
    f"""SELECT series_id, trend_ratio, p_score AS primary_score, score AS reliability_score, {label('score')} AS reliability_label,
 {', '.join(f'round(f_{k}, 3) AS {k}' for k in WEIGHTS)} FROM assessed""",
    f"trend_ratio primary_score reliability_score {' '.join(WEIGHTS)}",
)
Q["forecast_class"] = chain(*_ASSESS) + out(
    """SELECT series_id, p_class AS primary_class, used_linear_fallback, forecast_class, array_to_string(why, ' | ') AS classification_reasons,
 action AS recommended_action, round(ratio, 3) AS trend_consistency_ratio, damp AS trend_dampening_applied, factor AS dampening_factor,
 original AS original_trend_per_decade, per_decade AS trend_per_decade, a_year AS trend_per_year FROM assessed""",
    "trend_consistency_ratio dampening_factor original_trend_per_decade trend_per_decade trend_per_year",
)

# -- KPIs and rules -----------------------------------------------------------------------


def risk(source: str) -> str:
    """Risk columns appended to a source with the four inputs."""
    return f"""SELECT *, CASE WHEN risk_score >= 0.75 THEN 'Very High' WHEN risk_score >= 0.5 THEN 'High' WHEN risk_score >= 0.25 THEN 'Moderate'
 ELSE 'Low' END AS risk_category FROM (SELECT *, least(greatest(raw_score * least(greatest(forecast_factor, 0.8e0), 1.2e0), 0e0), 1e0) AS risk_score FROM
 (SELECT *, 0.4e0 * temp_trend_metric + 0.3e0 * rainfall_metric + 0.3e0 * anomaly_metric AS raw_score FROM
 (SELECT *, least(greatest(warming_rate_per_decade / 0.5e0, 0e0), 1e0) AS temp_trend_metric,
 least(greatest(coalesce(abs(second_half_mean - first_half_mean) / nullif(first_half_mean, 0), 0) / 0.5e0, 0e0), 1e0) AS rainfall_metric,
 least(greatest(anomaly_percentage / 1e1, 0e0), 1e0) AS anomaly_metric,
 CASE WHEN trend_consistency_ratio > 2 THEN 1.15e0 WHEN trend_consistency_ratio > 1.5 THEN 1.05e0 ELSE 1e0 END AS forecast_factor FROM ({source}))))"""


RISK_COLUMNS = "temp_trend_metric rainfall_metric anomaly_metric forecast_factor raw_score risk_score"
Q["risk_score"] = chain(PANEL, FLAGGED, ANOMALIES, HALVES, TREND_LONG) + out(
    risk(
        f"""SELECT series_id, anomaly_percentage, first_half_mean, second_half_mean, {disp('trend_per_decade', 3)} AS warming_rate_per_decade,
 1e0 AS trend_consistency_ratio FROM an JOIN halves USING (series_id) JOIN trends USING (series_id) WHERE variable = 'temperature'"""
    ),
    f"anomaly_percentage first_half_mean second_half_mean warming_rate_per_decade trend_consistency_ratio {RISK_COLUMNS}",
)
_same, _differs = texts.CONSISTENCY
KPIS = f"""averages AS (SELECT series_id, {disp('avg(temperature)', 2)} AS avg_temperature, {disp('max(temperature)', 2)} AS max_temperature,
 {disp('min(temperature)', 2)} AS min_temperature, {disp('avg(precipitation)', 2)} AS avg_precipitation FROM panel GROUP BY series_id),
kpi0 AS (SELECT series_id, avg_temperature, max_temperature, min_temperature, avg_precipitation, {disp('h.hist_trend', 3)} AS warming_rate_per_decade,
 h.hist_trend AS warming_rate_raw, {disp('h.hist_r2', 4)} AS historical_trend_r_squared, h.hist_p AS historical_trend_p_value, total_anomaly_days AS anomaly_days, anomaly_percentage,
 {disp('per_decade', 3)} AS forecast_trend_per_decade, {disp('tr2', 4)} AS forecast_trend_r_squared, tp AS forecast_trend_p_value,
 round(ratio, 3) AS trend_consistency_ratio, {disp('h.hist_trend', 3)} AS historical_trend_per_decade, forecast_class, action AS recommended_action,
 {label('score')} AS forecast_reliability, score AS forecast_reliability_score, {disp('r_squared', 4)} AS model_r_squared, n_folds AS validation_n_folds,
 {disp('avg_rmse', 4)} AS validation_avg_rmse, {disp('avg_mae', 4)} AS validation_avg_mae, {disp('avg_mape', 4)} AS validation_avg_mape,
 {disp('avg_r_squared', 4)} AS validation_avg_r_squared, best_model AS benchmark_best_model, use_primary AS benchmark_use_hw,
 recommendation AS benchmark_recommendation, len(quality_issues) = 0 AS quality_checks_passed, rmse AS model_rmse, mae AS model_mae, mape AS model_mape,
 original AS original_trend_per_decade, damp AS trend_dampening_applied, 3 AS forecast_horizon_years, analysis_start_year, analysis_end_year, total_years,
 mid_year, first_half_mean, second_half_mean, 'PASS' AS data_quality_status
 FROM assessed JOIN hist h USING (series_id) JOIN averages USING (series_id) JOIN an USING (series_id) JOIN span USING (series_id) JOIN halves USING (series_id)),
kpis AS (SELECT *, historical_trend_p_value < 0.05 AS hist_significant,
 CASE WHEN historical_trend_p_value < 0.05 THEN '{texts.SIGNIFICANCE[0]}' ELSE '{texts.SIGNIFICANCE[1]}' END AS hist_sig_text,
 trend_consistency_ratio < 2 AS fc_consistent, CASE WHEN trend_consistency_ratio < 2 THEN {quoted(_same)}
 ELSE {filled(_differs, disp('trend_consistency_ratio', 2))} END AS fc_consistency_text FROM ({risk('SELECT * FROM kpi0')}))"""
_KPI = (*_ASSESS, FLAGGED, ANOMALIES, SPAN, HALVES, KPIS)
KPI_DOUBLES = (
    "avg_temperature max_temperature min_temperature avg_precipitation warming_rate_per_decade warming_rate_raw historical_trend_r_squared historical_trend_p_value "
    "anomaly_percentage forecast_trend_per_decade forecast_trend_r_squared forecast_trend_p_value trend_consistency_ratio historical_trend_per_decade "
    "forecast_reliability_score model_r_squared validation_avg_rmse validation_avg_mae validation_avg_mape validation_avg_r_squared model_rmse model_mae "
    f"model_mape original_trend_per_decade mid_year first_half_mean second_half_mean {RISK_COLUMNS}"
)
KPI_INTEGERS = "anomaly_days validation_n_folds forecast_horizon_years analysis_start_year analysis_end_year total_years"
Q["executive_kpis"] = chain(*_KPI) + out("SELECT * FROM kpis", KPI_DOUBLES, KPI_INTEGERS)


def banded(value: str, bands, sign: str) -> str:
    *inner, (_, last) = bands
    return "CASE " + " ".join(f"WHEN {value} {sign} {limit} THEN {quoted(t)}" for limit, t in inner) + f" ELSE {quoted(last)} END"


P_TEXT = banded("historical_trend_p_value", texts.P_BANDS, "<")
_cv = "(model_rmse * 1e2 / nullif(abs(avg_temperature), 0))"
_r = texts.RMSE_BANDS
_pr = texts.PRACTICAL
_name, _rate, _p, _r2 = "'temperature'", "warming_rate_per_decade", "historical_trend_p_value", "historical_trend_r_squared"
_share = f"{_r2} * 100"
_g = texts.FORECAST_GUIDANCE
Q["interpretations"] = chain(*_KPI) + f"""SELECT series_id, {banded(_r2, texts.R2_BANDS, '>')} AS r2_text, {P_TEXT} AS p_text,
 CASE WHEN {_cv} IS NULL THEN '{texts.RMSE_UNDEFINED}' WHEN {_cv} < 5 THEN {filled(_r[0][1], _cv)} WHEN {_cv} < 15 THEN {filled(_r[1][1], _cv)}
 ELSE {filled(_r[2][1], _cv)} END AS rmse_text,
 CASE WHEN {_r2} > 0.3 AND {_p} < 0.05 THEN 'High' WHEN {_r2} > 0.1 OR {_p} < 0.05 THEN 'Moderate' ELSE 'Low' END AS confidence_level,
 CASE WHEN {_p} >= 0.05 THEN {filled(_pr['none'], _name, _p)} WHEN {_r2} < 0.1 THEN {filled(_pr['weak'], _name, _p, _r2, _share)}
 WHEN abs({_rate}) < 0.1 THEN {filled(_pr['small'], _name, _rate, _share)} WHEN abs({_rate}) < 0.5 THEN {filled(_pr['moderate'], _name, _rate, _share)}
 ELSE {filled(_pr['substantial'], _name, _rate, _share)} END AS practical_text,
 concat_ws(' ', CASE WHEN trend_consistency_ratio > 2 THEN {quoted(_g['diverges'])} WHEN trend_consistency_ratio > 1.5 THEN {quoted(_g['moderate'])}
 ELSE {quoted(_g['consistent'])} END, CASE WHEN forecast_trend_r_squared < 0.1 THEN {quoted(_g['low_r2'])} END) AS forecast_guidance,
 hist_sig_text, fc_consistency_text FROM kpis"""


def rows_of(listing: str, text: str, extra: str = "") -> str:
    return f"""SELECT series_id, CAST(i - 1 AS BIGINT) AS position, items[i] AS {text}{extra} FROM
 (SELECT series_id, items, unnest(range(1, len(items) + 1)) AS i FROM (SELECT series_id, {listing} AS items FROM kpis))"""


_in = texts.INSIGHTS
_fc, _hist, _ratio = "forecast_trend_per_decade", "historical_trend_per_decade", "trend_consistency_ratio"
Q["insights"] = chain(*_KPI) + rows_of(
    listed(
        ("true", f"CASE WHEN warming_rate_raw > 0.2 THEN {filled(_in['strong_trend'], _rate, 'hist_sig_text', _r2, _p, P_TEXT)} "
                 f"ELSE {filled(_in['trend'], _rate, 'hist_sig_text', _r2, P_TEXT)} END"),
        ("true", filled(_in["precipitation"], "avg_precipitation")),
        ("true", filled(_in["anomalies"], "anomaly_days", disp("anomaly_percentage", 1))),
        ("true", f"CASE WHEN {_ratio} > 2 THEN {filled(_in['divergent'], 'forecast_horizon_years', _fc, disp(f'abs({_ratio} - 1) * 100', 0), _hist, 'forecast_trend_r_squared')} "
                 f"ELSE {filled(_in['consistent'], 'forecast_horizon_years', _fc, _hist, 'forecast_trend_r_squared')} END"),
    ),
    "insight",
)
_rec = {k: quoted(v) for k, v in texts.RECOMMENDATIONS.items()}
_high = "risk_category IN ('High', 'Very High')"
Q["recommendations"] = chain(*_KPI) + rows_of(
    listed(
        (f"{_high} AND hist_significant", _rec["high_confirmed"]),
        (_high, _rec["high_plans"]),
        (_high, _rec["high_invest"]),
        ("risk_category = 'Moderate'", _rec["moderate_monitor"]),
        ("risk_category = 'Moderate'", _rec["moderate_codes"]),
        ("risk_category = 'Low'", _rec["low_monitor"]),
        ("risk_category = 'Low'", _rec["low_maintain"]),
        ("NOT hist_significant", _rec["not_significant"]),
        (f"{_r2} < 0.1", _rec["low_r2"]),
        (f"{_ratio} > 2", _rec["divergent"]),
        (f"{_ratio} > 2", _rec["divergent_review"]),
        (f"{_ratio} > 1.5 AND {_ratio} <= 2", _rec["moderate_divergence"]),
        ("anomaly_percentage > 5", filled(texts.RECOMMENDATIONS["anomalies"], disp("anomaly_percentage", 1))),
        ("true", _rec["coverage"]),
        ("true", _rec["update"]),
    ),
    "recommendation",
    ", CASE WHEN i = 1 THEN 'High' WHEN i <= 3 THEN 'Medium' ELSE 'Low' END AS priority",
)
_cw, _rw = texts.CONSISTENCY_WARNINGS, texts.REPORT_WARNINGS
Q["consistency_warnings"] = chain(*_KPI) + "SELECT series_id, array_to_string(" + listed(
    (f"{_rate} <> 0 AND {_ratio} > 3", filled(_cw["divergence"], _fc, _rate, disp(_ratio, 2), "3e0")),
    (f"{_rate} = 0 AND {_fc} <> 0", filled(_cw["zero_history"], _fc)),
    (f"{_high} AND anomaly_percentage < 2", filled(_cw["risk_high"], "risk_category", disp("anomaly_percentage", 1))),
    (f"{_rate} > 0.3 AND risk_score < 0.3", filled(_cw["risk_low_score"], _rate, "risk_score")),
    ("risk_category = 'Low' AND anomaly_percentage > 8", filled(_cw["low_risk_anomalies"], disp("anomaly_percentage", 1))),
    (f"{_high} AND {_p} > 0.05", filled(_cw["high_risk_trend"], "risk_category", _p)),
    (f"forecast_trend_r_squared < 0.1 AND {_ratio} > 2", filled(_cw["low_forecast_r2"], "forecast_trend_r_squared")),
    ("avg_temperature < -10 OR avg_temperature > 60", filled(_cw["implausible"], disp("avg_temperature", 1))),
) + ", ' | ') AS consistency_warnings, array_to_string(" + listed(
    ("trend_dampening_applied", filled(_rw["dampened"], "original_trend_per_decade", _fc)),
) + ", ' | ') AS report_warnings FROM kpis"
_dv = texts.DIVERGENCE
_pct = f"(abs({_fc} / nullif({_hist}, 0) - 1) * 100)"
Q["divergence_warnings"] = chain(
    PANEL, TREND_LONG, HISTORY, RANKED, SEASONAL, AHEAD, CATALOGUE,
    f"""pair AS (SELECT series_id, {disp('hist_trend', 3)} AS {_hist}, {disp('fc_trend', 3)} AS {_fc} FROM hist JOIN ahead USING (series_id))""",
) + f"""SELECT series_id, type, severity, details FROM
 (SELECT series_id, CASE WHEN {_pct} > 100 THEN 'TREND_DIVERGENCE' WHEN {_pct} > 50 THEN 'TREND_DIVERGENCE_MINOR' END AS type,
 CASE WHEN {_pct} > 100 THEN {filled(_dv['TREND_DIVERGENCE'], _hist, _fc, "'temperature'", _pct)}
 ELSE {filled(_dv['TREND_DIVERGENCE_MINOR'], _hist, _fc, "'temperature'", _pct)} END AS details FROM pair) JOIN rules USING (type)"""
Q["dashboard_labels"] = chain(*_KPI) + f"""SELECT series_id, CASE WHEN {_rate} > 0 THEN 'Increasing' WHEN {_rate} < 0 THEN 'Decreasing' ELSE 'Stable' END AS trend_direction,
 CASE WHEN quality_checks_passed THEN 'High' ELSE 'Moderate' END AS confidence_label,
 CASE WHEN forecast_trend_r_squared > 0.8 THEN 'Strong fit' WHEN forecast_trend_r_squared > 0.5 THEN 'Moderate fit' ELSE 'Weak fit' END AS fit_label,
 CASE WHEN avg_temperature >= 30 THEN '30+' WHEN avg_temperature >= 25 THEN '25-30' WHEN avg_temperature >= 20 THEN '20-25' ELSE '<20' END AS temperature_band,
 CASE WHEN anomaly_percentage > 5 THEN 'up' ELSE 'stable' END AS anomaly_direction FROM kpis"""

# -- exported feeds -----------------------------------------------------------------------

_SPANNED = f"""spanned AS (SELECT series_id, count(*) AS data_points, min(date) AS start, max(date) AS "end", {disp('avg(temperature)', 2)} AS avg_temp,
 {disp('sum(precipitation)', 2)} AS total_precip, count(*) FILTER (anomaly_zscore) AS days FROM flagged GROUP BY series_id)"""
Q["feed_dashboard_metrics"] = chain(*_KPI, _SPANNED) + out(
    'SELECT k.*, data_points, start, "end" FROM kpis k JOIN spanned USING (series_id)', KPI_DOUBLES, KPI_INTEGERS + " data_points"
)
Q["feed_regional_map"] = chain(*_KPI, _SPANNED) + out(
    """SELECT series_id, s.avg_temp, s.total_precip, s.days AS anomaly_days, risk_category,
 'Line ' || series_id AS name, length(series_id) * 1.5e0 AS lat, -length(series_id) * 2.5e0 AS lon FROM spanned s JOIN kpis USING (series_id)""",
    "avg_temp total_precip lat lon", "anomaly_days",
)
Q["feed_refresh"] = chain(PANEL) + out(
    f"""SELECT series_id, date, {', '.join(CORE)} FROM (SELECT * REPLACE (temperature + CASE WHEN series_id = 'RF' THEN 1 ELSE 0 END AS temperature)
 FROM panel)""",
    " ".join(CORE),
)
Q["feed_forecast"] = chain(*_ASSESS) + out(
    f"""SELECT series_id, forecast_class, array_to_string(why, ' | ') AS classification_reasons, action AS recommended_action,
 score AS reliability_score, {label('score')} AS reliability_label, per_decade AS trend_per_decade, tr2 AS trend_r_squared,
 round(ratio, 3) AS consistency_ratio, date, forecast, forecast_upper, forecast_lower FROM assessed JOIN (SELECT series_id, date,
 {', '.join(f'{disp(b, 2)} AS {b}' for b in BOUNDS.split())}, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i
 FROM bounds_rows) USING (series_id) WHERE i % 3 = 0""",
    f"reliability_score trend_per_decade trend_r_squared consistency_ratio {BOUNDS}",
)

# -- smoothing with fixed parameters ------------------------------------------------------

_a, _b, _c, _f = "0.3e0", "0.05e0", "0.2e0", "0.98e0"
SMOOTHED = f"""start AS (SELECT series_id, list(y ORDER BY pos) AS ys FROM obs WHERE pos < 14 GROUP BY series_id),
init AS (SELECT series_id, list_avg(ys[1:7]) AS level, (list_avg(ys[8:14]) - list_avg(ys[1:7])) / 7 AS slope,
 [v - list_avg(ys[1:7]) FOR v IN ys[1:7]] AS season FROM start),
run AS (SELECT series_id, CAST(-1 AS BIGINT) AS pos, level, slope, season, CAST(NULL AS DOUBLE) AS fitted FROM init
 UNION ALL
 SELECT r.series_id, o.pos,
  {_a} * (o.y - r.season[1]) + (1 - {_a}) * (r.level + {_f} * r.slope),
  {_b} * ({_a} * (o.y - r.season[1]) + (1 - {_a}) * (r.level + {_f} * r.slope) - r.level) + (1 - {_b}) * {_f} * r.slope,
  list_append(r.season[2:7], {_c} * (o.y - r.level - {_f} * r.slope) + (1 - {_c}) * r.season[1]),
  r.level + {_f} * r.slope + r.season[1]
 FROM run r JOIN obs o ON o.series_id = r.series_id AND o.pos = r.pos + 1)"""
Q["holt_winters_fixed"] = chain(PANEL, RANKED, SMOOTHED) + out(
    "SELECT series_id, pos, fitted FROM run WHERE pos >= 0", "fitted", "pos"
)
Q["holt_winters_fixed_forecast"] = chain(
    PANEL, RANKED, SMOOTHED, "last AS (SELECT r.* FROM run r JOIN (SELECT series_id, max(pos) AS pos FROM run GROUP BY series_id) USING (series_id, pos))"
) + out(
    f"""SELECT series_id, step, level + slope * {_f} * (1 - pow({_f}, step)) / (1 - {_f}) + season[(step - 1) % 7 + 1] AS forecast
 FROM last JOIN (SELECT unnest(range(1, 366)) AS step) ON true""",
    "forecast", "step",
)

# Every fit begins at the first reading, so the state behind its last one is its model.
def ahead_of(step: str) -> str:
    return f"level + slope * {_f} * (1 - pow({_f}, {step})) / (1 - {_f}) + season[({step} - 1) % 7 + 1]"


_smoothed_walk = f"""SELECT o.series_id, fold, y AS actual, {ahead_of('(o.pos - train_end + 1)')} AS predicted FROM obs o JOIN folds f USING (series_id)
 JOIN run r ON r.series_id = o.series_id AND r.pos = f.train_end - 1 WHERE o.pos >= train_end AND o.pos < test_end"""
SMOOTHED_WALK = f"walk AS ({accuracy(_smoothed_walk, 'series_id, fold')})"
SMOOTHED_FITTED = "fitted AS (SELECT o.*, r.fitted AS fit FROM obs o JOIN run r USING (series_id, pos))"
SMOOTHED_STEPS = f"""{STEPS},
steps AS (SELECT r.series_id, h.step, {ahead_of('h.step')} AS forecast FROM run r
 JOIN (SELECT series_id, max(n) - 1 AS pos FROM obs GROUP BY series_id) USING (series_id, pos) JOIN h ON true)"""
SMOOTHED_BASELINES = BASELINES.replace("pred AS (", "base_pred AS (") + f""",
pred AS (SELECT * FROM base_pred UNION ALL SELECT t.series_id, t.date, t.pos, t.y, 'holt_winters', {ahead_of('(t.pos - t.nt + 1)')}, 0
 FROM cut t JOIN run r ON r.series_id = t.series_id AND r.pos = t.nt - 1 WHERE t.pos >= t.nt)"""
_SMOOTHED_RUN = (
    PANEL, TREND_LONG, HISTORY, RANKED, SMOOTHED, SMOOTHED_FITTED, SPREAD, SMOOTHED_STEPS, AHEAD, CHECKS, FOLDS, SMOOTHED_WALK, WALK_SUMMARY,
    SMOOTHED_BASELINES, RANKING, choice("holt_winters", "Holt-Winters"), IN_SAMPLE, SUMMARY, ASSESSED,
)
Q["walk_forward_fixed"] = chain(PANEL, RANKED, SMOOTHED, FOLDS, SMOOTHED_WALK) + out("SELECT * FROM walk", METRICS, "fold rows")
Q["forecast_run_fixed"] = chain(*_SMOOTHED_RUN) + out(
    f"""SELECT r.* FROM ({bounded('SELECT * FROM steps')}) r JOIN assessed a USING (series_id) WHERE NOT a.used_linear_fallback
 UNION ALL SELECT r.* FROM ({bounded(_straight)}) r JOIN assessed a USING (series_id) WHERE a.used_linear_fallback""",
    BOUNDS,
)
Q["benchmark_fixed"] = chain(PANEL, RANKED, SMOOTHED, SMOOTHED_BASELINES, RANKING) + out(
    "SELECT * EXCLUDE (ord) FROM ranking", METRICS, "rows rank"
)
Q["forecast_summary_fixed"] = chain(*_SMOOTHED_RUN) + out(
    f"""SELECT series_id, rmse, mae, mape, r_squared, n_folds, avg_rmse, avg_mae, best_model, use_primary, recommendation, trend_ratio, p_class AS primary_class,
 p_score AS primary_score, used_linear_fallback, forecast_class, array_to_string(why, ' | ') AS classification_reasons, action AS recommended_action,
 score AS reliability_score, {label('score')} AS reliability_label, array_to_string(quality_issues, ' | ') AS quality_issues, damp AS trend_dampening_applied,
 per_decade AS trend_per_decade, tr2 AS trend_r_squared, false AS failed FROM assessed""",
    "rmse mae mape r_squared avg_rmse avg_mae trend_ratio primary_score reliability_score trend_per_decade trend_r_squared", "n_folds",
)

# The forest: trees level by level, then every row walks every tree.
FOREST_SEED, FOREST_TREES, FOREST_SAMPLE, PRIME = 42, 100, 256, 2147483647
HEIGHT = 8


def bits(text: str, start: int = 1) -> str:
    return f"CAST('0x' || substr(md5({text}), {start}, 13) AS BIGINT)"


def forest_ctes(source: str = "panel") -> str:
    k = range(len(CORE))
    ctes = [
        f"""complete AS (SELECT series_id, date, {', '.join(f'{c} AS f{j}' for j, c in enumerate(CORE))},
 {bits("concat_ws('|', series_id, CAST(date AS VARCHAR))")} % {PRIME} AS day FROM {source} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in CORE)})""",
        "lengths AS (SELECT series_id, count(*) AS n FROM complete GROUP BY series_id HAVING count(*) >= 10)",
        f"""orders AS (SELECT t AS tree, 1 + {bits(f"concat('{FOREST_SEED}|factor|', t)")} % {PRIME - 1} AS factor,
 {bits(f"concat('{FOREST_SEED}|offset|', t)")} % {PRIME} AS off FROM range({FOREST_TREES}) r(t))""",
        f"""level0 AS (SELECT series_id, tree, 1 AS node, greatest(1, ceil(log2(least(n, {FOREST_SAMPLE})))) AS height,
 {', '.join(f'f{j}' for j in k)} FROM complete JOIN lengths USING (series_id) CROSS JOIN orders
 QUALIFY row_number() OVER (PARTITION BY series_id, tree ORDER BY (factor * day + off) % {PRIME}, date) <= {FOREST_SAMPLE})""",
    ]
    for d in range(HEIGHT + 1):
        spans = ", ".join(f"min(f{j}) AS lo{j}, max(f{j}) AS hi{j}" for j in k)
        open_ = ", ".join(f"CASE WHEN hi{j} > lo{j} THEN {j} END" for j in k)
        seeded = f"concat_ws('|', '{FOREST_SEED}', series_id, tree, node)"
        ctes += [
            f"span{d} AS (SELECT series_id, tree, node, any_value(height) AS height, count(*) AS n, {spans} FROM level{d} GROUP BY series_id, tree, node)",
            f"""open{d} AS (SELECT *, list_filter([{open_}], lambda j: j IS NOT NULL) AS o FROM span{d})""",
            f"""pick{d} AS (SELECT *, CASE WHEN {d} < height AND n > 1 AND len(o) > 0
 THEN o[1 + CAST(floor({bits(seeded)} / 4503599627370496.0::DOUBLE * len(o)) AS INT)] ELSE -1 END AS feature,
 {bits(seeded, 14)} / 4503599627370496.0::DOUBLE AS u FROM open{d})""",
            f"""cut{d} AS (SELECT *, [{', '.join(f'lo{j}' for j in k)}][feature + 1] AS low, [{', '.join(f'hi{j}' for j in k)}][feature + 1] AS high FROM pick{d})""",
            f"""node{d} AS (SELECT series_id, tree, node, feature, CASE WHEN feature < 0 THEN {d} + CASE WHEN n > 2
 THEN 2 * (ln(n - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2 * (n - 1.0::DOUBLE) / n WHEN n = 2 THEN 1 ELSE 0 END
 WHEN low + u * (high - low) < high THEN low + u * (high - low) ELSE low END AS value FROM cut{d})""",
            f"""level{d + 1} AS (SELECT l.series_id, l.tree, 2 * l.node + CASE WHEN [{', '.join(f'f{j}' for j in k)}][feature + 1] > value THEN 1 ELSE 0 END AS node,
 height, {', '.join(f'f{j}' for j in k)} FROM level{d} l JOIN node{d} USING (series_id, tree, node) WHERE feature >= 0)""",
        ]
    ctes.append("nodes AS (" + " UNION ALL ".join(f"SELECT * FROM node{d}" for d in range(HEIGHT + 1)) + ")")
    xs = ", ".join(f"f{j}" for j in k)
    ctes.append(f"""walk0 AS (SELECT series_id, date, tree, [{xs}] AS x, feature, value, node FROM complete JOIN nodes USING (series_id) WHERE node = 1)""")
    for d in range(HEIGHT):
        ctes.append(f"""walk{d + 1} AS (SELECT w.series_id, w.date, w.tree, w.x, n.feature, n.value, n.node FROM walk{d} w JOIN nodes n
 ON n.series_id = w.series_id AND n.tree = w.tree
 AND n.node = CASE WHEN w.feature < 0 THEN w.node ELSE 2 * w.node + CASE WHEN w.x[w.feature + 1] > w.value THEN 1 ELSE 0 END END)""")
    ctes += [
        f"""scores AS (SELECT series_id, date, list_reduce(list(value ORDER BY tree), lambda p, q: p + q) AS depth FROM walk{HEIGHT} GROUP BY series_id, date)""",
        f"""sized AS (SELECT *, least(n, {FOREST_SAMPLE}) AS size FROM scores JOIN lengths USING (series_id))""",
        f"""scored AS (SELECT series_id, date, pow(2, -depth / ((2 * (ln(size - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2 * (size - 1.0::DOUBLE) / size) * {FOREST_TREES})) AS anomaly_score FROM sized)""",
        "cuts AS (SELECT series_id, quantile_cont(anomaly_score, 0.95) AS cut FROM scored GROUP BY series_id)",
        f"""forest AS (SELECT p.*, s.anomaly_score, coalesce(s.anomaly_score > c.cut, false) AS anomaly_iforest FROM {source} p
 LEFT JOIN scored s USING (series_id, date) LEFT JOIN cuts c USING (series_id))""",
    ]
    return ",\n".join(ctes)


Q["isolation_forest"] = chain(PANEL, forest_ctes()) + out("SELECT * FROM forest", ALL + " anomaly_score")

_BOTH_FLAGS = (
    FLAGGED,
    forest_ctes("flagged").replace("scored AS (", "forest_scored AS (").replace("JOIN scored", "JOIN forest_scored").replace("FROM scored", "FROM forest_scored"),
    "combined AS (SELECT * REPLACE (anomaly_zscore OR anomaly_iforest AS anomaly_zscore), anomaly_zscore AS z FROM forest)",
    ANOMALIES.replace("FROM flagged", "FROM combined").replace("count(*) FILTER (anomaly_zscore) AS zscore_days", "count(*) FILTER (z) AS zscore_days, count(*) FILTER (anomaly_iforest) AS iforest_days"),
)
Q["anomaly_pipeline"] = chain(PANEL, *_BOTH_FLAGS) + out(
    "SELECT * FROM an",
    "anomaly_mean anomaly_max anomaly_min overall_mean anomaly_percentage",
    "total_rows total_anomaly_days zscore_days iforest_days",
)

# The whole run: the smoothed forecast, both flags and the KPI row.
Q["pipeline_summary_fixed"] = chain(*_SMOOTHED_RUN, *_BOTH_FLAGS, SPAN, HALVES, KPIS) + out("SELECT * FROM kpis", KPI_DOUBLES, KPI_INTEGERS)

ORACLE = Q
