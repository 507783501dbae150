"""The registered queries in SQL for DuckDB, over the same given tables.

Where the library counts days by range frames, the SQL builds the date-complete panel
and counts rows, so the two reach a result by different ways.
"""

from __future__ import annotations

VALID, TEST, UNSEEN = "DATE '2001-08-01'", "DATE '2001-09-18'", "DATE '2001-11-05'"
VALID_END, TEST_END, SERVE_TO = "DATE '2001-09-17'", "DATE '2001-11-04'", "DATE '2001-12-22'"

LAGS = (49, 56, 63, 70, 77, 91)
ROLLS = ((7, 2), (14, 4), (28, 9), (91, 30))
SALES_FEATURES = [
    *[f"lag_{n}" for n in LAGS],
    *[f"{kind}_{w}" for w, _ in ROLLS for kind in ("roll_mean", "roll_std")],
    "roll_median_28", "trend_28_over_91", "open_rate_28", "dow_mean_4", "dow_ratio",
]

TABLES = f"""
WITH RECURSIVE sold AS (
  SELECT CAST(c_nationkey AS INT) AS Store, CAST(l_shipdate AS DATE) AS Date,
         SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS gross,
         COUNT(DISTINCT o_custkey) AS buyers
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2),
sold_days AS (
  SELECT *, CAST(isodow(Date) AS INT) AS dow,
         CAST(FLOOR((Date - DATE '1995-01-02') / 7.0) AS INT) AS wk,
         MONTH(Date) * 100 + DAY(Date) AS md
  FROM sold),
daily AS (
  SELECT Store, dow AS DayOfWeek, Date,
    CAST(CASE WHEN dow <> 7 THEN gross ELSE 0 END AS BIGINT) AS Sales,
    CAST(CASE WHEN dow <> 7 THEN buyers ELSE 0 END AS BIGINT) AS Customers,
    CASE WHEN dow <> 7 THEN 1 ELSE 0 END AS Open,
    CASE WHEN dow <= 5 AND (wk + Store) % 2 = 0 THEN 1 ELSE 0 END AS Promo,
    CASE WHEN md IN (101, 501, 1003) THEN 'a' WHEN md IN (413, 416) THEN 'b'
         WHEN md IN (1225, 1226) THEN 'c' ELSE '0' END AS StateHoliday,
    CASE WHEN md BETWEEN 701 AND 831 OR md >= 1223 THEN 1 ELSE 0 END AS SchoolHoliday
  FROM sold_days),
stores AS (
  SELECT CAST(n_nationkey AS INT) AS Store,
    SUBSTR('abcd', n_nationkey % 4 + 1, 1) AS StoreType,
    SUBSTR('abc', n_nationkey % 3 + 1, 1) AS Assortment,
    CASE WHEN n_nationkey % 8 <> 3
         THEN CAST(100 * (n_nationkey * n_nationkey + 1) AS DOUBLE) END AS CompetitionDistance,
    CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey % 12 + 1 END AS CompetitionOpenSinceMonth,
    CASE WHEN n_nationkey % 5 <> 0 THEN 1993 + n_nationkey % 9 END AS CompetitionOpenSinceYear,
    n_nationkey % 2 AS Promo2,
    CASE WHEN n_nationkey % 2 = 1 THEN 1 + (n_nationkey * 7) % 50 END AS Promo2SinceWeek,
    CASE WHEN n_nationkey % 2 = 1 THEN 1995 + n_nationkey % 5 END AS Promo2SinceYear,
    CASE WHEN n_nationkey % 2 = 0 THEN NULL WHEN n_nationkey % 3 = 0 THEN 'Jan,Apr,Jul,Oct'
         WHEN n_nationkey % 3 = 1 THEN 'Feb,May,Aug,Nov' ELSE 'Mar,Jun,Sep,Dec' END AS PromoInterval
  FROM nation),
calendar AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY Store, Date) AS BIGINT) AS Id, Store, DayOfWeek, Date,
    CASE WHEN Store = 6 AND DayOfWeek = 3 THEN NULL WHEN DayOfWeek <> 7 THEN 1 ELSE 0 END AS Open,
    CASE WHEN DayOfWeek <= 5 AND (wk + Store) % 2 = 0 THEN 1 ELSE 0 END AS Promo,
    '0' AS StateHoliday, CASE WHEN MONTH(Date) = 8 THEN 1 ELSE 0 END AS SchoolHoliday
  FROM (SELECT CAST(n_nationkey AS INT) AS Store, Date, CAST(isodow(Date) AS INT) AS DayOfWeek,
               CAST(FLOOR((Date - DATE '1995-01-02') / 7.0) AS INT) AS wk
        FROM nation CROSS JOIN (
          SELECT CAST(UNNEST(generate_series({UNSEEN}, {SERVE_TO}, INTERVAL 1 DAY)) AS DATE) AS Date) d
        WHERE n_nationkey % 4 <> 0) x)"""

HISTORY = """
history AS (
  SELECT Store, DayOfWeek, Date, Sales, Open, Promo, StateHoliday, SchoolHoliday FROM daily
  UNION ALL
  SELECT Store, DayOfWeek, Date, CAST(NULL AS BIGINT), COALESCE(Open, 1), Promo, StateHoliday,
         SchoolHoliday FROM calendar)"""


def split(date: str = "Date") -> str:
    return f"CASE WHEN {date} >= {TEST} THEN 'test' WHEN {date} >= {VALID} THEN 'valid' ELSE 'train' END"


def _days(table: str) -> str:
    return f"""
  SELECT Store, CAST(UNNEST(generate_series((SELECT MIN(Date) FROM {table}),
         (SELECT MAX(Date) FROM {table}), INTERVAL 1 DAY)) AS DATE) AS Date
  FROM (SELECT DISTINCT Store FROM {table})"""


PANEL = f"""
days AS ({_days('daily')}),
panel AS (
  SELECT g.Store, g.Date, CAST(isodow(g.Date) AS INT) AS DayOfWeek, d.Sales, d.Open, d.Promo,
         COALESCE(d.StateHoliday, '0') AS StateHoliday, COALESCE(d.SchoolHoliday, 0) AS SchoolHoliday,
         d.Sales IS NULL AS is_gap, {split('g.Date')} AS split
  FROM days g LEFT JOIN daily d ON g.Store = d.Store AND g.Date = d.Date)"""

EXTENDED = f"""{HISTORY},
xdays AS ({_days('history')}),
xpanel AS (
  SELECT g.Store, g.Date, CAST(isodow(g.Date) AS INT) AS DayOfWeek, d.Sales,
         COALESCE(d.Open, 0) AS Open, COALESCE(d.Promo, 0) AS Promo,
         COALESCE(d.StateHoliday, '0') AS StateHoliday, COALESCE(d.SchoolHoliday, 0) AS SchoolHoliday,
         d.Store IS NULL AS is_gap
  FROM xdays g LEFT JOIN history d ON g.Store = d.Store AND g.Date = d.Date)"""


def sales_features(panel: str, name: str) -> str:
    """Lags and rolling statistics by rows of a date-complete panel."""
    columns = [f"LAG(so, {n}) OVER s AS lag_{n}" for n in LAGS]
    for w, least in ROLLS:
        frame = f"OVER (s ROWS BETWEEN {47 + w} PRECEDING AND 48 PRECEDING)"
        enough = f"COUNT(so) {frame} >= {least}"
        columns.append(f"CASE WHEN {enough} THEN AVG(so) {frame} END AS roll_mean_{w}")
        columns.append(f"CASE WHEN {enough} THEN STDDEV_SAMP(so) {frame} END AS roll_std_{w}")
    frame = "OVER (s ROWS BETWEEN 75 PRECEDING AND 48 PRECEDING)"
    columns.append(f"CASE WHEN COUNT(so) {frame} >= 9 THEN MEDIAN(so) {frame} END AS roll_median_28")
    columns.append(f"CASE WHEN COUNT(Open) {frame} >= 9 THEN AVG(Open) {frame} END AS open_rate_28")
    frame = "OVER (w ROWS BETWEEN 10 PRECEDING AND 7 PRECEDING)"
    columns.append(f"CASE WHEN COUNT(so) {frame} >= 2 THEN AVG(so) {frame} END AS dow_mean_4")
    return f"""
{name} AS (
  SELECT *, roll_mean_28 / NULLIF(roll_mean_91, 0) AS trend_28_over_91,
         dow_mean_4 / NULLIF(roll_mean_28, 0) AS dow_ratio
  FROM (SELECT *, {', '.join(columns)}
        FROM (SELECT *, CASE WHEN Open = 1 THEN Sales END AS so FROM {panel})
        WINDOW s AS (PARTITION BY Store ORDER BY Date),
               w AS (PARTITION BY Store, DayOfWeek ORDER BY Date)))"""


def promo_features(panel: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT *, CASE WHEN Promo = 1 AND promo_prev_day = 0 THEN 1 ELSE 0 END AS promo_first_day,
            CASE WHEN Promo = 1 AND promo_next_day = 0 THEN 1 ELSE 0 END AS promo_last_day
  FROM (SELECT *, COALESCE(LAG(Promo, 1) OVER s, 0) AS promo_prev_day,
               COALESCE(LEAD(Promo, 1) OVER s, 0) AS promo_next_day,
               COALESCE(LAG(Promo, 7) OVER s, 0) AS promo_lag7,
               COALESCE(LAG(Promo, 14) OVER s, 0) AS promo_lag14,
               CAST(COALESCE(SUM(Promo) OVER (s ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 0) AS BIGINT)
                 AS promo_count_14d
        FROM {panel} WINDOW s AS (PARTITION BY Store ORDER BY Date)))"""


STORE_PARTS = """
far AS (SELECT 2 * MAX(CompetitionDistance) AS far FROM stores
        WHERE Store IN (SELECT Store FROM daily)),
attributes AS (
  SELECT *, LN(1 + COALESCE(CompetitionDistance, far)) AS competition_distance_log,
    CASE WHEN CompetitionDistance IS NULL THEN 1 ELSE 0 END AS competition_distance_missing,
    make_date(CompetitionOpenSinceYear, CompetitionOpenSinceMonth, 1) AS opened,
    make_date(Promo2SinceYear, 1, 1)
      + CAST((8 - isodow(make_date(Promo2SinceYear, 1, 1))) % 7 + 7 * (Promo2SinceWeek - 1) AS INT)
      AS joined
  FROM stores, far)"""

PROGRAMME = """
CASE WHEN Promo2 = 1 AND Date >= joined THEN 1 ELSE 0 END"""

MEDIANS = """
SELECT Store, DayOfWeek, MEDIAN(Sales) AS m FROM daily
WHERE Open = 1 AND Date < {cut} AND Date >= {cut} - {days} GROUP BY 1, 2"""
STORE_MEDIANS = "SELECT Store, MEDIAN(Sales) AS fb FROM daily WHERE Open = 1 AND Date < {cut} GROUP BY 1"
WEEK = """
SELECT Store, DayOfWeek, AVG(Sales) AS t FROM daily
WHERE Date < {cut} AND Date >= {cut} - 7 GROUP BY 1, 2"""


def forecasts(name: str, cut: str, last: str) -> str:
    """The three baselines on one window, side by side."""
    return f"""
{name} AS (
  SELECT d.*, CASE WHEN d.Open = 0 THEN 0.0 ELSE COALESCE(CAST(p.Sales AS DOUBLE), 0.0) END AS lag7_rolling,
         CASE WHEN d.Open = 0 THEN 0.0 ELSE COALESCE(t, 0.0) END AS last_week_tiled,
         CASE WHEN d.Open = 0 THEN 0.0 ELSE COALESCE(m, fb, 0.0) END AS weekday_median_4w
  FROM daily d LEFT JOIN daily p ON d.Store = p.Store AND d.Date = p.Date + 7
  LEFT JOIN ({WEEK.format(cut=cut)}) w ON d.Store = w.Store AND d.DayOfWeek = w.DayOfWeek
  LEFT JOIN ({MEDIANS.format(cut=cut, days=28)}) q ON d.Store = q.Store AND d.DayOfWeek = q.DayOfWeek
  LEFT JOIN ({STORE_MEDIANS.format(cut=cut)}) f ON d.Store = f.Store
  WHERE d.Date BETWEEN {cut} AND {last})"""


def long(name: str, columns=("lag7_rolling", "last_week_tiled", "weekday_median_4w")) -> str:
    return " UNION ALL ".join(
        f"SELECT Store, Date, Sales, Open, Promo, '{c}' AS label, {c} AS pred FROM {name}" for c in columns
    )


TEST_LONG = f"""{forecasts('ft', TEST, TEST_END)},
test_long AS ({long('ft')})"""
BOTH_LONG = f"""{forecasts('fv', VALID, VALID_END)}, {forecasts('ft', TEST, TEST_END)},
both_long AS (SELECT 'valid' AS split, * FROM ({long('fv')})
              UNION ALL SELECT 'test', * FROM ({long('ft')}))"""


def metrics(mask: str = "Open = 1", digits: int | None = 4) -> str:
    def r(expr: str) -> str:
        return expr if digits is None else f"ROUND({expr}, {digits})"

    return f"""
COUNT(*) FILTER (WHERE {mask}) AS n_scored,
{r(f"SQRT(AVG(POW((Sales - pred) / 100.0, 2)) FILTER (WHERE {mask}))")} AS rmse,
{r(f"AVG(ABS(Sales - pred) / Sales) FILTER (WHERE {mask} AND Sales > 0) * 100")} AS mape,
{r(f"SUM(ABS(Sales - pred)) FILTER (WHERE {mask}) / SUM(Sales) FILTER (WHERE {mask}) * 100")} AS wape"""


SCORES = f"""{BOTH_LONG},
scores AS (SELECT split, label, {metrics(digits=None)} FROM both_long GROUP BY 1, 2)"""


def sql(*ctes: str, body: str) -> str:
    return ",".join([TABLES, *ctes]) + "\n" + body


def unpivot(source: str, pairs: list[tuple[str, str]], key: str, value: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS {key}, {v} AS {value} FROM {source}" for k, v in pairs)


OBSERVED = "WHERE NOT is_gap"


def _panel_queries() -> dict[str, str]:
    columns = """p.Store, p.Date, p.DayOfWeek, p.Sales, p.Open, p.Promo, p.StateHoliday,
                 p.SchoolHoliday, p.is_gap, s.StoreType, s.Assortment"""
    return {
        "panel_complete": sql(
            PANEL, body=f"SELECT {columns} FROM panel p LEFT JOIN stores s ON p.Store = s.Store"
        ),
        "panel_extended": sql(
            EXTENDED, body=f"SELECT {columns} FROM xpanel p LEFT JOIN stores s ON p.Store = s.Store"
        ),
        "history_with_future": sql(HISTORY, body="SELECT * FROM history"),
        "panel_summary": sql(
            PANEL,
            body="""SELECT split, COUNT(*) AS panel_rows, COUNT(*) FILTER (WHERE is_gap) AS gap_rows,
              COUNT(*) FILTER (WHERE NOT is_gap) AS rows,
              CAST(SUM(Open) FILTER (WHERE NOT is_gap) AS BIGINT) AS open_rows,
              MIN(Date) FILTER (WHERE NOT is_gap) AS first, MAX(Date) FILTER (WHERE NOT is_gap) AS last
              FROM panel GROUP BY 1""",
        ),
        "modelling_frame": sql(
            PANEL,
            body="""SELECT Store, Date, Sales, Open, Promo, StateHoliday, SchoolHoliday, DayOfWeek, split
              FROM panel WHERE NOT is_gap""",
        ),
        "split_windows": sql(
            f"""e AS (SELECT MAX(Date) AS hi, MIN(Date) AS lo FROM daily),
            w AS (SELECT 'train' AS split, lo AS first, hi - 96 AS last FROM e
                  UNION ALL SELECT 'valid', hi - 95, hi - 48 FROM e
                  UNION ALL SELECT 'test', hi - 47, hi FROM e)""",
            body="""SELECT split, first, last, COUNT(*) AS rows, COUNT(*) FILTER (WHERE Open = 1) AS open_rows
              FROM w JOIN daily ON Date BETWEEN first AND last GROUP BY 1, 2, 3""",
        ),
    }


def _feature_queries() -> dict[str, str]:
    sf = sales_features("panel", "sf")
    pf = promo_features("panel", "pf")
    rolls = ", ".join(
        f"ROUND(roll_mean_{w}, 4) AS roll_mean_{w}, ROUND(roll_std_{w}, 1) AS roll_std_{w}" for w, _ in ROLLS
    )
    store_day = "FROM daily d JOIN attributes a ON d.Store = a.Store"
    calendar = f"""SELECT Store, Date, CAST(isodow(Date) AS INT) AS DayOfWeek, CAST(day(Date) AS INT) AS day,
      CAST(month(Date) AS INT) AS month, CAST(year(Date) AS INT) AS year,
      CAST(weekofyear(Date) AS INT) AS week_of_year, CAST(dayofyear(Date) AS INT) AS day_of_year,
      CAST(last_day(Date) - Date AS INT) AS days_to_month_end,
      CASE WHEN day(Date) <= 5 THEN 1 ELSE 0 END AS is_month_start,
      CASE WHEN last_day(Date) - Date <= 5 THEN 1 ELSE 0 END AS is_month_end, {split()} AS split
      FROM daily"""
    months = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month(Date)]"
    rates = [(f, f"AVG(CASE WHEN {f} IS NULL THEN 1.0 ELSE 0.0 END) * 100") for f in SALES_FEATURES]
    return {
        "features_calendar": sql(body=calendar),
        "features_promo": sql(
            PANEL,
            pf,
            body=f"""SELECT Store, Date, promo_prev_day, promo_next_day, promo_first_day, promo_last_day,
              promo_lag7, promo_lag14, promo_count_14d FROM pf {OBSERVED}""",
        ),
        "features_programme": sql(
            STORE_PARTS,
            body=f"""SELECT d.Store, Date, {PROGRAMME} AS promo2_active,
              ROUND(CASE WHEN {PROGRAMME} = 1 THEN (Date - joined) / 7.0 ELSE -1.0 END, 6)
                AS promo2_weeks_running,
              CASE WHEN {PROGRAMME} = 1
                   AND list_contains(string_split(COALESCE(PromoInterval, ''), ','), {months})
                   THEN 1 ELSE 0 END AS promo2_restart_month {store_day}""",
        ),
        "features_competition": sql(
            STORE_PARTS,
            body=f"""SELECT d.Store, Date, ROUND(competition_distance_log, 6) AS competition_distance_log,
              competition_distance_missing,
              ROUND(GREATEST(-999.0, LEAST(240.0, COALESCE((Date - opened) / CAST(30.44 AS DOUBLE), -999.0))), 6)
                AS competition_open_months {store_day}""",
        ),
        "features_lags": sql(
            PANEL, sf, body=f"SELECT Store, Date, {', '.join(f'lag_{n}' for n in LAGS)} FROM sf {OBSERVED}"
        ),
        "features_rolling": sql(
            PANEL,
            sf,
            body=f"""SELECT Store, Date, {rolls}, ROUND(trend_28_over_91, 6) AS trend_28_over_91
              FROM sf {OBSERVED}""",
        ),
        "features_median_open": sql(
            PANEL,
            sf,
            body=f"""SELECT Store, Date, ROUND(roll_median_28, 4) AS roll_median_28,
              ROUND(open_rate_28, 6) AS open_rate_28 FROM sf {OBSERVED}""",
        ),
        "features_dow": sql(
            PANEL,
            sf,
            body=f"""SELECT Store, Date, ROUND(dow_mean_4, 4) AS dow_mean_4, ROUND(dow_ratio, 6) AS dow_ratio
              FROM sf {OBSERVED}""",
        ),
        "features_bounded": sql(
            PANEL,
            sf,
            promo_features("sf", "spf"),
            STORE_PARTS,
            body=f"""SELECT b.Store, Date, promo_next_day, promo_count_14d, lag_91,
              ROUND(roll_mean_91, 4) AS roll_mean_91, ROUND(roll_median_28, 4) AS roll_median_28,
              ROUND(open_rate_28, 6) AS open_rate_28, ROUND(dow_mean_4, 4) AS dow_mean_4,
              ROUND(competition_distance_log, 6) AS competition_distance_log
              FROM spf b JOIN attributes a ON b.Store = a.Store
              WHERE NOT is_gap AND Date BETWEEN {TEST} AND {TEST_END}""",
        ),
        "target_transform": sql(
            body="""SELECT Store, Date, ROUND(LN(1 + Sales), 6) AS log_sales,
              ROUND(CASE WHEN Open = 0 THEN 0.0 ELSE CAST(Sales AS DOUBLE) END, 1) AS sales_again FROM daily"""
        ),
        "missing_rates": sql(
            PANEL,
            sf,
            f"seen AS (SELECT * FROM sf {OBSERVED})",
            body=f"""SELECT feature, ROUND(p, 4) AS missing_pct
              FROM ({unpivot('seen', rates, 'feature', 'p')}) WHERE p > 0""",
        ),
    }


def _score_queries() -> dict[str, str]:
    def pred(column: str) -> str:
        return f"SELECT Store, Date, Sales, Open, ROUND({column}, 4) AS pred FROM ft"

    ft = forecasts("ft", TEST, TEST_END)
    rmspe = "SQRT(AVG(POW((Sales - {p}) / Sales, 2)) FILTER (WHERE Sales > 0{extra}))"
    plain = rmspe.format(p="pred", extra="")
    grid = rmspe.format(p="pred * f", extra=" AND Open = 1")
    factors = "(SELECT UNNEST([" + ", ".join(f"{0.960 + 0.005 * i:.3f}::DOUBLE" for i in range(13)) + "]) AS f)"
    gains = ", ".join(
        f"ROUND((1 - {m} / MAX(CASE WHEN label = 'lag7_rolling' THEN {m} END) OVER (PARTITION BY split)) * 100, 4)"
        f" AS improvement_{m}_pct"
        for m in ("rmse", "mape", "wape")
    )
    head = " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, ROUND(b.{m}, 4) AS baseline, ROUND(x.{m}, 4) AS model,
            ROUND((1 - x.{m} / b.{m}) * 100, 4) AS drop_pct
            FROM scores b, scores x WHERE b.split = 'test' AND x.split = 'test'
            AND b.label = 'weekday_median_4w' AND x.label = 'lag7_rolling'"""
        for m in ("rmse", "mape", "wape")
    )
    return {
        "baseline_lag7": sql(ft, body=pred("lag7_rolling")),
        "baseline_tiled": sql(ft, body=pred("last_week_tiled")),
        "baseline_median": sql(ft, body=pred("weekday_median_4w")),
        "scores_all": sql(BOTH_LONG, body=f"SELECT split, label, {metrics()} FROM both_long GROUP BY 1, 2"),
        "scores_without_calendar": sql(
            TEST_LONG, body=f"SELECT label, {metrics('Sales > 0')} FROM test_long GROUP BY 1"
        ),
        "rmspe": sql(
            TEST_LONG,
            body=f"""SELECT label, COUNT(*) FILTER (WHERE Sales > 0) AS n_scored,
              ROUND({plain}, 6) AS rmspe FROM test_long GROUP BY 1""",
        ),
        "calibration_ratio": sql(
            TEST_LONG,
            body="""SELECT label, ROUND(SUM(pred) FILTER (WHERE Open = 1)
              / SUM(Sales) FILTER (WHERE Open = 1), 6) AS ratio FROM test_long GROUP BY 1""",
        ),
        "calibration_grid": sql(
            TEST_LONG,
            body=f"""SELECT label, f AS multiplier, ROUND({grid}, 6) AS rmspe
              FROM test_long, {factors} GROUP BY 1, 2""",
        ),
        "best_multiplier": sql(
            TEST_LONG,
            f"""grid AS (SELECT label, f, {grid} AS e FROM test_long, {factors} GROUP BY 1, 2),
            best AS (SELECT label, f, e FROM grid
                     QUALIFY ROW_NUMBER() OVER (PARTITION BY label ORDER BY e, f) = 1),
            base AS (SELECT label, {plain} AS b,
                       AVG(pred / Sales) FILTER (WHERE Open = 1 AND Sales > 0)
                       / AVG(POW(pred / Sales, 2)) FILTER (WHERE Open = 1 AND Sales > 0) AS c
                     FROM test_long GROUP BY 1)""",
            body="""SELECT base.label, ROUND(b, 6) AS base_rmspe, f AS best_multiplier,
              ROUND(e, 6) AS best_rmspe, ROUND((b - e) / b * 100, 4) AS gain_pct,
              CASE WHEN (b - e) / b * 100 > 1 THEN f ELSE 1.0::DOUBLE END AS applied,
              ROUND(c, 6) AS closed_form FROM base JOIN best ON base.label = best.label""",
        ),
        "improvement": sql(SCORES, body=f"SELECT split, label, {gains} FROM scores"),
        "headline": sql(SCORES, body=head),
    }


def _profile_queries() -> dict[str, str]:
    opened = "SELECT * FROM daily WHERE Open = 1"
    target = [
        ("count", "COUNT(Sales)"), ("mean", "AVG(Sales)"), ("std", "STDDEV_SAMP(Sales)"),
        ("min", "MIN(Sales)"), ("max", "MAX(Sales)"), ("skew", "SKEWNESS(Sales)"),
        ("skew_log1p", "SKEWNESS(LN(1 + Sales))"), ("p25", "QUANTILE_CONT(Sales, 0.25)"),
        ("p50", "QUANTILE_CONT(Sales, 0.5)"), ("p75", "QUANTILE_CONT(Sales, 0.75)"),
    ]
    store = [
        ("count", "COUNT(m)"), ("mean", "AVG(m)"), ("std", "STDDEV_SAMP(m)"), ("min", "MIN(m)"),
        ("max", "MAX(m)"),
        *[(f"p{p:02d}", f"QUANTILE_CONT(m, {p / 100})") for p in (1, 25, 50, 75, 99)],
        ("p99_over_p01", "QUANTILE_CONT(m, 0.99) / QUANTILE_CONT(m, 0.01)"),
        ("median_cv", "MEDIAN(sd / m)"),
    ]
    distance = [
        ("stores", "COUNT(*)"), ("missing", "COUNT(*) - COUNT(CompetitionDistance)"),
        ("max", "MAX(CompetitionDistance)"), ("median", "MEDIAN(CompetitionDistance)"),
    ]

    def described(source: str, pairs: list[tuple[str, str]]) -> str:
        rows = unpivot(source, [(k, f"CAST({v} AS DOUBLE)") for k, v in pairs], "statistic", "v")
        return f"SELECT statistic, ROUND(v, 3) AS value FROM ({rows})"

    def lift(flag: str) -> str:
        return f"""SELECT '{flag}' AS flag, ROUND((AVG(Sales) FILTER (WHERE {flag} = 1)
          / AVG(Sales) FILTER (WHERE {flag} = 0) - 1) * 100, 6) AS lift_pct FROM wide"""

    wide = f"wide AS (SELECT d.*, StoreType, Assortment, Promo2 FROM ({opened}) d LEFT JOIN stores s ON d.Store = s.Store)"
    attributes = " UNION ALL ".join(
        f"""SELECT '{a}' AS attribute, CAST({a} AS VARCHAR) AS value, ROUND(AVG(Sales), 3) AS mean,
            COUNT(DISTINCT Store) AS n_stores FROM wide GROUP BY 2"""
        for a in ("StoreType", "Assortment", "Promo2")
    )
    agree = " UNION ALL ".join(
        f"""SELECT {k} AS lag, COUNT(*) AS pairs, ROUND(AVG(CASE WHEN a.Promo = b.Promo THEN 1.0 ELSE 0.0 END) * 100, 6)
            AS agree_pct FROM daily a JOIN daily b ON a.Store = b.Store AND a.Date = b.Date + {k}"""
        for k in (7, 14, 21, 28)
    )
    ranked = f"""means AS (SELECT Store, AVG(Sales) AS m FROM ({opened}) GROUP BY 1),
      ranked AS (SELECT Store, m, ROW_NUMBER() OVER (ORDER BY m, Store) - 1 AS place,
                 COUNT(*) OVER () AS n FROM means)"""
    return {
        "target_profile": sql(f"o AS ({opened})", body=described("o", target)),
        "gap_audit": sql(
            """c AS (SELECT Store, COUNT(*) AS n FROM daily GROUP BY 1),
            f AS (SELECT COUNT(DISTINCT Date) AS n FROM daily),
            g AS (SELECT Store, n FROM c WHERE n < (SELECT n FROM f)),
            a AS (SELECT Date FROM daily WHERE Store IN (SELECT Store FROM g) GROUP BY 1
                  HAVING COUNT(DISTINCT Store) < (SELECT COUNT(*) FROM g))""",
            body="""SELECT (SELECT n FROM f) AS calendar_days, (SELECT COUNT(*) FROM c) AS stores,
              (SELECT COUNT(*) FROM c) - (SELECT COUNT(*) FROM g) AS full_stores,
              COUNT(*) AS gapped_stores, ROUND(AVG(n), 4) AS gapped_mean,
              ROUND(STDDEV_SAMP(n), 4) AS gapped_std, MIN(n) AS gapped_min,
              ROUND(QUANTILE_CONT(n, 0.25), 4) AS gapped_p25, ROUND(QUANTILE_CONT(n, 0.5), 4) AS gapped_p50,
              ROUND(QUANTILE_CONT(n, 0.75), 4) AS gapped_p75, MAX(n) AS gapped_max,
              (SELECT MIN(Date) FROM a) AS absent_first, (SELECT MAX(Date) FROM a) AS absent_last FROM g""",
        ),
        "dow_profile": sql(
            body="""SELECT DayOfWeek, ROUND(AVG(Open) * 100, 4) AS pct_open, ROUND(AVG(Sales), 3) AS mean_all,
              ROUND(AVG(Sales) FILTER (WHERE Open = 1), 3) AS mean_open FROM daily GROUP BY 1"""
        ),
        "promo_effect": sql(
            body=f"""SELECT Promo, COUNT(Sales) AS days, ROUND(AVG(Sales), 3) AS mean,
              ROUND(MEDIAN(Sales), 3) AS median FROM ({opened}) GROUP BY 1"""
        ),
        "promo_lift": sql(wide, body=f"{lift('Promo')} UNION ALL {lift('Promo2')}"),
        "store_heterogeneity": sql(
            f"p AS (SELECT Store, AVG(Sales) AS m, STDDEV_SAMP(Sales) AS sd FROM ({opened}) GROUP BY 1)",
            body=described("p", store),
        ),
        "metadata_profile": sql(wide, body=attributes),
        "distance_profile": sql(body=described("stores", distance)),
        "trend_monthly": sql(
            f"""o AS ({opened}),
            b AS (SELECT date_trunc('month', MAX(Date)) AS hi, date_trunc('month', MIN(Date)) AS lo FROM o),
            months AS (SELECT CAST(UNNEST(generate_series(GREATEST(lo, hi - INTERVAL 17 MONTH), hi,
                       INTERVAL 1 MONTH)) AS DATE) AS month FROM b)""",
            body="""SELECT month, ROUND(AVG(Sales), 3) AS mean FROM months
              LEFT JOIN o ON CAST(date_trunc('month', Date) AS DATE) = month GROUP BY 1""",
        ),
        "trend_yearly": sql(
            body=f"""SELECT CAST(year(Date) AS INT) AS year, ROUND(AVG(Sales), 3) AS mean
              FROM ({opened}) GROUP BY 1"""
        ),
        "promo_cycle": sql(body=agree),
        "promo_mismatch_cost": sql(
            body=f"""SELECT a.Promo = b.Promo AS promo_matches, COUNT(*) AS rows,
              ROUND(AVG(ABS(a.Sales - b.Sales) / a.Sales * 100), 4) AS mean_error_pct
              FROM daily a JOIN daily b ON a.Store = b.Store AND a.Date = b.Date + 7
              WHERE a.Date BETWEEN {VALID} AND {VALID_END} AND a.Open = 1 AND a.Sales > 0 GROUP BY 1"""
        ),
        "holiday_rates": sql(
            body=f"""SELECT {split()} AS split, ROUND(AVG(SchoolHoliday), 6) AS school_holiday_rate,
              ROUND(AVG(CASE WHEN StateHoliday <> '0' THEN 1.0 ELSE 0.0 END), 6) AS state_holiday_rate
              FROM daily GROUP BY 1"""
        ),
        "median_store": sql(
            ranked, body="SELECT Store, ROUND(m, 3) AS mean FROM ranked WHERE place = n // 2"
        ),
        "stratified_sample": sql(
            ranked,
            """placed AS (SELECT *, CASE WHEN place < (n % 15) * (n // 15 + 1) THEN place // (n // 15 + 1)
                ELSE (n % 15) + (place - (n % 15) * (n // 15 + 1)) // (n // 15) END AS stratum FROM ranked)""",
            body="""SELECT stratum, arg_min(Store, md5('0:' || CAST(Store AS VARCHAR))) AS Store,
              COUNT(*) AS stores FROM placed GROUP BY 1""",
        ),
    }


def _vocabulary_of(source: str) -> str:
    def part(column: str, text: bool) -> str:
        number, word = ("NULL", column) if text else (column, "NULL")
        return f"""SELECT '{column}' AS "column", CAST({number} AS BIGINT) AS number,
          CAST({word} AS VARCHAR) AS text, COUNT(*) AS c FROM {source} GROUP BY 1, 2, 3"""

    parts = [
        part("Store", False), part("DayOfWeek", False), part("StoreType", True),
        part("Assortment", True), part("StateHoliday", True),
    ]
    return f"""SELECT "column", number, text,
      ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY number, text) - 1 AS code
      FROM ({' UNION ALL '.join(parts)})"""


def _encoding_queries() -> dict[str, str]:
    wide = """wide AS (SELECT d.*, StoreType, Assortment FROM daily d LEFT JOIN stores s ON d.Store = s.Store),
      fwide AS (SELECT d.*, StoreType, Assortment FROM calendar d LEFT JOIN stores s ON d.Store = s.Store)"""
    both = f"""{wide}, v AS ({_vocabulary_of('wide')}), fv AS ({_vocabulary_of('fwide')})"""
    columns = {"Store": "number", "DayOfWeek": "number", "StoreType": "text", "Assortment": "text",
               "StateHoliday": "text"}

    def encoded(vocabulary: str) -> str:
        codes = ", ".join(
            f"""(SELECT code FROM {vocabulary} x WHERE x."column" = '{c}' AND x.{k} = wide.{c}) AS {c}_code"""
            for c, k in columns.items()
        )
        return f"SELECT Store, Date, {codes} FROM wide"

    outside = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT(*) FILTER (WHERE {c} NOT IN
            (SELECT {k} FROM fv WHERE "column" = '{c}')) AS rows_outside FROM wide"""
        for c, k in columns.items()
    )
    return {
        "vocabulary": sql(both, body="SELECT * FROM v"),
        "vocabulary_file": sql(both, body="SELECT * FROM v"),
        "encoded": sql(both, body=encoded("v")),
        "encoded_with_unseen": sql(both, body=encoded("fv")),
        "vocabulary_outside": sql(both, body=outside),
        "vocabulary_difference": sql(
            both,
            body="""SELECT *, 'left' AS side FROM (SELECT * FROM v EXCEPT ALL SELECT * FROM fv)
              UNION ALL SELECT *, 'right' FROM (SELECT * FROM fv EXCEPT ALL SELECT * FROM v)""",
        ),
    }


def _differs(a: str, b: str, rtol: str, atol: str) -> str:
    return f"""(({a} IS NULL) <> ({b} IS NULL)
      OR COALESCE(ABS({a} - {b}) > {atol} + {rtol} * ABS({b}), FALSE))"""


SKEW_COLUMNS = (
    "promo_prev_day", "promo_next_day", "promo_count_14d", "promo2_weeks_running",
    "competition_distance_log", "lag_49", "roll_mean_28", "roll_median_28", "open_rate_28", "dow_mean_4",
)


def _check_queries() -> dict[str, str]:
    blind = f"""blind AS (SELECT * REPLACE (CASE WHEN Date < {VALID} THEN Sales END AS Sales) FROM panel)"""
    full_f, blind_f = sales_features("panel", "a"), sales_features("blind", "b")
    pairs = """pairs AS (SELECT {columns} FROM a JOIN b ON a.Store = b.Store AND a.Date = b.Date
      WHERE a.split = 'valid')"""
    columns = ", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in SALES_FEATURES)

    def leaks(names: list[str]) -> str:
        return " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, COUNT(*) AS rows, COUNT(*) FILTER (WHERE {d}) AS rows_differ,
                ROUND(COUNT(*) FILTER (WHERE {d}) / COUNT(*) * 100, 4) AS pct_differ FROM pairs"""
            for c in names
            for d in [_differs(f"a_{c}", f"b_{c}", "1e-9", "1e-8")]
        )

    corr = unpivot(
        "(SELECT * FROM a WHERE split = 'valid')", [(c, f"CASE WHEN NOT ISNAN(CORR(Sales, {c})) THEN CORR(Sales, {c}) END") for c in SALES_FEATURES],
        "feature", "c",
    )
    week_ago = """{n} AS (SELECT p.*, CAST(q.Sales AS DOUBLE) AS week_ago FROM {t} p
      LEFT JOIN {t} q ON p.Store = q.Store AND p.Date = q.Date + 7)"""

    ahead_60 = """{n} AS (SELECT p.*, CAST(q.Sales AS DOUBLE) AS ahead_60 FROM {t} p
      LEFT JOIN {t} q ON p.Store = q.Store AND p.Date = q.Date - 60)"""

    weeks = f"CASE WHEN {PROGRAMME} = 1 THEN (Date - joined) / 7.0 ELSE -1.0 END AS promo2_weeks_running"
    paths = [
        PANEL, EXTENDED, STORE_PARTS,
        sales_features("panel", "o1"), promo_features("o1", "o2"),
        sales_features("xpanel", "x1"), promo_features("x1", "x2"),
        f"""o AS (SELECT o2.*, {weeks}, competition_distance_log FROM o2 JOIN attributes t ON o2.Store = t.Store
             WHERE NOT is_gap AND Date BETWEEN {TEST} AND {TEST_END}),
        x AS (SELECT x2.*, {weeks}, competition_distance_log FROM x2 JOIN attributes t ON x2.Store = t.Store
             WHERE NOT is_gap AND Date BETWEEN {TEST} AND {SERVE_TO}),
        j AS (SELECT o.Store, o.Date, {', '.join(f'o.{c} AS a_{c}, x.{c} AS b_{c}' for c in SKEW_COLUMNS)}
              FROM o JOIN x ON o.Store = x.Store AND o.Date = x.Date)""",
    ]
    skew = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT(*) AS rows,
            COUNT(*) FILTER (WHERE {_differs(f'a_{c}', f'b_{c}', '0', '1e-6')}) AS rows_differ,
            ROUND(CAST(MAX(ABS(a_{c} - b_{c})) AS DOUBLE), 5) AS max_diff FROM j"""
        for c in SKEW_COLUMNS
    )
    return {
        "leakage_report": sql(
            PANEL, blind, full_f, blind_f, pairs.format(columns=columns), body=leaks(SALES_FEATURES)
        ),
        "leakage_report_planted": sql(
            PANEL,
            blind,
            week_ago.format(n="a", t="panel"),
            week_ago.format(n="b", t="blind"),
            pairs.format(columns="a.week_ago AS a_week_ago, b.week_ago AS b_week_ago"),
            body=leaks(["week_ago"]),
        ),
        "leakage_report_planted_far": sql(
            PANEL,
            blind,
            ahead_60.format(n="a", t="panel"),
            ahead_60.format(n="b", t="blind"),
            pairs.format(columns="a.ahead_60 AS a_ahead_60, b.ahead_60 AS b_ahead_60"),
            body=leaks(["ahead_60"]),
        ),
        "feature_correlation": sql(
            PANEL, full_f, body=f"SELECT feature, ROUND(c, 6) AS corr FROM ({corr})"
        ),
        "feature_correlation_max": sql(
            PANEL,
            full_f,
            body=f"""SELECT feature, ROUND(ABS(c), 6) AS abs_corr FROM ({corr})
              ORDER BY ABS(c) DESC NULLS LAST LIMIT 1""",
        ),
        "skew_report_where_they_lie": f"SELECT * FROM ({sql(*paths, body=skew)}) WHERE \"column\" NOT LIKE 'lag_%'",
        "skew_report": sql(*paths, body=skew),
        "skew_worst": sql(
            *paths,
            body="""SELECT Store, Date, ROUND(f, 6) AS offline, ROUND(s, 6) AS serving, ROUND(ABS(f - s), 6) AS diff
              FROM (SELECT Store, Date, ROUND(a_open_rate_28, 9) AS f, ROUND(b_open_rate_28, 9) AS s FROM j)
              ORDER BY ABS(f - s) DESC NULLS LAST, Store, Date LIMIT 5""",
        ),
    }


WEEKS = (1, 2, 3, 4, 5, 6, 8, 12)


def _run_queries() -> dict[str, str]:
    parts = []
    for w in WEEKS:
        parts.append(
            f"""SELECT 'weeks_{w}' AS label, d.Sales, d.Open,
            CASE WHEN d.Open = 0 THEN 0.0 ELSE COALESCE(m, fb, 0.0) END AS pred FROM daily d
            LEFT JOIN ({MEDIANS.format(cut=VALID, days=7 * w)}) q
              ON d.Store = q.Store AND d.DayOfWeek = q.DayOfWeek
            LEFT JOIN ({STORE_MEDIANS.format(cut=VALID)}) f ON d.Store = f.Store
            WHERE d.Date BETWEEN {VALID} AND {VALID_END}"""
        )
    runs = f"""preds AS ({' UNION ALL '.join(parts)}),
      runs AS (SELECT label, {metrics(digits=None)} FROM preds GROUP BY 1)"""
    seeds = "('weeks_3', 'weeks_4', 'weeks_5', 'weeks_6')"
    return {
        "run_values": sql(
            runs, body="SELECT label AS name, 'valid_mape' AS key, ROUND(mape, 4) AS value FROM runs"
        ),
        "noise_floor": sql(
            runs,
            body=f"""SELECT COUNT(*) AS runs, ROUND(AVG(mape), 4) AS mean, ROUND(STDDEV_SAMP(mape), 4) AS std,
              ROUND(MIN(mape), 4) AS min, ROUND(MAX(mape), 4) AS max,
              ROUND(MAX(mape) - MIN(mape), 4) AS range FROM runs WHERE label IN {seeds}""",
        ),
        "variants_against_noise": sql(
            runs,
            body=f"""SELECT label AS name, ROUND(mape, 4) AS value,
              mape BETWEEN (SELECT MIN(mape) FROM runs WHERE label IN {seeds})
                       AND (SELECT MAX(mape) FROM runs WHERE label IN {seeds}) AS inside_band
              FROM runs WHERE label IN ('weeks_1', 'weeks_2', 'weeks_8', 'weeks_12')""",
        ),
        "ablation_table": sql(
            runs,
            body="""SELECT r.label AS name, ROUND(r.rmse, 4) AS rmse, ROUND(r.mape, 4) AS mape,
              ROUND(r.wape, 4) AS wape, ROUND(r.mape - f.mape, 4) AS mape_vs_full,
              ROUND((1 - r.mape / b.mape) * 100, 4) AS improve_vs_baseline_pct
              FROM runs r, runs f, runs b
              WHERE f.label = 'weeks_4' AND b.label = 'weeks_1' AND r.label <> 'weeks_1'""",
        ),
    }


def _serving_queries() -> dict[str, str]:
    weeks = f"{PROGRAMME} AS promo2_active"
    serving = [
        EXTENDED, STORE_PARTS,
        sales_features("xpanel", "x1"), promo_features("x1", "x2"),
        f"""serving AS (SELECT x2.*, x2.Store AS store_key, {weeks}, StoreType, Assortment
             FROM x2 JOIN attributes t ON x2.Store = t.Store
             WHERE NOT is_gap AND Date BETWEEN {TEST} AND {SERVE_TO})""",
    ]
    light = f"""{HISTORY},
      serving AS (SELECT *, Store AS store_key FROM history WHERE Date BETWEEN {TEST} AND {SERVE_TO})"""
    requests = """
      asked AS (SELECT o_orderkey AS request_id, CAST(o_custkey % ((SELECT COUNT(*) FROM nation) + 2) AS INT) AS store_id,
          DATE '2001-09-16' + CAST(o_orderkey % 97 AS INT) AS start_date,
          DATE '2001-09-16' + CAST(o_orderkey % 97 AS INT) + CAST(o_custkey % 16 - 1 AS INT) AS end_date
        FROM orders),
      span AS (SELECT MIN(Date) AS lo, MAX(Date) AS hi FROM serving),
      ranges AS (SELECT store_key, MIN(Date) AS first_date, MAX(Date) AS last_date FROM serving GROUP BY 1),
      good AS (SELECT asked.* FROM asked, span WHERE end_date >= start_date AND start_date >= lo AND end_date <= hi),
      hits AS (SELECT g.*, s.* FROM good g JOIN serving s
               ON g.store_id = s.store_key AND s.Date BETWEEN g.start_date AND g.end_date)"""
    predicted = f"""
      said AS (SELECT h.*, CASE WHEN h.Open = 0 THEN 0.0 ELSE COALESCE(m, fb, 0.0) END AS pred FROM hits h
        LEFT JOIN ({MEDIANS.format(cut=TEST, days=28)}) q ON h.Store = q.Store AND h.DayOfWeek = q.DayOfWeek
        LEFT JOIN ({STORE_MEDIANS.format(cut=TEST)}) f ON h.Store = f.Store)"""
    ape = "ABS(Sales - pred) / CASE WHEN Sales > 0 THEN Sales END * 100"
    submission = f"""submission AS (
      SELECT Id, CAST(ROUND(CASE WHEN COALESCE(c.Open, 1) = 0 THEN 0
                       ELSE CAST(COALESCE(m, fb, 0) AS DECIMAL(18, 4)) * 0.975 END, 2) AS DOUBLE) AS Sales
      FROM calendar c
      LEFT JOIN ({MEDIANS.format(cut=UNSEEN, days=28)}) q ON c.Store = q.Store AND c.DayOfWeek = q.DayOfWeek
      LEFT JOIN ({STORE_MEDIANS.format(cut=UNSEEN)}) f ON c.Store = f.Store)"""
    rates = [
        (f, f"AVG(CASE WHEN {f} IS NULL THEN 1.0 ELSE 0.0 END) * 100")
        for f in SALES_FEATURES
        if not f.startswith("lag_")
    ]
    ft = forecasts("ft", TEST, TEST_END)
    return {
        "serving_table": sql(
            *serving,
            body="""SELECT store_key, Date, Open, Promo, Sales, DayOfWeek, StateHoliday, SchoolHoliday, StoreType,
              promo_next_day, promo_count_14d, promo2_active, ROUND(roll_mean_28, 4) AS roll_mean_28,
              ROUND(roll_median_28, 4) AS roll_median_28, ROUND(open_rate_28, 6) AS open_rate_28,
              ROUND(dow_mean_4, 4) AS dow_mean_4 FROM serving""",
        ),
        "serving_file": sql(
            *serving, body="SELECT store_key, Date, Open, Sales, ROUND(dow_ratio, 6) AS dow_ratio FROM serving"
        ),
        "submission_file": sql(submission, body="SELECT Id, printf('%.2f', Sales) AS Sales FROM submission"),
        "serving_summary": sql(
            light,
            body="""SELECT COUNT(*) AS rows, COUNT(DISTINCT store_key) AS stores, COUNT(Sales) AS known,
              COUNT(*) - COUNT(Sales) AS unseen, MIN(Date) AS serve_from, MAX(Date) AS serve_to FROM serving""",
        ),
        "serving_ranges": sql(
            light,
            body="""SELECT store_key, MIN(Date) AS first_date, MAX(Date) AS last_date
              FROM serving GROUP BY 1""",
        ),
        "store_list": sql(
            light,
            body="""SELECT DISTINCT store_key, (SELECT COUNT(DISTINCT store_key) FROM serving) AS n_stores
              FROM serving ORDER BY 1 LIMIT 10""",
        ),
        "serving_missing": sql(
            *serving,
            body=f"""SELECT feature, ROUND(p, 4) AS missing_pct
              FROM ({unpivot('serving', rates, 'feature', 'p')}) WHERE p > 5""",
        ),
        "request_status": sql(
            light,
            requests,
            """counted AS (SELECT request_id, COUNT(*) AS n FROM hits GROUP BY 1),
            judged AS (SELECT a.*, first_date, last_date, COALESCE(n, 0) AS n_days,
              CASE WHEN first_date IS NULL THEN 'unknown store' WHEN end_date < start_date THEN 'reversed range'
                   WHEN start_date < lo OR end_date > hi THEN 'outside range'
                   WHEN n IS NULL THEN 'no rows' ELSE 'ok' END AS status
              FROM asked a CROSS JOIN span LEFT JOIN ranges r ON a.store_id = r.store_key
              LEFT JOIN counted c ON a.request_id = c.request_id)""",
            body="""SELECT request_id, store_id, start_date, end_date, status, n_days,
              CASE WHEN status = 'no rows' THEN first_date END AS first_date,
              CASE WHEN status = 'no rows' THEN last_date END AS last_date FROM judged""",
        ),
        "range_forecast": sql(
            light,
            requests,
            predicted,
            body=f"""SELECT request_id, store_id, Date AS date, CAST(isodow(Date) AS INT) AS day_of_week,
              Open = 1 AS open, Promo = 1 AS promo, ROUND(pred, 2) AS predicted_sales,
              CAST(Sales AS DOUBLE) AS actual_sales, ROUND({ape}, 2) AS absolute_percentage_error FROM said""",
        ),
        "range_summary": sql(
            light,
            requests,
            predicted,
            body=f"""SELECT request_id, store_id, COUNT(*) AS n_days, CAST(SUM(Open) AS BIGINT) AS n_trading_days,
              ROUND(SUM(pred), 2) AS total_predicted_sales,
              ROUND(SUM(pred) / GREATEST(SUM(Open), 1), 2) AS mean_predicted_sales_per_trading_day,
              ROUND(AVG({ape}), 2) AS mape_vs_actual FROM said GROUP BY 1, 2""",
        ),
        "submission_baseline": sql(submission, body="SELECT Id, Sales FROM submission"),
        "submission_checks": sql(
            submission,
            body="""SELECT COUNT(s.Id) AS rows, COUNT(c.Id) AS expected_rows,
              COUNT(*) FILTER (WHERE s.Id IS NULL) AS missing_ids,
              COUNT(*) FILTER (WHERE c.Id IS NULL) AS extra_ids,
              COUNT(s.Id) - COUNT(DISTINCT s.Id) AS repeated_ids,
              COUNT(*) FILTER (WHERE s.Id IS NOT NULL AND s.Sales IS NULL) AS null_forecasts
              FROM submission s FULL JOIN calendar c ON s.Id = c.Id""",
        ),
        "submission_summary": sql(
            submission,
            body="""SELECT COUNT(*) AS rows, ROUND(AVG(Sales), 3) AS mean,
              COUNT(*) FILTER (WHERE Sales = 0) AS zero_rows, ROUND(MAX(Sales), 3) AS max FROM submission""",
        ),
        "store_forecast": sql(
            ft,
            """sized AS (SELECT Store, ROW_NUMBER() OVER (ORDER BY AVG(Sales), Store) - 1 AS place,
                COUNT(*) OVER () AS n FROM ft WHERE Open = 1 GROUP BY 1)""",
            body="""SELECT ft.Store, Date, Promo, Sales, ROUND(weekday_median_4w, 3) AS baseline,
              ROUND(last_week_tiled, 3) AS model,
              ROUND(AVG(ABS(Sales - weekday_median_4w) / NULLIF(Sales, 0)) OVER () * 100, 4) AS baseline_mape,
              ROUND(AVG(ABS(Sales - last_week_tiled) / NULLIF(Sales, 0)) OVER () * 100, 4) AS model_mape
              FROM ft JOIN sized ON ft.Store = sized.Store WHERE place = n // 2 AND Open = 1""",
        ),
    }


def _file_queries() -> dict[str, str]:
    return {
        "facts_from_csv": sql(body="SELECT * FROM daily"),
        "stores_from_csv": sql(body="SELECT * FROM stores"),
        "future_from_csv": sql(body="SELECT * FROM calendar"),
        "feature_file": sql(
            PANEL,
            promo_features("panel", "pf"),
            body="""SELECT split, promo_count_14d, COUNT(*) AS rows FROM pf WHERE NOT is_gap GROUP BY 1, 2""",
        ),
        "training_rows": sql(
            body=f"""SELECT Store, Date, {split()} AS split, ROUND(LN(1 + Sales), 6) AS label
              FROM daily WHERE Open = 1 AND Date < {TEST}"""
        ),
        "store_levels": sql(
            f"""t AS (SELECT Store, LN(1 + Sales) AS y FROM daily WHERE Open = 1 AND Date < {VALID}),
            o AS (SELECT AVG(y) AS m FROM t)""",
            body="""SELECT Store, ROUND((SUM(y) + 10 * MAX(m)) / (COUNT(*) + 10), 6) AS level
              FROM t, o GROUP BY 1 UNION ALL SELECT NULL, ROUND(m, 6) FROM o""",
        ),
    }


TERMS = (0, 1, 2, 7, 8, 9)


def _classical_ctes() -> list[str]:
    def m(i: int, j: int) -> str:
        return f"m_{min(i, j)}_{max(i, j)}"

    def deseasoned(i: int, j: int) -> str:
        return f"({m(i, j)} - s * ({m(i, j + 7)} + {m(j, i + 7)}) + s * s * {m(i + 7, j + 7)})"

    def filtered(i: int, j: int) -> str:
        weights = ((0, "1"), (1, "(-a)"), (2, "(-b)"))
        return " + ".join(f"{x} * {y} * {m(i + p, j + q)}" for p, x in weights for q, y in weights)

    z = ", ".join(f"LAG(y, {k}) OVER s - LAG(y, {k + 7}) OVER s AS z{k}" for k in TERMS)
    moments = ", ".join(
        f"SUM(z{i} * z{j}) AS {m(i, j)}" for i in TERMS for j in TERMS if i <= j
    )
    known = " AND ".join(f"z{k} IS NOT NULL" for k in TERMS)
    series = f"""
      pts AS (SELECT Store, Date, CASE WHEN Sales > 0 THEN LN(1 + Sales) END AS y
              FROM daily WHERE Date < {VALID}),
      ends AS (SELECT Store, MIN(Date) AS lo, MAX(Date) AS hi FROM pts GROUP BY 1),
      grid AS (SELECT Store, hi, CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS Date
               FROM ends),
      spread AS (SELECT grid.Store, hi, grid.Date, y, CASE WHEN y IS NOT NULL THEN grid.Date END AS d
                 FROM grid LEFT JOIN pts ON grid.Store = pts.Store AND grid.Date = pts.Date),
      near AS (SELECT *, LAST_VALUE(y IGNORE NULLS) OVER p AS py, LAST_VALUE(d IGNORE NULLS) OVER p AS pd,
                 FIRST_VALUE(y IGNORE NULLS) OVER n AS ny, FIRST_VALUE(d IGNORE NULLS) OVER n AS nd
               FROM spread
               WINDOW p AS (PARTITION BY Store ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                      n AS (PARTITION BY Store ORDER BY Date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
      series AS (SELECT Store, hi, Date, CASE WHEN y IS NOT NULL THEN y WHEN py IS NULL THEN ny
                   WHEN ny IS NULL THEN py ELSE py + (ny - py) * ((Date - pd) / (nd - pd)) END AS y
                 FROM near WHERE py IS NOT NULL OR ny IS NOT NULL)"""
    fit = f"""
      lagged AS (SELECT Store, {z} FROM series WINDOW s AS (PARTITION BY Store ORDER BY Date)),
      mom AS (SELECT Store, COUNT(*) AS n, {moments} FROM lagged WHERE {known} GROUP BY 1),
      sweep AS (
        SELECT Store, 0 AS i, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS s FROM mom
        UNION ALL
        SELECT Store, i + 1, a, b,
          ({filtered(0, 7)}) / NULLIF({filtered(7, 7)}, 0) FROM (
          SELECT mom.*, i,
            ({deseasoned(0, 1)} * {deseasoned(2, 2)} - {deseasoned(0, 2)} * {deseasoned(1, 2)})
              / NULLIF({deseasoned(1, 1)} * {deseasoned(2, 2)} - {deseasoned(1, 2)} * {deseasoned(1, 2)}, 0) AS a,
            ({deseasoned(0, 2)} * {deseasoned(1, 1)} - {deseasoned(0, 1)} * {deseasoned(1, 2)})
              / NULLIF({deseasoned(1, 1)} * {deseasoned(2, 2)} - {deseasoned(1, 2)} * {deseasoned(1, 2)}, 0) AS b
          FROM sweep JOIN mom USING (Store) WHERE i < 20)),
      coef AS (SELECT sweep.*, n FROM sweep JOIN mom USING (Store) WHERE i = 20)"""

    def zt(k: int) -> str:
        return f"(y[-{k}] - y[-{k + 7}])"

    step = f"y[-7] + a * {zt(1)} + b * {zt(2)} + s * {zt(7)} - a * s * {zt(8)} - b * s * {zt(9)}"
    path = f"""
      verdict AS (SELECT e.Store, hi, a, b, s,
          CASE WHEN n IS NULL OR n < 3 THEN 'too little history'
               WHEN a IS NULL OR b IS NULL OR s IS NULL THEN 'no unique solution' END AS error
        FROM ends e LEFT JOIN coef ON e.Store = coef.Store),
      tails AS (SELECT Store, LIST(y ORDER BY Date) AS y FROM series WHERE hi - Date < 16 GROUP BY 1),
      path AS (
        SELECT v.Store, hi, 0 AS i, a, b, s, t.y FROM verdict v JOIN tails t ON v.Store = t.Store
        WHERE error IS NULL
        UNION ALL
        SELECT Store, hi, i + 1, a, b, s, list_append(y, {step}) FROM path WHERE i < 48),
      predicted AS (SELECT Store, CAST(hi + i AS DATE) AS Date, GREATEST(EXP(y[-1]) - 1, 0.0) AS pred,
                      CAST(NULL AS VARCHAR) AS error FROM path WHERE i > 0
                    UNION ALL SELECT Store, NULL, NULL, error FROM verdict WHERE error IS NOT NULL)"""
    return [series, fit, path]


def _noise_ctes() -> list[str]:
    """Two regressions with moving-average terms, the residuals written out as rows of their own."""
    long = (1, 2, 7, 8, 9, 14)
    lags = (0, 1, 2, 3, 7, 8, 9, 10, 14, 15, 16, 21)

    def eliminated(name: str, source: str, size: int) -> str:
        row = "list_transform(rw, lambda x, j: x - m[k + 1][j] * rw[k + 1] / NULLIF(m[k + 1][k + 1], 0))"
        own = "list_transform(rw, lambda x: x / NULLIF(m[k + 1][k + 1], 0))"
        return f"""{name}_steps AS (
          SELECT Store, 0 AS k, m FROM {source}
          UNION ALL SELECT Store, k + 1, list_transform(m, lambda rw, i: CASE WHEN i = k + 1 THEN {own} ELSE {row} END)
          FROM {name}_steps WHERE k < {size}),
        {name} AS (SELECT Store, list_transform(m, lambda rw: rw[{size + 1}]) AS w FROM {name}_steps WHERE k = {size})"""

    def system(terms: list[str], target: str) -> str:
        rows = ", ".join("[" + ", ".join([f"SUM({a} * {b})" for b in terms] + [f"SUM({target} * {a})"]) + "]" for a in terms)
        return f"[{rows}]"

    z = ", ".join(f"LAG(y, {k}) OVER s - LAG(y, {k + 7}) OVER s AS z{k}" for k in sorted({*lags, *(7 + k for k in long)}))
    known = " AND ".join(f"z{k} IS NOT NULL" for k in lags)

    def noise(ago: int) -> str:
        return f"z{ago} - " + " - ".join(f"w[{i + 1}] * z{ago + k}" for i, k in enumerate(long))

    def zt(ago: int) -> str:
        return f"(y[-{ago}] - y[-{ago + 7}])"

    start = ", ".join(f"{zt(a)} - " + " - ".join(f"l[{i + 1}] * {zt(a + k)}" for i, k in enumerate(long)) for a in range(7, 0, -1))
    step = f"y[-7] + w[1] * {zt(1)} + w[2] * {zt(7)} + w[3] * e[-1] + w[4] * e[-7]"
    unsolved = "len(list_filter(longs.w, lambda x: x IS NULL)) + len(list_filter(owns.w, lambda x: x IS NULL)) > 0"
    return [
        f"""zs AS (SELECT * FROM (SELECT Store, {z} FROM series WINDOW s AS (PARTITION BY Store ORDER BY Date)) WHERE {known}),
        first_system AS (SELECT Store, COUNT(*) AS n, {system([f'z{k}' for k in long], 'z0')} AS m FROM zs GROUP BY 1)""",
        eliminated("longs", "first_system", len(long)),
        f"""noisy AS (SELECT zs.*, {noise(1)} AS e1, {noise(7)} AS e7 FROM zs JOIN longs USING (Store)),
        second_system AS (SELECT Store, {system(['z1', 'z7', 'e1', 'e7'], 'z0')} AS m FROM noisy GROUP BY 1)""",
        eliminated("owns", "second_system", 4),
        f"""judged_fit AS (SELECT f.Store, n, longs.w AS l, owns.w AS w,
          CASE WHEN n < 60 THEN 'too little history' WHEN {unsolved} THEN 'no unique solution' END AS error
          FROM first_system f JOIN longs USING (Store) JOIN owns USING (Store))""",
        f"""noise_verdict AS (SELECT e.Store, hi, l, w, CASE WHEN n IS NULL THEN 'too little history' ELSE error END AS error
          FROM ends e LEFT JOIN judged_fit j ON e.Store = j.Store),
        noise_tails AS (SELECT Store, LIST(y ORDER BY Date) AS y FROM series WHERE hi - Date < 28 GROUP BY 1),
        noise_path AS (
          SELECT Store, hi, 0 AS i, w, y, [{start}] AS e FROM noise_verdict JOIN noise_tails USING (Store) WHERE error IS NULL
          UNION ALL SELECT Store, hi, i + 1, w, list_append(y, {step}), list_append(e, 0.0) FROM noise_path WHERE i < 48),
        noise_predicted AS (SELECT Store, CAST(hi + i AS DATE) AS Date, GREATEST(EXP(y[-1]) - 1, 0.0) AS pred,
            CAST(NULL AS VARCHAR) AS error FROM noise_path WHERE i > 0
          UNION ALL SELECT Store, NULL, NULL, error FROM noise_verdict WHERE error IS NOT NULL)""",
    ]


def _classical_queries() -> dict[str, str]:
    series, fit, path = _classical_ctes()
    noise = _noise_ctes()
    weights = ", ".join(f"ROUND(w[{i + 1}], 5) AS {name}" for i, name in enumerate(("f1", "f7", "g1", "g7")))
    ranked = """means AS (SELECT Store, AVG(Sales) AS m FROM daily WHERE Open = 1 GROUP BY 1),
      ranked AS (SELECT Store, ROW_NUMBER() OVER (ORDER BY m, Store) - 1 AS place,
                 COUNT(*) OVER () AS n FROM means),
      placed AS (SELECT *, CASE WHEN place < (n % 15) * (n // 15 + 1) THEN place // (n // 15 + 1)
                 ELSE (n % 15) + (place - (n % 15) * (n // 15 + 1)) // (n // 15) END AS stratum FROM ranked),
      sample AS (SELECT arg_min(Store, md5('0:' || CAST(Store AS VARCHAR))) AS Store
                 FROM placed GROUP BY stratum)"""
    return {
        "interpolated_series": sql(series, body="SELECT Store, Date, ROUND(y, 6) AS y FROM series"),
        "classical_forecast": sql(
            series, fit, path, body="SELECT Store, Date, ROUND(pred / 100, 1) AS pred, error FROM predicted"
        ),
        "classical_noise_coefficients": sql(series, *noise, body=f"SELECT Store, n, error, {weights} FROM judged_fit"),
        "classical_noise_forecast": sql(
            series, *noise, body="SELECT Store, Date, ROUND(pred / 100, 1) AS pred, error FROM noise_predicted"
        ),
        "classical_scores": sql(
            series,
            fit,
            path,
            ranked,
            forecasts("fv", VALID, VALID_END),
            """judged AS (SELECT fv.*, CASE WHEN Open = 0 THEN 0.0 ELSE COALESCE(p.pred, 0.0) END AS classical
                 FROM fv LEFT JOIN predicted p ON fv.Store = p.Store AND fv.Date = p.Date
                 WHERE fv.Store IN (SELECT Store FROM sample))""",
            f"judged_long AS ({long('judged', ('classical', 'weekday_median_4w'))})",
            body=f"SELECT label, {metrics(digits=3)} FROM judged_long GROUP BY 1",
        ),
    }


def _tree_queries() -> dict[str, str]:
    """The exact parts of what the trees give, and a fixed ensemble spelt out."""
    first = "CASE WHEN DayOfWeek IN (1, 2, 6) THEN CASE WHEN Promo <= 0.5 THEN -0.5 ELSE 1.125 END ELSE 0.25 END"
    second = """CASE WHEN promo_count_14d <= 4.5 THEN CASE WHEN DAY(Date) <= 15 THEN 0.75 ELSE -1.25 END
      ELSE CASE WHEN DayOfWeek = 5 THEN 2.0 ELSE 0.0625 END END"""
    fold = "CAST('0x' || SUBSTR(MD5('42|' || Store || '|' || Date), 1, 7) AS INT) % 5"
    own = ", ".join(f"CASE WHEN label = 'baseline' THEN {m} END AS {m}" for m in ("rmse", "mape", "wape"))
    names = "full no_lags no_store no_dow_mean lr_0.03_leaves_256 lr_0.10_leaves_64 seed_1 seed_2 seed_3".split()
    serving = _serving_queries()["range_forecast"].rsplit("SELECT request_id", 1)[0]
    return {
        "tree_scores": sql(
            PANEL,
            promo_features("panel", "pf"),
            body=f"""SELECT Store, Date, ROUND(8 + 0.1 * CAST({first} AS DOUBLE) + 0.1 * CAST({second} AS DOUBLE) + 0.1 * 3, 6) AS score
              FROM pf WHERE NOT is_gap""",
        ),
        "store_levels_by_fold": sql(
            f"""t AS (SELECT Store, {fold} AS fold, LN(1 + Sales) AS y FROM daily WHERE Open = 1 AND Date < {VALID}),
            f AS (SELECT DISTINCT fold FROM t),
            m AS (SELECT f.fold, AVG(y) AS overall FROM f JOIN t ON t.fold <> f.fold GROUP BY 1),
            o AS (SELECT f.fold, t.Store, SUM(y) AS s, COUNT(*) AS n FROM f JOIN t ON t.fold <> f.fold GROUP BY 1, 2)""",
            body="""SELECT k.Store, k.fold, ROUND((COALESCE(s, 0) + 10 * overall) / (COALESCE(n, 0) + 10), 6) AS level
              FROM (SELECT DISTINCT Store, fold FROM t) k JOIN m ON k.fold = m.fold
              LEFT JOIN o ON k.fold = o.fold AND k.Store = o.Store""",
        ),
        "gbt_scored_days": sql(
            BOTH_LONG,
            f"""s AS (SELECT split, 'baseline' AS label, {metrics()} FROM both_long WHERE label = 'weekday_median_4w' GROUP BY 1),
            both_labels AS (SELECT * FROM s UNION ALL SELECT split, 'model', n_scored, rmse, mape, wape FROM s)""",
            body=f"SELECT split, label, n_scored, {own} FROM both_labels",
        ),
        "gbt_importance_total": "SELECT 41 AS n_features, 100.0 AS total_pct, 0 AS negative",
        "gbt_variant_rounds": f"SELECT UNNEST({names}) AS name, TRUE AS ended_by_patience",
        "gbt_submission_days": sql(body="SELECT Id, COALESCE(Open, 1) = 0 AS nothing_sold FROM calendar"),
        "gbt_published": sql(body="SELECT Id FROM calendar"),
        "gbt_range_days": serving
        + """SELECT request_id, store_id, Date AS date, Open = 1 AS open, Promo = 1 AS promo,
          CAST(Sales AS DOUBLE) AS actual_sales, TRUE AS said FROM said""",
        "gbt_saved_model": sql(body=f"SELECT COUNT(*) AS rows, 0 AS rows_differ FROM daily WHERE Date BETWEEN {TEST} AND {TEST_END}"),
    }


# The same statements over suppliers as stores: other keys and another sum of the lines.
_SUPPLIERS = (
    ("CAST(c_nationkey AS INT) AS Store", "CAST(l_suppkey AS INT) AS Store"),
    (" JOIN customer ON o_custkey = c_custkey", ""),
    ("FROM nation", "FROM supplier"),
    ("n_nationkey", "s_suppkey"),
)


def by_supplier(statement: str) -> str:
    for nation, supplier in _SUPPLIERS:
        statement = statement.replace(nation, supplier)
    return statement


def statements(growing: tuple[str, ...] = ()) -> dict[str, str]:
    """All statements; those named in ``growing`` also over suppliers."""
    found = _statements()
    return found | {f"supplier_{name}": by_supplier(found[name]) for name in growing}


def _statements() -> dict[str, str]:
    return {
        **_file_queries(),
        **_panel_queries(),
        **_feature_queries(),
        **_score_queries(),
        **_profile_queries(),
        **_encoding_queries(),
        **_check_queries(),
        **_run_queries(),
        **_serving_queries(),
        **_classical_queries(),
        **_tree_queries(),
    }
