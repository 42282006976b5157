"""Registry of the queries that need no language-model subpackage: each with its plan and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import backtest as bt
from weftline.operators import estimators as es
from weftline.operators import features as ft
from weftline.operators import forecast as fc
from weftline.operators import ingest as ig
from weftline.operators import macro as mc
from weftline.operators import panel as pn
from weftline.operators import signals as sg
from weftline.functions import stats
from weftline.schema import rounded
from weftline.sources.workbook import column_index

from . import sql, views

Query = Callable[[SparkSession, str], DataFrame]
H = 26
CLEAN, GAPS, BROAD = "c_mktsegment", "n_name", "r_name"


def _series(spark: SparkSession, d: str, grain: str) -> DataFrame:
    return pn.series(pn.weekly_grid(pn.order_panel(spark, d, grain)))


def _grid(spark: SparkSession, d: str, grain: str) -> DataFrame:
    return pn.weekly_grid(pn.order_panel(spark, d, grain))


def show(df: DataFrame, **digits: int) -> DataFrame:
    """Doubles to a fixed number of digits by the floor form, which any engine repeats; ratios by name, others to three."""
    return df.select(*[rounded(F.col(c), digits.get(c, 3)).alias(c) if kind == "double" else F.col(c).cast("bigint").alias(c) if kind in ("int", "smallint") else F.col(c) for c, kind in df.dtypes])


def _same(columns: list[str], source: str, head: str, **digits: int) -> str:
    """SQL that rounds the named columns; those marked with ! are taken as they are."""
    out = ", ".join(c[1:] if c[0] == "!" else f"{sql.rnd(c, digits.get(c, 3))} AS {c}" for c in columns)
    return f"WITH {head} SELECT {out} FROM {source}"


RATIOS = {c: 6 for c in ("roc_1", "roc_4", "roc_13", "yoy_52", "drawdown_26", "recovery_26", "disparity24", "trix", "trix_signal", "zscore26", "momentum13", "rsi14", "hit_rate", "p_value", "p_value_vs_naive", "mase", "directional_accuracy", "high_score", "low_score", "return_pct", "mean_forward_return_pct", "hit_rate_pct", "wape_pct", "direction_accuracy_pct", "naive_improvement_pct", "r13", "r52", "negative_vote", "positive_vote", "pct")}

_REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, text: str | None = None):
    def add(f: Query) -> Query:
        _REGISTRY[name] = (f, text)
        return f

    return add


@query("weekly_panel", f"WITH {sql.panel(GAPS)} SELECT * FROM p")
def weekly_panel(spark, d):
    return pn.order_panel(spark, d, GAPS)


@query("weekly_grid", f"WITH {sql.grid(GAPS)} SELECT * FROM g")
def weekly_grid(spark, d):
    return _grid(spark, d, GAPS)


@query("gap_runs", f"WITH {sql.runs(GAPS)} SELECT region, CAST(count(*) AS BIGINT) AS weeks, count(*) FILTER (value IS NULL) AS missing, CAST(max(run) AS BIGINT) AS longest_gap FROM r GROUP BY region")
def gap_runs(spark, d):
    return pn.with_runs(_grid(spark, d, GAPS)).groupBy("region").agg(F.count(F.lit(1)).alias("weeks"), F.count_if(F.col("value").isNull()).alias("missing"), F.max("run").alias("longest_gap"))


@query("gap_fill_dashboard", f"WITH {sql.filled(GAPS, 2)} SELECT region, date, {sql.rnd('filled')} AS value, value IS NULL AS is_imputed FROM f WHERE filled IS NOT NULL")
def gap_fill_dashboard(spark, d):
    return show(pn.fill_dashboard(_grid(spark, d, GAPS)))


@query("gap_fill_library", f"""WITH {sql.filled(GAPS, 2)}, {sql.run_steps()}, x AS (SELECT region, max(run) AS longest FROM r GROUP BY region)
SELECT f.region, f.date, {sql.rnd('CASE WHEN longest < 3 THEN filled ELSE f.value END')} AS value, f.value IS NULL AND longest < 3 AND filled IS NOT NULL AS is_imputed FROM f JOIN x ON x.region = f.region""")
def gap_fill_library(spark, d):
    return show(pn.fill_library(_grid(spark, d, GAPS)))


@query("gap_fill_series", f"WITH {sql.series(GAPS)} SELECT region, date, {sql.rnd('value')} AS value FROM s")
def gap_fill_series(spark, d):
    return show(_series(spark, d, GAPS))


_EVENTS = "ev AS (SELECT event_type AS region, CAST(date_trunc('day', ts) AS DATE) AS date, floor(value) AS value, event_id FROM events)"


def _event_rows(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_type").alias("region"), F.to_date("ts").alias("date"), F.floor("value").cast("double").alias("value"), "event_id")


@query("duplicate_conflicts", f"WITH {_EVENTS}, x AS (SELECT region, date, min(value) AS value, count(DISTINCT value) AS n_values FROM ev WHERE value IS NOT NULL GROUP BY region, date) SELECT region, date, CAST(value AS DOUBLE) AS value, n_values FROM x")
def duplicate_conflicts(spark, d):
    return pn.dedup_checked(_event_rows(spark, d)).select("region", "date", "value", F.col("n_values").cast("bigint").alias("n_values"))


@query("duplicate_last", f"WITH {_EVENTS} SELECT region, date, CAST(arg_max(value, event_id) AS DOUBLE) AS value FROM ev WHERE value IS NOT NULL GROUP BY region, date")
def duplicate_last(spark, d):
    return pn.dedup_last(_event_rows(spark, d), "event_id")


@query("qa_counts", f"WITH {sql.runs(GAPS)}, q AS (SELECT region, count(*) AS weeks, count(*) FILTER (value IS NULL) AS missing, CAST(max(run) AS BIGINT) AS longest_gap FROM r GROUP BY region) SELECT region, weeks, missing, longest_gap, CAST(0 AS BIGINT) AS conflicts, CASE WHEN longest_gap < 3 THEN missing ELSE 0 END AS imputed, CAST((longest_gap >= 3) AS BIGINT) + CAST(weeks - missing + CASE WHEN longest_gap < 3 THEN missing ELSE 0 END < 104 AS BIGINT) AS n_blocking, CAST(longest_gap BETWEEN 1 AND 2 AS BIGINT) AS n_warnings FROM q")
def qa_counts(spark, d):
    p = pn.order_panel(spark, d, GAPS)
    q = pn.quality(p, pn.weekly_grid(p))
    return q.select("region", "weeks", "missing", "longest_gap", F.col("conflicts").cast("bigint").alias("conflicts"), F.col("imputed").cast("bigint").alias("imputed"), F.size("blocking").cast("bigint").alias("n_blocking"), F.size("warnings").cast("bigint").alias("n_warnings"))


@query("date_floor_monday", "SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week FROM orders")
def date_floor_monday(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.to_date(F.date_trunc("week", "o_orderdate")).alias("week"))


@query("excel_serial", "SELECT o_orderkey, CAST(DATE '1899-12-30' + CAST(floor(o_totalprice / 10) AS INT) AS DATE) AS day FROM orders WHERE o_totalprice > 0")
def excel_serial(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").where("o_totalprice > 0")
    return o.select("o_orderkey", F.expr("date_add(DATE'1899-12-30', cast(floor(o_totalprice / 10) as int))").alias("day"))


@query("parse_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS library, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS dashboard FROM orders")
def parse_dates(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate")
    form = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, form("yyyy.MM.dd")).when(k == 1, form("yyyy-MM-dd")).when(k == 2, form("yyyy/MM/dd")).otherwise(form("yyyyMMdd"))
    return o.select("o_orderkey", ig.library_date(raw, F.lit("text")).alias("library"), ig.dashboard_date(raw).alias("dashboard"))


@query("parse_numbers", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS DOUBLE) END AS value FROM orders")
def parse_numbers(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.floor("o_totalprice").alias("v"))
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a")).otherwise(F.format_number("v", 0))
    return o.select("o_orderkey", ig.number(raw).alias("value"))


@query("header_dedup", "SELECT CAST(n_nationkey AS BIGINT) AS col_idx, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS header FROM (SELECT n_nationkey, base, row_number() OVER (PARTITION BY base ORDER BY n_nationkey) AS k FROM (SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'column_' || n_nationkey ELSE r_name END AS base FROM nation JOIN region ON n_regionkey = r_regionkey))")
def header_dedup(spark, d):
    n, r = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    raw = F.when(F.col("n_regionkey") == 0, F.lit(" ")).otherwise(F.col("r_name"))
    names = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.lit("s").alias("source_name"), F.lit("f").alias("fingerprint"), F.lit("t").alias("sheet_name"), F.col("n_nationkey").alias("col_idx"), raw.alias("raw"))
    return ig.unique_headers(names).select(F.col("col_idx").cast("bigint").alias("col_idx"), "header")


@query("col_to_index", "SELECT s_suppkey, CAST((s_suppkey % 26 + 1) * 26 + s_suppkey % 7 AS BIGINT) AS col_idx FROM supplier")
def col_to_index(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    ref = F.concat(F.char(65 + F.col("s_suppkey") % 26), F.char(65 + F.col("s_suppkey") % 7), F.col("s_suppkey"))
    return s.select("s_suppkey", column_index(ref).cast("bigint").alias("col_idx"))


@query("binomial_tails", f"SELECT hits, n, {sql.rnd(sql.binomial_tail('hits', 'n'), 9)} AS p FROM (SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS hits, CAST(l_quantity AS BIGINT) AS n FROM lineitem WHERE l_linenumber <= l_quantity)")
def binomial_tails(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber <= l_quantity").select(F.col("l_linenumber").cast("bigint").alias("hits"), F.col("l_quantity").cast("bigint").alias("n")).distinct()
    return x.select("hits", "n", rounded(stats.binomial_tail(F.col("hits"), F.col("n")), 9).alias("p"))


@query("t_tails", f"SELECT p_size, n, {sql.rnd(sql.mean_tail('n', 'm', 's'), 9)} AS p FROM (SELECT CAST(p_size AS BIGINT) AS p_size, count(*) AS n, avg(p_retailprice - 1400) AS m, stddev_samp(p_retailprice - 1400) AS s FROM part GROUP BY 1)")
def t_tails(spark, d):
    x = F.col("p_retailprice") - 1400
    got = spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_size").cast("bigint").alias("p_size")).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    return got.select("p_size", "n", rounded(stats.mean_tail(F.col("n"), F.col("m"), F.col("s")), 9).alias("p"))


_LAGS = [f"lag_{k}" for k in range(1, 27)]


@query("lags_1_26", f"WITH {sql.series(CLEAN)} SELECT region, date, {', '.join(f'{sql.rnd(f'lag(value, {k}) OVER ({sql.PART})')} AS lag_{k}' for k in range(1, 27))} FROM s")
def lags_1_26(spark, d):
    return show(ft.feature_matrix(_series(spark, d, CLEAN)).select("region", "date", *_LAGS))


_FEATURES = {
    **{f"roll_{n}_{w}": sql.roll(f, "value", w) for w in (4, 13, 26) for n, f in (("mean", "avg"), ("std", "stddev_samp"))},
    "drawdown_26": f"value / ({sql.roll('max', 'value', 26, 4)}) - 1", "recovery_26": f"value / ({sql.roll('min', 'value', 26, 4)}) - 1",
    **{n: sql.change("value", k) for n, k in (("roc_1", 1), ("roc_4", 4), ("roc_13", 13), ("yoy_52", 52))},
    "ma6": sql.roll("avg", "value", 6), "ma24": sql.roll("avg", "value", 24), "macd": "macd", "macd_signal": "macd_signal", "macd_hist": "macd - macd_signal",
    "disparity24": f"value / ({sql.roll('avg', 'value', 24)}) * 100", "trix": "trix", "trix_signal": "trix_signal",
}


@query("feature_matrix", f"WITH {sql.recursive(CLEAN)}, z AS (SELECT *, ({sql.middle('value', 9)} + {sql.middle('value', 26)}) / 2 AS a, {sql.middle('value', 52)} AS b FROM rec) SELECT region, date, {', '.join(f'{sql.rnd(x, RATIOS.get(n, 3))} AS {n}' for n, x in _FEATURES.items())}, CASE WHEN a > b AND value >= a THEN 1.0 WHEN a < b AND value <= b THEN -1.0 ELSE 0.0 END::DOUBLE AS ichimoku_state FROM z")
def feature_matrix(spark, d):
    return show(ft.feature_matrix(_series(spark, d, CLEAN)).select("region", "date", *_FEATURES, "ichimoku_state"), **RATIOS)


_INDICATORS = ["value", "ma13", "ma26", "ma52", "bb_mid", "bb_upper", "bb_lower", "macd", "macd_signal", "rsi14", "tenkan", "kijun", "span_a", "span_b", "zscore26", "momentum13"]


@query("indicator_frame", _same(["!region", "!date", *_INDICATORS], "ind", sql.indicators(CLEAN), **RATIOS))
def indicator_frame(spark, d):
    return show(ft.indicator_frame(_series(spark, d, CLEAN)), **RATIOS)


@query("rolling_percentile_156", f"WITH {sql.series(CLEAN)}, x AS (SELECT region, date, list(value) OVER ({sql.PART} ROWS BETWEEN 155 PRECEDING AND CURRENT ROW) AS a FROM s) SELECT region, date, {sql.rnd('CASE WHEN len(a) >= 26 THEN len(list_filter(a, lambda v: v <= a[-1])) / len(a) * 100 END', 6)} AS pct FROM x")
def rolling_percentile_156(spark, d):
    return show(_series(spark, d, CLEAN).select("region", "date", ft.percentile_of_last(F.col("value")).alias("pct")), pct=6)


@query("risk_scores", _same(["!region", "!date", "high_score", "low_score"], "k", sql.risk(GAPS), **RATIOS))
def risk_scores(spark, d):
    return show(ft.risk_scores(_series(spark, d, GAPS)), **RATIOS)


@query("turning_points", f"WITH {sql.turning(GAPS)} SELECT region, date, event, {sql.rnd('value')} AS value FROM tp")
def turning_points(spark, d):
    return show(ft.turning_points(_series(spark, d, GAPS)))


@query("event_study", f"WITH {sql.risk(GAPS, sql.turning(GAPS))}, sl AS (SELECT region, date, 'high' AS signal_type, high_score AS score, 'peak' AS event FROM k UNION ALL SELECT region, date, 'low', low_score, 'trough' FROM k), h AS (SELECT *, EXISTS (SELECT 1 FROM tp WHERE tp.region = sl.region AND tp.event = sl.event AND tp.date BETWEEN sl.date + 7 AND sl.date + 56) AS hit FROM sl) SELECT region, signal_type, count(*) FILTER (score >= 80) AS signals, count(*) FILTER (score >= 80 AND hit) AS hits, {sql.rnd('coalesce(count(*) FILTER (score >= 80 AND hit) / nullif(count(*) FILTER (score >= 80), 0), 0.0)', 6)} AS hit_rate FROM h GROUP BY region, signal_type")
def event_study(spark, d):
    return show(ft.event_study(_series(spark, d, GAPS)), **RATIOS)


@query("signals_long", f"WITH {sql.signals(CLEAN)} SELECT region, date, indicator, signal, direction FROM sl WHERE fired")
def signals_long(spark, d):
    return sg.signals_long(ft.indicator_frame(_series(spark, d, CLEAN))).where("fired").select("region", "date", "indicator", "signal", "direction")


@query("signal_summary", _same(["!region", "!indicator", "!signal", "!direction", "!samples", "hit_rate_pct", "mean_forward_return_pct", "p_value", "!passed"], "ss", sql.summary(CLEAN), **RATIOS))
def signal_summary(spark, d):
    return show(sg.signal_summary(ft.indicator_frame(_series(spark, d, CLEAN))), **RATIOS)


@query("signal_events", f"WITH {sql.summary(CLEAN)} SELECT sl.region, sl.date, {sql.rnd('sl.value')} AS value, sl.indicator, sl.signal, sl.direction FROM sl JOIN ss ON ss.region = sl.region AND ss.signal = sl.signal AND ss.indicator = sl.indicator WHERE fired AND passed")
def signal_events(spark, d):
    return show(sg.signal_events(ft.indicator_frame(_series(spark, d, CLEAN))))


_MACRO = """mo AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS discount FROM lineitem GROUP BY 1),
qu AS (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS date, CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS tax FROM lineitem GROUP BY 1),
ma AS (SELECT 'quantity' AS indicator, date, quantity AS value FROM mo UNION ALL SELECT 'discount', date, discount FROM mo UNION ALL SELECT 'tax', date, tax FROM qu),
fr AS (SELECT indicator, CASE WHEN count(*) < 2 THEN 'M' WHEN median(gap) >= 60 THEN 'Q' WHEN median(gap) >= 20 THEN 'M' ELSE 'W' END AS freq FROM (SELECT indicator, date - lag(date) OVER (PARTITION BY indicator ORDER BY date) AS gap FROM ma) GROUP BY indicator),
re AS (SELECT indicator, freq, CAST(date + CASE freq WHEN 'M' THEN 28 WHEN 'Q' THEN 42 ELSE 7 END AS DATE) AS date, value FROM ma JOIN fr USING (indicator)),
ba AS (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS date FROM orders),
ao AS (SELECT gr.indicator, gr.freq, gr.date, re.value FROM (SELECT date, indicator, freq FROM ba CROSS JOIN fr) AS gr ASOF LEFT JOIN re ON re.indicator = gr.indicator AND re.date <= gr.date)"""


def _macro(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    total = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    month = li.groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("date")).agg(total("l_quantity").alias("quantity"), total("l_discount").alias("discount")).unpivot("date", ["quantity", "discount"], "indicator", "value")
    quarter = li.groupBy(F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("date")).agg(total("l_tax").alias("tax")).unpivot("date", ["tax"], "indicator", "value")
    return month.unionByName(quarter)


def _weeks(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.to_date(F.date_trunc("week", "o_orderdate")).alias("date"))


@query("macro_frequency", f"WITH {_MACRO} SELECT * FROM fr")
def macro_frequency(spark, d):
    return mc.frequency(_macro(spark, d))


@query("macro_asof", f"WITH {_MACRO} SELECT * FROM ao")
def macro_asof(spark, d):
    return mc.macro_asof(_weeks(spark, d), _macro(spark, d)).select("indicator", "freq", "date", "value")


_QUARTER, _OTHER = "freq = 'Q'", "freq <> 'Q'"
_LAGGED = [(i, k) for i in ("discount", "quantity", "tax") for k in (4, 8, 12, 24)]


@query("macro_lag_features", f"WITH {_MACRO}, lg AS (SELECT indicator, freq, date, {', '.join(f'lag(value, {k}) OVER (PARTITION BY indicator ORDER BY date) AS l{k}' for k in (4, 8, 12, 24))} FROM ao) SELECT date, " + ", ".join(f"max(l{k}) FILTER (indicator = '{i}' AND ({'true' if k == 12 else _QUARTER if k == 24 else _OTHER})) AS {i}_lag_{k}w" for i, k in _LAGGED) + " FROM lg GROUP BY date")
def macro_lag_features(spark, d):
    return mc.lag_columns(_weeks(spark, d), _macro(spark, d), ["discount", "quantity", "tax"])


@query("cutoffs_rolling", f"WITH {sql.cutoffs(GAPS, H)} SELECT region, CAST(position AS BIGINT) AS position FROM cu")
def cutoffs_rolling(spark, d):
    return show(bt.cutoffs_rolling(bt.lengths(_series(spark, d, GAPS)), H))


@query("cutoffs_end_anchored", f"WITH {sql.cutoffs_end(GAPS, H)} SELECT region, CAST(position AS BIGINT) AS position FROM cu")
def cutoffs_end_anchored(spark, d):
    return show(bt.cutoffs_end(bt.lengths(_series(spark, d, GAPS)), H))


@query("cutoffs_start_anchored", f"WITH {sql.cutoffs_start(GAPS, H)} SELECT region, CAST(position AS BIGINT) AS position FROM cu")
def cutoffs_start_anchored(spark, d):
    return show(bt.cutoffs_start(bt.lengths(_series(spark, d, GAPS)), H))


_FULL = sql.baselines(sql.series(CLEAN), H, full=True)


@query("forecast_baselines", f"WITH {_FULL} SELECT region, CAST(cutoff + CAST(7 * step AS INT) AS DATE) AS date, CAST(step AS BIGINT) AS step, model, {sql.rnd('forecast')} AS forecast FROM b")
def forecast_baselines(spark, d):
    return show(fc.full_forecasts(_series(spark, d, CLEAN), H))


def _pred(spark, d, planner=bt.cutoffs_rolling, grain=CLEAN):
    # used several times by what follows: kept, not worked out again
    s = _series(spark, d, grain).persist()
    cuts = planner(bt.lengths(s), H)
    return s, bt.predictions(s, bt.baseline_forecasts(s, cuts, H)).persist()


@query("backtest_predictions", f"WITH {sql.predictions(sql.cutoffs(CLEAN, H), H)} SELECT region, cutoff, target_date, CAST(step AS BIGINT) AS step, {sql.rnd('origin')} AS origin, {sql.rnd('actual')} AS actual, {sql.rnd('forecast')} AS forecast, model FROM pr")
def backtest_predictions(spark, d):
    return show(_pred(spark, d)[1])


_BOARD = ["mae", "rmse", "mase", "wape_pct", "direction_accuracy_pct", "naive_improvement_pct", "p_value_vs_naive", "!n_predictions", "!passed"]


@query("leaderboard_dashboard", _same(["!region", "!model", *_BOARD, "!place"], "lb", sql.board_dashboard(CLEAN, H), **RATIOS))
def leaderboard_dashboard(spark, d):
    s, pred = _pred(spark, d)
    return show(bt.leaderboard_dashboard(pred, bt.mase_scale(s)), **RATIOS)


@query("model_selection_top3", f"WITH {sql.board_dashboard(GAPS, H)} SELECT * FROM se")
def model_selection_top3(spark, d):
    s, pred = _pred(spark, d, grain=GAPS)
    return show(bt.select_models(bt.leaderboard_dashboard(pred, bt.mase_scale(s))))


@query("leaderboard_library", _same(["!region", f"!CAST({H} AS BIGINT) AS horizon", "!model", "mae", "rmse", "mase", "directional_accuracy", "!n_windows"], "yb", sql.board_library(CLEAN, H), **RATIOS))
def leaderboard_library(spark, d):
    s, pred = _pred(spark, d, bt.cutoffs_end)
    return show(bt.library_report(pred, bt.mase_scale(s), H)[0], **RATIOS)


@query("top2_ensemble", f"WITH {sql.board_library(CLEAN, H)} SELECT region, CAST({H} AS BIGINT) AS horizon, cutoff, target_date, {sql.rnd('actual')} AS actual, {sql.rnd('origin')} AS origin, 'Top2Ensemble' AS model, {sql.rnd('forecast')} AS forecast, {sql.rnd('forecast - actual')} AS residual FROM en")
def top2_ensemble(spark, d):
    s, pred = _pred(spark, d, bt.cutoffs_end)
    return show(bt.library_report(pred, bt.mase_scale(s), H)[1])


_INTERVAL = sql.board_dashboard(CLEAN, H) + f""",
fb AS (SELECT region, origin, CAST(cutoff + CAST(7 * step AS INT) AS DATE) AS date, step, model, forecast FROM (SELECT *, count(*) FILTER (forecast > 0) OVER (PARTITION BY region, model) AS good2 FROM (
  SELECT w.region, w.step, w.cutoff, w.origin, w.model, CASE w.model WHEN 'Naive' THEN w.origin WHEN 'Drift' THEN w.origin + (w.origin - w.v0) / greatest(1, w.position - 1) * w.step ELSE q.value END AS forecast
  FROM (SELECT *, unnest(['Naive', 'Drift', 'SeasonalNaive52']) AS model FROM (SELECT z.region, z.n AS position, z.value AS origin, z.date AS cutoff, a.value AS v0, unnest(range(1, {H + 1})) AS step FROM sn AS z JOIN sn AS a ON a.region = z.region AND a.rn = 1 WHERE z.rn = z.n)) AS w
  LEFT JOIN sn AS q ON q.region = w.region AND w.position >= 52 AND q.rn = w.position - 52 + (w.step - 1) % 52 + 1)) WHERE good2 = {H}),
er AS (SELECT pr.region, quantile_cont((actual - forecast) / nullif(forecast, 0), 0.1) AS q10, quantile_cont((actual - forecast) / nullif(forecast, 0), 0.9) AS q90 FROM pr JOIN se ON se.region = pr.region AND se.model = pr.model GROUP BY pr.region),
vo AS (SELECT region, stddev_samp(r) AS vol FROM (SELECT region, r, row_number() OVER (PARTITION BY region ORDER BY date DESC) AS k FROM (SELECT region, date, value / lag(value) OVER (PARTITION BY region ORDER BY date) - 1 AS r FROM s) WHERE r IS NOT NULL) WHERE k <= 156 GROUP BY region),
pt AS (SELECT fb.region, fb.date, fb.step, avg(forecast) AS p50 FROM fb JOIN se ON se.region = fb.region AND se.model = fb.model GROUP BY ALL),
sd AS (SELECT region, step, min(forecast) AS low, max(forecast) AS high FROM fb GROUP BY ALL),
bd AS (SELECT pt.*, low, high, q10, q90, 1.64 * CASE WHEN vol > 0 THEN vol ELSE 0.002 END * sqrt(pt.step) AS band FROM pt JOIN sd ON sd.region = pt.region AND sd.step = pt.step JOIN er ON er.region = pt.region JOIN vo ON vo.region = pt.region),
ff AS (SELECT region, date, step, p50, least(CASE WHEN q10 < 0 THEN p50 * (1 + q10 - band * 0.25) ELSE p50 * (1 - band) END, low, p50) AS p10, greatest(CASE WHEN q90 > 0 THEN p50 * (1 + q90 + band * 0.25) ELSE p50 * (1 + band) END, high, p50) AS p90 FROM bd)"""


def _dashboard(spark, d):
    s, pred = _pred(spark, d)
    chosen = bt.select_models(bt.leaderboard_dashboard(pred, bt.mase_scale(s))).persist()
    forecasts = fc.full_forecasts(s, H).persist()
    return s, forecasts, fc.dashboard_forecast(s, H, pred, chosen, forecasts)


@query("forecast_frame", f"WITH {_INTERVAL}, nm AS (SELECT region, string_agg(CASE model WHEN 'SeasonalNaive52' THEN 'Seasonal Naive 52주' ELSE model END, ', ' ORDER BY rank) AS selected_models FROM se GROUP BY region) SELECT ff.region, date, CAST(step AS BIGINT) AS step, {sql.rnd('p50')} AS p50, {sql.rnd('p10')} AS p10, {sql.rnd('p90')} AS p90, selected_models FROM ff JOIN nm ON nm.region = ff.region")
def forecast_frame(spark, d):
    return show(_dashboard(spark, d)[2])


@query("votes", f"WITH {_INTERVAL}, v AS (SELECT *, avg(CAST(forecast < origin AS DOUBLE)) OVER (PARTITION BY region) * 100 AS negative_vote, avg(CAST(forecast > origin AS DOUBLE)) OVER (PARTITION BY region) * 100 AS positive_vote FROM fb WHERE step = {H}) SELECT region, model, {sql.rnd('forecast')} AS forecast_last, {sql.rnd('(forecast / origin - 1) * 100', 6)} AS return_pct, {sql.rnd('negative_vote', 6)} AS negative_vote, {sql.rnd('positive_vote', 6)} AS positive_vote FROM v")
def votes(spark, d):
    s, forecasts, _ = _dashboard(spark, d)
    return show(fc.votes(s, forecasts, H), **RATIOS)


_BUNDLE = sql.board_library(CLEAN, H) + f""",
fy AS (SELECT z.region, z.value AS origin, z.date AS cutoff, z.n AS position, a.value AS v0, unnest(range(1, {H + 1})) AS step FROM sn AS z JOIN sn AS a ON a.region = z.region AND a.rn = 1 WHERE z.rn = z.n),
fz AS (SELECT fy.*, q.value AS seasonal FROM fy LEFT JOIN sn AS q ON q.region = fy.region AND fy.position >= 52 AND q.rn = fy.position - 52 + (fy.step - 1) % 52 + 1),
fx AS (SELECT region, cutoff, step, origin, 'Naive' AS model, origin AS forecast FROM fz UNION ALL SELECT region, cutoff, step, origin, 'Drift', origin + (origin - v0) / greatest(1, position - 1) * step FROM fz UNION ALL SELECT region, cutoff, step, origin, 'SeasonalNaive52', seasonal FROM fz WHERE seasonal IS NOT NULL),
tw AS (SELECT region, model FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY mase, mae, model) AS rank FROM yb) WHERE rank <= 2 AND model <> 'Top2Ensemble'),
rq AS (SELECT region, quantile_cont(forecast - actual, 0.1) AS q10, quantile_cont(forecast - actual, 0.9) AS q90 FROM en GROUP BY region),
bu AS (SELECT fx.region, CAST(cutoff + CAST(7 * step AS INT) AS DATE) AS date, step, avg(forecast) AS p50 FROM fx JOIN tw ON tw.region = fx.region AND tw.model = fx.model GROUP BY ALL)"""


@query("forecast_bundle", f"WITH {_BUNDLE} SELECT bu.region, date, CAST(step AS BIGINT) AS step, {sql.rnd('p50')} AS p50, {sql.rnd('p50 + q10')} AS p10, {sql.rnd('p50 + q90')} AS p90 FROM bu JOIN rq ON rq.region = bu.region")
def forecast_bundle(spark, d):
    s, pred = _pred(spark, d, bt.cutoffs_end)
    board, ensemble = bt.library_report(pred, bt.mase_scale(s), H)
    return show(fc.library_forecast(s, H, board, ensemble, fc.full_forecasts(s, H)))


@query("risk_composite", f"WITH {_INTERVAL}, {sql.composite_steps(H)} SELECT * FROM rc")
def risk_composite(spark, d):
    s, forecasts, frame = _dashboard(spark, d)
    return fc.risk_composite(s, frame, fc.votes(s, forecasts, H))


@query("kpi_summary", f"WITH {sql.series(BROAD)}, x AS (SELECT region, value, date, lag(value, 13) OVER ({sql.PART}) AS a, lag(value, 52) OVER ({sql.PART}) AS b, rn, n FROM sn) SELECT region, CAST(min(date) AS DATE) AS first_date, CAST(max(date) AS DATE) AS last_date, count(*) AS weeks, {sql.rnd('max(value) FILTER (rn = n)')} AS latest, {sql.rnd('max((value / a - 1) * 100) FILTER (rn = n AND n > 14)', 6)} AS r13, {sql.rnd('max((value / b - 1) * 100) FILTER (rn = n AND n > 53)', 6)} AS r52 FROM x GROUP BY region")
def kpi_summary(spark, d):
    return show(views.kpis(_series(spark, d, BROAD)), **RATIOS)


@query("unpivot_returns", f"WITH {sql.series(BROAD)}, x AS (SELECT region, value, lag(value, 13) OVER ({sql.PART}) AS a, lag(value, 52) OVER ({sql.PART}) AS b, rn, n FROM sn), y AS (SELECT region, max((value / a - 1) * 100) FILTER (rn = n AND n > 14) AS r13, max((value / b - 1) * 100) FILTER (rn = n AND n > 53) AS r52 FROM x GROUP BY region) SELECT region, period, {sql.rnd('return_pct', 6)} AS return_pct FROM (SELECT region, 'r13' AS period, r13 AS return_pct FROM y UNION ALL SELECT region, 'r52', r52 FROM y)")
def unpivot_returns(spark, d):
    return show(views.returns_long(_series(spark, d, BROAD)), **RATIOS)


@query("last_420", f"WITH {sql.series(BROAD)} SELECT region, date, {sql.rnd('value')} AS value FROM sn WHERE rn > n - 420")
def last_420(spark, d):
    return show(views.tail(_series(spark, d, BROAD), 420))


def _estimated(spark, d, models):
    s = _series(spark, d, CLEAN)
    last = bt.lengths(s).select("region", F.col("n").cast("int").alias("position"))
    return es.forecasts(s, last, H, models)


@query("estimators_dashboard")
def estimators_dashboard(spark, d):
    return _estimated(spark, d, es.DASHBOARD)


@query("estimators_library")
def estimators_library(spark, d):
    return _estimated(spark, d, es.LIBRARY)


@query("estimators_direct_boosting")
def estimators_direct_boosting(spark, d):
    s = _series(spark, d, CLEAN)
    return es.direct_forecasts(s, bt.cutoffs_start(bt.lengths(s), H), H)


@query("backtest_all_models")
def backtest_all_models(spark, d):
    """The dashboard's leaderboard with every model."""
    s = _series(spark, d, CLEAN).persist()
    cuts = bt.cutoffs_rolling(bt.lengths(s), H).persist()
    made = bt.baseline_forecasts(s, cuts, H).unionByName(es.forecasts(s, cuts, H, es.DASHBOARD))
    return bt.leaderboard_dashboard(bt.predictions(s, made).persist(), bt.mase_scale(s))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indicator frame of all regions."""
    return indicator_frame(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: t for k, (_, t) in _REGISTRY.items() if t}


