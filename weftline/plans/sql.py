"""DuckDB SQL of the registered queries, built from common table expressions."""

from __future__ import annotations

PART = "PARTITION BY region ORDER BY date"


def panel(grain: str) -> str:
    return f"""p AS (SELECT {grain} AS region, CAST(date_trunc('week', o_orderdate) AS DATE) AS date, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region AS r0 ON n_regionkey = r_regionkey GROUP BY 1, 2)"""


def grid(grain: str) -> str:
    return panel(grain) + """,
g0 AS (SELECT region, CAST(unnest(generate_series(min(date), max(date), INTERVAL 7 DAY)) AS DATE) AS date FROM p GROUP BY region),
g AS (SELECT g0.region, g0.date, p.value FROM g0 LEFT JOIN p ON g0.region = p.region AND g0.date = p.date)"""


def filled(grain: str, limit: int) -> str:
    back, ahead = f"({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"({PART} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return grid(grain) + f""",
n0 AS (SELECT *, row_number() OVER ({PART}) AS rn FROM g),
n1 AS (SELECT *, last_value(value IGNORE NULLS) OVER {back} AS pv, last_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER {back} AS pr,
  first_value(value IGNORE NULLS) OVER {ahead} AS nv, first_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER {ahead} AS nr FROM n0),
f AS (SELECT region, date, value, CASE WHEN value IS NOT NULL THEN value WHEN rn - pr <= {limit} OR nr - rn <= {limit} THEN pv + (nv - pv) * (rn - pr) / (nr - pr) END AS filled FROM n1)"""


def series(grain: str) -> str:
    return filled(grain, 4) + f""",
s AS (SELECT region, date, filled AS value FROM f WHERE filled IS NOT NULL),
sn AS (SELECT *, row_number() OVER ({PART}) AS rn, count(*) OVER (PARTITION BY region) AS n FROM s)"""


def run_steps() -> str:
    return f"""m AS (SELECT *, CAST(value IS NULL AS INT) AS missing FROM g),
c AS (SELECT *, coalesce(CAST(missing <> lag(missing) OVER ({PART}) AS INT), 0) AS change FROM m),
d AS (SELECT *, sum(change) OVER ({PART} ROWS UNBOUNDED PRECEDING) AS run_id FROM c),
r AS (SELECT region, date, value, sum(missing) OVER (PARTITION BY region, run_id) AS run FROM d)"""


def runs(grain: str) -> str:
    return grid(grain) + ",\n" + run_steps()


def rnd(x: str, digits: int = 3) -> str:
    scale = float(10**digits)
    return f"floor(({x}) * {scale} + 0.5003) / {scale}"


def roll(fn: str, x: str, size: int, least: int | None = None) -> str:
    w = f"OVER ({PART} ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {size if least is None else least} THEN {fn}({x}) {w} END"


def change(x: str, k: int) -> str:
    return f"{x} / lag({x}, {k}) OVER ({PART}) - 1"


def middle(x: str, size: int) -> str:
    return f"(({roll('max', x, size)}) + ({roll('min', x, size)})) / 2"


def ema(before: str, x: str, alpha: float) -> str:
    return f"CASE WHEN {before} IS NULL THEN {x} ELSE {1 - alpha!r} * {before} + {alpha!r} * {x} END"


def recursive(grain: str) -> str:
    a12, a26, a9, a14 = 2 / 13, 2 / 27, 2 / 10, 1 / 14
    return "RECURSIVE " + series(grain) + f""",
e AS (
  SELECT region, rn, date, value, value AS e12, value AS e26, CAST(0 AS DOUBLE) AS sig, value AS t1, value AS t2, value AS t3, CAST(NULL AS DOUBLE) AS trix, CAST(NULL AS DOUBLE) AS tsig, CAST(NULL AS DOUBLE) AS gain, CAST(NULL AS DOUBLE) AS loss
  FROM sn WHERE rn = 1
  UNION ALL
  SELECT region, rn, date, value, e12, e26, {ema('osig', '(e12 - e26)', a9)}, t1, t2, t3, (t3 / ot3 - 1) * 100, {ema('otsig', '((t3 / ot3 - 1) * 100)', a9)}, {ema('ogain', 'greatest(dv, 0)', a14)}, {ema('oloss', 'greatest(-dv, 0)', a14)}
  FROM (SELECT *, {ema('ot3', 't2', a12)} AS t3 FROM (SELECT *, {ema('ot2', 't1', a12)} AS t2 FROM (
    SELECT x.region, x.rn, x.date, x.value, {ema('e.e12', 'x.value', a12)} AS e12, {ema('e.e26', 'x.value', a26)} AS e26, {ema('e.t1', 'x.value', a12)} AS t1, e.t2 AS ot2, e.t3 AS ot3, e.sig AS osig, e.tsig AS otsig, e.gain AS ogain, e.loss AS oloss, x.value - e.value AS dv
    FROM e JOIN sn AS x ON x.region = e.region AND x.rn = e.rn + 1)))),
rec AS (SELECT region, date, value, e12 - e26 AS macd, sig AS macd_signal, trix, tsig AS trix_signal, 100 - 100 / (1 + gain / nullif(loss, 0)) AS rsi14 FROM e)"""


def indicators(grain: str) -> str:
    mid, std = roll("avg", "value", 20, 12), roll("stddev_samp", "value", 20, 12)
    return recursive(grain) + f""",
i0 AS (SELECT region, date, value, {roll('avg', 'value', 13, 8)} AS ma13, {roll('avg', 'value', 26, 13)} AS ma26, {roll('avg', 'value', 52, 26)} AS ma52, {mid} AS bb_mid, ({mid}) + 2 * ({std}) AS bb_upper, ({mid}) - 2 * ({std}) AS bb_lower,
  macd, macd_signal, rsi14, {middle('value', 9)} AS tenkan, {middle('value', 26)} AS kijun, {middle('value', 52)} AS span_b, (value - ({roll('avg', 'value', 26, 13)})) / nullif({roll('stddev_samp', 'value', 26, 13)}, 0) AS zscore26, {change('value', 13)} AS momentum13 FROM rec),
ind AS (SELECT *, (tenkan + kijun) / 2 AS span_a FROM i0)"""


def risk(grain: str, base: str | None = None) -> str:
    win = f"({PART} ROWS BETWEEN 155 PRECEDING AND CURRENT ROW)"
    pct = lambda a: f"CASE WHEN len({a}) >= 26 THEN len(list_filter({a}, lambda v: v <= {a}[-1])) / len({a}) * 100 END"
    return (base or series(grain)) + f""",
k0 AS (SELECT region, date, value / ({roll('avg', 'value', 24)}) * 100 AS d, value / ({roll('max', 'value', 52, 13)}) AS n, -(value / ({roll('max', 'value', 26, 4)}) - 1) AS w FROM s),
k1 AS (SELECT region, date, list_filter(list(d) OVER {win}, lambda v: v IS NOT NULL) AS da, list_filter(list(n) OVER {win}, lambda v: v IS NOT NULL) AS na, list_filter(list(w) OVER {win}, lambda v: v IS NOT NULL) AS wa FROM k0),
k2 AS (SELECT region, date, {pct('da')} AS high, coalesce({pct('na')}, 50) AS near, coalesce({pct('wa')}, 50) AS deep FROM k1),
k AS (SELECT region, date, CASE WHEN high IS NOT NULL THEN greatest(least(0.45 * high + 0.35 * near + 0.2 * (100 - deep), 100), 0) END AS high_score, CASE WHEN high IS NOT NULL THEN greatest(least(0.45 * (100 - high) + 0.35 * deep + 0.2 * (100 - near), 100), 0) END AS low_score FROM k2)"""


def turning(grain: str) -> str:
    return series(grain) + ",\n" + turning_steps()


def turning_steps() -> str:
    around, future, soon = (f"({PART} ROWS BETWEEN {w})" for w in ("6 PRECEDING AND 6 FOLLOWING", "1 FOLLOWING AND 13 FOLLOWING", "1 FOLLOWING AND 4 FOLLOWING"))
    return f"""t0 AS (SELECT *, avg(value) OVER ({PART} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS sm FROM s),
t1 AS (SELECT region, date, value, count(sm) OVER {around} >= 7 AND sm = max(sm) OVER {around} AS is_max, count(sm) OVER {around} >= 7 AND sm = min(sm) OVER {around} AS is_min, min(value) OVER {future} AS low, max(value) OVER {future} AS high, count(value) OVER {future} AS n_ahead, max(value) OVER {soon} AS soon_high, min(value) OVER {soon} AS soon_low FROM t0),
tp AS (SELECT region, date, 'peak' AS event, value FROM t1 WHERE n_ahead >= 4 AND is_max AND low / value - 1 <= -0.02 AND soon_high < value
  UNION ALL SELECT region, date, 'trough', value FROM t1 WHERE n_ahead >= 4 AND is_min AND high / value - 1 >= 0.02 AND soon_low > value)"""


def composite_steps(horizon: int) -> str:
    """rc: risk composite, from s, sn, fb (forecasts of the models) and ff (the forecast)."""
    clip = lambda x: f"greatest(least({x}, 100), 0)"
    slope = "(p50 / last - 1) * 600"
    return turning_steps() + f""",
k0 AS (SELECT region, date, value / ({roll('avg', 'value', 24)}) * 100 AS d, value / ({roll('max', 'value', 52, 13)}) AS n, -(value / ({roll('max', 'value', 26, 4)}) - 1) AS w FROM s),
kl AS (SELECT region, 'd' AS c, date, d AS x FROM k0 WHERE d IS NOT NULL UNION ALL SELECT region, 'n', date, n FROM k0 WHERE n IS NOT NULL UNION ALL SELECT region, 'w', date, w FROM k0 WHERE w IS NOT NULL),
km AS (SELECT *, row_number() OVER (PARTITION BY region, c ORDER BY date DESC) AS j, first_value(x) OVER (PARTITION BY region, c ORDER BY date DESC) AS lx FROM kl),
kq AS (SELECT region, c, avg(CAST(x <= lx AS DOUBLE)) * 100 AS p FROM km WHERE j <= 156 GROUP BY region, c),
kr AS (SELECT region, max(p) FILTER (c = 'd') AS hot, max(p) FILTER (c = 'n') AS near, max(p) FILTER (c = 'w') AS deep FROM kq GROUP BY region),
lv AS (SELECT region, value AS last, date AS enddate FROM sn WHERE rn = n),
te AS (SELECT tp.region, bool_or(event = 'peak') AS pk, bool_or(event = 'trough') AS tr FROM tp JOIN lv ON lv.region = tp.region WHERE tp.date >= lv.enddate - 84 GROUP BY tp.region),
vt AS (SELECT region, avg(CAST(forecast < origin AS DOUBLE)) * 100 AS nv, avg(CAST(forecast > origin AS DOUBLE)) * 100 AS pv FROM fb WHERE step = {horizon} GROUP BY region),
rc AS (SELECT lv.region,
  round_even({clip(f"0.25 * coalesce(hot, 50) + 0.2 * {clip(f'-({slope})')} + 0.2 * coalesce(near, 50) + 0.2 * nv + 0.15 * CASE WHEN coalesce(pk, false) THEN 100 ELSE 40 END")}, 1) AS high_risk_score,
  round_even({clip(f"0.25 * coalesce(100 - hot, 50) + 0.2 * {clip(slope)} + 0.2 * coalesce(deep, 50) + 0.2 * pv + 0.15 * CASE WHEN coalesce(tr, false) THEN 100 ELSE 40 END")}, 1) AS low_zone_score
  FROM lv JOIN ff ON ff.region = lv.region AND ff.step = {horizon} JOIN vt ON vt.region = lv.region LEFT JOIN kr ON kr.region = lv.region LEFT JOIN te ON te.region = lv.region)"""


def signals(grain: str) -> str:
    lag = lambda c: f"lag({c}) OVER ({PART})"
    found = [
        ("Bollinger", "하단 이탈", "bullish", "value <= bb_lower"), ("Bollinger", "상단 돌파", "bearish", "value >= bb_upper"),
        ("MACD", "상향 교차", "bullish", f"macd > macd_signal AND {lag('macd')} <= {lag('macd_signal')}"), ("MACD", "하향 교차", "bearish", f"macd < macd_signal AND {lag('macd')} >= {lag('macd_signal')}"),
        ("RSI", "과매도", "bullish", "rsi14 <= 35"), ("RSI", "과열", "bearish", "rsi14 >= 65"),
        ("Ichimoku", "구름 상단 우위", "bullish", "value > greatest(span_a, span_b) AND tenkan > kijun"), ("Ichimoku", "구름 하단 약세", "bearish", "value < least(span_a, span_b) AND tenkan < kijun"),
        ("Z-score", "저평가", "bullish", "zscore26 <= -1.5"), ("Z-score", "고평가", "bearish", "zscore26 >= 1.5"),
        ("Momentum", "13주 모멘텀 전환", "bullish", f"momentum13 > 0 AND {lag('momentum13')} <= 0"), ("Momentum", "13주 모멘텀 둔화", "bearish", f"momentum13 < 0 AND {lag('momentum13')} >= 0"),
    ]
    flags = ", ".join(f"coalesce({c}, false) AS f{k}" for k, (_, _, _, c) in enumerate(found))
    rows = " UNION ALL ".join(f"SELECT region, date, value, forward, '{i}' AS indicator, '{s}' AS signal, '{d}' AS direction, f{k} AS fired FROM fl" for k, (i, s, d, _) in enumerate(found))
    return indicators(grain) + f""",
fl AS (SELECT *, lead(value, 13) OVER ({PART}) / value - 1 AS forward, {flags} FROM ind),
sl AS ({rows})"""


def t_tail(t: str, df: str) -> str:
    """P(T > t) by the finite series; coefficients by the gamma function."""
    th, c = f"atan(abs({t}) / sqrt({df}))", f"cos(atan(abs({t}) / sqrt({df})))"
    even = f"sin({th}) * list_sum(list_transform(range(0, CAST(floor({df} / 2) AS BIGINT)), lambda j: exp(lgamma(2 * j + 1) - 2 * j * ln(2) - 2 * lgamma(j + 1)) * pow({c}, 2 * j)))"
    odd = f"2 / pi() * ({th} + sin({th}) * coalesce(list_sum(list_transform(range(0, CAST(floor(({df} - 1) / 2) AS BIGINT)), lambda j: exp(2 * j * ln(2) + 2 * lgamma(j + 1) - lgamma(2 * j + 2)) * pow({c}, 2 * j + 1))), 0))"
    a = f"(CASE WHEN {df} % 2 = 1 THEN {odd} ELSE {even} END)"
    return f"CASE WHEN {t} > 0 THEN (1 - {a}) / 2 ELSE (1 + {a}) / 2 END"


def mean_tail(n: str, mean: str, std: str) -> str:
    return f"CASE WHEN {n} < 2 THEN NULL WHEN {std} > 0 THEN {t_tail(f'({mean} / ({std} / sqrt({n})))', f'({n} - 1)')} WHEN {mean} > 0 THEN 0.0 WHEN {mean} < 0 THEN 1.0 END"


def binomial_tail(hits: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN least(list_sum(list_transform(range({hits}, {n} + 1), lambda j: exp(lgamma({n} + 1) - lgamma(j + 1) - lgamma({n} - j + 1) - {n} * ln(2)))), 1.0) END"


def summary(grain: str) -> str:
    return signals(grain) + f""",
sv AS (SELECT *, CASE WHEN fired AND forward IS NOT NULL THEN CASE WHEN direction = 'bearish' THEN -forward ELSE forward END END AS signed FROM sl),
sa AS (SELECT region, indicator, signal, direction, count(signed) AS samples, count(*) FILTER (signed > 0) AS hits, avg(forward) FILTER (signed IS NOT NULL) AS mean, avg(signed) AS sm, stddev_samp(signed) AS sd FROM sv GROUP BY ALL),
sp AS (SELECT region, indicator, signal, direction, samples, coalesce(hits / nullif(samples, 0), 0.0) * 100 AS hit_rate_pct, mean * 100 AS mean_forward_return_pct, least({binomial_tail('hits', 'samples')}, {mean_tail('samples', 'sm', 'sd')}) AS p_value FROM sa),
ss AS (SELECT *, samples >= 10 AND hit_rate_pct >= 55 AND coalesce(p_value <= 0.25, false) AS passed FROM sp)"""


def cutoffs(grain: str, h: int) -> str:
    least, gap = max(156, 52 + h), max(4, h // 2)
    return series(grain) + f""",
ln AS (SELECT region, n, n - {h} AS lastc, greatest(1, least(4, greatest(1, CAST(floor((n - {h} - {least}) / {gap}) AS BIGINT) + 1))) AS cnt FROM (SELECT DISTINCT region, n FROM sn)),
cu AS (SELECT DISTINCT region, position FROM (SELECT region, unnest(CASE WHEN lastc <= {least} THEN CASE WHEN lastc > 60 THEN [lastc] ELSE [] END WHEN cnt = 1 THEN [{least}] ELSE list_transform(range(0, cnt), lambda i: CAST(floor({least} + i * ((lastc - {least}) / (cnt - 1))) AS BIGINT)) END) AS position FROM ln) WHERE position > 60)"""


def cutoffs_end(grain: str, h: int) -> str:
    least = max(104, 3 * h)
    return series(grain) + f""",
ln AS (SELECT region, n, greatest(1, least(6, greatest(1, CAST(floor((n - {least} - {h}) / 4) AS BIGINT) + 1))) AS cnt FROM (SELECT DISTINCT region, n FROM sn)),
cu AS (SELECT region, n - {h} - 4 * i AS position FROM (SELECT region, n, unnest(range(0, cnt)) AS i FROM ln) WHERE n - {h} - 4 * i >= 1)"""


def cutoffs_start(grain: str, h: int) -> str:
    least = max(104, 3 * h)
    return series(grain) + f""",
ln AS (SELECT region, n, greatest(1, least(6, greatest(1, CAST(floor((n - {least} - {h}) / 4) AS BIGINT) + 1))) AS cnt FROM (SELECT DISTINCT region, n FROM sn)),
cu AS (SELECT region, {least} + 4 * i AS position FROM (SELECT region, n, unnest(range(0, cnt)) AS i FROM ln) WHERE {least} + 4 * i - 1 + {h} < n)"""


def baselines(base: str, h: int, full: bool = False) -> str:
    cu = "" if not full else ", cu AS (SELECT DISTINCT region, n AS position FROM sn)"
    return base + cu + f""",
pl AS (SELECT cu.region, cu.position, o.value AS origin, o.date AS cutoff, a.value AS v0, unnest(range(1, {h + 1})) AS step FROM cu JOIN sn AS o ON o.region = cu.region AND o.rn = cu.position JOIN sn AS a ON a.region = cu.region AND a.rn = 1),
b0 AS (SELECT pl.*, q.value AS seasonal FROM pl LEFT JOIN sn AS q ON q.region = pl.region AND pl.position >= 52 AND q.rn = pl.position - 52 + (pl.step - 1) % 52 + 1),
b1 AS (SELECT region, position, step, cutoff, origin, 'Naive' AS model, origin AS forecast FROM b0 UNION ALL SELECT region, position, step, cutoff, origin, 'Drift', origin + (origin - v0) / greatest(1, position - 1) * step FROM b0 UNION ALL SELECT region, position, step, cutoff, origin, 'SeasonalNaive52', seasonal FROM b0),
b AS (SELECT * FROM (SELECT *, count(*) FILTER (forecast > 0) OVER (PARTITION BY region, position, model) AS good FROM b1) WHERE good = {h})"""


def predictions(base: str, h: int) -> str:
    return baselines(base, h) + """,
pr AS (SELECT b.region, b.cutoff, t.date AS target_date, b.step, b.origin, t.value AS actual, b.forecast, b.model FROM b JOIN sn AS t ON t.region = b.region AND t.rn = b.position + b.step),
sc AS (SELECT region, coalesce(nullif(avg(d), 0), 1.0) AS scale FROM (SELECT region, abs(value - lag(value) OVER (PARTITION BY region ORDER BY date)) AS d FROM s) GROUP BY region)"""


def board_dashboard(grain: str, h: int) -> str:
    return predictions(cutoffs(grain, h), h) + f""",
l0 AS (SELECT p.*, abs(p.forecast - p.actual) AS e, abs(nv.forecast - p.actual) AS bb, CAST(sign(p.forecast - p.origin) = sign(p.actual - p.origin) AS DOUBLE) AS rt FROM pr AS p JOIN pr AS nv ON nv.model = 'Naive' AND nv.region = p.region AND nv.cutoff = p.cutoff AND nv.step = p.step),
l1 AS (SELECT region, model, avg(e) AS mae, sqrt(avg(e * e)) AS rmse, sum(e) / sum(abs(actual)) * 100 AS wape_pct, avg(rt) * 100 AS direction_accuracy_pct, avg(bb) AS nmae, count(*) AS n_predictions, avg(bb - e) AS dm, stddev_samp(bb - e) AS ds FROM l0 GROUP BY region, model),
l2 AS (SELECT l1.region, model, mae, rmse, mae / scale AS mase, wape_pct, direction_accuracy_pct, CASE WHEN model = 'Naive' OR nmae <= 0 THEN 0.0 ELSE (1 - mae / nmae) * 100 END AS naive_improvement_pct, CASE WHEN model <> 'Naive' THEN {mean_tail('n_predictions', 'dm', 'ds')} END AS p_value_vs_naive, n_predictions FROM l1 JOIN sc ON sc.region = l1.region),
lb AS (SELECT *, model <> 'Naive' AND naive_improvement_pct > 0 AND coalesce(p_value_vs_naive, 1.0) <= 0.25 AND direction_accuracy_pct >= 45 AS passed, row_number() OVER (PARTITION BY region ORDER BY mase, wape_pct, model) AS place FROM l2),
se AS (SELECT region, model, rank FROM (SELECT region, model, passed, count(*) FILTER (passed) OVER (PARTITION BY region) AS np, row_number() OVER (PARTITION BY region ORDER BY passed DESC, place) AS rank FROM lb) WHERE (np > 0 AND passed AND rank <= 3) OR (np = 0 AND rank = 1))"""


def board_library(grain: str, h: int) -> str:
    score = f"avg(abs(forecast - actual)) AS mae, sqrt(avg((forecast - actual) * (forecast - actual))) AS rmse, avg(CAST(sign(forecast - origin) = sign(actual - origin) AS DOUBLE)) AS directional_accuracy, count(*) AS n_windows"
    return predictions(cutoffs_end(grain, h), h) + f""",
y0 AS (SELECT region, model, {score} FROM pr WHERE step = {h} GROUP BY region, model),
y1 AS (SELECT y0.*, mae / scale AS mase FROM y0 JOIN sc ON sc.region = y0.region),
y2 AS (SELECT region, model FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY mase, mae, model) AS rank FROM y1) WHERE rank <= 2),
en AS (SELECT pr.region, cutoff, target_date, actual, origin, avg(forecast) AS forecast FROM pr JOIN y2 ON y2.region = pr.region AND y2.model = pr.model WHERE step = {h} GROUP BY ALL),
y3 AS (SELECT region, 'Top2Ensemble' AS model, {score} FROM en GROUP BY region),
yb AS (SELECT * FROM y1 UNION ALL BY NAME SELECT y3.*, mae / scale AS mase FROM y3 JOIN sc ON sc.region = y3.region)"""
