"""Calibration, lift and capture, walk-forward and threshold searches over scored events.

Train and test periods are parameters of the texts; the values fit the derived tables' years.
A mask table names overlapping groups once and every statistic follows from it by one aggregation.
"""

from __future__ import annotations

from .sqltext import both

#: Events of the test period with a known tier and reaction, and the tiers as they are reported; high conviction lies within high alert.
OOS = "o AS (SELECT * FROM ev WHERE y >= 1998 AND a IS NOT NULL AND b IS NOT NULL)"
TIERS = """SELECT 'Normal' AS tier, * FROM o WHERE b = 'Normal' UNION ALL SELECT 'Elevated', * FROM o WHERE b = 'Elevated'
UNION ALL SELECT 'High Alert', * FROM o WHERE b = 'High Alert' UNION ALL SELECT 'High Conviction', * FROM o WHERE hc"""
_OVER = lambda *steps: "count(*) AS n, [[avg(CASE WHEN a < 1e-2 THEN 1e0 ELSE 0e0 END)]] AS under_1, " + ", ".join(
    f"[[avg(CASE WHEN a >= {t}e-2 THEN 1e0 ELSE 0e0 END)]] AS over_{t}" for t in steps)

both("a10_hit_rates", f"WITH {OOS}, t AS ({TIERS}) SELECT tier, {_OVER(3, 5, 8, 10, 15)} FROM t GROUP BY tier")
both("a11_capture", f"""WITH {OOS}, t AS (SELECT * FROM (VALUES (3e-2), (5e-2), (8e-2), (10e-2), (15e-2)) AS v(threshold))
SELECT [[threshold]] AS threshold, count(*) AS moves, count(CASE WHEN b <> 'Normal' THEN 1 END) AS flagged, [[count(CASE WHEN b <> 'Normal' THEN 1 END) / CAST(count(*) AS DOUBLE)]] AS capture
FROM o JOIN t ON a >= threshold GROUP BY threshold""")
both("a12_yearly_high_alert", f"WITH {OOS} SELECT y, count(*) AS n, CAST(sum(ex) AS BIGINT) AS hits, [[avg(ex)]] AS rate FROM o WHERE b = 'High Alert' GROUP BY y")
both("a13_percentile_bands", f"""WITH {OOS}, x AS (SELECT *, coalesce(p75r, p75) AS tail FROM o),
k AS (SELECT a, (rank() OVER (ORDER BY tail) + (count(*) OVER (PARTITION BY tail) - 1) / 2e0) / count(*) OVER () AS pct FROM x WHERE tail IS NOT NULL),
bands AS (SELECT * FROM (VALUES ('0-50', 0e0, 5e-1), ('50-75', 5e-1, 75e-2), ('75-90', 75e-2, 9e-1), ('90-95', 9e-1, 95e-2), ('95-99', 95e-2, 99e-2), ('99-100', 99e-2, 1e0)) AS v(band, lo, hi))
SELECT band, {_OVER(3, 8, 10)} FROM k JOIN bands ON pct >= lo AND pct <= hi GROUP BY band""")
both("a14_stats_by_stock", "SELECT stock, count(s) AS n, [[avg(s)]] AS mean, [[stddev_samp(s)]] AS sd, [[min(s)]] AS lo, [[max(s)]] AS hi FROM ev GROUP BY stock")
both("a14_stats_by_date", "SELECT earnings_date, count(s) AS n, [[avg(s)]] AS mean, [[stddev_samp(s)]] AS sd, [[min(s)]] AS lo, [[max(s)]] AS hi FROM ev WHERE s IS NOT NULL AND a IS NOT NULL GROUP BY earnings_date")
both("a15_describe", "SELECT count(s) AS n, [[avg(s)]] AS mean, [[stddev_samp(s)]] AS sd, [[min(s)]] AS lo, [[QUANTILE(s, 0.25)]] AS q25, [[QUANTILE(s, 0.5)]] AS q50, [[QUANTILE(s, 0.75)]] AS q75, [[max(s)]] AS hi FROM ev")
both("a16_correlations", "WITH k AS (SELECT * FROM ev WHERE a IS NOT NULL AND s IS NOT NULL AND vol IS NOT NULL AND bias IS NOT NULL) SELECT [[corr(s, a)]] AS s_a, [[corr(s, vol)]] AS s_vol, [[corr(s, bias)]] AS s_bias, [[corr(vol, a)]] AS vol_a, [[corr(bias, a)]] AS bias_a FROM k")
both("a17_spearman_by_year", """WITH k AS (SELECT y, (rank() OVER (PARTITION BY y ORDER BY s) + (count(*) OVER (PARTITION BY y, s) - 1) / 2e0) AS rs, (rank() OVER (PARTITION BY y ORDER BY a) + (count(*) OVER (PARTITION BY y, a) - 1) / 2e0) AS ra
FROM ev WHERE s IS NOT NULL AND a IS NOT NULL) SELECT y, count(*) AS n, [[corr(rs, ra)]] AS spearman FROM k GROUP BY y""")
both("a18_histogram", """WITH m AS (SELECT min(s) AS lo, max(s) AS hi FROM ev) SELECT CAST(least(29, floor((s - lo) / nullif(hi - lo, 0e0) * 30)) AS INT) AS bin, count(*) AS n FROM ev CROSS JOIN m WHERE s IS NOT NULL GROUP BY 1""")
_AUC = "(sum(CASE WHEN ex = 1 THEN rk ELSE 0e0 END) - CAST(sum(ex) AS DOUBLE) * (CAST(sum(ex) AS DOUBLE) + 1) / 2) / nullif(CAST(sum(ex) AS DOUBLE) * (count(*) - CAST(sum(ex) AS DOUBLE)), 0e0)"
both("a19_auc", f"WITH k AS (SELECT ex, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2e0 AS rk FROM ev WHERE s IS NOT NULL AND a IS NOT NULL) SELECT count(*) AS n, [[{_AUC}]] AS auc FROM k")
both("a20_confusion", """WITH k AS (SELECT CASE WHEN b = 'High Alert' THEN 1 ELSE 0 END AS p, ex FROM ev WHERE b IS NOT NULL AND a IS NOT NULL),
c AS (SELECT sum(p * ex) AS tp, sum(p * (1 - ex)) AS fp, sum((1 - p) * ex) AS fn, sum((1 - p) * (1 - ex)) AS tn FROM k)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, [[tp / nullif(CAST(tp + fp AS DOUBLE), 0e0)]] AS precision_, [[tp / nullif(CAST(tp + fn AS DOUBLE), 0e0)]] AS recall_ FROM c""")
both("a21_median_split", "WITH m AS (SELECT QUANTILE(s, 0.5) AS mid FROM ev) SELECT s > mid AS upper_half, count(*) AS n, [[avg(ex)]] AS rate FROM ev CROSS JOIN m WHERE s IS NOT NULL GROUP BY 1")
both("a22_most_active_sector", "SELECT sector, count(*) AS n FROM ev WHERE b IN ('High Alert', 'Elevated') GROUP BY sector ORDER BY n DESC, sector LIMIT 1")
both("a23_unique", "SELECT count(DISTINCT stock) AS stocks, count(DISTINCT sector) AS sectors, count(DISTINCT y) AS years FROM ev")


def qcut(x: str, q: int, where: str = "true") -> str:
    """CTE ``g`` with ``bin``: how many of the interior quantile edges, equal ones and the least value's taken once, lie below ``x``."""
    edges = ", ".join([f"min({x}) AS e0", *(f"QUANTILE({x}, {i / q}) AS e{i}" for i in range(1, q))])
    below = " + ".join(f"CASE WHEN x > e{i} AND e{i} > e{i - 1} THEN 1 ELSE 0 END" for i in range(1, q))
    return f"k AS (SELECT *, {x} AS x FROM ev WHERE {x} IS NOT NULL AND a IS NOT NULL AND {where}), c AS (SELECT {edges} FROM ev WHERE {x} IS NOT NULL AND a IS NOT NULL AND {where}), g AS (SELECT k.*, {below} AS bin FROM k CROSS JOIN c)"


_P, _N, _Z = "avg(ex)", "count(*)", "196e-2"
_MID = f"({_P} + {_Z} * {_Z} / (2 * {_N})) / (1 + {_Z} * {_Z} / {_N})"
_HALF = f"{_Z} * sqrt({_P} * (1 - {_P}) / {_N} + {_Z} * {_Z} / (4e0 * {_N} * {_N})) / (1 + {_Z} * {_Z} / {_N})"
both("b03_decile_lift", f"WITH {qcut('p75', 10)} SELECT bin, count(*) AS n, [[min(x)]] AS lo, [[max(x)]] AS hi, [[avg(ex)]] AS rate, [[avg(ex) / (SELECT avg(ex) FROM g)]] AS lift, [[{_MID} - {_HALF}]] AS wilson_lo, [[{_MID} + {_HALF}]] AS wilson_hi FROM g GROUP BY bin")
both("b04_tails", """WITH c AS (SELECT QUANTILE(s, 0.8) AS s80, QUANTILE(s, 0.2) AS s20 FROM ev), m AS (SELECT 'all' AS part, ex FROM ev UNION ALL SELECT 'top', ex FROM ev CROSS JOIN c WHERE s >= s80 UNION ALL SELECT 'bottom', ex FROM ev CROSS JOIN c WHERE s <= s20)
SELECT part, count(*) AS n, [[avg(ex)]] AS extreme_rate FROM m GROUP BY part""")
both("b04_quintiles", f"WITH {qcut('s', 5)} SELECT bin, count(*) AS n, [[avg(a)]] AS mean_move, [[avg(lg)]] AS large_rate, [[avg(ex)]] AS extreme_rate FROM g GROUP BY bin")


def masks(rows: dict[str, str], source: str = "ev") -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS mask, * FROM {source} WHERE {v}" for k, v in rows.items())


_CUTS = "c AS (SELECT QUANTILE(vr, 0.9) AS vr90, QUANTILE(dens, 0.5) AS dens50, QUANTILE(vol, 0.98) AS vol98, QUANTILE(vol, 0.9) AS vol90, QUANTILE(s, 0.9) AS s90, QUANTILE(fr, 0.9) AS fr90 FROM ev), e AS (SELECT * FROM ev CROSS JOIN c)"
_STATS = "count(*) AS n, [[avg(lg)]] AS large_rate, [[avg(ex)]] AS extreme_rate"
_JOINT = "(s >= s90 AND fr >= fr90)"


def _masked(name: str, rows: dict[str, str]) -> None:
    both(name, f"WITH {_CUTS}, m AS ({masks(rows, 'e')}) SELECT mask, {_STATS} FROM m GROUP BY mask")


#: The danger feature of these regimes is a parameter; here it is the ratio of short to long volatility.
_masked("b05_regimes", {"all": "true", "danger, individual volatility and explosiveness": "vr >= vr90 AND svs >= 1e0 AND s >= s90"})
_masked("b06_conditional", {
    "all": "true", "danger": "vr >= vr90", "danger, extreme stress": "vr >= vr90 AND vse = 1", "danger, low density": "vr >= vr90 AND NOT coalesce(dens >= dens50, false)", "danger, individual volatility": "vr >= vr90 AND svs >= 1e0",
})
_masked("b07_volatility_only", {"all": "true", "volatile against its sector": "vol >= vol90 AND svs >= 1e0"})
_HIGH = "h AS (SELECT QUANTILE(vr, 0.8) AS vr80, QUANTILE(s, 0.9) AS top FROM ev), r AS (SELECT * FROM ev CROSS JOIN h WHERE vr >= vr80 AND svs >= 1e0 AND s >= top)"
both("b08_high_risk", f"""WITH {_HIGH}, z AS (SELECT stock, count(*) AS n FROM r GROUP BY stock), d AS (SELECT avg(ex) AS ex, avg(lg) AS lg FROM ev),
p AS (SELECT count(*) AS stocks, avg(n) AS mean, min(n) AS lo, max(n) AS hi FROM z)
SELECT count(*) AS n, [[avg(lg)]] AS large_rate, [[avg(ex)]] AS extreme_rate, [[(SELECT lg FROM d)]] AS base_large, [[(SELECT ex FROM d)]] AS base_extreme, [[avg(a)]] AS mean_move, [[stddev_samp(a)]] AS sd_move, [[min(a)]] AS least_move,
  [[QUANTILE(a, 0.25)]] AS q25_move, [[QUANTILE(a, 0.5)]] AS median_move, [[QUANTILE(a, 0.75)]] AS q75_move, [[max(a)]] AS most_move, (SELECT stocks FROM p) AS stocks, [[(SELECT mean FROM p)]] AS events_a_stock, (SELECT lo FROM p) AS least_events, (SELECT hi FROM p) AS most_events FROM r""")
both("b08_threshold_grid", """WITH t AS (SELECT QUANTILE(vr, 0.7) AS v7, QUANTILE(vr, 0.8) AS v8, QUANTILE(s, 0.8) AS s8, QUANTILE(s, 0.9) AS s9 FROM ev),
g AS (SELECT 7e-1 AS danger_q, 8e-1 AS score_q, v7 AS tv, s8 AS ts FROM t UNION ALL SELECT 7e-1, 9e-1, v7, s9 FROM t UNION ALL SELECT 8e-1, 8e-1, v8, s8 FROM t UNION ALL SELECT 8e-1, 9e-1, v8, s9 FROM t)
SELECT [[danger_q]] AS danger_q, [[score_q]] AS score_q, count(*) AS n, [[avg(ex)]] AS rate FROM ev JOIN g ON vr >= tv AND s >= ts WHERE svs >= 1e0 GROUP BY danger_q, score_q HAVING count(*) > 30""")
both("b09_precision_recall", f"""WITH {_CUTS}, k AS (SELECT CASE WHEN {_JOINT} THEN 1 ELSE 0 END AS p, ex FROM e),
q AS (SELECT sum(p * ex) AS tp, sum(p * (1 - ex)) AS fp, sum((1 - p) * ex) AS fn, sum((1 - p) * (1 - ex)) AS tn, sum(p) AS flagged, count(*) AS n FROM k)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, [[tp / nullif(CAST(tp + fp AS DOUBLE), 0e0)]] AS precision_, [[tp / nullif(CAST(tp + fn AS DOUBLE), 0e0)]] AS recall_, CAST(flagged AS BIGINT) AS flagged, n FROM q""")
#: Labels are shuffled by two fixed orders: by stock and date, and by a digest of them.
both("b10_against_volatility", f"""WITH {_CUTS}, j AS (SELECT *, CASE WHEN {_JOINT} THEN 1 ELSE 0 END AS p, row_number() OVER (ORDER BY stock, date) AS i, row_number() OVER (ORDER BY md5(concat(stock, CAST(date AS VARCHAR(10)))), stock, date) AS h FROM e),
w AS (SELECT l.p, r.ex FROM j l JOIN j r ON l.i = r.h), mid AS (SELECT QUANTILE(y, 0.5) AS y50 FROM ev),
t AS (SELECT 'joint' AS test, ex FROM j WHERE p = 1 UNION ALL SELECT 'shuffled labels', ex FROM w WHERE p = 1 UNION ALL SELECT 'first half', ex FROM j CROSS JOIN mid WHERE p = 1 AND y <= y50
  UNION ALL SELECT 'second half', ex FROM j CROSS JOIN mid WHERE p = 1 AND y > y50 UNION ALL SELECT 'top volatility', ex FROM j WHERE vol >= vol98)
SELECT test, count(*) AS n, CAST(sum(ex) AS BIGINT) AS hits, [[avg(ex)]] AS precision_ FROM t GROUP BY test""")
_METRIC = "m AS (SELECT min(s) AS lo, max(s) AS hi FROM ev), k AS (SELECT stock, earnings_date, a, 100 * (s - lo) / nullif(hi - lo, 0e0) AS x FROM ev CROSS JOIN m WHERE s IS NOT NULL AND a IS NOT NULL)"
both("b11_score_statistics", f"""WITH {_METRIC}, q AS (SELECT QUANTILE(x, 0.1) AS p10, QUANTILE(x, 0.9) AS p90 FROM k)
SELECT count(*) AS n, [[min(x)]] AS lo, [[max(x)]] AS hi, [[avg(x)]] AS mean, [[QUANTILE(x, 0.5)]] AS median_, [[stddev_samp(x)]] AS sd, [[max(p10)]] AS p10, [[QUANTILE(x, 0.25)]] AS p25, [[QUANTILE(x, 0.75)]] AS p75, [[max(p90)]] AS p90, [[QUANTILE(x, 0.95)]] AS p95,
  [[avg(CASE WHEN x >= p90 THEN 1e0 ELSE 0e0 END)]] AS high_tail, [[avg(CASE WHEN x <= p10 THEN 1e0 ELSE 0e0 END)]] AS low_tail, [[corr(x, a)]] AS corr_move FROM k CROSS JOIN q""")
both("b11_histogram", f"WITH {_METRIC}, n AS (SELECT min(x) AS x0, max(x) AS x1 FROM k) SELECT CAST(least(29, floor((x - x0) / nullif(x1 - x0, 0e0) * 30)) AS INT) AS bin, count(*) AS n FROM k CROSS JOIN n GROUP BY 1")
both("b11_by_date", f"WITH {_METRIC} SELECT earnings_date, [[avg(x)]] AS mean, [[stddev_samp(x)]] AS sd, [[min(x)]] AS lo, [[max(x)]] AS hi, count(*) AS n FROM k GROUP BY earnings_date")
both("b11_by_stock", f"WITH {_METRIC} SELECT stock, [[avg(x)]] AS mean, [[stddev_samp(x)]] AS sd, count(*) AS n FROM k GROUP BY stock")
both("b11_quintiles", f"WITH {qcut('s', 5)} SELECT bin, count(*) AS n, [[avg(a)]] AS mean_move FROM g GROUP BY bin")
#: Normalised by the train period; test scores are clipped to its range, so none is without a bin of the frozen quintiles.
_FROZEN = "n AS (SELECT * FROM ev WHERE s IS NOT NULL AND a IS NOT NULL), t AS (SELECT min(s) AS lo, max(s) AS hi, QUANTILE(s, 0.2) AS e1, QUANTILE(s, 0.4) AS e2, QUANTILE(s, 0.6) AS e3, QUANTILE(s, 0.8) AS e4 FROM n WHERE y < 1998)"
_SPLIT = f"{_FROZEN}, k AS (SELECT y >= 1998 AS test, a, CASE WHEN hi > lo THEN 100 * least(1e0, greatest(0e0, (s - lo) / (hi - lo))) ELSE 50e0 END AS x, CASE WHEN s <= e1 THEN 0 WHEN s <= e2 THEN 1 WHEN s <= e3 THEN 2 WHEN s <= e4 THEN 3 ELSE 4 END AS bin FROM n CROSS JOIN t)"
both("b12_train_test", f"WITH {_SPLIT} SELECT test, bin, count(*) AS n, [[avg(x)]] AS mean_score, [[avg(a)]] AS mean_move FROM k GROUP BY test, bin")
both("b12_correlations", f"WITH {_SPLIT} SELECT test, count(*) AS n, [[corr(x, a)]] AS corr_move FROM k GROUP BY test")
#: Values outside frozen edges have no bin.
both("b02_frozen_edges", f"WITH {_FROZEN} SELECT y >= 1998 AS test, CASE WHEN s < lo OR s > hi THEN NULL WHEN s <= e1 THEN 0 WHEN s <= e2 THEN 1 WHEN s <= e3 THEN 2 WHEN s <= e4 THEN 3 ELSE 4 END AS bin, count(*) AS n, [[avg(a)]] AS mean_move FROM n CROSS JOIN t GROUP BY 1, 2")
both("b13_yearly_oos", """WITH k AS (SELECT y, s, a, ex FROM ev WHERE s IS NOT NULL AND a IS NOT NULL), ys AS (SELECT DISTINCT y AS test FROM k),
t AS (SELECT test, count(*) AS n_train, min(s) AS lo, max(s) AS hi, QUANTILE(s, 0.2) AS e1, QUANTILE(s, 0.8) AS e4 FROM k JOIN ys ON y < test GROUP BY test),
u AS (SELECT test, n_train, least(1e0, greatest(0e0, (s - lo) / nullif(hi - lo, 0e0))) AS x, s <= e1 AS low, s > e4 AS top, a, ex FROM k JOIN t ON y = test)
SELECT test, max(n_train) AS n_train, count(*) AS n_test, [[corr(x, a)]] AS corr_move, [[avg(CASE WHEN top THEN a END)]] AS top_move, [[avg(CASE WHEN low THEN a END)]] AS low_move,
  [[avg(CASE WHEN top THEN a END) / nullif(avg(CASE WHEN low THEN a END), 0e0)]] AS lift FROM u GROUP BY test HAVING max(n_train) >= 500 AND count(*) >= 100""")


def _forward(name: str, cut: str, regime: str, known: str) -> None:
    both(name, f"""WITH k AS (SELECT * FROM ev WHERE {known} AND a IS NOT NULL), t AS (SELECT {cut} FROM k WHERE y BETWEEN 1995 AND 1997),
u AS (SELECT CASE WHEN y <= 1997 THEN 'train' ELSE 'test' END AS split, y, ex, CASE WHEN {regime} THEN 1 ELSE 0 END AS g FROM k CROSS JOIN t)
SELECT split, y, count(*) AS n, [[avg(ex)]] AS base_rate, CAST(sum(g) AS BIGINT) AS n_regime, [[avg(CASE WHEN g = 1 THEN ex END)]] AS rate, [[avg(CASE WHEN g = 1 THEN ex END) / nullif(avg(ex), 0e0)]] AS lift,
  [[avg(g)]] AS share, [[sum(g * ex) / nullif(CAST(sum(ex) AS DOUBLE), 0e0)]] AS capture FROM u GROUP BY split, y""")


_forward("b14_forward_onefactor", "QUANTILE(p75, 0.9) AS c1", "p75 >= c1", "p75 IS NOT NULL")
_forward("b15_forward_twofactor", "QUANTILE(p75, 0.8) AS c1, QUANTILE(vol, 0.8) AS c2", "p75 >= c1 AND vol >= c2", "p75 IS NOT NULL AND vol IS NOT NULL")
_DRIFT, _SURPRISE = "coalesce(dflag, '') <> ''", "coalesce(sflag, '') <> ''"
_HC = {k: f"b = 'High Alert' AND ({v})" for k, v in {
    "High Alert": "true", "Drift": _DRIFT, "Any surprise": _SURPRISE, "Beat Streak": "sflag = 'Beat Streak'", "Miss Streak": "sflag = 'Miss Streak'", "Overdue Miss": "sflag = 'Overdue Miss'", "Erratic": "sflag = 'Erratic'",
    "Drift or surprise": f"{_DRIFT} OR {_SURPRISE}", "Drift and surprise": f"{_DRIFT} AND {_SURPRISE}", "Drift or three flags": f"{_DRIFT} OR sflag IN ('Beat Streak', 'Miss Streak', 'Erratic')",
}.items()}
_HCM = f"k AS (SELECT * FROM ev WHERE y >= 1998), m AS ({masks(_HC, 'k')}), t AS (SELECT y, sum(ex) AS hits, avg(ex) AS base FROM k GROUP BY y), r AS (SELECT mask, m.y, count(*) AS n, avg(ex) AS rate, avg(ex) / nullif(max(base), 0e0) AS lift, sum(ex) / nullif(CAST(max(hits) AS DOUBLE), 0e0) AS capture FROM m JOIN t ON m.y = t.y GROUP BY mask, m.y)"
both("b16_conviction_by_year", f"WITH {_HCM} SELECT mask, y, n, [[rate]] AS rate, [[lift]] AS lift, [[capture]] AS capture FROM r")
both("b16_conviction_pooled", f"WITH {_HCM}, p AS (SELECT avg(ex) AS base FROM k), q AS (SELECT mask, sum(n) AS n, sum(n * rate) / sum(n) AS rate, avg(n) AS per_year, avg(capture) AS capture FROM r GROUP BY mask) SELECT mask, CAST(n AS BIGINT) AS n, [[per_year]] AS per_year, [[rate]] AS rate, [[rate / base]] AS lift, [[capture]] AS avg_capture FROM q CROSS JOIN p")
#: Test years with at least 500 events before and 50 inside. A tier is predicted by its own past rate: drawn towards itself, it stays.
_WALK = """ys AS (SELECT y AS test, count(*) AS n FROM ev WHERE y >= 1998 GROUP BY y HAVING count(*) >= 50),
ok AS (SELECT test FROM ys JOIN ev AS past ON past.y < test GROUP BY test HAVING count(*) >= 500),
p AS (SELECT test, b, avg(ex) AS predicted FROM ok JOIN ev AS past ON past.y < test WHERE b IS NOT NULL GROUP BY test, b),
r AS (SELECT test, p.b, max(predicted) AS predicted, avg(ex) AS actual, count(*) AS n FROM p JOIN ev AS now ON now.y = test AND now.b = p.b GROUP BY test, p.b),
g AS (SELECT b, avg(predicted) * 100 AS predicted, avg(actual) * 100 AS actual, avg(abs(predicted - actual)) * 100 AS error_pp, sum(n) AS n FROM r GROUP BY b)"""
both("b17_oos_calibration", f"WITH {_WALK} SELECT b AS tier, CAST(n AS BIGINT) AS n, [[predicted]] AS predicted, [[actual]] AS actual, [[error_pp]] AS error_pp FROM g")
both("b17_oos_ece", f"WITH {_WALK} SELECT [[sum(error_pp * n) / sum(n)]] AS ece FROM g")
#: The search sees events only as counts by year and by the number of thresholds that lie below their score.
_STEPS = list(range(55, 95, 3))
_ABOVE = " + ".join(f"CASE WHEN s > {t} THEN 1 ELSE 0 END" for t in _STEPS)
_PAIRS = ", ".join(f"({lo}, {hi}, {i}, {j})" for i, lo in enumerate(_STEPS) if lo <= 79 for j, hi in enumerate(_STEPS) if hi >= lo + 6)
both("b18_threshold_search", f"""WITH h AS (SELECT y, CASE WHEN s IS NULL THEN -1 ELSE {_ABOVE} END AS k, count(*) AS n, sum(ex) AS x FROM ev GROUP BY 1, 2),
ys AS (SELECT y AS test FROM h WHERE y >= 1998 GROUP BY y HAVING sum(n) >= 50),
tr AS (SELECT test, k, sum(n) AS n, sum(x) AS x FROM ys JOIN h ON y < test GROUP BY test, k),
ba AS (SELECT test, sum(x) / CAST(sum(n) AS DOUBLE) AS base FROM tr GROUP BY test HAVING sum(n) >= 500),
d AS (SELECT * FROM (VALUES {_PAIRS}) AS v(lo, hi, i, j)), known AS (SELECT * FROM tr WHERE k >= 0), seen AS (SELECT y AS test, k, n, x FROM h WHERE k >= 0),
p AS (SELECT lo, hi, known.test, CASE WHEN k <= i THEN 0 WHEN k <= j THEN 1 ELSE 2 END AS bin, (sum(x) + 5 * max(base)) / (sum(n) + 5e0) AS predicted FROM known JOIN ba ON known.test = ba.test CROSS JOIN d GROUP BY 1, 2, 3, 4),
q AS (SELECT lo, hi, seen.test, CASE WHEN k <= i THEN 0 WHEN k <= j THEN 1 ELSE 2 END AS bin, sum(x) / CAST(sum(n) AS DOUBLE) AS actual, sum(n) AS n FROM seen CROSS JOIN d GROUP BY 1, 2, 3, 4),
u AS (SELECT p.lo, p.hi, p.bin, avg(predicted) AS predicted, avg(actual) AS actual, avg(abs(predicted - actual)) AS gap, sum(n) AS n FROM p JOIN q ON p.lo = q.lo AND p.hi = q.hi AND p.test = q.test AND p.bin = q.bin GROUP BY p.lo, p.hi, p.bin),
z AS (SELECT lo, hi, 100 * sum(gap * n) / sum(n) AS ece, {", ".join(f"max(CASE WHEN bin = {i} THEN {f} END) * 100 AS {f}_{n}" for i, n in enumerate(("normal", "elevated", "high")) for f in ("predicted", "actual"))} FROM u GROUP BY lo, hi)
SELECT lo, hi, [[ece]] AS ece, {", ".join(f"[[{f}_{n}]] AS {f}_{n}" for n in ("normal", "elevated", "high") for f in ("predicted", "actual"))}, row_number() OVER (ORDER BY round(ece, 9), lo, hi) = 1 AS best FROM z""")
both("b19_corr_parts", """WITH k AS (SELECT stock, s, a, s - avg(s) OVER (PARTITION BY stock) AS ds, a - avg(a) OVER (PARTITION BY stock) AS da FROM ev WHERE s IS NOT NULL AND a IS NOT NULL),
m AS (SELECT stock, avg(s) AS ms, avg(a) AS ma FROM k GROUP BY stock) SELECT [[corr(s, a)]] AS pooled, [[(SELECT corr(ms, ma) FROM m)]] AS between_stocks, [[corr(ds, da)]] AS within_stocks FROM k""")
both("b20_bucket_profile", "SELECT b AS tier, count(*) AS n, [[avg(a)]] AS mean_move, [[QUANTILE(a, 0.5)]] AS median_move, [[avg(lg)]] AS large_rate, [[avg(ex)]] AS extreme_rate, [[avg(ex) / (SELECT avg(ex) FROM ev WHERE b IS NOT NULL AND a IS NOT NULL)]] AS lift FROM ev WHERE b IS NOT NULL AND a IS NOT NULL GROUP BY b")
both("b20_efficiency", """WITH k AS (SELECT *, CASE WHEN b = 'High Alert' THEN 1 ELSE 0 END AS f FROM ev WHERE y >= 1998), c AS (SELECT avg(f) AS flagged, avg(ex) AS base, avg(CASE WHEN f = 1 THEN ex END) AS hit, sum(f * ex) / nullif(CAST(sum(ex) AS DOUBLE), 0e0) AS captured FROM k)
SELECT [[flagged]] AS flagged, [[hit]] AS precision_, [[captured]] AS captured, [[1 - captured]] AS missed, [[base]] AS base_rate, [[hit / nullif(base, 0e0)]] AS edge FROM c""")
both("b20_yearly_lift", """WITH r AS (SELECT y, avg(ex) AS base, avg(CASE WHEN b = 'High Alert' THEN ex END) AS hit, count(CASE WHEN b = 'High Alert' THEN 1 END) AS n_flagged, sum(CASE WHEN b = 'High Alert' THEN ex ELSE 0 END) / nullif(CAST(sum(ex) AS DOUBLE), 0e0) AS capture,
  CASE WHEN count(CASE WHEN s IS NOT NULL AND a IS NOT NULL THEN 1 END) >= 50 THEN corr(s, a) END AS corr_move FROM ev WHERE y >= 1998 GROUP BY y)
SELECT y, [[base]] AS base_rate, [[hit]] AS rate, [[hit / nullif(base, 0e0)]] AS lift, n_flagged, [[capture]] AS capture, [[corr_move]] AS corr_move FROM r WHERE n_flagged > 0""")
_DECILES = "t AS (SELECT min(s) AS lo, max(s) AS hi, min(s) AS e0, " + ", ".join(f"QUANTILE(s, 0.{i}) AS e{i}" for i in range(1, 10)) + " FROM ev WHERE y < 1998)"
_DBIN = "CASE WHEN s >= lo AND s <= hi THEN 1 + " + " + ".join(f"CASE WHEN s > e{i} AND e{i} > e{i - 1} THEN 1 ELSE 0 END" for i in range(1, 10)) + " END"
both("b21_frozen_deciles", f"WITH {_DECILES}, k AS (SELECT y, s, ex, {_DBIN} AS decile FROM ev CROSS JOIN t WHERE y >= 1998), r AS (SELECT y, decile, avg(s) AS score, avg(ex) AS rate, count(*) AS n FROM k WHERE decile IS NOT NULL GROUP BY y, decile) SELECT decile, [[avg(score)]] AS avg_score, [[avg(rate) * 100]] AS actual_pct, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY decile")
_OVERLAY = "count(a) AS n, [[avg(a)]] AS mean_move, [[avg(ex)]] AS rate, [[avg(r)]] AS signed_move, [[avg(ex) / (SELECT avg(ex) FROM ev WHERE y >= 1998)]] AS lift"
_STREAK = "CASE WHEN streak <= -3 THEN '-3 and below' WHEN streak <= -1 THEN '-2 to -1' WHEN streak <= 1 THEN '0 to 1' WHEN streak <= 4 THEN '2 to 4' WHEN streak <= 6 THEN '5 to 6' ELSE 'above 6' END"
both("b22_streak_bins", f"SELECT {_STREAK} AS bin, {_OVERLAY} FROM ev WHERE y >= 1998 AND streak IS NOT NULL AND a IS NOT NULL GROUP BY 1")
both("b22_surprise_flags", f"SELECT sflag, {_OVERLAY} FROM ev WHERE y >= 1998 GROUP BY sflag")
both("b22_drift_flags", f"SELECT dflag, {_OVERLAY} FROM ev WHERE y >= 1998 GROUP BY dflag")
both("b22_drift_deciles", f"WITH {qcut('z', 10, 'y >= 1998')} SELECT bin, count(*) AS n, [[avg(z)]] AS mean_z, [[avg(a)]] AS mean_move, [[avg(r)]] AS signed_move, [[avg(ex)]] AS rate FROM g GROUP BY bin")
both("b22_drift_correlations", "SELECT count(*) AS n, [[corr(z, a)]] AS corr_move, [[corr(z, r)]] AS corr_signed FROM ev WHERE y >= 1998 AND z IS NOT NULL AND a IS NOT NULL")
both("b22_flag_coverage", "SELECT count(*) AS n, count(CASE WHEN sflag <> '' THEN 1 END) AS with_surprise, count(CASE WHEN dflag <> '' THEN 1 END) AS with_drift, count(CASE WHEN sflag <> '' OR dflag <> '' THEN 1 END) AS with_either FROM ev WHERE y >= 1998 AND b = 'High Alert'")
both("b23_conviction_stack", f"WITH k AS (SELECT * FROM ev WHERE a IS NOT NULL AND b IS NOT NULL), m AS ({masks(_HC, 'k')}) SELECT mask, count(*) AS n, CAST(sum(ex) AS BIGINT) AS hits, [[avg(ex)]] AS rate, [[avg(a)]] AS mean_move FROM m GROUP BY mask")
both("b23_top_hits", "SELECT stock, date, [[s]] AS s, [[a]] AS a FROM ev WHERE hc AND a IS NOT NULL ORDER BY a DESC, stock, date LIMIT 20")
both("b23_top_misses", "SELECT stock, date, [[s]] AS s, [[a]] AS a FROM ev WHERE hc AND a IS NOT NULL ORDER BY a, stock, date LIMIT 20")


_CLIP = lambda x: f"CASE WHEN ({x}) IS NOT NULL THEN greatest(0e0, least(1e0, {x})) END"
_TAIL, _VOL = "coalesce(p75r, p75)", "CASE WHEN vol IS NOT NULL THEN greatest(vol, 1e-6) END"
_GATE = "(1 + CASE WHEN coalesce(svs, 1e0) > 1 THEN 4e-1 ELSE 0e0 END + 3e-1 * coalesce(vse, 0))"


def _gated(score: str) -> str:
    """A score of up to 100, raised by the volatility gate."""
    x = f"100 * {_CLIP(score)} * {_GATE}"
    return f"CASE WHEN ({score}) IS NOT NULL THEN greatest(0e0, least(100e0, {x})) END"


_FULL = f"35e-2 * ({_CLIP(f'{_TAIL} / ({_VOL}) / scale')}) + 30e-2 * ({_CLIP('coalesce(ez, 0e0) / scale')}) + 25e-2 * ({_CLIP(f'{_TAIL} / 12e-2')}) + 10e-2 * ({_CLIP('ent')})"
_SIMPLE = f"85e-2 * ({_CLIP(f'{_TAIL} / 12e-2')}) + 15e-2 * ({_CLIP('ent')})"
#: Correlation by test year, after the first, with 500 events before and 100 inside; a year's scale does not change it.
_BY_YEAR = """f AS (SELECT min(y) AS y0 FROM k), n AS (SELECT {key}, y, count(*) AS n, corr(x, a) AS c FROM k GROUP BY {key}, y),
w AS (SELECT {key}, y, n, c, sum(n) OVER (PARTITION BY {key} ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM n), v AS (SELECT w.* FROM w CROSS JOIN f WHERE y > y0 AND past >= 500 AND n >= 100)"""
_SCALES = ", ".join(f"({x}e0)" for x in [*range(4, 21), 25, 30, 35, 40])
both("b24_scales", f"WITH d AS (SELECT * FROM (VALUES {_SCALES}) AS v(scale)), j AS (SELECT y, a, scale, {_gated(_FULL)} AS x FROM ev CROSS JOIN d), k AS (SELECT * FROM j WHERE x IS NOT NULL AND a IS NOT NULL), {_BY_YEAR.format(key='scale')} SELECT [[scale]] AS scale, count(*) AS years, [[avg(c)]] AS avg_corr FROM v GROUP BY scale")
both("b24_simplified", f"WITH j AS (SELECT y, a, 1 AS one, {_gated(_SIMPLE)} AS x FROM ev), k AS (SELECT * FROM j WHERE x IS NOT NULL AND a IS NOT NULL), {_BY_YEAR.format(key='one')} SELECT count(*) AS years, [[avg(c)]] AS avg_corr FROM v")
_WS = ", ".join(f"({5 * i}e-2)" for i in range(21))
_LABEL = "CASE WHEN a >= {0}e-2 THEN 1 ELSE 0 END"
both("b25_weight_sweep", f"""WITH d AS (SELECT * FROM (VALUES {_WS}) AS v(w)), k AS (SELECT w, {_LABEL.format(5)} AS ex, round(w * s + (1 - w) * fr, 9) AS x FROM ev CROSS JOIN d WHERE s IS NOT NULL AND fr IS NOT NULL),
r AS (SELECT w, ex, rank() OVER (PARTITION BY w ORDER BY x) + (count(*) OVER (PARTITION BY w, x) - 1) / 2e0 AS rk FROM k), z AS (SELECT w, {_AUC} AS auc FROM r GROUP BY w)
SELECT [[w]] AS w, [[auc]] AS auc, row_number() OVER (ORDER BY round(auc, 9) DESC, w) = 1 AS best FROM z""")
_FEATURES = {"vol_ratio_cross_sectional_pct": "vrp", "sector_vol_ratio_pct": "svp", "earnings_explosiveness_z": "ez", "earnings_tail_z": "etz", "proximity_score": "px", "vol_expansion_score": "vx", "momentum_fragility_score": "fr", "earnings_explosiveness_score": "s", "risk_score": "s"}
_LONG = " UNION ALL ".join(f"SELECT '{f}' AS feature, {t} AS pct, {c} AS x, {_LABEL.format(t)} AS ex FROM ev WHERE {c} IS NOT NULL" for f, c in _FEATURES.items() for t in (3, 5))
both("b25_features", f"""WITH k AS ({_LONG}), r AS (SELECT *, rank() OVER (PARTITION BY feature, pct ORDER BY x) + (count(*) OVER (PARTITION BY feature, pct, x) - 1) / 2e0 AS rk FROM k)
SELECT feature, pct, count(*) AS n, [[covar_pop(x, CAST(ex AS DOUBLE)) / nullif(stddev_pop(x) * stddev_pop(CAST(ex AS DOUBLE)), 0e0)]] AS corr_label, [[{_AUC}]] AS auc FROM r GROUP BY feature, pct""")
_CATEGORIES = {"vol_stress_elevated": "vsl", "vol_stress_extreme": "vse", "sector_vol_stress_high": "ssh", "momentum_pressure_regime": "CAST(mpr AS INT)", "earnings_explosiveness_bucket": "b"}
_KINDS = " UNION ALL ".join(f"SELECT '{f}' AS feature, {t} AS pct, CAST({c} AS VARCHAR(40)) AS value, {_LABEL.format(t)} AS ex FROM ev WHERE {c} IS NOT NULL" for f, c in _CATEGORIES.items() for t in (3, 5))
both("b25_categories", f"WITH k AS ({_KINDS}) SELECT feature, pct, value, count(*) AS n, [[avg(ex)]] AS rate FROM k GROUP BY feature, pct, value")
both("b25_fragility_bins", f"WITH k AS (SELECT fr AS x, {_LABEL.format(5)} AS ex FROM ev WHERE fr IS NOT NULL), c AS (SELECT min(x) AS e0, {', '.join(f'QUANTILE(x, 0.{i}) AS e{i}' for i in range(1, 10))} FROM k), g AS (SELECT ex, {' + '.join(f'CASE WHEN x > e{i} AND e{i} > e{i - 1} THEN 1 ELSE 0 END' for i in range(1, 10))} AS bin FROM k CROSS JOIN c) SELECT bin, count(*) AS n, [[avg(ex)]] AS rate FROM g GROUP BY bin")
both("x09_top_decile_by_date", "WITH k AS (SELECT *, (rank() OVER (PARTITION BY date ORDER BY s) + (count(*) OVER (PARTITION BY date, s) - 1) / 2e0) / count(*) OVER (PARTITION BY date) AS pct FROM ev WHERE s IS NOT NULL AND a IS NOT NULL) SELECT pct > 9e-1 AS top, count(*) AS n, [[avg(ex)]] AS rate FROM k GROUP BY 1")
_ROLLS = " UNION ALL ".join(
    f"SELECT {n} AS w, y, ex, CASE WHEN count(a) OVER (PARTITION BY stock ORDER BY earnings_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) >= {n} THEN QUANTILE(a, 0.75) OVER (PARTITION BY stock ORDER BY earnings_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) WHEN count(a) OVER (PARTITION BY stock ORDER BY earnings_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 2 THEN QUANTILE(a, 0.75) OVER (PARTITION BY stock ORDER BY earnings_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS p FROM ev"
    for n in (8, 10, 15, 20, 28))
both("b26_window_sensitivity", f"""WITH k AS ({_ROLLS}), t AS (SELECT w, QUANTILE(p, 0.9) AS c FROM k WHERE y BETWEEN 1995 AND 1997 GROUP BY w),
u AS (SELECT k.w, y, max(c) AS threshold, count(CASE WHEN p >= c THEN 1 END) AS n, avg(CASE WHEN p >= c THEN ex END) / nullif(avg(ex), 0e0) AS lift, sum(CASE WHEN p >= c THEN ex ELSE 0 END) / nullif(CAST(sum(ex) AS DOUBLE), 0e0) AS capture FROM k JOIN t ON k.w = t.w WHERE y >= 1998 AND p IS NOT NULL GROUP BY k.w, y),
z AS (SELECT w, max(threshold) AS threshold, avg(lift) AS avg_lift, QUANTILE(lift, 0.5) AS median_lift, avg(CASE WHEN lift >= 3 THEN 1e0 ELSE 0e0 END) AS years_over_3, avg(n) AS avg_n, avg(capture) AS avg_capture FROM u GROUP BY w)
SELECT w, [[threshold]] AS threshold, [[avg_lift]] AS avg_lift, [[median_lift]] AS median_lift, [[years_over_3]] AS years_over_3, [[avg_n]] AS avg_n, [[avg_capture]] AS avg_capture, row_number() OVER (ORDER BY round(avg_lift, 9) DESC, w) = 1 AS best FROM z""")
both("b28_stock_report", """WITH g AS (SELECT b, avg(ex) AS p FROM ev WHERE b IS NOT NULL GROUP BY b), al AS (SELECT avg(ex) AS p FROM ev),
o AS (SELECT stock, b, count(*) AS n, sum(ex) AS hits FROM ev WHERE b IS NOT NULL GROUP BY stock, b), q AS (SELECT stock, o.b, n, hits, g.p AS tier_prob, (hits + 20 * g.p) / (n + 20e0) AS shrunk FROM o JOIN g ON o.b = g.b)
SELECT stock, b AS tier, n, CAST(hits AS BIGINT) AS hits, [[tier_prob]] AS tier_prob, [[shrunk]] AS shrunk, [[shrunk / nullif(al.p, 0e0)]] AS lift_vs_base, [[shrunk / nullif(tier_prob, 0e0)]] AS lift_vs_tier FROM q CROSS JOIN al""")
