"""The stages in SQL, as named views that a query's SQL takes what it needs from."""

from __future__ import annotations

import re

from ..sources.derived import SQL as SOURCES

_DAY = "PARTITION BY stock ORDER BY date"
_EVENT = "PARTITION BY stock ORDER BY earnings_date"


def rolled(f: str, x: str, over: str, n: int | str, least: int, at: str = "") -> str:
    rows = f"({over} ROWS BETWEEN {'UNBOUNDED' if n == 'all' else n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) OVER {rows} >= {least} THEN {f}({x}{at}) OVER {rows} END"


def pct_rank(x: str, keys: str) -> str:
    """With average ties."""
    part, ties = (f"PARTITION BY {keys}", f"PARTITION BY {keys}, {x}") if keys else ("", f"PARTITION BY {x}")
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({part} ORDER BY {x} NULLS LAST) + (count({x}) OVER ({ties}) - 1) / 2.0) / count({x}) OVER ({part}) END"


def r6(names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names.split())


def clip(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(0.0, least(1.0, {x})) END"


def flag(x: str) -> str:
    return f"CAST(coalesce({x}, false) AS INT)"


VIEWS = dict(SOURCES)
VIEWS["dedup"] = """WITH a AS (SELECT *, reported_eps IS NOT NULL AS e,
  coalesce(earnings_date - lag(earnings_date) OVER w <= 30, false) AS c FROM earnings WINDOW w AS (PARTITION BY stock ORDER BY earnings_date, reported_eps IS NULL)),
b AS (SELECT *, c AND NOT e AND coalesce(lag(e) OVER w, false) AS d, coalesce(lead(c) OVER w, false) AS nc, coalesce(lead(e) OVER w, false) AS ne FROM a
  WINDOW w AS (PARTITION BY stock ORDER BY earnings_date, reported_eps IS NULL))
SELECT stock, earnings_date, reported_eps, estimated_eps, surprise_percentage FROM b WHERE NOT (d OR (nc AND NOT d AND NOT (e AND NOT ne)))"""
VIEWS["base"] = """SELECT p.stock, p.date, p.price, d.sector, d.sub_sector, e.earnings_date, e.reported_eps, e.estimated_eps, e.surprise_percentage
FROM prices p JOIN stock_data d ON p.stock = d.stock ASOF LEFT JOIN dedup e ON p.stock = e.stock AND p.date <= e.earnings_date"""
VIEWS["returned"] = f"SELECT *, price / nullif(lag(price) OVER ({_DAY}), 0) - 1 AS daily_ret, CAST(earnings_date - date AS INT) AS days_to_earnings FROM base"
VIEWS["windowed"] = f"""SELECT *, {rolled('avg', 'daily_ret', _DAY, 30, 30)} AS drift_30d, {rolled('avg', 'daily_ret', _DAY, 60, 60)} AS drift_60d,
  {rolled('stddev_samp', 'daily_ret', _DAY, 10, 10)} AS vol_10d, {rolled('stddev_samp', 'daily_ret', _DAY, 30, 30)} AS vol_30d,
  {rolled('sum', 'daily_ret', _DAY, 5, 5)} AS mom_5d, {rolled('sum', 'daily_ret', _DAY, 20, 20)} AS mom_20d,
  {flag('days_to_earnings = 0')} AS is_earnings_day, {flag('days_to_earnings BETWEEN 0 AND 5')} AS is_earnings_week, {flag('days_to_earnings BETWEEN 0 AND 10')} AS is_earnings_window,
  lead(price, 1) OVER ({_DAY}) / nullif(price, 0) - 1 AS n1, lead(price, 3) OVER ({_DAY}) / nullif(price, 0) - 1 AS n3, lead(price, 5) OVER ({_DAY}) / nullif(price, 0) - 1 AS n5 FROM returned"""
VIEWS["reacted"] = """SELECT * EXCLUDE (n1, n3, n5), vol_10d / nullif(vol_30d, 0) AS vol_ratio_10_to_30,
  CASE WHEN is_earnings_day = 1 THEN n1 END AS reaction_1d, CASE WHEN is_earnings_day = 1 THEN n3 END AS reaction_3d, CASE WHEN is_earnings_day = 1 THEN n5 END AS reaction_5d FROM windowed"""
VIEWS["daily"] = f"""SELECT *, abs(reaction_3d) AS abs_reaction_3d, {flag('reaction_3d > 0.007')} AS is_up, {flag('reaction_3d < -0.007')} AS is_down, {flag('abs(reaction_3d) <= 0.007')} AS is_nochange,
  {flag('abs(reaction_3d) >= 0.05')} AS is_large_reaction, {flag('abs(reaction_3d) >= 0.08')} AS is_extreme_reaction FROM reacted"""
VIEWS["sector_days"] = """WITH m AS (SELECT sector, date, avg(drift_60d) AS a, avg(vol_10d) AS b, avg(vol_30d) AS c FROM daily WHERE sector IS NOT NULL GROUP BY 1, 2)
SELECT sector, date, lag(a) OVER w AS sector_drift_60d, lag(b) OVER w AS sector_vol_10d, lag(c) OVER w AS sector_vol_30d FROM m WINDOW w AS (PARTITION BY sector ORDER BY date)"""
VIEWS["sectored"] = """SELECT d.*, s.sector_drift_60d, s.sector_vol_10d, s.sector_vol_30d, vol_30d / nullif(s.sector_vol_30d, 0) AS stock_vs_sector_vol,
  avg(is_earnings_week) OVER (PARTITION BY d.sector, d.date) AS sector_earnings_density
FROM daily d LEFT JOIN sector_days s ON d.sector = s.sector AND d.date = s.date"""
VIEWS["event_days"] = "SELECT stock, date, earnings_date, reaction_1d, reaction_3d, abs(reaction_3d) AS a, surprise_percentage, drift_30d FROM daily WHERE is_earnings_day = 1"
VIEWS["event_rolled"] = f"""SELECT *, {rolled('quantile_cont', 'a', _EVENT, 28, 28, ', 0.75')} AS abs_reaction_p75_rolling, {rolled('quantile_cont', 'a', _EVENT, 28, 28, ', 0.9')} AS abs_reaction_p90_rolling,
  {rolled('avg', 'surprise_percentage', _EVENT, 5, 3)} AS surprise_mean_5, {rolled('stddev_samp', 'surprise_percentage', _EVENT, 5, 3)} AS surprise_std_5,
  (drift_30d - {rolled('avg', 'drift_30d', _EVENT, 'all', 1)}) / nullif({rolled('stddev_samp', 'drift_30d', _EVENT, 'all', 5)}, 0) AS pre_earnings_drift_z FROM event_days"""
VIEWS["event_reacted"] = f"""SELECT stock, date, earnings_date, {rolled('stddev_samp', 'a', _EVENT, 8, 3)} AS reaction_std, {rolled('avg', 'reaction_3d', _EVENT, 'all', 1)} AS directional_bias,
  {rolled('quantile_cont', 'a', _EVENT, 'all', 1, ', 0.5')} AS abs_reaction_median, {rolled('quantile_cont', 'a', _EVENT, 'all', 1, ', 0.75')} AS abs_reaction_p75 FROM event_days WHERE a IS NOT NULL"""
VIEWS["event_entropy"] = f"""WITH l AS (SELECT stock, date, list(abs(coalesce(reaction_3d, reaction_1d))) OVER ({_EVENT} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v
  FROM event_days WHERE coalesce(reaction_3d, reaction_1d) IS NOT NULL),
m AS (SELECT stock, date, v, list_min(v) AS lo, list_max(v) AS hi FROM l WHERE len(v) >= 8),
h AS (SELECT *, list_transform(v, lambda x: least(7, CAST(floor((x - lo) / nullif(hi - lo, 0) * 8) AS INT))) AS p FROM m),
k AS (SELECT *, list_filter(list_transform(range(8), lambda b: len(list_filter(p, lambda y: y = b))), lambda n: n > 0) AS n FROM h)
SELECT stock, date, CASE WHEN hi > lo THEN -list_sum(list_transform(n, lambda z: z / len(v) * ln(z / len(v)))) ELSE 0.0 END AS reaction_entropy FROM k"""
VIEWS["event_streak"] = """WITH p AS (SELECT stock, date, earnings_date, lag(surprise_percentage) OVER w AS past FROM event_days WINDOW w AS (PARTITION BY stock ORDER BY earnings_date)),
y AS (SELECT *, CASE WHEN past >= 0 THEN 1 WHEN past < 0 THEN -1 END AS way FROM p),
f AS (SELECT *, CASE WHEN way IS NOT NULL AND way = lag(way) OVER (PARTITION BY stock ORDER BY earnings_date) THEN 0 ELSE 1 END AS fresh FROM y),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY stock ORDER BY earnings_date) AS run FROM f)
SELECT stock, date, CAST(row_number() OVER (PARTITION BY stock, run ORDER BY earnings_date) * way AS DOUBLE) AS surprise_streak FROM g"""
VIEWS["featured"] = """SELECT s.*, r.abs_reaction_p75_rolling, r.abs_reaction_p90_rolling, r.surprise_mean_5, r.surprise_std_5, k.surprise_streak, r.pre_earnings_drift_z,
  e.directional_bias, e.abs_reaction_median, e.abs_reaction_p75, h.reaction_entropy, x.reaction_std
FROM sectored s LEFT JOIN event_rolled r ON s.stock = r.stock AND s.date = r.date LEFT JOIN event_streak k ON s.stock = k.stock AND s.date = k.date
LEFT JOIN event_reacted e ON s.stock = e.stock AND s.date = e.date LEFT JOIN event_entropy h ON s.stock = h.stock AND s.date = h.date
LEFT JOIN event_reacted x ON s.stock = x.stock AND s.earnings_date = x.earnings_date"""
VIEWS["ranked"] = f"""SELECT *, {pct_rank('vol_ratio_10_to_30', 'date')} AS vol_ratio_cross_sectional_pct, {pct_rank('vol_ratio_10_to_30', 'sector, date')} AS sector_vol_ratio_pct,
  coalesce(abs(mom_5d) > quantile_cont(abs(mom_5d), 0.8) OVER (PARTITION BY date), false) AS far5, coalesce(abs(mom_20d) > quantile_cont(abs(mom_20d), 0.8) OVER (PARTITION BY date), false) AS far20,
  last_value(reaction_entropy IGNORE NULLS) OVER (PARTITION BY stock ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known_entropy FROM featured"""
VIEWS["stressed"] = f"""SELECT * EXCLUDE (far5, far20), {flag('vol_ratio_cross_sectional_pct >= 0.8 AND vol_ratio_10_to_30 >= 1.1')} AS vol_stress_elevated, {flag('vol_ratio_cross_sectional_pct >= 0.9')} AS vol_stress_extreme,
  {flag('sector_vol_ratio_pct >= 0.9')} AS sector_vol_stress_high, CASE WHEN far5 AND far20 THEN 100.0 WHEN far20 THEN 55.0 WHEN far5 THEN 35.0 ELSE 0.0 END::DOUBLE AS momentum_pressure_regime,
  power(1 - {clip('days_to_earnings / 30.0::DOUBLE')}, 1.5) AS nearness, (SELECT quantile_cont(abs(directional_bias), 0.9) FROM featured) AS bias_p90,
  coalesce(abs_reaction_p75_rolling, abs_reaction_p75) AS tail FROM ranked"""
VIEWS["unflagged"] = f"""SELECT * EXCLUDE (nearness, bias_p90, tail, known_entropy), abs_reaction_median / CASE WHEN vol_30d IS NOT NULL THEN greatest(vol_30d, 1e-6) END AS earnings_explosiveness_z,
  abs_reaction_p75 / CASE WHEN vol_30d IS NOT NULL THEN greatest(vol_30d, 1e-6) END AS earnings_tail_z,
  coalesce(CASE WHEN days_to_earnings > 0 THEN 100 * {clip('nearness + CASE WHEN nearness > 0.6 AND is_earnings_window = 1 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN nearness > 0.6 AND is_earnings_week = 1 THEN 0.08::DOUBLE ELSE 0 END')} END, 0.0) AS proximity_score,
  100 * {clip('(0.40::DOUBLE * coalesce(vol_ratio_cross_sectional_pct, 0) + 0.35::DOUBLE * coalesce(' + clip('(stock_vs_sector_vol - 1) / 1.5::DOUBLE') + ', 0) + 0.25::DOUBLE * coalesce(sector_vol_ratio_pct, 0)) * (1 + 0.25::DOUBLE * vol_stress_elevated + 0.5::DOUBLE * vol_stress_extreme) + 0.08::DOUBLE * sector_vol_stress_high')} AS vol_expansion_score,
  100 * {clip('0.35::DOUBLE * coalesce(' + clip('abs(sector_drift_60d) / 0.10::DOUBLE') + ', 0) + 0.20::DOUBLE * coalesce(' + clip('abs(directional_bias) / nullif(bias_p90, 0)') + ', 0)')} AS momentum_fragility_score,
  CASE WHEN tail IS NOT NULL THEN 100 * {clip('0.85::DOUBLE * ' + '(' + clip('tail / 0.12::DOUBLE') + ')' + ' + 0.15::DOUBLE * coalesce(' + clip('known_entropy') + ', 0)')} END AS earnings_explosiveness_score,
  CASE WHEN is_earnings_day = 1 AND abs_reaction_p75_rolling IS NOT NULL AND abs_reaction_p90_rolling IS NOT NULL THEN
    CASE WHEN abs_reaction_3d < abs_reaction_p75_rolling THEN 0 WHEN abs_reaction_3d < abs_reaction_p90_rolling THEN 1 WHEN abs_reaction_3d >= abs_reaction_p90_rolling THEN 2 END END AS earnings_move_bucket,
  CASE WHEN is_earnings_day = 1 THEN CASE WHEN surprise_streak >= 6 THEN 'Extended Beat Streak' WHEN surprise_streak >= 4 AND surprise_mean_5 > 0.05 THEN 'Beat Streak'
    WHEN surprise_streak <= -3 THEN 'Miss Streak' WHEN surprise_std_5 > 0.20 THEN 'Erratic' ELSE '' END END AS own_flag FROM stressed"""
VIEWS["scored"] = """WITH h AS (SELECT stock, avg(drift_30d) AS m, stddev_samp(drift_30d) AS sd FROM unflagged WHERE is_earnings_day = 1 GROUP BY 1),
z AS (SELECT u.*, CASE WHEN is_earnings_day = 1 THEN pre_earnings_drift_z WHEN days_to_earnings BETWEEN 1 AND 60 AND h.sd > 0 THEN (drift_30d - h.m) / h.sd END AS z FROM unflagged u LEFT JOIN h ON u.stock = h.stock),
f AS (SELECT * EXCLUDE (z, own_flag), coalesce(last_value(own_flag IGNORE NULLS) OVER (PARTITION BY stock ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS surprise_momentum_flag,
  CASE WHEN z >= 1.5 THEN 'Extended' WHEN z <= -1.5 THEN 'Compressed' ELSE '' END AS pre_earnings_drift_flag,
  CASE WHEN earnings_explosiveness_score <= 73 THEN 'Normal' WHEN earnings_explosiveness_score <= 79 THEN 'Elevated' WHEN earnings_explosiveness_score > 79 THEN 'High Alert' END AS earnings_explosiveness_bucket FROM z)
SELECT *, earnings_explosiveness_score AS risk_score, coalesce(earnings_explosiveness_bucket = 'High Alert' AND pre_earnings_drift_flag <> '', false) AS is_high_conviction FROM f"""


def sql(final: str, **more: str) -> str:
    """``final`` with the views it needs, directly or not, in front; ``more``: further views."""
    views = VIEWS | more
    order = list(views)
    need, todo = set(), [final]
    while todo:
        text = todo.pop()
        for name in order:
            if name not in need and re.search(rf"\b(FROM|JOIN|,)\s*{name}\b", text):
                need.add(name)
                todo.append(views[name])
    head = ",\n".join(f"{n} AS MATERIALIZED ({views[n]})" for n in order if n in need)
    if not head:
        return final
    return f"WITH {head}" + (f",\n{final.removeprefix('WITH ')}" if final.startswith("WITH ") else f"\n{final}")
