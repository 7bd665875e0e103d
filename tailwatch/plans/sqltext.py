"""Evaluation queries as SQL text over scored events, which Spark plans and DuckDB checks.

In a text, ``QUANTILE`` is the exact interpolated percentile and ``[[x]]`` rounds a double at the very
end of a query. Literals with an exponent are doubles in both engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import stages
from .oracle import sql
from .registry import query

#: The columns that evaluations read, under short names: one row per event.
EVENTS = """SELECT stock, date, earnings_date, CAST(year(earnings_date) AS INT) AS y, sector, reaction_1d AS r1, reaction_3d AS r, abs_reaction_3d AS a, is_large_reaction AS lg, is_extreme_reaction AS ex,
  earnings_explosiveness_score AS s, earnings_explosiveness_bucket AS b, is_high_conviction AS hc, abs_reaction_median AS med, abs_reaction_p75 AS p75, abs_reaction_p75_rolling AS p75r,
  vol_30d AS vol, vol_ratio_10_to_30 AS vr, stock_vs_sector_vol AS svs, surprise_streak AS streak, surprise_momentum_flag AS sflag, pre_earnings_drift_flag AS dflag, pre_earnings_drift_z AS z,
  momentum_fragility_score AS fr, vol_expansion_score AS vx, directional_bias AS bias, reaction_entropy AS ent, sector_earnings_density AS dens, vol_stress_elevated AS vsl, vol_stress_extreme AS vse,
  sector_vol_stress_high AS ssh, momentum_pressure_regime AS mpr, vol_ratio_cross_sectional_pct AS vrp, sector_vol_ratio_pct AS svp, earnings_explosiveness_z AS ez, earnings_tail_z AS etz, proximity_score AS px FROM {scored} WHERE is_earnings_day = 1"""


def _text(template: str, quantile: str) -> str:
    return template.replace("QUANTILE(", f"{quantile}(").replace("[[", "(round(").replace("]]", ", 6) + 0e0)")


def events(spark: SparkSession, sf_dir: str, text: str | None = None) -> DataFrame:
    """Events with all columns, or with those that a text names."""
    named = None if text is None else {*re.findall(r"\w+", text)}
    items = [x for x in EVENTS.split(" FROM ")[0].removeprefix("SELECT ").replace("\n", " ").split(", ") if named is None or x.split()[-1] in named]
    read = {"earnings_date" if x.startswith("CAST(year(earnings_date)") else x.split()[0] for x in items}
    frame = stages.event_frame(spark, sf_dir, read | {"is_earnings_day"})
    return spark.sql(f"SELECT {', '.join(items or ['stock'])} FROM {{scored}} WHERE is_earnings_day = 1", scored=frame)


def both(name: str, template: str) -> None:
    """Register a text over ``ev`` (events) and ``scored`` for both engines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = _text(template, "percentile")
        frames = {}
        for view, frame in (("ev", events), ("scored", stages.scored_frame)):
            marked = text.replace(f"FROM {view}", f"FROM {{{view}}}").replace(f"JOIN {view} ", f"JOIN {{{view}}} ")
            if marked != text:
                frames[view] = frame(spark, sf_dir, text) if view == "ev" else frame(spark, sf_dir)
                text = marked
        return spark.sql(text, **frames)

    query(name, sql(_text(template, "quantile_cont"), ev=EVENTS.replace("{scored}", "scored")))(run)
