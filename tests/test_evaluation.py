"""Evaluations against pandas versions written from their definitions, over the same scored events."""

import hashlib
import math
import os

import numpy as np
import pandas as pd
import pytest

from tailwatch.plans import registry, stages
from tailwatch.plans.sqltext import events

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def ev(spark):
    df = events(spark, SF).toPandas()
    for c in df.columns:
        if df[c].dtype == object and c not in ("stock", "date", "earnings_date", "sector", "b", "sflag", "dflag"):
            df[c] = df[c].astype(float)
    assert len(df) > 2000 and df.s.notna().any()
    return df


def rows(spark, name, *keys):
    got = registry.QUERIES[name](spark, SF).collect()
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict() for r in got} if keys else got[0].asDict()


def near(a, b):
    return (a is None or pd.isna(a)) and pd.isna(b) or a == pytest.approx(float(b), abs=2e-6)


def auc(label, score):
    rank, pos = score.rank(), label.sum()
    return (rank[label == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(label) - pos))


def bins(x, q):
    """Right-closed quantile bins, equal edges taken once, the least value in the first."""
    edges = np.unique(np.quantile(x, np.linspace(0, 1, q + 1)))
    return np.maximum(np.searchsorted(edges, x, side="left") - 1, 0)


def test_regimes(spark, ev):
    danger, high, own = ev.vr >= ev.vr.quantile(0.9), ev.s >= ev.s.quantile(0.9), ev.svs >= 1
    dense = ev.dens >= ev.dens.median()
    want = {
        "b05_regimes": {"all": ev.y > 0, "danger, individual volatility and explosiveness": danger & high & own},
        "b06_conditional": {"all": ev.y > 0, "danger": danger, "danger, extreme stress": danger & (ev.vse == 1), "danger, low density": danger & ~dense, "danger, individual volatility": danger & own},
        "b07_volatility_only": {"all": ev.y > 0, "volatile against its sector": (ev.vol >= ev.vol.quantile(0.9)) & own},
    }
    for name, masks in want.items():
        got = rows(spark, name, "mask")
        assert set(got) == {k for k, m in masks.items() if m.any()}
        for k, r in got.items():
            part = ev[masks[k]]
            assert r["n"] == len(part) and near(r["large_rate"], part.lg.mean()) and near(r["extreme_rate"], part.ex.mean())
    got = rows(spark, "b08_threshold_grid", "danger_q", "score_q")
    for d in (0.7, 0.8):
        for q in (0.8, 0.9):
            part = ev[(ev.vr >= ev.vr.quantile(d)) & (ev.s >= ev.s.quantile(q)) & own]
            assert ((d, q) in got) == (len(part) > 30)
            assert len(part) <= 30 or got[d, q]["n"] == len(part) and near(got[d, q]["rate"], part.ex.mean())
    part, got = ev[(ev.vr >= ev.vr.quantile(0.8)) & own & high], rows(spark, "b08_high_risk")
    assert got["n"] == len(part) and near(got["base_large"], ev.lg.mean()) and near(got["q75_move"], part.a.quantile(0.75)) and near(got["events_a_stock"], part.groupby("stock").size().mean())


def test_joint_regime(spark, ev):
    joint = (ev.s >= ev.s.quantile(0.9)) & (ev.fr >= ev.fr.quantile(0.9))
    tp, fp, fn = (joint & (ev.ex == 1)).sum(), (joint & (ev.ex == 0)).sum(), (~joint & (ev.ex == 1)).sum()
    got = rows(spark, "b09_precision_recall")
    assert (got["tp"], got["fp"], got["fn"], got["tn"], got["flagged"], got["n"]) == (tp, fp, fn, len(ev) - tp - fp - fn, joint.sum(), len(ev))
    assert near(got["precision_"], tp / (tp + fp)) and near(got["recall_"], tp / (tp + fn))
    got, mid = rows(spark, "b10_against_volatility", "test"), ev.y.median()
    for k, m in {"joint": joint, "first half": joint & (ev.y <= mid), "second half": joint & (ev.y > mid), "top volatility": ev.vol >= ev.vol.quantile(0.98)}.items():
        assert k not in got and not m.any() or got[k]["n"] == m.sum() and near(got[k]["precision_"], ev[m].ex.mean())
    by_name = ev.assign(p=joint).sort_values(["stock", "date"])
    key = [hashlib.md5(f"{r.stock}{r.date}".encode()).hexdigest() for r in by_name.itertuples()]
    shuffled = by_name.ex.to_numpy()[np.argsort(key, kind="stable")]
    assert got["shuffled labels"]["n"] == joint.sum() and got["shuffled labels"]["hits"] == shuffled[by_name.p.to_numpy()].sum()


def test_score_metric(spark, ev):
    x = 100 * (ev.s - ev.s.min()) / (ev.s.max() - ev.s.min())
    on = x.notna() & ev.a.notna()
    x, a, got = x[on], ev.a[on], rows(spark, "b11_score_statistics")
    want = {"n": len(x), "lo": x.min(), "hi": x.max(), "mean": x.mean(), "median_": x.median(), "sd": x.std(), "corr_move": x.corr(a), "high_tail": (x >= x.quantile(0.9)).mean(), "low_tail": (x <= x.quantile(0.1)).mean()}
    want |= {f"p{q}": x.quantile(q / 100) for q in (10, 25, 75, 90, 95)}
    assert set(got) == set(want) and all(near(got[k], want[k]) for k in want)
    got = {k: r["n"] for k, r in rows(spark, "b11_histogram", "bin").items()}
    counts, _ = np.histogram(x, bins=30)
    assert sum(abs(got.get(i, 0) - n) for i, n in enumerate(counts)) <= 2  # a value on an edge may fall to either side
    quintiles = a.groupby(bins(x, 5)).mean()
    assert all(near(r["mean_move"], quintiles[k]) for k, r in rows(spark, "b11_quintiles", "bin").items())


def test_train_and_test(spark, ev):
    d = ev[ev.s.notna() & ev.a.notna()]
    train = d[d.y < 1998]
    lo, hi = train.s.min(), train.s.max()
    x, inner = (100 * (d.s - lo) / (hi - lo)).clip(0, 100), np.quantile(train.s, [0.2, 0.4, 0.6, 0.8])
    place = np.searchsorted(inner, d.s, side="left")
    got = rows(spark, "b12_train_test", "test", "bin")
    for (test, k), part in d.groupby([d.y >= 1998, place]):
        assert got[test, k]["n"] == len(part) and near(got[test, k]["mean_move"], part.a.mean()) and near(got[test, k]["mean_score"], x[part.index].mean())
    for test, r in rows(spark, "b12_correlations", "test").items():
        assert near(r["corr_move"], x[(d.y >= 1998) == test].corr(d.a))
    deciles = ev[ev.y >= 1998].copy()
    edges = np.unique(np.quantile(ev[(ev.y < 1998) & ev.s.notna()].s, np.linspace(0, 1, 11)))
    deciles["d"] = pd.cut(deciles.s, edges, labels=False, include_lowest=True)
    per = deciles.groupby(["y", "d"]).agg(score=("s", "mean"), rate=("ex", "mean"), n=("s", "size")).groupby("d").agg(score=("score", "mean"), rate=("rate", "mean"), n=("n", "sum"))
    got = rows(spark, "b21_frozen_deciles", "decile")
    assert set(got) == {int(k) + 1 for k in per.index} and all(near(got[int(k) + 1]["avg_score"], r.score) and near(got[int(k) + 1]["actual_pct"], 100 * r.rate) and got[int(k) + 1]["n"] == r.n for k, r in per.iterrows())


def walk_forward(ev, tier, prior, shrink_to_all):
    out = []
    for y in sorted(set(ev.y[ev.y >= 1998])):
        train, test = ev.y < y, ev.y == y
        if train.sum() < 500 or test.sum() < 50:
            continue
        for t in sorted(set(tier[train].dropna())):
            inside = ev.ex[train & (tier == t)]
            mean = ev.ex[train].mean() if shrink_to_all else inside.mean()
            now = ev.ex[test & (tier == t)]
            if len(now):
                out.append((t, (inside.sum() + prior * mean) / (len(inside) + prior), now.mean(), len(now)))
    d = pd.DataFrame(out, columns=["t", "p", "a", "n"])
    d["gap"] = (d.p - d.a).abs() * 100
    g = d.groupby("t").agg(p=("p", "mean"), a=("a", "mean"), gap=("gap", "mean"), n=("n", "sum"))
    return g, (g.gap * g.n).sum() / g.n.sum()


def test_calibration(spark, ev):
    want, ece = walk_forward(ev, ev.b, 5, False)
    got = rows(spark, "b17_oos_calibration", "tier")
    assert set(got) == set(want.index)
    for k, r in want.iterrows():
        assert got[k]["n"] == r.n and near(got[k]["predicted"], 100 * r.p) and near(got[k]["actual"], 100 * r.a) and near(got[k]["error_pp"], r.gap)
    assert near(rows(spark, "b17_oos_ece")["ece"], ece)
    got = rows(spark, "b18_threshold_search", "lo", "hi")
    assert set(got) == {(lo, hi) for lo in range(55, 82, 3) for hi in range(lo + 6, 95, 3)}
    for lo, hi in [(55, 61), (61, 79), (73, 79), (79, 94)]:
        tier = pd.Series(np.searchsorted([lo, hi], ev.s, side="left").astype(float), ev.index).where(ev.s.notna())
        want, ece = walk_forward(ev, tier, 5, True)
        assert near(got[lo, hi]["ece"], ece) and near(got[lo, hi]["predicted_high"], 100 * want.p.get(2, np.nan)) and near(got[lo, hi]["actual_normal"], 100 * want.a.get(0, np.nan))
    assert [k for k, r in got.items() if r["best"]] == [min(got, key=lambda k: (round(got[k]["ece"], 6), k))]


def test_conviction(spark, ev):
    d = ev[ev.y >= 1998]
    ha, drift, flag = d.b == "High Alert", d.dflag.fillna("") != "", d.sflag.fillna("") != ""
    masks = {"High Alert": ha, "Drift": ha & drift, "Any surprise": ha & flag, "Drift and surprise": ha & drift & flag, "Drift or three flags": ha & (drift | d.sflag.isin(["Beat Streak", "Miss Streak", "Erratic"]))}
    years, pooled = rows(spark, "b16_conviction_by_year", "mask", "y"), rows(spark, "b16_conviction_pooled", "mask")
    for k, m in masks.items():
        per = []
        for y, g in d.groupby("y"):
            part = g[m[g.index]]
            if len(part):
                r = years[k, y]
                per.append(part.ex.sum() / g.ex.sum() if g.ex.sum() else np.nan)
                assert r["n"] == len(part) and near(r["rate"], part.ex.mean()) and near(r["lift"], part.ex.mean() / g.ex.mean() if g.ex.mean() else np.nan) and near(r["capture"], per[-1])
        assert k not in pooled and not m.any() or near(pooled[k]["rate"], d[m].ex.mean()) and near(pooled[k]["lift"], d[m].ex.mean() / d.ex.mean()) and near(pooled[k]["avg_capture"], np.nanmean(per)) and pooled[k]["n"] == m.sum()


def test_overlays(spark, ev):
    d = ev[ev.y >= 1998]
    part = d[d.streak.notna() & d.a.notna()]
    cut = pd.cut(part.streak, [-np.inf, -3, -1, 1, 4, 6, np.inf], labels=["-3 and below", "-2 to -1", "0 to 1", "2 to 4", "5 to 6", "above 6"]).astype(str)
    got = rows(spark, "b22_streak_bins", "bin")
    assert set(got) == set(cut)
    for k, g in part.groupby(cut):
        assert got[k]["n"] == len(g) and near(got[k]["rate"], g.ex.mean()) and near(got[k]["signed_move"], g.r.mean()) and near(got[k]["lift"], g.ex.mean() / d.ex.mean())
    got = rows(spark, "b22_drift_flags", "dflag")
    assert all(got[k]["n"] == g.a.count() and near(got[k]["rate"], g.ex.mean()) for k, g in d.groupby("dflag"))
    ha, got = d[d.b == "High Alert"], rows(spark, "b22_flag_coverage")
    assert (got["n"], got["with_drift"], got["with_either"]) == (len(ha), (ha.dflag != "").sum(), ((ha.dflag != "") | (ha.sflag != "")).sum())
    eff, got = d.b == "High Alert", rows(spark, "b20_efficiency")
    assert near(got["flagged"], eff.mean()) and near(got["captured"], d[eff].ex.sum() / d.ex.sum()) and near(got["edge"], d[eff].ex.mean() / d.ex.mean())


def test_scores_and_weights(spark, ev):
    tail, gate = ev.p75r.fillna(ev.p75), 1 + 0.4 * (ev.svs.fillna(1) > 1) + 0.3 * ev.vse.fillna(0)
    e3, e4 = (tail / 0.12).clip(0, 1), ev.ent.clip(0, 1)

    def yearly(x):
        d, corrs = pd.DataFrame({"x": x, "a": ev.a, "y": ev.y}).dropna(), []
        for y in sorted(set(d.y))[1:]:
            if (d.y < y).sum() >= 500 and (d.y == y).sum() >= 100:
                corrs.append(d.x[d.y == y].corr(d.a[d.y == y]))
        return np.mean(corrs) if corrs else np.nan

    assert near(rows(spark, "b24_simplified")["avg_corr"], yearly((100 * (0.85 * e3 + 0.15 * e4).clip(0, 1) * gate).clip(0, 100)))
    got = rows(spark, "b24_scales", "scale")
    for scale in (4, 12, 40):
        score = 0.35 * (tail / np.maximum(ev.vol, 1e-6) / scale).clip(0, 1) + 0.3 * (ev.ez.fillna(0) / scale).clip(0, 1) + 0.25 * e3 + 0.1 * e4
        assert near(got[scale]["avg_corr"], yearly((100 * score.clip(0, 1) * gate).clip(0, 100)))
    label, both = (ev.a >= 0.05).astype(int), ev.s.notna() & ev.fr.notna()
    got = rows(spark, "b25_weight_sweep", "w")
    want = {w: auc(label[both], (w * ev.s + (1 - w) * ev.fr)[both].round(9)) for w in (0, 0.25, 0.5, 1)}
    assert len(got) == 21 and all(got[w]["auc"] == pytest.approx(v, abs=1e-5) for w, v in want.items()) and sum(r["best"] for r in got.values()) == 1
    got = rows(spark, "b25_features", "feature", "pct")
    for name, x in (("vol_expansion_score", ev.vx), ("earnings_tail_z", ev.etz)):
        on, three = x.notna(), (ev.a >= 0.03).astype(int)
        assert near(got[name, 3]["corr_label"], x[on].corr(three[on])) and near(got[name, 3]["auc"], auc(three[on], x[on])) and got[name, 3]["n"] == on.sum()


def test_reports_and_ranks(spark, ev):
    d = ev[ev.b.notna()]
    tier = d.groupby("b").ex.mean()
    got = rows(spark, "b28_stock_report", "stock", "tier")
    for (stock, b), g in d.groupby(["stock", "b"]):
        p = (g.ex.sum() + 20 * tier[b]) / (len(g) + 20)
        assert near(got[stock, b]["shrunk"], p) and near(got[stock, b]["lift_vs_tier"], p / tier[b] if tier[b] else np.nan) and near(got[stock, b]["lift_vs_base"], p / ev.ex.mean())
    oos = ev[(ev.y >= 1998) & ev.a.notna() & ev.b.notna()]
    tail = oos.p75r.fillna(oos.p75)
    pct, got = tail.rank(pct=True), rows(spark, "a13_percentile_bands", "band")
    for k, lo, hi in (("0-50", 0, 0.5), ("50-75", 0.5, 0.75), ("95-99", 0.95, 0.99), ("99-100", 0.99, 1)):
        part = oos[(pct >= lo) & (pct <= hi)]
        assert got[k]["n"] == len(part) and near(got[k]["over_8"], (part.a >= 0.08).mean())
    frame = stages.scored_frame(spark, SF).select("stock", "date", "earnings_date", "abs_reaction_p75_rolling", "abs_reaction_p75").toPandas().sort_values("date")
    last = frame.groupby("stock").last()
    ahead = last[last.earnings_date >= frame.date.max()]
    want = (ahead.abs_reaction_p75_rolling.astype(float).fillna(ahead.abs_reaction_p75.astype(float)).rank(pct=True) * 100).fillna(0).astype(int)
    got = rows(spark, "m02_upcoming", "stock")
    assert {k: r["peer_percentile"] for k, r in got.items()} == want.to_dict() and len(want) > 5


def test_wilson_interval_by_hand(spark, ev):
    for r in rows(spark, "b03_decile_lift", "bin").values():
        p, n, z = r["rate"], r["n"], 1.96
        half = z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / (1 + z * z / n)
        assert r["wilson_hi"] - r["wilson_lo"] == pytest.approx(2 * half, abs=1e-5)
