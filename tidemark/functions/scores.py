"""Scores, gates and ratings as column expressions over a feature row. Nulls are 'not known' and score nothing unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import scaled, weighted_mean_of_present

Bands = list[tuple[float, float]]

# Points by band, highest first; a value above the bound gets the points.
MOM_6M: Bands = [(40, 30), (25, 25), (12, 19), (3, 12), (-8, 6)]
MOM_3M: Bands = [(20, 15), (8, 11), (0, 7), (-8, 3)]
ACCEL: Bands = [(8, 14), (2, 10), (-2, 5)]
CUMULATIVE: Bands = [(25, 10), (10, 7), (0, 4)]
SPIKE: Bands = [(2.0, 10), (1.3, 7), (0.8, 4)]
#: Score 0 at the first bound, 100 at the second.
BOUNDS = {
    "roe": (5.0, 20.0),
    "net_margin": (0.0, 15.0),
    "gross_margin": (10.0, 30.0),
    "asset_turnover": (0.5, 3.0),
    "rev_cagr": (-5.0, 15.0),
    "eps_cagr": (0.0, 20.0),
    "debt_to_asset": (60.0, 30.0),
    "current_ratio": (100.0, 250.0),
    "pe_vs_industry": (30.0, 10.0),
}
GROUPS = {
    "profitability": (["roe", "net_margin", "gross_margin", "asset_turnover"], 0.30),
    "growth": (["rev_cagr", "eps_cagr"], 0.25),
    "safety": (["debt_to_asset", "current_ratio"], 0.25),
    "valuation": (["pe_vs_industry"], 0.20),
}
PEG_POINTS = [(0.75, 100.0), (1.0, 80.0), (1.5, 55.0), (2.0, 35.0), (3.0, 0.0)]
#: Weights of fundamental, valuation, technical, momentum, whale and the least score, by mode.
MODES = {
    "conservative": (0.28, 0.17, 0.20, 0.16, 0.19, 64),
    "aggressive": (0.12, 0.08, 0.22, 0.34, 0.24, 55),
    "balanced": (0.31, 0.08, 0.19, 0.27, 0.15, 54),
}
REGIME_FACTORS = {
    "bull": (1.00, 1.00, 1.05, 1.10, 1.00),
    "neutral": (1.00, 1.00, 1.00, 1.00, 1.00),
    "bear": (1.00, 0.60, 0.30, 1.50, 0.30),
}
#: Gates by mode: high and overheated RSI, chased bias, least whale score, and what counts as hot momentum, whale, revenue and technical.
GATES = ("rsi_overbought", "rsi_extreme", "bias_chase", "chip_min", "mom_hot", "whale_hot", "rev_hot", "tech_hot")
PROFILES = {
    "conservative": (65.0, 72.0, 12.0, 45.0, 52.0, 48.0, 15.0, 70.0),
    "aggressive": (75.0, 82.0, 18.0, 30.0, 42.0, 36.0, 10.0, 60.0),
    "balanced": (72.0, 78.0, 15.0, 30.0, 46.0, 42.0, 12.0, 65.0),
}
#: In a bear market: added to the least score, and factors of chip_min and whale_hot.
BEAR_GATES = (10.0, 1.5, 1.4)
HORIZON_WEIGHTS = {1: 0.10, 3: 0.15, 5: 0.25, 10: 0.25, 20: 0.25}


def by_band(v: Column, bands: Bands) -> Column:
    """Points of the first band whose bound v exceeds; 0 below all and for null."""
    out = F
    for bound, points in bands:
        out = out.when(v > bound, F.lit(float(points)))
    return out.otherwise(0.0)


def points(*rules: tuple[Column, float]) -> Column:
    """Points of the first rule that holds, else 0."""
    out = F
    for rule, value in rules:
        out = out.when(rule, F.lit(float(value)))
    return out.otherwise(0.0)


def clamped(v: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), v))


def technical_score(c=F.col, extra: Column | float = 0.0) -> Column:
    """From close, ma5, ma20, weekly_ma, rsi, macd_status, cross, bb_status, ma_cross."""
    structure = points((c("close") > c("ma5"), 10)) + points((c("ma5") > c("ma20"), 10)) + points((c("close") > c("ma20"), 10))
    weekly = points(((c("weekly_ma") > 0) & (c("close") > c("weekly_ma")), 15))
    r = c("rsi")
    strength = points((r.between(50, 70), 25), ((r >= 40) & (r < 50), 18), ((r > 70) & (r <= 75), 15), ((r >= 30) & (r < 40), 10), (r > 75, 8))
    m = c("macd_status")
    trend = points((m == "bullish_strong", 20), ((m == "bullish_recovery") | (c("cross") == "golden"), 15), (m == "neutral", 8))
    band = points((c("bb_status") == "squeezing", 8), (c("bb_status") == "expanding", 5))
    crossed = points((c("ma_cross") == "golden_cross", 6), (c("ma_cross") == "death_cross", -8))
    return clamped(structure + weekly + strength + trend + band + crossed + extra)


def momentum_score(c=F.col, extra: Column | float = 0.0) -> Column:
    """An unknown or zero spike counts as 1. From m6, m3, rs6, rs3, accel, cum_yoy, rev_streak, volume, spike, bias, divergence, obv_rising, j."""
    m6, m3 = F.coalesce(c("m6"), F.lit(0.0)), F.coalesce(c("m3"), F.lit(0.0))
    price = by_band(m6, MOM_6M) + by_band(m3, MOM_3M) + points(((m6 > 12) & (m3 < -5), -8))
    rs3 = F.coalesce(c("rs3"), F.lit(0.0))
    relative = points(((c("rs6") > 20) & (rs3 > 0), 8), (c("rs6") > 8, 5), (c("rs6") > 0, 2), (c("rs6") < -15, -6), (c("rs6") < -5, -3))
    revenue = by_band(c("accel"), ACCEL) + by_band(c("cum_yoy"), CUMULATIVE) + points((c("rev_streak") >= 6, 6), (c("rev_streak") >= 3, 3))
    b = c("bias")
    spike = F.coalesce(F.nullif(c("spike"), F.lit(0.0)), F.lit(1.0))
    health = F.when(c("volume") >= 500, by_band(spike, SPIKE)).otherwise(0.0)
    health = health + points(((b > 0) & (b <= 8), 10), (b.between(-5, 0), 8), ((b > 8) & (b <= 15), 5), (b > 15, 1), ((b >= -12) & (b < -5), 3))
    health = health + points((c("divergence"), -5), (c("obv_rising"), 5)) + points((c("j") > 100, -3))
    return clamped(price + relative + revenue + health + extra)


def horizon_ratio(foreign: Column, trust: Column) -> Column:
    """Weighted sum over the horizons of two maps from horizon to net ratio."""
    at = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0.0))
    return sum((F.lit(w) * (at(foreign, k) + at(trust, k)) for k, w in HORIZON_WEIGHTS.items()), F.lit(0.0))


def whale_score(c=F.col) -> Column:
    """From foreign, trust (maps horizon to net ratio), fbuy, tbuy, fsell, tsell (days), concentration, participation, flow_accel, up_volume, holders_change."""
    ratio = horizon_ratio(c("foreign"), c("trust"))
    at = lambda m, k: F.coalesce(F.try_element_at(c(m), F.lit(k)), F.lit(0.0))
    both = points((((at("foreign", 5) > 0) & (at("trust", 5) > 0)) | ((at("foreign", 10) > 0) & (at("trust", 10) > 0)), 8))
    days = lambda x: F.least(F.coalesce(c(x), F.lit(0)), F.lit(3)) * 2.0
    streaks = days("fbuy") + days("tbuy") - days("fsell") - days("tsell")
    more = points((c("concentration") >= 1.0, 8), (c("concentration") >= 0.3, 4)) + points((c("participation") >= 40, 4), (c("participation") >= 25, 2))
    more = more + points(((ratio > 0) & (c("flow_accel") >= 1.5), 5)) + points((c("up_volume") >= 55, 3), ((c("up_volume") > 0) & (c("up_volume") < 45), -3))
    now = clamped(48 + ratio * 300 + both + streaks + clamped(more, -15, 15) + _holders(c, ratio))
    empty = lambda x: F.coalesce(F.size(c(x)), F.lit(0)) <= 0
    return F.when(empty("foreign") & empty("trust"), streak_whale_score(c)).otherwise(now)


def _holders(c, inflow: Column) -> Column:
    """Points of the large holders' change; less where they leave while others buy."""
    h = F.coalesce(c("holders_change"), F.lit(0.0))
    points_ = F.when(h > 0, F.least(h * 4, F.lit(8.0))).when(h < 0, F.greatest(h * 4, F.lit(-8.0)) + F.when(inflow > 0, -3.0).otherwise(0.0)).otherwise(0.0)
    return clamped(points_, -8, 8)


def streak_whale_score(c=F.col) -> Column:
    """The score without net ratios: from the days of buying and selling, net5, fflow and tflow (net lots of 5 and 10 days) and the rest as above."""
    known = lambda x: F.coalesce(c(x), F.lit(0.0))
    side = lambda x: F.least(known(x) * 20.0, F.lit(100.0)) * 0.5
    base = side("tbuy") + side("fbuy") + points(((known("tbuy") > 0) & (known("fbuy") > 0), 15)) - known("tsell") * 8.0 - known("fsell") * 6.0
    sign = lambda x, n: points((known(x) > 0, n), (known(x) < 0, -n))
    more = sign("net5", 8) + sign("fflow", 4) + sign("tflow", 4) + points(((known("net5") > 0) & (c("flow_accel") >= 1.5), 5))
    more = more + points((c("concentration") >= 1.0, 8), (c("concentration") >= 0.3, 4)) + points((c("participation") >= 40, 4), (c("participation") >= 25, 2))
    more = more + points((c("up_volume") >= 55, 3), ((c("up_volume") > 0) & (c("up_volume") < 45), -3))
    return clamped(base + clamped(more, -25, 25) + _holders(c, known("net5")))


def overlays(c=F.col) -> dict[str, tuple[Column | float, Column | float]]:
    """Points that a variant of the signals adds to the technical and to the momentum score."""
    b, rs3 = c("percent_b"), F.coalesce(c("rs3"), F.lit(0.0))
    relative = points(((c("rs6") > 20) & (rs3 > 0), 8), (c("rs6") > 8, 5), (c("rs6") > 0, 2), (c("rs6") < -15, -6), (c("rs6") < -5, -3))
    return {
        "base": (0.0, 0.0), "no_relative_strength": (0.0, -relative), "percent_b": (points((b.between(0.5, 0.95), 5), (b > 1.05, -4), (b < 0.05, -2)), 0.0),
        "kd": (points(((c("k") > c("d_")) & c("j").between(20, 90), 5), ((c("k") < c("d_")) & (c("j") < 20), -3)), 0.0), "obv_trend": (0.0, points((c("obv_above_ma20"), 4), (~c("obv_above_ma20"), -2))),
    }


def comment_tags(c=F.col) -> Column:
    """Tags of a pre-score, joined by +, from whale, technical and the days of buying and selling."""
    more = lambda a, b, name: F.when((c(a) > 0) | (c(b) > 0), name)
    first = F.when(c("whale") > 70, "joint_buying").when(c("tbuy") > 0, "trust_buying")
    tags = F.concat_ws("+", first, more("tsell", "fsell", "selling"), F.when(c("technical") > 70, "averages_aligned"))
    return F.when(tags == "", "consolidating").otherwise(tags)


def group_score(keys: list[str], c=F.col) -> Column:
    """Mean of the known metrics' scores; 50 if none is known."""
    n = sum((F.when(c(k).isNotNull(), 1).otherwise(0) for k in keys), F.lit(0))
    total = sum((F.coalesce(scaled(c(k), *BOUNDS[k]), F.lit(0.0)) for k in keys), F.lit(0.0))
    return F.when(n > 0, total / n).otherwise(50.0)


def fundamental_score(c=F.col) -> Column:
    """Weighted mean of the four groups."""
    return sum((group_score(keys, c) * w for keys, w in GROUPS.values()), F.lit(0.0))


def fundamental_passed(c=F.col) -> Column:
    """The hard gates; financial entities are exempt from those on debt and liquidity, and debt that is liquid and earns passes."""
    d, cr, nm = c("debt_to_asset"), c("current_ratio"), c("net_margin")
    known = d.isNotNull() & cr.isNotNull() & nm.isNotNull()
    bad_debt = (d > 85) & ~c("is_financial") & ((cr < 100) | (nm < 0) | (d > 92))
    return F.coalesce(known & ~bad_debt & ~((cr < 50) & ~c("is_financial")) & (nm >= -10), F.lit(False)) & F.coalesce(c("cash_quality") >= 0.5, F.lit(True))


def fundamental_confidence(c=F.col) -> Column:
    keys = [k for keys, _ in GROUPS.values() for k in keys if k != "asset_turnover"]
    missing = sum((F.when(c(k).isNull(), 1).otherwise(0) for k in keys), F.lit(0))
    return F.greatest(F.lit(0.0), 100 - missing * 12.0)


def profit_risk(c=F.col) -> Column:
    """Earnings that outgrow sales without the core business, or fall while sales rise."""
    share = F.when(c("operating_share") > 1.5, c("operating_share") / 100).otherwise(c("operating_share"))
    jump = (c("income_growth") > 0) & (c("income_growth") - c("revenue_growth") >= 25)
    return F.coalesce(F.when(jump, share < 0.80).otherwise((c("income_growth") < 0) & (c("revenue_growth") > 0)), F.lit(False))


def moat(c=F.col) -> Column:
    g = c("gross_margin")
    return F.when(g >= 40, "strong").when(g >= 20, "medium").when(g.isNotNull(), "weak").otherwise("unknown")


def cash_health(c=F.col) -> Column:
    """healthy, watch, high_risk or unknown, from ocf, fcf, ocf_to_income, cum_yoy, rev_cagr."""
    growing = F.coalesce(c("cum_yoy") >= 30, F.lit(False)) | F.coalesce(c("rev_cagr") >= 30, F.lit(False))
    thin = F.coalesce(c("ocf_to_income") < 0.5, F.lit(False))
    return (
        F.when(c("ocf").isNull(), "unknown")
        .when(c("ocf") < 0, F.when(growing, "watch").otherwise("high_risk"))
        .when(thin | (F.coalesce(c("fcf") < 0, F.lit(False)) & (c("ocf") <= 0)), "watch")
        .otherwise("healthy")
    )


def peg_score(peg: Column) -> Column:
    """100 to 0 along the points, linear between."""
    out = F.when(peg <= PEG_POINTS[0][0], 100.0)
    for (x0, y0), (x1, y1) in zip(PEG_POINTS, PEG_POINTS[1:], strict=False):
        out = out.when(peg <= x1, y0 + (y1 - y0) * (peg - x0) / (x1 - x0))
    return F.when(peg.isNotNull(), out.otherwise(0.0))


def history_score(c=F.col) -> Column:
    """Mean of how low pe and pb, and how high the yield, stand in their own histories, by weights renormalised to what is known; null without pe_pct and pb_pct."""
    parts = [(100 - c("pe_pct"), 0.45), (100 - c("pb_pct"), 0.30), (c("yield_pct"), 0.25)]
    w = sum((F.when(v.isNotNull(), x).otherwise(0.0) for v, x in parts), F.lit(0.0))
    b = sum((F.coalesce(v, F.lit(0.0)) * x for v, x in parts), F.lit(0.0)) / F.nullif(w, F.lit(0.0))
    return F.when(c("pe_pct").isNotNull() | c("pb_pct").isNotNull(), b)


def valuation_score(c=F.col) -> Column:
    """The industry percentile where known; else .85 of the PEG score and .15 of the historical ranks; capped at 30 for a dear price without growth.

    From industry_pct, pe, pe_pct, pb_pct, yield_pct, growth (the first positive growth known), cum_yoy.
    """
    peg = F.when((c("pe") > 0) & (c("growth") > 0), c("pe") / c("growth"))
    a = peg_score(peg)
    b = history_score(c)
    mix = F.when(a.isNotNull() & b.isNotNull(), a * 0.85 + b * 0.15).otherwise(F.coalesce(a, b))
    grows = F.coalesce(peg < 1.0, F.lit(False)) | F.coalesce(c("cum_yoy") >= 15, F.lit(False))
    checked = peg.isNotNull() | c("cum_yoy").isNotNull() | c("growth").isNotNull()
    bubble = F.coalesce(c("pe_pct") >= 80, F.lit(False)) & checked & ~grows
    return F.coalesce(c("industry_pct"), F.when(bubble, F.least(mix, F.lit(30.0))).otherwise(mix))


#: Bounds of the absolute valuation, (value of 0, value of 100), and the weight of each: fixed values.
ABSOLUTE = {"pe": (30.0, 8.0, 0.35), "pb": (4.0, 0.8, 0.25), "ps": (8.0, 0.5, 0.20), "dividend_yield": (0.0, 6.0, 0.20)}


def absolute_valuation(c=F.col) -> Column:
    """0 to 100 from pe, pb, ps and dividend_yield (0: unknown) between fixed bounds, by weights renormalised to what is known; null where nothing is."""
    known = {k: F.nullif(c(k), F.lit(0.0)) if k == "dividend_yield" else c(k) for k in ABSOLUTE}
    return weighted_mean_of_present([(F.when(known[k].isNotNull(), scaled(known[k], low, high)), w) for k, (low, high, w) in ABSOLUTE.items()])


def valuation_basis(c=F.col) -> Column:
    """What the valuation rests on: industry, growth+history, growth, history, absolute or none."""
    growth = F.when((c("pe") > 0) & (c("growth") > 0), "growth")
    history = F.when(c("pe_pct").isNotNull() | c("pb_pct").isNotNull(), "history")
    absolute = F.when(absolute_valuation(c).isNotNull(), "absolute").otherwise("none")
    return F.when(c("industry_pct").isNotNull(), "industry").otherwise(F.coalesce(F.nullif(F.concat_ws("+", growth, history), F.lit("")), absolute))


def valuation_confidence(c=F.col) -> Column:
    """80 and 5 for each further lens under the industry's rank; else 100 less 12 (of history) or 20 (absolute) for each missing one."""
    lack = lambda *names: sum((F.when(c(n).isNull(), 1).otherwise(0) for n in names), F.lit(0))
    lenses = 3 - lack("pe_pct", "pb_pct", "yield_pct") + F.when(F.coalesce((c("pe") > 0) & (c("growth") > 0), F.lit(False)), 1).otherwise(0)
    history = F.when(c("pe_pct").isNotNull() | c("pb_pct").isNotNull(), lack("pe_pct", "pb_pct", "yield_pct")).otherwise(3)
    absolute = lack("pe", "pb", "ps") + F.when(F.nullif(c("dividend_yield"), F.lit(0.0)).isNull(), 1).otherwise(0)
    basis = valuation_basis(c)
    return F.when(basis == "industry", F.least(F.lit(100.0), 80.0 + lenses * 5.0)).when(basis.isin("absolute", "none"), F.greatest(F.lit(0.0), 100.0 - absolute * 20.0)).otherwise(F.greatest(F.lit(40.0), 100.0 - history * 12.0))


def valuation_status(score: Column) -> Column:
    return F.when(score >= 65, "cheap").when(score >= 40, "fair").when(score.isNotNull(), "dear").otherwise("unknown")


DIMENSIONS = ("fundamental", "valuation", "technical", "momentum", "whale")


def composite_score(regime: Column, strong_trend: Column, c=F.col) -> Column:
    """Weighted mean of the five dimensions by a mode's weights (w_<dimension>), the regime and the trend.

    In a strong trend 60 % of the valuation weight moves to momentum (.6) and whale (.4).
    """
    factor = lambda i: F.when(regime == "bull", REGIME_FACTORS["bull"][i]).when(regime == "bear", REGIME_FACTORS["bear"][i]).otherwise(1.0)
    w = {k: c(f"w_{k}") * factor(i) for i, k in enumerate(DIMENSIONS)}
    cut = F.when(strong_trend, w["valuation"] * 0.6).otherwise(0.0)
    w |= {"valuation": w["valuation"] - cut, "momentum": w["momentum"] + cut * 0.6, "whale": w["whale"] + cut * 0.4}
    return sum((w[k] * c(k) for k in DIMENSIONS), F.lit(0.0)) / sum(w.values(), F.lit(0.0))


def rating(c=F.col) -> Column:
    """AVOID, WATCH, STRONG or SUPER by ordered gates.

    From passed, cash, profit_risk, val_status, composite, min_score, the mode's GATES, whale, momentum, technical, rsi,
    bias, uptrend, inflow, dual_buy, participation, blowoff, rescue, washout, bubble, revenue_hot.
    """
    sound = c("passed") & (c("cash") != "high_risk") & ~c("profit_risk")
    hard = ~c("passed") | (c("cash") == "high_risk") | ((c("rsi") < 30) & (c("momentum") < 20))
    hot = (c("momentum") >= c("mom_hot")) | (c("technical") >= c("tech_hot")) | c("revenue_hot")
    ignited = c("inflow") & ((c("whale") >= c("whale_hot")) | c("dual_buy") | (c("participation") >= 40))
    top = sound & ~c("bubble") & c("uptrend") & hot & ignited & ~c("blowoff")
    dear = (c("val_status") == "dear") & (c("composite") < 50)
    quality = c("cash").isin("healthy", "watch") & ~c("profit_risk")
    value = quality & c("val_status").isin("cheap", "fair") & (c("whale") >= c("chip_min")) & (c("composite") >= c("min_score")) & (c("rsi") < c("rsi_extreme")) & (c("bias") <= c("bias_chase"))
    trend = quality & ~c("bubble") & c("uptrend") & c("inflow") & (c("whale") >= c("chip_min")) & ~c("blowoff") & (c("composite") >= c("min_score") - 5)
    spared = F.when(c("rescue"), "WATCH").otherwise("AVOID")
    value, trend = F.coalesce(value, F.lit(False)), F.coalesce(trend, F.lit(False))
    return F.when(hard, spared).when(top, "SUPER").when(dear, spared).when(c("washout"), "WATCH").when(value | trend, "STRONG").otherwise("WATCH")


def advice(c=F.col) -> Column:
    """The first of the rules that fits, as a word; from what `rating` reads, the rating, and change, spike, ma20, close, the days of buying and selling."""
    share = F.when(c("operating_share") > 1.5, c("operating_share") / 100).otherwise(c("operating_share"))
    leverage = (c("income_growth") > 0) & (c("income_growth") - c("revenue_growth") >= 25) & (share >= 0.8)
    priced = c("val_status").isin("cheap", "fair") & (c("whale") >= c("chip_min")) & (c("composite") >= c("min_score")) & (c("rsi") < c("rsi_extreme")) & (c("bias") <= c("bias_chase"))
    above = c("close") > c("ma20")
    return (
        F.when(~c("passed"), "fails_gates").when(c("cash") == "high_risk", "cash_alarm").when(c("profit_risk"), "doubtful_profit").when(c("washout"), "washout")
        .when(c("rating") == "SUPER", "ride_the_trend").when((c("rating") == "STRONG") & ~F.coalesce(priced, F.lit(False)), "follow_the_trend")
        .when(leverage & (c("rating") != "AVOID"), "operating_leverage").when((c("spike") > 2) & (c("change") > 3) & above & (c("bias") <= c("bias_chase")), "breakout")
        .when(c("rating").isin("STRONG", "WATCH") & ((c("rsi") >= c("rsi_overbought")) | (c("bias") > c("bias_chase"))), "overbought").when(c("val_status") == "dear", "dear")
        .when(c("rating") == "STRONG", "fair_buy").when((c("tsell") > 0) | (c("fsell") > 0), "selling").otherwise("mixed")
    )


def sector(override: Column, c=F.col) -> Column:
    """A (large, stable) or B (cyclical), by override, finance, size, then points of foreign share, volatility and industry."""
    size = F.when(c("market_cap") >= 1.0e11, "A").when(c("market_cap") < 3.0e10, "B").when(c("cyclical") | F.coalesce(c("atr_pct") >= 6, F.lit(False)), "B").otherwise("A")
    score = points((c("foreign_share") >= 35, 2), (c("foreign_share") >= 20, 1)) + points((c("atr_pct") < 3, 2), (c("atr_pct") < 4, 1), (c("atr_pct") >= 6, -2)) + points((c("stable"), 1), (c("cyclical"), -2))
    return F.coalesce(override, F.when(c("is_financial"), "A"), F.when(c("market_cap") > 0, size), F.when(score >= 2, "A").otherwise("B"))


def trade_plan(c=F.col) -> dict[str, Column]:
    """entry_low, entry_high, stop, target1, target2 (twice the risk), distance, in_zone, rr and note from close, atr, val, poc, vah, support, resistance, ma20; each uses those before it."""
    price, a = c("close"), c("atr")
    fresh = lambda x: F.when(c(x) >= price * 0.75, c(x))
    near = lambda x: F.when(x <= price * 1.02, x)
    high = F.coalesce(F.least(near(fresh("poc")), near(c("ma20"))), price - 0.5 * a)
    below = lambda x: F.when(fresh(x) < c("entry_high"), fresh(x))
    low = F.coalesce(F.greatest(below("val"), below("support")), c("entry_high") - 1.5 * a)
    stop = F.when(c("entry_low") - 1.5 * a > 0, c("entry_low") - 1.5 * a).otherwise(c("entry_low") * 0.95)
    target = F.greatest(F.coalesce(F.when(c("vah") > price, c("vah")), F.when(c("resistance") > price, c("resistance")), price + 2 * a), price + a)
    risk = c("entry_high") - c("stop")
    note = F.when(c("in_zone") & (c("distance") <= -3), "below_the_zone").when(c("in_zone"), "in_the_zone").when(c("distance") <= 4, "just_above").otherwise("too_high")
    return {
        "entry_high": high, "entry_low": low, "stop": stop, "target1": F.when(target <= c("entry_high"), c("entry_high") + 2 * a).otherwise(target), "target2": F.when(risk > 0, c("entry_high") + 2 * risk),
        "distance": (price - c("entry_high")) / c("entry_high") * 100, "in_zone": price <= c("entry_high") * 1.005, "rr": F.when(risk > 0, (c("target1") - c("entry_high")) / risk), "note": note,
    }
