"""Screening strategies: every rule is a column, so one pass scores all days at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, or_zero, tie_safe

k = F.col


@dataclass(frozen=True)
class Params:
    limit: int = 20
    min_score: float = 60.0
    min_amount_ma20: float = 150e6
    rsi_threshold: float = 25.0


def yes(*conds: Column) -> Column:
    """All hold; a null term fails."""
    out = F.lit(True)
    for c in conds:
        out = out & F.coalesce(c, F.lit(False))
    return out


def or_missing(c: Column) -> Column:
    """A null term passes."""
    return F.coalesce(c, F.lit(True))


def exclusion(p: Params) -> Column:
    """First reason against a row, else null."""
    required = ["adj_close", "ma20", "ma60", "ret_5", "ret_20", "amount_ma20"]
    missing = F.greatest(*[k(c).isNull().cast("int") for c in required]) == 1
    return (
        F.when(missing, "missing_required_factor")
        .when(k("amount_ma20") < p.min_amount_ma20, "insufficient_liquidity")
        .when(k("ret_5") >= 0.15, "overheated_ret_5")
        .when(k("rsi_14") >= 85, "extreme_rsi")
        .when(yes(k("atr_pct_14") >= 0.10) | yes(k("vol_20") >= 0.08), "excessive_volatility")
    )


def trend_up() -> Column:
    return yes(k("adj_close") > k("ma20"), k("ma20") > k("ma60"))


def candidate(name: str, p: Params) -> Column:
    """Candidate type of a row under a strategy, else null."""
    c, ma20, ma60 = k("adj_close"), k("ma20"), k("ma60")
    if name in ("trend_strength", "multi_factor"):
        breakout = yes(k("ret_20") > 0, k("pos_20") >= 0.85, k("dd_20") >= -0.03, k("vol_ratio_20") > 0)
        pullback = yes(ma20 > ma60, c >= ma20, k("ret_5") <= 0, k("ret_20") > 0, k("dd_20") >= -0.12)
        return F.when(breakout, "breakout_watch").when(trend_up() & yes(k("ret_20") > 0), "strong_trend").when(pullback, "pullback_watch")
    rules = {
        "low_vol_breakout": ("breakout_watch", [trend_up(), yes(k("pos_20") >= 0.85), or_missing(k("pos_60") >= 0.70), yes(k("dd_20") >= -0.03, k("vol_ratio_20") >= 0.12, k("vol_20") <= 0.045, k("atr_pct_14") <= 0.05, k("ret_20") > 0), or_missing(k("ret_5") <= 0.08), or_missing(k("rsi_14") < 78)]),
        "ma_pullback": ("pullback_watch", [yes(c >= 0.97 * ma20, c <= 1.03 * ma20, ma20 > ma60, k("ret_20") > 0.03), or_missing(k("ret_5") <= 0.03), yes(k("dd_20") >= -0.10), or_missing(k("rsi_14") < 72), or_missing(k("atr_pct_14") <= 0.06)]),
        "relative_strength": ("strong_trend", [trend_up(), yes(k("ret_20") >= 0.08, k("ret_60") >= 0.10), or_missing(k("pos_20") >= 0.65), or_missing(k("ret_5") <= 0.10)]),
        "volume_breakout": ("breakout_watch", [yes(c > ma20, k("pos_20") >= 0.85, k("dd_20") >= -0.03, k("vol_ratio_20") >= 0.25), or_missing(k("ret_5") > 0), or_missing(k("rsi_14") < 80), or_missing(k("vol_20") <= 0.06)]),
        "mean_reversion": ("oversold_rebound", [yes(k("rsi_14") < p.rsi_threshold, c < F.coalesce(k("bb_lower_20"), ma20 * (1 - 2 * k("std_pctchg_20"))), k("ret_20") < -0.15)]),
        "smart_money": ("smart_money", [yes(k("vol_ratio_5_60") > 2.5, k("price_vol_corr_20") > 0.6, k("atr_pct_14_pct_rank") > 0.8)]),
    }
    kind, terms = rules[name]
    all_ = terms[0]
    for t in terms[1:]:
        all_ = all_ & t
    return F.when(all_, kind)


NAMES = ["trend_strength", "low_vol_breakout", "ma_pullback", "relative_strength", "volume_breakout", "mean_reversion", "smart_money", "multi_factor"]
ACTIVE = {"trend_strength": 2.0, "low_vol_breakout": 2.0, "ma_pullback": 2.0, "relative_strength": 1.5, "volume_breakout": 1.0, "mean_reversion": 1.5, "smart_money": 1.0, "multi_factor": 2.0}


def tags(name: str, p: Params) -> Column:
    """Distinct tags in a fixed order."""
    c, ma20, ma60 = k("adj_close"), k("ma20"), k("ma60")
    expand = {"low_vol_breakout": 0.20, "volume_breakout": 0.25}.get(name, 0.10)
    found = F.array(
        F.when(yes(c > ma20, ma20 > ma60), "trend_strong"),
        F.when(yes(k("vol_ratio_20") > expand) if expand == 0.10 else yes(k("vol_ratio_20") >= expand), "volume_expansion"),
        F.when(yes(k("amount_ma20") >= ACTIVE[name] * p.min_amount_ma20), "active_amount"),
    )
    return F.array_compact(found)


def risk_flags(name: str) -> Column:
    mild = yes(k("atr_pct_14") >= 0.05) | yes(k("vol_20") >= 0.04)
    extra = []
    if name == "low_vol_breakout":
        extra = [F.when(yes(k("atr_pct_14") >= 0.04) | yes(k("vol_20") >= 0.035), "high_volatility")]
    if name == "volume_breakout":
        extra = [F.when(yes(k("vol_ratio_20") >= 0.75, k("ret_5") <= 0), "volume_climax")]
    return F.array_compact(
        F.array(
            F.when(k("rsi_14").isNull() | k("atr_pct_14").isNull() | k("vol_20").isNull(), "risk_factor_missing"),
            F.when(yes(k("ret_5") >= 0.08), "ret_5_strong"),
            F.when(yes(k("rsi_14") >= 75), "rsi_high"),
            F.when(mild, "mild_volatility"),
            *extra,
            F.when(yes(k("dd_20") >= -0.03), "near_20d_high"),
        )
    )


def components(name: str, p: Params) -> dict[str, Column]:
    """Score components by name, each rounded to two places."""
    c, ma20, ma60 = k("adj_close"), k("ma20"), k("ma60")
    flag = lambda *conds: F.when(yes(*conds), 1.0).otherwise(0.0)
    z = or_zero
    m = max(p.min_amount_ma20, 1.0)
    safe = F.try_divide
    every = {
        "trend": F.least(F.lit(35.0), 15 * flag(c > ma20) + 10 * flag(ma20 > ma60) + 10 * clamp(z("ret_20") / 0.20)),
        "liquidity": 20 * clamp(z("amount_ma20") / max(5 * p.min_amount_ma20, 1.0)),
        "position": 20 * clamp(z("pos_20")),
        "short_strength": 15 * clamp((z("ret_5") + 0.05) / 0.20),
        "breakout": 20 * clamp((z("pos_20") + z("pos_60")) / 1.8) + 10 * clamp(z("vol_ratio_20") / 0.5),
        "low_volatility": 20 * clamp(1 - F.greatest(z("vol_20"), z("atr_pct_14")) / 0.08),
        "pullback": 20 * F.when(z("ma20") == 0, 0.0).otherwise(clamp(1 - F.abs(safe(z("adj_close"), z("ma20")) - 1) / 0.05)) + 10 * clamp(F.greatest(F.lit(0.0), -z("dd_20")) / 0.08),
        "momentum": 18 * clamp(z("ret_20") / 0.18) + 12 * clamp(z("ret_60") / 0.25) + 8 * clamp(F.greatest(z("ret_5"), F.lit(0.0)) / 0.08),
        "volume": 20 * clamp(z("vol_ratio_20") / 0.5) + 10 * clamp((z("amount_ma20") / m - 1) / 2),
        "oversold": 25 * clamp((30 - F.coalesce(F.nullif(k("rsi_14"), F.lit(0.0)), F.lit(30.0))) / 10) + 15 * clamp(F.greatest(F.lit(0.0), -z("ret_20") - 0.15) / 0.15),
        "band_reclaim": 20 * clamp(F.greatest(F.lit(0.0), z("bb_lower_20") - z("adj_close")) / F.greatest(F.abs(F.coalesce(F.nullif(k("bb_lower_20"), F.lit(0.0)), F.nullif(c, F.lit(0.0)), F.lit(1.0))), F.lit(1.0))) + tie_safe(10 * clamp(1 - z("std_pctchg_20") / 0.05), 2),
        "smart_volume": 20 * clamp(z("vol_ratio_5_60") / 2.5) + 10 * clamp(z("price_vol_corr_20") / 0.6),
        "stability": 15 * clamp(z("atr_pct_14") / 0.05),
    }
    penalty = -1 * F.when(k("rsi_14").isNull() | k("atr_pct_14").isNull() | k("vol_20").isNull(), 1.0).otherwise(0.0)
    penalty = penalty - 4 * flag(k("ret_5") >= 0.08) - 4 * flag(k("rsi_14") >= 75) - 4 * F.when(yes(k("atr_pct_14") >= 0.05) | yes(k("vol_20") >= 0.04), 1.0).otherwise(0.0) - 2 * flag(k("dd_20") >= -0.03)
    extra = {
        "low_vol_breakout": -6 * F.when(yes(k("atr_pct_14") >= 0.04) | yes(k("vol_20") >= 0.035), 1.0).otherwise(0.0),
        "ma_pullback": -6 * flag(k("dd_20") < -0.12),
        "relative_strength": -4 * F.when((z("ret_60") < 0.10) | yes(k("ret_5") >= 0.10), 1.0).otherwise(0.0),
        "volume_breakout": -6 * flag(k("vol_ratio_20") < 0.25),
        "mean_reversion": 2 * flag(k("rsi_14") < 30),
        "smart_money": 2 * flag(k("price_vol_corr_20") > 0.6),
    }
    every["risk_penalty"] = F.greatest(F.lit(-30.0), penalty + extra.get(name, F.lit(0.0)))
    sets = {
        "trend_strength": ["trend", "liquidity", "position", "short_strength", "risk_penalty"],
        "low_vol_breakout": ["trend", "breakout", "low_volatility", "liquidity", "risk_penalty"],
        "ma_pullback": ["trend", "pullback", "liquidity", "short_strength", "risk_penalty"],
        "relative_strength": ["trend", "momentum", "position", "liquidity", "risk_penalty"],
        "volume_breakout": ["trend", "breakout", "volume", "liquidity", "risk_penalty"],
        "mean_reversion": ["trend", "oversold", "band_reclaim", "liquidity", "risk_penalty"],
        "smart_money": ["trend", "smart_volume", "stability", "liquidity", "risk_penalty"],
    }
    return {n: tie_safe(every[n], 2) for n in sets[name]}


WEIGHTS = {"momentum": 0.4, "volatility": -0.3, "liquidity": 0.3, "relative": 0.2, "trend": 0.1}


def multi_factor_components(w: dict[str, float] = WEIGHTS) -> dict[str, Column]:
    """Weighted percentile ranks, six places each; the total is scaled to 100."""
    trend = F.when(yes(k("adj_close") > k("ma20"), k("ma20") > k("ma60")), 1.0).when(yes(k("adj_close") > k("ma20")), 0.5).otherwise(0.0)
    parts = {"momentum": or_zero("pct_rank_ret_20"), "volatility": 1 - or_zero("vol_20_pct_rank"), "liquidity": or_zero("amount_ma20_pct_rank"), "relative": or_zero("rs_score"), "trend": trend}
    return {n: tie_safe(w[n] * c, 6) for n, c in parts.items()}


def scored(f: DataFrame, name: str, p: Params = Params()) -> DataFrame:
    """Rows of f with reason, candidate_type, tags, risk_flags, score_breakdown and score."""
    parts = multi_factor_components() if name == "multi_factor" else components(name, p)
    total = sum((c for c in parts.values()), F.lit(0.0))
    total = clamp(total * 100 if name == "multi_factor" else total, 0.0, 100.0)
    breakdown = F.map_from_arrays(F.array(*[F.lit(n) for n in parts]), F.array(*parts.values()))
    return f.withColumns({"reason": exclusion(p), "candidate_type": candidate(name, p), "tags": tags(name, p), "risk_flags": risk_flags(name), "score_breakdown": breakdown, "score": tie_safe(total, 2)}).withColumn(
        "status", F.when(k("reason").isNotNull(), "excluded").when(k("candidate_type").isNull(), "unclassified_filtered").when(k("score") < p.min_score, "low_score_filtered").otherwise("picked")
    )


def picks(f: DataFrame, name: str, p: Params = Params()) -> DataFrame:
    """The best rows of every day, ranked."""
    day = Window.partitionBy("trade_date").orderBy(k("score").desc(), k("amount_ma20").desc_nulls_last(), "market", "symbol")
    x = scored(f, name, p).where("status = 'picked'").withColumn("rank", F.row_number().over(day).cast("long"))
    return x.where(k("rank") <= p.limit).withColumns({"strategy": F.lit(name), "priority_weight": tie_safe(k("score") / 100, 4)})


def all_picks(f: DataFrame, names: list[str], p: Params = Params()) -> DataFrame:
    """The picks of several strategies from one pass over f: (trade_date, market, symbol, amount_ma20, risk_score, strategy, score, risk_flags, rank)."""
    reason = exclusion(p)

    def verdict(name: str) -> Column:
        parts = multi_factor_components() if name == "multi_factor" else components(name, p)
        total = sum((c for c in parts.values()), F.lit(0.0))
        score = tie_safe(clamp(total * 100 if name == "multi_factor" else total, 0.0, 100.0), 2)
        kept = reason.isNull() & candidate(name, p).isNotNull() & (score >= p.min_score)
        return F.when(kept, F.struct(F.lit(name).alias("strategy"), score.alias("score"), risk_flags(name).alias("risk_flags")))

    x = f.select("trade_date", "market", "symbol", "amount_ma20", "risk_score", F.explode(F.array_compact(F.array(*[verdict(n) for n in names]))).alias("v")).select("trade_date", "market", "symbol", "amount_ma20", "risk_score", "v.*")
    w = Window.partitionBy("trade_date", "strategy").orderBy(k("score").desc(), k("amount_ma20").desc_nulls_last(), "market", "symbol")
    return x.withColumn("rank", F.row_number().over(w).cast("long")).where(k("rank") <= p.limit)


#: Reasons of exclusion, in their order.
REASONS = ["missing_required_factor", "insufficient_liquidity", "overheated_ret_5", "extreme_rsi", "excessive_volatility"]


def summary(f: DataFrame, name: str, p: Params = Params()) -> DataFrame:
    """By day: rows, and how many were excluded (by reason), unclassified, scored low and picked."""
    s = scored(f, name, p)
    reasons = REASONS
    return s.groupBy("trade_date").agg(F.count("*").alias("universe"), *[F.count_if(k("reason") == r).alias(r) for r in reasons], *[F.count_if(k("status") == x).alias(x) for x in ("unclassified_filtered", "low_score_filtered", "picked")])


def explain(f: DataFrame, name: str, market: str, symbol: str, p: Params = Params()) -> DataFrame:
    """One instrument's every day: status, reason, type, score."""
    return scored(f, name, p).where((k("market") == market) & (k("symbol") == symbol))


def pairs(f: DataFrame, symbols: list[str], lookback: int = 60, min_abs_z: float = 2.0, max_pairs: int = 10) -> DataFrame:
    """Pair arbitrage inside a market: legs of the pairs of a bounded pool whose price ratio is far from its rolling mean, by day.

    A positive z shorts the first symbol and buys the second. The pool is a list, so the self-join is bounded by its square a day.
    """
    pool = f.where(k("symbol").isin(symbols)).select("market", "trade_date", "symbol", "adj_close")
    both = pool.alias("a").join(pool.alias("b"), ["market", "trade_date"]).where(k("a.symbol") < k("b.symbol")).select("market", "trade_date", k("a.symbol").alias("first"), k("b.symbol").alias("second"), F.try_divide(k("a.adj_close"), k("b.adj_close")).alias("r"))
    w = Window.partitionBy("market", "first", "second").orderBy("trade_date").rowsBetween(1 - lookback, 0)
    z = both.withColumns({"mean": F.avg("r").over(w), "sd": F.stddev_samp("r").over(w), "n": F.count("r").over(w)}).withColumn("z", tie_safe(F.try_divide(k("r") - k("mean"), k("sd")), 4))
    far = z.where((k("n") >= lookback) & (F.abs("z") >= min_abs_z))
    day = Window.partitionBy("trade_date").orderBy(F.abs("z").desc(), "first", "second", "market")
    top = far.withColumn("i", F.row_number().over(day).cast("long")).where(k("i") <= max_pairs)
    over = k("z") > 0
    leg = lambda sym, peer, side, i: F.struct(sym.alias("symbol"), peer.alias("peer"), side.alias("direction"), i.alias("rank"))
    short, long = F.when(over, k("first")).otherwise(k("second")), F.when(over, k("second")).otherwise(k("first"))
    legs = F.array(leg(short, long, F.lit("SHORT"), 2 * k("i") - 1), leg(long, short, F.lit("LONG"), 2 * k("i")))
    return top.select("market", "trade_date", "z", tie_safe(10 * F.abs("z"), 2).alias("score"), F.explode(legs).alias("leg")).select("market", "trade_date", "leg.*", "z", "score")


#: Kinds of strategies, for consensus of different kinds.
KINDS = {"trend_strength": "trend", "low_vol_breakout": "breakout", "volume_breakout": "breakout", "ma_pullback": "pullback", "relative_strength": "momentum", "mean_reversion": "reversal", "smart_money": "volume", "multi_factor": "factor"}


def consensus(all_picks: DataFrame, min_hit: int = 2, method: str = "simple_majority", different_kinds: bool = False, weights: dict[str, float] | None = None, decay_half_life: float | None = None, decay_min: float = 0.10) -> DataFrame:
    """Instruments that several strategies picked on a day.

    method "rank_sum" adds 5 ln(hit + 1) to the mean score; "weighted_by_performance" sums scores by the strategies' weights
    over the hits. A half-life in days multiplies scores by 0.5 ** (1 / half-life), decay_min at least. different_kinds
    asks for min_hit kinds of strategies (KINDS).
    """
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    factor = max(decay_min, 0.5 ** (1 / max(0.5, decay_half_life))) if decay_half_life else 1.0
    weight = F.coalesce(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[k("strategy")], F.lit(1.0)) if weights else F.lit(1.0)
    # Scores have two places: their sums are taken in whole hundredths, the same in any order.
    cents = F.round(k("score") * 100).cast("long")
    g = all_picks.withColumn("kind", F.coalesce(kinds[k("strategy")], F.lit("other"))).groupBy("trade_date", "market", "symbol").agg(
        F.countDistinct("strategy").alias("hit"), F.countDistinct("kind").alias("kinds"), (F.sum(cents) / F.count("score") / 100 * factor).alias("a"), (F.max("score") * factor).alias("m"), F.sum(cents * weight).alias("weighted"),
        F.avg(tie_safe("risk_score", 9)).alias("risk"), F.array_join(F.array_sort(F.collect_set("strategy")), ",").alias("strategies"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("risk_flags")))).alias("flags"),
    )
    g = g.where(k("hit") >= min_hit)
    if different_kinds:
        g = g.where(k("kinds") >= min_hit)
    avg = tie_safe(k("weighted") / k("hit") / 100, 2) if method == "weighted_by_performance" else tie_safe("a", 2)
    if method == "rank_sum":
        avg = tie_safe(avg + 5 * F.log(k("hit") + 1), 2)
    x = g.select("trade_date", "market", "symbol", "hit", avg.alias("avg_score"), tie_safe("m", 2).alias("max_score"), tie_safe("risk", 4).alias("risk_score"), "strategies", F.size("flags").cast("long").alias("n_flags"))
    day = Window.partitionBy("trade_date").orderBy(k("hit").desc(), k("avg_score").desc(), k("max_score").desc(), "n_flags", "symbol", "market")
    return x.withColumn("rank", F.row_number().over(day).cast("long"))


def compare(all_picks: DataFrame) -> DataFrame:
    """By strategy: picks, mean and best score, strong ones, distinct risk flags."""
    flags = all_picks.select("strategy", F.explode("risk_flags").alias("flag")).groupBy("strategy").agg(F.countDistinct("flag").alias("n_flags"))
    g = all_picks.groupBy("strategy").agg(F.count("*").alias("picks"), tie_safe(F.sum(F.round(k("score") * 100).cast("long")) / F.count("score") / 100, 2).alias("avg_score"), tie_safe(F.max("score"), 2).alias("max_score"), F.count_if(k("score") >= 80).alias("strong"), F.countDistinct("market", "symbol").alias("symbols"))
    return g.join(flags, "strategy", "left").withColumn("n_flags", F.coalesce("n_flags", F.lit(0).cast("long")))


def overlap(all_picks: DataFrame) -> DataFrame:
    """Pairs of strategies with the number of picks they share."""
    x = all_picks.select("strategy", "market", "symbol", "trade_date")
    y = x.withColumnRenamed("strategy", "other")
    return x.join(y, ["market", "symbol", "trade_date"]).where("strategy < other").groupBy("strategy", "other").agg(F.count("*").alias("shared"))


#: Rule, names its input may have, and the side of the threshold on which a row is filtered out.
PRE_FILTER = (
    ("min_listing_days", ("listing_days", "listed_days"), "<"),
    ("min_price", ("close", "price"), "<"),
    ("max_price", ("close", "price"), ">"),
    ("min_amount_ma20", ("amount_ma20",), "<"),
    ("min_turnover", ("turnover_ma20", "turnover"), "<"),
    ("max_volatility", ("annual_volatility", "annualized_volatility"), ">"),
    ("max_drawdown", ("max_drawdown_1y", "max_drawdown"), ">"),
    ("min_trading_days", ("trading_days",), "<"),
    ("max_financial_data_age_months", ("financial_data_age_months",), ">"),
)
PRE_FILTER_SECTIONS = {"basic": ("exclude_st", "exclude_delisting_risk", "min_listing_days", "min_price", "max_price"), "liquidity": ("min_amount_ma20", "min_turnover"), "risk": ("max_volatility", "max_drawdown"), "data_quality": ("min_trading_days", "max_financial_data_age_months", "required_fields")}
PRE_FILTER_OLD_NAMES = {"min_listing_days": "min_listed_days", "min_turnover": "min_turnover_ma20", "max_volatility": "max_annualized_volatility", "max_drawdown": "max_drawdown_1y"}


def pre_filter_config(config: dict) -> dict:
    """A flat configuration from a flat or a sectioned one; a section's own value comes first."""
    out = {}
    for section, names in PRE_FILTER_SECTIONS.items():
        own = config.get(section) if isinstance(config.get(section), dict) else {}
        for n in names:
            out[n] = own.get(n, config.get(n, config.get(PRE_FILTER_OLD_NAMES.get(n, n))))
    return out


def pre_filter(f: DataFrame, config: dict | None = None) -> DataFrame:
    """f with `broken`, the rules that a row breaks as (rule, actual, threshold); a null input, or a column that f lacks, skips its rule.

    ST and delisting rows go unless switched off; tags, risk_flags, is_st, delisting_risk and data_quality_insufficient
    are read where f has them; required_fields names columns that may be neither null nor empty.
    """
    cfg = pre_filter_config(config or {})
    has = lambda *names: next((k(n) for n in names if n in f.columns), None)
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    hit = lambda rule, when, actual, threshold: F.when(yes(when), F.struct(F.lit(rule).alias("rule"), text(actual).alias("actual"), F.lit(str(threshold)).alias("threshold")))
    broken = []
    if cfg["exclude_st"] is None or cfg["exclude_st"]:
        tagged = [F.array_contains(n, "st") for n in ("tags", "risk_flags") if n in f.columns]
        marked = [F.coalesce(k("is_st").cast("boolean"), F.lit(False))] if "is_st" in f.columns else []
        if tagged or marked:
            st = F.lit(False)
            for c in [*tagged, *marked]:
                st = st | F.coalesce(c, F.lit(False))
            broken.append(hit("exclude_st", st, has("is_st"), False))
    delisting = has("delisting_risk", "delist_risk")
    if delisting is not None and (cfg["exclude_delisting_risk"] is None or cfg["exclude_delisting_risk"]):
        broken.append(hit("exclude_delisting_risk", delisting.cast("boolean"), delisting, False))
    for rule, names, op in PRE_FILTER:
        value, limit = has(*names), cfg[rule]
        if value is None or limit is None:
            continue
        number = value.cast("double")
        number = F.abs(number) if rule == "max_drawdown" else number
        broken.append(hit(rule, number < float(limit) if op == "<" else number > float(limit), value, float(limit)))
    poor = has("data_quality_insufficient")
    if poor is not None:
        broken.append(hit("data_quality", poor.cast("boolean"), poor, False))
    if cfg["required_fields"]:
        missing = F.array_compact(F.array(*[F.when(F.coalesce(k(n).cast("string"), F.lit("")) == "", F.lit(n)) if n in f.columns else F.lit(n) for n in cfg["required_fields"]]))
        broken.append(hit("required_fields", F.size(missing) > 0, F.array_join(missing, ","), "non-empty"))
    every = F.array(*broken) if broken else F.array().cast("array<struct<rule:string,actual:string,threshold:string>>")
    return f.withColumn("broken", F.array_compact(every))


def excluded(f: DataFrame, name: str, p: Params = Params(), most: int = 20) -> DataFrame:
    """The first excluded instruments of each day: by order of reasons, score, daily amount, market, symbol."""
    place = F.array_position(F.array(*[F.lit(r) for r in REASONS]), k("reason"))
    w = Window.partitionBy("trade_date").orderBy(place, k("score").desc_nulls_last(), k("amount_ma20").desc_nulls_last(), "market", "symbol")
    return scored(f, name, p).where(k("status") == "excluded").withColumn("place", F.row_number().over(w).cast("long")).where(k("place") <= most)


def label_counts(picks: DataFrame) -> DataFrame:
    """By day: how often each candidate type, tag and risk flag occurs."""
    labels = F.concat(
        F.array(F.struct(F.lit("candidate_type").alias("kind"), k("candidate_type").alias("label"))),
        F.transform("tags", lambda x: F.struct(F.lit("tag").alias("kind"), x.alias("label"))),
        F.transform("risk_flags", lambda x: F.struct(F.lit("risk_flag").alias("kind"), x.alias("label"))),
    )
    return picks.select("trade_date", F.explode(labels).alias("x")).where("x.label is not null").groupBy("trade_date", "x.kind", "x.label").agg(F.count("*").alias("n"))


def unique_picks(all_picks: DataFrame) -> DataFrame:
    """By strategy: picks that no other strategy made on that day."""
    g = all_picks.groupBy("trade_date", "market", "symbol").agg(F.min("strategy").alias("strategy"), F.countDistinct("strategy").alias("n"))
    return g.where("n = 1").groupBy("strategy").agg(F.count("*").alias("own_picks"))
