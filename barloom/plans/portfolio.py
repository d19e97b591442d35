"""Portfolios from picks: weights, caps, exposures, risk checks, rebalancing, costs, slices, market regime, alerts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import tie_safe

k = F.col

def day() -> WindowSpec:
    return Window.partitionBy("trade_date")


def share(c: Column) -> Column:
    """c over its day's sum; equal parts where that is 0."""
    total = F.sum(c).over(day())
    return F.when(total > 0, c / total).otherwise(1 / F.count("*").over(day()))


METHODS = ("equal", "score", "risk", "liquidity", "hybrid")


def weights(picks: DataFrame, method: str) -> DataFrame:
    """picks (trade_date, market, symbol, score, risk_score, amount_ma20) with weight: each day's sum to 1."""
    score, calm = F.coalesce("score", F.lit(0.0)), 1 - F.coalesce("risk_score", F.lit(0.0))
    adv = F.greatest(F.coalesce("amount_ma20", F.lit(0.0)), F.lit(1.0))
    bases = {"equal": F.lit(1.0), "score": score, "risk": score * calm, "liquidity": score * calm * adv}
    if method == "hybrid":
        value = 0.4 * share(score) + 0.3 * share(calm) + 0.2 * share(adv) + 0.1 * share(F.lit(1.0))
        return picks.withColumn("v", value).withColumn("weight", share(k("v"))).drop("v")
    return picks.withColumn("weight", share(bases[method]))


def constrained(w: np.ndarray, adv: np.ndarray, max_weight: float, min_weight: float, liquidity: tuple[float, float, float] | None) -> np.ndarray:
    """One portfolio's weights after floors, liquidity caps, a cap whose excess goes to the uncapped, and normalising."""
    w = w.astype(float).copy()
    if min_weight > 0 and (w >= min_weight).any():
        w[w < min_weight] = 0.0
    if liquidity and liquidity[0] > 0:
        capital, part, days = liquidity
        # An instrument without a daily amount has no liquidity cap.
        cap = np.where(np.nan_to_num(adv) > 0, np.nan_to_num(adv) * part * days / capital, np.inf)
        w = np.minimum(w, cap)
    if w.sum() <= 0:
        w[:] = 1 / len(w)
    capped = np.zeros(len(w), bool)
    for _ in range(len(w) if max_weight > 0 else 0):
        over = (w > max_weight + 1e-12) & ~capped
        if not over.any():
            break
        excess = (w[over] - max_weight).sum()
        w[over] = max_weight
        capped |= over
        free = ~capped & (w > 0)
        if not free.any():
            break
        w[free] += excess * w[free] / w[free].sum()
    return (w / w.sum()).round(12)


def base_weights(score: np.ndarray, calm: np.ndarray, adv: np.ndarray, method: str) -> np.ndarray:
    """Weights of one portfolio by one of METHODS, before constraints; as :func:`weights`."""
    part = lambda x: x / x.sum() if x.sum() > 0 else np.full(len(x), 1 / len(x))
    if method == "hybrid":
        return part(0.4 * part(score) + 0.3 * part(calm) + 0.2 * part(adv) + 0.1 / len(score))
    return part({"equal": np.ones(len(score)), "score": score, "risk": score * calm, "liquidity": score * calm * adv}[method])


def cap_and_redistribute(weighted: DataFrame, max_weight: float = 0.1, min_weight: float = 0.005, liquidity: tuple[float, float, float] | None = (1e7, 0.1, 3.0)) -> DataFrame:
    """weight after floors, liquidity caps (capital, participation, days) and a cap whose excess goes to the uncapped.

    A portfolio of a day is a group: at most the picks' limit of rows. Weights below min_weight go unless all would;
    the rest is normalised to 1, which may leave weights over the cap where n * max_weight < 1.
    """
    kinds = weighted.schema

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["market", "symbol"]).copy()
        g["weight"] = constrained(g["weight"].to_numpy(float), g["amount_ma20"].to_numpy(float), max_weight, min_weight, liquidity)
        return g[kinds.names]

    return weighted.groupBy("trade_date").applyInPandas(run, kinds)


NEAR_HIGH = "near_20d_high"


def trim_near_high(picks: DataFrame, method: str, most: float = 0.40, max_weight: float = 0.1, min_weight: float = 0.0, liquidity: tuple[float, float, float] | None = (1e7, 0.1, 3.0)) -> DataFrame:
    """picks with weight, or null where a pick near its 20-day high was dropped: while such picks weigh more than `most`, the
    one of lowest score goes and the rest is weighted anew. A group is one day's portfolio.

    The loop runs over arrays, and days are dealt over twice the session's partitions: picks are few bytes, which adaptive
    execution would hand to one task, however long their loops take."""
    kinds = picks.withColumn("weight", F.lit(None).cast("double")).schema
    partitions = 2 * int(picks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["market", "symbol"]).reset_index(drop=True)
        near = np.array([NEAR_HIGH in (x if x is not None else []) for x in g["risk_flags"]], bool)
        score, calm = g["score"].fillna(0.0).to_numpy(float), 1 - g["risk_score"].fillna(0.0).to_numpy(float)
        amount = g["amount_ma20"].to_numpy(float)
        adv = np.maximum(g["amount_ma20"].fillna(0.0).to_numpy(float), 1.0)
        weight = np.full(len(g), np.nan)
        kept = np.arange(len(g))
        while len(kept):
            w = constrained(base_weights(score[kept], calm[kept], adv[kept], method), amount[kept], max_weight, min_weight, liquidity)
            at_high = near[kept]
            if w[at_high].sum() <= most or not at_high.any():
                weight[kept] = w
                break
            over = np.flatnonzero(at_high)
            kept = np.delete(kept, over[score[kept[over]].argmin()])
        return g.assign(weight=weight)[kinds.names]

    return picks.repartition(partitions, "trade_date").groupBy("trade_date").applyInPandas(run, kinds)


def exposure(weighted: DataFrame, sector: str = "market") -> DataFrame:
    return weighted.groupBy("trade_date", k(sector).alias("sector")).agg(tie_safe(F.sum("weight"), 6).alias("weight"), F.count("*").alias("n"), tie_safe(F.sum(F.when(F.array_contains("risk_flags", "near_20d_high"), k("weight")).otherwise(0.0)), 6).alias("near_high_weight"))


def risk_check(weighted: DataFrame, min_n: int = 1, max_weight: float = 0.10, low_liquidity: float = 50e6, max_tags: int = 0, max_risk: float = 0.7, max_market: float = 0.75) -> DataFrame:
    """By day: counts and sums with violations and warnings as one string each."""
    missing = F.array_contains("risk_flags", "risk_factor_missing")
    illiquid = F.when(k("amount_ma20").isNull(), missing).otherwise(k("amount_ma20") < low_liquidity)
    keyless = (F.coalesce("market", F.lit("")) == "") | (F.coalesce("symbol", F.lit("")) == "")
    markets = weighted.groupBy("trade_date", "market").agg(F.sum("weight").alias("m")).groupBy("trade_date").agg(F.max("m").alias("m"))
    x = weighted.groupBy("trade_date").agg(
        F.count("*").alias("n"), F.sum("weight").alias("s"), F.max("weight").alias("w"), F.sum(F.size("risk_flags")).alias("flags"),
        F.count_if(illiquid).alias("illiquid"), F.avg("risk_score").alias("risk"), F.count_if(keyless).alias("keyless"),
    ).join(markets, "trade_date")
    text = lambda *c: F.array_join(F.array_compact(F.array(*c)), ",")
    violations = text(F.when(k("n") < min_n, "too_few_holdings"), F.when(k("w") > max_weight + 1e-12, "weight_above_max"), F.when(k("keyless") > 0, "missing_key"))
    warnings = text(
        F.when((k("s") != 0) & (F.abs(k("s") - 1) > 0.02), "weights_off_one"), F.when(k("m") > max_market, "market_exposure"), F.when((k("flags") > max_tags) & F.lit(max_tags >= 0), "risk_tags"),
        F.when(tie_safe("risk", 6) > max_risk, "high_average_risk"), F.when(k("illiquid") > 0, "low_liquidity"),
    )
    return x.select("trade_date", "n", tie_safe("w", 6).alias("max_weight"), tie_safe("m", 6).alias("max_market"), "flags", "illiquid", violations.alias("violations"), warnings.alias("warnings"), (violations == "").alias("passed"))


def rebalance(weighted: DataFrame, tolerance: float = 1e-6, paused: Column | None = None) -> DataFrame:
    """Orders from each day's portfolio to the next one's: BUY, SELL, HOLD, INCREASE, REDUCE, or HOLD_CASH for purchases while paused."""
    days = weighted.select("trade_date").distinct().withColumn("next_date", F.lead("trade_date").over(Window.orderBy("trade_date"))).where("next_date is not null")
    now = weighted.select("trade_date", "market", "symbol", k("weight").alias("current"), k("amount_ma20").alias("adv_now")).join(days, "trade_date").select(k("next_date").alias("trade_date"), "market", "symbol", "current", "adv_now")
    target = weighted.join(days.select(k("next_date").alias("trade_date")), "trade_date", "left_semi").select("trade_date", "market", "symbol", k("weight").alias("target"), "amount_ma20")
    x = now.join(target, ["trade_date", "market", "symbol"], "full_outer").withColumns({"current": F.coalesce("current", F.lit(0.0)), "target": F.coalesce("target", F.lit(0.0)), "adv": F.coalesce("amount_ma20", "adv_now")})
    delta = k("target") - k("current")
    action = F.when(F.abs(delta) <= tolerance, "HOLD").when(k("current") == 0, "BUY").when(k("target") == 0, "SELL").when(delta > 0, "INCREASE").otherwise("REDUCE")
    out = x.select("trade_date", "market", "symbol", "current", "target", delta.alias("delta"), "adv", action.alias("action"))
    if paused is None:
        return out
    # A purchase that a pause stops leaves the weight where it is.
    held = paused & k("action").isin("BUY", "INCREASE")
    return out.select("trade_date", "market", "symbol", "current", F.when(held, k("current")).otherwise(k("target")).alias("target"), F.when(held, 0.0).otherwise(k("delta")).alias("delta"), "adv", F.when(held, "HOLD_CASH").otherwise(k("action")).alias("action"))


def turnover(plan: DataFrame) -> DataFrame:
    """By day: orders, half the absolute changes, its impact in basis points, and whether to trade in batches."""
    t = plan.groupBy("trade_date").agg(F.count_if(k("action") != "HOLD").alias("orders"), (F.sum(F.abs("delta")) / 2).alias("t"))
    return t.select("trade_date", "orders", tie_safe("t", 6).alias("turnover"), tie_safe(k("t") * 50, 4).alias("impact_bps"), (k("orders") > 50).alias("batched"))


def trade_costs(plan: DataFrame, capital: float = 1e7, fee_bps: float = 3.0) -> DataFrame:
    """Cost level and basis points by an order's share of the daily amount."""
    part = F.try_divide(F.abs("delta") * capital, k("adv"))
    level = F.when(part.isNull(), "unknown").when(part >= 0.10, "critical").when(part >= 0.05, "high").when(part >= 0.01, "medium").otherwise("low")
    slip = F.when(level == "critical", 50.0).when(level == "high", 20.0).when(level == "medium", 10.0).otherwise(5.0)
    return plan.where("action <> 'HOLD'").select("trade_date", "market", "symbol", "action", tie_safe(part, 8).alias("adv_share"), level.alias("cost_level"), (F.lit(fee_bps) + slip).alias("cost_bps"))


def slices(plan: DataFrame, n: int = 4, capital: float = 1e7) -> DataFrame:
    """Equal slices of each order in time, with their estimated impact."""
    part = F.coalesce(F.try_divide(F.abs("delta") * capital, k("adv")), F.lit(0.0))
    x = plan.where("action not in ('HOLD', 'HOLD_CASH')").select("trade_date", "market", "symbol", "action", "delta", part.alias("part"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("slice"))
    return x.select("trade_date", "market", "symbol", "action", "slice", tie_safe(k("delta") * capital / n, 2).alias("amount"), tie_safe(8 * (1 + 2 * k("part") / n), 4).alias("impact_bps"))


#: Extra basis points by cost level, and levels whose orders are refused, where no others are given.
PIECEWISE = {"medium": (5.0, False), "high": (15.0, False), "critical": (40.0, True)}


def execution_orders(plan: DataFrame, method: str = "TWAP", slices: int | None = None, participation: float = 0.1, piecewise: dict[str, tuple[float, bool]] | None = None, capital: float = 1e7, base_bps: float = 8.0) -> DataFrame:
    """(trade_date, market, symbol, action, method, slice, delta, adv_share, cost_level, impact_bps, reject): orders cut into slices.

    TWAP and PoV cut into 4 slices; where 0 are asked for, PoV takes 6 up to a tenth of the daily amount, else 4. Any other
    method trades at once. Without piecewise levels add nothing; with them each level adds its basis points and may be refused.
    """
    kind = "PoV" if method.lower() == "pov" else method.upper()
    usual = 4 if kind in ("TWAP", "PoV") else 1
    n = usual if slices is None else slices
    if n <= 0:
        n = (6 if participation <= 0.1 else 4) if kind == "PoV" else usual
    share = F.coalesce(F.try_divide(F.abs("delta") * capital, k("adv")), F.lit(0.0))
    level = F.when(share >= 0.10, "critical").when(share >= 0.05, "high").when(share >= 0.01, "medium").otherwise("low")
    bump = lambda i, default: F.coalesce(*[F.when(k("cost_level") == name, F.lit(v[i])) for name, v in piecewise.items()], F.lit(default)) if piecewise else F.lit(default)
    x = plan.where("action not in ('HOLD', 'HOLD_CASH')").withColumns({"adv_share": share, "cost_level": level}).withColumn("slice", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return x.select("trade_date", "market", "symbol", "action", F.lit(kind).alias("method"), "slice", tie_safe(k("delta") / n, 8).alias("delta"), tie_safe("adv_share", 8).alias("adv_share"), "cost_level", tie_safe(base_bps * (1 + 2 * k("adv_share")) + bump(0, 0.0), 4).alias("impact_bps"), bump(1, False).alias("reject"))


def execution_summary(orders: DataFrame) -> DataFrame:
    """By day: slices, refused ones, mean impact (of whole ten-thousandths, rounded at the half), and whether to trade in batches."""
    total, n = F.sum(F.round(k("impact_bps") * 10_000).cast("long")), F.count("*")
    x = orders.groupBy("trade_date").agg(n.alias("slices"), F.count_if("reject").alias("rejected"), total.alias("total"))
    return x.select("trade_date", "slices", "rejected", (F.expr("(2 * total + slices) div (2 * slices)") / 10_000.0).alias("impact_bps"), (k("slices") > 1).alias("batched"))


def liquidity(weighted: DataFrame, capital: float = 1e7, participation: float = 0.1, most_days: float = 3.0) -> DataFrame:
    """(trade_date, market, symbol, weight, target_amount, adv_share, days_to_sell, weight_cap, status): how long a holding takes to sell.

    A holding may be `participation` of the daily amount a day; without an amount, or without capital, nothing is known.
    """
    adv = F.when((k("amount_ma20") > 0) & F.lit(capital > 0), k("amount_ma20"))
    days = k("weight") * capital / F.greatest(adv * participation, F.lit(1.0))
    days = F.when(adv.isNotNull(), days)
    status = F.when(days.isNull(), "no_adv_data").when(days <= most_days, "pass").otherwise("exceeds_liquidation_days")
    return weighted.select("trade_date", "market", "symbol", tie_safe("weight", 8).alias("weight"), tie_safe(F.when(adv.isNotNull(), k("weight") * capital), 2).alias("target_amount"), tie_safe(k("weight") * capital / adv, 6).alias("adv_share"), tie_safe(days, 4).alias("days_to_sell"), tie_safe(adv * participation * most_days / capital, 6).alias("weight_cap"), status.alias("status"))


def breadth(f: DataFrame) -> DataFrame:
    return f.where("pc is not null").groupBy("trade_date").agg(F.count("*").alias("n"), tie_safe(F.avg((k("c") > k("pc")).cast("double")), 6).alias("breadth"))


def regime(b: DataFrame) -> DataFrame:
    """Bull, bear or neutral by breadth, and what it allows."""
    name = F.when(k("breadth") >= 0.6, "bull").when(k("breadth") <= 0.4, "bear").otherwise("neutral")
    return b.select("trade_date", "breadth", name.alias("regime"), F.when(name == "bull", "allow_open").when(name == "bear", "pause_open").otherwise("reduce_position").alias("action"))


def index_state(f: DataFrame, symbols: list[str]) -> DataFrame:
    """Close against its means, by index symbol and day."""
    x = f.where(k("symbol").isin(symbols))
    return x.select("market", "symbol", "trade_date", tie_safe("c", 6).alias("close"), tie_safe("ma20", 6).alias("ma20"), tie_safe("ma60", 6).alias("ma60"), ((k("c") > k("ma20")) & (k("ma20") > k("ma60"))).alias("trend_up"))


def alerts(events: DataFrame, channels: list[str]) -> DataFrame:
    """One row for each event (trade_date, event_type, detail) and channel: warnings everywhere, the rest in the log alone."""
    severe = k("event_type").isin("weight_above_max", "too_few_holdings", "pause_open")
    to = F.when(severe, F.array(*[F.lit(c) for c in channels])).otherwise(F.array(F.lit("log")))
    return events.select("trade_date", "event_type", "detail", F.when(severe, "warning").otherwise("info").alias("severity"), F.explode(to).alias("channel"))
