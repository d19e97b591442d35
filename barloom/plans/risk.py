"""Gates between candidates and a portfolio: filters, events, conditions, controls, scenarios. Nothing is dropped without a reason."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

k = F.col
EXCLUDED_TAGS = ("high_volatility", "low_liquidity")


def labels() -> Column:
    return F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("risk_flags", F.array().cast("array<string>")))


def intercept(candidates: DataFrame, market: str | None = None, tags: tuple[str, ...] = EXCLUDED_TAGS, max_risk: float | None = None) -> DataFrame:
    """candidates with `reason` (null: kept) and `trigger_tags`: another market, an excluded tag, a risk score over the bound."""
    hit = F.array_sort(F.array_intersect(labels(), F.array(*[F.lit(t) for t in tags]).cast("array<string>")))
    other = F.lower("market") != market.lower() if market else F.lit(False)
    risky = F.coalesce(k("risk_score") > max_risk, F.lit(False)) if max_risk is not None else F.lit(False)
    reason = F.when(other, "market").when(F.size(hit) > 0, "excluded_tag").when(risky, "risk_score")
    return candidates.withColumns({"reason": reason, "trigger_tags": F.when(reason == "excluded_tag", hit).otherwise(F.array().cast("array<string>"))})


def event_gate(candidates: DataFrame, windows: dict[str, tuple[int, int]] | None = None, off: tuple[str, ...] = (), action: str = "postpone", factor: float = 0.5) -> DataFrame:
    """candidates (event_type, event_date, as_of) with event_action and weight_factor.

    ignore without an event, for kinds switched off, and outside the kind's window of days around the event; where a window
    or a date is missing the event counts. Else `action`: postpone, reject, or reduce_weight by `factor`.
    """
    inside = F.lit(True)
    for kind, (a, b) in (windows or {}).items():
        days = F.datediff("as_of", "event_date")
        inside = F.when(k("event_type") == kind, F.coalesce((days >= a) & (days <= b), F.lit(True))).otherwise(inside)
    none = F.coalesce(k("event_type"), F.lit("")) == ""
    ignored = none | k("event_type").isin(*off) | ~inside if off else none | ~inside
    out = F.when(ignored, "ignore").otherwise(action)
    return candidates.withColumns({"event_action": out, "weight_factor": F.when((out == "reduce_weight"), F.lit(float(factor)))})


CONDITION = re.compile(r"^\s*([A-Za-z_][\w.]*)\s*(>=|<=|==|!=|>|<)\s*['\"]?([^'\"]+)['\"]?\s*$")


def condition(text: str, columns: list[str]) -> Column:
    """`name op literal` as a column: numbers where both sides are, else text; null for what is absent or not such a text."""
    m = CONDITION.match(text)
    if not m or m[1] not in columns:
        return F.lit(None).cast("boolean")
    name, op, right = m[1], m[2], m[3].strip()
    compare = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}[op]
    left = F.nullif(k(name).cast("string"), F.lit(""))
    as_text = compare(left, F.lit(right))
    try:
        number = F.lit(float(right))
    except ValueError:
        return as_text
    return F.coalesce(compare(F.expr(f"try_cast(`{name}` as double)"), number), as_text)


def market_state(observed: DataFrame, bull: list[str] | None = None, required: list[str] | None = None, enabled: bool = True, bear_trade_allowed: bool = False, missing_action: str = "pause_open") -> DataFrame:
    """observed (one row a day) with status and action.

    Disabled: neutral. A required indicator that is missing: not_available. With conditions: bull where all hold, not_available
    where one cannot be told, else bear. Without: by market_breadth, 0.6 and over bull, 0.4 and under bear. Bull opens, neutral
    reduces, bear pauses (or reduces where bear trades are allowed), and so does what is not available.
    """
    missing = F.lit(False)
    for name in required or []:
        missing = missing | (k(name).isNull() if name in observed.columns else F.lit(True))
    if bull:
        found = [condition(t, observed.columns) for t in bull]
        unknown, all_true = F.lit(False), F.lit(True)
        for c in found:
            unknown, all_true = unknown | c.isNull(), all_true & F.coalesce(c, F.lit(False))
        status = F.when(all_true, "bull").when(unknown, "not_available").otherwise("bear")
    else:
        b = k("market_breadth") if "market_breadth" in observed.columns else F.lit(None).cast("double")
        status = F.when(b >= 0.6, "bull").when(b <= 0.4, "bear").when(b.isNotNull(), "neutral").otherwise("not_available")
    status = F.when(F.lit(not enabled), "neutral").when(missing, "not_available").otherwise(status)
    action = F.when(F.lit(not enabled) | (status == "bull"), "allow_open").when(missing, missing_action).when((status == "neutral") | ((status == "bear") & F.lit(bear_trade_allowed)), "reduce_position").otherwise("pause_open")
    return observed.withColumns({"status": status, "action": action})


#: Names in a mode's table and the parameters that they override.
OVERRIDES = {"max_weight": "max_weight", "max_sector": "max_sector_weight", "max_sector_weight": "max_sector_weight", "max_adv_participation": "max_adv_participation", "min_amount_ma20": "min_amount_ma20", "max_liquidation_days": "max_liquidation_days"}


def control(candidates: DataFrame, block_tags: tuple[str, ...] = (), block_sectors: tuple[str, ...] = ()) -> DataFrame:
    """candidates with `reason` (null: kept): a blocked tag, else a blocked sector (where there is a column sector)."""
    tagged = F.arrays_overlap(labels(), F.array(*[F.lit(t) for t in block_tags]).cast("array<string>")) if block_tags else F.lit(False)
    sector = k("sector").isin(*block_sectors) if block_sectors and "sector" in candidates.columns else F.lit(False)
    return candidates.withColumn("reason", F.when(tagged, "blocked_tag").when(F.coalesce(sector, F.lit(False)), "blocked_sector"))


def overrides(dynamic: dict, status: str, action: str, liquidity: str = "") -> dict[str, float]:
    """Parameters that a bear or reduced market, or a thin one, changes."""
    modes = []
    if status == "bear" or action == "reduce_position":
        modes.append(dynamic.get("high_volatility_mode", {}))
    if liquidity in ("low", "low_liquidity"):
        modes.append(dynamic.get("low_liquidity_mode", {}))
    return {OVERRIDES[n]: v for m in modes for n, v in m.items() if n in OVERRIDES}


def scenarios(candidates: DataFrame, least: int = 2) -> DataFrame:
    """What may go wrong, by candidate: two standing scenarios, one for an event, one for risk flags, and macro ones up to `least`."""
    row = lambda kind, text, p, impact, trigger: F.struct(F.lit(kind).alias("scenario_type"), text.alias("description"), F.lit(p).alias("probability"), F.lit(impact).alias("impact"), trigger.alias("trigger"))
    flags = F.array_join("risk_flags", ",")
    event = F.coalesce(k("event_type"), F.lit("")) if "event_type" in candidates.columns else F.lit("")
    standing = [row("technical", F.lit("close under its mean of 20 days"), 0.30, "medium", F.lit("ma20")), row("sector", F.lit("policy or competition turns on the sector"), 0.20, "medium", F.lit("sector"))]
    sometimes = [F.when(event != "", row("event", F.lit("wider swings around the event"), 0.25, "medium", event)), F.when(F.size("risk_flags") > 0, row("technical", F.concat(F.lit("risk flags: "), flags), 0.35, "high", F.lit("risk_flags")))]
    found = F.array_compact(F.array(*standing, *sometimes))
    padded = F.concat(found, F.array_repeat(row("macro", F.lit("the market's appetite for risk falls"), 0.20, "medium", F.lit("macro")), F.greatest(F.lit(0), F.lit(least) - F.size(found))))
    return candidates.select("trade_date", "market", "symbol", F.posexplode(padded).alias("place", "s")).select("trade_date", "market", "symbol", (k("place") + 1).alias("place"), "s.*")


def gate_target(source: str, diagnostics: dict, require_filtered: bool = True) -> None:
    """ValueError unless a rebalancing target is a portfolio, or a file, that went through the risk filters."""
    if source not in ("portfolio", "portfolio_report") and not source.startswith("file:"):
        raise ValueError(f"not a portfolio: {source}")
    if require_filtered and not diagnostics.get("risk_filter_applied"):
        raise ValueError("the target did not go through the risk filters")


def reject_costly(plan: DataFrame, costs: DataFrame) -> DataFrame:
    """plan whose orders at the critical cost level become REJECT_TRADE, their target staying where it is now."""
    worst = costs.where("cost_level = 'critical'").select("trade_date", "market", "symbol", F.lit(True).alias("critical"))
    x = plan.join(worst, ["trade_date", "market", "symbol"], "left")
    bad = F.coalesce(k("critical"), F.lit(False)) & ~k("action").isin("HOLD", "HOLD_CASH")
    return x.withColumns({"action": F.when(bad, "REJECT_TRADE").otherwise(k("action")), "target": F.when(bad, k("current")).otherwise(k("target")), "delta": F.when(bad, 0.0).otherwise(k("delta"))}).drop("critical")
