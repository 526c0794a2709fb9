"""Scalar trade rules as Column expressions (F1-F5, F8). No UDF: everything stays in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickweave import constants as K


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def risk_score(mape, rsi, change_pct) -> Column:
    """clamp(100 - 2*mape - |rsi-50|/50*20 - |change|/10, 0, 100).  [F1]

    NULL in gives NULL out (``least``/``greatest`` would skip a NULL and return a bound)."""
    mape, rsi, change_pct = _c(mape), _c(rsi), _c(change_pct)
    base = F.lit(100.0) - mape * F.lit(2.0)
    rsi_pen = F.abs(rsi - F.lit(50.0)) / F.lit(50.0) * F.lit(20.0)
    change_vol = F.abs(change_pct) / F.lit(10.0)
    raw = base - rsi_pen - change_vol
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))
    return F.when(mape.isNull() | rsi.isNull() | change_pct.isNull(), F.lit(None).cast("double")).otherwise(clamped)


def strike_step(price) -> Column:
    """Strike increment by price band."""
    price = _c(price)
    expr = None
    for bound, step in K.STRIKE_STEPS:
        expr = (F.when(price < bound, F.lit(step)) if expr is None else expr.when(price < bound, F.lit(step)))
    return expr.otherwise(F.lit(K.STRIKE_STEP_ABOVE))


def round_to_strike(price, direction: str = "neutral") -> Column:
    """Nearest strike (half-even), then one step further when the remainder says so:
    ``up`` if ``price mod step > step/2``, ``down`` if ``< step/2`` — the reference moves an
    already-rounded strike once more (1060 up -> 1200, 1000 down -> 900).  [F2]"""
    price = _c(price)
    inc = strike_step(price)
    nearest = F.bround(price / inc, 0) * inc
    rem = price % inc
    if direction == "up":
        nearest = F.when(rem > inc / F.lit(2.0), nearest + inc).otherwise(nearest)
    elif direction == "down":
        nearest = F.when(rem < inc / F.lit(2.0), nearest - inc).otherwise(nearest)
    return F.round(nearest, 2)


def strike_text(price, strike) -> Column:
    """Strike as the reference prints it: integer steps without decimals, 0.5 steps as a
    float (``9.5``, ``10.0``)."""
    return F.when(strike_step(_c(price)) < 1, _c(strike).cast("string")).otherwise(_c(strike).cast("long").cast("string"))


def expected_change_pct(last_forecast, last_close) -> Column:
    """(last forecast / last close - 1) * 100; NULL when the close is 0 or missing.  [F4]"""
    return (F.try_divide(_c(last_forecast), _c(last_close)) - F.lit(1.0)) * F.lit(100.0)


def rsi_or_default(rsi) -> Column:
    """Missing RSI counts as neutral 50.  [F5]"""
    return F.coalesce(_c(rsi), F.lit(K.RSI_DEFAULT))


def action(mape, change_pct, last_close) -> tuple[Column, Column]:
    """Trade action and its strike.  [F3]

    mape < 5: change > 2 -> calls at strike(last*1.02, up); -2 <= change <= 2 -> hold;
    otherwise puts at strike(last*0.98, down).  mape >= 5 -> unreliable.
    NULL mape or NULL change -> unreliable (the reference would fall through to puts on NaN)."""
    mape, change_pct, last_close = _c(mape), _c(change_pct), _c(last_close)
    call_px = last_close * F.lit(K.CALL_FACTOR)
    put_px = last_close * F.lit(K.PUT_FACTOR)
    call_k = round_to_strike(call_px, "up")
    put_k = round_to_strike(put_px, "down")
    reliable = mape.isNotNull() & change_pct.isNotNull() & (mape < F.lit(K.MAPE_RELIABLE_BELOW))
    calls = reliable & (change_pct > F.lit(K.CHANGE_BAND))
    hold = reliable & (change_pct >= F.lit(-K.CHANGE_BAND)) & (change_pct <= F.lit(K.CHANGE_BAND))
    puts = reliable & ~calls & ~hold
    strike = F.when(calls, call_k).when(puts, put_k)
    text = (
        F.when(calls, F.concat(F.lit(K.ACTION_CALLS), strike_text(call_px, call_k)))
        .when(hold, F.lit(K.ACTION_HOLD))
        .when(puts, F.concat(F.lit(K.ACTION_PUTS), strike_text(put_px, put_k)))
        .otherwise(F.lit(K.ACTION_UNRELIABLE))
    )
    return text, strike


def business_days(last_date, n: int = K.FORECAST_STEPS) -> Column:
    """The next ``n`` Monday-to-Friday dates after ``last_date`` (no holiday calendar).  [F8]"""
    d = _c(last_date)
    span = (n // 5 + 2) * 7
    days = F.sequence(F.date_add(d, 1), F.date_add(d, span))
    return F.slice(F.filter(days, lambda x: F.dayofweek(x).between(2, 6)), 1, n)
