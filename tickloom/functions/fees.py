"""Commission expressions over a signed quantity and an execution price."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: default fee parameters
TIERED_FLOOR, TIERED_RATE = 100.0, 0.0021
NOTIONAL_BPS = 25.0
FIXED_FEE = 1.0
PER_SHARE_FEE = 0.005
PER_SHARE_MIN = 1.0
NOTIONAL_TIERS = [(100_000.0, 10.0), (1_000_000.0, 5.0), (float("inf"), 2.5)]


def _zero() -> Column:
    return F.lit(0.0)


def commission_zero(quantity: Column, price: Column) -> Column:
    return _zero()


def commission_quantity_tiered(quantity: Column, price: Column) -> Column:
    return F.greatest(F.lit(TIERED_FLOOR), F.abs(quantity) * TIERED_RATE)


def commission_notional_bps(quantity: Column, price: Column) -> Column:
    return F.abs(quantity) * price * (NOTIONAL_BPS / 10_000)


def commission_fixed(quantity: Column, price: Column, fee: float = FIXED_FEE) -> Column:
    return F.when(quantity == 0, _zero()).otherwise(F.lit(float(fee)))


def commission_per_share(quantity: Column, price: Column, fee: float = PER_SHARE_FEE) -> Column:
    return F.abs(quantity) * fee


def commission_per_share_bounded(
    quantity: Column,
    price: Column,
    fee: float = PER_SHARE_FEE,
    minimum: float = PER_SHARE_MIN,
    maximum: float | None = None,
) -> Column:
    bounded = F.greatest(F.lit(float(minimum)), F.abs(quantity) * fee)
    if maximum is not None:
        bounded = F.least(F.lit(float(maximum)), bounded)
    return F.when(quantity == 0, _zero()).otherwise(bounded)


def commission_notional_bps_min(
    quantity: Column, price: Column, bps: float = NOTIONAL_BPS, minimum: float = 0.0
) -> Column:
    notional = F.abs(quantity) * price
    return F.when(notional == 0, _zero()).otherwise(F.greatest(F.lit(float(minimum)), notional * bps / 10_000))


def commission_notional_tiers(
    quantity: Column, price: Column, tiers: Sequence[tuple[float, float]] = NOTIONAL_TIERS
) -> Column:
    """The rate of the first tier that reaches the notional; beyond all of them the last rate."""
    notional = F.abs(quantity) * price
    rate = F.lit(tiers[-1][1])
    for bound, bps in reversed(tiers[:-1]):
        rate = F.when(notional <= bound, F.lit(bps)).otherwise(rate)
    return notional * rate / 10_000


def commission_sell_regulatory(
    quantity: Column,
    price: Column,
    notional_bps: float = 0.0,
    per_share: float = 0.0,
    per_share_cap: float | None = None,
) -> Column:
    """Sell-side only: a notional part plus a per-share part with an optional cap."""
    shares = F.abs(quantity)
    activity = shares * per_share
    if per_share_cap is not None:
        activity = F.least(activity, F.lit(float(per_share_cap)))
    return F.when(quantity < 0, shares * price * notional_bps / 10_000 + activity).otherwise(_zero())


COMMISSIONS = {
    "zero": commission_zero,
    "quantity_tiered": commission_quantity_tiered,
    "notional_bps": commission_notional_bps,
    "fixed": commission_fixed,
    "per_share": commission_per_share,
    "per_share_bounded": commission_per_share_bounded,
    "notional_bps_min": commission_notional_bps_min,
    "notional_tiers": commission_notional_tiers,
    "sell_regulatory": commission_sell_regulatory,
}
