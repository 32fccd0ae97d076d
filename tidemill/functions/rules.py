"""Business rules as columns: local dates, windows, fees, tiers, labels, seeds, policy cascades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the shop's terms.
RETURN_DAYS, RETURN_FEE, FREE_SHIPPING_FROM, SHIPPING_FEE = 7, 3000, 30_000, 3000
DELAY_SHORT, DELAY_LONG, DELAY_LONG_FROM, DEFECTIVE = 2000, 5000, 3, 3000
COUPON_DAYS, COUPON_LIMIT = 30, 2
OFFSET = "+09:00"


def local_time(utc: Column) -> Column:
    """UTC time as local time: a fixed offset, no daylight saving."""
    return F.from_utc_timestamp(utc.cast("timestamp"), OFFSET)


def local_date(utc: Column) -> Column:
    return F.to_date(local_time(utc))


def local_minute(utc: Column) -> Column:
    """'YYYY-MM-DD HH:MM' in local time; null stays null."""
    return F.date_format(local_time(utc), "yyyy-MM-dd HH:mm")


def return_deadline(delivered: Column) -> Column:
    return F.date_add(local_date(delivered), RETURN_DAYS)


def in_return_window(now: Column, delivered: Column) -> Column:
    """The last day counts."""
    return local_date(now) <= return_deadline(delivered)


def return_fee(reason: Column) -> Column:
    return F.when(reason == "changed_mind", RETURN_FEE).otherwise(0)


def refund(goods: Column, reason: Column) -> Column:
    """Goods less the fee, taken once a request; never below zero."""
    return F.greatest(F.lit(0), goods - return_fee(reason))


def delay_days(promised: Column, delivered: Column, now: Column) -> Column:
    """Local days past the promised date, up to today if not delivered; zero or less is in time."""
    return F.datediff(local_date(F.coalesce(delivered, now)), promised)


def compensation(reason: Column, days: Column) -> Column:
    """Coupon amount; null if there is no claim."""
    delayed = F.when(days <= 0, None).when(days >= DELAY_LONG_FROM, DELAY_LONG).otherwise(DELAY_SHORT)
    return F.when(reason == "defective_item", DEFECTIVE).otherwise(delayed)


def fallback_compensation(reason: Column) -> Column:
    """The lowest amount of a reason, for coupons that pass though none is due."""
    return F.when(reason == "defective_item", DEFECTIVE).otherwise(DELAY_SHORT)


def shipping_fee(goods: Column) -> Column:
    return F.when(goods >= FREE_SHIPPING_FROM, 0).otherwise(SHIPPING_FEE)


def label(code: Column, labels: dict[str, str]) -> Column:
    """Label of a code; an unknown code is an error, null stays null."""
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    found = F.element_at(known, code)
    return F.when(code.isNull(), None).when(found.isNull(), F.raise_error(F.concat(F.lit("unknown code: "), code))).otherwise(found)


def derived_seed(*parts: Column) -> Column:
    """31 bits: the first four bytes of the SHA-256 of the parts, joined by '|', without the sign bit."""
    digest = F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % (1 << 31)


def first_failure(checks: Sequence[tuple[str, Column]]) -> Column:
    """Code of the first check that fails, in order; null if none does. What a strict policy refuses with."""
    return F.coalesce(*(F.when(failed, code) for code, failed in checks))


def all_failures(checks: Sequence[tuple[str, Column]]) -> Column:
    """Codes of all checks that fail, in order. What a lenient policy records and goes on."""
    return F.array_compact(F.array(*(F.when(failed, code) for code, failed in checks)))


def amount(won: Column) -> Column:
    return F.concat(F.format_number(won, 0), F.lit("원"))


def share(n: Column, d: Column) -> Column:
    """n / d; null if d is zero."""
    return F.try_divide(n, d)
