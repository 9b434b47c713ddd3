"""Typed columns out of the raw string columns of a review table."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DISCOUNT_TIERS, NA_TOKENS, TIER_LABELS


def na_to_null(c) -> Column:
    """Missing-value tokens to null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~c.isin(*NA_TOKENS), c)


def _to_double(text: Column, strict: bool) -> Column:
    number = text.cast("double") if strict else text.try_cast("double")
    return F.when(~F.isnan(number), number)


def money(c, strict: bool = False) -> Column:
    """`₹1,099` to 1099.0; `strict` raises on junk instead of giving null."""
    return _to_double(F.regexp_replace(na_to_null(c), "[₹,]", ""), strict)


def percent(c, strict: bool = False) -> Column:
    """`64%` to 64."""
    digits = F.regexp_replace(na_to_null(c), "%", "")
    return digits.cast("int") if strict else digits.try_cast("int")


def rating(c, strict: bool = False) -> Column:
    """Digits and dots only; nothing left means null."""
    return _to_double(F.nullif(F.regexp_replace(na_to_null(c), r"[^\d.]", ""), F.lit("")), strict)


def category_level(c, level: int) -> Column:
    """One level of an `A|B|C` path, null where the path is shorter."""
    return F.get(F.split(c, r"\|"), F.lit(level))


def discount_tier(pct, tiers=DISCOUNT_TIERS) -> Column:
    """Right-closed tiers from 0; anything outside the outer edges is null."""
    pct = F.col(pct) if isinstance(pct, str) else pct
    (first, first_upper), rest = tiers[0], tiers[1:]
    out = F.when((pct >= 0) & (pct <= first_upper), first)
    for label, upper in rest:
        out = out.when((pct > 0) & (pct <= upper), label)
    return out


def tier_rank(c, labels=TIER_LABELS) -> Column:
    """Position of a tier in its own order."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in labels]), c), F.lit(0)).cast("int")
