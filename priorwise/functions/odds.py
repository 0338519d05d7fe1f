"""Betting-price arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clip, normal_cdf


def spread_to_margin(home_spread: Column) -> Column:
    """Bookmaker spread (home favoured by six is -6) to expected home margin (+6)."""
    return -home_spread.cast("double")


def implied_probability(price: Column, *, strict: bool = True) -> Column:
    """American price to implied probability. Zero raises, or is null where ``strict`` is false."""
    value = price.cast("double")
    bad = (
        F.raise_error(F.lit("an American price of zero has no probability")).cast("double")
        if strict
        else F.lit(None).cast("double")
    )
    return (
        F.when(value == 0, bad)
        .when(value < 0, -value / (F.lit(100.0) - value))
        .otherwise(F.lit(100.0) / (value + 100.0))
    )


def no_vig(price: Column, other: Column, *, strict: bool = True) -> Column:
    """Implied probability of ``price`` after the two-way margin is normalized away."""
    mine = implied_probability(price, strict=strict)
    return mine / (mine + implied_probability(other, strict=strict))


def home_cover_probability(margin: Column, home_spread: Column, margin_std: Column) -> Column:
    return normal_cdf((margin - spread_to_margin(home_spread)) / F.greatest(margin_std, F.lit(1e-6)))


def over_probability(total: Column, line: Column, total_std: Column) -> Column:
    return normal_cdf((total - line) / F.greatest(total_std, F.lit(1e-6)))


def score_pair(margin: Column, total: Column) -> tuple[Column, Column]:
    """Home and away score that add up to ``total`` and differ by ``margin``, floored at zero."""
    return clip((total + margin) / 2.0, 0.0), clip((total - margin) / 2.0, 0.0)


def moneyline(probability: Column) -> Column:
    """Fair American price of a win probability, to the nearest five."""
    p = clip(probability, 0.001, 0.999)
    price = F.when(p >= 0.5, -p / (1.0 - p)).otherwise((1.0 - p) / p) * 100.0
    return (F.bround(price / 5.0, 0) * 5).cast("bigint")
