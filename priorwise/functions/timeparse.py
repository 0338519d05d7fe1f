"""Timestamps and calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OFFSET = r"(?:[zZ]|[+-][0-9]{2}:?[0-9]{2})$"


def parse_instant(text: Column) -> Column:
    """ISO timestamp with a mandatory UTC offset; naive or malformed text is null."""
    return F.when(text.rlike(_OFFSET), F.try_to_timestamp(text))


def parse_as_of(text: Column) -> Column:
    """As-of argument: a bare date or a naive time is read as UTC."""
    return F.try_to_timestamp(text)


def local_kickoff(gameday: Column, gametime: Column, zone: str = "America/New_York") -> Column:
    """UTC instant of a local date and ``HH:mm``; unknown or ``TBD`` times are null."""
    stamp = F.try_to_timestamp(
        F.concat_ws(" ", gameday.cast("string"), gametime), F.lit("yyyy-MM-dd HH:mm")
    )
    return F.when(
        gameday.isNotNull() & gametime.isNotNull() & ~gametime.isin("", "TBD"),
        F.to_utc_timestamp(stamp, zone),
    )


def transition_weight(week: Column) -> Column:
    """Weight of preseason knowledge: one in week 1, a quarter less each week, zero from week 5."""
    capped = F.greatest(week.cast("double"), F.lit(1.0))
    return F.least(F.greatest(F.lit(1.25) - capped * 0.25, F.lit(0.0)), F.lit(1.0))


def league_year(day: Column) -> Column:
    """The league year turns over on 15 March."""
    return F.when(F.month(day) * 100 + F.dayofmonth(day) >= 315, F.year(day)).otherwise(F.year(day) - 1)


def training_seasons(day: Column, history: int = 4) -> Column:
    """The ``history`` seasons before the prediction season, and that season itself."""
    season = league_year(day)
    return F.sequence(season - history, season)


def parse_season_list(text: Column) -> Column:
    """``2022-2025,2027`` to a sorted array of distinct seasons."""
    ranges = F.transform(
        F.split(text, ","),
        lambda part: F.sequence(
            F.trim(F.element_at(F.split(part, "-"), 1)).cast("int"),
            F.trim(F.element_at(F.split(part, "-"), -1)).cast("int"),
        ),
    )
    return F.array_sort(F.array_distinct(F.flatten(ranges)))
