"""Tolerant normalizers for nested college feeds.

A feed is a DataFrame with a ``raw`` JSON text column and an ``ordinal`` giving the ingest order.
Numbers arrive as numbers or text, fields may be missing, dates may be malformed: everything that
does not parse becomes null (or the stated default) instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeparse import parse_as_of
from ..operators.history import keep_one
from .feeds import _exists


def _parse(feed: DataFrame, schema: str) -> DataFrame:
    return feed.select("ordinal", F.from_json("raw", schema).alias("r"))


def _number(name: str, kind: str = "double") -> Column:
    value = F.expr(f"try_cast(r.{name} AS DOUBLE)")
    return value if kind == "double" else F.expr(f"try_cast(try_cast(r.{name} AS DOUBLE) AS {kind})")


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"r.{name}"), F.lit(""))


def _flag(name: str) -> Column:
    return F.coalesce(F.expr(f"try_cast(r.{name} AS BOOLEAN)"), F.lit(False))


def normalize_teams(feed: DataFrame) -> DataFrame:
    """Typed teams with their first logo; a repeated id keeps its first record."""
    text = ("school", "abbreviation", "mascot", "conference", "classification", "color")
    schema = ", ".join(f"{c} STRING" for c in text)
    rows = _parse(feed, f"id STRING, {schema}, alternateColor STRING, logos ARRAY<STRING>").select(
        "ordinal",
        _number("id", "BIGINT").alias("team_id"),
        *[_text(c).alias(c) for c in text],
        _text("alternateColor").alias("alternate_color"),
        F.coalesce(F.get("r.logos", F.lit(0)), F.lit("")).alias("logo"),
    )
    return keep_one(rows.where("team_id IS NOT NULL"), ["team_id"], "ordinal")


def normalize_games(feed: DataFrame) -> DataFrame:
    """Typed games with a UTC kickoff and ``fbs_vs_fbs``; a repeated id keeps its first record."""
    names = (
        "id season week seasonType startDate homeId homeTeam homeConference homeClassification awayId "
        "awayTeam awayConference awayClassification neutralSite conferenceGame completed homePoints awayPoints"
    ).split()
    rows = _parse(feed, ", ".join(f"{n} STRING" for n in names)).select(
        "ordinal",
        _number("id", "BIGINT").alias("game_id"),
        _number("season", "INT").alias("season"),
        _number("week", "INT").alias("week"),
        _text("seasonType").alias("season_type"),
        parse_as_of(F.col("r.startDate")).alias("start_date"),
        _number("homeId", "BIGINT").alias("home_id"),
        _text("homeTeam").alias("home_team"),
        _text("homeConference").alias("home_conference"),
        _text("homeClassification").alias("home_classification"),
        _number("awayId", "BIGINT").alias("away_id"),
        _text("awayTeam").alias("away_team"),
        _text("awayConference").alias("away_conference"),
        _text("awayClassification").alias("away_classification"),
        _flag("neutralSite").alias("neutral_site"),
        _flag("conferenceGame").alias("conference_game"),
        _flag("completed").alias("completed"),
        _number("homePoints").alias("home_points"),
        _number("awayPoints").alias("away_points"),
    )
    both = F.expr("home_classification = 'fbs' AND away_classification = 'fbs'")
    return keep_one(
        rows.where("game_id IS NOT NULL").withColumn("fbs_vs_fbs", both), ["game_id"], "ordinal"
    )


def normalize_calendar(feed: DataFrame) -> DataFrame:
    """Calendar weeks; readers order by season and week."""
    return _parse(
        feed, "season STRING, week STRING, seasonType STRING, startDate STRING, endDate STRING"
    ).select(
        _number("season", "INT").alias("season"),
        _number("week", "INT").alias("week"),
        _text("seasonType").alias("season_type"),
        parse_as_of(F.col("r.startDate")).alias("start_date"),
        parse_as_of(F.col("r.endDate")).alias("end_date"),
    )


_UNIT = "STRUCT<ppa: STRING, successRate: STRING, explosiveness: STRING, plays: STRING, drives: STRING>"


def normalize_advanced(feed: DataFrame) -> DataFrame:
    """Nested offence and defence flattened; a repeated (game, team) keeps its last record."""
    rows = _parse(
        feed,
        f"gameId STRING, season STRING, week STRING, team STRING, opponent STRING, offense {_UNIT}, defense {_UNIT}",
    ).select(
        "ordinal",
        _number("gameId", "BIGINT").alias("game_id"),
        _number("season", "INT").alias("season"),
        _number("week", "INT").alias("week"),
        F.col("r.team").alias("team"),
        F.col("r.opponent").alias("opponent"),
        _number("offense.ppa").alias("off_ppa"),
        _number("offense.successRate").alias("off_success_rate"),
        _number("offense.explosiveness").alias("off_explosiveness"),
        _number("offense.plays").alias("off_plays"),
        _number("offense.drives").alias("off_drives"),
        _number("defense.ppa").alias("def_ppa"),
        _number("defense.successRate").alias("def_success_rate"),
        _number("defense.explosiveness").alias("def_explosiveness"),
    )
    known = rows.where("game_id IS NOT NULL AND team IS NOT NULL")
    return keep_one(known, ["game_id", "team"], "ordinal", keep="last")


def normalize_returning(feed: DataFrame) -> DataFrame:
    """Returning production; a repeated (season, team) keeps its last record."""
    rows = _parse(
        feed,
        "season STRING, team STRING, percentPPA STRING, percentPassingPPA STRING, "
        "percentRushingPPA STRING, percentReceivingPPA STRING, usage STRING",
    ).select(
        "ordinal",
        _number("season", "INT").alias("season"),
        _text("team").alias("team"),
        _number("percentPPA").alias("returning_ppa"),
        _number("percentPassingPPA").alias("returning_passing_ppa"),
        _number("percentRushingPPA").alias("returning_rushing_ppa"),
        _number("percentReceivingPPA").alias("returning_receiving_ppa"),
        _number("usage").alias("returning_usage"),
    )
    return keep_one(rows.where("season IS NOT NULL"), ["season", "team"], "ordinal", keep="last")


def normalize_portal(feed: DataFrame) -> DataFrame:
    """Transfer records with a UTC date; every record counts, so nothing is deduplicated."""
    return (
        _parse(
            feed,
            "season STRING, origin STRING, destination STRING, rating STRING, stars STRING, transferDate STRING",
        )
        .select(
            _number("season", "INT").alias("season"),
            _text("origin").alias("origin"),
            _text("destination").alias("destination"),
            _number("rating").alias("rating"),
            _number("stars").alias("stars"),
            parse_as_of(F.col("r.transferDate")).alias("transfer_date"),
        )
        .where("season IS NOT NULL")
    )


def normalize_talent(feed: DataFrame) -> DataFrame:
    return (
        _parse(feed, "year STRING, team STRING, talent STRING")
        .select(
            "ordinal",
            _number("year", "INT").alias("season"),
            _text("team").alias("team"),
            _number("talent").alias("talent"),
        )
        .where("season IS NOT NULL")
    )


def normalize_recruiting(feed: DataFrame) -> DataFrame:
    return (
        _parse(feed, "year STRING, team STRING, points STRING, rank STRING")
        .select(
            "ordinal",
            _number("year", "INT").alias("season"),
            _text("team").alias("team"),
            _number("points").alias("recruiting_points"),
            _number("rank").alias("recruiting_rank"),
        )
        .where("season IS NOT NULL")
    )


def normalize_lines(feed: DataFrame) -> DataFrame:
    """Per game, negated median spread, median total and the number of providers.

    The medians are taken inside the record's own array of a few providers; the provider count
    includes providers without a line. A repeated game keeps its last record.
    """

    def median(field: str) -> Column:
        values = F.expr(
            f"array_sort(filter(transform(COALESCE(r.lines, array()), l -> try_cast(l.{field} AS DOUBLE)), v -> v IS NOT NULL))"
        )
        n = F.size(values)
        low = F.try_element_at(values, F.floor((n + 1) / 2).cast("int"))
        high = F.try_element_at(values, F.floor((n + 2) / 2).cast("int"))
        return F.when(n > 0, (low + high) / 2.0)

    rows = _parse(
        feed,
        "id STRING, season STRING, week STRING, lines ARRAY<STRUCT<spread: STRING, overUnder: STRING>>",
    ).select(
        "ordinal",
        _number("id", "BIGINT").alias("game_id"),
        _number("season", "INT").alias("season"),
        _number("week", "INT").alias("week"),
        (-median("spread")).alias("market_home_margin"),
        median("overUnder").alias("market_total"),
        F.expr("COALESCE(size(r.lines), 0)").alias("market_provider_count"),
    )
    return keep_one(rows.where("game_id IS NOT NULL"), ["game_id"], "ordinal", keep="last")


#: Feed name to normalizer, so that callers can plug in their own.
NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "teams": normalize_teams,
    "games": normalize_games,
    "calendar": normalize_calendar,
    "advanced": normalize_advanced,
    "returning": normalize_returning,
    "portal": normalize_portal,
    "talent": normalize_talent,
    "recruiting": normalize_recruiting,
    "lines": normalize_lines,
}


#: Feeds of a season's history, and those without which there is none.
HISTORY = ("games", "advanced", "returning", "portal", "talent", "recruiting", "lines")
REQUIRED = ("games", "advanced")
_LANDED = "ordinal BIGINT, record STRING, _broken STRING"


def read_history(
    spark: SparkSession, root: str, seasons: Sequence[int], *, feeds: Sequence[str] = HISTORY, required: Sequence[str] = REQUIRED,
    normalizers: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every feed over its published season folders, normalized, and the counts of (feed, season, lines, broken).

    Records lie under ``root/<feed>/season=<year>`` as lines of JSON with an ordinal and the record. A season that
    a feed hasn't published is skipped, a feed without any is empty; a required feed without a readable record
    fails. Lines that are no JSON or have no ordinal are left out and counted. Order of ingest is season, then
    ordinal. Folders are found by their metadata; nothing is read before the frames are used, but to see that
    required feeds aren't empty.
    """
    registry = {**NORMALIZERS, **(normalizers or {})}
    frames: dict[str, DataFrame] = {}
    counts = None
    for feed in feeds:
        paths = [p for p in (f"{root}/{feed}/season={s}" for s in seasons) if _exists(spark, p)]
        if paths:
            reader = spark.read.schema(_LANDED).option("columnNameOfCorruptRecord", "_broken").option("basePath", f"{root}/{feed}")
            landed = reader.json(paths).withColumn("season", F.col("season").cast("int"))
        else:
            landed = spark.createDataFrame([], _LANDED + ", season INT")
        good = F.col("ordinal").isNotNull() & F.col("record").isNotNull() & F.col("_broken").isNull()
        readable = landed.where(good).select(F.struct("season", "ordinal").alias("ordinal"), F.col("record").alias("raw"))
        if feed in required and readable.isEmpty():
            raise ValueError(f"feed {feed} has no readable record for the requested seasons")
        frames[feed] = registry[feed](readable)
        part = landed.groupBy(F.lit(feed).alias("feed"), "season").agg(F.count(F.lit(1)).alias("lines"), F.count_if(~good).alias("broken"))
        counts = part if counts is None else counts.unionByName(part)
    return frames, counts
