"""College games: eligibility, as-of cuts, preseason table, Elo and form features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .selection import connected_groups, exact_medians

# The rating scale and how fast it moves.
ELO_START = 1500.0
ELO_HOME = 55.0
ELO_SCALE = 400.0
ELO_POINTS = 25.0
ELO_K = 20.0
ELO_SEASON_KEEP = 0.65
ELO_MARGIN = 2.2
# Recent form. Six games, an earlier season counts 0.35, the prior counts three games.
FORM_GAMES = 6
FORM_OFFSEASON = 0.35
FORM_PRIOR_WEIGHT = 3.0
#: Least and most days of rest that count; the least stands before a team's first game too.
REST_DAYS = (4, 28)
FORM_PRIORS = {
    "points_for": 27.0,
    "points_against": 27.0,
    "margin_vs_elo": 0.0,
    "opponent_elo": 1500.0,
    "off_ppa": 0.0,
    "def_ppa": 0.0,
    "off_success_rate": 0.42,
    "def_success_rate": 0.42,
    "off_explosiveness": 1.2,
    "def_explosiveness": 1.2,
    "plays": 70.0,
}
# The preseason measures, and the efficiency measures by their columns in the feed.
PRESEASON_SOURCES = [
    "returning_ppa",
    "returning_passing_ppa",
    "returning_rushing_ppa",
    "returning_receiving_ppa",
    "talent",
    "recruiting_points",
    "portal_net_rating",
]
PRESEASON_FEATURES = [f"{c}_z" for c in PRESEASON_SOURCES]
_ADVANCED = {
    "off_ppa": "off_ppa",
    "def_ppa": "def_ppa",
    "off_success_rate": "off_success_rate",
    "def_success_rate": "def_success_rate",
    "off_explosiveness": "off_explosiveness",
    "def_explosiveness": "def_explosiveness",
    "plays": "off_plays",
}


# The columns of the four nested configurations, by name and in order.
ELO_FEATURES = [
    "home_elo",
    "away_elo",
    "elo_diff",
    "elo_expected_margin",
    "week",
    "home_field",
    "conference_game",
    "home_rest_days",
    "away_rest_days",
    "rest_advantage",
]
FORM_FEATURES = [
    "home_points_for_l6",
    "home_points_against_l6",
    "home_margin_vs_elo_l6",
    "home_opponent_elo_l6",
    "home_plays_l6",
    "away_points_for_l6",
    "away_points_against_l6",
    "away_margin_vs_elo_l6",
    "away_opponent_elo_l6",
    "away_plays_l6",
]
EFFICIENCY_FEATURES = [
    "home_off_ppa_l6",
    "home_def_ppa_l6",
    "home_off_success_rate_l6",
    "home_def_success_rate_l6",
    "home_off_explosiveness_l6",
    "home_def_explosiveness_l6",
    "away_off_ppa_l6",
    "away_def_ppa_l6",
    "away_off_success_rate_l6",
    "away_def_success_rate_l6",
    "away_off_explosiveness_l6",
    "away_def_explosiveness_l6",
]
PRESEASON_SIDES = [
    "home_returning_ppa_z",
    "home_returning_passing_ppa_z",
    "home_returning_rushing_ppa_z",
    "home_returning_receiving_ppa_z",
    "home_talent_z",
    "home_recruiting_points_z",
    "home_portal_net_rating_z",
    "away_returning_ppa_z",
    "away_returning_passing_ppa_z",
    "away_returning_rushing_ppa_z",
    "away_returning_receiving_ppa_z",
    "away_talent_z",
    "away_recruiting_points_z",
    "away_portal_net_rating_z",
]
CONFIGURATIONS = {
    "elo_context": ELO_FEATURES,
    "elo_form": ELO_FEATURES + FORM_FEATURES,
    "elo_form_advanced": ELO_FEATURES + FORM_FEATURES + EFFICIENCY_FEATURES,
    "elo_form_advanced_preseason": ELO_FEATURES + FORM_FEATURES + EFFICIENCY_FEATURES + PRESEASON_SIDES,
}

_COMPLETED = "COALESCE(completed, false) AND home_points IS NOT NULL AND away_points IS NOT NULL"


def eligible_games(games: DataFrame, *, include_scheduled: bool = False) -> DataFrame:
    """Games between two top-division teams with ids, week and kickoff; completed unless asked."""
    known = games.where(
        "COALESCE(fbs_vs_fbs, false) AND home_id IS NOT NULL AND away_id IS NOT NULL"
        " AND week IS NOT NULL AND start_date IS NOT NULL"
    ).withColumn("completed", F.expr(_COMPLETED))
    return known if include_scheduled else known.where("completed")


def as_of_cut(games: DataFrame, advanced: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Forget results after ``as_of``: later games are not completed and carry no points, and the
    advanced stats of those games are gone."""
    later = F.col("start_date") > as_of
    cut = games.withColumns(
        {
            "completed": F.when(later, False).otherwise(F.col("completed")),
            "home_points": F.when(~F.coalesce(later, F.lit(False)), F.col("home_points")),
            "away_points": F.when(~F.coalesce(later, F.lit(False)), F.col("away_points")),
        }
    )
    visible = games.where(~F.coalesce(later, F.lit(False))).select("game_id")
    return cut, advanced.join(visible, "game_id", "left_semi")


def season_zscores(df: DataFrame, columns: list[str], *, by: str = "season") -> DataFrame:
    """``<c>_z`` within the season; missing values take the median, a constant column becomes 0.

    Season statistics are aggregates joined back, so a season with many rows is not one window, and medians are
    selected by counts, so no task holds its values.
    """
    df = cut_lineage(df)  # each pass reads it
    long = exact_medians(df, [by], columns)
    medians = df.select(by).distinct().join(long, by, "left").groupBy(by).agg(
        *[F.max(F.when(F.col("column") == c, F.col("median"))).alias(f"_md_{c}") for c in columns]
    )
    filled = df.join(F.broadcast(medians), by).withColumns(  # one row per season
        {f"_v_{c}": F.coalesce(F.col(c).cast("double"), F.col(f"_md_{c}")) for c in columns}
    )
    moments = filled.groupBy(by).agg(
        *[F.avg(f"_v_{c}").alias(f"_mu_{c}") for c in columns],
        *[F.stddev_samp(f"_v_{c}").alias(f"_sd_{c}") for c in columns],
    )
    scored = filled.join(F.broadcast(moments), by).withColumns(
        {
            f"{c}_z": F.expr(f"COALESCE(try_divide(_v_{c} - _mu_{c}, NULLIF(_sd_{c}, 0D)), 0D)")
            for c in columns
        }
    )
    return scored.select(*df.columns, *[f"{c}_z" for c in columns])


def portal_flows(portal: DataFrame, games: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Incoming and outgoing ratings per (season, team) of transfers in the 400 days before the
    season's first kickoff."""
    starts = games.groupBy("season").agg(F.min("start_date").alias("season_start"))
    dated = portal.join(starts, "season").where(
        "transfer_date < season_start AND transfer_date >= season_start - INTERVAL 400 DAYS"
    )
    rating = F.sum(F.coalesce("rating", F.lit(0.0)))

    def flow(side: str, name: str) -> DataFrame:
        named = dated.where(F.coalesce(F.col(side), F.lit("")) != "")
        return named.groupBy("season", F.col(side).alias("team")).agg(rating.alias(name))

    return flow("destination", "portal_in_rating"), flow("origin", "portal_out_rating")


def preseason_table(
    games: DataFrame, returning: DataFrame, portal: DataFrame, talent: DataFrame, recruiting: DataFrame
) -> DataFrame:
    """Seven season z-scores for every team on the season's schedule."""
    teams = games.select(
        "season", F.explode(F.array("home_team", "away_team")).alias("team")
    ).distinct()

    def last(feed: DataFrame, columns: list[str]) -> DataFrame:
        if "ordinal" not in feed.columns:
            return feed.select("season", "team", *columns)
        return feed.groupBy("season", "team").agg(*[F.max_by(c, "ordinal").alias(c) for c in columns])

    incoming, outgoing = portal_flows(portal, games)
    keys = ["season", "team"]
    joined = (
        teams.join(last(returning, PRESEASON_SOURCES[:4]), keys, "left")
        .join(last(talent, ["talent"]), keys, "left")
        .join(last(recruiting, ["recruiting_points"]), keys, "left")
        .join(incoming, keys, "left")
        .join(outgoing, keys, "left")
        .withColumn(
            "portal_net_rating",
            F.expr("COALESCE(portal_in_rating, 0D) - COALESCE(portal_out_rating, 0D)"),
        )
    )
    return season_zscores(joined, PRESEASON_SOURCES).select("season", "team", *PRESEASON_FEATURES)


def _elo_fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk the games of each league in order. State is one number per team, never the rows."""
    league, season, ratings = None, None, {}
    for batch in batches:
        home_out, away_out = [], []
        for row in batch.itertuples(index=False):
            if row.league != league:
                league, season, ratings = row.league, row.season_no, {}
            while season < row.season_no:
                ratings = {t: ELO_START + ELO_SEASON_KEEP * (r - ELO_START) for t, r in ratings.items()}
                season += 1
            home, away = ratings.get(row.home_id, ELO_START), ratings.get(row.away_id, ELO_START)
            home_out.append(home)
            away_out.append(away)
            if row.margin != row.margin:
                continue
            edge = home - away + ELO_HOME * row.home_field
            expected = 1.0 / (1.0 + 10.0 ** (-edge / ELO_SCALE))
            result = 0.5 * (1 + (row.margin > 0) - (row.margin < 0))
            step = ELO_K * row.log_margin * ELO_MARGIN / (abs(home - away) * 0.001 + ELO_MARGIN)
            ratings[row.home_id] = home + step * (result - expected)
            ratings[row.away_id] = away - step * (result - expected)
        yield pd.DataFrame({"game_id": batch["game_id"], "home_elo": home_out, "away_elo": away_out})


def elo_ratings(games: DataFrame) -> DataFrame:
    """Pregame Elo of both teams of every eligible game.

    A rating depends on the game before it, so the games of one ``league`` (teams that meet each
    other) are walked in order by one task; leagues run in parallel. Without a league column, a league
    is what the schedule connects. Rows stream through in Arrow batches: memory is the rating table of
    one league, whatever the length of its history.
    """
    if "league" not in games.columns:
        games = cut_lineage(games)
        groups = connected_groups(games, "home_id", "away_id").select(F.col("member").alias("home_id"), F.col("group").alias("league"))
        return elo_ratings(games.join(groups, "home_id", "left")).drop("league")
    seasons = games.select("season").distinct().withColumn(
        "season_no", F.row_number().over(Window.orderBy("season"))
    )
    margin = F.when(F.col("completed"), F.col("home_points") - F.col("away_points"))
    rows = (
        games.join(F.broadcast(seasons), "season")  # one row per season
        .select(
            "league",
            "season_no",
            "week",
            "start_date",
            "game_id",
            "home_id",
            "away_id",
            F.when(F.coalesce("neutral_site", F.lit(False)), 0.0).otherwise(1.0).alias("home_field"),
            margin.alias("margin"),
            F.log(F.abs(margin) + 1.0).alias("log_margin"),
        )
        .repartition("league")
        .sortWithinPartitions("league", "season_no", "week", "start_date", "game_id")
    )
    folded = rows.mapInPandas(_elo_fold, "game_id bigint, home_elo double, away_elo double")
    return games.join(folded, "game_id").withColumns(
        {
            "home_field": F.expr("CASE WHEN COALESCE(neutral_site, false) THEN 0D ELSE 1D END"),
            "elo_diff": F.col("home_elo") - F.col("away_elo"),
        }
    ).withColumns(
        {
            "elo_expected_margin": (F.col("elo_diff") + ELO_HOME * F.col("home_field")) / ELO_POINTS,
            "elo_home_probability": 1.0
            / (1.0 + F.pow(F.lit(10.0), -(F.col("elo_diff") + ELO_HOME * F.col("home_field")) / ELO_SCALE)),
        }
    )


def form_history(rated: DataFrame, advanced: DataFrame) -> DataFrame:
    """Two rows per game with the measures that enter a team's history; missing efficiency values
    take their priors."""
    def side(name: str, other: str, sign: int) -> Column:
        return F.struct(
            F.lit(name).alias("side"),
            F.col(f"{name}_team").alias("team"),
            F.col(f"{name}_points").cast("double").alias("points_for"),
            F.col(f"{other}_points").cast("double").alias("points_against"),
            (sign * (F.col("home_points") - F.col("away_points") - F.col("elo_expected_margin"))).alias("margin_vs_elo"),
            F.col(f"{other}_elo").alias("opponent_elo"),
        )

    rows = rated.select(
        "game_id", "season", "week", "start_date", "completed",
        F.explode(F.array(side("home", "away", 1), side("away", "home", -1))).alias("_s"),
    ).select("game_id", "season", "week", "start_date", "completed", "_s.*")
    joined = rows.join(advanced.select("game_id", "team", *_ADVANCED.values()), ["game_id", "team"], "left")
    filled = {k: F.expr(f"COALESCE(NULLIF({c}, double('NaN')), {FORM_PRIORS[k]}D)") for k, c in _ADVANCED.items()}
    return joined.withColumns(filled)


def _form_of_team(team: pa.Table) -> pa.Table:
    """Rest and form of a team's rows, which come in order, from its games completed before each."""

    def numbers(name: str, missing: int = 0) -> tuple[np.ndarray, np.ndarray]:
        column = team.column(name).combine_chunks()
        return column.fill_null(missing).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)

    start, dated = numbers("start")
    seconds = start // 1_000_000
    days = np.clip((seconds[1:] - seconds[:-1]) // 86400, *REST_DAYS)
    rest = np.concatenate(([REST_DAYS[0]], np.where(dated[1:] & dated[:-1], days, REST_DAYS[0]))).astype(float)

    done = numbers("completed", False)[0]
    before = np.cumsum(done) - done  # completed games before each row
    season, some = numbers("season")
    values, known = (np.stack(x)[:, done] for x in zip(*map(numbers, FORM_PRIORS), strict=True))
    held = np.minimum(before, FORM_GAMES)
    total = np.full(len(season), FORM_PRIOR_WEIGHT)
    sums = np.stack([np.full(len(season), FORM_PRIOR_WEIGHT * p) for p in FORM_PRIORS.values()])
    missing = np.zeros(sums.shape, dtype=bool)
    for lag in range(FORM_GAMES, 0, -1) if done.any() else ():  # the oldest is added first
        there, at = before >= lag, np.maximum(before - lag, 0)
        at = np.minimum(at, done.sum() - 1)
        same = (season[done][at] == season) & some[done][at] & some
        weight = np.where(there, (held - lag + 1.0) / np.maximum(held, 1) * np.where(same, 1.0, FORM_OFFSEASON), 0.0)
        total += weight
        sums += np.where(there & known[:, at], values[:, at] * weight, 0.0)
        missing |= there & ~known[:, at]
    form = {f"{k}_l6": pa.array(sums[i] / total, mask=missing[i]) for i, k in enumerate(FORM_PRIORS)}
    return pa.table({"game_id": team.column("game_id"), "side": team.column("side"), "rest_days": pa.array(rest), **form})


def form_state(rows: DataFrame) -> DataFrame:
    """Shrunken form of the last six completed games before each row, newest weighing most, and the days of rest.

    Rest is in whole 24-hour periods since the team's previous game, scheduled ones included. One pass over each
    team's schedule; a team plays at most a handful of games a day, so a group is bounded by the calendar.
    """
    measures = [F.col(k).cast("double").alias(k) for k in FORM_PRIORS]
    sent = rows.select("game_id", "side", "team", "season", "week", F.unix_micros("start_date").alias("start"), "completed", *measures)
    made = [T.StructField(n, T.DoubleType()) for n in ("rest_days", *[f"{k}_l6" for k in FORM_PRIORS])]
    dealt = sent.repartition("team").sortWithinPartitions("team", "season", "week", "start", "game_id")
    return dealt.groupBy("team").applyInArrow(_form_of_team, T.StructType([sent.schema["game_id"], sent.schema["side"], *made]))


def college_features(
    games: DataFrame, advanced: DataFrame, preseason: DataFrame, lines: DataFrame, *, include_scheduled: bool = False
) -> DataFrame:
    """Elo, form, efficiency, preseason and listed lines going into every game."""
    rated = elo_ratings(eligible_games(games, include_scheduled=include_scheduled))
    state = form_state(form_history(rated, advanced))
    names = ["rest_days", *[f"{k}_l6" for k in FORM_PRIORS]]
    paired = state.groupBy("game_id").agg(
        *[F.expr(f"max(CASE WHEN side = '{s}' THEN {n} END)").alias(f"{s}_{n}") for s in ("home", "away") for n in names]
    )
    # The preseason meets the games before they carry the form, so that less is dealt where it is too large to be sent.
    out = rated
    for side in ("home", "away"):
        mine = preseason.select(
            "season", F.col("team").alias(f"{side}_team"), *[F.col(f).alias(f"{side}_{f}") for f in PRESEASON_FEATURES]
        )
        out = out.join(mine, ["season", f"{side}_team"], "left").fillna(
            0.0, [f"{side}_{f}" for f in PRESEASON_FEATURES]
        )
    listed = lines.select("game_id", "market_home_margin", "market_total", "market_provider_count")
    return out.join(paired, "game_id").join(listed, "game_id", "left").fillna(0, ["market_provider_count"]).withColumns(
        {
            "conference_game": F.coalesce(F.col("conference_game"), F.lit(False)).cast("double"),
            "rest_advantage": F.col("home_rest_days") - F.col("away_rest_days"),
            "home_margin": F.expr("CASE WHEN completed THEN CAST(home_points - away_points AS DOUBLE) END"),
            "total_points": F.expr("CASE WHEN completed THEN CAST(home_points + away_points AS DOUBLE) END"),
            "form_expected_total": F.expr(
                "0.5D * (home_points_for_l6 + away_points_against_l6 + away_points_for_l6 + home_points_against_l6)"
            ),
        }
    )


def foundation_summary(teams: DataFrame, games: DataFrame, calendar: DataFrame) -> DataFrame:
    """Size and bounds of a season's foundation data, one row."""
    counts = games.agg(
        F.count(F.lit(1)).alias("scheduled_game_count"),
        F.count_if(F.coalesce("fbs_vs_fbs", F.lit(False))).alias("fbs_vs_fbs_game_count"),
        F.count_if(F.coalesce("completed", F.lit(False))).alias("completed_game_count"),
    )
    weeks = calendar.where("season_type = 'regular'").agg(
        F.count(F.lit(1)).alias("calendar_week_count"),
        F.min("start_date").alias("season_start"),
        F.max("end_date").alias("season_end"),
    )
    return teams.agg(F.count(F.lit(1)).alias("team_count")).crossJoin(counts).crossJoin(weeks)


def input_coverage(
    games: DataFrame, feeds: dict[str, DataFrame], portal: DataFrame, season: int
) -> DataFrame:
    """How many of the season's scheduled teams each feed covers, one row."""
    current = games.where((F.col("season") == season) & F.coalesce("fbs_vs_fbs", F.lit(False)))
    teams = current.select(F.explode(F.array("home_team", "away_team")).alias("team")).distinct()
    out = teams.agg(F.count(F.lit(1)).alias("scheduled_fbs_teams"))
    for name, feed in feeds.items():
        covered = feed.where(F.col("season") == season).join(teams, "team", "left_semi")
        out = out.crossJoin(covered.agg(F.countDistinct("team").alias(f"{name}_teams")))
    records = portal.where(F.col("season") == season).agg(F.count(F.lit(1)).alias("portal_records"))
    played = games.where(F.expr(_COMPLETED)).where(F.col("season") == season)
    return out.crossJoin(records).crossJoin(played.agg(F.count(F.lit(1)).alias("completed_games")))


def audit_by_season(
    features: DataFrame, team_feeds: dict[str, DataFrame], row_feeds: dict[str, DataFrame]
) -> DataFrame:
    """Rows or distinct teams per season and feed; seasons without a feed show 0."""
    out = features.groupBy("season").agg(F.count(F.lit(1)).alias("completed_games"))
    for name, feed in team_feeds.items():
        out = out.join(feed.groupBy("season").agg(F.countDistinct("team").alias(name)), "season", "left")
    for name, feed in row_feeds.items():
        out = out.join(feed.groupBy("season").agg(F.count(F.lit(1)).alias(name)), "season", "left")
    return out.fillna(0)
