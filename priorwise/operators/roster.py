"""Season-opening roster change, measured in last season's snaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip
from ..functions.text import name_key
from ..functions.timeparse import transition_weight

# Roster states that mean a player has left, and the position groups.
DEPARTED = ("CUT", "RET", "TRD", "TRC")
OFFENSIVE_LINE = ("OL", "T", "OT", "G", "C")
SKILL = ("WR", "TE", "RB", "FB")
FRONT = ("DL", "DE", "DT", "NT", "LB", "ILB", "OLB", "EDGE")
SECONDARY = ("CB", "S", "DB", "FS", "SS")

# Measures of roster change.
RAW_FEATURES = [
    "roster_offense_continuity",
    "roster_defense_continuity",
    "roster_qb_returning",
    "roster_ol_continuity",
    "roster_skill_continuity",
    "roster_front_continuity",
    "roster_secondary_continuity",
    "roster_incoming_offense_share",
    "roster_incoming_defense_share",
]
DELTA_FEATURES = [f"{f}_delta" for f in RAW_FEATURES]
# The groups of roster columns that ablations add, by name and in order.
ROSTER_GROUPS = {
    "roster_overall": [
        "home_roster_offense_continuity_delta",
        "home_roster_defense_continuity_delta",
        "away_roster_offense_continuity_delta",
        "away_roster_defense_continuity_delta",
    ],
    "roster_offense_positions": [
        "home_roster_qb_returning_delta",
        "home_roster_ol_continuity_delta",
        "home_roster_skill_continuity_delta",
        "away_roster_qb_returning_delta",
        "away_roster_ol_continuity_delta",
        "away_roster_skill_continuity_delta",
    ],
    "roster_defense_positions": [
        "home_roster_front_continuity_delta",
        "home_roster_secondary_continuity_delta",
        "away_roster_front_continuity_delta",
        "away_roster_secondary_continuity_delta",
    ],
    "roster_veteran_additions": [
        "home_roster_incoming_offense_share_delta",
        "home_roster_incoming_defense_share_delta",
        "away_roster_incoming_offense_share_delta",
        "away_roster_incoming_defense_share_delta",
    ],
}


def _player_key(df: DataFrame, name: str, feed_id: str) -> Column:
    """Folded name, else the feed id; null where both are blank."""
    key = name_key(F.col(name)) if name in df.columns else F.lit("")
    raw = F.trim(F.coalesce(F.col(feed_id), F.lit(""))) if feed_id in df.columns else F.lit("")
    return F.when(key != "", key).when(raw != "", F.concat(F.lit("pfr:"), raw))


def opening_rosters(rosters: DataFrame) -> DataFrame:
    """Distinct (season, team, player) of each season's earliest week, without the departed.

    Game-day inactives stay: an inactive list of week one is not known before the season.
    """
    frame = rosters
    if "game_type" in frame.columns:
        # Fall back to all rows only where a feed marks nothing as regular season.
        marked = frame.agg(F.max((F.col("game_type") == "REG").cast("int")).alias("_marked"))
        one_row = F.broadcast(marked)
        frame = frame.crossJoin(one_row).where("_marked = 0 OR game_type = 'REG'").drop("_marked")
    week = F.coalesce(F.col("week").cast("int"), F.lit(1)) if "week" in frame.columns else F.lit(1)
    frame = frame.withColumn("_week", week).withColumn(
        "player_id", _player_key(rosters, "full_name", "pfr_id")
    )
    opening = frame.groupBy("season").agg(F.min("_week").alias("_week"))
    kept = frame.join(F.broadcast(opening), ["season", "_week"])  # one row per season
    if "status" in frame.columns:
        kept = kept.where(~F.coalesce("status", F.lit("")).isin(*DEPARTED))
    return kept.where(F.col("player_id").isNotNull()).select("season", "team", "player_id").distinct()


def player_snaps(snaps: DataFrame) -> DataFrame:
    """Season totals per (season, team, player, position)."""
    frame = snaps.where("game_type = 'REG'") if "game_type" in snaps.columns else snaps
    return (
        frame.withColumn("player_id", _player_key(snaps, "player", "pfr_player_id"))
        .where(F.col("player_id").isNotNull())
        .groupBy(
            "season",
            "team",
            "player_id",
            F.upper(F.coalesce("position", F.lit(""))).alias("position"),
        )
        .agg(
            *[
                F.sum(F.coalesce(F.expr(f"try_cast({c} AS DOUBLE)"), F.lit(0.0))).alias(c)
                for c in ("offense_snaps", "defense_snaps")
            ]
        )
    )


def raw_transitions(opening: DataFrame, totals: DataFrame) -> DataFrame:
    """Share of last season's snaps that returns, by unit and position group, and arrivals.

    All joins are on the player, so no team's history is gathered in one place before it has been
    summed; the sums by (season, team) are combined map-side.
    """
    prior = totals.withColumn("season", F.col("season") + 1)
    now = opening.withColumn("returning", F.lit(True))
    stayed = prior.join(now, ["season", "team", "player_id"], "left").withColumn(
        "returning", F.coalesce("returning", F.lit(False))
    )

    def share(snaps: str, positions: tuple[str, ...] | None = None) -> Column:
        rows = "true" if positions is None else f"position IN ({', '.join(repr(p) for p in positions)})"
        kept = F.expr(f"sum(CASE WHEN {rows} AND returning THEN {snaps} ELSE 0D END)")
        total = F.expr(f"sum(CASE WHEN {rows} THEN {snaps} ELSE 0D END)")
        return F.when(total > 0, kept / total)

    quarterback = F.expr("position = 'QB' AND offense_snaps > 0")
    order = F.struct(-F.col("offense_snaps"), F.col("player_id"))
    per_team = stayed.groupBy("season", "team").agg(
        share("offense_snaps").alias("roster_offense_continuity"),
        share("defense_snaps").alias("roster_defense_continuity"),
        F.min_by(F.when(quarterback, F.col("returning").cast("double")), F.when(quarterback, order)).alias(
            "roster_qb_returning"
        ),
        share("offense_snaps", OFFENSIVE_LINE).alias("roster_ol_continuity"),
        share("offense_snaps", SKILL).alias("roster_skill_continuity"),
        share("defense_snaps", FRONT).alias("roster_front_continuity"),
        share("defense_snaps", SECONDARY).alias("roster_secondary_continuity"),
        F.sum("offense_snaps").alias("team_offense"),
        F.sum("defense_snaps").alias("team_defense"),
    )
    elsewhere = prior.withColumnRenamed("team", "from_team")
    arrivals = (
        opening.join(elsewhere, ["season", "player_id"])
        .where("team <> from_team")
        .groupBy("season", "team")
        .agg(F.sum("offense_snaps").alias("in_offense"), F.sum("defense_snaps").alias("in_defense"))
    )
    present = opening.select("season", "team").distinct()

    def incoming(unit: str) -> Column:
        ratio = F.coalesce(F.col(f"in_{unit}"), F.lit(0.0)) / F.col(f"team_{unit}")
        return F.when(F.col(f"team_{unit}") > 0, clip(ratio, 0.0, 1.0))

    return (
        per_team.join(present, ["season", "team"], "left_semi")
        .join(arrivals, ["season", "team"], "left")
        .withColumns(
            {
                "roster_incoming_offense_share": incoming("offense"),
                "roster_incoming_defense_share": incoming("defense"),
            }
        )
        .select("season", "team", *RAW_FEATURES)
    )


def league_centred(df: DataFrame, features: list[str], *, by: str = "season") -> DataFrame:
    """Fill each feature with its season mean and add ``<feature>_delta`` from that mean."""
    means = df.groupBy(by).agg(*[F.avg(f).alias(f"_m_{f}") for f in features])
    joined = df.join(F.broadcast(means), by)  # one row per season
    filled = {f: F.coalesce(F.col(f), F.col(f"_m_{f}")) for f in features}
    deltas = {
        f"{f}_delta": F.coalesce(F.coalesce(F.col(f), F.col(f"_m_{f}")) - F.col(f"_m_{f}"), F.lit(0.0))
        for f in features
    }
    return joined.withColumns({**deltas, **filled}).drop(*[f"_m_{f}" for f in features])


def transition_table(rosters: DataFrame, snaps: DataFrame) -> DataFrame:
    """(season, team) with nine raw features and their league-centred deltas."""
    raw = raw_transitions(opening_rosters(rosters), player_snaps(snaps))
    return league_centred(raw, RAW_FEATURES)


def attach_transitions(games: DataFrame, transitions: DataFrame) -> DataFrame:
    """Deltas of both teams, fading over the first weeks; teams without a row get 0."""
    out = games
    weight = transition_weight(F.col("week"))
    for side in ("home", "away"):
        mine = transitions.select(
            "season",
            F.col("team").alias(f"{side}_team"),
            *[F.col(f).alias(f"{side}_{f}") for f in DELTA_FEATURES],
        )
        out = out.join(mine, ["season", f"{side}_team"], "left").withColumns(
            {
                f"{side}_{f}": F.coalesce(F.col(f"{side}_{f}") * weight, F.lit(0.0))
                for f in DELTA_FEATURES
            }
        )
    return out


def season_snapshot(transitions: DataFrame, schedule: DataFrame) -> DataFrame:
    """Transition rows of the newest season in the schedule, keyed by team."""
    season = F.year("gameday") if "season" not in schedule.columns else F.col("season")
    newest = schedule.agg(F.max(season).alias("season"))
    return transitions.join(F.broadcast(newest), "season").drop("season")  # a single row
