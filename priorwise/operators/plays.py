"""Play-level flags and per-game summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite_or_null

#: Summary measures of one (game, team), offence first, in reporting order.
SUMMARY_MEASURES = (
    "yards",
    "off_epa",
    "def_epa",
    "turnovers",
    "pressure_allowed",
    "pressure_generated",
    "success_rate_for",
    "success_rate_allowed",
    "early_down_epa_for",
    "early_down_epa_allowed",
    "explosive_rate_for",
    "explosive_rate_allowed",
    "neutral_pass_rate",
    "sack_rate_allowed",
    "sack_rate_generated",
)


def regular_season(df: DataFrame) -> DataFrame:
    """Regular-season rows by ``game_type``, else ``season_type``, else everything."""
    for column in ("game_type", "season_type"):
        if column in df.columns:
            return df.where(F.col(column) == "REG")
    return df


def _number(df: DataFrame, name: str, default: float | None = 0.0) -> Column:
    if name not in df.columns:
        return F.lit(default).cast("double")
    value = finite_or_null(F.col(name))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def play_flags(plays: DataFrame) -> DataFrame:
    """Derived per-play measures; absent columns take their defaults."""
    kind = F.coalesce(F.col("play_type"), F.lit("")) if "play_type" in plays.columns else F.lit("")
    scrimmage = kind.isin("pass", "run")
    dropback = _number(plays, "qb_dropback") == 1
    sacked = _number(plays, "sack") == 1
    hurried = (_number(plays, "qb_hit") == 1) | sacked
    yards, epa = _number(plays, "yards_gained"), _number(plays, "epa")
    positive = (epa > 0).cast("double")
    success = F.coalesce(_number(plays, "success", None), positive)
    quarter, lead = _number(plays, "qtr", None), _number(plays, "score_differential", None)
    early = F.coalesce(scrimmage & _number(plays, "down", None).isin(1.0, 2.0), F.lit(False))
    neutral = F.coalesce(scrimmage & (quarter <= 3) & (F.abs(lead) <= 8), F.lit(False))
    explosive = ((kind == "pass") & (yards >= 20)) | ((kind == "run") & (yards >= 10))
    return plays.withColumns(
        {
            "is_scrimmage": scrimmage,
            "is_dropback": dropback,
            "is_pressure": dropback & hurried,
            "is_sack": dropback & sacked,
            "is_early_down": early,
            "is_explosive": explosive,
            "is_neutral": neutral,
            "is_neutral_pass": neutral & (kind == "pass"),
            "play_yards": yards,
            "play_epa": epa,
            "play_success": success,
            "play_turnovers": _number(plays, "interception") + _number(plays, "fumble_lost"),
        }
    )


def game_team_summary(plays: DataFrame) -> DataFrame:
    """Fifteen offence and defence measures and the primary passer per (game, team).

    One scan and one pre-aggregation serve both roles: plays shrink to one row per (game, attack,
    defence, passer) map-side, and only those rows are doubled into an offence and a defence entry.
    The passer counts come out of the same aggregate. Teams without a play in possession do not
    appear.
    """
    flags = play_flags(regular_season(plays)).where(F.col("game_id").isNotNull())
    passer = F.col("passer_player_id") if "passer_player_id" in plays.columns else F.lit(None)

    def amount(value: Column, condition: Column | None = None) -> Column:
        return F.sum(value if condition is None else F.when(condition, value))

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0))

    scrimmage = F.col("is_scrimmage")
    by_passer = flags.groupBy(
        "game_id",
        "posteam",
        "defteam",
        F.when(F.col("is_dropback"), passer).cast("string").alias("passer"),
    ).agg(
        F.count(F.lit(1)).alias("plays"),
        amount(F.col("play_yards")).alias("yards"),
        amount(F.col("play_turnovers")).alias("turnovers"),
        count(scrimmage).alias("scrimmage"),
        amount(F.col("play_epa"), scrimmage).alias("epa"),
        amount(F.col("play_success"), scrimmage).alias("success"),
        count(F.col("is_early_down")).alias("early"),
        amount(F.col("play_epa"), F.col("is_early_down")).alias("early_epa"),
        count(scrimmage & F.col("is_explosive")).alias("explosive"),
        count(F.col("is_dropback")).alias("dropbacks"),
        count(F.col("is_pressure")).alias("pressures"),
        count(F.col("is_sack")).alias("sacks"),
        count(F.col("is_neutral")).alias("neutral"),
        count(F.col("is_neutral_pass")).alias("neutral_pass"),
    )
    measured = [c for c in by_passer.columns if c not in ("game_id", "posteam", "defteam", "passer")]

    def role(team: str, attacks: bool) -> Column:
        named = F.col("passer") if attacks else F.lit(None).cast("string")
        return F.struct(
            F.col(team).alias("team"), F.lit(attacks).alias("attacks"), named.alias("passer")
        )

    level_one = (
        by_passer.withColumn("_role", F.explode(F.array(role("posteam", True), role("defteam", False))))
        .where(F.col("_role.team").isNotNull())
        .select("game_id", "_role.*", *measured)
    )
    parts = [c for c in level_one.columns if c not in ("game_id", "team", "attacks", "passer")]
    sums = [
        F.sum(F.when(F.col("attacks") == attacks, F.col(part))).alias(f"{prefix}_{part}")
        for prefix, attacks in (("o", True), ("d", False))
        for part in parts
    ]
    busiest = F.min_by(
        "passer", F.when(F.col("passer").isNotNull(), F.struct(-F.col("plays"), F.col("passer")))
    )
    level_two = (
        level_one.groupBy("game_id", "team")
        .agg(*sums, busiest.alias("primary_qb"))
        .where(F.col("o_plays").isNotNull())
    )

    def rate(numerator: str, denominator: str) -> Column:
        return F.try_divide(F.col(numerator).cast("double"), F.col(denominator).cast("double"))

    return level_two.select(
        "game_id",
        "team",
        F.col("o_yards").alias("yards"),
        rate("o_epa", "o_scrimmage").alias("off_epa"),
        rate("d_epa", "d_scrimmage").alias("def_epa"),
        F.col("o_turnovers").alias("turnovers"),
        rate("o_pressures", "o_dropbacks").alias("pressure_allowed"),
        rate("d_pressures", "d_dropbacks").alias("pressure_generated"),
        rate("o_success", "o_scrimmage").alias("success_rate_for"),
        rate("d_success", "d_scrimmage").alias("success_rate_allowed"),
        rate("o_early_epa", "o_early").alias("early_down_epa_for"),
        rate("d_early_epa", "d_early").alias("early_down_epa_allowed"),
        rate("o_explosive", "o_scrimmage").alias("explosive_rate_for"),
        rate("d_explosive", "d_scrimmage").alias("explosive_rate_allowed"),
        rate("o_neutral_pass", "o_neutral").alias("neutral_pass_rate"),
        rate("o_sacks", "o_dropbacks").alias("sack_rate_allowed"),
        rate("d_sacks", "d_dropbacks").alias("sack_rate_generated"),
        "primary_qb",
    )
