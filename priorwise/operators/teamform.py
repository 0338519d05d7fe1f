"""Rolling team state and point-in-time game features.

All games of a calendar day see results of earlier days only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import shrunk_mean, shrunk_volatility
from ..session import cut_lineage, store
from .plays import SUMMARY_MEASURES, game_team_summary, regular_season

# What a league average looks like before any game has been seen.
DEFAULT_PRIORS = {
    "points_for": 22.5,
    "points_against": 22.5,
    "yards": 350.0,
    "off_epa": 0.0,
    "def_epa": 0.0,
    "turnovers": 1.2,
    "win": 0.5,
    "pressure_allowed": 0.20,
    "pressure_generated": 0.20,
    "success_rate_for": 0.45,
    "success_rate_allowed": 0.45,
    "early_down_epa_for": 0.0,
    "early_down_epa_allowed": 0.0,
    "explosive_rate_for": 0.10,
    "explosive_rate_allowed": 0.10,
    "neutral_pass_rate": 0.55,
    "sack_rate_allowed": 0.07,
    "sack_rate_generated": 0.07,
}
MARGIN_VOLATILITY_PRIOR = 13.0
EPA_VOLATILITY_PRIOR = 0.18
QB_CONTINUITY_PRIOR = 0.5
#: Rest cap, and the rest assumed before a team's first game.
MAX_REST_DAYS = 21
DEFAULT_REST_DAYS = 7

#: Window length and feature name per measure.
ROLLING = {m: (8, "win_pct_l8") if m == "win" else (4, f"{m}_l4") for m in DEFAULT_PRIORS}
STATE_FEATURES = [name for _, name in ROLLING.values()] + [
    "margin_volatility_l8",
    "off_epa_volatility_l8",
    "qb_continuity_l4",
]

# The columns of the game models and of the groups that ablations add, by name and in order.
CORE_GAME_FEATURES = [
    "home_points_for_l4",
    "home_points_against_l4",
    "home_yards_l4",
    "home_off_epa_l4",
    "home_def_epa_l4",
    "home_turnovers_l4",
    "home_win_pct_l8",
    "home_pressure_allowed_l4",
    "home_pressure_generated_l4",
    "away_points_for_l4",
    "away_points_against_l4",
    "away_yards_l4",
    "away_off_epa_l4",
    "away_def_epa_l4",
    "away_turnovers_l4",
    "away_win_pct_l8",
    "away_pressure_allowed_l4",
    "away_pressure_generated_l4",
    "home_rest_days",
    "away_rest_days",
    "rest_advantage",
    "division_game",
    "week",
    "home_field",
]
CANDIDATE_GROUPS = {
    "efficiency": [
        "home_success_rate_for_l4",
        "home_success_rate_allowed_l4",
        "home_early_down_epa_for_l4",
        "home_early_down_epa_allowed_l4",
        "away_success_rate_for_l4",
        "away_success_rate_allowed_l4",
        "away_early_down_epa_for_l4",
        "away_early_down_epa_allowed_l4",
    ],
    "explosiveness": [
        "home_explosive_rate_for_l4",
        "home_explosive_rate_allowed_l4",
        "away_explosive_rate_for_l4",
        "away_explosive_rate_allowed_l4",
    ],
    "sacks": [
        "home_sack_rate_allowed_l4",
        "home_sack_rate_generated_l4",
        "away_sack_rate_allowed_l4",
        "away_sack_rate_generated_l4",
    ],
    "stability": [
        "home_neutral_pass_rate_l4",
        "home_margin_volatility_l8",
        "home_off_epa_volatility_l8",
        "home_qb_continuity_l4",
        "away_neutral_pass_rate_l4",
        "away_margin_volatility_l8",
        "away_off_epa_volatility_l8",
        "away_qb_continuity_l4",
    ],
}


def _day_number() -> Column:
    return F.datediff(F.col("gameday"), F.lit("1970-01-01"))


def team_games(games: DataFrame, summaries: DataFrame, *, plays_by: str = "team") -> DataFrame:
    """Two rows per game, one per team, with the measures of completed games.

    ``observed`` tells whether the team had plays; ``completed`` whether the game has a result.
    ``plays_by="side"`` says the summaries name the side (home, away) instead of the club, which
    spares the plays a join with the schedule.
    """
    done = F.col("home_score").isNotNull() & F.col("away_score").isNotNull()

    def side(name: str, other: str) -> Column:
        return F.struct(
            F.lit(name).alias("side"),
            F.col(f"{name}_team").alias("team"),
            F.col(f"{name}_score").cast("double").alias("points_for"),
            F.col(f"{other}_score").cast("double").alias("points_against"),
        )

    rows = (
        games.where(
            F.col("gameday").isNotNull()
            & F.col("home_team").isNotNull()
            & F.col("away_team").isNotNull()
        )
        .withColumn("completed", done)
        .withColumn("_t", F.explode(F.array(side("home", "away"), side("away", "home"))))
        .select("game_id", "gameday", "completed", "_t.*")
        .withColumns(
            {
                "points_for": F.when(F.col("completed"), F.col("points_for")),
                "points_against": F.when(F.col("completed"), F.col("points_against")),
            }
        )
        .withColumns(
            {
                "margin": F.col("points_for") - F.col("points_against"),
                "win": (F.signum(F.col("points_for") - F.col("points_against")) + 1.0) / 2.0,
            }
        )
    )
    joined = rows.join(summaries.withColumnRenamed("team", plays_by), ["game_id", plays_by], "left")
    # Yards alone would tell; naming the passer as well makes every consumer of these rows need the
    # same summary columns, so the shuffle behind the summary runs once and is reused.
    return joined.withColumn("observed", F.expr("yards IS NOT NULL OR primary_qb IS NOT NULL"))


def league_priors(rows: DataFrame, measures: Sequence[str] = tuple(DEFAULT_PRIORS)) -> DataFrame:
    """Per schedule day, the league mean of every measure over all earlier days.

    A completed team-game without plays enters the league history as the prior of its own day, so
    the mean feeds itself: with ``S`` and ``N`` the sum and count before a day, ``r`` values summing
    to ``x`` and ``k`` imputed rows, ``S' = S*(1 + k/N) + x`` and ``N' = N + r + k``. That linear
    recurrence has a closed form in prefix sums of ``ln(1 + k/N)``, so it is three windows over a
    table of day totals, whose length is the calendar and not the data.
    """
    done = F.col("completed")
    totals = []
    for measure in measures:
        value = F.when(done, F.col(measure))
        if measure in SUMMARY_MEASURES:
            value = F.when(F.col("observed"), value)
            imputed = F.sum(F.when(done & ~F.col("observed"), 1).otherwise(0))
        else:
            imputed = F.lit(0).cast("bigint")
        totals.append(
            F.struct(
                F.lit(measure).alias("measure"),
                F.coalesce(F.sum(value), F.lit(0.0)).alias("x"),
                F.count(value).alias("r"),
                imputed.alias("k"),
                F.lit(DEFAULT_PRIORS[measure]).alias("base"),
            )
        )
    days = (
        rows.groupBy("gameday")
        .agg(F.array(*totals).alias("_m"))
        .select("gameday", F.inline("_m"))
    )
    order = Window.partitionBy("measure").orderBy("gameday")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    counted = days.withColumn("n", F.coalesce(F.sum(F.col("r") + F.col("k")).over(before), F.lit(0)))
    growth = F.when(F.col("n") > 0, F.log1p(F.col("k") / F.col("n"))).otherwise(F.lit(0.0))
    grown = counted.withColumn("g", growth).withColumn(
        "lp", F.coalesce(F.sum("g").over(before), F.lit(0.0))
    )
    entering = F.when(F.col("n") > 0, F.col("x")).otherwise(F.col("x") + F.col("k") * F.col("base"))
    total = F.sum(entering * F.exp(-(F.col("lp") + F.col("g")))).over(before)
    prior = F.when(F.col("n") > 0, total * F.exp("lp") / F.col("n")).otherwise(F.col("base"))
    by_measure = grown.withColumn("prior", prior)
    return by_measure.groupBy("gameday").agg(
        *[
            F.max(F.when(F.col("measure") == m, F.col("prior"))).alias(f"prior_{m}")
            for m in measures
        ]
    )


#: The passer that counts: the one named in a completed game.
PASSER = "CASE WHEN completed AND trim(primary_qb) <> '' THEN primary_qb END"


def with_priors(rows: DataFrame, priors: DataFrame) -> DataFrame:
    """Team-game rows with the priors and number of their day; completed games without plays take the priors."""
    return rows.join(F.broadcast(priors), "gameday", "left").withColumns(  # one row per day
        {
            **{m: F.expr(f"CASE WHEN observed THEN {m} WHEN completed THEN prior_{m} END") for m in SUMMARY_MEASURES if f"prior_{m}" in priors.columns},
            "day": _day_number(),
        }
    )


def rolling_team_state(rows: DataFrame, priors: DataFrame) -> DataFrame:
    """Sums and counts of the last 4 or 8 completed games of each team, after each row.

    Unplayed rows sit between played ones, so frames count completed games (``seq``), not rows.
    The windows are over one team's schedule: a team plays at most a handful of games a day, so a
    partition is bounded by the calendar however large the league table grows.
    """
    filled = with_priors(rows, priors)
    order = Window.partitionBy("team").orderBy("day", "game_id")
    passer = F.expr(PASSER)
    numbered = filled.withColumn("passer", passer).withColumns(
        {
            "seq": F.sum(F.col("completed").cast("int")).over(
                order.rowsBetween(Window.unboundedPreceding, 0)
            ),
            "passer_before": F.last("passer", ignorenulls=True).over(
                order.rowsBetween(Window.unboundedPreceding, -1)
            ),
        }
    ).withColumn(
        "passer_changed",
        F.expr("CASE WHEN passer IS NOT NULL THEN CAST(COALESCE(passer <> passer_before, false) AS INT) END"),
    )
    by_seq = Window.partitionBy("team").orderBy("seq")
    frames = {4: by_seq.rangeBetween(-3, 0), 8: by_seq.rangeBetween(-7, 0)}
    parts = []
    for measure, (length, _) in ROLLING.items():
        value = F.expr(f"CASE WHEN completed THEN {measure} END")
        parts.append(F.sum(value).over(frames[length]).alias(f"s_{measure}"))
        parts.append(F.count(value).over(frames[length]).alias(f"n_{measure}"))
    for measure in ("margin", "off_epa"):
        value = F.expr(f"CASE WHEN completed THEN {measure} END")
        parts.append(F.stddev_samp(value).over(frames[8]).alias(f"sd_{measure}"))
        parts.append(F.count(value).over(frames[8]).alias(f"n8_{measure}"))
    # Passer changes inside the last four games: all changes but the one that opens the frame.
    parts.append(F.count("passer").over(frames[4]).alias("n_passers"))
    parts.append(F.sum("passer_changed").over(frames[4]).alias("changes"))
    parts.append(F.first("passer_changed", ignorenulls=True).over(frames[4]).alias("opening"))
    return numbered.select("*", F.struct(*parts).alias("state"))


def state_features(state: str, prior) -> dict[str, Column]:
    """The 21 rolling features of a state struct; ``prior`` maps a measure to its anchor."""
    features = {
        name: shrunk_mean(f"{state}.s_{m}", f"{state}.n_{m}", prior(m))
        for m, (_, name) in ROLLING.items()
    }
    for m, name, base in (
        ("margin", "margin_volatility_l8", MARGIN_VOLATILITY_PRIOR),
        ("off_epa", "off_epa_volatility_l8", EPA_VOLATILITY_PRIOR),
    ):
        features[name] = shrunk_volatility(f"{state}.sd_{m}", f"{state}.n8_{m}", base)
    features["qb_continuity_l4"] = F.expr(
        f"CASE WHEN {state}.n_passers >= 2 THEN 1.0D - ({state}.changes - {state}.opening)"
        f" / ({state}.n_passers - 1) ELSE {QB_CONTINUITY_PRIOR}D END"
    )
    return features


def team_features_as_of(states: DataFrame) -> DataFrame:
    """Every team-game row with the state of the last completed game of an earlier day."""
    before = (
        Window.partitionBy("team").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    )
    done = F.col("completed")
    held = states.withColumns(
        {
            "held": F.last(F.when(done, F.col("state")), ignorenulls=True).over(before),
            "last_day": F.max(F.when(done, F.col("day"))).over(before),
        }
    )
    rest = F.coalesce(
        F.least(F.col("day") - F.col("last_day"), F.lit(MAX_REST_DAYS)), F.lit(DEFAULT_REST_DAYS)
    ).cast("double")
    features = state_features("held", lambda m: f"prior_{m}")
    return held.select(
        "game_id", "team", "side", rest.alias("rest_days"), *[c.alias(n) for n, c in features.items()]
    )


def _numbers(table: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Values by (column, row), zero where there are none, and where there are some."""
    columns = [table.column(n).combine_chunks() for n in names]
    known = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
    return np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns]), known


def _back(values: np.ndarray, lag: int) -> np.ndarray:
    """Values by (column, row) of the row ``lag`` rows before, zero before the first."""
    out = np.zeros_like(values)
    out[:, lag:] = values[:, : max(values.shape[1] - lag, 0)]
    return out


def _rolled(values: np.ndarray, length: int) -> np.ndarray:
    """Sums over each row and the ones before it, the oldest added first."""
    return sum((_back(values, lag) for lag in range(length - 1, -1, -1)), np.zeros_like(values))


def _deviation(values: np.ndarray, known: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Standard deviation by row of the values that are known among the last eight, from their sums and counts."""
    with np.errstate(divide="ignore", invalid="ignore"):
        mean, squares = sums / counts, np.zeros_like(sums)
        for lag in range(7, -1, -1):
            squares += np.where(_back(known[None], lag)[0], (_back(values[None], lag)[0] - mean) ** 2, 0.0)
        return np.sqrt(squares / (counts - 1))


def _passer_changes(passers: pa.ChunkedArray, length: int) -> np.ndarray:
    """(passers named, changes but the one that opens) by row, over each row and the ones before it."""
    codes = passers.combine_chunks().dictionary_encode().indices
    named = codes.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(named)
    code = codes.fill_null(-1).to_numpy(zero_copy_only=False)[at]
    changed = np.zeros((1, len(named)))
    changed[0, at[1:]] = code[1:] != code[:-1]
    first = np.maximum(np.arange(len(named)) - (length - 1), 0)
    opens = np.searchsorted(at, first)  # the first one named in the frame
    opening = changed[0, at[np.minimum(opens, len(at) - 1)]] if len(at) else np.zeros(len(named))
    return np.stack((_rolled(named[None].astype(float), length)[0], _rolled(changed, length)[0] - opening))


#: Where a volatility comes from, and what it is shrunk towards.
VOLATILITY = {"margin_volatility_l8": ("margin", MARGIN_VOLATILITY_PRIOR), "off_epa_volatility_l8": ("off_epa", EPA_VOLATILITY_PRIOR)}


def measures_of(features: Sequence[str]) -> list[str]:
    """The measures that have to be known for some of the state features."""
    rolled = [m for m, (_, name) in ROLLING.items() if name in features]
    return list(dict.fromkeys([*rolled, *(m for name, (m, _) in VOLATILITY.items() if name in features)]))


def _as_of_days(team: pa.Table, wanted: Sequence[str] = tuple(STATE_FEATURES)) -> pa.Table:
    """What the ``wanted`` features of a team's rows are made of, from its games completed on earlier days; ``t_`` and ``n_`` are yet to meet the priors."""
    measures = measures_of(wanted)
    team = team.take(pc.sort_indices(team, [("day", "ascending"), ("game_id", "ascending")], null_placement="at_start"))
    day = team.column("day").to_numpy()
    done = team.filter(team.column("completed"))
    values, known = _numbers(done, measures) if measures else (np.empty((0, len(done))), np.empty((0, len(done)), dtype=bool))
    lengths = {length for length, name in ROLLING.values() if name in wanted} | ({8} if any(n in wanted for n in VOLATILITY) else set())
    by_length = {length: (_rolled(values, length), _rolled(known.astype(float), length)) for length in lengths}
    days = done.column("day").to_numpy()
    held = np.searchsorted(days, day) - 1  # the last game of an earlier day
    some, held = held >= 0, np.maximum(held, 0)

    def at(x: np.ndarray) -> np.ndarray:
        return np.where(some, x[held], 0.0) if len(x) else np.zeros(len(day))

    last = days[held] if len(days) else np.zeros(len(day), dtype=day.dtype)
    rest = np.where(some, np.minimum(day - last, MAX_REST_DAYS), MAX_REST_DAYS).astype(float)  # the cap before a first game, as there
    features = {"rest_days": pa.array(rest)}
    for m, (length, name) in ROLLING.items():
        if name in wanted:
            features[f"t_{name}"], features[f"n_{name}"] = (pa.array(at(x[measures.index(m)])) for x in by_length[length])
    for name, (m, base) in VOLATILITY.items():
        if name in wanted:
            k = measures.index(m)
            n = at(by_length[8][1][k])
            features[name] = pa.array(np.where(n < 2, base, (at(_deviation(values[k], known[k], *(x[k] for x in by_length[8]))) * n + base * 2.0) / (n + 2.0)))
    if "qb_continuity_l4" in wanted:
        named, changes = map(at, _passer_changes(done.column("passer"), 4))
        features["qb_continuity_l4"] = pa.array(np.where(named >= 2, 1.0 - changes / np.maximum(named - 1, 1), QB_CONTINUITY_PRIOR))
    return pa.table({n: team.column(n) for n in ("game_id", "team", "side", "gameday")} | features)


def features_as_of(rows: DataFrame, priors: DataFrame, wanted: Sequence[str] = tuple(STATE_FEATURES)) -> DataFrame:
    """What :func:`team_features_as_of` gives for :func:`rolling_team_state`, in one pass over each team's schedule.

    A team plays at most a handful of games a day, so a group is bounded by the calendar. The priors, one row per day,
    meet the rows again after it, so they aren't dealt with them. Of the state features, only those ``wanted`` are made.
    """
    wanted = [n for n in STATE_FEATURES if n in wanted]
    passer = F.expr(PASSER) if "qb_continuity_l4" in wanted else F.lit(None).cast("string")
    sent = with_priors(rows, priors).select("game_id", "team", "side", "gameday", "day", "completed", passer.alias("passer"), *[F.col(n).cast("double").alias(n) for n in measures_of(wanted)])
    rolled = [name for _, name in ROLLING.values() if name in wanted]
    kept = [n for n in wanted if n not in rolled]
    made = [T.StructField(n, T.DoubleType()) for n in ("rest_days", *[f"{k}_{n}" for n in rolled for k in "tn"], *kept)]
    schema = T.StructType([*[sent.schema[n] for n in ("game_id", "team", "side", "gameday")], *made])
    held = sent.groupBy("team").applyInArrow(_as_of(wanted), schema).join(F.broadcast(priors), "gameday", "left")
    anchored = [F.expr(f"(t_{name} + prior_{m} * 2D) / (n_{name} + 2D)").alias(name) for m, (_, name) in ROLLING.items() if name in wanted]
    return held.select("game_id", "team", "side", "rest_days", *anchored, *kept)


def _as_of(wanted: Sequence[str]) -> Callable[[pa.Table], pa.Table]:
    def run(team: pa.Table) -> pa.Table:  # the types are read by Spark
        return _as_of_days(team, wanted)

    return run


def team_rows(games: DataFrame, plays: DataFrame, *, plays_by: str = "team", features: Sequence[str] = tuple(STATE_FEATURES)) -> DataFrame:
    """Regular-season team-game rows, stored, so that the plays are summed once for all that read them.

    They have the measures that some of the state features are made of.
    """
    rows = team_games(regular_season(games), game_team_summary(plays), plays_by=plays_by)
    unread = {*SUMMARY_MEASURES, *DEFAULT_PRIORS, "margin"} - set(measures_of(features))
    if "qb_continuity_l4" not in features:
        unread.add("primary_qb")
    return store(rows.drop(*unread))


def team_states(games: DataFrame, plays: DataFrame, *, plays_by: str = "team") -> DataFrame:
    """Regular-season team-game rows with the rolling state after each of them."""
    schedule = regular_season(games)
    rows = team_games(schedule, game_team_summary(plays), plays_by=plays_by)
    return rolling_team_state(rows, league_priors(rows))


def game_features(
    games: DataFrame,
    plays: DataFrame,
    *,
    include_unplayed: bool = False,
    transitions: DataFrame | None = None,
    plays_by: str = "team",
    rows: DataFrame | None = None,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Point-in-time feature row per game, with results where the game is completed.

    Both teams meet again in one aggregate by game instead of two joins. ``transitions`` is the
    roster table of :func:`priorwise.operators.roster.transition_table`; ``rows`` are the
    :func:`team_rows` of these games, where they are at hand. Of the rolling features of both sides, only those
    named by ``features`` are made, all if there are none.
    """
    wanted = [n for n in STATE_FEATURES if features is None or f"home_{n}" in features or f"away_{n}" in features]
    if rows is None:
        rows = team_rows(games, plays, plays_by=plays_by, features=wanted)
    # Priors are read before and after the pass over the teams: one row per day, stored.
    per_team = features_as_of(rows, cut_lineage(league_priors(rows, [m for m in DEFAULT_PRIORS if m in measures_of(wanted)])), wanted)
    names = ["rest_days", *wanted]
    paired = per_team.groupBy("game_id").agg(
        *[
            F.expr(f"max(CASE WHEN side = '{side}' THEN {n} END)").alias(f"{side}_{n}")
            for side in ("home", "away")
            for n in names
        ]
    )
    schedule = regular_season(games)
    if not include_unplayed:
        schedule = schedule.where(F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    neutral = F.coalesce(F.col("neutral_site"), F.lit(False))
    division = F.col("division_game") if "division_game" in games.columns else F.lit(0.0)
    out = schedule.join(paired, "game_id").withColumns(
        {
            "rest_advantage": F.col("home_rest_days") - F.col("away_rest_days"),
            "division_game": division.cast("double"),
            "home_field": F.when(neutral, 0.0).otherwise(1.0),
            "home_margin": (F.col("home_score") - F.col("away_score")).cast("double"),
            "total_points": (F.col("home_score") + F.col("away_score")).cast("double"),
        }
    )
    if transitions is not None:
        from .roster import attach_transitions

        out = attach_transitions(out, transitions)
    return out


def team_snapshot(states: DataFrame, transitions: DataFrame | None = None) -> DataFrame:
    """Latest rolling state per team, anchored on the fixed defaults rather than league means.

    With ``transitions``, the latest season's roster features are merged in; a team known only from
    its roster gets the default state.
    """
    latest = states.where("completed").groupBy("team").agg(F.max_by("state", "seq").alias("state"))
    snapshot = latest
    if transitions is not None:
        from .roster import season_snapshot

        current = season_snapshot(transitions, states)
        snapshot = latest.join(current, "team", "full_outer")
    features = state_features("state", lambda m: DEFAULT_PRIORS[m])
    extra = [c for c in snapshot.columns if c not in ("team", "state")]
    return snapshot.select("team", *[c.alias(n) for n, c in features.items()], *extra)


def with_division(games: DataFrame, divisions: DataFrame) -> DataFrame:
    """``division_game`` from a small (team, division) table; unknown teams never match."""
    home = divisions.select(F.col("team").alias("home_team"), F.col("division").alias("_hd"))
    away = divisions.select(F.col("team").alias("away_team"), F.col("division").alias("_ad"))
    return (
        games.join(home, "home_team", "left")
        .join(away, "away_team", "left")
        .withColumn("division_game", F.coalesce((F.col("_hd") == F.col("_ad")).cast("double"), F.lit(0.0)))
        .drop("_hd", "_ad")
    )


def game_baselines(features: DataFrame) -> DataFrame:
    """Simple expectations a model has to beat: strength difference and mean scoring rates."""
    pf_h, pa_h = F.col("home_points_for_l4"), F.col("home_points_against_l4")
    pf_a, pa_a = F.col("away_points_for_l4"), F.col("away_points_against_l4")
    return features.withColumns(
        {
            "baseline_margin": (pf_h - pa_h) - (pf_a - pa_a) + 1.5 * F.col("home_field"),
            "baseline_total": (pf_h + pf_a + pa_h + pa_a) / 2.0,
        }
    )
