"""Registered queries: plays, team form and point-in-time game features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import plays as play_ops
from ..operators import teamform as form
from .bindings import SQL_BINDINGS
from .registry import query

_M = play_ops.SUMMARY_MEASURES
_PRIORS = form.DEFAULT_PRIORS

SQL_BINDINGS["flags"] = (
    ("plays",),
    """SELECT *, play_type IN ('pass', 'run') AS scrim,
    COALESCE(success, CASE WHEN epa > 0 THEN 1 ELSE 0 END) AS succ,
    CAST(qb_dropback = 1 AND (qb_hit = 1 OR sack = 1) AS INTEGER) AS press,
    CAST(qb_dropback = 1 AND sack = 1 AS INTEGER) AS sck,
    CAST(play_type IN ('pass', 'run') AND down IN (1, 2) AS INTEGER) AS early,
    CAST((play_type = 'pass' AND yards_gained >= 20) OR (play_type = 'run' AND yards_gained >= 10) AS INTEGER) AS expl,
    CAST(play_type IN ('pass', 'run') AND qtr <= 3 AND abs(score_differential) <= 8 AS INTEGER) AS neut
    FROM plays""",
)
SQL_BINDINGS["passers"] = (
    ("plays",),
    """SELECT game_id, posteam AS team, passer_player_id AS primary_qb FROM (
    SELECT game_id, posteam, passer_player_id, row_number() OVER (PARTITION BY game_id, posteam
      ORDER BY count(*) DESC, passer_player_id) AS rn FROM plays
    WHERE season_type = 'REG' AND qb_dropback = 1 AND passer_player_id IS NOT NULL
    GROUP BY game_id, posteam, passer_player_id) WHERE rn = 1""",
)
SQL_BINDINGS["summary"] = (
    ("flags", "passers"),
    """SELECT o.*, d.* EXCLUDE (game_id, team), primary_qb FROM
    (SELECT game_id, posteam AS team, sum(yards_gained) AS yards,
      avg(CASE WHEN scrim THEN epa END) AS off_epa, sum(interception + fumble_lost) AS turnovers,
      sum(press) / nullif(sum(qb_dropback), 0) AS pressure_allowed,
      avg(CASE WHEN scrim THEN succ END) AS success_rate_for,
      avg(CASE WHEN early = 1 THEN epa END) AS early_down_epa_for,
      avg(CASE WHEN scrim THEN expl END) AS explosive_rate_for,
      sum(CASE WHEN neut = 1 AND play_type = 'pass' THEN 1 ELSE 0 END) / nullif(sum(neut), 0) AS neutral_pass_rate,
      sum(sck) / nullif(sum(qb_dropback), 0) AS sack_rate_allowed
      FROM flags WHERE season_type = 'REG' GROUP BY 1, 2) o
    LEFT JOIN (SELECT game_id, defteam AS team, avg(CASE WHEN scrim THEN epa END) AS def_epa,
      sum(press) / nullif(sum(qb_dropback), 0) AS pressure_generated,
      avg(CASE WHEN scrim THEN succ END) AS success_rate_allowed,
      avg(CASE WHEN early = 1 THEN epa END) AS early_down_epa_allowed,
      avg(CASE WHEN scrim THEN expl END) AS explosive_rate_allowed,
      sum(sck) / nullif(sum(qb_dropback), 0) AS sack_rate_generated
      FROM flags WHERE season_type = 'REG' GROUP BY 1, 2) d USING (game_id, team)
    LEFT JOIN passers USING (game_id, team)""",
)
SQL_BINDINGS["team_rows"] = (
    ("games", "summary"),
    """SELECT g.*, s.* EXCLUDE (game_id, team), s.game_id IS NOT NULL AS observed,
    points_for - points_against AS margin,
    CASE WHEN points_for > points_against THEN 1.0 WHEN points_for = points_against THEN 0.5
      WHEN points_for < points_against THEN 0.0 END AS win,
    points_for IS NOT NULL AS completed FROM (
    SELECT game_id, gameday, 'home' AS side, home_team AS team, home_score AS points_for, away_score AS points_against
      FROM games WHERE game_type = 'REG' UNION ALL
    SELECT game_id, gameday, 'away', away_team, away_score, home_score FROM games WHERE game_type = 'REG') g
    LEFT JOIN summary s ON s.game_id = g.game_id AND s.team = g.side""",
)


def _day_totals() -> str:
    parts = []
    for m, base in _PRIORS.items():
        seen = " AND observed" if m in _M else ""
        imputed = "sum(CASE WHEN completed AND NOT observed THEN 1 ELSE 0 END)" if m in _M else "0"
        parts.append(
            f"SELECT gameday, '{m}' AS measure, {base} AS base, "
            f"COALESCE(sum(CASE WHEN completed{seen} THEN {m} END), 0.0) AS x, "
            f"count(CASE WHEN completed{seen} THEN {m} END) AS r, {imputed} AS k FROM team_rows GROUP BY 1"
        )
    return " UNION ALL ".join(parts)


SQL_BINDINGS["day_totals"] = (
    ("team_rows",),
    f"SELECT *, dense_rank() OVER (ORDER BY gameday) AS i FROM ({_day_totals()})",
)
# The league history folded day by day, the way it is defined.
SQL_BINDINGS["fold"] = (
    ("day_totals",),
    """SELECT measure, i, 0.0::DOUBLE AS s, 0.0::DOUBLE AS n FROM day_totals WHERE i = 1
    UNION ALL SELECT f.measure, f.i + 1, f.s + t.x + t.k * CASE WHEN f.n > 0 THEN f.s / f.n ELSE t.base END,
    f.n + t.r + t.k FROM fold f JOIN day_totals t ON t.i = f.i AND t.measure = f.measure""",
)
SQL_BINDINGS["priors_long"] = (
    ("fold",),
    """SELECT t.gameday, t.measure, CASE WHEN f.n > 0 THEN f.s / f.n ELSE t.base END AS prior
    FROM fold f JOIN day_totals t ON t.i = f.i AND t.measure = f.measure""",
)
SQL_BINDINGS["priors"] = (
    ("priors_long",),
    "SELECT gameday, "
    + ", ".join(f"max(CASE WHEN measure = '{m}' THEN prior END) AS prior_{m}" for m in _PRIORS)
    + " FROM priors_long GROUP BY 1",
)
SQL_BINDINGS["filled"] = (
    ("team_rows", "priors"),
    "SELECT t.* REPLACE ("
    + ", ".join(
        f"CASE WHEN observed THEN {m} WHEN completed THEN prior_{m} END AS {m}" for m in _M
    )
    + "), p.* EXCLUDE (gameday) FROM team_rows t JOIN priors p USING (gameday)",
)


def _state_sql() -> str:
    parts = []
    for m, (length, _) in form.ROLLING.items():
        parts.append(f"sum({m}) OVER w{length} AS s_{m}, count({m}) OVER w{length} AS n_{m}")
    for m in ("margin", "off_epa"):
        parts.append(f"stddev_samp({m}) OVER w8 AS sd_{m}, count({m}) OVER w8 AS n8_{m}")
    parts.append("list(primary_qb) FILTER (WHERE primary_qb IS NOT NULL) OVER w4 AS passers")
    return (
        f"SELECT team, gameday, row_number() OVER (PARTITION BY team ORDER BY gameday, game_id) AS seq, {', '.join(parts)} "
        "FROM filled WHERE completed WINDOW "
        "w4 AS (PARTITION BY team ORDER BY gameday, game_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), "
        "w8 AS (PARTITION BY team ORDER BY gameday, game_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"
    )


SQL_BINDINGS["states"] = (("filled",), _state_sql())


def _features_sql(prior) -> str:
    parts = [
        f"(COALESCE(s_{m}, 0) + 2 * {prior(m)}) / (COALESCE(n_{m}, 0) + 2) AS {name}"
        for m, (_, name) in form.ROLLING.items()
    ]
    for m, name, base in (
        ("margin", "margin_volatility_l8", form.MARGIN_VOLATILITY_PRIOR),
        ("off_epa", "off_epa_volatility_l8", form.EPA_VOLATILITY_PRIOR),
    ):
        parts.append(
            f"CASE WHEN COALESCE(n8_{m}, 0) < 2 THEN {base} ELSE (sd_{m} * n8_{m} + 2 * {base}) / (n8_{m} + 2) END AS {name}"
        )
    parts.append(
        "CASE WHEN COALESCE(len(passers), 0) < 2 THEN 0.5 ELSE 1.0 - list_sum(list_transform("
        "range(2, len(passers) + 1), lambda j: CASE WHEN passers[j] <> passers[j - 1] THEN 1 ELSE 0 END))"
        " / (len(passers) - 1) END AS qb_continuity_l4"
    )
    return ", ".join(parts)


SQL_BINDINGS["team_asof"] = (
    ("filled", "states"),
    f"""SELECT f.game_id, f.side, f.team, s.seq, CAST(s.gameday AS VARCHAR) AS seen_day,
    CAST(COALESCE(least(f.gameday - s.gameday, 21), 7) AS DOUBLE) AS rest_days,
    {_features_sql(lambda m: 'f.prior_' + m)}
    FROM filled f ASOF LEFT JOIN states s ON f.team = s.team AND f.gameday > s.gameday""",
)

_SUMMARY_SPEC = "game_id:i team:s " + " ".join(f"{m}:d" for m in _M)


@query(
    "a15_regular_season",
    "game_id:i gameday:s home_team:s",
    "SELECT game_id, gameday, home_team FROM games WHERE game_type = 'REG'",
    "games",
)
def _(t):
    return play_ops.regular_season(t.games)


@query(
    "b01_play_flags",
    "game_id:i posteam:s is_scrimmage:i is_dropback:i is_pressure:i is_sack:i is_early_down:i "
    "is_explosive:i is_neutral:i play_success:d play_turnovers:d",
    """SELECT game_id, posteam, scrim AS is_scrimmage, qb_dropback AS is_dropback, press AS is_pressure,
    sck AS is_sack, early AS is_early_down, expl AS is_explosive, neut AS is_neutral, succ AS play_success,
    interception + fumble_lost AS play_turnovers FROM flags""",
    "flags",
)
def _(t):
    return play_ops.play_flags(t.plays)


@query("c01_game_team_summary", _SUMMARY_SPEC, "SELECT * FROM summary", "summary")
def _(t):
    return play_ops.game_team_summary(t.plays)


@query(
    "c02_primary_passer", "game_id:i team:s primary_qb:s", "SELECT * FROM passers", "passers"
)
def _(t):
    return play_ops.game_team_summary(t.plays).where(F.col("primary_qb").isNotNull())


_STATE_SPEC = "game_id:i side:s "


def _states(t):
    return form.team_states(t.games, t.plays, plays_by="side")


def _as_of(t):
    return form.team_features_as_of(_states(t))


@query(
    "d01_rolling_shrunk_means",
    _STATE_SPEC + "points_for_l4:d points_against_l4:d off_epa_l4:d win_pct_l8:d",
    "SELECT * FROM team_asof",
    "team_asof",
)
def _(t):
    return _as_of(t)


@query(
    "d02_rolling_volatility",
    _STATE_SPEC + "margin_volatility_l8:d off_epa_volatility_l8:d",
    "SELECT * FROM team_asof",
    "team_asof",
)
def _(t):
    return _as_of(t)


@query("d03_passer_continuity", _STATE_SPEC + "qb_continuity_l4:d", "SELECT * FROM team_asof", "team_asof")
def _(t):
    return _as_of(t)


@query(
    "d04_team_state",
    _STATE_SPEC + " ".join(f"{n}:d" for n in form.STATE_FEATURES),
    "SELECT * FROM team_asof",
    "team_asof",
)
def _(t):
    return _as_of(t)


@query(
    "d05_league_priors",
    "gameday:s " + " ".join(f"prior_{m}:d" for m in _PRIORS),
    "SELECT * FROM priors",
    "priors",
)
def _(t):
    from ..operators.plays import game_team_summary, regular_season

    rows = form.team_games(regular_season(t.games), game_team_summary(t.plays), plays_by="side")
    return form.league_priors(rows)


@query(
    "d06_day_batched_visibility",
    "game_id:i side:s seen_games:i seen_day:s",
    "SELECT game_id, side, COALESCE(seq, 0) AS seen_games, seen_day FROM team_asof",
    "team_asof",
)
def _(t):
    from pyspark.sql import Window

    before = Window.partitionBy("team").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    return _states(t).select(
        "game_id",
        "side",
        F.coalesce(F.max(F.when(F.col("completed"), F.col("seq"))).over(before), F.lit(0)).alias(
            "seen_games"
        ),
        F.max(F.when(F.col("completed"), F.col("gameday"))).over(before).alias("seen_day"),
    )


@query("d07_rest_days", "game_id:i side:s rest_days:d", "SELECT * FROM team_asof", "team_asof")
def _(t):
    return _as_of(t)


def _paired_sql(names) -> str:
    return ", ".join(
        f"max(CASE WHEN side = '{side}' THEN {n} END) AS {side}_{n}"
        for side in ("home", "away")
        for n in names
    )


_GAME_NAMES = [f"{s}_{n}" for s in ("home", "away") for n in ["rest_days", *form.STATE_FEATURES]]
_GAME_SPEC = (
    "game_id:i season:i week:i home_team:s away_team:s "
    + " ".join(f"{n}:d" for n in _GAME_NAMES)
    + " rest_advantage:d division_game:d home_field:d home_margin:d total_points:d"
)
SQL_BINDINGS["features"] = (
    ("games", "team_asof"),
    f"""SELECT g.*, p.* EXCLUDE (game_id), home_rest_days - away_rest_days AS rest_advantage,
    CASE WHEN neutral_site THEN 0.0 ELSE 1.0 END AS home_field, home_score - away_score AS home_margin,
    home_score + away_score AS total_points FROM games g JOIN (SELECT game_id,
    {_paired_sql(['rest_days', *form.STATE_FEATURES])} FROM team_asof GROUP BY 1) p USING (game_id)""",
)


@query("d09_point_in_time_game_features", _GAME_SPEC, "SELECT * FROM features", "features")
def game_features_all(t, features=None):
    return form.game_features(t.games, t.plays, include_unplayed=True, plays_by="side", features=features)


@query(
    "d09_completed_game_features",
    _GAME_SPEC,
    "SELECT * FROM features WHERE home_score IS NOT NULL",
    "features",
)
def game_features_completed(t, features=None):
    return form.game_features(t.games, t.plays, plays_by="side", features=features)


@query(
    "d10_team_snapshot",
    "team:s " + " ".join(f"{n}:d" for n in form.STATE_FEATURES),
    f"""SELECT team, {_features_sql(lambda m: str(_PRIORS[m]))} FROM states
    QUALIFY row_number() OVER (PARTITION BY team ORDER BY seq DESC) = 1""",
    "states",
)
def _(t):
    return form.team_snapshot(_states(t))


@query(
    "b04_site_and_division",
    "game_id:i division_game:d home_field:d",
    """SELECT game_id, CASE WHEN h.division = a.division THEN 1.0 ELSE 0.0 END AS division_game,
    CASE WHEN neutral_site THEN 0.0 ELSE 1.0 END AS home_field FROM games
    LEFT JOIN (SELECT DISTINCT home_team AS team, substr(home_team, 2, 1) || right(home_team, 1) AS division FROM games WHERE right(home_team, 1) <> '7') h ON h.team = home_team
    LEFT JOIN (SELECT DISTINCT home_team AS team, substr(home_team, 2, 1) || right(home_team, 1) AS division FROM games WHERE right(home_team, 1) <> '7') a ON a.team = away_team""",
    "games",
)
def _(t):
    team = F.col("home_team")
    divisions = (
        t.games.where(F.right(team, F.lit(1)) != "7")
        .select(
            team.alias("team"),
            F.concat(F.substring(team, 2, 1), F.right(team, F.lit(1))).alias("division"),
        )
        .distinct()
    )
    flagged = form.with_division(t.games.drop("division_game"), divisions)
    return flagged.withColumn("home_field", F.when(F.col("neutral_site"), 0.0).otherwise(1.0))


@query(
    "g09_game_baselines",
    "game_id:i baseline_margin:d baseline_total:d",
    """SELECT game_id, (home_points_for_l4 - home_points_against_l4) - (away_points_for_l4 - away_points_against_l4)
    + 1.5 * home_field AS baseline_margin,
    (home_points_for_l4 + away_points_for_l4 + home_points_against_l4 + away_points_against_l4) / 2 AS baseline_total
    FROM features""",
    "features",
)
def _(t):
    return form.game_baselines(game_features_all(t))
