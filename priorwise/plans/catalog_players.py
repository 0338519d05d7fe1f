"""Registered queries: player logs, rolling player features, rosters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, players, roster
from .bindings import SQL_BINDINGS
from .catalog_form import game_features_all
from .registry import query

# --- player logs -------------------------------------------------------------------------------

_CLUB = """CASE WHEN l.posteam = 'home' THEN home_team ELSE away_team END"""
_OTHER = """CASE WHEN l.posteam = 'home' THEN away_team ELSE home_team END"""


def _log_sql(role: str, where: str, aggregates: str) -> str:
    return f"""SELECT g.season, g."week", l.game_id, g.gameday AS game_date, {_CLUB} AS posteam, {_OTHER} AS defteam,
    {_CLUB} || '-' || l.{role}_player_id AS player_id, {aggregates} FROM plays l JOIN games g ON g.game_id = l.game_id
    WHERE l.season_type = 'REG' AND {where} AND l.{role}_player_id IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6, 7"""


SQL_BINDINGS["passing"] = (
    ("plays", "games"),
    _log_sql(
        "passer",
        "pass_attempt = 1",
        """sum(CASE WHEN complete_pass = 1 THEN yards_gained ELSE 0 END) AS passing_yards,
        CAST(sum(pass_attempt) AS DOUBLE) AS attempts, CAST(sum(complete_pass) AS DOUBLE) AS completions,
        CAST(sum(pass_touchdown) AS DOUBLE) AS passing_tds, CAST(sum(interception) AS DOUBLE) AS interceptions""",
    ),
)
SQL_BINDINGS["receiving"] = (
    ("plays", "games"),
    f"""SELECT *, sum(targets) OVER (PARTITION BY game_id, posteam) AS team_targets FROM ({_log_sql(
        'receiver', 'pass_attempt = 1',
        '''sum(CASE WHEN complete_pass = 1 THEN yards_gained ELSE 0 END) AS receiving_yards,
        CAST(count(*) AS DOUBLE) AS targets, CAST(sum(complete_pass) AS DOUBLE) AS receptions,
        CAST(sum(pass_touchdown) AS DOUBLE) AS receiving_tds''')})""",
)
SQL_BINDINGS["rushing"] = (
    ("plays", "games"),
    _log_sql(
        "rusher",
        "rush_attempt = 1 AND qb_kneel <> 1 AND qb_spike <> 1",
        """sum(yards_gained) AS rushing_yards, CAST(count(*) AS DOUBLE) AS carries,
        CAST(sum(rush_touchdown) AS DOUBLE) AS rushing_tds""",
    ),
)

LOGS = {
    "passing": players.passing_log,
    "receiving": players.receiving_log,
    "rushing": players.rushing_log,
}


def club_log(t, kind: str):
    return players.attach_clubs(LOGS[kind](t.plays), t.games)


def _register_log(code: str, kind: str) -> None:
    extra = ["team_targets"] if kind == "receiving" else []
    spec = "season:i week:i game_id:i posteam:s defteam:s player_id:s " + " ".join(
        f"{c}:d" for c in [*players.STATS[kind], *extra]
    )

    @query(f"{code}_{kind}_log", spec, f"SELECT * FROM {kind}", kind)
    def _(t):
        return club_log(t, kind)


for _code, _kind in (("c03", "passing"), ("c04", "receiving"), ("c05", "rushing")):
    _register_log(_code, _kind)


# --- rolling player features -------------------------------------------------------------------

def weighted_sql(stat: str, k: int, order: str, key: str = "player_id") -> str:
    """Recency-weighted mean of the k rows before, as a list expression over a window."""
    held = f"list({stat}) OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    return held


def _rolled_sql(source: str, stats, windows, order: str) -> str:
    lists = ", ".join(f"{weighted_sql(s, k, order)} AS h_{s}_{k}" for s in stats for k in windows)
    clean = ", ".join(
        f"list_filter(h_{s}_{k}, lambda x: x IS NOT NULL) AS v_{s}_{k}" for s in stats for k in windows
    )

    def mean(name: str) -> str:
        v = f"v_{name}"
        w = f"exp(CASE WHEN len({v}) > 1 THEN (j - 1.0) / (len({v}) - 1) ELSE 0 END - 1.0)"
        return (
            f"CASE WHEN len({v}) > 0 THEN list_sum(list_transform(range(1, len({v}) + 1), lambda j: {v}[j] * {w}))"
            f" / list_sum(list_transform(range(1, len({v}) + 1), lambda j: {w})) END"
        )

    means = ", ".join(f"{mean(f'{s}_{k}')} AS {s}_l{k}" for s in stats for k in windows)
    return f"SELECT *, {means} FROM (SELECT *, {clean} FROM (SELECT *, {lists} FROM {source}))"


@query(
    "d16_shifted_rolling",
    "player_id:i game_id:i stat_l4:d stat_l8:d load_l4:d load_l8:d",
    _rolled_sql("player_log", ["stat", "load"], (4, 8), "ts, game_id"),
    "player_log",
)
def _(t):
    return history.shifted_rolling(
        t.player_log, ["stat", "load"], order=("ts", "game_id"), block=F.to_date("ts")
    )


SQL_BINDINGS["rushing_shared"] = (
    ("rushing",),
    "SELECT *, carries / sum(carries) OVER (PARTITION BY game_id) AS snap_share FROM rushing",
)
SQL_BINDINGS["passing_shared"] = (("passing",), "SELECT *, NULL::DOUBLE AS snap_share FROM passing")
SQL_BINDINGS["receiving_shared"] = (
    ("receiving",),
    "SELECT *, NULL::DOUBLE AS snap_share FROM receiving",
)


def _safe(top: str, bottom: str, default: float) -> str:
    return f"COALESCE({top} / nullif({bottom}, 0), {default})"


_RATIO_SQL = {
    "passing": f"{_safe('completions_l4', 'attempts_l4', 0.62)} AS completion_pct_l4, COALESCE(snap_share_l4, 1.0) AS snap_filled",
    "receiving": f"{_safe('receptions_l4', 'targets_l4', 0.65)} AS catch_rate_l4, "
    f"{_safe('receiving_yards_l4', 'receptions_l4', 10.0)} AS yards_per_reception_l4, "
    f"{_safe('targets_l4', 'team_targets_l4', 0.1)} AS target_share_l4, "
    f"COALESCE(snap_share_l4, {_safe('targets_l4', 'team_targets_l4', 0.1)}) AS snap_filled",
    "rushing": f"{_safe('rushing_yards_l4', 'carries_l4', 4.1)} AS yards_per_carry_l4, COALESCE(snap_share_l4, 0.1) AS snap_filled",
}
for _kind in LOGS:
    _stats = players._rolled_stats(_kind)
    SQL_BINDINGS[f"{_kind}_rolled"] = (
        (f"{_kind}_shared",),
        f"SELECT * REPLACE (snap_filled AS snap_share_l4) FROM (SELECT *, {_RATIO_SQL[_kind]} FROM "
        f"({_rolled_sql(f'{_kind}_shared', _stats, (4, 8), 'game_date, game_id')}))",
    )


def _register_features(kind: str) -> None:
    names = [n for n in players.PLAYER_FEATURES[kind] if n != "opponent_def_epa"]
    spec = "game_id:i player_id:s " + " ".join(f"{n}:d" for n in names)

    @query(f"d17_{kind}_ratio_features", spec, f"SELECT * FROM {kind}_rolled", f"{kind}_rolled")
    def _(t):
        return players.player_features(club_log(t, kind), kind)


for _kind in LOGS:
    _register_features(_kind)

SQL_BINDINGS["rushing_forecast"] = (
    ("rushing_shared",),
    """SELECT * EXCLUDE (rn), FALSE AS is_forecast FROM (SELECT *, 1 AS rn FROM rushing_shared) UNION ALL BY NAME
    SELECT season, 99 AS "week", (SELECT max(game_date) FROM rushing_shared) + 8 AS game_date, posteam, defteam,
    player_id, NULL::DOUBLE AS rushing_yards, NULL::DOUBLE AS carries, NULL::DOUBLE AS rushing_tds,
    NULL::DOUBLE AS snap_share, NULL::BIGINT AS game_id, TRUE AS is_forecast FROM rushing_shared
    QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY game_date DESC, game_id DESC) = 1""",
)
SQL_BINDINGS["rushing_next"] = (
    ("rushing_forecast",),
    f"""SELECT * REPLACE (snap_filled AS snap_share_l4) FROM (SELECT *, {_RATIO_SQL['rushing']} FROM
    ({_rolled_sql('rushing_forecast', players._rolled_stats('rushing'), (4, 8), 'game_date, is_forecast, game_id')}))
    WHERE is_forecast""",
)


@query(
    "d18_forecast_rows",
    "player_id:s posteam:s week:i game_date:s rushing_yards_l4:d rushing_yards_l8:d carries_l4:d yards_per_carry_l4:d snap_share_l4:d",
    "SELECT * FROM rushing_next",
    "rushing_next",
)
def _(t):
    return players.forecast_rows(club_log(t, "rushing"), "rushing")


@query(
    "d20_within_game_shares",
    "game_id:i player_id:s carry_share:d target_share:d",
    """SELECT game_id, player_id, carries / sum(carries) OVER (PARTITION BY game_id) AS carry_share,
    NULL::DOUBLE AS target_share FROM rushing UNION ALL
    SELECT game_id, player_id, NULL::DOUBLE, targets / team_targets FROM receiving""",
    "rushing receiving",
)
def _(t):
    rush, catch = club_log(t, "rushing"), club_log(t, "receiving")
    none = F.lit(None).cast("double")
    return rush.select(
        "game_id",
        "player_id",
        players.within_game_share(rush, "carries", 0.1, keys=["game_id"]).alias("carry_share"),
        none.alias("target_share"),
    ).unionByName(
        catch.select(
            "game_id",
            "player_id",
            none.alias("carry_share"),
            players.safe_divide(F.col("targets"), F.col("team_targets"), 0.1).alias("target_share"),
        )
    )


SQL_BINDINGS["opponent"] = (
    ("rushing", "features"),
    """SELECT r.*, CASE WHEN r.posteam = f.home_team THEN f.away_def_epa_l4 ELSE f.home_def_epa_l4 END AS opponent_def_epa
    FROM rushing r LEFT JOIN features f USING (game_id)""",
)


@query(
    "e01_opponent_defence",
    "game_id:i player_id:s carries:d opponent_def_epa:d",
    "SELECT * FROM opponent",
    "opponent",
)
def _(t):
    return players.attach_opponent_defence(club_log(t, "rushing"), game_features_all(t))


# --- rosters -----------------------------------------------------------------------------------

SQL_BINDINGS["crosswalk"] = (
    ("rosters",),
    """SELECT season, pfr_id, gsis_id FROM rosters
    QUALIFY row_number() OVER (PARTITION BY season, pfr_id ORDER BY "week" DESC, gsis_id DESC) = 1""",
)


@query("e02_id_crosswalk", "season:i pfr_id:s gsis_id:s", "SELECT * FROM crosswalk", "crosswalk")
def _(t):
    return players.id_crosswalk(t.rosters)


def _field_snaps(t):
    """Snap counts with a game (200 consecutive events) and a share, so that they can meet the logs."""
    return t.snaps.select(
        "season",
        "week",
        F.floor(F.col("event_id") / 200).alias("game_id"),
        "team",
        "pfr_player_id",
        "position",
        (F.col("offense_snaps") / 100.0).alias("offense_pct"),
    )


def _event_log(t):
    """Receiving log of the same players; some of them never were on the field by the snaps."""
    day = F.dayofmonth("ts")
    return (
        t.read("events")
        .where("event_type <> 'view'")  # a view is a snap without a target
        .select(
            F.when(day <= 15, 2023).otherwise(2024).alias("season"),
            (F.floor((day - 1) / 7) + 1).cast("int").alias("week"),
            F.floor(F.col("event_id") / 200).alias("game_id"),
            F.lit("2024-01-01").cast("date").alias("game_date"),
            (F.col("user_id") % 8).cast("string").alias("posteam"),
            F.concat(F.lit("g"), F.col("user_id")).alias("player_id"),
            F.concat(F.lit("p"), F.col("user_id")).alias("player_name"),
            "value",
        )
        .groupBy("season", "week", "game_id", "game_date", "posteam", "player_id", "player_name")
        .agg(
            F.sum("value").alias("receiving_yards"),
            F.count(F.lit(1)).cast("double").alias("targets"),
            F.lit(1.0).alias("receptions"),
            F.lit(0.0).alias("receiving_tds"),
        )
    )


@query(
    "e03_participation_spine",
    "season:i week:i game_id:i posteam:s player_id:s player_name:s snap_share:d receiving_yards:d targets:d receptions:d team_targets:d",
    """SELECT season, "week", game_id, posteam, player_id, COALESCE(player_name, roster_name) AS player_name,
    COALESCE(snap_share, 0) AS snap_share, COALESCE(receiving_yards, 0) AS receiving_yards,
    COALESCE(targets, 0) AS targets, COALESCE(receptions, 0) AS receptions,
    sum(COALESCE(targets, 0)) OVER (PARTITION BY game_id, posteam) AS team_targets FROM
    (SELECT s.season, s."week", s.event_id // 200 AS game_id, s.team AS posteam, c.gsis_id AS player_id,
      max(c.gsis_id) AS roster_name, max(s.offense_snaps / 100.0) AS snap_share FROM snaps s JOIN crosswalk c
      ON c.season = s.season AND c.pfr_id = s.pfr_player_id WHERE s.offense_snaps > 0 AND s.position = 'WR'
      GROUP BY 1, 2, 3, 4, 5) f
    FULL OUTER JOIN (SELECT CASE WHEN day(ts) <= 15 THEN 2023 ELSE 2024 END AS season, (day(ts) - 1) // 7 + 1 AS "week",
      event_id // 200 AS game_id, CAST(user_id % 8 AS VARCHAR) AS posteam, 'g' || user_id AS player_id,
      'p' || user_id AS player_name, sum("value") AS receiving_yards, CAST(count(*) AS DOUBLE) AS targets,
      1.0 AS receptions FROM events WHERE event_type <> 'view' GROUP BY 1, 2, 3, 4, 5, 6) l
    USING (season, "week", game_id, posteam, player_id)""",
    "snaps crosswalk",
)
def _(t):
    dates = _field_snaps(t).select("game_id", F.lit("2024-01-01").cast("date").alias("game_date"))
    spine = players.snap_spine(_field_snaps(t), t.rosters, dates.distinct())
    return players.participation(_event_log(t), spine, "receiving")


SQL_BINDINGS["opening"] = (
    ("rosters",),
    """SELECT DISTINCT season, team, 'pfr:' || pfr_id AS player_id FROM rosters r
    WHERE "week" = (SELECT min("week") FROM rosters q WHERE q.season = r.season) AND status <> 'CUT'""",
)
SQL_BINDINGS["snap_totals"] = (
    ("snaps",),
    """SELECT season, team, 'pfr:' || pfr_player_id AS player_id, position, sum(offense_snaps) AS offense_snaps,
    sum(defense_snaps) AS defense_snaps FROM snaps GROUP BY 1, 2, 3, 4""",
)


def _share_sql(column: str, rows: str) -> str:
    return (
        f"CASE WHEN sum(CASE WHEN {rows} THEN {column} ELSE 0 END) > 0 THEN "
        f"sum(CASE WHEN {rows} AND back THEN {column} ELSE 0 END) / sum(CASE WHEN {rows} THEN {column} ELSE 0 END) END"
    )


SQL_BINDINGS["raw_transitions"] = (
    ("opening", "snap_totals"),
    f"""SELECT b.season, b.team, {_share_sql('offense_snaps', 'true')} AS roster_offense_continuity,
    {_share_sql('defense_snaps', 'true')} AS roster_defense_continuity,
    any_value(q.returning) AS roster_qb_returning,
    {_share_sql('offense_snaps', "position = 'OL'")} AS roster_ol_continuity,
    {_share_sql('offense_snaps', "position = 'WR'")} AS roster_skill_continuity,
    {_share_sql('defense_snaps', "position = 'LB'")} AS roster_front_continuity,
    {_share_sql('defense_snaps', "position = 'CB'")} AS roster_secondary_continuity,
    CASE WHEN sum(offense_snaps) > 0 THEN least(COALESCE(any_value(a.o), 0) / sum(offense_snaps), 1) END AS roster_incoming_offense_share,
    CASE WHEN sum(defense_snaps) > 0 THEN least(COALESCE(any_value(a.d), 0) / sum(defense_snaps), 1) END AS roster_incoming_defense_share
    FROM (SELECT s.season + 1 AS season, s.team, s.player_id, position, offense_snaps, defense_snaps, o.player_id IS NOT NULL AS back
      FROM snap_totals s LEFT JOIN opening o ON o.season = s.season + 1 AND o.team = s.team AND o.player_id = s.player_id) b
    LEFT JOIN (SELECT s.season + 1 AS season, s.team, CASE WHEN o.player_id IS NOT NULL THEN 1.0 ELSE 0.0 END AS returning
      FROM snap_totals s LEFT JOIN opening o ON o.season = s.season + 1 AND o.team = s.team AND o.player_id = s.player_id
      WHERE position = 'QB' AND offense_snaps > 0
      QUALIFY row_number() OVER (PARTITION BY s.season, s.team ORDER BY offense_snaps DESC, s.player_id) = 1) q
      ON q.season = b.season AND q.team = b.team
    LEFT JOIN (SELECT o.season, o.team, sum(offense_snaps) AS o, sum(defense_snaps) AS d FROM opening o JOIN snap_totals s
      ON s.season + 1 = o.season AND s.player_id = o.player_id AND s.team <> o.team GROUP BY 1, 2) a
      ON a.season = b.season AND a.team = b.team
    WHERE (b.season, b.team) IN (SELECT season, team FROM opening) GROUP BY 1, 2""",
)
_RAW = roster.RAW_FEATURES
SQL_BINDINGS["transitions"] = (
    ("raw_transitions",),
    "SELECT season, team, "
    + ", ".join(
        f"COALESCE({f}, avg({f}) OVER (PARTITION BY season)) AS {f}, "
        f"COALESCE({f} - avg({f}) OVER (PARTITION BY season), 0) AS {f}_delta"
        for f in _RAW
    )
    + " FROM raw_transitions",
)


@query(
    "c06_player_snaps",
    "season:i team:s player_id:s position:s offense_snaps:d defense_snaps:d",
    "SELECT * FROM snap_totals",
    "snap_totals",
)
def _(t):
    return roster.player_snaps(t.snaps)


@query("e09_opening_roster", "season:i team:s player_id:s", "SELECT * FROM opening", "opening")
def _(t):
    return roster.opening_rosters(t.rosters)


@query(
    "e07_roster_continuity",
    "season:i team:s " + " ".join(f"{f}:d" for f in _RAW),
    "SELECT * FROM raw_transitions",
    "raw_transitions",
)
def _(t):
    return roster.raw_transitions(roster.opening_rosters(t.rosters), roster.player_snaps(t.snaps))


@query(
    "e08_incoming_veterans",
    "season:i team:s roster_incoming_offense_share:d roster_incoming_defense_share:d",
    "SELECT * FROM raw_transitions",
    "raw_transitions",
)
def _(t):
    return roster.raw_transitions(roster.opening_rosters(t.rosters), roster.player_snaps(t.snaps))


@query(
    "d21_league_centred_delta",
    "season:i team:s " + " ".join(f"{f}:d {f}_delta:d" for f in _RAW),
    "SELECT * FROM transitions",
    "transitions",
)
def _(t):
    return roster.transition_table(t.rosters, t.snaps)


def roster_games(t):
    """Games whose clubs are the eight roster teams of the opening season."""
    return t.games.select(
        "game_id",
        F.lit(2024).alias("season"),
        "week",
        (F.col("game_id") % 8).cast("string").alias("home_team"),
        ((F.col("game_id") + 3) % 9).cast("string").alias("away_team"),
    )


@query(
    "e10_roster_features_attached",
    "game_id:i " + " ".join(f"{s}_{f}:d" for s in ("home", "away") for f in roster.DELTA_FEATURES),
    "SELECT g.game_id, "
    + ", ".join(
        f"COALESCE({s[0]}.{f} * least(greatest(1.25 - 0.25 * greatest(\"week\", 1), 0), 1), 0) AS {s}_{f}"
        for s in ("home", "away")
        for f in roster.DELTA_FEATURES
    )
    + """ FROM (SELECT *, CAST(game_id % 8 AS VARCHAR) AS ht, CAST((game_id + 3) % 9 AS VARCHAR) AS at_ FROM games) g
    LEFT JOIN transitions h ON h.season = 2024 AND h.team = g.ht
    LEFT JOIN transitions a ON a.season = 2024 AND a.team = g.at_""",
    "games transitions",
)
def _(t):
    return roster.attach_transitions(roster_games(t), roster.transition_table(t.rosters, t.snaps))


@query(
    "e19_roster_snapshot",
    "team:s " + " ".join(f"{f}:d" for f in [*_RAW, *roster.DELTA_FEATURES]),
    "SELECT * FROM transitions WHERE season = (SELECT max(season) FROM rosters)",
    "transitions rosters",
)
def _(t):
    return roster.season_snapshot(roster.transition_table(t.rosters, t.snaps), t.rosters)


SQL_BINDINGS["current_roster"] = (
    ("rosters",),
    """SELECT gsis_id AS player_id, team, season AS roster_season FROM (SELECT * FROM rosters
    WHERE season = (SELECT max(season) FROM rosters)
    QUALIFY row_number() OVER (PARTITION BY gsis_id ORDER BY "week" DESC, team DESC, status DESC) = 1)
    WHERE status IN ('ACT', 'INA')""",
)


def unique_rosters(t):
    """One status per (player, week), so that the latest row is well defined."""
    return t.rosters.groupBy("season", "week", "team", "pfr_id", "gsis_id").agg(
        F.max("status").alias("status")
    )


@query(
    "e14_current_roster",
    "player_id:s team:s roster_season:i",
    "SELECT * FROM current_roster",
    "current_roster",
)
def _(t):
    return players.current_roster(unique_rosters(t))
