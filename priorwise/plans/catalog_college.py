"""Registered queries: college feeds, Elo, form, preseason and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import college
from ..sources import college as feeds
from . import jobs
from .bindings import SQL_BINDINGS, Tables
from .registry import query

AS_OF = "2000-06-30"

# --- raw feeds: JSON text built from the tables, with bad numbers, repeats and gaps ----------------


def _raw(df: DataFrame, ordinal: str, **fields: str) -> DataFrame:
    record = F.struct(*[F.expr(sql).alias(name) for name, sql in fields.items()])
    return df.select(F.col(ordinal).alias("ordinal"), F.to_json(record).alias("raw"))


def raw_teams(t: Tables) -> DataFrame:
    return _raw(
        t.read("supplier"),
        "s_suppkey",
        id="CASE WHEN s_suppkey % 17 = 0 THEN 'n/a' ELSE CAST(s_suppkey % 70 AS STRING) END",
        school="s_name",
        conference="CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE concat('C', s_nationkey) END",
        logos="CASE WHEN s_suppkey % 4 = 0 THEN array() ELSE array(concat('logo', s_suppkey), 'other') END",
    )


@query(
    "a04_normalize_teams",
    "team_id:i school:s conference:s logo:s",
    """SELECT s_suppkey % 70 AS team_id, s_name AS school, CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE 'C' || s_nationkey END AS conference,
    CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'logo' || s_suppkey END AS logo FROM supplier WHERE s_suppkey % 17 <> 0
    QUALIFY row_number() OVER (PARTITION BY s_suppkey % 70 ORDER BY s_suppkey) = 1""",
)
def _(t):
    return feeds.normalize_teams(raw_teams(t))


def raw_games(t: Tables) -> DataFrame:
    return _raw(
        t.read("orders"),
        "o_orderkey",
        id="CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE CAST(o_orderkey - CASE WHEN o_orderkey % 10 = 9 THEN 1 ELSE 0 END AS STRING) END",
        season="year(o_orderdate)",
        week="CASE WHEN o_custkey % 50 = 1 THEN 'bowl' ELSE CAST(floor((dayofyear(o_orderdate) - 1) / 7) + 1 AS STRING) END",
        startDate="CASE WHEN o_custkey % 60 = 2 THEN 'TBD' ELSE date_format(o_orderdate, \"yyyy-MM-dd'T'17:30:00'Z'\") END",
        homeId="o_custkey",
        homeTeam="concat('T', o_custkey % 100)",
        homeClassification="CASE WHEN o_custkey % 5 = 0 THEN 'fcs' ELSE 'fbs' END",
        awayTeam="concat('T', o_orderkey % 100)",
        awayClassification="CASE WHEN o_orderkey % 7 = 0 THEN 'fcs' ELSE 'fbs' END",
        completed="o_orderstatus = 'F'",
        homePoints="CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS STRING) ELSE '-' END",
    )


@query(
    "a05_normalize_games",
    "game_id:i season:i week:i start_date:s home_id:i home_team:s away_team:s completed:i home_points:d fbs_vs_fbs:i",
    """SELECT o_orderkey - CASE WHEN o_orderkey % 10 = 9 THEN 1 ELSE 0 END AS game_id, year(o_orderdate) AS season,
    CASE WHEN o_custkey % 50 <> 1 THEN (dayofyear(o_orderdate) - 1) // 7 + 1 END AS "week",
    CASE WHEN o_custkey % 60 <> 2 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 17:30:00' END AS start_date,
    o_custkey AS home_id, 'T' || o_custkey % 100 AS home_team, 'T' || o_orderkey % 100 AS away_team,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS completed, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS home_points,
    CASE WHEN o_custkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN 1 ELSE 0 END AS fbs_vs_fbs FROM orders WHERE o_orderkey % 101 <> 0
    QUALIFY row_number() OVER (PARTITION BY o_orderkey - CASE WHEN o_orderkey % 10 = 9 THEN 1 ELSE 0 END ORDER BY o_orderkey) = 1""",
)
def _(t):
    return feeds.normalize_games(raw_games(t))


@query(
    "a06_normalize_calendar",
    "season:i week:i season_type:s start_date:s end_date:s",
    """SELECT year(o_orderdate) AS season, (dayofyear(o_orderdate) - 1) // 7 + 1 AS "week", 'regular' AS season_type,
    strftime(min(o_orderdate), '%Y-%m-%d') || ' 07:00:00' AS start_date, NULL AS end_date FROM orders GROUP BY 1, 2""",
)
def _(t):
    weeks = t.read("orders").groupBy(
        F.year("o_orderdate").alias("y"),
        (F.floor((F.dayofyear("o_orderdate") - 1) / 7) + 1).alias("w"),
    ).agg(F.min("o_orderdate").alias("first"))
    raw = _raw(
        weeks,
        "w",
        season="CAST(y AS STRING)",
        week="w",
        seasonType="'regular'",
        startDate="date_format(first, \"yyyy-MM-dd'T'07:00:00'Z'\")",
        endDate="'later'",
    )
    return feeds.normalize_calendar(raw)


@query(
    "a07_normalize_advanced",
    "game_id:i team:s off_ppa:d off_success_rate:d off_plays:d def_ppa:d def_explosiveness:d",
    """SELECT l_orderkey AS game_id, 'S' || l_linenumber % 2 AS team, l_discount AS off_ppa,
    CASE WHEN l_suppkey % 6 <> 0 THEN l_tax END AS off_success_rate, l_quantity AS off_plays,
    CASE WHEN l_partkey % 8 <> 0 THEN l_tax END AS def_ppa, CASE WHEN l_partkey % 8 <> 0 THEN l_quantity END AS def_explosiveness
    FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2
      ORDER BY l_partkey * 1000 + l_suppkey DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC) = 1""",
)
def _(t):
    items = t.read("lineitem").withColumn(
        "o", F.expr("struct(l_partkey * 1000 + l_suppkey, l_linenumber, l_quantity, l_extendedprice)")
    )
    raw = _raw(
        items,
        "o",
        gameId="l_orderkey",
        team="concat('S', l_linenumber % 2)",
        offense="named_struct('ppa', l_discount, 'successRate', CASE WHEN l_suppkey % 6 = 0 THEN 'NaN%' ELSE CAST(l_tax AS STRING) END, 'plays', l_quantity)",
        defense="CASE WHEN l_partkey % 8 <> 0 THEN named_struct('ppa', l_tax, 'explosiveness', l_quantity) END",
    )
    return feeds.normalize_advanced(raw)


_SEASON_TEAM = "year(o_orderdate) AS season, 'T' || o_custkey % 100 AS team"


@query(
    "a08_normalize_returning",
    "season:i team:s returning_ppa:d returning_usage:d",
    f"""SELECT {_SEASON_TEAM}, o_totalprice AS returning_ppa, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS returning_usage FROM orders
    QUALIFY row_number() OVER (PARTITION BY year(o_orderdate), o_custkey % 100 ORDER BY o_orderkey DESC) = 1""",
)
def _(t):
    raw = _raw(
        t.read("orders"),
        "o_orderkey",
        season="year(o_orderdate)",
        team="concat('T', o_custkey % 100)",
        percentPPA="o_totalprice",
        usage="CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey AS STRING) ELSE '?' END",
    )
    return feeds.normalize_returning(raw)


@query(
    "a09_normalize_portal",
    "season:i origin:s destination:s rating:d stars:d transfer_date:s",
    """SELECT year(o_orderdate) AS season, 'T' || o_custkey % 100 AS origin, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'T' || o_orderkey % 100 END AS destination,
    CASE WHEN o_custkey % 9 <> 0 THEN o_custkey % 100 / 100.0 END AS rating, o_custkey % 5 AS stars,
    strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' AS transfer_date FROM orders WHERE o_orderkey % 13 <> 0""",
)
def _(t):
    raw = _raw(
        t.read("orders"),
        "o_orderkey",
        season="CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE CAST(year(o_orderdate) AS STRING) END",
        origin="concat('T', o_custkey % 100)",
        destination="CASE WHEN o_orderkey % 4 <> 0 THEN concat('T', o_orderkey % 100) END",
        rating="CASE WHEN o_custkey % 9 = 0 THEN 'unrated' ELSE CAST(o_custkey % 100 / 100.0 AS STRING) END",
        stars="o_custkey % 5",
        transferDate="date_format(o_orderdate, 'yyyy-MM-dd')",
    )
    return feeds.normalize_portal(raw)


@query(
    "a10_normalize_talent_recruiting",
    "feed:s season:i team:s value:d rank:d",
    f"""SELECT 'talent' AS feed, {_SEASON_TEAM}, o_totalprice AS "value", NULL::DOUBLE AS rank FROM orders WHERE o_orderkey % 13 <> 0
    UNION ALL SELECT 'recruiting', {_SEASON_TEAM}, CASE WHEN o_custkey % 9 <> 0 THEN o_custkey END, o_orderkey % 130 FROM orders""",
)
def _(t):
    orders = t.read("orders")
    team = "concat('T', o_custkey % 100)"
    talent = feeds.normalize_talent(
        _raw(
            orders, "o_orderkey", team=team, talent="o_totalprice",
            year="CASE WHEN o_orderkey % 13 <> 0 THEN year(o_orderdate) END",
        )
    )
    recruiting = feeds.normalize_recruiting(
        _raw(
            orders, "o_orderkey", team=team, year="year(o_orderdate)", rank="o_orderkey % 130",
            points="CASE WHEN o_custkey % 9 = 0 THEN 'none' ELSE CAST(o_custkey AS STRING) END",
        )
    )
    return talent.select(
        F.lit("talent").alias("feed"), "season", "team", F.col("talent").alias("value"),
        F.lit(None).cast("double").alias("rank"),
    ).unionByName(
        recruiting.select(
            F.lit("recruiting").alias("feed"), "season", "team",
            F.col("recruiting_points").alias("value"), F.col("recruiting_rank").alias("rank"),
        )
    )


@query(
    "a11_normalize_lines",
    "game_id:i market_home_margin:d market_total:d market_provider_count:i",
    """SELECT game_id, -median(s) AS market_home_margin, median(o) AS market_total, any_value(n) AS market_provider_count FROM
    (SELECT l_orderkey // 2 AS game_id, CASE WHEN l_partkey % 10 = 0 THEN 0 ELSE 3 END AS n,
      unnest([CASE WHEN l_partkey % 10 <> 0 THEN l_quantity END, CASE WHEN l_partkey % 10 <> 0 AND l_suppkey % 4 <> 0 THEN l_quantity + 3 END]) AS s,
      unnest([NULL, CASE WHEN l_partkey % 10 <> 0 THEN l_tax * 100 END]) AS o FROM
      (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey // 2
        ORDER BY l_orderkey DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC, l_extendedprice DESC) = 1)) GROUP BY 1""",
)
def _(t):
    items = t.read("lineitem").withColumn(
        "o", F.expr("struct(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice)")
    )
    raw = _raw(
        items,
        "o",
        id="CAST(floor(l_orderkey / 2) AS BIGINT)",
        lines="CASE WHEN l_partkey % 10 <> 0 THEN array(named_struct('spread', CAST(l_quantity AS STRING), 'overUnder', 'n/a'), "
        "named_struct('spread', CASE WHEN l_suppkey % 4 <> 0 THEN CAST(l_quantity + 3 AS STRING) END, 'overUnder', CAST(l_tax * 100 AS STRING)), "
        "named_struct('spread', '', 'overUnder', NULL)) END",
    )
    return feeds.normalize_lines(raw)


# --- the schedule as college games ---------------------------------------------------------------

SQL_BINDINGS["cgames"] = (
    ("games",),
    """SELECT *, CAST(gameday AS TIMESTAMP) + to_hours(CAST(custkey % 24 AS INTEGER)) AS start_date,
    home_score AS home_points, away_score AS away_points, home_score IS NOT NULL AS completed,
    game_id % 3 = 0 AS conference_game FROM games""",
)


def college_games(t: Tables) -> DataFrame:
    start = F.col("gameday").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, CAST(custkey % 24 AS INT))")
    return t.games.withColumns(
        {
            "start_date": start,
            "home_id": F.col("home_team"),
            "away_id": F.col("away_team"),
            "home_points": F.col("home_score"),
            "away_points": F.col("away_score"),
            "completed": F.col("home_score").isNotNull(),
            "conference_game": F.col("game_id") % 3 == 0,
        }
    )


SQL_BINDINGS["eligible"] = (
    ("cgames",),
    """SELECT *, dense_rank() OVER (ORDER BY gameday) AS d,
    season - min(season) OVER () AS season_no FROM cgames WHERE fbs_vs_fbs""",
)
SQL_BINDINGS["elo_days"] = (("eligible",), "SELECT DISTINCT d, season_no FROM eligible")
SQL_BINDINGS["elo_rows"] = (
    ("eligible",),
    """SELECT d, home_team AS team, away_team AS opponent, CASE WHEN neutral_site THEN 0 ELSE 55 END AS edge,
    home_points - away_points AS m FROM eligible WHERE completed UNION ALL
    SELECT d, away_team, home_team, CASE WHEN neutral_site THEN 0 ELSE -55 END, away_points - home_points FROM eligible WHERE completed""",
)
# Ratings folded day by day: a team plays at most once a day, so a day is one parallel step.
SQL_BINDINGS["elo"] = (
    ("elo_days", "elo_rows"),
    """SELECT DISTINCT 0::BIGINT AS d, 0::BIGINT AS season_no, team, 1500.0::DOUBLE AS pre, 1500.0::DOUBLE AS post
    FROM (SELECT home_team AS team FROM eligible UNION SELECT away_team FROM eligible)
    UNION ALL SELECT n.d, n.season_no, a.team, a.post_r, a.post_r + CASE WHEN r.m IS NULL THEN 0 ELSE
      20 * ln(abs(r.m) + 1) * 2.2 / (abs(a.post_r - b.post_r) * 0.001 + 2.2)
      * ((sign(r.m) + 1) / 2 - 1 / (1 + pow(10.0, -(a.post_r - b.post_r + r.edge) / 400))) END
    FROM (SELECT e.*, n.d AS nd, CASE WHEN n.season_no > e.season_no THEN 1500 + 0.65 * (e.post - 1500) ELSE e.post END AS post_r
          FROM elo e JOIN elo_days n ON n.d = e.d + 1) a
    JOIN elo_days n ON n.d = a.d + 1
    LEFT JOIN elo_rows r ON r.d = n.d AND r.team = a.team
    LEFT JOIN (SELECT e.*, CASE WHEN n.season_no > e.season_no THEN 1500 + 0.65 * (e.post - 1500) ELSE e.post END AS post_r
          FROM elo e JOIN elo_days n ON n.d = e.d + 1) b ON b.team = r.opponent""",
)
SQL_BINDINGS["rated"] = (
    ("eligible", "elo"),
    """SELECT g.*, h.pre AS home_elo, a.pre AS away_elo, h.pre - a.pre AS elo_diff,
    CASE WHEN neutral_site THEN 0.0 ELSE 1.0 END AS home_field,
    (h.pre - a.pre + CASE WHEN neutral_site THEN 0 ELSE 55 END) / 25 AS elo_expected_margin,
    1 / (1 + pow(10.0, -(h.pre - a.pre + CASE WHEN neutral_site THEN 0 ELSE 55 END) / 400)) AS elo_home_probability
    FROM eligible g JOIN elo h ON h.d = g.d AND h.team = g.home_team JOIN elo a ON a.d = g.d AND a.team = g.away_team""",
)


@query(
    "b02_eligible_games",
    "game_id:i season:i week:i completed:i",
    "SELECT game_id, season, \"week\", CAST(completed AS INTEGER) AS completed FROM eligible",
    "eligible",
)
def _(t):
    return college.eligible_games(college_games(t), include_scheduled=True)


@query(
    "a14_as_of_cut",
    "game_id:i completed:i home_points:d has_advanced:i",
    f"""SELECT game_id, CASE WHEN completed AND start_date <= TIMESTAMP '{AS_OF}' THEN 1 ELSE 0 END AS completed,
    CASE WHEN start_date <= TIMESTAMP '{AS_OF}' THEN home_points END AS home_points,
    CASE WHEN start_date <= TIMESTAMP '{AS_OF}' AND game_id IN (SELECT game_id FROM cadvanced) THEN 1 ELSE 0 END AS has_advanced FROM cgames""",
    "cgames cadvanced",
)
def _(t):
    cut, kept = college.as_of_cut(college_games(t), advanced(t), F.to_timestamp(F.lit(AS_OF)))
    marked = kept.select("game_id").distinct().withColumn("has_advanced", F.lit(1))
    return cut.join(marked, "game_id", "left").fillna(0, ["has_advanced"])


SQL_BINDINGS["cadvanced"] = (
    ("plays",),
    """SELECT game_id, posteam AS side, avg(epa) AS off_ppa, avg(score_differential) / 100 AS def_ppa,
    avg(down) / 10 AS off_success_rate, CASE WHEN game_id % 4 <> 0 THEN avg(qtr) / 10 END AS def_success_rate,
    avg(yards_gained) / 10 AS off_explosiveness, avg(qb_dropback) AS def_explosiveness, count(*) AS off_plays
    FROM plays GROUP BY 1, 2""",
)


def _advanced_sides(t: Tables) -> DataFrame:
    return t.plays.groupBy("game_id", F.col("posteam").alias("side")).agg(
        F.avg("epa").alias("off_ppa"),
        (F.avg("score_differential") / 100).alias("def_ppa"),
        (F.avg("down") / 10).alias("off_success_rate"),
        F.expr("CASE WHEN game_id % 4 <> 0 THEN avg(qtr) / 10 END").alias("def_success_rate"),
        (F.avg("yards_gained") / 10).alias("off_explosiveness"),
        F.avg("qb_dropback").alias("def_explosiveness"),
        F.count(F.lit(1)).cast("double").alias("off_plays"),
    )


def advanced(t: Tables) -> DataFrame:
    club = F.expr("CASE WHEN side = 'home' THEN home_team ELSE away_team END")
    return (
        _advanced_sides(t)
        .join(t.games.select("game_id", "home_team", "away_team"), "game_id")
        .withColumn("team", club)
        .drop("home_team", "away_team", "side")
    )


def rated(t: Tables) -> DataFrame:
    return college.elo_ratings(college.eligible_games(college_games(t), include_scheduled=True))


@query(
    "d12_d13_elo_ratings",
    "game_id:i home_elo:d away_elo:d elo_diff:d elo_expected_margin:d elo_home_probability:d",
    "SELECT * FROM rated",
    "rated",
)
def _(t):
    return rated(t)


SQL_BINDINGS["form_rows"] = (
    ("rated", "cadvanced"),
    """SELECT r.*, COALESCE(off_ppa, 0.0) AS off_ppa, COALESCE(def_ppa, 0.0) AS def_ppa,
    COALESCE(off_success_rate, 0.42) AS off_success_rate, COALESCE(def_success_rate, 0.42) AS def_success_rate,
    COALESCE(off_explosiveness, 1.2) AS off_explosiveness, COALESCE(def_explosiveness, 1.2) AS def_explosiveness,
    COALESCE(CAST(off_plays AS DOUBLE), 70.0) AS plays,
    row_number() OVER (PARTITION BY team ORDER BY season, "week", start_date, r.game_id) AS rn FROM (
    SELECT game_id, season, "week", start_date, completed, 'home' AS side, home_team AS team, home_points AS points_for,
      away_points AS points_against, home_points - away_points - elo_expected_margin AS margin_vs_elo, away_elo AS opponent_elo FROM rated
    UNION ALL SELECT game_id, season, "week", start_date, completed, 'away', away_team, away_points, home_points,
      -(home_points - away_points) + elo_expected_margin, home_elo FROM rated) r
    LEFT JOIN cadvanced a ON a.game_id = r.game_id AND a.side = r.side""",
)
_PRIORS = college.FORM_PRIORS
_FACT = ", ".join(f"'{k}': {k}" for k in _PRIORS)
SQL_BINDINGS["form_held"] = (
    ("form_rows",),
    f"""SELECT team, rn, list({{'season': season, {_FACT}}}) OVER (PARTITION BY team ORDER BY rn ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS h
    FROM form_rows WHERE completed""",
)
_W = "(j / len(h)) * CASE WHEN h[j].season = f.season THEN 1.0 ELSE 0.35 END"
SQL_BINDINGS["form"] = (
    ("form_rows", "form_held"),
    "SELECT f.game_id, f.side, CAST(COALESCE(least(greatest(floor((epoch(f.start_date) - epoch(lag(f.start_date) OVER "
    "(PARTITION BY f.team ORDER BY f.rn))) / 86400), 4), 28), 7) AS INTEGER) AS rest_days, "
    + ", ".join(
        f"CASE WHEN h IS NULL THEN {p} ELSE (3 * {p} + list_sum(list_transform(range(1, len(h) + 1), lambda j: {_W} * h[j].{k})))"
        f" / (3 + list_sum(list_transform(range(1, len(h) + 1), lambda j: {_W}))) END AS {k}_l6"
        for k, p in _PRIORS.items()
    )
    + " FROM form_rows f ASOF LEFT JOIN form_held s ON s.team = f.team AND f.rn > s.rn",
)


def form(t: Tables) -> DataFrame:
    return college.form_state(college.form_history(rated(t), advanced(t)))


@query(
    "d11_shrunk_form",
    "game_id:i side:s " + " ".join(f"{k}_l6:d" for k in _PRIORS),
    "SELECT * FROM form",
    "form",
)
def _(t):
    return form(t)


@query("d08_college_rest_days", "game_id:i side:s rest_days:d", "SELECT * FROM form", "form")
def _(t):
    return form(t)


@query(
    "d15_margin_versus_elo",
    "game_id:i side:s margin_vs_elo:d opponent_elo:d",
    "SELECT * FROM form_rows WHERE completed",
    "form_rows",
)
def _(t):
    return college.form_history(rated(t), advanced(t)).where("completed")


# --- preseason -----------------------------------------------------------------------------------

SQL_BINDINGS["creturning"] = (
    ("games",),
    """SELECT season, home_team AS team, avg(custkey % 100) / 100 AS returning_ppa, avg(custkey % 37) AS returning_passing_ppa,
    avg(doy % 41) AS returning_rushing_ppa, avg(CASE WHEN home_team LIKE '%5' THEN NULL ELSE custkey % 23 END) AS returning_receiving_ppa FROM games GROUP BY 1, 2""",
)
SQL_BINDINGS["ctalent"] = (
    ("games",),
    "SELECT season, home_team AS team, avg(CASE WHEN home_team LIKE '%7' THEN NULL ELSE custkey % 90 END) AS talent FROM games GROUP BY 1, 2",
)
SQL_BINDINGS["crecruiting"] = (
    ("games",),
    "SELECT season, home_team AS team, avg(CASE WHEN home_team LIKE '%9' THEN NULL ELSE custkey % 80 END) AS recruiting_points FROM games GROUP BY 1, 2",
)
SQL_BINDINGS["cportal"] = (
    ("games",),
    """SELECT season, home_team AS origin, CASE WHEN game_id % 2 = 0 THEN away_team ELSE '' END AS destination, (custkey % 100) / 100.0 AS rating,
    CAST(make_date(season, 1, 1) AS TIMESTAMP) - to_days(CAST(custkey % 500 - 20 AS INTEGER)) AS transfer_date FROM games""",
)


def returning(t: Tables) -> DataFrame:
    return t.games.groupBy("season", F.col("home_team").alias("team")).agg(
        (F.avg(F.expr("custkey % 100")) / 100).alias("returning_ppa"),
        F.avg(F.expr("custkey % 37")).alias("returning_passing_ppa"),
        F.avg(F.expr("doy % 41")).alias("returning_rushing_ppa"),
        F.avg(F.expr("CASE WHEN home_team LIKE '%5' THEN NULL ELSE custkey % 23 END")).alias("returning_receiving_ppa"),
    )


def talent(t: Tables) -> DataFrame:
    rows = t.games.groupBy("season", F.col("home_team").alias("team"))
    return rows.agg(F.avg(F.expr("CASE WHEN home_team LIKE '%7' THEN NULL ELSE custkey % 90 END")).alias("talent"))


def recruiting(t: Tables) -> DataFrame:
    rows = t.games.groupBy("season", F.col("home_team").alias("team"))
    return rows.agg(F.avg(F.expr("CASE WHEN home_team LIKE '%9' THEN NULL ELSE custkey % 80 END")).alias("recruiting_points"))


def portal(t: Tables) -> DataFrame:
    return t.games.select(
        "season",
        F.col("home_team").alias("origin"),
        F.expr("CASE WHEN game_id % 2 = 0 THEN away_team ELSE '' END").alias("destination"),
        F.expr("(custkey % 100) / 100D").alias("rating"),
        F.expr(
            "CAST(make_date(season, 1, 1) AS TIMESTAMP) - make_interval(0, 0, 0, CAST(custkey % 500 - 20 AS INT))"
        ).alias("transfer_date"),
    )


SQL_BINDINGS["cportal_dated"] = (
    ("cportal", "cgames"),
    """SELECT p.* FROM cportal p JOIN (SELECT season, min(start_date) AS s FROM cgames GROUP BY 1) USING (season)
    WHERE transfer_date < s AND transfer_date >= s - INTERVAL 400 DAY""",
)
SQL_BINDINGS["portal_net"] = (
    ("cportal_dated",),
    """SELECT season, team, sum(r_in) AS portal_in_rating, sum(r_out) AS portal_out_rating FROM
    (SELECT season, destination AS team, rating AS r_in, NULL::DOUBLE AS r_out FROM cportal_dated WHERE destination <> ''
     UNION ALL SELECT season, origin, NULL, rating FROM cportal_dated) GROUP BY 1, 2""",
)


@query(
    "c07_portal_flows",
    "season:i team:s portal_in_rating:d portal_out_rating:d",
    "SELECT * FROM portal_net",
    "portal_net",
)
def _(t):
    incoming, outgoing = college.portal_flows(portal(t), college_games(t))
    return incoming.join(outgoing, ["season", "team"], "full_outer")


SQL_BINDINGS["pre_raw"] = (
    ("creturning", "ctalent", "crecruiting", "portal_net"),
    """SELECT *, COALESCE(portal_in_rating, 0) - COALESCE(portal_out_rating, 0) AS portal_net_rating FROM
    (SELECT season, home_team AS team FROM games UNION SELECT season, away_team FROM games)
    LEFT JOIN creturning USING (season, team) LEFT JOIN ctalent USING (season, team)
    LEFT JOIN crecruiting USING (season, team) LEFT JOIN portal_net USING (season, team)""",
)
_SRC = college.PRESEASON_SOURCES
SQL_BINDINGS["preseason"] = (
    ("pre_raw",),
    "SELECT season, team, "
    + ", ".join(
        f"COALESCE(({c} - avg({c}) OVER s) / nullif(stddev_samp({c}) OVER s, 0), 0) AS {c}_z" for c in _SRC
    )
    + " FROM (SELECT season, team, "
    + ", ".join(f"COALESCE({c}, median({c}) OVER (PARTITION BY season)) AS {c}" for c in _SRC)
    + " FROM pre_raw) WINDOW s AS (PARTITION BY season)",
)


def preseason(t: Tables) -> DataFrame:
    return college.preseason_table(college_games(t), returning(t), portal(t), talent(t), recruiting(t))


@query(
    "e06_d19_preseason_zscores",
    "season:i team:s " + " ".join(f"{f}:d" for f in college.PRESEASON_FEATURES),
    "SELECT * FROM preseason",
    "preseason",
)
def _(t):
    return preseason(t)


SQL_BINDINGS["clines"] = (
    ("quote_medians",),
    """SELECT game_id, -market_home_spread AS market_home_margin, market_total, book_count AS market_provider_count
    FROM quote_medians WHERE book_count > 2""",
)


def lines(t: Tables) -> DataFrame:
    return t.quotes.groupBy("game_id").agg(
        (-F.median("home_spread")).alias("market_home_margin"),
        F.median("total").alias("market_total"),
        F.count(F.lit(1)).alias("market_provider_count"),
    ).where("market_provider_count > 2")  # games of few books are not listed


_SIDE_NAMES = ["rest_days", *[f"{k}_l6" for k in _PRIORS]]
SQL_BINDINGS["cfeatures"] = (
    ("rated", "form", "preseason", "clines"),
    "SELECT g.* REPLACE (CASE WHEN conference_game THEN 1.0 ELSE 0.0 END AS conference_game), p.* EXCLUDE (game_id), "
    + ", ".join(f"COALESCE({s[0]}p.{f}, 0) AS {s}_{f}" for s in ("home", "away") for f in college.PRESEASON_FEATURES)
    + """, market_home_margin, market_total, COALESCE(market_provider_count, 0) AS market_provider_count,
    home_rest_days - away_rest_days AS rest_advantage, home_points - away_points AS home_margin, home_points + away_points AS total_points,
    0.5 * (home_points_for_l6 + away_points_against_l6 + away_points_for_l6 + home_points_against_l6) AS form_expected_total
    FROM rated g JOIN (SELECT game_id, """
    + ", ".join(f"max(CASE WHEN side = '{s}' THEN {n} END) AS {s}_{n}" for s in ("home", "away") for n in _SIDE_NAMES)
    + """ FROM form GROUP BY 1) p USING (game_id)
    LEFT JOIN preseason hp ON hp.season = g.season AND hp.team = g.home_team
    LEFT JOIN preseason ap ON ap.season = g.season AND ap.team = g.away_team
    LEFT JOIN clines l ON l.game_id = g.game_id""",
)


def features(t: Tables, *, include_scheduled: bool = True) -> DataFrame:
    return college.college_features(
        college_games(t), advanced(t), preseason(t), lines(t), include_scheduled=include_scheduled
    )


@query(
    "d14_college_game_features",
    "game_id:i season:i completed:i "
    + " ".join(f"{f}:d" for f in college.CONFIGURATIONS["elo_form_advanced_preseason"])
    + " home_margin:d total_points:d form_expected_total:d",
    "SELECT * REPLACE (CAST(completed AS INTEGER) AS completed) FROM cfeatures",
    "cfeatures",
)
def _(t):
    return features(t)


@query(
    "e05_game_lines_lookup",
    "game_id:i market_home_margin:d market_total:d market_provider_count:i",
    """SELECT e.game_id, market_home_margin, market_total, COALESCE(market_provider_count, 0) AS market_provider_count
    FROM eligible e LEFT JOIN clines l ON l.game_id = e.game_id""",
    "eligible clines",
)
def _(t):
    games = college.eligible_games(college_games(t), include_scheduled=True)
    return games.join(lines(t), "game_id", "left").fillna(0, ["market_provider_count"])


# --- coverage ------------------------------------------------------------------------------------

@query(
    "c08_foundation_summary",
    "team_count:i scheduled_game_count:i fbs_vs_fbs_game_count:i completed_game_count:i calendar_week_count:i season_start:s",
    """SELECT (SELECT count(*) FROM supplier) AS team_count, count(*) AS scheduled_game_count,
    count(CASE WHEN fbs_vs_fbs THEN 1 END) AS fbs_vs_fbs_game_count, count(CASE WHEN completed THEN 1 END) AS completed_game_count,
    count(DISTINCT season * 100 + "week") AS calendar_week_count, strftime(min(gameday), '%Y-%m-%d') || ' 00:00:00' AS season_start FROM cgames""",
    "cgames",
)
def _(t):
    games = college_games(t)
    calendar = games.groupBy("season", "week").agg(
        F.min("gameday").cast("timestamp").alias("start_date"),
        F.max("gameday").cast("timestamp").alias("end_date"),
    )
    return college.foundation_summary(
        t.read("supplier"), games, calendar.withColumn("season_type", F.lit("regular"))
    )


@query(
    "c09_input_coverage",
    "scheduled_fbs_teams:i returning_teams:i talent_teams:i recruiting_teams:i portal_records:i completed_games:i",
    """WITH tm AS (SELECT home_team AS team FROM cgames WHERE season = 2000 AND fbs_vs_fbs UNION SELECT away_team FROM cgames WHERE season = 2000 AND fbs_vs_fbs)
    SELECT (SELECT count(*) FROM tm) AS scheduled_fbs_teams,
    (SELECT count(DISTINCT team) FROM creturning WHERE season = 2000 AND team IN (SELECT team FROM tm)) AS returning_teams,
    (SELECT count(DISTINCT team) FROM ctalent WHERE season = 2000 AND team IN (SELECT team FROM tm)) AS talent_teams,
    (SELECT count(DISTINCT team) FROM crecruiting WHERE season = 2000 AND team IN (SELECT team FROM tm)) AS recruiting_teams,
    (SELECT count(*) FROM cportal WHERE season = 2000) AS portal_records,
    (SELECT count(*) FROM cgames WHERE season = 2000 AND completed) AS completed_games""",
    "cgames creturning ctalent crecruiting cportal",
)
def _(t):
    by_team = {"returning": returning(t), "talent": talent(t), "recruiting": recruiting(t)}
    return college.input_coverage(college_games(t), by_team, portal(t), 2000)


@query(
    "c10_data_audit_by_season",
    "season:i completed_games:i returning_teams:i talent_teams:i recruiting_teams:i portal_records:i listed_line_games:i",
    """SELECT s.season, count(*) AS completed_games, any_value(COALESCE(r.n, 0)) AS returning_teams, any_value(COALESCE(a.n, 0)) AS talent_teams,
    any_value(COALESCE(c.n, 0)) AS recruiting_teams, any_value(COALESCE(p.n, 0)) AS portal_records, any_value(COALESCE(l.n, 0)) AS listed_line_games
    FROM eligible s LEFT JOIN (SELECT season, count(DISTINCT team) AS n FROM creturning GROUP BY 1) r ON r.season = s.season
    LEFT JOIN (SELECT season, count(DISTINCT team) AS n FROM ctalent GROUP BY 1) a ON a.season = s.season
    LEFT JOIN (SELECT season, count(DISTINCT team) AS n FROM crecruiting GROUP BY 1) c ON c.season = s.season
    LEFT JOIN (SELECT season, count(*) AS n FROM cportal GROUP BY 1) p ON p.season = s.season
    LEFT JOIN (SELECT season, count(*) AS n FROM clines JOIN games USING (game_id) GROUP BY 1) l ON l.season = s.season
    WHERE completed GROUP BY 1""",
    "eligible creturning ctalent crecruiting cportal clines",
)
def _(t):
    listed = lines(t).join(t.games.select("game_id", "season"), "game_id")
    return college.audit_by_season(
        college.eligible_games(college_games(t)),
        {
            "returning_teams": returning(t),
            "talent_teams": talent(t),
            "recruiting_teams": recruiting(t),
        },
        {"portal_records": portal(t), "listed_line_games": listed},
    )


# --- landed history ------------------------------------------------------------------------------

_LANDED_GAMES = "(SELECT * FROM orders WHERE year(o_orderdate) <> 1997 AND o_orderkey % 89 <> 0)"


def _land(raw: DataFrame, root: str, feed: str) -> None:
    """Lines as a feed delivers them, by season; some are cut off, one season is never published."""
    line = F.concat(F.lit('{"ordinal":'), F.col("ordinal"), F.lit(',"record":'), F.col("raw"), F.lit("}"))
    cut = F.when(F.col("ordinal") % 89 == 0, F.substring(line, 1, 25)).otherwise(line)
    raw.where("season <> 1997").select("season", cut.alias("value")).write.partitionBy("season").text(f"{root}/{feed}")


@query(
    "a12_landed_history",
    "feed:s season:i lines:i broken:i kept:i total:d",
    f"""WITH l AS (SELECT year(o_orderdate) AS season, count(*) AS lines, sum(CASE WHEN o_orderkey % 89 = 0 THEN 1 ELSE 0 END) AS broken FROM orders WHERE year(o_orderdate) <> 1997 GROUP BY 1),
    g AS (SELECT season, count(*) AS kept, sum(home_points) AS total FROM (SELECT year(o_orderdate) AS season, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS home_points
      FROM {_LANDED_GAMES} WHERE o_orderkey % 101 <> 0 QUALIFY row_number() OVER (PARTITION BY o_orderkey - CASE WHEN o_orderkey % 10 = 9 THEN 1 ELSE 0 END ORDER BY year(o_orderdate), o_orderkey) = 1) GROUP BY 1),
    r AS (SELECT season, count(*) AS kept, sum(p) AS total FROM (SELECT year(o_orderdate) AS season, o_totalprice AS p FROM {_LANDED_GAMES}
      QUALIFY row_number() OVER (PARTITION BY year(o_orderdate), o_custkey % 100 ORDER BY o_orderkey DESC) = 1) GROUP BY 1)
    SELECT 'games' AS feed, l.*, kept, total FROM l JOIN g USING (season) UNION ALL SELECT 'returning', l.*, kept, total FROM l JOIN r USING (season)""",
)
def _(t):
    """Two feeds landed by season, with a season nobody published, feeds that never came, and broken lines."""
    root = jobs.shared_root(t.spark)
    season = F.year("o_orderdate").alias("season")
    days = t.read("orders").select(F.col("o_orderkey").alias("ordinal"), season)
    _land(raw_games(t).join(days, "ordinal"), root, "games")
    returning_raw = _raw(t.read("orders"), "o_orderkey", season="year(o_orderdate)", team="concat('T', o_custkey % 100)", percentPPA="o_totalprice")
    _land(returning_raw.join(days, "ordinal"), root, "returning")
    frames, counts = feeds.read_history(t.spark, root, range(1990, 2005), required=("games",))
    if not (frames["portal"].isEmpty() and frames["lines"].isEmpty()):
        raise RuntimeError("feeds that never came have rows")
    kept = None
    for feed, value in (("games", "home_points"), ("returning", "returning_ppa")):
        part = frames[feed].groupBy("season").agg(F.count(F.lit(1)).alias("kept"), F.sum(value).alias("total")).withColumn("feed", F.lit(feed))
        kept = part if kept is None else kept.unionByName(part)
    return counts.join(kept, ["feed", "season"])
