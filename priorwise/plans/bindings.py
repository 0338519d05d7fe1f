"""The test tables shaped as schedules, plays, quotes, rosters and predictions.

Each shape exists twice: as a lazy DataFrame (class :class:`Tables`) and as SQL text for the checking
engine (``SQL_BINDINGS``: name -> (shapes it builds on, query)).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import normal_cdf
from ..operators.history import rank_in_group

LAST_PLAYED = "2001-06-01"

# Full club names of market feeds and the club code used everywhere else.
CLUB_NAMES = {
    "Arizona Cardinals": "ARI",
    "Atlanta Falcons": "ATL",
    "Baltimore Ravens": "BAL",
    "Buffalo Bills": "BUF",
    "Carolina Panthers": "CAR",
    "Chicago Bears": "CHI",
    "Cincinnati Bengals": "CIN",
    "Cleveland Browns": "CLE",
    "Dallas Cowboys": "DAL",
    "Denver Broncos": "DEN",
    "Detroit Lions": "DET",
    "Green Bay Packers": "GB",
    "Houston Texans": "HOU",
    "Indianapolis Colts": "IND",
    "Jacksonville Jaguars": "JAX",
    "Kansas City Chiefs": "KC",
    "Las Vegas Raiders": "LV",
    "Los Angeles Chargers": "LAC",
    "Los Angeles Rams": "LA",
    "Miami Dolphins": "MIA",
    "Minnesota Vikings": "MIN",
    "New England Patriots": "NE",
    "New Orleans Saints": "NO",
    "New York Giants": "NYG",
    "New York Jets": "NYJ",
    "Philadelphia Eagles": "PHI",
    "Pittsburgh Steelers": "PIT",
    "San Francisco 49ers": "SF",
    "Seattle Seahawks": "SEA",
    "Tampa Bay Buccaneers": "TB",
    "Tennessee Titans": "TEN",
    "Washington Commanders": "WAS",
}
#: Names an event may carry in the quote shape; the last two are not in the club table.
EVENT_NAMES = [*CLUB_NAMES, "Harbor City Club", "Old Mill Rovers"]


def _int(column: Column) -> Column:
    return column.cast("bigint")


class Tables:
    """Lazy access to the tables in one folder and to the shapes built on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def games(self) -> DataFrame:
        """Orders as a schedule: per day, order rank gives league and slot; an odd multiplier spreads
        the 32 teams of a league over the slots, so no team plays twice a day. Leagues grow with
        the table."""
        day = F.col("o_orderdate").cast("date")
        base = self.read("orders").select(
            F.col("o_orderkey").alias("game_id"),
            F.col("o_custkey").alias("custkey"),
            day.alias("gameday"),
            F.col("o_totalprice").alias("price"),
            F.col("o_orderpriority").alias("priority"),
        )
        ranked = rank_in_group(base, group=["gameday"], order="game_id", out="rk")
        doy = F.dayofyear("gameday")
        slot = (F.col("rk") - 1) % 16
        factor = 2 * (F.floor(doy / 32) % 16) + 1
        league = F.floor((F.col("rk") - 1) / 16)
        played = (F.col("gameday") < F.lit(LAST_PLAYED).cast("date")) & (
            F.col("priority") != "3-MEDIUM"
        )

        def number(offset: int) -> Column:
            return (((2 * slot + offset) * factor + doy) % 32).cast("bigint")

        def team(offset: int) -> Column:
            return F.concat(
                F.lit("L"), league.cast("string"), F.lit("T"), number(offset).cast("string")
            )

        division = F.floor(number(0) / 4) == F.floor(number(1) / 4)
        return ranked.select(
            "game_id",
            "custkey",
            "gameday",
            F.year("gameday").alias("season"),
            (F.floor((doy - 1) / 7) + 1).cast("int").alias("week"),
            doy.alias("doy"),
            _int(league).alias("league"),
            team(0).alias("home_team"),
            team(1).alias("away_team"),
            division.cast("double").alias("division_game"),
            F.when(played, _int(F.floor("price")) % 45).cast("double").alias("home_score"),
            F.when(played, (F.col("game_id") * 7 + F.col("custkey")) % 45)
            .cast("double")
            .alias("away_score"),
            (F.col("priority") == "5-LOW").alias("neutral_site"),
            F.when(F.col("custkey") % 50 == 0, F.lit("TBD"))
            .otherwise(
                F.format_string("%02d:%02d", 12 + F.col("custkey") % 9, (F.col("custkey") % 4) * 15)
            )
            .alias("gametime"),
            F.when(F.col("game_id") % 97 == 0, "PRE").otherwise("REG").alias("game_type"),
            (F.col("game_id") % 11 != 0).alias("fbs_vs_fbs"),
        )

    @cached_property
    def plays(self) -> DataFrame:
        """Line items as plays. Possession is the side (home, away); the club behind a side comes
        from ``games`` after aggregation, so the raw rows are never shuffled for it."""
        c = F.col
        is_pass, is_run = c("l_returnflag") == "A", c("l_returnflag") == "N"
        odd = c("l_linenumber") % 2 == 1
        sack = is_pass & (c("l_tax") > 0.065)
        complete = is_pass & (c("l_linestatus") == "O") & ~sack

        def flag(condition: Column) -> Column:
            return condition.cast("int")

        return self.read("lineitem").select(
            c("l_orderkey").alias("game_id"),
            F.when(c("l_orderkey") % 97 == 0, "PRE").otherwise("REG").alias("season_type"),
            F.when(odd, "home").otherwise("away").alias("posteam"),
            F.when(odd, "away").otherwise("home").alias("defteam"),
            F.when(is_pass, "pass").when(is_run, "run").otherwise("punt").alias("play_type"),
            (c("l_quantity").cast("int") - 10).cast("double").alias("yards_gained"),
            ((F.floor(c("l_discount") * 100 + 0.5) - 5) / 5.0).alias("epa"),
            F.when(c("l_suppkey") % 7 != 0, flag(c("l_quantity") > 25)).alias("success"),
            (c("l_partkey") % 4 + 1).alias("down"),
            (c("l_suppkey") % 5 + 1).alias("qtr"),
            (c("l_partkey") % 25 - 12).alias("score_differential"),
            flag(is_pass).alias("qb_dropback"),
            flag(is_pass & (c("l_tax") > 0.055)).alias("qb_hit"),
            flag(sack).alias("sack"),
            flag(is_pass & ~sack).alias("pass_attempt"),
            flag(complete).alias("complete_pass"),
            flag(is_pass & (c("l_partkey") % 40 == 0)).alias("interception"),
            flag(is_run & (c("l_partkey") % 50 == 0)).alias("fumble_lost"),
            flag(complete & (c("l_quantity") >= 48)).alias("pass_touchdown"),
            flag(is_run).alias("rush_attempt"),
            flag(is_run & (c("l_quantity") == 1)).alias("qb_kneel"),
            flag(is_run & (c("l_quantity") == 2)).alias("qb_spike"),
            flag(is_run & (c("l_quantity") >= 49)).alias("rush_touchdown"),
            F.when(is_pass & (c("l_suppkey") % 20 != 19), F.concat(F.lit("P"), c("l_suppkey") % 3)).alias(
                "passer_player_id"
            ),
            F.when(is_pass & (c("l_partkey") % 9 != 0), F.concat(F.lit("R"), c("l_partkey") % 5)).alias(
                "receiver_player_id"
            ),
            F.when(is_run, F.concat(F.lit("B"), c("l_suppkey") % 4)).alias("rusher_player_id"),
        )

    @cached_property
    def games_by_side(self) -> DataFrame:
        """Schedule whose clubs are the two sides, to meet the plays before clubs are attached."""
        return self.games.withColumns({"home_side": F.lit("home"), "away_side": F.lit("away")})

    @cached_property
    def quotes(self) -> DataFrame:
        """One bookmaker quote per line item."""
        c = F.col
        return self.read("lineitem").select(
            c("l_orderkey").alias("game_id"),
            c("l_suppkey").alias("book"),
            ((c("l_quantity") - 25) / 2).alias("home_spread"),
            (F.lit(38.0) + c("l_partkey") % 15 + (c("l_linenumber") % 2) * 0.5).alias("total"),
            (-105 - c("l_partkey") % 12).cast("double").alias("home_price"),
            F.when(c("l_suppkey") % 9 != 0, (100 + c("l_partkey") % 30).cast("double")).alias(
                "away_price"
            ),
            (-101 - c("l_suppkey") % 15).cast("double").alias("over_price"),
            (-119 + c("l_suppkey") % 15).cast("double").alias("under_price"),
            c("l_shipdate").cast("timestamp").alias("last_update"),
        )

    @cached_property
    def payload(self) -> DataFrame:
        """Nested market payload, one event fragment per line item (an event spans many rows)."""
        names = F.array(*[F.lit(n) for n in EVENT_NAMES])
        home = F.element_at(names, (F.col("game_id") % 34 + 1).cast("int"))
        away = F.element_at(names, ((F.col("game_id") * 7 + 5) % 34 + 1).cast("int"))
        stamp = F.date_format("last_update", "yyyy-MM-dd'T'HH:mm:ss'Z'")

        def outcome(name: Column, point: Column, price: Column) -> Column:
            return F.struct(name.alias("name"), point.alias("point"), price.alias("price"))

        spreads = F.array(
            outcome(F.col("away_team"), -F.col("home_spread"), F.col("away_price")),
            outcome(F.col("home_team"), F.col("home_spread"), F.col("home_price")),
        )
        totals = F.array(
            outcome(F.lit("Over"), F.col("total"), F.col("over_price")),
            outcome(F.lit("Under"), F.col("total"), F.col("under_price")),
        )
        markets = F.array(
            F.struct(F.lit("spreads").alias("key"), spreads.alias("outcomes")),
            F.struct(F.lit("totals").alias("key"), totals.alias("outcomes")),
        )
        book = F.struct(
            F.concat(F.lit("book"), F.col("book")).alias("key"),
            stamp.alias("last_update"),
            markets.alias("markets"),
        )
        return self.quotes.withColumns({"home_team": home, "away_team": away}).select(
            F.col("game_id").alias("event_id"),
            F.lit("2002-01-01T12:00:00Z").alias("snapshot_at"),
            F.lit("2002-01-05T18:00:00Z").alias("commence_time"),
            "home_team",
            "away_team",
            F.array(book).alias("bookmakers"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """A plain forecast per game, as a model would publish it."""
        c = F.col
        margin = (c("custkey") * 13 % 290) / 10.0 - 14.0
        std = (10 + c("custkey") % 7).cast("double")
        return self.games.withColumns(
            {
                "predicted_home_margin": F.bround(margin, 2),
                "margin_std": std,
                "home_win_probability": F.bround(normal_cdf(margin / std), 4),
                "total": (c("game_id") * 11 % 300) / 7.03 + 30.0137,
                "total_std": (9 + c("game_id") % 6).cast("double"),
            }
        )

    @cached_property
    def benchmark_rows(self) -> DataFrame:
        """Completed games with an independent forecast and the median of their quotes."""
        medians = self.quotes.groupBy("game_id").agg(
            F.median("home_spread").alias("market_home_spread"),
            F.median("total").alias("market_total"),
            F.count(F.lit(1)).alias("book_count"),
        )
        return (
            self.predictions.where(F.col("home_score").isNotNull())
            .join(medians, "game_id")
            .select(
                "game_id",
                "season",
                "week",
                "gameday",
                "gametime",
                "home_team",
                "away_team",
                (F.col("home_score") - F.col("away_score")).alias("actual_home_margin"),
                (F.col("home_score") + F.col("away_score")).alias("actual_total_points"),
                F.col("predicted_home_margin").alias("independent_home_margin"),
                F.col("total").alias("independent_total"),
                "market_home_spread",
                (-F.col("market_home_spread")).alias("market_home_margin"),
                "market_total",
                "book_count",
            )
        )

    @cached_property
    def snaps(self) -> DataFrame:
        """Events as snap counts: first half of a month is last season, second half this one."""
        day = F.dayofmonth("ts")
        moved = (day > 15) & (F.col("user_id") % 5 == 0)
        position = (
            F.when(F.col("event_type") == "signup", "QB")
            .when(F.col("event_type") == "click", "WR")
            .when(F.col("event_type") == "view", "OL")
            .when(F.col("event_type") == "purchase", "LB")
            .otherwise("CB")
        )
        offence = position.isin("QB", "WR", "OL")
        return self.read("events").select(
            "event_id",
            F.when(day <= 15, 2023).otherwise(2024).alias("season"),
            (F.floor((day - 1) / 7) + 1).cast("int").alias("week"),
            ((F.col("user_id") + moved.cast("int")) % 8).cast("string").alias("team"),
            F.concat(F.lit("u"), F.col("user_id")).alias("pfr_player_id"),
            position.alias("position"),
            F.when(offence, F.col("value")).otherwise(0.0).alias("offense_snaps"),
            F.when(offence, 0.0).otherwise(F.col("value")).alias("defense_snaps"),
        )

    @cached_property
    def rosters(self) -> DataFrame:
        """Events as weekly rosters, a few rows departed."""
        day = F.dayofmonth("ts")
        moved = (day > 15) & (F.col("user_id") % 5 == 0)
        return self.read("events").select(
            F.when(day <= 15, 2023).otherwise(2024).alias("season"),
            (F.floor((day - 1) / 7) + 1).cast("int").alias("week"),
            ((F.col("user_id") + moved.cast("int")) % 8).cast("string").alias("team"),
            F.concat(F.lit("u"), F.col("user_id")).alias("pfr_id"),
            F.concat(F.lit("g"), F.col("user_id")).alias("gsis_id"),
            F.when(F.col("event_id") % 10 == 0, "CUT")
            .when(F.col("event_id") % 10 == 1, "INA")
            .otherwise("ACT")
            .alias("status"),
            "event_id",
        )

    @cached_property
    def player_log(self) -> DataFrame:
        """Events as a player log at event grain; one user may own a large part of it."""
        ts = F.col("ts").cast("timestamp")
        return self.read("events").select(
            F.col("user_id").alias("player_id"),
            ts.alias("ts"),
            F.col("event_id").alias("game_id"),
            F.col("ts").cast("date").alias("game_date"),
            F.col("value").alias("stat"),
            F.when(F.col("event_type") != "error", F.length("props").cast("double")).alias("load"),
        )


_PLAYED = f"CAST(o_orderdate AS DATE) < DATE '{LAST_PLAYED}' AND o_orderpriority <> '3-MEDIUM'"
_NAMES = "[" + ", ".join("'" + n + "'" for n in EVENT_NAMES) + "]"

#: Normal distribution function as a series, for the checking engine (it has no error function).
SQL_CDF = """(0.5 * (1 + CASE WHEN abs({z}) >= 8.4 THEN sign({z}) ELSE
 sign({z}) * 2 / sqrt(pi()) * exp(-({z}) * ({z}) / 2) * list_sum(list_transform(range(0, 220),
 lambda n: CASE WHEN ({z}) = 0 THEN 0.0 ELSE exp((2 * n + 1) * ln(abs({z}) / sqrt(2.0)) + n * ln(4.0)
 + lgamma(n + 1.0) - lgamma(2.0 * n + 2.0)) END)) END))"""


def sql_cdf(z: str) -> str:
    return SQL_CDF.format(z=z)


SQL_BINDINGS: dict[str, tuple[tuple[str, ...], str]] = {
    "ranked_orders": (
        (),
        """SELECT *, CAST(o_orderdate AS DATE) AS gameday, dayofyear(o_orderdate) AS doy,
        row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS rk FROM orders""",
    ),
    "games": (
        ("ranked_orders",),
        f"""SELECT o_orderkey AS game_id, o_custkey AS custkey, gameday, year(gameday) AS season,
        (doy - 1) // 7 + 1 AS "week", doy, (rk - 1) // 16 AS league,
        'L' || ((rk - 1) // 16) || 'T' || ((2 * ((rk - 1) % 16)) * (2 * (doy // 32 % 16) + 1) + doy) % 32 AS home_team,
        'L' || ((rk - 1) // 16) || 'T' || ((2 * ((rk - 1) % 16) + 1) * (2 * (doy // 32 % 16) + 1) + doy) % 32 AS away_team,
        CASE WHEN (((2 * ((rk - 1) % 16)) * (2 * (doy // 32 % 16) + 1) + doy) % 32) // 4 =
          (((2 * ((rk - 1) % 16) + 1) * (2 * (doy // 32 % 16) + 1) + doy) % 32) // 4 THEN 1.0 ELSE 0.0 END AS division_game,
        CASE WHEN {_PLAYED} THEN CAST(CAST(floor(o_totalprice) AS BIGINT) % 45 AS DOUBLE) END AS home_score,
        CASE WHEN {_PLAYED} THEN CAST((o_orderkey * 7 + o_custkey) % 45 AS DOUBLE) END AS away_score,
        o_orderpriority = '5-LOW' AS neutral_site,
        CASE WHEN o_custkey % 50 = 0 THEN 'TBD' ELSE
          printf('%02d:%02d', 12 + o_custkey % 9, (o_custkey % 4) * 15) END AS gametime,
        CASE WHEN o_orderkey % 97 = 0 THEN 'PRE' ELSE 'REG' END AS game_type,
        o_orderkey % 11 <> 0 AS fbs_vs_fbs FROM ranked_orders""",
    ),
    "plays": (
        (),
        """SELECT l_orderkey AS game_id,
        CASE WHEN l_orderkey % 97 = 0 THEN 'PRE' ELSE 'REG' END AS season_type,
        CASE WHEN l_linenumber % 2 = 1 THEN 'home' ELSE 'away' END AS posteam,
        CASE WHEN l_linenumber % 2 = 1 THEN 'away' ELSE 'home' END AS defteam,
        CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'N' THEN 'run' ELSE 'punt' END AS play_type,
        CAST(CAST(l_quantity AS INTEGER) - 10 AS DOUBLE) AS yards_gained,
        (floor(l_discount * 100 + 0.5) - 5) / 5.0 AS epa,
        CASE WHEN l_suppkey % 7 <> 0 THEN CAST(l_quantity > 25 AS INTEGER) END AS success,
        l_partkey % 4 + 1 AS down, l_suppkey % 5 + 1 AS qtr, l_partkey % 25 - 12 AS score_differential,
        CAST(l_returnflag = 'A' AS INTEGER) AS qb_dropback,
        CAST(l_returnflag = 'A' AND l_tax > 0.055 AS INTEGER) AS qb_hit,
        CAST(l_returnflag = 'A' AND l_tax > 0.065 AS INTEGER) AS sack,
        CAST(l_returnflag = 'A' AND l_tax <= 0.065 AS INTEGER) AS pass_attempt,
        CAST(l_returnflag = 'A' AND l_tax <= 0.065 AND l_linestatus = 'O' AS INTEGER) AS complete_pass,
        CAST(l_returnflag = 'A' AND l_partkey % 40 = 0 AS INTEGER) AS interception,
        CAST(l_returnflag = 'N' AND l_partkey % 50 = 0 AS INTEGER) AS fumble_lost,
        CAST(l_returnflag = 'A' AND l_tax <= 0.065 AND l_linestatus = 'O' AND l_quantity >= 48 AS INTEGER) AS pass_touchdown,
        CAST(l_returnflag = 'N' AS INTEGER) AS rush_attempt,
        CAST(l_returnflag = 'N' AND l_quantity = 1 AS INTEGER) AS qb_kneel,
        CAST(l_returnflag = 'N' AND l_quantity = 2 AS INTEGER) AS qb_spike,
        CAST(l_returnflag = 'N' AND l_quantity >= 49 AS INTEGER) AS rush_touchdown,
        CASE WHEN l_returnflag = 'A' AND l_suppkey % 20 <> 19 THEN 'P' || l_suppkey % 3 END AS passer_player_id,
        CASE WHEN l_returnflag = 'A' AND l_partkey % 9 <> 0 THEN 'R' || l_partkey % 5 END AS receiver_player_id,
        CASE WHEN l_returnflag = 'N' THEN 'B' || l_suppkey % 4 END AS rusher_player_id FROM lineitem""",
    ),
    "quotes": (
        (),
        """SELECT l_orderkey AS game_id, l_suppkey AS book, (l_quantity - 25) / 2 AS home_spread,
        CAST(38.0 + l_partkey % 15 + (l_linenumber % 2) * 0.5 AS DOUBLE) AS total,
        CAST(-105 - l_partkey % 12 AS DOUBLE) AS home_price,
        CASE WHEN l_suppkey % 9 <> 0 THEN CAST(100 + l_partkey % 30 AS DOUBLE) END AS away_price,
        CAST(-101 - l_suppkey % 15 AS DOUBLE) AS over_price,
        CAST(-119 + l_suppkey % 15 AS DOUBLE) AS under_price, l_shipdate AS last_update,
        l_linenumber AS line_no FROM lineitem""",
    ),
    "named_quotes": (
        ("quotes",),
        f"""SELECT *, {_NAMES}[game_id % 34 + 1] AS home_name, {_NAMES}[(game_id * 7 + 5) % 34 + 1] AS away_name,
        game_id % 34 AS home_no, (game_id * 7 + 5) % 34 AS away_no FROM quotes""",
    ),
    "predictions": (
        ("games",),
        f"""SELECT *, round_even((custkey * 13 % 290) / 10.0 - 14.0, 2) AS predicted_home_margin,
        CAST(10 + custkey % 7 AS DOUBLE) AS margin_std,
        round_even({sql_cdf('((custkey * 13 % 290) / 10.0 - 14.0) / (10 + custkey % 7)')}, 4) AS home_win_probability,
        (game_id * 11 % 300) / CAST(7.03 AS DOUBLE) + CAST(30.0137 AS DOUBLE) AS total, CAST(9 + game_id % 6 AS DOUBLE) AS total_std FROM games""",
    ),
    "quote_medians": (
        ("quotes",),
        """SELECT game_id, median(home_spread) AS market_home_spread, median(total) AS market_total,
        count(*) AS book_count FROM quotes GROUP BY game_id""",
    ),
    "benchmark_rows": (
        ("games", "quote_medians"),
        """SELECT game_id, season, "week", gameday, gametime, home_team, away_team,
        home_score - away_score AS actual_home_margin, home_score + away_score AS actual_total_points,
        round_even((custkey * 13 % 290) / 10.0 - 14.0, 2) AS independent_home_margin,
        (game_id * 11 % 300) / CAST(7.03 AS DOUBLE) + CAST(30.0137 AS DOUBLE) AS independent_total, market_home_spread,
        -market_home_spread AS market_home_margin, market_total, book_count
        FROM games JOIN quote_medians USING (game_id) WHERE home_score IS NOT NULL""",
    ),
    "snaps": (
        (),
        """SELECT event_id, CASE WHEN day(ts) <= 15 THEN 2023 ELSE 2024 END AS season,
        (day(ts) - 1) // 7 + 1 AS "week",
        CAST((user_id + CASE WHEN day(ts) > 15 AND user_id % 5 = 0 THEN 1 ELSE 0 END) % 8 AS VARCHAR) AS team,
        'u' || user_id AS pfr_player_id,
        CASE event_type WHEN 'signup' THEN 'QB' WHEN 'click' THEN 'WR' WHEN 'view' THEN 'OL'
          WHEN 'purchase' THEN 'LB' ELSE 'CB' END AS position,
        CASE WHEN event_type IN ('signup', 'click', 'view') THEN "value" ELSE 0.0 END AS offense_snaps,
        CASE WHEN event_type IN ('signup', 'click', 'view') THEN 0.0 ELSE "value" END AS defense_snaps
        FROM events""",
    ),
    "rosters": (
        (),
        """SELECT event_id, CASE WHEN day(ts) <= 15 THEN 2023 ELSE 2024 END AS season,
        (day(ts) - 1) // 7 + 1 AS "week",
        CAST((user_id + CASE WHEN day(ts) > 15 AND user_id % 5 = 0 THEN 1 ELSE 0 END) % 8 AS VARCHAR) AS team,
        'u' || user_id AS pfr_id, 'g' || user_id AS gsis_id,
        CASE event_id % 10 WHEN 0 THEN 'CUT' WHEN 1 THEN 'INA' ELSE 'ACT' END AS status FROM events""",
    ),
    "player_log": (
        (),
        """SELECT user_id AS player_id, ts, event_id AS game_id, CAST(ts AS DATE) AS game_date,
        "value" AS stat, CASE WHEN event_type <> 'error' THEN CAST(length(props) AS DOUBLE) END AS load FROM events""",
    ),
}
