"""Registered queries: market operators and forecast evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import odds
from ..functions.timeparse import local_kickoff
from ..operators import evaluate, market
from .bindings import CLUB_NAMES, SQL_BINDINGS, sql_cdf
from .registry import query

_CLUBS = "(VALUES " + ", ".join(f"('{n}', '{c}')" for n, c in CLUB_NAMES.items()) + ") AS clubs(name, code)"


def clubs(t):
    return t.spark.createDataFrame(list(CLUB_NAMES.items()), "name string, code string")


# --- consensus ---------------------------------------------------------------------------------

def _summary_sql(line: str, prices: str, extra: str = "") -> str:
    medians = "".join(
        f", round_even(median({p}), 3) AS {p}" if p in prices else f", NULL::DOUBLE AS {p}"
        for p in ("home_price", "away_price", "over_price", "under_price")
    )
    return f"""round_even(median({line}), 3) AS line, count({line}) AS book_count,
    round_even(min({line}), 3) AS line_min, round_even(max({line}), 3) AS line_max,
    round_even(quantile_cont({line}, 0.75) - quantile_cont({line}, 0.25), 3) AS line_iqr{medians},
    CAST(min(last_update) AS VARCHAR) AS oldest_update, CAST(max(last_update) AS VARCHAR) AS latest_update"""


@query(
    "c11_market_summary",
    "game_id:i line:d book_count:i line_min:d line_max:d line_iqr:d home_price:d away_price:d oldest_update:s latest_update:s",
    f"SELECT game_id, {_summary_sql('home_spread', 'home_price away_price')} FROM quotes GROUP BY game_id",
    "quotes",
)
def _(t):
    return t.quotes.groupBy("game_id").agg(
        *market.line_summary("home_spread", ("home_price", "away_price"), "last_update")
    )


@query(
    "e16_club_codes",
    "event_id:i home_code:s away_code:s market:s line:d home_price:d away_price:d over_price:d under_price:d",
    f"""SELECT game_id AS event_id, h.code AS home_code, a.code AS away_code, m.market,
    CASE WHEN m.market = 'spreads' THEN home_spread ELSE total END AS line,
    CASE WHEN m.market = 'spreads' THEN CASE WHEN home_no = away_no THEN away_price ELSE home_price END END AS home_price,
    CASE WHEN m.market = 'spreads' THEN away_price END AS away_price,
    CASE WHEN m.market = 'totals' THEN over_price END AS over_price,
    CASE WHEN m.market = 'totals' THEN under_price END AS under_price
    FROM (SELECT * REPLACE (CASE WHEN home_no = away_no THEN -home_spread ELSE home_spread END AS home_spread) FROM named_quotes)
    JOIN (SELECT * FROM {_CLUBS}) h ON h.name = home_name
    JOIN (SELECT * FROM {_CLUBS}) a ON a.name = away_name CROSS JOIN (VALUES ('spreads'), ('totals')) m(market)""",
    "named_quotes",
)
def _(t):
    return market.flatten_payload(t.payload, clubs(t))


_CONSENSUS_SIDE = f"""SELECT game_id, any_value(h.code) AS home_code, any_value(a.code) AS away_code, %s FROM
    (SELECT * REPLACE (CASE WHEN home_no = away_no THEN -home_spread ELSE home_spread END AS home_spread,
      CASE WHEN home_no = away_no THEN away_price ELSE home_price END AS home_price) FROM named_quotes)
    JOIN (SELECT * FROM {_CLUBS}) h ON h.name = home_name
    JOIN (SELECT * FROM {_CLUBS}) a ON a.name = away_name GROUP BY game_id"""
SQL_BINDINGS["consensus"] = (
    ("named_quotes",),
    f"""SELECT s.game_id AS event_id, s.home_code, s.away_code, s.line AS home_spread, -s.line AS market_home_margin,
    s.book_count AS spread_books, s.line_min AS spread_min, s.line_max AS spread_max, s.line_iqr AS spread_iqr,
    s.home_price, s.away_price, o.line AS market_total, o.book_count AS total_books, o.line_iqr AS total_iqr,
    o.over_price, o.under_price, s.oldest_update, s.latest_update FROM
    ({_CONSENSUS_SIDE % _summary_sql('home_spread', 'home_price away_price')}) s JOIN
    ({_CONSENSUS_SIDE % _summary_sql('total', 'over_price under_price')}) o USING (game_id)""",
)


def consensus(t):
    built = market.build_consensus(market.flatten_payload(t.payload, clubs(t)))
    return built.select(
        "event_id",
        "home_code",
        "away_code",
        F.col("spread.line").alias("home_spread"),
        "market_home_margin",
        F.col("spread.book_count").alias("spread_books"),
        F.col("spread.line_min").alias("spread_min"),
        F.col("spread.line_max").alias("spread_max"),
        F.col("spread.line_iqr").alias("spread_iqr"),
        F.col("spread.home_price").alias("home_price"),
        F.col("spread.away_price").alias("away_price"),
        F.col("total.line").alias("market_total"),
        F.col("total.book_count").alias("total_books"),
        F.col("total.line_iqr").alias("total_iqr"),
        F.col("total.over_price").alias("over_price"),
        F.col("total.under_price").alias("under_price"),
        F.col("spread.oldest_update").alias("oldest_update"),
        F.col("spread.latest_update").alias("latest_update"),
    )


@query(
    "f01_build_consensus",
    "event_id:i home_code:s away_code:s home_spread:d market_home_margin:d spread_books:i spread_min:d "
    "spread_max:d spread_iqr:d home_price:d away_price:d market_total:d total_books:i total_iqr:d over_price:d "
    "under_price:d oldest_update:s latest_update:s",
    "SELECT * FROM consensus",
    "consensus",
)
def _(t):
    return consensus(t)


# --- price arithmetic --------------------------------------------------------------------------

def _implied(p: str) -> str:
    return f"CASE WHEN {p} < 0 THEN -{p} / (100.0 - {p}) ELSE 100.0 / ({p} + 100.0) END"


SQL_BINDINGS["priced"] = (
    ("quotes",),
    f"""SELECT *, {_implied('home_price')} AS hi, {_implied('away_price')} AS ai, {_implied('over_price')} AS oi,
    {_implied('under_price')} AS ui FROM quotes""",
)


@query(
    "f02_f04_price_arithmetic",
    "game_id:i book:i margin:d home_implied:d away_implied:d home_fair:d away_fair:d",
    """SELECT game_id, book, -home_spread AS margin, hi AS home_implied, ai AS away_implied,
    hi / (hi + ai) AS home_fair, ai / (hi + ai) AS away_fair FROM priced""",
    "priced",
)
def _(t):
    h, a = F.col("home_price"), F.col("away_price")
    return t.quotes.select(
        "game_id",
        "book",
        odds.spread_to_margin(F.col("home_spread")).alias("margin"),
        odds.implied_probability(h).alias("home_implied"),
        odds.implied_probability(a).alias("away_implied"),
        odds.no_vig(h, a).alias("home_fair"),
        odds.no_vig(a, h).alias("away_fair"),
    )


@query(
    "f05_cover_and_over_probability",
    "game_id:i home_cover:d over:d",
    f"""SELECT game_id, {sql_cdf('((independent_home_margin + market_home_spread) / 12.5)')} AS home_cover,
    {sql_cdf('((independent_total - market_total) / 9.5)')} AS over FROM benchmark_rows""",
    "benchmark_rows",
)
def _(t):
    return t.benchmark_rows.select(
        "game_id",
        odds.home_cover_probability(
            F.col("independent_home_margin"), F.col("market_home_spread"), F.lit(12.5)
        ).alias("home_cover"),
        odds.over_probability(F.col("independent_total"), F.col("market_total"), F.lit(9.5)).alias("over"),
    )


@query(
    "f06_edge_table",
    "game_id:i book:i spread_side:s spread_probability:d spread_fair:d spread_implied:d spread_edge:d "
    "total_side:s total_probability:d total_fair:d total_implied:d total_edge:d",
    f"""SELECT *, spread_probability - spread_fair AS spread_edge, total_probability - total_fair AS total_edge FROM
    (SELECT game_id, book, CASE WHEN cover >= 0.5 THEN 'home' ELSE 'away' END AS spread_side,
    greatest(cover, 1 - cover) AS spread_probability,
    CASE WHEN cover >= 0.5 THEN hi ELSE ai END / (hi + ai) AS spread_fair,
    CASE WHEN cover >= 0.5 THEN hi ELSE ai END AS spread_implied,
    CASE WHEN over_p >= 0.5 THEN 'Over' ELSE 'Under' END AS total_side, greatest(over_p, 1 - over_p) AS total_probability,
    CASE WHEN over_p >= 0.5 THEN oi ELSE ui END / (oi + ui) AS total_fair,
    CASE WHEN over_p >= 0.5 THEN oi ELSE ui END AS total_implied FROM (
    SELECT q.*, {sql_cdf('((p.predicted_home_margin + q.home_spread) / p.margin_std)')} AS cover,
    {sql_cdf('((p.total - q.total) / p.total_std)')} AS over_p FROM priced q JOIN predictions p USING (game_id)
    WHERE q.away_price IS NOT NULL))""",
    "priced predictions",
)
def _(t):
    forecasts = t.predictions.select(
        "game_id", F.col("predicted_home_margin").alias("margin"), "margin_std", "total", "total_std"
    )
    priced = t.quotes.withColumnRenamed("total", "market_total").where("away_price IS NOT NULL")
    return market.edge_table(priced.join(forecasts, "game_id"))


# --- planning and temporal validity ------------------------------------------------------------

SQL_BINDINGS["kickoffs"] = (
    ("games",),
    """SELECT *, CASE WHEN gametime <> 'TBD' THEN
    timezone('America/New_York', CAST(CAST(gameday AS VARCHAR) || ' ' || gametime || ':00' AS TIMESTAMP)) AT TIME ZONE 'UTC' END AS kickoff_at
    FROM games""",
)


@query(
    "f07_snapshot_plan",
    "kickoff_epoch:i requested_epoch:i games:i first_game:i",
    """SELECT CAST(epoch(kickoff_at) AS BIGINT) AS kickoff_epoch, CAST(epoch(kickoff_at) AS BIGINT) - 1800 AS requested_epoch,
    count(*) AS games, min(game_id) AS first_game FROM kickoffs WHERE kickoff_at IS NOT NULL GROUP BY 1, 2""",
    "kickoffs",
)
def _(t):
    return market.snapshot_plan(t.games).select(
        F.unix_timestamp("kickoff_at").alias("kickoff_epoch"),
        F.unix_timestamp("requested_at").alias("requested_epoch"),
        "games",
        "first_game",
    )


@query(
    "f08_request_budget",
    "requests:i cache_hits:i estimated_credits:i within_budget:i",
    """SELECT count(*) AS requests, sum(hit) AS cache_hits, (count(*) - sum(hit)) * 20 AS estimated_credits,
    CASE WHEN (count(*) - sum(hit)) * 20 <= 100000 THEN 1 ELSE 0 END AS within_budget FROM
    (SELECT kickoff_at, max(CASE WHEN game_id % 3 = 0 THEN 1 ELSE 0 END) AS hit FROM kickoffs WHERE kickoff_at IS NOT NULL GROUP BY 1)""",
    "kickoffs",
)
def _(t):
    plan = market.snapshot_plan(t.games)
    cached = market.snapshot_plan(t.games.where("game_id % 3 = 0"))
    return market.request_budget(plan, cached, max_credits=100000)


def _pair_consensus(t):
    """Consensus per pairing of the schedule, in feed order, some of it stale or after kickoff."""
    kickoff = local_kickoff(F.col("gameday"), F.coalesce(F.nullif("gametime", F.lit("TBD")), F.lit("13:00")))
    return (
        t.games.join(
            t.quotes.groupBy("game_id").agg(
                F.median("home_spread").alias("home_spread"), F.median("total").alias("market_total")
            ),
            "game_id",
        )
        .select(
            "home_team",
            "away_team",
            F.col("game_id").alias("ordinal"),
            "home_spread",
            (-F.col("home_spread")).alias("market_home_margin"),
            F.when(F.col("game_id") % 7 != 0, F.col("market_total")).alias("market_total"),
            F.when(F.col("game_id") % 5 != 0, kickoff).alias("commence_time"),
            (kickoff - F.expr("make_interval(0, 0, 0, CAST(game_id % 9 AS INT) - 1)")).alias("snapshot_at"),
        )
    )


@query(
    "e11_attach_consensus",
    "game_id:i snapshot_epoch:i market_line:d market_margin:d market_total:d market_home_score:d market_away_score:d",
    """SELECT game_id, CASE WHEN ok THEN CAST(epoch(snapshot_at) AS BIGINT) END AS snapshot_epoch,
    CASE WHEN ok THEN home_spread END AS market_line,
    CASE WHEN ok AND mt IS NOT NULL THEN -home_spread END AS market_margin,
    CASE WHEN ok AND mt IS NOT NULL THEN round_even(mt, 1) END AS market_total,
    CASE WHEN ok AND mt IS NOT NULL THEN round_even(greatest((mt - home_spread) / 2, 0), 1) END AS market_home_score,
    CASE WHEN ok AND mt IS NOT NULL THEN round_even(greatest((mt + home_spread) / 2, 0), 1) END AS market_away_score FROM
    (SELECT g.game_id, m.*, COALESCE(m.snapshot_at <= CAST(g.gameday AS TIMESTAMP) AND m.snapshot_at >= CAST(g.gameday AS TIMESTAMP) - INTERVAL 8 DAY
      AND (COALESCE(m.commence_time, g.kickoff_at) IS NULL OR m.snapshot_at < COALESCE(m.commence_time, g.kickoff_at)), FALSE) AS ok
    FROM kickoffs g LEFT JOIN (SELECT home_team, away_team, home_spread, CASE WHEN game_id % 7 <> 0 THEN mt END AS mt,
      CASE WHEN game_id % 5 <> 0 THEN k END AS commence_time, k - to_days(CAST(game_id % 9 - 1 AS INTEGER)) AS snapshot_at FROM
      (SELECT home_team, away_team, game_id, median(home_spread) AS home_spread, median(total) AS mt, any_value(k) AS k FROM
        (SELECT *, timezone('America/New_York', CAST(CAST(gameday AS VARCHAR) || ' ' || CASE WHEN gametime = 'TBD' THEN '13:00' ELSE gametime END || ':00' AS TIMESTAMP)) AT TIME ZONE 'UTC' AS k FROM games)
        JOIN quotes USING (game_id) GROUP BY 1, 2, 3)
      QUALIFY row_number() OVER (PARTITION BY home_team, away_team ORDER BY game_id DESC) = 1) m
    ON m.home_team = g.home_team AND m.away_team = g.away_team)""",
    "kickoffs quotes",
)
def _(t):
    joined = market.attach_consensus(
        t.games, _pair_consensus(t), F.col("gameday").cast("timestamp")
    )
    return joined.withColumn("snapshot_epoch", F.unix_timestamp("market_snapshot_at"))


def _snapshot_events(t):
    """What each request returned: some events moved, late or without a total."""
    kickoff = local_kickoff(F.col("gameday"), F.col("gametime"))
    c = F.col
    return (
        t.games.withColumn("k", kickoff)
        .where("k IS NOT NULL")
        .select(
            (c("k") - F.expr("INTERVAL 30 MINUTES")).alias("requested_at"),
            F.when(c("game_id") % 6 != 0, c("home_team")).alias("home_team"),  # some events name a club nobody knows
            "away_team",
            (c("k") + F.expr("make_interval(0, 0, 0, 0, CAST(game_id % 10 AS INT))")).alias("commence_time"),
            (c("k") + F.expr("make_interval(0, 0, 0, 0, 0, CAST(game_id % 8 AS INT) * 10 - 60)")).alias("snapshot_at"),
            ((c("game_id") % 20) / 2.0).alias("market_home_spread"),
            F.when(c("game_id") % 13 != 0, c("game_id") % 60).cast("double").alias("market_total"),
        )
    )


@query(
    "e12_match_snapshots",
    "game_id:i miss:s market_home_spread:d market_total:d",
    """SELECT g.game_id, CASE WHEN e.k IS NULL OR e.game_id % 13 = 0 THEN 'no event'
      WHEN e.game_id % 10 > 6 THEN 'other kickoff' WHEN (e.game_id % 8) * 10 - 60 >= 0 THEN 'late snapshot' END AS miss,
    CASE WHEN e.k IS NOT NULL THEN (e.game_id % 20) / 2 END AS market_home_spread,
    CASE WHEN e.game_id % 13 <> 0 THEN e.game_id % 60 END AS market_total FROM kickoffs g
    LEFT JOIN (SELECT *, kickoff_at AS k, CASE WHEN game_id % 6 <> 0 THEN home_team END AS host FROM kickoffs WHERE kickoff_at IS NOT NULL) e
    ON e.k = g.kickoff_at AND e.host = g.home_team AND e.away_team = g.away_team""",
    "kickoffs",
)
def _(t):
    return market.match_snapshots(t.games, _snapshot_events(t))


@query(
    "f09_market_scores",
    "game_id:i home_score_market:d away_score_market:d",
    """SELECT game_id, round_even(greatest((market_total + market_home_margin) / 2, 0), 1) AS home_score_market,
    round_even(greatest((market_total - market_home_margin) / 2, 0), 1) AS away_score_market FROM benchmark_rows""",
    "benchmark_rows",
)
def _(t):
    home, away = odds.score_pair(F.col("market_home_margin"), F.col("market_total"))
    return t.benchmark_rows.select(
        "game_id",
        F.bround(home, 1).alias("home_score_market"),
        F.bround(away, 1).alias("away_score_market"),
    )


# --- evaluation --------------------------------------------------------------------------------

_ERR = "independent_home_margin - actual_home_margin"


@query(
    "h01_error_metrics",
    "season:i rows:i mae:d rmse:d bias:d",
    f"""SELECT season, count(*) AS "rows", avg(abs({_ERR})) AS mae, sqrt(avg(({_ERR}) * ({_ERR}))) AS rmse,
    avg({_ERR}) AS bias FROM benchmark_rows GROUP BY 1""",
    "benchmark_rows",
)
def _(t):
    return evaluate.metrics_by(
        t.benchmark_rows, ["season"], "actual_home_margin", "independent_home_margin"
    )


def _split_sql() -> str:
    splits = [
        ("'all_oof'", "true"),
        ("'development'", "season < 2000"),
        ("'holdout'", "season = 2000"),
        ("'weeks_1_4'", "\"week\" <= 4"),
        ("'development_weeks_1_4'", "\"week\" <= 4 AND season < 2000"),
        ("'holdout_weeks_1_4'", "\"week\" <= 4 AND season = 2000"),
        ("'season_' || season", "true"),
        ("'weeks_1_4_season_' || season", "\"week\" <= 4"),
    ]
    return " UNION ALL ".join(
        f"SELECT {name} AS split, count(*) AS \"rows\", avg(abs({_ERR})) AS mae, "
        f"sqrt(avg(({_ERR}) * ({_ERR}))) AS rmse, avg({_ERR}) AS bias FROM benchmark_rows WHERE {rows} GROUP BY 1"
        for name, rows in splits
    )


@query("h02_split_metrics", "split:s rows:i mae:d rmse:d bias:d", _split_sql(), "benchmark_rows")
def _(t):
    return evaluate.split_metrics(
        t.benchmark_rows, "actual_home_margin", "independent_home_margin", holdout_season=2000
    )


def _prequential_sql(target: str, actual: str, first: str, second: str) -> str:
    return f"""SELECT season, "week", CASE WHEN any_value(nb) >= 64 THEN
    arg_min(w, {{'e': round(eb, 6), 'w': w}}) ELSE 0.5 END AS weight FROM (
    SELECT season, "week", w, sum(e) OVER p AS eb, sum(n) OVER p AS nb FROM (
      SELECT season, "week", i / 100.0 AS w, sum(abs({actual} - ((i / 100.0) * {first} + (1.0 - i / 100.0) * {second}))) AS e,
      count(*) AS n FROM benchmark_rows, range(0, 101) r(i) GROUP BY 1, 2, 3)
    WINDOW p AS (PARTITION BY w ORDER BY season, "week" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY 1, 2"""


SQL_BINDINGS["margin_weights"] = (
    ("benchmark_rows",),
    _prequential_sql("margin", "actual_home_margin", "market_home_margin", "independent_home_margin"),
)
SQL_BINDINGS["total_weights"] = (
    ("benchmark_rows",),
    _prequential_sql("total", "actual_total_points", "market_total", "independent_total"),
)
SQL_BINDINGS["blended"] = (
    ("margin_weights", "total_weights"),
    """SELECT b.*, m.weight AS market_margin_weight, t.weight AS market_total_weight,
    m.weight * market_home_margin + (1 - m.weight) * independent_home_margin AS blended_margin,
    t.weight * market_total + (1 - t.weight) * independent_total AS blended_total
    FROM benchmark_rows b JOIN margin_weights m USING (season, "week") JOIN total_weights t USING (season, "week")""",
)


@query("d22_prequential_weights", "season:i week:i weight:d", "SELECT * FROM margin_weights", "margin_weights")
def _(t):
    return evaluate.prequential_weights(
        t.benchmark_rows, "actual_home_margin", "market_home_margin", "independent_home_margin"
    )


@query(
    "g05_h08_prequential_market_blend",
    "game_id:i market_margin_weight:d blended_margin:d market_total_weight:d blended_total:d",
    "SELECT * FROM blended",
    "blended",
)
def _(t):
    return evaluate.market_blends(t.benchmark_rows)


_GRID_BEST = """SELECT arg_min(w, {{'e': round(e, 6), 'w': w}}) AS weight FROM (SELECT i / 100.0 AS w,
    sum(abs({a} - ((i / 100.0) * {f} + (1.0 - i / 100.0) * {s}))) AS e FROM benchmark_rows, range(0, 101) r(i) GROUP BY 1)"""


@query(
    "g05_mae_grid_weight",
    "weight:d",
    _GRID_BEST.format(a="actual_home_margin", f="market_home_margin", s="independent_home_margin"),
    "benchmark_rows",
)
def _(t):
    return evaluate.mae_weight(
        t.benchmark_rows, "actual_home_margin", "market_home_margin", "independent_home_margin"
    )


@query(
    "g04_least_squares_weight",
    "weight:d",
    """SELECT CASE WHEN sum((f - s) * (f - s)) > 1e-12 THEN
    least(greatest(sum((f - s) * (a - s)) / sum((f - s) * (f - s)), 0), 1) ELSE 0.5 END AS weight FROM
    (SELECT actual_total_points AS a, market_total AS f, independent_total AS s FROM benchmark_rows)""",
    "benchmark_rows",
)
def _(t):
    return evaluate.least_squares_weight(
        t.benchmark_rows, "actual_total_points", "market_total", "independent_total"
    )


@query(
    "h03_variant_mae_by_season",
    "season:i games:i independent_mae:d market_mae:d blended_mae:d",
    """SELECT season, count(*) AS games, avg(abs(independent_home_margin - actual_home_margin)) AS independent_mae,
    avg(abs(market_home_margin - actual_home_margin)) AS market_mae, avg(abs(blended_margin - actual_home_margin)) AS blended_mae
    FROM blended GROUP BY 1""",
    "blended",
)
def _(t):
    return evaluate.variant_mae_by_season(
        evaluate.market_blends(t.benchmark_rows),
        "actual_home_margin",
        {"independent": "independent_home_margin", "market": "market_home_margin", "blended": "blended_margin"},
    )


_SCORED = (
    "predictions",
    """SELECT season, home_score - away_score AS actual, predicted_home_margin AS predicted, margin_std AS std,
    home_win_probability AS p, CASE WHEN home_score > away_score THEN 1.0 ELSE 0.0 END AS outcome
    FROM predictions WHERE home_score IS NOT NULL""",
)
SQL_BINDINGS["scored"] = ((_SCORED[0],), _SCORED[1])


def _scored(t):
    return t.predictions.where("home_score IS NOT NULL").select(
        "season",
        (F.col("home_score") - F.col("away_score")).alias("actual"),
        F.col("predicted_home_margin").alias("predicted"),
        F.col("margin_std").alias("std"),
        F.col("home_win_probability").alias("p"),
        (F.col("home_score") > F.col("away_score")).cast("double").alias("outcome"),
    )


@query(
    "h04_interval_metrics",
    "season:i interval_80_coverage:d pinball_p10:d pinball_p90:d",
    """SELECT season, avg(CASE WHEN actual BETWEEN predicted - 1.2816 * std AND predicted + 1.2816 * std THEN 1.0 ELSE 0.0 END) AS interval_80_coverage,
    avg(greatest(0.1 * (actual - (predicted - 1.2816 * std)), -0.9 * (actual - (predicted - 1.2816 * std)))) AS pinball_p10,
    avg(greatest(0.9 * (actual - (predicted + 1.2816 * std)), -0.1 * (actual - (predicted + 1.2816 * std)))) AS pinball_p90
    FROM scored GROUP BY 1""",
    "scored",
)
def _(t):
    m = evaluate.interval_metrics(F.col("actual"), F.col("predicted"), F.col("std"))
    return _scored(t).groupBy("season").agg(*[c.alias(n) for n, c in m.items()])


@query(
    "h05_probability_metrics",
    "season:i brier:d log_loss:d",
    """SELECT season, avg((p - outcome) * (p - outcome)) AS brier,
    -avg(outcome * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - outcome) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6))) AS log_loss
    FROM scored GROUP BY 1""",
    "scored",
)
def _(t):
    m = evaluate.probability_metrics(F.col("p"), F.col("outcome"))
    return _scored(t).groupBy("season").agg(*[c.alias(n) for n, c in m.items()])


@query(
    "h06_calibration_error",
    "calibration_error:d rows:i",
    """SELECT sum(n * abs(pm - om)) / sum(n) AS calibration_error, sum(n) AS "rows" FROM
    (SELECT count(*) AS n, avg(p) AS pm, avg(outcome) AS om FROM scored GROUP BY least(CAST(floor(p * 10) AS INTEGER), 9))""",
    "scored",
)
def _(t):
    return evaluate.calibration_error(_scored(t), "p", "outcome")


SQL_BINDINGS["buckets"] = (
    ("benchmark_rows",),
    """SELECT d.bucket, COALESCE(games, 0) AS games, COALESCE(ats_decisions, 0) AS ats_decisions, ats_win_rate,
    independent_margin_mae, market_margin_mae FROM (VALUES ('under_2'), ('2_to_4'), ('4_to_7'), ('7_plus')) d(bucket)
    LEFT JOIN (SELECT CASE WHEN abs(gap) < 2 THEN 'under_2' WHEN abs(gap) < 4 THEN '2_to_4' WHEN abs(gap) < 7 THEN '4_to_7' ELSE '7_plus' END AS bucket,
      count(*) AS games, count(CASE WHEN r <> 0 THEN 1 END) AS ats_decisions,
      avg(CASE WHEN r > 0 THEN 1.0 WHEN r < 0 THEN 0.0 END) AS ats_win_rate,
      avg(abs(independent_home_margin - actual_home_margin)) AS independent_margin_mae,
      avg(abs(market_home_margin - actual_home_margin)) AS market_margin_mae FROM
      (SELECT *, independent_home_margin - market_home_margin AS gap,
        sign(actual_home_margin - market_home_margin) * sign(independent_home_margin - market_home_margin) AS r FROM benchmark_rows)
      GROUP BY 1) b USING (bucket)""",
)


@query(
    "h07_disagreement_buckets",
    "bucket:s games:i ats_decisions:i ats_win_rate:d independent_margin_mae:d market_margin_mae:d",
    "SELECT * FROM buckets",
    "buckets",
)
def _(t):
    return evaluate.disagreement_buckets(t.benchmark_rows)


@query(
    "h09_snapshot_audit",
    "timestamp_violations:i spread_sign_violations:i minimum_lead_minutes:d maximum_lead_minutes:d",
    """SELECT sum(CASE WHEN lead_m <= 0 THEN 1 ELSE 0 END) AS timestamp_violations, 0 AS spread_sign_violations,
    min(lead_m) AS minimum_lead_minutes, max(lead_m) AS maximum_lead_minutes FROM
    (SELECT 60 - (game_id % 8) * 10 AS lead_m FROM kickoffs JOIN (SELECT DISTINCT game_id FROM quotes) USING (game_id)
     WHERE home_score IS NOT NULL AND kickoff_at IS NOT NULL)""",
    "kickoffs quotes",
)
def _(t):
    kickoff = local_kickoff(F.col("gameday"), F.col("gametime"))
    rows = t.benchmark_rows.withColumn("k", kickoff).where("k IS NOT NULL")
    snapshot = F.col("k") + F.expr("make_interval(0, 0, 0, 0, 0, CAST(game_id % 8 AS INT) * 10 - 60)")
    return evaluate.snapshot_audit(rows, F.col("k"), snapshot)


def _variant_sql() -> str:
    out = []
    for name, a, p in (
        ("independent_margin", "actual_home_margin", "independent_home_margin"),
        ("market_margin", "actual_home_margin", "market_home_margin"),
        ("walk_forward_blended_margin", "actual_home_margin", "blended_margin"),
        ("independent_total", "actual_total_points", "independent_total"),
        ("market_total", "actual_total_points", "market_total"),
        ("walk_forward_blended_total", "actual_total_points", "blended_total"),
    ):
        for metric, expr in (
            ("mae", f"avg(abs({p} - {a}))"),
            ("rmse", f"sqrt(avg(({p} - {a}) * ({p} - {a})))"),
            ("bias", f"avg({p} - {a})"),
        ):
            out.append(f"SELECT 'variant' AS section, '{name}' AS item, '{metric}' AS metric, {expr} AS \"value\" FROM blended")
    for item, metric, expr in (
        ("all", "games", "count(*)"),
        ("all", "average_books", "avg(book_count)"),
        ("latest", "market_margin_weight", "arg_max(market_margin_weight, season * 100 + \"week\")"),
        ("latest", "market_total_weight", "arg_max(market_total_weight, season * 100 + \"week\")"),
    ):
        out.append(f"SELECT 'summary', '{item}', '{metric}', {expr} FROM blended")
    for metric, expr in (
        ("games", "count(*)"),
        ("independent_mae", "avg(abs(independent_home_margin - actual_home_margin))"),
        ("market_mae", "avg(abs(market_home_margin - actual_home_margin))"),
        ("blended_mae", "avg(abs(blended_margin - actual_home_margin))"),
    ):
        out.append(f"SELECT 'by_season', CAST(season AS VARCHAR), '{metric}', {expr} FROM blended GROUP BY season")
    for metric in ("games", "ats_decisions", "ats_win_rate", "independent_margin_mae", "market_margin_mae"):
        out.append(f"SELECT 'disagreement', bucket, '{metric}', {metric} FROM buckets")
    for name, a, f, s in (
        ("margin", "actual_home_margin", "market_home_margin", "independent_home_margin"),
        ("total", "actual_total_points", "market_total", "independent_total"),
    ):
        out.append(f"SELECT 'future_weight', '{name}', 'market_weight', weight FROM ({_GRID_BEST.format(a=a, f=f, s=s)})")
    return " UNION ALL ".join(out)


@query(
    "h10_aggregate_report",
    "section:s item:s metric:s value:d",
    _variant_sql(),
    "blended buckets",
)
def _(t):
    return evaluate.aggregate_report(t.benchmark_rows)


@query(
    "h18_relative_improvement",
    "season:i improvement:d",
    """SELECT season, (avg(abs(market_home_margin - actual_home_margin)) - avg(abs(independent_home_margin - actual_home_margin)))
    / nullif(avg(abs(market_home_margin - actual_home_margin)), 0) AS improvement FROM benchmark_rows GROUP BY 1""",
    "benchmark_rows",
)
def _(t):
    rows = evaluate.variant_mae_by_season(
        t.benchmark_rows,
        "actual_home_margin",
        {"model": "independent_home_margin", "baseline": "market_home_margin"},
    )
    return rows.withColumn(
        "improvement", F.try_divide(F.col("baseline_mae") - F.col("model_mae"), F.col("baseline_mae"))
    )


@query(
    "h19_featured_game",
    "season:i week:i game_id:i predicted_home_margin:d",
    """SELECT season, "week", game_id, predicted_home_margin FROM predictions
    QUALIFY row_number() OVER (PARTITION BY season, "week" ORDER BY abs(predicted_home_margin) DESC, game_id) = 1""",
    "predictions",
)
def _(t):
    order = F.struct(-F.abs("predicted_home_margin"), F.col("game_id"))
    best = F.min_by(F.struct("game_id", "predicted_home_margin"), order)
    return t.predictions.groupBy("season", "week").agg(best.alias("b")).select("season", "week", "b.*")


@query(
    "g07_forecast_distribution",
    "game_id:i std:d p10:d p90:d probability_above_zero:d",
    f"""SELECT game_id, margin_std AS std, predicted_home_margin - 1.2816 * margin_std AS p10,
    predicted_home_margin + 1.2816 * margin_std AS p90, {sql_cdf('(predicted_home_margin / margin_std)')} AS probability_above_zero
    FROM predictions""",
    "predictions",
)
def _(t):
    return evaluate.forecast_distribution(
        t.predictions, "predicted_home_margin", F.col("margin_std")
    )
