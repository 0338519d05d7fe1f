"""Registered queries: feeds, ledgers, scenarios, labels, whole jobs and streams."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import odds, text, timeparse
from ..session import cut_lineage, store
from ..operators import boosting, college, ensemble, players, ridge, roster, scenario, teamform
from ..sources import feeds, ledger, releases
from ..streaming import quotes as stream
from . import catalog_college as cc
from . import jobs
from .bindings import SQL_BINDINGS, sql_cdf
from .catalog_form import _features_sql, game_features_all, game_features_completed
from .catalog_models import ridge_bindings
from .catalog_players import club_log
from .registry import query

# --- feeds ---------------------------------------------------------------------------------------


@query(
    "a01_a12_available_seasons",
    "season:i games:i",
    "SELECT season, count(*) AS games FROM games WHERE season IN (1996, 1999, 2000) GROUP BY 1",
    "games",
)
def _(t):
    """Union of the published seasons; a season nobody published is skipped."""
    parts = [{"games": t.games.where(F.col("season") == s)} for s in (1996, 1999, 2000, 2050)]
    return feeds.combine_bundles(parts)["games"].groupBy("season").agg(F.count(F.lit(1)).alias("games"))


@query(
    "a03_roster_season_fallback",
    "season:i gsis_id:s rows:i",
    """SELECT season, gsis_id, count(*) AS "rows" FROM (SELECT season, gsis_id FROM rosters WHERE season = 2024
    UNION ALL SELECT season, gsis_id FROM rosters WHERE season = 2023 AND status = 'ACT') GROUP BY 1, 2""",
    "rosters",
)
def _(t):
    weekly = t.rosters.where("season = 2024")
    seasonal = t.rosters.where("status = 'ACT'").drop("event_id")
    both = feeds.with_season_fallback(weekly, seasonal)
    return both.groupBy("season", "gsis_id").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "a13_combine_bundles",
    "season:i games:i lines:i",
    """SELECT season, count(*) AS games, count(CASE WHEN game_id IN (SELECT game_id FROM clines) THEN 1 END) AS lines FROM games GROUP BY 1""",
    "games clines",
)
def _(t):
    listed = cc.lines(t)
    parts = [
        {"games": t.games.where("season < 2001"), "lines": listed.where("game_id % 2 = 0")},
        {"games": t.games.where("season >= 2001"), "lines": listed.where("game_id % 2 = 1")},
    ]
    both = feeds.combine_bundles(parts)
    joined = both["games"].join(both["lines"].select("game_id", F.lit(1).alias("l")), "game_id", "left")
    return joined.groupBy("season").agg(F.count(F.lit(1)).alias("games"), F.count("l").alias("lines"))


@query(
    "a16_fingerprint",
    "feed:s columns:s rows:i same_in_any_order:i changed_by_a_row:i changed_by_a_value:i",
    """SELECT 'plays' AS feed, 'game_id,posteam,play_type,epa' AS columns, count(*) AS "rows", 1 AS same_in_any_order, 1 AS changed_by_a_row, 1 AS changed_by_a_value FROM plays
    UNION ALL SELECT 'rosters', 'season,team,gsis_id,status', count(*), 1, 1, 1 FROM rosters""",
    "plays rosters",
)
def _(t):
    """Digests of two feeds, of the same rows in another order, of all but one row, and of one changed value."""
    feeds_ = {"plays": (t.plays, ["game_id", "posteam", "play_type", "epa", "not_there"]), "rosters": (t.rosters, ["season", "team", "gsis_id", "status"])}

    def first(df, column):
        return df.where(F.col(column).isNotNull()).agg(F.min(column)).first()[0]

    out = feeds.fingerprint(feeds_).select("feed", "columns", "rows", "digest")
    others = {"same_in_any_order": {}, "changed_by_a_row": {}, "changed_by_a_value": {}}
    for name, (df, wanted) in feeds_.items():
        key = "game_id" if name == "plays" else "gsis_id"
        value = first(df, key)
        others["same_in_any_order"][name] = (df.repartition(7, key).sortWithinPartitions(F.desc(key)), wanted)
        others["changed_by_a_row"][name] = (df.unionByName(df.where(F.col(key) == value).limit(1)), wanted)
        last = wanted[3]
        others["changed_by_a_value"][name] = (df.withColumn(last, F.when(F.col(key) == value, F.lit(None)).otherwise(F.col(last))), wanted)
    for what, changed in others.items():
        again = feeds.fingerprint(changed).select("feed", F.col("digest").alias(what))
        same = F.col("digest") == F.col(what)
        out = out.join(again, "feed").withColumn(what, (same if what == "same_in_any_order" else ~same).cast("int"))
    return out


@query(
    "a20_distinct_snapshots",
    "request_kind:s snapshot_at:s payload:i",
    """SELECT event_type AS request_kind, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS snapshot_at, event_id AS payload FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id) = 1""",
)
def _(t):
    rows = t.read("events").select(
        F.col("event_type").alias("request_kind"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("snapshot_at"),
        F.col("event_id").alias("payload"),
        F.col("event_id").alias("ordinal"),
    )
    return ledger.distinct_snapshots(rows)


@query(
    "a21_season_context",
    "gameday:s season:i first_training:i",
    """SELECT DISTINCT gameday, CASE WHEN month(gameday) * 100 + day(gameday) >= 315 THEN year(gameday) ELSE year(gameday) - 1 END AS season,
    season - 4 AS first_training FROM (SELECT gameday FROM games)""",
    "games",
)
def _(t):
    day = F.col("gameday")
    return t.games.select("gameday").distinct().select(
        "gameday",
        timeparse.league_year(day).alias("season"),
        F.element_at(timeparse.training_seasons(day), 1).alias("first_training"),
    )


@query(
    "a22_season_list",
    "customers:i season:i",
    """SELECT count(*) AS customers, season FROM (SELECT c_custkey, unnest(list_distinct(list_concat(
    range(2000 + c_custkey % 7, 2000 + c_custkey % 7 + 1 + c_nationkey % 4), [2003 + c_custkey % 2]))) AS season FROM customer) GROUP BY 2""",
)
def _(t):
    wanted = F.format_string(
        "%d-%d,%d",
        2000 + F.col("c_custkey") % 7,
        2000 + F.col("c_custkey") % 7 + F.col("c_nationkey") % 4,
        2003 + F.col("c_custkey") % 2,
    )
    seasons = t.read("customer").select(F.explode(timeparse.parse_season_list(wanted)).alias("season"))
    return seasons.groupBy("season").agg(F.count(F.lit(1)).alias("customers"))


@query(
    "b03_upcoming_games",
    "game_id:i week:i",
    """SELECT game_id, "week" FROM games WHERE season = 2001 AND home_score IS NULL
    AND "week" = (SELECT min("week") FROM games WHERE season = 2001 AND home_score IS NULL)""",
    "games",
)
def _(t):
    return feeds.upcoming_games(t.games, 2001)


def _injuries(t):
    day = F.dayofmonth("ts")
    return t.read("events").select(
        F.when(day <= 15, 2023).otherwise(2024).alias("season"),
        (F.floor((day - 1) / 7) + 1).cast("int").alias("week"),
        F.col("event_id").alias("entry"),
        F.concat(F.lit("g"), F.col("user_id")).alias("gsis_id"),
        F.expr("CASE WHEN event_type = 'error' THEN 'Out' END").alias("report_status"),
        F.expr("CASE WHEN event_type = 'view' THEN 'Limited' END").alias("practice_status"),
    )


@query(
    "c12_latest_injury_report",
    "entry:i gsis_id:s report_status:s practice_status:s stale:i",
    """SELECT event_id AS entry, 'g' || user_id AS gsis_id, CASE WHEN event_type = 'error' THEN 'Out' END AS report_status,
    CASE WHEN event_type = 'view' THEN 'Limited' END AS practice_status, 1 AS stale FROM events
    WHERE event_type IN ('error', 'view') AND day(ts) > 15 AND (day(ts) - 1) // 7 = (SELECT max((day(ts) - 1) // 7) FROM events WHERE day(ts) > 15)""",
)
def _(t):
    return feeds.latest_injuries(_injuries(t), 2025)


# --- ledger --------------------------------------------------------------------------------------

def _runs(t):
    """The forecasts of a game as three batches issued on different days."""
    base = t.predictions.select(
        F.concat(F.lit("run"), F.col("game_id") % 3).alias("run_id"),
        "game_id",
        "predicted_home_margin",
        "total",
        F.expr("CASE WHEN game_id % 4 = 0 THEN predicted_home_margin + 1 END").alias("football_margin"),
        F.expr("CASE WHEN game_id % 4 = 0 THEN total + 1 END").alias("football_total"),
        F.expr("CASE WHEN game_id % 5 = 0 THEN predicted_home_margin - 2 END").alias("market_margin"),
        F.expr("CASE WHEN game_id % 5 = 0 THEN total - 2 END").alias("market_total"),
    )
    return base


SQL_BINDINGS["runs"] = (
    ("predictions",),
    """SELECT *, 'run' || game_id % 3 AS run_id, home_score - away_score AS am, home_score + away_score AS at_ FROM predictions WHERE home_score IS NOT NULL""",
)


@query(
    "e13_results_join",
    "run_id:s game_id:i actual_home_margin:d margin_absolute_error:d total_absolute_error:d winner_correct:d",
    """SELECT run_id, game_id, am AS actual_home_margin, abs(predicted_home_margin - am) AS margin_absolute_error, abs(total - at_) AS total_absolute_error,
    CASE WHEN (predicted_home_margin > 0) = (am > 0) THEN 1 ELSE 0 END AS winner_correct FROM runs""",
    "runs",
)
def _(t):
    return ledger.score_rows(_runs(t), t.games)


@query(
    "h11_ledger_summaries",
    "run_id:s games:i margin_mae:d total_mae:d winner_accuracy:d football_margin_mae:d football_total_mae:d market_games:i market_margin_mae:d market_total_mae:d",
    """SELECT run_id, count(*) AS games, avg(abs(predicted_home_margin - am)) AS margin_mae, avg(abs(total - at_)) AS total_mae,
    avg(CASE WHEN (predicted_home_margin > 0) = (am > 0) THEN 1.0 ELSE 0.0 END) AS winner_accuracy,
    avg(CASE WHEN game_id % 4 = 0 THEN abs(predicted_home_margin + 1 - am) END) AS football_margin_mae,
    avg(CASE WHEN game_id % 4 = 0 THEN abs(total + 1 - at_) END) AS football_total_mae,
    count(CASE WHEN game_id % 5 = 0 THEN 1 END) AS market_games,
    avg(CASE WHEN game_id % 5 = 0 THEN abs(predicted_home_margin - 2 - am) END) AS market_margin_mae,
    avg(CASE WHEN game_id % 5 = 0 THEN abs(total - 2 - at_) END) AS market_total_mae FROM runs GROUP BY 1""",
    "runs",
)
def _(t):
    return ledger.run_summaries(ledger.score_rows(_runs(t), t.games))


@query(
    "a18_unscored_runs",
    "run_id:s games:i",
    "SELECT 'run' || game_id % 3 AS run_id, count(*) AS games FROM predictions WHERE game_id % 3 <> 1 GROUP BY 1",
    "predictions",
)
def _(t):
    done = _runs(t).where("run_id = 'run1'")
    return ledger.unscored_runs(_runs(t), done).groupBy("run_id").agg(F.count(F.lit(1)).alias("games"))


def _batches(t):
    return t.predictions.select(
        F.format_string("run%03d", F.col("game_id") % 50).alias("run_id"),
        F.concat(F.lit("h"), F.col("game_id") % 50).alias("model_hash"),
        F.col("season").alias("prediction_season"),
        F.to_timestamp(F.date_add("gameday", 1)).alias("created_at"),
        "game_id",
    )


def _shared(t) -> str:
    """A fresh folder that all executors see."""
    return jobs.shared_root(t.spark)


@query(
    "a01_a02_read_published_seasons",
    "season:i games:i home_points:d",
    """SELECT season, count(*) AS games, sum(home_score) AS home_points FROM games
    WHERE season BETWEEN 1990 AND (SELECT max(season) - 1 FROM games) GROUP BY 1""",
    "games",
)
def _(t):
    """Seasons published in folders are found and read; seasons nobody published are skipped."""
    root = _shared(t)
    wanted = "season int, game_id bigint, home_score double"
    rows = t.games.select("season", F.col("game_id").cast("bigint").alias("game_id"), F.col("home_score").cast("double").alias("home_score"))
    newest = rows.agg(F.max("season")).first()[0]
    rows.write.partitionBy("season").parquet(root)
    read = feeds.read_seasons(t.spark, root, list(range(1980, newest)), wanted)
    feeds.require_rows({"games": read}, ["games"])
    return read.groupBy("season").agg(F.count(F.lit(1)).alias("games"), F.sum("home_score").alias("home_points"))


@query(
    "a17_a18_recorded_and_scored",
    "run_id:s game_id:i model_hash:s prediction_season:i margin_absolute_error:d total_absolute_error:d",
    """SELECT run_id, game_id, 'h-' || run_id AS model_hash, 2001 AS prediction_season, abs(predicted_home_margin - am) AS margin_absolute_error,
    abs(total - at_) AS total_absolute_error FROM runs WHERE run_id <> 'run2'""",
    "runs",
)
def _(t):
    """Three batches are written once each, two of them scored once each, and the scores read back."""
    root = _shared(t)
    for run in ("run0", "run1", "run2"):
        batch = _runs(t).where(F.col("run_id") == run).drop("run_id")
        ledger.record_batch(
            batch, root, run_id=run, created_at="2001-06-01 00:00:00", model_hash=f"h-{run}", data_cutoff="2001-05-31", prediction_season=2001
        )
    for run in ("run0", "run1"):
        ledger.record_scores(t.spark, root, run, t.games, "2001-12-01 00:00:00")
    return ledger.read_scores(t.spark, root)


@query(
    "a20_a24_published_pairs",
    "release:s part:s season:i rows:i value:d",
    """SELECT 'benchmark' AS release, 'matched' AS part, season, count(*) AS "rows", sum(actual_home_margin) AS value FROM benchmark_rows GROUP BY season
    UNION ALL SELECT 'benchmark', 'report', season, count(*), avg(abs(independent_home_margin - actual_home_margin)) FROM benchmark_rows GROUP BY season
    UNION ALL SELECT 'closing', 'consensus', NULL, count(*), sum(market_home_spread) FROM quote_medians
    UNION ALL SELECT 'closing', 'raw', NULL, count(*), sum(home_spread) FROM quotes""",
    "benchmark_rows quote_medians quotes",
)
def _(t):
    """Two pairs of tables, each published by one manifest and read back; a pair whose second table fails stays unseen."""
    root, spark = _shared(t), t.spark
    rows = t.benchmark_rows
    report = rows.groupBy("season").agg(F.count(F.lit(1)).alias("games"), F.avg(F.abs(F.col("independent_home_margin") - F.col("actual_home_margin"))).alias("mae"))
    ledger.save_benchmark(rows, report, root, "benchmark-1")
    for stamp in ("20010101T000000Z", "20010102T000000Z"):
        raw = t.quotes.where("home_spread > 1e9") if stamp < "20010102" else t.quotes  # the first request came back empty
        medians = raw.groupBy("game_id").agg(F.median("home_spread").alias("market_home_spread"))
        ledger.save_snapshot(raw.select("game_id", "home_spread"), medians, root, request_kind="closing", stamp=stamp)
    broken = report.select(F.raise_error(F.lit("no report")).alias("games"))
    try:
        ledger.save_benchmark(rows, broken, root, "benchmark-2")
    except Exception as failed:  # noqa: BLE001
        if "no report" not in str(failed):
            raise
    matched = releases.read_published(spark, root, "matched", start="benchmark-")
    parts = [
        matched.groupBy("season").agg(F.count(F.lit(1)).alias("rows"), F.sum("actual_home_margin").alias("value")).withColumn("part", F.lit("matched")),
        releases.read_published(spark, root, "report", start="benchmark-").select("season", F.col("games").alias("rows"), F.col("mae").alias("value"), F.lit("report").alias("part")),
        ledger.current_consensus(spark, root, "closing").agg(F.count(F.lit(1)).alias("rows"), F.sum("market_home_spread").alias("value")).withColumns({"part": F.lit("consensus"), "season": F.lit(None).cast("int")}),
        releases.read_published(spark, root, "raw", start="closing-").agg(F.count(F.lit(1)).alias("rows"), F.sum("home_spread").alias("value")).withColumns({"part": F.lit("raw"), "season": F.lit(None).cast("int")}),
    ]
    out = None
    for part in parts:
        named = part.withColumn("release", F.when(F.col("part").isin("matched", "report"), "benchmark").otherwise("closing"))
        out = named if out is None else out.unionByName(named)
    return out


@query(
    "a23_publish_by_season",
    "prediction_season:i games:i total:d",
    """SELECT season AS prediction_season, count(*) AS games, sum(CASE WHEN season = 2000 THEN total + 1 ELSE total END) AS total
    FROM predictions WHERE season IN (1999, 2000) GROUP BY 1""",
    "predictions",
)
def _(t):
    """Publishing a season again replaces it and leaves the other one alone."""
    root = _shared(t)
    for season, shift in ((1999, 0.0), (2000, 0.0), (2000, 1.0)):
        rows = t.predictions.where(F.col("season") == season).select("game_id", (F.col("total") + shift).alias("total"))
        ledger.publish(rows, root, "forecasts", season)
    read = t.spark.read.parquet(f"{root}/forecasts")
    return read.groupBy("prediction_season").agg(F.count(F.lit(1)).alias("games"), F.sum("total").alias("total"))


@query(
    "a19_latest_run",
    "run_id:s model_hash:s",
    """SELECT printf('run%03d', game_id % 50) AS run_id, 'h' || game_id % 50 AS model_hash FROM predictions
    ORDER BY gameday DESC, game_id % 50 DESC LIMIT 1""",
    "predictions",
)
def _(t):
    return ledger.latest_run(_batches(t))


@query(
    "h17_release_consistency",
    "hashes:i consistent:i",
    "SELECT count(DISTINCT game_id % 50) AS hashes, CASE WHEN count(DISTINCT game_id % 50) = 1 THEN 1 ELSE 0 END AS consistent FROM predictions",
    "predictions",
)
def _(t):
    return ledger.release_consistency(_batches(t), _batches(t).where("season = 2000"))


@query(
    "g14_model_registry",
    "model:s target:s features:i intercept:d first_weight:d residual_std:d digest_length:i altered_fails:i",
    """SELECT 'game_margin' AS model, 'home_margin' AS target, len(w) AS features, c AS intercept, w[1] AS first_weight,
    (SELECT stddev_samp(actual - predicted) FROM tune_margin_50) AS residual_std, 64 AS digest_length, 1 AS altered_fails FROM game_margin_last
    UNION ALL SELECT 'game_total', 'total_points', len(w), c, w[1], (SELECT stddev_samp(actual - predicted) FROM tune_total_50), 64, 1 FROM game_total_last""",
    "game_margin_last game_total_last tune_margin_50 tune_total_50",
)
def _(t):
    """The game models written once, read back with their digests verified; an altered copy fails on read."""
    root = _shared(t)
    models = jobs.game_models(game_features_completed(t))
    ledger.save_models(models, root, "v1")
    loaded = ledger.load_models(t.spark, root, "v1")
    kept = t.spark.read.parquet(f"{root}/models/version=v1")
    kept.withColumn("intercept", F.col("intercept") + 1).write.parquet(f"{root}/models/version=v2")
    try:
        ledger.load_models(t.spark, root, "v2").collect()  # two rows
        fails = 0
    except Exception as mismatch:  # noqa: BLE001
        fails = int("checksum mismatch" in str(mismatch))
    return loaded.select(
        "model", "target", F.size("features").alias("features"), "intercept", F.element_at("coefficients", 1).alias("first_weight"),
        "residual_std", F.length("sha256").alias("digest_length"), F.lit(fails).alias("altered_fails"),
    )


@query(
    "g15_h16_published_under_contract",
    "what:s count:i",
    """SELECT unnest(['rows', 'missing_result', 'missing_feature', 'drifted', 'read']) AS what,
    unnest([count(*), count(CASE WHEN home_margin IS NULL THEN 1 END), 0, 0, count(*)]) AS count FROM features""",
    "features",
)
def _(t):
    """All game features published while their contract is counted; a table with a missing feature is refused."""
    root, games = _shared(t), store(game_features_all(t))  # published twice, made once
    configurations = t.spark.createDataFrame([(n, list(f)) for n, f in college.CONFIGURATIONS.items()], "name string, features array<string>")
    counts = jobs.publish_features(games, teamform.CORE_GAME_FEATURES, root, "features-1", configurations=configurations)
    holed = games.withColumn("home_rest_days", F.when(F.col("week") != 3, F.col("home_rest_days")))
    try:
        jobs.publish_features(holed, teamform.CORE_GAME_FEATURES, root, "features-2")
    except releases.ContractError:
        pass
    read = releases.read_published(t.spark, root, "features", start="features-").agg(F.count(F.lit(1)).alias("count")).select(F.lit("read").alias("what"), "count")
    drifted = jobs.configuration_drift(configurations).agg(F.count_if("drifted").alias("count")).select(F.lit("drifted").alias("what"), "count")
    return t.spark.createDataFrame(list(counts.items()), "what string, count bigint").unionByName(drifted).unionByName(read)


# --- scenarios -----------------------------------------------------------------------------------

def _injury_scenario(t):
    positions = F.array(*[F.lit(p) for p in ["QB", "RB1", "WR2", "DEF_STAR", "K"]])
    statuses = F.array(*[F.lit(s) for s in ["OUT", "DOUBTFUL", "QUESTIONABLE", "PROBABLE"]])
    return t.read("customer").select(
        F.concat(F.lit("L0T"), F.col("c_custkey") % 40).alias("team"),
        F.concat(F.lit("Player "), F.floor(F.col("c_custkey") / 80)).alias("player_name"),
        F.element_at(positions, (F.col("c_nationkey") % 5 + 1).cast("int")).alias("position"),
        F.element_at(statuses, (F.col("c_custkey") % 4 + 1).cast("int")).alias("status"),
        F.col("c_custkey").alias("ordinal"),
    )


SQL_BINDINGS["injury_rows"] = (
    (),
    """SELECT *, CASE status WHEN 'OUT' THEN 1.0 WHEN 'DOUBTFUL' THEN 0.75 WHEN 'QUESTIONABLE' THEN 0.35 ELSE 0.0 END AS missing FROM
    (SELECT 'L0T' || c_custkey % 40 AS team, 'Player ' || c_custkey // 80 AS player_name,
    ['QB', 'RB1', 'WR2', 'DEF_STAR', 'K'][c_nationkey % 5 + 1] AS position,
    ['OUT', 'DOUBTFUL', 'QUESTIONABLE', 'PROBABLE'][c_custkey % 4 + 1] AS status FROM customer
    QUALIFY row_number() OVER (PARTITION BY c_custkey % 40, c_custkey // 80 ORDER BY c_custkey DESC) = 1)""",
)
SQL_BINDINGS["injury_effects"] = (
    ("injury_rows",),
    """SELECT team, sum(CASE position WHEN 'QB' THEN 4.5 WHEN 'RB1' THEN 0.7 WHEN 'WR2' THEN 0.4 ELSE 0 END * missing) AS lost,
    sum(CASE position WHEN 'DEF_STAR' THEN 0.8 ELSE 0 END * missing) AS added, count(*) AS n FROM injury_rows GROUP BY 1""",
)


def _scenario_games(t):
    return t.predictions.withColumns(
        {
            "home_score": (F.col("total") + F.col("predicted_home_margin")) / 2.0,
            "away_score": (F.col("total") - F.col("predicted_home_margin")) / 2.0,
        }
    )


@query(
    "h21_injury_scenario",
    "game_id:i adjusted_home_score:d adjusted_away_score:d injury_adjusted:i",
    """SELECT game_id, round_even(greatest((total + predicted_home_margin) / 2 - COALESCE(h.lost, 0) + COALESCE(a.added, 0), 0), 1) AS adjusted_home_score,
    round_even(greatest((total - predicted_home_margin) / 2 - COALESCE(a.lost, 0) + COALESCE(h.added, 0), 0), 1) AS adjusted_away_score,
    CASE WHEN COALESCE(h.n, 0) + COALESCE(a.n, 0) > 0 THEN 1 ELSE 0 END AS injury_adjusted FROM predictions
    LEFT JOIN injury_effects h ON h.team = home_team LEFT JOIN injury_effects a ON a.team = away_team""",
    "predictions injury_effects",
)
def _(t):
    return scenario.adjust_games(_scenario_games(t), _injury_scenario(t))


def _player_forecasts(t):
    return t.read("customer").select(
        F.col("c_custkey").alias("player_id"),
        F.concat(F.lit("L0T"), F.col("c_custkey") % 40).alias("team"),
        F.upper(F.concat(F.lit("Player "), F.floor(F.col("c_custkey") / 40))).alias("player_name"),
        (F.col("c_acctbal") / 37.0).alias("mean"),
        (10.0 + F.col("c_nationkey")).alias("std"),
    )


@query(
    "h22_player_availability",
    "player_id:i adjusted:d availability_note:s",
    """SELECT c_custkey AS player_id, CASE WHEN i.status IS NULL THEN c_acctbal / 37.0 ELSE round_even(greatest(c_acctbal / 37.0 * (1 - missing), 0), 1) END AS adjusted,
    CASE WHEN i.status IS NULL THEN 'no entry' ELSE i.status || ' assumed: plays at ' || CAST(CAST(round((1 - missing) * 100) AS INTEGER) AS VARCHAR) || '%' END AS availability_note
    FROM customer LEFT JOIN injury_rows i ON i.team = 'L0T' || c_custkey % 40 AND lower(i.player_name) = lower('Player ' || c_custkey // 40)""",
    "injury_rows",
)
def _(t):
    return scenario.adjust_players(_player_forecasts(t), _injury_scenario(t))


@query(
    "g17_prop_probability",
    "player_id:i prop_line:d p10:d over:d under:d",
    f"""SELECT player_id, l AS prop_line, greatest(m - 1.2816 * s, 0) AS p10, {sql_cdf('((m - l) / s)')} AS over, 1 - {sql_cdf('((m - l) / s)')} AS under FROM
    (SELECT c_custkey AS player_id, c_acctbal / 37.0 AS m, 10.0 + c_nationkey AS s, round_even(c_acctbal / 37.0 * 2, 0) / 2 AS l FROM customer)""",
)
def _(t):
    return scenario.prop_probabilities(_player_forecasts(t))


SQL_BINDINGS["snapshot"] = (
    ("states",),
    f"""SELECT team, {_features_sql(lambda m: str(teamform.DEFAULT_PRIORS[m]))} FROM states
    QUALIFY row_number() OVER (PARTITION BY team ORDER BY seq DESC) = 1""",
)


@query(
    "e18_custom_matchups",
    "home_team:s away_team:s home_points_for_l4:d away_off_epa_l4:d rest_advantage:d home_field:d week:i",
    """SELECT h.team AS home_team, a.team AS away_team, h.points_for_l4 AS home_points_for_l4, a.off_epa_l4 AS away_off_epa_l4, 3 AS rest_advantage,
    0 AS home_field, 2 AS "week" FROM (SELECT DISTINCT home_team, away_team FROM games) g
    JOIN snapshot h ON h.team = g.home_team JOIN snapshot a ON a.team = g.away_team""",
    "games snapshot",
)
def _(t):
    pairs = t.games.select("home_team", "away_team").distinct()
    asked = pairs.selectExpr(
        "*", "10 AS home_rest_days", "7 AS away_rest_days", "true AS neutral_site", "2 AS week", "0D AS division_game"
    )
    snapshot = teamform.team_snapshot(teamform.team_states(t.games, t.plays, plays_by="side"))
    return scenario.matchup_features(asked, snapshot, teamform.CORE_GAME_FEATURES)


_SIDES = ", ".join(f"{f[0]}.{f[5:]}" for f in teamform.CORE_GAME_FEATURES if f[:5] in ("home_", "away_") and f[5:] in teamform.STATE_FEATURES)
_ASKED = "SELECT * FROM (VALUES (7, 7, false, 1, 0), (10, 7, false, 2, 0), (7, 14, true, 5, 1)) v(home_rest_days, away_rest_days, neutral_site, \"week\", division_game)"


@query(
    "e18_scored_pairings",
    "home_team:s away_team:s week:i neutral_site:i home_score:d away_score:d predicted_home_margin:d total:d total_p10:d total_p90:d home_win_probability:d",
    f"""SELECT home_team, away_team, "week", CAST(neutral_site AS INTEGER) AS neutral_site, round_even(greatest((t + m) / 2, 0), 1) AS home_score,
    round_even(greatest((t - m) / 2, 0), 1) AS away_score, round_even(m, 2) AS predicted_home_margin, round_even(t, 1) AS total,
    round_even(greatest(t - 1.2816 * ts, 0), 1) AS total_p10, round_even(greatest(t + 1.2816 * ts, 0), 1) AS total_p90, {sql_cdf('(m / ms)')} AS home_win_probability FROM
    (SELECT x.*, mf.c + list_inner_product(mf.w, v) AS m, tf.c + list_inner_product(tf.w, v) AS t,
      (SELECT stddev_samp(actual - predicted) FROM tune_margin_50) AS ms, (SELECT stddev_samp(actual - predicted) FROM tune_total_50) AS ts
      FROM (SELECT h.team AS home_team, a.team AS away_team, s.*, list_transform([{_SIDES}, home_rest_days, away_rest_days, home_rest_days - away_rest_days, division_game, "week",
        CASE WHEN neutral_site THEN 0 ELSE 1 END], lambda q: CAST(q AS DOUBLE)) AS v FROM snapshot h JOIN snapshot a ON h.team <> a.team, ({_ASKED}) s) x, game_margin_last mf, game_total_last tf)""",
    "snapshot game_margin_last game_total_last tune_margin_50 tune_total_50",
)
def _(t):
    """Every pairing of two clubs in three scenarios, scored by the game models."""
    rows = teamform.team_rows(t.games, t.plays, plays_by="side")  # read for the states and for the features
    snapshot = teamform.team_snapshot(teamform.rolling_team_state(rows, teamform.league_priors(rows)))
    models = jobs.game_models(teamform.game_features(t.games, t.plays, plays_by="side", rows=rows, features=teamform.CORE_GAME_FEATURES)).withColumn("model", F.replace("model", F.lit("game_"), F.lit("")))
    snapshot, models = cut_lineage(snapshot), cut_lineage(models)
    clubs = snapshot.select("team")
    pairs = clubs.select(F.col("team").alias("home_team")).join(clubs.select(F.col("team").alias("away_team")), F.col("home_team") != F.col("away_team"))
    return scenario.score_pairings(pairs, t.spark.sql(_ASKED.replace('"week"', "week")), snapshot, models, teamform.CORE_GAME_FEATURES)


def _lead(gap: str, limit: float, text_: str) -> str:
    return f"CASE WHEN abs({gap}) > {limit} THEN replace('{text_}', '%s', CASE WHEN {gap} > 0 THEN home_team ELSE away_team END) END"


@query(
    "h20_explanations",
    "game_id:i reasons:s",
    f"""SELECT game_id, array_to_string(CASE WHEN len(r) = 0 THEN ['No measure separates the two sides by much.'] ELSE r[1:3] END, ' / ') AS reasons FROM
    (SELECT game_id, list_filter([{_lead('((home_off_epa_l4 - home_def_epa_l4) - (away_off_epa_l4 - away_def_epa_l4))', 0.03, 'Recent play efficiency favours %s.')},
    {_lead('((home_points_for_l4 - home_points_against_l4) - (away_points_for_l4 - away_points_against_l4))', 2.0, 'Recent point difference favours %s.')},
    {_lead('((home_pressure_generated_l4 - home_pressure_allowed_l4) - (away_pressure_generated_l4 - away_pressure_allowed_l4))', 0.02, "Pressure on passers, made less allowed, favours %s.")},
    CASE WHEN division_game = 1 THEN 'Both sides share a division, so home advantage counts for less.' END,
    CASE WHEN home_field = 0 THEN 'No home advantage: the site is neutral.' END], lambda x: x IS NOT NULL) AS r FROM features WHERE home_score IS NOT NULL)""",
    "features",
)
def _(t):
    reasons = scenario.explanations(game_features_completed(t))
    return reasons.withColumn("reasons", F.array_join("reasons", " / "))


@query(
    "h23_freshness_notices",
    "newest_roster_season:i scheduled_fbs_teams:i returning_teams:i roster_stale:i coverage_gap:i",
    """WITH tm AS (SELECT home_team AS team FROM games WHERE season = 2000 AND fbs_vs_fbs UNION SELECT away_team FROM games WHERE season = 2000 AND fbs_vs_fbs),
    c AS (SELECT (SELECT count(*) FROM tm) AS s, (SELECT count(DISTINCT team) FROM creturning WHERE season = 2000 AND team IN (SELECT team FROM tm)) AS r,
      (SELECT count(DISTINCT team) FROM ctalent WHERE season = 2000 AND team IN (SELECT team FROM tm)) AS t)
    SELECT (SELECT max(season) FROM rosters) AS newest_roster_season, s AS scheduled_fbs_teams, r AS returning_teams, 1 AS roster_stale,
    CASE WHEN s > 0 AND (r < s OR t < s) THEN 1 ELSE 0 END AS coverage_gap FROM c""",
    "games creturning ctalent rosters",
)
def _(t):
    from ..operators import college

    by_team = {"returning": cc.returning(t), "talent": cc.talent(t)}
    coverage = college.input_coverage(cc.college_games(t), by_team, cc.portal(t), 2000)
    return scenario.freshness_notices(t.rosters, coverage, 2025)


_RUSHING = [n for n in players.PLAYER_FEATURES["rushing"] if n != "opponent_def_epa"]


@query(
    "e15_player_snapshots",
    "player_id:s team:s opponent:s opponent_def_epa:d roster_season:i " + " ".join(f"{n}:d" for n in _RUSHING),
    f"""SELECT player_id, posteam AS team, opponent, COALESCE(def_epa_l4, 0) AS opponent_def_epa, 2001 AS roster_season, {', '.join(f'COALESCE({n}, 0) AS {n}' for n in _RUSHING)}
    FROM rushing_next JOIN (SELECT side, other AS opponent FROM
      (SELECT home_team AS side, away_team AS other, gameday, game_id FROM games WHERE season = 2001 AND home_score IS NULL
       UNION ALL SELECT away_team, home_team, gameday, game_id FROM games WHERE season = 2001 AND home_score IS NULL)
      QUALIFY row_number() OVER (PARTITION BY side ORDER BY gameday DESC, game_id DESC) = 1) ON side = posteam
    LEFT JOIN snapshot ON snapshot.team = opponent""",
    "rushing_next games snapshot",
)
def _(t):
    """Runners on a current roster with their next opponent."""
    log = club_log(t, "rushing").withColumn("player_name", F.col("player_id"))
    forecasts = players.forecast_rows(log, "rushing")
    current = log.groupBy("player_id").agg(F.max_by("posteam", F.struct("game_date", "game_id")).alias("team"))
    snapshot = teamform.team_snapshot(teamform.team_states(t.games, t.plays, plays_by="side"))
    upcoming = t.games.where("season = 2001 AND home_score IS NULL")
    listed = current.withColumn("roster_season", F.lit(2001))
    return players.player_snapshots(forecasts, listed, players.next_opponents(upcoming, snapshot), "rushing")


# --- player models, tree candidates, whole jobs ----------------------------------------------------

SQL_BINDINGS["rush_model"] = (
    ("rushing_rolled", "opponent"),
    "SELECT r.*, o.opponent_def_epa FROM rushing_rolled r JOIN opponent o ON o.game_id = r.game_id AND o.player_id = r.player_id",
)
ridge_bindings("rush_oof", "rush_model", players.PLAYER_FEATURES["rushing"], "rushing_yards", 10.0, 350, "game_id, player_id")


@query(
    "g10_rushing_target",
    "game_id:i player_id:s train_rows:i actual:d predicted:d",
    "SELECT * FROM rush_oof",
    "rush_oof",
)
def _(t):
    frame = jobs.player_frame(club_log(t, "rushing"), game_features_all(t), "rushing")
    spec = {"rushing_yards": (players.PLAYER_FEATURES["rushing"], "rushing_yards", ensemble.PLAYER_RIDGE)}
    return ridge.walk_forward_predictions(frame, spec, min_rows=350, keep=["game_id", "player_id"])


@query(
    "g08_g10_player_ensembles",
    "target:s rows:i mae:d rmse:d bias:d baseline_mae:d interval_80_coverage:d",
)
def _(t):
    """Four player targets, each with its own features and its rolling mean as a third member."""
    logs = {kind: club_log(t, kind) for kind in ("passing", "receiving", "rushing")}
    return jobs.player_reports(logs, game_features_all(t, ["home_def_epa_l4", "away_def_epa_l4"]))


def roster_games(t):
    """Completed games of clubs with roster history, with the change of their rosters."""
    transitions = roster.transition_table(t.rosters, t.snaps)
    side = {s: ((F.col("game_id") + d) % 8).cast("string") for s, d in (("home", 0), ("away", 3))}
    games = game_features_completed(t, teamform.CORE_GAME_FEATURES).withColumns({"real_season": F.col("season"), "season": F.lit(2024)})
    keyed = games.withColumns({f"{s}_team": c for s, c in side.items()})
    return roster.attach_transitions(keyed, transitions).withColumn("season", F.col("real_season"))


@query("g03_boosted_trees", "game_id:i season:i week:i model:s actual:d tree_prediction:d")
def _(t):
    """Each season but the first, predicted by trees grown on all seasons before it; both targets."""
    models = {"margin": (teamform.CORE_GAME_FEATURES, "home_margin"), "total": (teamform.CORE_GAME_FEATURES, "total_points")}
    return boosting.boosted_oof(game_features_completed(t, teamform.CORE_GAME_FEATURES), models, {"current": ensemble.TREE_PROFILES["current"]}, keep=["game_id"])


_NAMES = ", ".join(f"'{f}'" for f in teamform.CORE_GAME_FEATURES)
_VALUES = ", ".join(f"CAST({f} AS DOUBLE)" for f in teamform.CORE_GAME_FEATURES)


@query(
    "g03_first_split_sums",
    "season:i feature:s bin:i rows:i pull:d",
    f"""SELECT season, feature, bin, count(*) AS "rows", sum(y - m) AS pull FROM (
      SELECT s.season, c.feature, len(list_filter(e.edges, lambda q: q < c.x)) AS bin, c.y, s.m
      FROM cells c JOIN edges e USING (feature)
      JOIN (SELECT s.season, avg(f.home_margin) AS m FROM (SELECT DISTINCT season FROM features) s JOIN features f ON f.season < s.season WHERE home_margin IS NOT NULL GROUP BY 1 HAVING count(*) >= 350) s ON c.season < s.season
    ) GROUP BY 1, 2, 3""",
    "cells edges",
)
def _(t):
    """Sums from which the first split of each season's trees is picked."""
    return boosting.first_sums(game_features_completed(t), teamform.CORE_GAME_FEATURES, "home_margin", keep=["game_id"])


SQL_BINDINGS["cells"] = (("features",), f"SELECT season, CAST(home_margin AS DOUBLE) AS y, unnest([{_NAMES}]) AS feature, unnest([{_VALUES}]) AS x FROM features WHERE home_margin IS NOT NULL")
SQL_BINDINGS["edges"] = (
    ("cells",),
    f"SELECT feature, quantile_disc(x, [{', '.join(f'{k / boosting.BINS}' for k in range(1, boosting.BINS))}]) AS edges FROM cells WHERE season = (SELECT min(season) FROM cells) GROUP BY 1",
)


@query("g06_ridge_tree_ensemble", "game_id:i season:i week:i model:s actual:d ridge:d tree:d first_weight:d second_weight:d ensemble:d")
def _(t):
    """Margin and total, each with its own features, from ridge and trees."""
    return jobs.game_ensembles(roster_games(t))


@query(
    "g16_prequential_components",
    "game_id:i season:i week:i margin_actual:d margin_predicted:d margin_ridge_weight:d total_actual:d total_predicted:d total_ridge_weight:d",
)
def _(t):
    return jobs.independent_forecasts(roster_games(t))


@query("h14_profile_tuning", "profile:s target:s split:s rows:i mae:d ridge_mae:d tree_mae:d mean_ridge_weight:d")
def _(t):
    """Eight candidates on two targets, against the last season as holdout."""
    return jobs.tuning_report(game_features_completed(t, teamform.CORE_GAME_FEATURES), holdout_season=2000)


@query(
    "g13_college_weekly_forecast",
    "game_id:i week:i home_team:s away_team:s predicted_home_margin:d predicted_total:d home_win_probability:d margin_p10:d margin_p90:d",
)
def _(t):
    return jobs.college_weekly(
        cc.college_games(t), cc.advanced(t), cc.preseason(t), cc.lines(t), as_of="2000-06-30", season=2000, min_rows=1200
    )


SQL_BINDINGS["roster_features"] = (
    ("features", "transitions"),
    "SELECT g.*, "
    + ", ".join(
        f"COALESCE({s[0]}.{f} * least(greatest(1.25 - 0.25 * greatest(\"week\", 1), 0), 1), 0) AS {s}_{f}"
        for s in ("home", "away")
        for f in roster.DELTA_FEATURES
    )
    + """ FROM (SELECT *, CAST(game_id % 8 AS VARCHAR) AS ht, CAST((game_id + 3) % 8 AS VARCHAR) AS at_ FROM features WHERE home_margin IS NOT NULL) g
    LEFT JOIN transitions h ON h.season = 2024 AND h.team = g.ht
    LEFT JOIN transitions a ON a.season = 2024 AND a.team = g.at_""",
)
_ROSTER_SETS = ensemble.group_combinations(teamform.CORE_GAME_FEATURES, roster.ROSTER_GROUPS)
for _k, _features in enumerate(_ROSTER_SETS.values()):
    ridge_bindings(f"roster_{_k}", "roster_features", _features, "home_margin", ensemble.GAME_RIDGE, 350, "game_id")


@query(
    "h13_roster_group_ablation",
    "model:s split:s rows:i mae:d mae_change:d",
    """SELECT model, split, n AS "rows", mae, mae - max(CASE WHEN model = 'core' THEN mae END) OVER (PARTITION BY split) AS mae_change FROM
    (SELECT model, split, count(*) AS n, avg(e) AS mae FROM (SELECT *, unnest(['all_oof', CASE WHEN "week" <= 4 THEN 'weeks_1_4' END,
      CASE WHEN "week" <= 4 AND season < 2000 THEN 'development_weeks_1_4' END, CASE WHEN "week" <= 4 AND season = 2000 THEN 'holdout_weeks_1_4' END]) AS split FROM ("""
    + " UNION ALL ".join(f"SELECT '{n}' AS model, season, \"week\", abs(predicted - actual) AS e FROM roster_{k}" for k, n in enumerate(_ROSTER_SETS))
    + ")) WHERE split IS NOT NULL GROUP BY 1, 2)",
    " ".join(f"roster_{k}" for k in range(len(_ROSTER_SETS))),
)
def _(t):
    """Every combination of roster feature groups on games of clubs with roster history."""
    return jobs.roster_ablation(roster_games(t), _ROSTER_SETS, holdout_season=2000)


# --- labels and scalars --------------------------------------------------------------------------

@query(
    "s01_name_key",
    "doc_id:i key_md5:s key_length:i",
    """SELECT doc_id, md5(k) AS key_md5, length(k) AS key_length FROM (SELECT doc_id, CASE WHEN n = '' THEN '' ELSE 'name:' || n END AS k FROM
    (SELECT doc_id, regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g') AS n FROM documents))""",
)
def _(t):
    key = text.name_key(F.col("text"))
    return t.read("documents").select("doc_id", F.md5(key).alias("key_md5"), F.length(key).alias("key_length"))


@query(
    "s02_transition_weight",
    "game_id:i weight:d",
    'SELECT game_id, least(greatest(1.25 - 0.25 * greatest("week", 1), 0), 1) AS weight FROM games',
    "games",
)
def _(t):
    return t.games.withColumn("weight", timeparse.transition_weight(F.col("week")))


@query(
    "s04_timestamp_parse",
    "event_id:i with_offset:i naive:i",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) WHEN event_id % 3 = 1 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 7200 END AS with_offset,
    CAST(epoch(CAST(ts AS DATE)) AS BIGINT) AS naive FROM events""",
)
def _(t):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.expr("CASE event_id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' ELSE '' END")
    day = F.date_format("ts", "yyyy-MM-dd")
    return t.read("events").select(
        "event_id",
        F.unix_timestamp(timeparse.parse_instant(F.concat(stamp, zone))).alias("with_offset"),
        F.unix_timestamp(timeparse.parse_as_of(day)).alias("naive"),
    )


@query(
    "s06_moneyline",
    "game_id:i moneyline:i label:s percent:s",
    """SELECT game_id, ml AS moneyline, CASE WHEN ml > 0 THEN '+' || ml ELSE CAST(ml AS VARCHAR) END AS label, printf('%.2f', p * 100) || '%' AS percent FROM
    (SELECT game_id, p, CAST(round_even(CASE WHEN q >= 0.5 THEN -100 * q / (1 - q) ELSE 100 * (1 - q) / q END / 5, 0) * 5 AS BIGINT) AS ml FROM
    (SELECT game_id, home_win_probability AS p, least(greatest(home_win_probability, 0.001), 0.999) AS q FROM predictions))""",
    "predictions",
)
def _(t):
    line = odds.moneyline(F.col("home_win_probability"))
    return t.predictions.select(
        "game_id",
        line.alias("moneyline"),
        text.american_label(line).alias("label"),
        text.percent_label(F.col("home_win_probability"), 2).alias("percent"),
    )


@query(
    "s07_s08_labels",
    "game_id:i spread:s market:s kickoff:s separator:s",
    """SELECT game_id, CASE WHEN abs(m) < 0.05 THEN 'Pick' ELSE CASE WHEN m > 0 THEN home_team ELSE away_team END || printf(' -%.1f', abs(m)) END AS spread,
    CASE WHEN s IS NULL THEN 'no feed yet' ELSE home_team || printf(' %+.1f', s) || ' · O/U ' || printf('%.1f', o) END AS market,
    strftime(gameday, '%a %-m/%-d ') || CASE WHEN gametime = 'TBD' THEN 'TBD' ELSE
      printf('%d:%s%s', CASE WHEN CAST(left(gametime, 2) AS INTEGER) > 12 THEN CAST(left(gametime, 2) AS INTEGER) - 12 ELSE CAST(left(gametime, 2) AS INTEGER) END,
        right(gametime, 2), CASE WHEN CAST(left(gametime, 2) AS INTEGER) < 12 THEN 'a' ELSE 'p' END) END || CASE WHEN neutral_site THEN ' · neutral site' ELSE '' END AS kickoff,
    CASE WHEN neutral_site THEN 'vs' ELSE '@' END AS separator FROM
    (SELECT p.*, CAST(((custkey * 13) % 290) AS DOUBLE) * 2 - 280.0 AS m, round_even(market_home_spread * 2, 0) / 2 + 0.0 AS s, CAST(round_even(market_total, 0) AS DOUBLE) AS o FROM predictions p LEFT JOIN quote_medians USING (game_id))""",
    "predictions quote_medians",
)
def _(t):
    medians = t.quotes.groupBy("game_id").agg(
        (F.bround(F.median("home_spread") * 2, 0) / 2).alias("s"), F.bround(F.median("total"), 0).alias("o")
    )
    rows = t.predictions.join(medians, "game_id", "left")
    margin = (F.col("custkey") * 13 % 290) * 2.0 - 280.0
    return rows.select(
        "game_id",
        text.spread_label(margin, F.col("home_team"), F.col("away_team")).alias("spread"),
        text.line_label(F.col("home_team"), F.col("s"), F.col("o"), F.col("s").isNotNull()).alias("market"),
        text.kickoff_label(F.col("gameday"), F.col("gametime"), F.col("neutral_site"), F.lit(None).cast("string")).alias("kickoff"),
        text.matchup_separator(F.col("neutral_site")).alias("separator"),
    )


@query(
    "s09_club_aliases",
    "code:s rows:i",
    """SELECT CASE c WHEN 'LAR' THEN 'LA' WHEN 'WSH' THEN 'WAS' ELSE c END AS code, count(*) AS "rows" FROM
    (SELECT ['LAR', 'WSH', 'LA', 'KC', 'SF'][c_nationkey % 5 + 1] AS c FROM customer) GROUP BY 1""",
)
def _(t):
    codes = F.array(*[F.lit(f" {c} ") for c in ["LAR", "WSH", "LA", "KC", "SF"]])
    rows = t.read("customer").select(
        text.canonical_club(F.element_at(codes, F.col("c_nationkey") % 5 + 1)).alias("code")
    )
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("rows"))


# --- streams -------------------------------------------------------------------------------------

_WINDOWED = """SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id % 20 AS game_id,
    round_even(median(floor("value")), 3) AS line, round_even(quantile_cont(floor("value"), 0.75) - quantile_cont(floor("value"), 0.25), 3) AS line_iqr,
    count("value") AS book_count, floor(min("value")) AS line_min, floor(max("value")) AS line_max FROM events {where} GROUP BY 1, 2"""
_WINDOW_SPEC = "window_start:s game_id:i line:d line_iqr:d book_count:i line_min:d line_max:d"


def _quote_events(df):
    return df.select(
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("user_id") % 20).alias("game_id"),
        F.floor("value").cast("double").alias("line"),
        "event_id",
    )


@query("t01_windowed_consensus_table", _WINDOW_SPEC, _WINDOWED.format(where=""))
def _(t):
    return stream.windowed_consensus(_quote_events(t.read("events")), window="1 day", unique="event_id")


@query(
    "t01_windowed_consensus_stream",
    _WINDOW_SPEC,
    _WINDOWED.format(
        where="WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE"
    ),
)
def _(t):
    """The same consensus over the table replayed as a stream: windows the watermark has closed."""
    source = t.read("events").schema
    folder = _shared(t)
    quotes = t.spark.readStream.schema(source).parquet(f"{t.folder}/events*.parquet")
    closed = stream.windowed_consensus(_quote_events(quotes), window="1 day", unique="event_id")
    running = (
        closed.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return t.spark.read.schema(closed.schema).parquet(f"{folder}/out")


def _quote_kickoffs(t):
    known = t.read("events").select((F.col("user_id") % 20).alias("game_id")).distinct().where("game_id <> 19")  # a game that isn't scheduled
    return known.withColumn("kickoff_at", F.expr("TIMESTAMP '2024-01-05' + make_interval(0, 0, 0, CAST(game_id AS INT))"))


@query(
    "t02_quotes_stream",
    "event_id:i game_id:i line:d verdict:s",
    """SELECT event_id, g AS game_id, floor("value") AS line, CASE WHEN g = 19 THEN 'unknown game' WHEN ts >= k THEN 'late' WHEN ts < k - INTERVAL 8 DAY THEN 'stale' ELSE 'valid' END AS verdict
    FROM (SELECT *, user_id % 20 AS g, TIMESTAMP '2024-01-05' + to_days(CAST(user_id % 20 AS INTEGER)) AS k FROM events)""",
)
def _(t):
    """Quotes delivered twice, some late, stale or for no game: each is judged once, valid and rejected ones in sinks of their own."""
    source, root = t.read("events").schema, _shared(t)
    delivered = [_quote_events(t.spark.readStream.schema(source).parquet(f"{t.folder}/events*.parquet")) for _ in range(2)]
    again = delivered[0].unionByName(delivered[1])
    running = stream.judged_stream(again, _quote_kickoffs(t), root, f"{root}/state", unique="event_id")
    running.awaitTermination()
    return stream.judged_quotes(t.spark, root)


@query(
    "t02_valid_quotes",
    "event_id:i game_id:i",
    """SELECT event_id, user_id % 20 AS game_id FROM events WHERE ts < TIMESTAMP '2024-01-05' + to_days(CAST(user_id % 20 AS INTEGER))
    AND ts >= TIMESTAMP '2024-01-05' + to_days(CAST(user_id % 20 AS INTEGER)) - INTERVAL 8 DAY""",
)
def _(t):
    kickoffs = t.read("events").select((F.col("user_id") % 20).alias("game_id")).distinct().withColumn(
        "kickoff_at", F.expr("TIMESTAMP '2024-01-05' + make_interval(0, 0, 0, CAST(game_id AS INT))")
    )
    return stream.valid_quotes(_quote_events(t.read("events")), kickoffs)
