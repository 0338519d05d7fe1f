"""Features of teams in one pass against the windows that define them."""

from pyspark.sql import functions as F

from priorwise.operators import teamform
from priorwise.operators.plays import SUMMARY_MEASURES


def rows(spark, n=600):
    """Team games with gaps: unplayed games, games without plays, missing passers and measures, two games a day."""
    k = F.col("id")
    value = {m: F.when((k % 11 != 0) & (k % (13 + j) != 0), F.sin(k * (j + 1.3)) * 10) for j, m in enumerate(SUMMARY_MEASURES)}
    made = spark.range(n).select(
        k.alias("game_id"), F.when(k.isin(10, 300), "few").when(k == 3, "none").otherwise(F.concat(F.lit("T"), k % 4)).alias("team"), F.lit("home").alias("side"),
        F.date_add(F.lit("2001-01-01").cast("date"), F.floor(k / 6).cast("int")).alias("gameday"), (k % 7 != 3).alias("completed"),
        *[v.alias(m) for m, v in value.items()],
        F.when(k % 11 != 0, F.element_at(F.array(F.lit("P"), F.lit("Q"), F.lit(" "), F.lit(None)), (F.floor(k / 9) % 4 + 1).cast("int"))).alias("primary_qb"),
    )
    done, k = F.col("completed"), F.col("game_id")
    made = made.withColumns({"points_for": F.when(done, k % 31).cast("double"), "points_against": F.when(done & (k % 29 != 0), k % 17).cast("double")})
    made = made.withColumn("margin", F.col("points_for") - F.col("points_against")).withColumn("win", (F.signum("margin") + 1.0) / 2.0)
    return made.withColumn("observed", F.expr("yards IS NOT NULL OR primary_qb IS NOT NULL"))


def test_one_pass_gives_what_the_windows_give(spark):
    made = rows(spark).cache()
    priors = teamform.league_priors(made)
    names = ["rest_days", *teamform.STATE_FEATURES]
    want = teamform.team_features_as_of(teamform.rolling_team_state(made, priors))
    both = [{(r.game_id, r.team, r.side): [r[n] for n in names] for r in df.collect()} for df in (want, teamform.features_as_of(made, priors))]
    assert both[0].keys() == both[1].keys() and len(both[0]) == 600
    for key, expected in both[0].items():
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(expected, both[1][key], strict=True)), key


def test_features_of_games_need_no_windows_over_teams(spark):
    made = rows(spark)
    plan = teamform.features_as_of(made, teamform.league_priors(made))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "partitionBy" not in plan and "[team" not in plan.split("Window")[-1].split("\n")[0]


def test_team_games_are_made_once(spark, monkeypatch):
    monkeypatch.setattr(teamform, "game_team_summary", lambda plays: plays)
    monkeypatch.setattr(teamform, "team_games", lambda *_, **__: rows(spark, 60))
    games = spark.createDataFrame([(k, 2001, 1, 20, k, False) for k in range(60)], "game_id long, season int, week int, home_score int, away_score int, neutral_site boolean")
    out = teamform.game_features(games, None)
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()  # neither priors nor teams make them again
    assert out.count() == 60


def test_priors_are_not_dealt_with_the_rows(spark):
    made = rows(spark).where("team = 'T1'")
    names = ["game_id", "team", "side", "gameday", "completed", *teamform.ROLLING, "margin"]
    sent = made.select(*names, F.datediff("gameday", F.lit("1970-01-01")).alias("day"), F.lit("P").alias("passer")).toArrow()
    out = teamform._as_of_days(sent)
    assert {"t_win_pct_l8", "n_win_pct_l8"} < set(out.column_names) and out.num_rows == made.count()


def test_rows_at_hand_are_not_made_again(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("plays are summed again")

    monkeypatch.setattr(teamform, "game_team_summary", never)
    games = spark.createDataFrame([(k, 2001, 1, 20, k, False) for k in range(60)], "game_id long, season int, week int, home_score int, away_score int, neutral_site boolean")
    assert teamform.game_features(games, None, rows=rows(spark, 60)).count() == 60


def test_game_models_make_only_their_columns(spark):
    from priorwise.plans import jobs

    k = F.col("game_id")
    games = spark.range(800).withColumnRenamed("id", "game_id").select(
        "game_id", F.lit(2001).alias("season"), *[F.sin(k * (j + 1.7)).alias(f) for j, f in enumerate(teamform.CORE_GAME_FEATURES) if f != "week"],
        F.floor(k / 50).cast("int").alias("week"), F.cos(k * 3.1).alias("home_margin"), F.cos(k * 5.3).alias("total_points"), F.raise_error(F.lit("made")).cast("double").alias("else"),
    )
    assert {r.model for r in jobs.game_models(games).collect()} == {"game_margin", "game_total"}


def test_features_are_made_once_for_two_publications(spark, monkeypatch):
    from priorwise.plans import catalog_ops
    from priorwise.plans.registry import REGISTRY

    plans, publish = [], catalog_ops.jobs.publish_features
    columns = [F.lit(1.0).alias(f) for f in teamform.CORE_GAME_FEATURES if f != "week"]
    games = spark.range(40).select(F.col("id").alias("game_id"), (F.col("id") % 5).cast("int").alias("week"), *columns, F.lit(1.0).alias("home_margin"), F.lit(2.0).alias("total_points"))

    def seen(table, *args, **kwargs):
        plans.append(table._jdf.queryExecution().optimizedPlan().toString())
        return publish(table, *args, **kwargs)

    monkeypatch.setattr(catalog_ops, "game_features_all", lambda _: games)
    monkeypatch.setattr(catalog_ops.jobs, "publish_features", seen)
    counts = {r.what: r["count"] for r in REGISTRY["g15_h16_published_under_contract"].run(spark, "/nowhere").collect()}
    assert counts == {"rows": 40, "missing_result": 0, "missing_feature": 0, "drifted": 0, "read": 40}
    assert len(plans) == 2 and not any("Range (" in p for p in plans)
