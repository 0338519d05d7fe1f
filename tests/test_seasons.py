"""Season blocks cover every season, and ratings stay in theirs."""

from priorwise.operators import boosting, ratings


def test_trees_forecast_every_season_after_the_first(spark):
    small = {"small": boosting.Profile(2, 1, 0.5, 1)}
    rows = [(k, season, 1, float(k), float(season + k)) for season in (1997, 1998, 2000) for k in range(6)] + [(9, 1996, 1, None, 1.0)]
    df = spark.createDataFrame(rows, "game_id int, season int, week int, x double, y double")
    got = boosting.boosted_oof(df, {"m": (["x"], "y")}, small, keep=["game_id"], min_rows=1)
    assert sorted((r.season, r.game_id) for r in got.collect()) == [(s, k) for s in (1998, 2000) for k in range(6)]
    assert boosting.boosted_oof(df.where("season = 1997"), {"m": (["x"], "y")}, small, keep=["game_id"], min_rows=1).count() == 0


def test_calibration_joins_ratings_by_season(spark):
    games = spark.createDataFrame(
        [(1, 1999, 1, "A", "B", 1.0, 44.0, 10.0, 0.5, 1.0), (2, 2000, 1, "A", "B", 1.0, 44.0, 10.0, 0.5, 1.0)],
        "game_id int, season int, week int, home_team string, away_team string, predicted_home_margin double, total double, margin_std double, home_win_probability double, home_field double",
    )
    rated = spark.createDataFrame([(1999, "A", 0.5, 2.0), (1999, "B", -0.5, 2.0), (2000, "A", -1.0, 1.0), (2000, "B", 1.0, 1.0)], "season int, team string, rating double, home_field_points double")
    got = ratings.calibrate_preseason(games, rated, "s1").collect()
    assert sorted((r.game_id, r.prior_home_margin) for r in got) == [(1, 3.0), (2, -1.0)]
