import numpy as np
import pytest
from pyspark.sql import functions as F

from priorwise.operators import college, evaluate, ratings, ridge, roster
from priorwise.plans import jobs

PAIRS = [(h, a) for h in "ABCD" for a in "ABCD" if h != a]


def games_frame(spark, strengths, field, bias=0.0):
    rows = []
    for n, (h, a) in enumerate(PAIRS):
        neutral = n % 4 == 0
        flag = 0.0 if neutral else 1.0
        rows.append((1, n, h, a, strengths[h] - strengths[a] + bias + field * flag, 5, flag))
    return spark.createDataFrame(rows, "g int, game_id int, home_team string, away_team string, margin double, book_count int, home_field double")


def test_market_ratings_recover_strengths(spark):
    strengths = {"A": 4.0, "B": 1.0, "C": -1.0, "D": -4.0}
    games = games_frame(spark, strengths, 2.0)
    fitted = ratings.market_ratings(games.withColumnRenamed("margin", "market_home_margin"), ["g"]).collect()
    assert {r.team: round(r.rating, 9) for r in fitted} == strengths
    assert fitted[0].home_field_points == pytest.approx(2.0)
    assert {r.team: r.rank for r in fitted} == {"A": 1, "B": 2, "C": 3, "D": 4}


def test_single_book_lines_and_loose_schedules_have_no_ratings(spark):
    games = games_frame(spark, dict.fromkeys("ABCD", 0.0), 2.0).withColumnRenamed("margin", "market_home_margin")
    assert ratings.market_ratings(games.withColumn("book_count", F.lit(1)), ["g"]).count() == 0
    apart = games.where("(home_team IN ('A', 'B')) = (away_team IN ('A', 'B'))")
    doubled = apart.unionByName(apart)
    assert ratings.market_ratings(doubled, ["g"]).count() == 0


def test_schedule_ratings_recover_bias_and_home_field(spark):
    games = games_frame(spark, {"A": 3.0, "B": 1.0, "C": -1.0, "D": -3.0}, 2.5, bias=0.2)
    fitted = ratings.schedule_ratings(games, ["g"], ridge=0.0)
    row = fitted.first()
    assert row.home_bias == pytest.approx(0.2) and row.home_field_points == pytest.approx(2.5)
    fit = ratings.fit_diagnostics(games, fitted, ["g"], flag_home_field=True).first()
    assert fit.line_fit_mae == pytest.approx(0.0, abs=1e-9)


def test_walk_forward_ridge_equals_refits(spark):
    rng = np.random.default_rng(1)
    rows = [
        (2000 + n // 200, n // 20 % 10, n, float(x), float(y), 1.0, float(2 * x - y + rng.normal()))
        for n, (x, y) in enumerate(rng.normal(size=(400, 2)))
    ]
    df = spark.createDataFrame(rows, "season int, week int, game_id int, x double, y double, c double, t double")
    names = ["x", "y", "c", "week"]
    out = ridge.walk_forward_predictions(df, {"m": (names, "t", 10.0)}, min_rows=60, keep=["game_id"])
    got = {r.game_id: r.predicted for r in out.collect()}
    data = df.toPandas()
    for (season, week), fold in data.groupby(["season", "week"]):
        train = data[(data.season < season) | ((data.season == season) & (data.week < week))]
        if len(train) < 60:
            assert not set(fold.game_id) & set(got)
            continue
        X, t = train[names].to_numpy(float), train.t.to_numpy()
        sd = np.where(X.std(0) == 0, 1.0, X.std(0))
        Z = (X - X.mean(0)) / sd
        w = np.linalg.solve(Z.T @ Z + 10 * np.eye(4), Z.T @ (t - t.mean()))
        want = ((fold[names].to_numpy(float) - X.mean(0)) / sd) @ w + t.mean()
        np.testing.assert_allclose([got[g] for g in fold.game_id], want, atol=1e-9)


def test_later_weeks_never_change_earlier_forecasts(spark):
    rows = [(2000, n // 10, n, float(n % 7), float(n % 5 - n % 7)) for n in range(200)]
    df = spark.createDataFrame(rows, "season int, week int, game_id int, x double, t double")
    spoiled = df.withColumn("t", F.when(F.col("week") >= 12, F.col("t") * 100).otherwise(F.col("t")))
    spec = {"m": (["x"], "t", 1.0)}
    a, b = (
        {r.game_id: r.predicted for r in ridge.walk_forward_predictions(d, spec, min_rows=20, keep=["game_id"]).where("week <= 12").collect()}
        for d in (df, spoiled)
    )
    assert a == b and a


def test_weights(spark):
    rows = [(2000, 1 + n // 40, float(n % 11), float(n % 11), float(n % 11) + 3.0) for n in range(120)]
    df = spark.createDataFrame(rows, "season int, week int, actual double, good double, bad double")
    assert evaluate.mae_weight(df, "actual", "good", "bad").first().weight == 1.0
    assert evaluate.mae_weight(df, "actual", "bad", "good").first().weight == 0.0
    assert evaluate.least_squares_weight(df, "actual", "good", "bad").first().weight == 1.0
    weekly = {r.week: r.weight for r in evaluate.prequential_weights(df, "actual", "good", "bad", min_rows=40).collect()}
    assert weekly == {1: 0.5, 2: 1.0, 3: 1.0}


def test_elo_equals_a_plain_loop(spark):
    rows = [(n, 1999 + n // 30, n % 30, f"T{n % 4}", f"T{(n + 1 + n % 3) % 4}", n % 5 == 0, float(n * 7 % 31), float(n * 3 % 29)) for n in range(60)]
    df = spark.createDataFrame(
        [(*r, True) for r in rows],
        "game_id long, season int, week int, home_id string, away_id string, neutral_site boolean, home_points double, away_points double, completed boolean",
    ).withColumn("start_date", F.expr("timestamp_seconds(game_id * 86400)"))
    got = {r.game_id: (r.home_elo, r.away_elo) for r in college.elo_ratings(df).collect()}
    elo, season = {}, None
    for g, s, _, h, a, neutral, hp, ap in rows:
        if season is not None and s != season:
            elo = {k: 1500 + 0.65 * (v - 1500) for k, v in elo.items()}
        season = s
        x, y = elo.get(h, 1500.0), elo.get(a, 1500.0)
        assert got[g] == (pytest.approx(x), pytest.approx(y))
        d = x - y + (0 if neutral else 55)
        won = 1.0 if hp > ap else 0.0 if hp < ap else 0.5
        step = 20 * np.log(abs(hp - ap) + 1) * 2.2 / (abs(x - y) * 0.001 + 2.2) * (won - 1 / (1 + 10 ** (-d / 400)))
        elo[h], elo[a] = x + step, y - step


def test_roster_shares(spark):
    snaps = [(2023, "A", p, pos, 10.0 if off else 0.0, 0.0 if off else 10.0) for p, pos, off in (
        ("QB-A", "QB", 1), ("OL1", "OL", 1), ("OL2", "OL", 1), ("WR1", "WR", 1), ("WR2", "WR", 1), ("LB1", "LB", 0), ("CB1", "CB", 0))]
    snaps += [(2023, "B", "QB-B", "QB", 10.0, 0.0)]
    now = [(2024, 1, "A", p, "ACT") for p in ("QB-A", "OL1", "WR1", "LB1", "QB-B")]
    now += [(2024, 1, "A", "OL2", "CUT"), (2024, 2, "A", "WR2", "ACT")]
    table = roster.transition_table(
        spark.createDataFrame(now, "season int, week int, team string, pfr_id string, status string"),
        spark.createDataFrame(snaps, "season int, team string, pfr_player_id string, position string, offense_snaps double, defense_snaps double"),
    ).where("team = 'A'").first()
    assert table.roster_offense_continuity == pytest.approx(3 / 5)
    assert table.roster_defense_continuity == pytest.approx(1 / 2)
    assert table.roster_ol_continuity == table.roster_skill_continuity == pytest.approx(1 / 2)
    assert table.roster_qb_returning == 1.0
    assert table.roster_incoming_offense_share == pytest.approx(1 / 5)


def test_preseason_blend_is_idempotent(spark):
    games = spark.createDataFrame(
        [(1, 1, "A", "B", 1.0, 44.0, 12.0, 0.5, 1.0)],
        "game_id int, week int, home_team string, away_team string, predicted_home_margin double, total double, margin_std double, home_win_probability double, home_field double",
    )
    rated = spark.createDataFrame([("A", 0.5, 2.0), ("B", -0.5, 2.0)], "team string, rating double, home_field_points double")
    once = ratings.calibrate_preseason(games, rated, "s1")
    row = once.first()
    assert (row.predicted_home_margin, row.home_score, row.away_score, row.football_margin) == (3.0, 23.5, 20.5, 1.0)
    again = ratings.calibrate_preseason(once, rated, "s1").select(*once.columns)
    assert again.first() == row


def test_schema_drift_and_missing_features(spark):
    published = {k: list(v) for k, v in college.CONFIGURATIONS.items()}
    jobs.check_configuration(published, ["elo_form"])
    assert [len(v) for v in college.CONFIGURATIONS.values()] == [10, 20, 32, 46]
    published["elo_form"].append("extra")
    with pytest.raises(ValueError, match="drift"):
        jobs.check_configuration(published, ["elo_form"])
    with pytest.raises(ValueError, match="missing features"):
        ridge.check_features(spark.range(1), ["id", "nope"])


def test_missing_values_cost_a_model_only_its_own_rows(spark):
    """A null in a column that one model does not use leaves that model's fits and forecasts as they were."""
    rng = np.random.default_rng(3)
    rows = [(int(i), 1999, int(i // 20), float(a), float(b), float(2 * a - b + rng.normal())) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    specs = {"a": (["x"], "y", 1.0), "ab": (["x", "z"], "y", 1.0)}

    def run(rows):
        df = spark.createDataFrame(rows, "game_id long, season int, week int, x double, z double, y double")
        return {(r.model, r.game_id): r.predicted for r in ridge.walk_forward_predictions(df, specs, min_rows=20, keep=["game_id"]).collect()}

    holes = [(i, s, w, a, None if i % 7 == 0 or w == 3 else b, y) for i, s, w, a, b, y in rows]
    full, some = run(rows), run(holes)
    assert {k: v for k, v in full.items() if k[0] == "a"} == pytest.approx({k: v for k, v in some.items() if k[0] == "a"})
    only = run([r for r in holes if r[4] is not None])
    assert {k: v for k, v in some.items() if k[0] == "ab"} == pytest.approx({k: v for k, v in only.items() if k[0] == "ab"})
    assert len(full) == 360 and {i for m, i in some if m == "ab"} == {r[0] for r in holes if r[4] is not None and r[2] > 1}


def test_learning_in_parts_equals_one_fit(spark, tmp_path):
    import random

    r = random.Random(4)
    rows = [(k, 2000 + k // 60, 1 + k // 10 % 6, r.gauss(0, 1), r.gauss(0, 1) if k % 9 else None, r.gauss(0, 1), r.gauss(40, 5)) for k in range(180)]
    df = spark.createDataFrame(rows, "game_id int, season int, week int, a double, b double, y double, z double")
    specs = {"m": (["a", "b"], "y", 3.0), "t": (["a"], "z", 1.0)}
    root = str(tmp_path)
    late = df.where("game_id = 7")  # comes in the last run, though it is old
    for name, part in (("1", df.where("game_id < 100 AND game_id <> 7")), ("2", df.where("game_id < 150 AND game_id <> 7")), ("2", df), ("3", df)):
        new = ridge.learn_new_rows(part, specs, root, name, id_col="game_id")
    assert sorted(x.game_id for x in new.collect()) == sorted([7, *range(150, 180)]) and late.count() == 1
    one = {x.model: (x.train_rows, x.intercept, *x.coefficients) for x in ridge.full_fits(df, specs).collect()}
    two = {x.model: (x.train_rows, x.intercept, *x.coefficients) for x in ridge.learned_fits(spark, specs, root).collect()}
    assert one.keys() == two.keys() and all(abs(p - q) < 1e-9 for m in one for p, q in zip(one[m], two[m], strict=True))


def test_many_models_are_fitted_in_lots(spark, monkeypatch):
    monkeypatch.setattr(ridge, "MOST_SETS", 2)
    rows = [(k, 1 + k // 10, float(k % 7), float(k % 5), float(k % 3), float(k % 11)) for k in range(60)]
    df = spark.createDataFrame(rows, "game_id int, week int, a double, b double, c double, y double").selectExpr("*", "2000 AS season")
    specs = {n: (list(n), "y", 1.0) for n in ("a", "b", "c", "ab", "bc")}
    got = {(x.model, x.game_id): x.predicted for x in ridge.walk_forward_predictions(df, specs, min_rows=20, keep=["game_id"]).collect()}
    for n in specs:
        alone = ridge.walk_forward_predictions(df, {n: specs[n]}, min_rows=20, keep=["game_id"]).collect()
        assert alone and all(abs(got[n, x.game_id] - x.predicted) < 1e-9 for x in alone)
