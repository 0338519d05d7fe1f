"""What jobs leave on disk: stored tables, files of shuffles, blocks of trees, refused releases."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from priorwise import session
from priorwise.operators import boosting, college, ensemble, teamform
from priorwise.operators.boosting import Profile
from priorwise.sources import releases

from test_boosting import games
from test_teamform import rows


def files_below(folder) -> int:
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())


def checkpoint_folder(spark) -> str:
    return session._checkpoint_dir(spark).removeprefix("file:")


def test_stored_tables_keep_their_rows_in_fewer_bytes(spark):
    made = spark.range(20_000).select("id", F.when(F.col("id") % 7 != 0, F.col("id") % 50).cast("double").alias("x"), F.lit("text").alias("t"), *[(F.col("id") % k).cast("double").alias(f"c{k}") for k in range(2, 22)])
    folder = checkpoint_folder(spark)
    before = files_below(folder)
    stored = session.store(made)
    took = files_below(folder) - before
    session.cut_lineage(made)
    assert 4 * took < files_below(folder) - before - took
    assert stored.schema.names == made.schema.names and stored.exceptAll(made).isEmpty() and made.exceptAll(stored).isEmpty()


def test_files_of_shuffles_go_when_a_query_ends(spark):
    session.configure(spark)
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    assert spark.range(1000).repartition(5).groupBy((F.col("id") % 9).alias("k")).count().count() == 9
    assert tracker.shuffleStatuses().size() <= before


def test_only_the_wanted_features_are_dealt(spark):
    made = rows(spark)
    wanted = ["win_pct_l8", "off_epa_volatility_l8"]
    priors = teamform.league_priors(made, teamform.measures_of(wanted))
    out = teamform.features_as_of(made, priors, wanted)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sack_rate_allowed" not in plan.split("Range")[0].split("FlatMapGroupsInArrow")[1].split("\n")[1]
    assert out.columns == ["game_id", "team", "side", "rest_days", *wanted]
    whole = teamform.features_as_of(made, teamform.league_priors(made)).select(*out.columns)
    assert sorted(map(str, out.collect())) == sorted(map(str, whole.collect()))


def test_games_have_the_features_that_are_named(spark, monkeypatch):
    monkeypatch.setattr(teamform, "game_team_summary", lambda plays: plays)
    monkeypatch.setattr(teamform, "team_games", lambda *_, **__: rows(spark, 60))
    schedule = spark.createDataFrame([(k, 2001, 1, 20, k, False) for k in range(60)], "game_id long, season int, week int, home_score int, away_score int, neutral_site boolean")
    all_, some = (teamform.game_features(schedule, None, features=f) for f in (None, ["home_def_epa_l4", "away_def_epa_l4"]))
    assert "home_yards_l4" in all_.columns and "home_yards_l4" not in some.columns
    assert sorted(map(str, some.collect())) == sorted(map(str, all_.select(*some.columns).collect()))


def test_members_of_an_ensemble_read_one_stored_table(spark, monkeypatch):
    stored = []
    for module in (boosting, ensemble, __import__("priorwise.operators.ridge", fromlist=["x"])):
        monkeypatch.setattr(module, "store", lambda df: stored.append(df.columns) or session.store(df))
    df = games(spark).withColumn("unread", F.lit(1.0))
    monkeypatch.setitem(ensemble.TREE_PROFILES, "current", Profile(2, 1, 0.1, 5))
    out = ensemble.component_oof(df, {"m": (["f1", "f2"], "a")}, 1.0, keep=["game"], min_rows=40)
    assert out.count() > 50 and stored == [["game", "season", "week", "f1", "f2", "a"]]


def test_blocks_written_before_are_deleted(spark, monkeypatch):
    monkeypatch.setattr(boosting, "STORED", 2)
    profile = {"p": Profile(9, 1, 0.1, 5)}
    made = boosting.prepare(games(spark), {"m": (["f1", "f2"], "a")}, profile, ["game"], 40, None)
    growth = boosting.Growth(made.blocks, 2, made.own, made.fits, profile)
    written, forget = [], growth.forget

    def watched(last):
        written.extend(r for r in growth.written if r not in written)
        forget(last)
        assert sum(os.path.exists(r.getCheckpointFile().removeprefix("file:")) for r in written if r.getCheckpointFile()) <= max(last, 0)

    growth.forget = watched
    growth.grow()
    assert len(written) >= 4


def test_below_the_root_the_side_of_fewer_rows_is_counted(spark, monkeypatch):
    profile = {"p": Profile(4, 3, 0.1, 5)}
    made = boosting.prepare(games(spark), {"m": (["f1", "f2", "f3"], "a")}, profile, ["game"], 40, None)
    growth = boosting.Growth(made.blocks, 3, made.own, made.fits, profile)
    shares, sums = [], growth.split_sums

    def counted(growing, turn, places):
        out = sums(growing, turn, places)
        for place, (k, node) in enumerate(places):
            rows = out[1, place, 0].sum()
            if node:
                shares.append((rows, whole[k]))
            else:
                whole[k] = rows
        return out

    whole = {}
    growth.split_sums = counted
    growth.grow()
    assert shares and all(2 * rows <= all_ for rows, all_ in shares)


def test_refused_releases_leave_no_files(spark, tmp_path):
    table = spark.range(100).withColumn("x", F.when(F.col("id") != 5, 1.0))
    with pytest.raises(releases.ContractError):
        releases.publish_checked(spark, "t", table, str(tmp_path), "r", {"missing": F.col("x").isNull()})
    assert not list(tmp_path.rglob("*.parquet"))


def test_preseason_meets_games_before_they_carry_their_form(spark):
    day = "TIMESTAMP '2001-09-01 12:00:00'"
    schedule = spark.range(60).selectExpr(
        "id AS game_id", "2001 AS season", "CAST(id / 6 AS INT) + 1 AS week", f"{day} + make_interval(0, 0, 0, CAST(id AS INT)) AS start_date", "concat('T', id % 5) AS home_team",
        "concat('T', 5 + id % 4) AS away_team", "concat('T', id % 5) AS home_id", "concat('T', 5 + id % 4) AS away_id", "id % 30 AS home_points", "id % 17 AS away_points", "true AS completed",
        "true AS fbs_vs_fbs", "false AS neutral_site", "false AS conference_game", "0 AS league",
    )
    advanced = spark.range(0).selectExpr("id AS game_id", "'T' AS team", *[f"1D AS {c}" for c in college._ADVANCED.values()])
    preseason = spark.range(3).selectExpr("2001 AS season", "concat('T', id) AS team", *[f"CAST(id + 1 AS DOUBLE) AS {c}" for c in college.PRESEASON_FEATURES])
    lines = spark.range(0).selectExpr("id AS game_id", "1D AS market_home_margin", "1D AS market_total", "3L AS market_provider_count")
    out = college.college_features(schedule, advanced, preseason, lines)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    first = [line for line in plan.split("\n") if "Join" in line]
    assert "game_id" in first[0] and "game_id" in first[1] and "LeftOuter" in first[0] and "Inner" in first[1]  # lines, form; the preseason comes below
    got = {r["game_id"]: (r["home_talent_z"], r["away_talent_z"]) for r in out.collect()}
    assert got == {k: (float(k % 5 + 1) if k % 5 < 3 else 0.0, 0.0) for k in range(60)}
