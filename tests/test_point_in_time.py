from pyspark.sql import functions as F

from priorwise.operators import teamform
from priorwise.plans.bindings import Tables

SMALL = "/root/testdata/sf0.001"


def test_future_results_never_change_features(spark):
    t = Tables(spark, SMALL)
    cut = "1998-06-01"
    later = F.col("gameday") >= F.lit(cut).cast("date")
    spoiled = t.games.withColumn("home_score", F.when(later, F.col("home_score") * 50).otherwise(F.col("home_score")))
    names = [c for s in ("home", "away") for c in (f"{s}_rest_days", *(f"{s}_{n}" for n in teamform.STATE_FEATURES))]

    def early(games):
        rows = teamform.game_features(games, t.plays, include_unplayed=True, plays_by="side")
        return sorted(map(tuple, rows.where(F.col("gameday") <= F.lit(cut).cast("date")).select("game_id", *names).collect()))

    before = early(t.games)
    assert before == early(spoiled) and len(before) > 500
