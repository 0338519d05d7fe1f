import math

import pytest
from pyspark.sql import functions as F

from priorwise.functions import numeric, odds, text, timeparse


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_normal_cdf_matches_the_library_function(spark):
    points = [x / 7.0 for x in range(-70, 71)] + [0.0, 1e-9, 30.0, -30.0]
    rows = spark.createDataFrame([(p,) for p in points], "x double")
    for row in rows.select("x", numeric.normal_cdf(F.col("x")).alias("p")).collect():
        assert row.p == pytest.approx(0.5 * (1 + math.erf(row.x / math.sqrt(2))), abs=1e-15)


def test_american_prices(spark):
    assert one(spark, odds.implied_probability(F.lit(-110))) == pytest.approx(110 / 210)
    assert one(spark, odds.implied_probability(F.lit(150))) == pytest.approx(100 / 250)
    assert one(spark, odds.no_vig(F.lit(-110), F.lit(-110))) == 0.5
    assert one(spark, odds.implied_probability(F.lit(0), strict=False)) is None
    with pytest.raises(Exception, match="price of zero"):
        one(spark, odds.implied_probability(F.lit(0)))


def test_safe_divide_defaults(spark):
    assert one(spark, numeric.safe_divide(F.lit(1.0), F.lit(0.0), 0.5)) == 0.5
    assert one(spark, numeric.safe_divide(F.lit(None).cast("double"), F.lit(2.0), 0.5)) == 0.5
    assert one(spark, numeric.safe_divide(F.lit(1.0), F.lit(4.0), 0.5)) == 0.25


def test_name_key_folds_accents_and_agrees_with_the_full_form(spark):
    names = ["D'André Smith-Njigba Jr.", "Łukasz Ünal", "", None, "José Núñez 3rd", "Ａｂｃ", "ﬁnn", "𝐀dam", "ǆero", "½ ⅷ ㎏", "ẞßſ", "Ⅻ🄐"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    out = rows.select(text.name_key(F.col("n")).alias("a"), text.name_key_udf(F.col("n")).alias("b")).collect()
    assert out[0].a == "name:dandresmithnjigbajr"
    assert out[2].a == out[3].a == ""
    assert [r.a for r in out[6:9]] == ["name:finn", "name:adam", "name:dzero"]
    assert all(r.a == r.b for r in out)


def test_kickoffs_and_seasons(spark):
    kick = timeparse.local_kickoff(F.lit("2025-09-07").cast("date"), F.lit("13:00"))
    assert str(one(spark, kick)) .endswith("17:00:00")
    assert one(spark, timeparse.local_kickoff(F.lit("2025-09-07").cast("date"), F.lit("TBD"))) is None
    assert one(spark, timeparse.league_year(F.lit("2026-03-14").cast("date"))) == 2025
    assert one(spark, timeparse.training_seasons(F.lit("2026-03-15").cast("date"))) == [2022, 2023, 2024, 2025, 2026]
    assert one(spark, timeparse.parse_season_list(F.lit("2022-2025,2027,2024"))) == [2022, 2023, 2024, 2025, 2027]
    assert one(spark, timeparse.parse_instant(F.lit("2025-01-01T00:00:00"))) is None
    assert one(spark, timeparse.transition_weight(F.lit(4))) == 0.25
    assert one(spark, timeparse.transition_weight(F.lit(9))) == 0.0


def test_labels(spark):
    assert one(spark, text.spread_label(F.lit(-3.5), F.lit("H"), F.lit("A"))) == "A -3.5"
    assert one(spark, text.spread_label(F.lit(0.01), F.lit("H"), F.lit("A"))) == "Pick"
    assert one(spark, text.line_label(F.lit("H"), F.lit(-3.5), F.lit(46.0), F.lit(True))) == "H -3.5 · O/U 46.0"
    assert one(spark, odds.moneyline(F.lit(0.6))) == -150
    assert one(spark, text.canonical_club(F.lit(" WSH "))) == "WAS"
