"""Team ratings by least squares on schedules.

Ratings explain game margins as ``home - away + home field``. The normal equations are sums over
games, so they aggregate like any other sum; only the solve, over teams squared, runs as one small
task per group (league, season, snapshot). Groups are independent and run in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Reserved unknowns next to the teams.
HOME_FIELD = "\u0001home_field"
HOME_BIAS = "\u0001home_bias"


def normal_entries(games: DataFrame, group: Sequence[str], *, bias: bool) -> DataFrame:
    """Entries (i, j, value) of the normal matrix and (i, null, value) of its right side.

    Games carry ``home_team``, ``away_team``, ``margin``, ``weight`` and ``home_field``.
    """
    unknowns = [
        F.struct(F.col("home_team").alias("u"), F.lit(1.0).alias("x")),
        F.struct(F.col("away_team").alias("u"), F.lit(-1.0).alias("x")),
        F.struct(F.lit(HOME_FIELD).alias("u"), F.col("home_field").cast("double").alias("x")),
    ]
    if bias:
        unknowns.append(F.struct(F.lit(HOME_BIAS).alias("u"), F.lit(1.0).alias("x")))
    rows = games.withColumn("_x", F.array(*unknowns)).withColumn(
        "_y", F.array_append("_x", F.struct(F.lit(None).cast("string").alias("u"), F.col("margin").alias("x")))
    )
    pairs = rows.select(*group, "weight", F.explode("_x").alias("a"), "_y").select(
        *group, "weight", "a", F.explode("_y").alias("b")
    )
    return pairs.groupBy(*group, F.col("a.u").alias("i"), F.col("b.u").alias("j")).agg(
        F.sum(F.col("weight") * F.col("a.x") * F.col("b.x")).alias("value"),
        F.count(F.lit(1)).alias("games"),
    )


def _solver(group: list[str], *, ridge: float, bias: bool):
    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        specials = [HOME_FIELD, *([HOME_BIAS] if bias else [])]
        teams = sorted(set(cells["i"]) - set(specials))
        place = {u: n for n, u in enumerate([*teams, *specials])}
        matrix, right = np.zeros((len(place), len(place))), np.zeros(len(place))
        appearances = dict.fromkeys(teams, 0)
        games = 0
        for cell in cells.itertuples(index=False):
            row = place[cell.i]
            if cell.j is None or cell.j != cell.j:
                right[row] = cell.value
                games = max(games, cell.games if cell.i == HOME_FIELD else 0)
            else:
                matrix[row, place[cell.j]] = cell.value
                if cell.i == cell.j and cell.i in appearances:
                    appearances[cell.i] = cell.games
        empty = pd.DataFrame(columns=[*group, "team", "rating", "games", "home_field_points", "home_bias", "team_count"])
        if len(teams) < 2 or games < len(teams):
            return empty
        if ridge == 0:
            strength = np.linalg.eigvalsh(matrix)
            if (strength > strength.max() * 1e-10).sum() < len(teams):
                return empty
        for n in range(len(teams)):
            matrix[n, n] += ridge
        solution = np.linalg.pinv(matrix, rcond=1e-11, hermitian=True) @ right
        ratings = solution[: len(teams)] - solution[: len(teams)].mean()
        out = pd.DataFrame({"team": teams, "rating": ratings, "games": list(appearances.values())})
        for key in group:
            out[key] = cells[key].iloc[0]
        out["home_field_points"] = solution[place[HOME_FIELD]]
        out["home_bias"] = solution[place[HOME_BIAS]] if bias else 0.0
        out["team_count"] = len(teams)
        return out[[*group, "team", "rating", "games", "home_field_points", "home_bias", "team_count"]]

    return solve


def _ratings(games: DataFrame, group: Sequence[str], *, ridge: float, bias: bool) -> DataFrame:
    names = list(group)
    types = dict(games.dtypes)
    schema = ", ".join(
        [*(f"{g} {types[g]}" for g in names), "team string, rating double, games bigint",
         "home_field_points double, home_bias double, team_count int"]
    )
    cells = normal_entries(games, names, bias=bias)
    solved = cells.groupBy(*names).applyInPandas(_solver(names, ridge=ridge, bias=bias), schema)
    order = Window.partitionBy(*names).orderBy(F.desc("rating"), "team")
    return solved.withColumn("rank", F.row_number().over(order))


def usable_games(games: DataFrame) -> DataFrame:
    return games.where(
        "trim(home_team) <> '' AND trim(away_team) <> '' AND home_team <> away_team"
        " AND margin IS NOT NULL AND NOT isnan(margin) AND home_field IS NOT NULL"
    )


def market_ratings(games: DataFrame, group: Sequence[str]) -> DataFrame:
    """Zero-sum ratings implied by consensus margins, weighted by the number of books.

    Lines of a single book do not count. A group with fewer games than teams, or whose schedule is
    not connected, has no ratings.
    """
    lines = usable_games(games.withColumnRenamed("market_home_margin", "margin")).where("book_count > 1")
    return _ratings(lines.withColumn("weight", F.col("book_count").cast("double")), group, ridge=0.0, bias=False)


def schedule_ratings(games: DataFrame, group: Sequence[str], *, ridge: float = 0.25) -> DataFrame:
    """Ratings that decompose forecast margins of a schedule, with a designated-home bias and the
    extra edge of a true home field; a small penalty holds loosely connected teams."""
    rows = usable_games(games).withColumn("weight", F.lit(1.0))
    return _ratings(rows, group, ridge=max(ridge, 0.0), bias=True)


def fit_diagnostics(games: DataFrame, ratings: DataFrame, group: Sequence[str], *, flag_home_field: bool) -> DataFrame:
    """How well ratings reproduce the margins they came from, per group.

    ``flag_home_field`` false adds the home field to every game, neutral sites included.
    """
    names = list(group)
    side = ratings.select(*names, F.col("team"), "rating", "home_field_points", "home_bias")
    home = side.withColumnsRenamed({"team": "home_team", "rating": "_home"})
    away = side.select(*names, F.col("team").alias("away_team"), F.col("rating").alias("_away"))
    field = F.col("home_field") if flag_home_field else F.lit(1.0)
    fitted = F.col("_home") - F.col("_away") + F.col("home_bias") + F.col("home_field_points") * field
    rows = games.join(home, [*names, "home_team"]).join(away, [*names, "away_team"])
    residual = fitted - F.col("margin")
    extra = []
    if {"book_count", "line_iqr"} <= set(games.columns):
        extra = [F.median("book_count").alias("median_book_count"), F.median("line_iqr").alias("median_line_iqr")]
    return rows.groupBy(*names).agg(
        F.count(F.lit(1)).alias("games"),
        F.avg(F.abs(residual)).alias("line_fit_mae"),
        F.sqrt(F.avg(residual * residual)).alias("line_fit_rmse"),
        *extra,
    )


RANK_RANGE = 0.25  # points of rating


def form_ratings(snapshot: DataFrame) -> DataFrame:
    """Descriptive recent-form score of every team with a complete snapshot, ranked."""
    score = F.expr(
        "points_for_l4 - points_against_l4 + 8D * (off_epa_l4 - def_epa_l4)"
        " + 3D * (pressure_generated_l4 - pressure_allowed_l4)"
    )
    scored = snapshot.select("team", score.alias("rating")).where("rating IS NOT NULL")
    # Teams are ranked inside narrow rating ranges and shifted by the counts of the ranges above; the
    # only window over everything is over the ranges, whose number depends on the scale of a rating.
    ranged = scored.withColumn("_range", F.floor(-F.col("rating") / RANK_RANGE))
    above = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    shift = counts.select("_range", F.coalesce(F.sum("_rows").over(above), F.lit(0)).alias("_above"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc("rating"), "team"))
    ranked = ranged.withColumn("_inside", inside).join(F.broadcast(shift), "_range")
    return ranked.select("team", "rating", (F.col("_inside") + F.col("_above")).alias("rank"))


def neutral_matchups(games: DataFrame) -> DataFrame:
    return games.where("COALESCE(neutral_site, false)").select("away_team", "home_team").distinct()


def calibrate_preseason(predictions: DataFrame, ratings: DataFrame, snapshot_at: str) -> DataFrame:
    """Blend a market-strength prior into early-season margins.

    Full weight in week 1, a quarter less each week. The football-only forecast is kept beside the
    blend. A prediction already calibrated with this snapshot is left as it is, which makes the
    step idempotent; so is one whose teams have no rating. Where both sides have a season, a team's
    rating is that of the season.
    """
    from ..functions.numeric import normal_cdf
    from ..functions.odds import score_pair
    from ..functions.timeparse import transition_weight

    frame = predictions
    for name, source in (("football_margin", "predicted_home_margin"), ("football_total", "total"),
                         ("football_probability", "home_win_probability"), ("calibrated_with", None)):
        if name not in frame.columns:
            frame = frame.withColumn(name, F.lit(None).cast("string" if source is None else "double"))
    by = ["season"] if "season" in ratings.columns and "season" in frame.columns else []
    home = ratings.select(*by, F.col("team").alias("home_team"), F.col("rating").alias("_home"), "home_field_points")
    away = ratings.select(*by, F.col("team").alias("away_team"), F.col("rating").alias("_away"))
    joined = frame.join(home, [*by, "home_team"], "left").join(away, [*by, "away_team"], "left")
    due = F.col("_home").isNotNull() & F.col("_away").isNotNull() & ~F.coalesce(
        F.col("calibrated_with") == snapshot_at, F.lit(False)
    )
    football = F.coalesce("football_margin", "predicted_home_margin")
    total = F.coalesce("football_total", "total")
    prior = F.col("_home") - F.col("_away") + F.col("home_field_points") * F.col("home_field")
    weight = transition_weight(F.col("week"))
    margin = weight * prior + (1.0 - weight) * football
    home_score, away_score = score_pair(margin, total)
    sigma = F.greatest(F.col("margin_std"), F.lit(1e-6))
    updated = {
        "football_margin": F.bround(football, 2),
        "football_total": F.bround(total, 1),
        "football_probability": F.bround(F.coalesce("football_probability", "home_win_probability"), 4),
        "prior_home_margin": F.bround(prior, 2),
        "calibration_weight": F.bround(weight, 4),
        "predicted_home_margin": F.bround(margin, 2),
        "home_score": F.bround(home_score, 1),
        "away_score": F.bround(away_score, 1),
        "home_win_probability": F.bround(normal_cdf(margin / sigma), 4),
        "calibrated_with": F.lit(snapshot_at),
        "forecast_method": F.when(weight > 0, F.lit("preseason calibrated")).otherwise("football only"),
    }
    kept = {n: F.when(due, c).otherwise(F.col(n)) if n in frame.columns else F.when(due, c) for n, c in updated.items()}
    return joined.withColumns(kept).drop("_home", "_away", "home_field_points")
