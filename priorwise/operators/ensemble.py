"""Candidate models, their blends and the model registry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, normal_cdf
from ..session import store
from . import evaluate
from .boosting import Profile, boosted_oof
from .ridge import walk_forward_predictions

GAME_RIDGE = 50.0
PLAYER_RIDGE = 10.0

# Boosted-tree profiles compared by the tuning report.
TREE_PROFILES = {
    "current": Profile(rounds=150, depth=2, rate=0.035, min_leaf=10, sample=0.8),
    "shallow_huber": Profile(rounds=200, depth=1, rate=0.03, min_leaf=15, sample=0.8),
    "conservative_huber": Profile(rounds=150, depth=2, rate=0.025, min_leaf=20, sample=0.8),
    "shallow_squared": Profile(rounds=150, depth=1, rate=0.03, min_leaf=15, sample=0.8, loss="squared"),
    "histogram_absolute": Profile(rounds=150, depth=3, rate=0.05, min_leaf=20, loss="absolute", leaves=7, penalty=5.0),
}
# Ridge penalty and tree profile of every tuning candidate.
TUNING_PROFILES = {
    "current": (10.0, "current"),
    "ridge30_current_tree": (30.0, "current"),
    "ridge50_current_tree": (50.0, "current"),
    "ridge100_current_tree": (100.0, "current"),
    "shallow_huber": (30.0, "shallow_huber"),
    "conservative_huber": (50.0, "conservative_huber"),
    "shallow_squared": (30.0, "shallow_squared"),
    "histogram_absolute": (50.0, "histogram_absolute"),
}


def component_oof(
    df: DataFrame, models: Mapping[str, tuple[Sequence[str], str]], alpha: float, *,
    keep: Sequence[str], min_rows: int = 350, profile: str = "current",
) -> DataFrame:
    """Out-of-fold forecasts of both members: ``keep``, season, week, model, actual, ridge, tree.

    Ridge is fitted for every week, trees for every season; rows that both forecast are given. A model has its
    features and its target. Both members read one stored table, of the columns they need.
    """
    names = list(dict.fromkeys([*keep, "season", "week"]))
    rows = store(df.select(*dict.fromkeys([*names, *(c for features, target in models.values() for c in (*features, target))])))
    specs = {name: (features, target, alpha) for name, (features, target) in models.items()}
    ridge = walk_forward_predictions(rows, specs, min_rows=min_rows, keep=keep, stored=True).select(*names, "model", "actual", F.col("predicted").alias("ridge"))
    trees = boosted_oof(rows, models, {profile: TREE_PROFILES[profile]}, keep=keep, min_rows=min_rows, stored=True)
    return ridge.join(trees.select(*names, "model", F.col("tree_prediction").alias("tree")), [*names, "model"])


def blend_out_of_fold(
    oof: DataFrame, *, actual: str = "actual", first: str = "first", second: str = "second",
    baseline: str | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Attach the blended forecast and its member weights to every out-of-fold row.

    The two candidates get their closed-form convex weight, in each group ``by``; with ``baseline`` the blend
    is mixed with it at the MAE-optimal grid weight. Weights are a row a group and travel to the data.
    """
    def attached(rows: DataFrame, weights: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(weights), list(by)) if by else rows.crossJoin(F.broadcast(weights))  # a row a group

    w = evaluate.least_squares_weight(oof, actual, first, second, by).withColumnRenamed("weight", "_w")
    mixed = attached(oof, w).withColumn("_blend", F.expr(f"_w * {first} + (1D - _w) * {second}"))
    if baseline is None:
        return mixed.withColumns(
            {
                "first_weight": F.col("_w"),
                "second_weight": 1.0 - F.col("_w"),
                "baseline_weight": F.lit(0.0),
                "ensemble": F.col("_blend"),
            }
        ).drop("_w", "_blend")
    b = evaluate.mae_weight(mixed, actual, "_blend", baseline, by).withColumnRenamed("weight", "_b")
    return attached(mixed, b).withColumns(
        {
            "first_weight": F.expr("_b * _w"),
            "second_weight": F.expr("_b * (1D - _w)"),
            "baseline_weight": F.expr("1D - _b"),
            "ensemble": F.expr(f"_b * _blend + (1D - _b) * {baseline}"),
        }
    ).drop("_w", "_b", "_blend")


def ensemble_metrics(
    blended: DataFrame, *, actual: str = "actual", forecast: str = "ensemble", baseline: str | None = None,
    winner: bool = False,
) -> DataFrame:
    """Error, interval, latest-season and (for margins) winner metrics of a blend, one row.

    The residual deviation comes first, since intervals and probabilities depend on it.
    """
    residual = F.col(actual) - F.col(forecast)
    spread = blended.agg(
        F.greatest(F.stddev_samp(residual), F.lit(1e-6)).alias("residual_std"),
        F.max("season").alias("latest_season"),
    )
    rows = blended.crossJoin(F.broadcast(spread))  # a single row
    latest = F.col("season") == F.col("latest_season")
    metrics: dict[str, Column] = evaluate.error_metrics(F.col(actual), F.col(forecast))
    metrics |= evaluate.interval_metrics(F.col(actual), F.col(forecast), F.col("residual_std"))
    metrics["residual_std"] = F.first("residual_std")
    metrics["latest_holdout_season"] = F.first("latest_season")
    metrics["latest_holdout_rows"] = F.count_if(latest)
    metrics["latest_holdout_mae"] = F.avg(F.when(latest, F.abs(residual)))
    if baseline is not None:
        gap = F.abs(F.col(baseline) - F.col(actual))
        metrics["baseline_mae"] = F.avg(gap)
        metrics["mae_improvement_vs_baseline"] = F.avg(gap) - F.avg(F.abs(residual))
        metrics["latest_holdout_baseline_mae"] = F.avg(F.when(latest, gap))
    if winner:
        probability = normal_cdf(F.col(forecast) / F.col("residual_std"))
        outcome = (F.col(actual) > 0).cast("double")
        rows = rows.withColumns({"_p": probability, "_o": outcome})
        named = evaluate.probability_metrics(F.col("_p"), F.col("_o"))
        metrics |= {f"winner_{n}": c for n, c in named.items()}
    out = rows.agg(*[c.alias(n) for n, c in metrics.items()])
    if winner:
        calibration = evaluate.calibration_error(rows, "_p", "_o").select(
            F.col("calibration_error").alias("winner_calibration_error")
        )
        out = out.crossJoin(calibration)
    return out


def score_forecasts(df: DataFrame, margin: str, total: str) -> DataFrame:
    """Publishable scores from margin and total: floors at zero, fixed rounding."""
    m, t = F.col(margin), F.col(total)
    return df.withColumns(
        {
            "home_score_forecast": F.bround(clip((t + m) / 2.0, 0.0), 1),
            "away_score_forecast": F.bround(clip((t - m) / 2.0, 0.0), 1),
            "margin_forecast": F.bround(m, 2),
            "total_forecast": F.bround(clip(t, 0.0), 1),
        }
    )


def best_configuration(results: DataFrame, name: str, by: Sequence[str], mae: str) -> DataFrame:
    """Configuration with the lowest development MAE per target; the name breaks ties."""
    return results.groupBy(*by).agg(
        F.min_by(name, F.struct(F.col(mae), F.col(name))).alias("selected"), F.min(mae).alias("selected_mae")
    )


def group_combinations(core: Sequence[str], groups: dict[str, Sequence[str]]) -> dict[str, list[str]]:
    """The core features alone and with every combination of the groups."""
    from itertools import combinations

    out = {"core": list(core)}
    for size in range(1, len(groups) + 1):
        for chosen in combinations(groups, size):
            out["core+" + "+".join(chosen)] = [*core, *[f for g in chosen for f in groups[g]]]
    return out


def change_versus(results: DataFrame, model: str, reference: str, by: Sequence[str], value: str = "mae") -> DataFrame:
    """Difference of every model's metric from a reference model's; ``results`` has a row for each model and group."""
    base = F.max(F.when(F.col(model) == reference, F.col(value))).over(Window.partitionBy(*by))  # as many rows as models
    return results.withColumn(f"{value}_change", F.col(value) - base).where(F.col(f"{value}_change").isNotNull())
