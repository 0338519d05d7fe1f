"""Whole jobs: the weekly college forecast, game and player models, roster ablation."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import Z80, normal_cdf
from ..operators import college, ensemble, evaluate, players, ridge, roster, teamform
from ..operators.ridge import linear_prediction
from ..sources.releases import ContractError, publish_checked
from ..session import cut_lineage, local_folder, store

PLAYER_TARGETS = {
    "passing_yards": ("passing", "passing"),
    "receiving_yards": ("receiving", "receiving"),
    "receptions": ("receiving", "receptions"),
    "rushing_yards": ("rushing", "rushing"),
}


def fresh_folder(root: str) -> str:
    return f"{root.rstrip('/')}/priorwise-{uuid.uuid4().hex}"


def shared_root(spark: SparkSession) -> str:
    """A fresh folder that all executors see."""
    return fresh_folder(spark.sparkContext.getConf().get("spark.checkpoint.dir") or local_folder(spark))


def game_models(games: DataFrame) -> DataFrame:
    """Margin and total models fitted on all completed games, as registry rows.

    Both share one Gram matrix; the residual deviation comes from the walk-forward errors.
    """
    specs = {
        "game_margin": (teamform.CORE_GAME_FEATURES, "home_margin", ensemble.GAME_RIDGE),
        "game_total": (teamform.CORE_GAME_FEATURES, "total_points", ensemble.GAME_RIDGE),
    }
    ridge.check_features(games, [*teamform.CORE_GAME_FEATURES, "home_margin", "total_points"])
    # Stored with the columns of the models alone, so that nothing else is made for them.
    games = store(games.select(*dict.fromkeys(["game_id", *ridge.FOLD, *teamform.CORE_GAME_FEATURES, "home_margin", "total_points"])))
    fits = ridge.full_fits(games, specs, min_rows=350)
    oof = ridge.walk_forward_predictions(games, specs, min_rows=350, keep=["game_id"], stored=True)
    spread = oof.groupBy("model").agg(F.stddev_samp(F.col("actual") - F.col("predicted")).alias("residual_std"))
    target = F.when(F.col("model") == "game_margin", "home_margin").otherwise("total_points")
    names = F.array(*[F.lit(f) for f in teamform.CORE_GAME_FEATURES])
    return fits.join(spread, "model").select(
        "model", target.alias("target"), names.alias("features"), "intercept", "coefficients",
        F.greatest("residual_std", F.lit(1e-6)).alias("residual_std"),
    )


def player_frame(log: DataFrame, games: DataFrame, kind: str) -> DataFrame:
    """Player features with the opponent's defence attached."""
    return players.attach_opponent_defence(players.player_features(log, kind), games)


#: Game models: margin and total points, each with its own features.
GAME_MODELS = {
    "margin": (teamform.CORE_GAME_FEATURES, "home_margin"),
    "total": ([*teamform.CORE_GAME_FEATURES, *roster.ROSTER_GROUPS["roster_offense_positions"]], "total_points"),
}


def game_components(games: DataFrame, *, min_rows: int = 350) -> DataFrame:
    """Out-of-fold ridge and tree forecasts of margin and total, with the simple baseline of the game."""
    rows = teamform.game_baselines(games)
    oof = ensemble.component_oof(rows, GAME_MODELS, ensemble.GAME_RIDGE, keep=["game_id", "baseline_margin", "baseline_total"], min_rows=min_rows)
    baseline = F.when(F.col("model") == "margin", F.col("baseline_margin")).otherwise(F.col("baseline_total"))
    return oof.withColumn("baseline", baseline).drop("baseline_margin", "baseline_total")


def game_ensembles(games: DataFrame, *, min_rows: int = 350) -> DataFrame:
    """Both game ensembles: members, their weights and the blend for every out-of-fold row."""
    oof = store(game_components(games, min_rows=min_rows))
    return ensemble.blend_out_of_fold(oof, first="ridge", second="tree", by=["model"])


def independent_forecasts(games: DataFrame, *, min_rows: int = 350) -> DataFrame:
    """Margin and total of a game on one row, members weighted by the errors of earlier weeks only."""
    oof = store(game_components(games, min_rows=min_rows))
    blended = evaluate.prequential_blend(oof, "actual", "ridge", "tree", out="predicted", weight="ridge_weight", by=["model"])

    def pick(model: str, column: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(column)))

    return blended.groupBy("game_id", "season", "week").agg(
        *[pick(m, c).alias(f"{m}_{c}") for m in GAME_MODELS for c in ("actual", "predicted", "ridge_weight")]
    ).where("margin_predicted IS NOT NULL AND total_predicted IS NOT NULL")


def player_reports(logs: Mapping[str, DataFrame], games: DataFrame, *, min_rows: int = 350) -> DataFrame:
    """Ensemble metrics per player target: ridge and trees, and the rolling mean as a third member.

    The logs are laid under one another; a target learns from the rows that have its columns, so all four
    share Gram matrices and grow their trees together.
    """
    games = cut_lineage(games.select("game_id", "home_team", "home_def_epa_l4", "away_def_epa_l4"))
    models = {target: (players.PLAYER_FEATURES[names], target) for target, (_, names) in PLAYER_TARGETS.items()}
    together = None
    for kind, log in logs.items():
        own = [t for t, (k, _) in PLAYER_TARGETS.items() if k == kind]
        columns = dict.fromkeys([*(f for t in own for f in models[t][0]), *own])
        frame = player_frame(log, games, kind).select(F.lit(kind).alias("kind"), "game_id", "player_id", "season", "week", *columns)
        together = frame if together is None else together.unionByName(frame, allowMissingColumns=True)
    baselines = [f"{t}_l4" for t in PLAYER_TARGETS]
    oof = ensemble.component_oof(together, models, ensemble.PLAYER_RIDGE, keep=["kind", "game_id", "player_id", *baselines], min_rows=min_rows)
    baseline = F.coalesce(*[F.when(F.col("model") == t, F.col(f"{t}_l4")) for t in PLAYER_TARGETS])
    members = store(oof.withColumn("baseline", baseline).drop(*baselines))
    # Weights, residual spread and metrics each pass over these rows.
    blended = store(ensemble.blend_out_of_fold(members, first="ridge", second="tree", baseline="baseline", by=["model"]))
    out = None
    for target in PLAYER_TARGETS:
        part = ensemble.ensemble_metrics(blended.where(F.col("model") == target), baseline="baseline").withColumn("target", F.lit(target))
        out = part if out is None else out.unionByName(part)
    return out


def tuning_report(games: DataFrame, *, holdout_season: int, min_rows: int = 350) -> DataFrame:
    """Every tuning candidate on both targets: errors of the blend and its members before, in and over the holdout.

    All penalties share Gram matrices, and all tree profiles grow together; a candidate is a pair of them, whose
    weights are learned from earlier weeks.
    """
    targets = {"margin": "home_margin", "total": "total_points"}
    features = teamform.CORE_GAME_FEATURES
    rows = store(games.select(*dict.fromkeys(["game_id", *ridge.FOLD, *features, *targets.values()])))
    penalties = sorted({alpha for alpha, _ in ensemble.TUNING_PROFILES.values()})
    specs = {f"{t}:{alpha:g}": (features, column, alpha) for t, column in targets.items() for alpha in penalties}
    ridge_part = F.split("model", ":")
    ridges = ridge.walk_forward_predictions(rows, specs, min_rows=min_rows, keep=["game_id"], stored=True).select(
        "game_id", "season", "week", ridge_part[0].alias("target"), ridge_part[1].alias("penalty"), "actual", F.col("predicted").alias("ridge")
    )
    trees = ensemble.boosted_oof(rows, {t: (features, c) for t, c in targets.items()}, ensemble.TREE_PROFILES, keep=["game_id"], min_rows=min_rows, stored=True)
    trees = trees.select("game_id", "season", "week", F.col("model").alias("target"), F.col("profile").alias("trees"), F.col("tree_prediction").alias("tree"))
    pairs = [F.struct(F.lit(name).alias("profile"), F.lit(f"{alpha:g}").alias("penalty"), F.lit(t).alias("trees")) for name, (alpha, t) in ensemble.TUNING_PROFILES.items()]
    # each ridge row goes to the candidates of its penalty
    of = F.filter(F.array(*pairs), lambda p: p["penalty"] == F.col("penalty"))
    members = ridges.select("*", F.explode(of).alias("c")).select("game_id", "season", "week", "target", "actual", "ridge", "c.profile", "c.trees")
    members = store(members.join(trees, ["game_id", "season", "week", "target", "trees"]))
    blended = evaluate.prequential_blend(members, "actual", "ridge", "tree", out="blend", weight="ridge_weight", by=["profile", "target"])
    split = F.array(F.lit("all_oof"), F.expr(f"CASE WHEN season < {holdout_season} THEN 'development' WHEN season = {holdout_season} THEN 'holdout' END"))
    parts = blended.withColumn("split", F.explode(split)).where("split IS NOT NULL")

    def error(column: str) -> Column:
        return F.avg(F.abs(F.col(column) - F.col("actual")))

    return parts.groupBy("profile", "target", "split").agg(
        F.count(F.lit(1)).alias("rows"), error("blend").alias("mae"), error("ridge").alias("ridge_mae"),
        error("tree").alias("tree_mae"), F.avg("ridge_weight").alias("mean_ridge_weight"),
    )


def college_weekly(
    games: DataFrame, advanced: DataFrame, preseason: DataFrame, lines: DataFrame, *,
    as_of: str, season: int, week: int | None = None, min_rows: int = 1200, alpha: float = 50.0,
    configuration: str = "elo_form_advanced_preseason",
) -> DataFrame:
    """Forecast the earliest open week (or ``week``) from what was known at ``as_of``.

    Results after the cut are forgotten before any feature is built; the models learn from games
    completed by then, and their residual deviation from walk-forward errors.
    """
    cut_at = F.to_timestamp(F.lit(as_of))
    known_games, known_stats = college.as_of_cut(games, advanced, cut_at)
    names = college.CONFIGURATIONS[configuration]
    keep = ["game_id", "season", "week", "start_date", "home_team", "away_team"]
    rows = college.college_features(known_games, known_stats, preseason, lines, include_scheduled=True)
    rows = store(rows.select(*dict.fromkeys([*keep, "completed", *names, "home_margin", "total_points"])))
    specs = {"margin": (names, "home_margin", alpha), "total": (names, "total_points", alpha)}
    training = rows.where(F.col("completed") & (F.col("start_date") <= cut_at))
    fits = ridge.full_fits(training, specs, min_rows=min_rows)
    oof = ridge.walk_forward_predictions(training, specs, min_rows=min_rows, keep=["game_id"], stored=True)
    spread = oof.groupBy("model").agg(
        F.greatest(F.stddev_samp(F.col("actual") - F.col("predicted")), F.lit(1e-6)).alias("std")
    )
    models = fits.join(spread, "model")
    open_games = rows.where((F.col("season") == season) & ~F.col("completed") & (F.col("start_date") > cut_at))
    if week is None:
        first = open_games.agg(F.min("week").alias("week"))
        chosen = open_games.join(F.broadcast(first), "week")  # a single row
    else:
        chosen = open_games.where(F.col("week") == week)
    scored = chosen.crossJoin(F.broadcast(models)).select(  # two rows
        *keep, "model", "std", linear_prediction(names).alias("mean")
    )

    def pick(model: str, value):
        return F.max(F.when(F.col("model") == model, value))

    wide = scored.groupBy(*keep).agg(
        pick("margin", F.col("mean")).alias("predicted_home_margin"),
        pick("margin", F.col("std")).alias("margin_std"),
        pick("total", F.col("mean")).alias("predicted_total"),
        pick("total", F.col("std")).alias("total_std"),
    )
    m, t = F.col("predicted_home_margin"), F.col("predicted_total")
    return wide.withColumns(
        {
            "predicted_home_score": (t + m) / 2.0,
            "predicted_away_score": (t - m) / 2.0,
            "home_win_probability": normal_cdf(m / F.col("margin_std")),
            "margin_p10": m - Z80 * F.col("margin_std"),
            "margin_p90": m + Z80 * F.col("margin_std"),
            "total_p10": t - Z80 * F.col("total_std"),
            "total_p90": t + Z80 * F.col("total_std"),
        }
    )


def roster_ablation(games: DataFrame, sets: Mapping[str, Sequence[str]], *, holdout_season: int) -> DataFrame:
    """Margin error of every feature set by split, against the core set; one Gram matrix in all."""
    specs = {name: (features, "home_margin", ensemble.GAME_RIDGE) for name, features in sets.items()}
    oof = ridge.walk_forward_predictions(games, specs, min_rows=350, keep=["game_id"])
    error = F.abs(F.col("predicted") - F.col("actual"))
    early = F.col("week") <= 4
    parts = oof.groupBy("model", "season", early.alias("early")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(error).alias("a")
    )
    splits = F.array(
        F.lit("all_oof"),
        F.when(F.col("early"), "weeks_1_4"),
        F.when(F.col("early") & (F.col("season") < holdout_season), "development_weeks_1_4"),
        F.when(F.col("early") & (F.col("season") == holdout_season), "holdout_weeks_1_4"),
    )
    results = (
        parts.withColumn("split", F.explode(splits)).where("split IS NOT NULL").groupBy("model", "split")
        .agg(F.sum("n").alias("rows"), (F.sum("a") / F.sum("n")).alias("mae"))
    )
    return ensemble.change_versus(results, "model", "core", ["split"])


def check_configuration(published: Mapping[str, Sequence[str]], selected: Sequence[str]) -> None:
    """A selected configuration must exist and name exactly the features the code would use."""
    for name in selected:
        if name not in college.CONFIGURATIONS:
            raise ValueError(f"unknown feature configuration: {name}")
        if list(published.get(name, [])) != list(college.CONFIGURATIONS[name]):
            raise ValueError(f"feature schema drift for {name}")


def configuration_drift(published: DataFrame) -> DataFrame:
    """(name, drifted) of every configuration of the code against a published table (name, features); order counts."""
    rows = [(n, list(f)) for n, f in college.CONFIGURATIONS.items()]
    ours = published.sparkSession.createDataFrame(rows, "name string, ours array<string>")  # a handful
    joined = ours.join(published.select("name", F.col("features").alias("theirs")), "name", "left")
    return joined.select("name", F.coalesce(F.col("ours") != F.col("theirs"), F.lit(True)).alias("drifted"))


def publish_features(games: DataFrame, features: Sequence[str], root: str, release: str, *, configurations: DataFrame | None = None) -> dict[str, int]:
    """Publish a feature table if it keeps its contract; returns what was counted while it was written.

    Every row must have every feature, and every published configuration must be the code's. What is counted
    without being enforced are the rows and those without a result. A broken contract publishes nothing.
    """
    ridge.check_features(games, features)
    enforced = {"missing_feature": ~F.expr(ridge.known(features))}
    counted = {"rows": F.lit(True), "missing_result": F.expr("home_margin IS NULL OR total_points IS NULL")}
    if configurations is not None:
        drifted = [r["name"] for r in configuration_drift(configurations).where("drifted").collect()]  # a handful
        if drifted:
            raise ContractError(f"feature schema drift for {', '.join(sorted(drifted))}")
    return publish_checked(games.sparkSession, "features", games, root, release, enforced, counted)
