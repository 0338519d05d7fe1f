"""Forecast evaluation: errors, calibration, blends and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import Z80, clip, finite_or_null, normal_cdf
from ..session import cut_lineage

GRID = 101
# How far model and market may be apart, per bucket; the last is open.
DISAGREEMENT = (("under_2", 0.0, 2.0), ("2_to_4", 2.0, 4.0), ("4_to_7", 4.0, 7.0), ("7_plus", 7.0, None))


def error_metrics(actual: Column, predicted: Column, where: Column | None = None) -> dict[str, Column]:
    """Rows, MAE, RMSE and bias over the pairs where both numbers are finite; null when none is."""
    error = finite_or_null(predicted) - finite_or_null(actual)
    if where is not None:
        error = F.when(where, error)
    return {
        "rows": F.count(error),
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "bias": F.avg(error),
    }


def metrics_by(df: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        *[c.alias(n) for n, c in error_metrics(F.col(actual), F.col(predicted)).items()]
    )


def split_metrics(
    df: DataFrame, actual: str, predicted: str, *, holdout_season: int, early_weeks: int = 4
) -> DataFrame:
    """All / development / holdout / early weeks / per season, in one pass over the rows.

    Every row is aggregated once by (season, early); the splits are sums over that small result.
    """
    error = finite_or_null(F.col(predicted)) - finite_or_null(F.col(actual))
    base = (
        df.withColumn("_e", error)
        .groupBy("season", (F.col("week") <= early_weeks).alias("early"))
        .agg(
            F.count("_e").alias("n"),
            F.sum(F.abs("_e")).alias("a"),
            F.sum(F.col("_e") * F.col("_e")).alias("q"),
            F.sum("_e").alias("s"),
        )
    )
    develop, held = F.col("season") < holdout_season, F.col("season") == holdout_season
    splits = F.array(
        F.lit("all_oof"),
        F.when(develop, "development"),
        F.when(held, "holdout"),
        F.when(F.col("early"), "weeks_1_4"),
        F.when(F.col("early") & develop, "development_weeks_1_4"),
        F.when(F.col("early") & held, "holdout_weeks_1_4"),
        F.concat(F.lit("season_"), F.col("season")),
        F.when(F.col("early"), F.concat(F.lit("weeks_1_4_season_"), F.col("season"))),
    )
    return (
        base.withColumn("split", F.explode(splits))
        .where("split IS NOT NULL")
        .groupBy("split")
        .agg(
            F.sum("n").alias("rows"),
            F.try_divide(F.sum("a"), F.sum("n")).alias("mae"),
            F.sqrt(F.try_divide(F.sum("q"), F.sum("n"))).alias("rmse"),
            F.try_divide(F.sum("s"), F.sum("n")).alias("bias"),
        )
    )


def variant_mae_by_season(df: DataFrame, actual: str, variants: dict[str, str]) -> DataFrame:
    return df.groupBy("season").agg(
        F.count(F.lit(1)).alias("games"),
        *[F.avg(F.abs(F.col(c) - F.col(actual))).alias(f"{n}_mae") for n, c in variants.items()],
    )


def interval_metrics(actual: Column, predicted: Column, std: Column) -> dict[str, Column]:
    """Coverage of the 80 percent interval and pinball loss of its two edges."""
    low, high = predicted - Z80 * std, predicted + Z80 * std

    def pinball(q: float, edge: Column) -> Column:
        gap = actual - edge
        return F.avg(F.greatest(q * gap, (q - 1.0) * gap))

    inside = F.when((actual >= low) & (actual <= high), 1.0).otherwise(0.0)
    return {
        "interval_80_coverage": F.avg(inside),
        "pinball_p10": pinball(0.10, low),
        "pinball_p90": pinball(0.90, high),
    }


def probability_metrics(probability: Column, outcome: Column) -> dict[str, Column]:
    p = clip(probability, 1e-6, 1.0 - 1e-6)
    return {
        "brier": F.avg((probability - outcome) * (probability - outcome)),
        "log_loss": -F.avg(outcome * F.log(p) + (1.0 - outcome) * F.log(1.0 - p)),
    }


def calibration_error(df: DataFrame, probability: str, outcome: str, bins: int = 10) -> DataFrame:
    """Expected calibration error: bin by probability (last bin closed), weigh gaps by bin size."""
    slot = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1))
    per_bin = df.groupBy(slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(probability).alias("p"), F.avg(outcome).alias("o")
    )
    return per_bin.agg(
        (F.sum(F.col("n") * F.abs(F.col("p") - F.col("o"))) / F.sum("n")).alias("calibration_error"),
        F.sum("n").alias("rows"),
    )


def disagreement_buckets(
    df: DataFrame, actual: str = "actual_home_margin", model: str = "independent_home_margin",
    market: str = "market_home_margin",
) -> DataFrame:
    """Against-the-spread record by how far model and market differ; empty buckets stay in."""
    spark = df.sparkSession
    names = spark.createDataFrame([(n,) for n, _, _ in DISAGREEMENT], "bucket string")
    gap = F.col(model) - F.col(market)
    label = F.lit(None)
    for name, low, high in reversed(DISAGREEMENT):
        inside = F.abs(gap) >= low if high is None else (F.abs(gap) >= low) & (F.abs(gap) < high)
        label = F.when(inside, F.lit(name)).otherwise(label)
    result = F.signum(F.col(actual) - F.col(market)) * F.signum(gap)
    won = F.when(result != 0, (result > 0).cast("double"))
    found = df.groupBy(label.alias("bucket")).agg(
        F.count(F.lit(1)).alias("games"),
        F.count(won).alias("ats_decisions"),
        F.avg(won).alias("ats_win_rate"),
        F.avg(F.abs(F.col(model) - F.col(actual))).alias("independent_margin_mae"),
        F.avg(F.abs(F.col(market) - F.col(actual))).alias("market_margin_mae"),
    )
    return names.join(found, "bucket", "left").fillna(0, ["games", "ats_decisions"])


def _grid_task(keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    weights = np.arange(GRID) / float(GRID - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple, list] = {}
        for batch in batches:
            actual, first, second = batch[["_a", "_f", "_s"]].to_numpy(dtype=float).T[:, :, None]
            errors = np.nan_to_num(np.abs(actual - (weights * first + (1.0 - weights) * second)))
            groups = batch.groupby(keys, sort=False).indices if keys else {(): np.arange(len(batch))}
            for key, index in groups.items():
                total = totals.setdefault(key if isinstance(key, tuple) else (key,), [0, np.zeros(GRID)])
                total[0] += len(index)
                total[1] += errors[index].sum(axis=0)
        if totals:
            yield pd.DataFrame([{**dict(zip(keys, key, strict=True)), "n": n, "err": e} for key, (n, e) in totals.items()])

    return run


def _grid_errors(df: DataFrame, keys: Sequence[str], actual: str, first: str, second: str) -> DataFrame:
    """Summed absolute error of every grid weight per key, long form; keys must not be null, rows with a null forecast add nothing.

    Each task reckons all weights of its rows at once and gives one row of sums per key.
    """
    columns = [F.col(c).cast("double").alias(n) for c, n in ((actual, "_a"), (first, "_f"), (second, "_s"))]
    rows = df.select(*keys, *columns)
    kinds = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)]), "n bigint", "err array<double>"])
    parts = rows.mapInPandas(_grid_task(list(keys)), kinds).select(*keys, "n", F.posexplode("err").alias("i", "err"))
    return parts.groupBy(*keys, (F.col("i") / float(GRID - 1)).alias("w")).agg(F.sum("err").alias("err"), F.sum("n").alias("n"))


def _best(error: str) -> Column:
    # Sums of the same errors in another order differ in the last bits; ties must not depend on it.
    return F.min_by("w", F.struct(F.round(error, 6), F.col("w")))


def mae_weight(df: DataFrame, actual: str, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """Convex weight of ``first`` with the lowest MAE on a 101-point grid, for each group; lowest weight wins ties."""
    chosen = _grid_errors(df, by, actual, first, second).groupBy(*by).agg(_best("err").alias("weight"))
    return chosen.select(*by, F.coalesce("weight", F.lit(0.5)).alias("weight"))


def least_squares_weight(df: DataFrame, actual: str, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """Closed-form convex weight of ``first``, clipped to 0..1, for each group; one half where the two coincide."""
    gap = F.col(first) - F.col(second)
    sums = df.groupBy(*by).agg(
        F.sum(gap * gap).alias("d"), F.sum(gap * (F.col(actual) - F.col(second))).alias("x")
    )
    return sums.select(
        *by, F.when(F.col("d") > 1e-12, clip(F.col("x") / F.col("d"), 0.0, 1.0)).otherwise(0.5).alias("weight")
    )


def prequential_weights(
    df: DataFrame, actual: str, first: str, second: str, *, min_rows: int = 64, by: Sequence[str] = ()
) -> DataFrame:
    """Per (season, week), and group, the best grid weight over all earlier weeks only.

    Cumulative errors run over weeks x 101 aggregated rows, one window partition per weight.
    """
    order = (
        Window.partitionBy(*by, "w")
        .orderBy("season", "week")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    errors = _grid_errors(df, [*by, "season", "week"], actual, first, second).withColumns(
        {"before": F.sum("err").over(order), "rows_before": F.sum("n").over(order)}
    )
    chosen = errors.groupBy(*by, "season", "week").agg(
        _best("before").alias("best"), F.max("rows_before").alias("rows_before")
    )
    enough = F.col("rows_before") >= min_rows
    return chosen.select(
        *by, "season", "week", F.when(enough, F.col("best")).otherwise(0.5).alias("weight")
    )


def prequential_blend(
    df: DataFrame, actual: str, first: str, second: str, *, out: str, weight: str, min_rows: int = 64, by: Sequence[str] = ()
) -> DataFrame:
    """Blend of two forecasts with the prequential weight of each row's week."""
    weights = prequential_weights(df, actual, first, second, min_rows=min_rows, by=by)
    joined = df.join(F.broadcast(weights.withColumnRenamed("weight", weight)), [*by, "season", "week"])  # one row per week
    return joined.withColumn(
        out, F.col(weight) * F.col(first) + (1.0 - F.col(weight)) * F.col(second)
    )


def market_blends(df: DataFrame, *, min_rows: int = 64) -> DataFrame:
    """Walk-forward blend of market and independent forecast, for margin and total."""
    margin = prequential_blend(
        df, "actual_home_margin", "market_home_margin", "independent_home_margin",
        out="blended_margin", weight="market_margin_weight", min_rows=min_rows,
    )
    return prequential_blend(
        margin, "actual_total_points", "market_total", "independent_total",
        out="blended_total", weight="market_total_weight", min_rows=min_rows,
    )


def snapshot_audit(df: DataFrame, kickoff: Column, snapshot: Column) -> DataFrame:
    """Lead time of the snapshots and violations of time order and spread sign."""
    lead = (kickoff.cast("double") - snapshot.cast("double")) / 60.0
    sign = F.abs(F.col("market_home_spread") + F.col("market_home_margin"))
    return df.agg(
        F.sum(F.when(lead <= 0, 1).otherwise(0)).alias("timestamp_violations"),
        F.sum(F.when(sign > 1e-9, 1).otherwise(0)).alias("spread_sign_violations"),
        F.min(lead).alias("minimum_lead_minutes"),
        F.max(lead).alias("maximum_lead_minutes"),
    )


def aggregate_report(df: DataFrame) -> DataFrame:
    """The publishable report as (section, item, metric, value): no game rows leave."""
    blended = df = cut_lineage(market_blends(df))  # every section reads it
    margin, total = "actual_home_margin", "actual_total_points"
    variants = {
        "independent_margin": (margin, "independent_home_margin"),
        "market_margin": (margin, "market_home_margin"),
        "walk_forward_blended_margin": (margin, "blended_margin"),
        "independent_total": (total, "independent_total"),
        "market_total": (total, "market_total"),
        "walk_forward_blended_total": (total, "blended_total"),
    }
    parts = []
    for name, (actual, predicted) in variants.items():
        m = error_metrics(F.col(actual), F.col(predicted))
        for metric in ("mae", "rmse", "bias"):
            parts.append((name, metric, m[metric]))
    parts += [
        ("all", "games", F.count(F.lit(1)).cast("double")),
        ("all", "average_books", F.avg("book_count")),
        ("latest", "market_margin_weight", F.max_by("market_margin_weight", F.struct("season", "week"))),
        ("latest", "market_total_weight", F.max_by("market_total_weight", F.struct("season", "week"))),
    ]

    def item(section: str, name: str, metric: str, value: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"),
            F.lit(name).alias("item"),
            F.lit(metric).alias("metric"),
            value.cast("double").alias("value"),
        )

    overall = blended.agg(
        F.array(*[item("variant" if n in variants else "summary", n, m, v) for n, m, v in parts]).alias("r")
    ).select(F.inline("r"))
    seasons = variant_mae_by_season(
        blended, margin,
        {"independent": "independent_home_margin", "market": "market_home_margin", "blended": "blended_margin"},
    )
    by_season = _unpivot(seasons, "by_season", F.col("season").cast("string"), "season")
    buckets = _unpivot(disagreement_buckets(blended), "disagreement", F.col("bucket"), "bucket")
    future = [
        mae_weight(df, a, m, i).select(F.inline(F.array(item("future_weight", n, "market_weight", F.col("weight")))))
        for n, a, m, i in (
            ("margin", margin, "market_home_margin", "independent_home_margin"),
            ("total", total, "market_total", "independent_total"),
        )
    ]
    out = overall.unionByName(by_season).unionByName(buckets)
    for part in future:
        out = out.unionByName(part)
    return out


def _unpivot(df: DataFrame, section: str, item: Column, key: str) -> DataFrame:
    values = [c for c in df.columns if c != key]
    entries = [
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values
    ]
    return df.select(
        F.lit(section).alias("section"), item.alias("item"), F.inline(F.array(*entries))
    )


def forecast_distribution(df: DataFrame, mean: str, std: Column) -> DataFrame:
    """Mean, deviation, 10th and 90th percentile and the probability of a positive outcome."""
    sigma = F.greatest(std, F.lit(1e-6))
    return df.withColumns(
        {
            "std": sigma,
            "p10": F.col(mean) - Z80 * sigma,
            "p90": F.col(mean) + Z80 * sigma,
            "probability_above_zero": normal_cdf(F.col(mean) / sigma),
        }
    )
