"""Append-only tables: forecasts, their scores, models, snapshots and published reads.

Every batch is a folder of its own (``run_id=<id>``) that is written once. Spark's committer makes
the folder appear as a whole, and a second write to it fails.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .feeds import _exists
from .releases import publish_together, read_published, releases


def record_batch(
    predictions: DataFrame, root: str, *, run_id: str, created_at: str, model_hash: str,
    data_cutoff: str, prediction_season: int, metadata: dict | None = None,
) -> str:
    """Write one immutable batch; a run id can be used once."""
    target = f"{root}/predictions/run_id={run_id}"
    predictions.withColumns(
        {
            "created_at": F.lit(created_at).cast("timestamp"),
            "model_hash": F.lit(model_hash),
            "data_cutoff": F.lit(data_cutoff),
            "prediction_season": F.lit(prediction_season),
            "metadata": F.lit(json.dumps(metadata or {}, sort_keys=True)),
        }
    ).write.mode("errorifexists").parquet(target)
    return target


def read_batches(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("basePath", f"{root}/predictions").parquet(f"{root}/predictions")


def score_rows(predictions: DataFrame, results: DataFrame) -> DataFrame:
    """Errors of every prediction whose game has a result; optional forecasts stay null.

    Predictions carry ``run_id``, ``game_id``, ``predicted_home_margin``, ``total`` and optionally
    ``football_margin``, ``football_total``, ``market_margin``, ``market_total``.
    """
    done = results.where("home_score IS NOT NULL AND away_score IS NOT NULL").select(
        "game_id",
        (F.col("home_score") - F.col("away_score")).alias("actual_home_margin"),
        (F.col("home_score") + F.col("away_score")).alias("actual_total"),
    )
    joined = predictions.join(done, "game_id")

    def error(column: str, actual: str) -> Column:
        if column not in predictions.columns:
            return F.lit(None).cast("double")
        return F.abs(F.col(column) - F.col(actual))

    return joined.withColumns(
        {
            "margin_absolute_error": error("predicted_home_margin", "actual_home_margin"),
            "total_absolute_error": error("total", "actual_total"),
            "winner_correct": ((F.col("predicted_home_margin") > 0) == (F.col("actual_home_margin") > 0)).cast("double"),
            "football_margin_absolute_error": error("football_margin", "actual_home_margin"),
            "football_total_absolute_error": error("football_total", "actual_total"),
            "market_margin_absolute_error": error("market_margin", "actual_home_margin"),
            "market_total_absolute_error": error("market_total", "actual_total"),
        }
    )


def run_summaries(scored: DataFrame) -> DataFrame:
    """Per run: games, errors and winner accuracy; averages skip missing forecasts."""
    return scored.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("games"),
        F.avg("margin_absolute_error").alias("margin_mae"),
        F.avg("total_absolute_error").alias("total_mae"),
        F.avg("winner_correct").alias("winner_accuracy"),
        F.avg("football_margin_absolute_error").alias("football_margin_mae"),
        F.avg("football_total_absolute_error").alias("football_total_mae"),
        F.count("market_margin_absolute_error").alias("market_games"),
        F.avg("market_margin_absolute_error").alias("market_margin_mae"),
        F.avg("market_total_absolute_error").alias("market_total_mae"),
    )


def unscored_runs(predictions: DataFrame, scored: DataFrame) -> DataFrame:
    """Predictions of runs that have no recorded score yet."""
    return predictions.join(scored.select("run_id").distinct(), "run_id", "left_anti")


def record_scores(spark: SparkSession, root: str, run_id: str, results: DataFrame, scored_at: str) -> str:
    """Score one run, once. An unknown run and a second scoring both fail, also one that runs at the same time."""
    if not _exists(spark, f"{root}/predictions/run_id={run_id}"):
        raise FileNotFoundError(f"unknown prediction run: {run_id}")
    batch = read_batches(spark, root).where(F.col("run_id") == run_id)
    scored = score_rows(batch, results).withColumn("scored_at", F.lit(scored_at).cast("timestamp"))
    return publish_together(spark, {"scores": scored}, f"{root}/results", run_id) + "/scores"


def read_scores(spark: SparkSession, root: str) -> DataFrame:
    """The scores of all runs that have any."""
    return read_published(spark, f"{root}/results", "scores")


def latest_run(batches: DataFrame) -> DataFrame:
    """Newest run and its model hash, one row."""
    return batches.agg(
        F.max_by(F.struct("run_id", "model_hash", "prediction_season"), F.struct("created_at", "run_id")).alias("_r")
    ).select("_r.*")


def check_consistent(batch: DataFrame, pointer: DataFrame) -> DataFrame:
    """The batch a pointer names; fails on the first row whose model hash is another one."""
    named = batch.join(F.broadcast(pointer.select("run_id", F.col("model_hash").alias("_h"))), "run_id")
    same = F.col("model_hash") == F.col("_h")
    bad = F.raise_error(F.concat(F.lit("inconsistent model hash in run "), F.col("run_id")))
    return named.withColumn("model_hash", F.when(same, F.col("model_hash")).otherwise(bad)).drop("_h")


def release_consistency(*tables: DataFrame) -> DataFrame:
    """Whether all tables of a release carry one and the same model hash."""
    hashes = None
    for table in tables:
        part = table.select("model_hash").distinct()
        hashes = part if hashes is None else hashes.unionByName(part)
    return hashes.agg(
        F.countDistinct("model_hash").alias("hashes"), (F.countDistinct("model_hash") == 1).alias("consistent")
    )


def save_snapshot(raw: DataFrame, consensus: DataFrame, root: str, *, request_kind: str, stamp: str) -> str:
    """Raw payload and the consensus drawn from it, visible together; a kind and time of request are saved once."""
    return publish_together(raw.sparkSession, {"raw": raw, "consensus": consensus}, root, f"{request_kind}-{stamp}")


def current_consensus(spark: SparkSession, root: str, request_kind: str) -> DataFrame:
    """The consensus of the latest snapshot of a kind."""
    names = list(releases(spark, root, f"{request_kind}-"))
    if not names:
        raise FileNotFoundError(f"no snapshot of {request_kind}")
    return read_published(spark, root, "consensus", names[-1])


def save_benchmark(matched: DataFrame, report: DataFrame, private: str, release: str) -> str:
    """Matched game-level records and the report made from them, published as one; readers of the report never touch the records."""
    return publish_together(matched.sparkSession, {"matched": matched, "report": report}, private, release)


def distinct_snapshots(snapshots: DataFrame) -> DataFrame:
    """One row per (request kind, snapshot time), the first ingested."""
    from ..operators.history import keep_one

    return keep_one(snapshots, ["request_kind", "snapshot_at"], "ordinal")


def publish(table: DataFrame, root: str, name: str, season: int) -> str:
    """Replace one season of a read table and leave the others alone."""
    target = f"{root}/{name}/prediction_season={season}"
    table.write.mode("overwrite").parquet(target)
    return target


def model_hash(models: DataFrame) -> DataFrame:
    """Registry rows with a digest of everything that defines a model."""
    body = F.to_json(F.struct("model", "target", "features", "intercept", "coefficients", "residual_std"))
    return models.withColumn("sha256", F.sha2(body, 256))


def save_models(models: DataFrame, root: str, version: str) -> str:
    """Write coefficient tables with their digests; a version is written once."""
    target = f"{root}/models/version={version}"
    model_hash(models).write.mode("errorifexists").parquet(target)
    return target


def load_models(spark: SparkSession, root: str, version: str) -> DataFrame:
    """Registry rows whose digest is verified again on read; an altered model fails the job."""
    stored = spark.read.parquet(f"{root}/models/version={version}")
    again = model_hash(stored.drop("sha256")).select("model", F.col("sha256").alias("_now"))
    checked = stored.join(again, "model")
    bad = F.raise_error(F.concat(F.lit("checksum mismatch for model "), F.col("model")))
    return checked.withColumn(
        "sha256", F.when(F.col("sha256") == F.col("_now"), F.col("sha256")).otherwise(bad)
    ).drop("_now")
