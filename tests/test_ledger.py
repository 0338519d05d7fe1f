import pytest

from priorwise.sources import feeds, ledger


@pytest.fixture()
def batch(spark):
    return spark.createDataFrame([(1, 3.0, 44.0), (2, -1.0, 40.0)], "game_id int, predicted_home_margin double, total double")


def record(batch, root, run):
    return ledger.record_batch(
        batch, root, run_id=run, created_at="2026-01-01 00:00:00", model_hash="h", data_cutoff="2025-12-31", prediction_season=2026
    )


def test_batches_are_written_and_scored_once(spark, batch, tmp_path):
    root = str(tmp_path / "ledger")
    record(batch, root, "r1")
    with pytest.raises(Exception, match="(?i)already exists"):
        record(batch, root, "r1")
    results = spark.createDataFrame([(1, 20.0, 10.0), (2, None, None)], "game_id int, home_score double, away_score double")
    path = ledger.record_scores(spark, root, "r1", results, "2026-01-08 00:00:00")
    assert [r.margin_absolute_error for r in spark.read.parquet(path).collect()] == [7.0]
    with pytest.raises(FileExistsError):
        ledger.record_scores(spark, root, "r1", results, "2026-01-09 00:00:00")
    with pytest.raises(FileNotFoundError):
        ledger.record_scores(spark, root, "nope", results, "2026-01-09 00:00:00")


def test_tampered_models_fail_on_read(spark, tmp_path):
    models = spark.createDataFrame(
        [("m", "t", ["a"], 1.0, [2.0], 3.0)],
        "model string, target string, features array<string>, intercept double, coefficients array<double>, residual_std double",
    )
    root = str(tmp_path / "registry")
    ledger.save_models(models, root, "v1")
    assert ledger.load_models(spark, root, "v1").first().intercept == 1.0
    ledger.model_hash(models).selectExpr("* EXCEPT (intercept)", "9D AS intercept").write.parquet(f"{root}/models/version=v2")
    with pytest.raises(Exception, match="checksum mismatch"):
        ledger.load_models(spark, root, "v2").collect()


def test_feeds(spark, tmp_path):
    root = str(tmp_path / "feed")
    spark.range(3).write.parquet(f"{root}/season=2024")
    frame = feeds.read_seasons(spark, root, [2023, 2024], "id long")
    assert [(r.season, r.id) for r in frame.orderBy("id").collect()] == [(2024, 0), (2024, 1), (2024, 2)]
    assert feeds.read_seasons(spark, root, [1999], "id long").count() == 0
    with pytest.raises(ValueError):
        feeds.require_rows({"plays": frame.limit(0)}, ["plays"])
    a = feeds.fingerprint({"f": (frame, ["id"])}).first().digest
    assert a == feeds.fingerprint({"f": (frame.orderBy("id", ascending=False).repartition(3), ["id"])}).first().digest
    assert a != feeds.fingerprint({"f": (frame.where("id > 0"), ["id"])}).first().digest


def test_fingerprint_sees_values_that_move_between_nullable_columns(spark):
    kind = "a double, b double"
    one, two = spark.createDataFrame([(None, 7.0)], kind), spark.createDataFrame([(7.0, None)], kind)
    digests = [feeds.fingerprint({"f": (df, ["a", "b"])}).first().digest for df in (one, two)]
    assert digests[0] != digests[1]
