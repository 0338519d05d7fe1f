"""Tables that become visible together, and the quote stream that writes through them."""

import threading

import pytest
from pyspark.sql import functions as F

from priorwise.sources import ledger, releases
from priorwise.streaming import quotes


def test_a_failed_second_table_leaves_nothing_visible(spark, tmp_path):
    root, rows = str(tmp_path), spark.range(5)
    broken = rows.select(F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        ledger.save_benchmark(rows, broken, root, "b1")
    assert releases.releases(spark, root) == {}
    with pytest.raises(FileNotFoundError):
        releases.read_published(spark, root, "matched", "b1")
    ledger.save_benchmark(rows, rows.limit(1), root, "b1")
    assert releases.read_published(spark, root, "matched", "b1").count() == 5
    assert releases.read_published(spark, root, "report", start="b").count() == 1


def test_of_two_writers_one_wins(spark, tmp_path):
    root, failures = str(tmp_path), []
    start = threading.Barrier(2)

    def write(k):
        start.wait()
        try:
            releases.publish_together(spark, {"t": spark.range(k)}, root, "r")
        except FileExistsError:
            failures.append(k)

    writers = [threading.Thread(target=write, args=(k,)) for k in (3, 4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert len(failures) == 1 and releases.read_published(spark, root, "t", "r").count() == 7 - failures[0]
    with pytest.raises(FileExistsError):
        releases.publish_together(spark, {"t": spark.range(1)}, root, "r")


def test_a_torn_manifest_does_not_count(spark, tmp_path):
    root = str(tmp_path)
    releases.publish_together(spark, {"t": spark.range(1)}, root, "whole")
    (tmp_path / "_manifests" / "torn.json").write_text('{"release": "torn", "fol')
    assert list(releases.releases(spark, root)) == ["whole"]


def test_snapshots_are_saved_once_and_the_latest_is_current(spark, tmp_path):
    root = str(tmp_path)
    for stamp, n in (("20260102T000000Z", 2), ("20260101T000000Z", 1)):
        ledger.save_snapshot(spark.range(9), spark.range(n), root, request_kind="closing", stamp=stamp)
    assert ledger.current_consensus(spark, root, "closing").count() == 2
    with pytest.raises(FileExistsError):
        ledger.save_snapshot(spark.range(9), spark.range(1), root, request_kind="closing", stamp="20260101T000000Z")
    with pytest.raises(FileNotFoundError):
        ledger.current_consensus(spark, root, "opening")


def test_judged_stream_resumes_and_repeats_nothing(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    kick = spark.createDataFrame([(1, "2026-01-10 18:00:00")], "game_id long, kickoff_at string").withColumn("kickoff_at", F.to_timestamp("kickoff_at"))

    def deliver(rows):
        spark.createDataFrame(rows, "event_id long, game_id long, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("event_id long, game_id long, ts timestamp").parquet(str(source))
        running = quotes.judged_stream(stream, kick, root, str(tmp_path / "state"), unique="event_id")
        running.awaitTermination()
        return sorted((r.event_id, r.verdict) for r in quotes.judged_quotes(spark, root).collect())

    first = deliver([(1, 1, "2026-01-10 17:59:59"), (2, 1, "2026-01-10 18:00:00"), (3, 1, "2026-01-02 17:59:59"), (4, 8, "2026-01-05 00:00:00"), (1, 1, "2026-01-10 17:59:59")])
    assert first == [(1, "valid"), (2, "late"), (3, "stale"), (4, "unknown game")]
    again = deliver([(1, 1, "2026-01-10 17:59:59"), (5, 1, "2026-01-10 17:58:00"), (6, 1, "2026-01-02 18:00:00")])
    # quote 6 comes after the watermark has passed it and is dropped; quote 1 was delivered before
    assert again == sorted([*first, (5, "valid")])
    before = spark.read.text(f"{root}/_manifests").count()
    assert deliver([(7, 1, "2026-01-10 19:00:00")])[-1] == (7, "late") and spark.read.text(f"{root}/_manifests").count() > before


def test_a_broken_contract_publishes_nothing(spark, tmp_path):
    from priorwise.operators import college
    from priorwise.plans import jobs

    root = str(tmp_path)
    games = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, None, 2.0, None), (3, float("nan"), 2.0, 1.0)], "game_id int, a double, home_margin double, total_points double")
    with pytest.raises(releases.ContractError, match="missing_feature': 2"):
        jobs.publish_features(games, ["a"], root, "r")
    assert releases.releases(spark, root) == {}
    whole = games.where("game_id = 1")
    assert jobs.publish_features(whole, ["a"], root, "r") == {"missing_feature": 0, "rows": 1, "missing_result": 0}
    assert releases.read_published(spark, root, "features", "r").count() == 1
    names = {n: list(f) for n, f in college.CONFIGURATIONS.items()}
    first = next(iter(names))
    names[first] = names[first][::-1]
    table = spark.createDataFrame(list(names.items()), "name string, features array<string>")
    with pytest.raises(releases.ContractError, match=first):
        jobs.publish_features(whole, ["a"], root, "s", configurations=table)
    with pytest.raises(ValueError, match="missing features"):
        jobs.publish_features(whole, ["b"], root, "s")


def test_landed_history_counts_broken_lines(spark, tmp_path):
    from priorwise.sources import college as feeds

    for season, lines in ((2001, ['{"ordinal": 1, "record": {"id": 5, "season": 2001, "homePoints": 3}}', '{"ordinal": 2, "rec', '{"record": {"id": 6}}', "", "[1]"]), (2003, ['{"ordinal": 1, "record": {"id": 5, "season": 2003}}'])):
        folder = tmp_path / "games" / f"season={season}"
        folder.mkdir(parents=True)
        (folder / "part.txt").write_text("\n".join(lines))
    frames, counts = feeds.read_history(spark, str(tmp_path), [2001, 2002, 2003], required=("games",))
    assert [(r.game_id, r.season) for r in frames["games"].collect()] == [(5, 2001)]  # the first record of an id stays
    assert frames["lines"].isEmpty() and "market_total" in frames["lines"].columns
    assert sorted((r.feed, r.season, r.lines, r.broken) for r in counts.collect()) == [("games", 2001, 4, 3), ("games", 2003, 1, 0)]
    with pytest.raises(ValueError, match="advanced"):
        feeds.read_history(spark, str(tmp_path), [2001])
