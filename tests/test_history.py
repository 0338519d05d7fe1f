import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorwise.operators import history


def brute(values):
    clean = [v for v in values if v is not None]
    if not clean:
        return None
    w = np.exp(np.linspace(-1.0, 0.0, len(clean)))
    return float(np.average(clean, weights=w))


def test_rolling_equals_brute_force_with_and_without_blocks(spark):
    rng = random.Random(3)
    rows = []
    for n in range(900):
        key = 1 if n % 3 else rng.randrange(2, 20)  # one key owns most rows
        rows.append((key, n // 25, n, None if rng.random() < 0.2 else rng.random()))
    df = spark.createDataFrame(rows, "player_id int, day int, game_id int, x double")
    plain = history.shifted_rolling(df, ["x"], order=("day", "game_id"))
    blocked = history.shifted_rolling(df, ["x"], order=("day", "game_id"), block=F.col("day"))
    got = {r.game_id: (r.x_l4, r.x_l8) for r in blocked.collect()}
    assert got == {r.game_id: (r.x_l4, r.x_l8) for r in plain.collect()}
    seen: dict[int, list] = {}
    for key, _, game, x in rows:
        past = seen.setdefault(key, [])
        for mine, k in zip(got[game], (4, 8), strict=True):
            want = brute(past[-k:])
            assert (mine is None and want is None) or mine == pytest.approx(want, abs=1e-12)
        past.append(x)


def test_rolling_in_batches_equals_the_window_of_arrays(spark):
    """Batches end inside a key, and values, keys and order columns are missing, infinite or repeated."""
    rng = random.Random(4)
    odd = [None, float("nan"), float("inf"), float("-inf"), -0.0, 1e300]
    rows = [(rng.choice([None, "a", "b", *[f"k{n}" for n in range(30)]]), rng.choice([None, n // 9]), n, rng.choice([*odd, *[rng.random() for _ in range(9)]]), rng.choice([None, n]), "kept", None) for n in range(700)]
    df = spark.createDataFrame(rows, "who string, day int, game_id int, x double, y long, note string, x_l8 double")
    held = history.attach_recent(df, keys=["who"], order=["day", "game_id"], fact=F.struct("x", F.col("y").cast("double").alias("y")), k=8, out="_r")
    last = {8: F.col("_r"), 3: history.last_items(F.col("_r"), 3)}
    want = held.withColumns({f"{s}_l{k}": history.recency_weighted_mean(a[s]) for k, a in last.items() for s in ("x", "y")}).drop("_r")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = history.shifted_rolling(df, ["x", "y"], key="who", order=("day", "game_id"), windows=(3, 8))
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = {r.game_id: r.asDict() for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "MapInArrow" in plan and "collect_list" not in plan and got.columns[:7] == df.columns
    assert {k: repr(sorted(r.items())) for k, r in rows.items()} == {r.game_id: repr(sorted(r.asDict().items())) for r in want.collect()}


def test_rank_is_exact_across_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 100003).alias("o"), (F.col("id") % 3).alias("g"))
    ranked = history.rank_in_group(df, group=["g"], order="o", out="rk", width=97).collect()
    for g in range(3):
        mine = sorted((r.o, r.rk) for r in ranked if r.g == g)
        assert [rk for _, rk in mine] == list(range(1, len(mine) + 1))


def test_keep_one_by_ordinal(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 2, None)], "k int, o int, v string")
    assert {r.k: r.v for r in history.keep_one(df, ["k"], "o").collect()} == {1: "a", 2: None}
    assert {r.k: r.v for r in history.keep_one(df, ["k"], "o", keep="last").collect()} == {1: "c", 2: None}
    assert math.isclose(1.0, 1.0)
