"""Form and rest of college teams against a plain loop."""

from pyspark.sql import functions as F

from priorwise.operators import college


def rows(spark, n=900):
    """Team games with gaps: unplayed games, missing seasons, kickoffs and measures, teams that never played, no team."""
    k = F.col("id")
    values = [F.when(k % (101 + i) != 5, F.sin(k * (i + 1.3)) * 10).alias(c) for i, c in enumerate(college.FORM_PRIORS)]
    return spark.range(n).select(
        k.alias("game_id"), F.when(k % 2 == 0, "home").otherwise("away").alias("side"),
        F.when(k == 7, None).when(k % 53 == 0, "none").otherwise(F.concat(F.lit("T"), k % 5)).alias("team"),
        F.when(k % 97 == 0, None).otherwise((1990 + k / 200).cast("int")).alias("season"), F.floor(k % 200 / 20).cast("int").alias("week"),
        F.when(k % 89 == 0, None).otherwise((F.lit(1e9) + k * 50000.25).cast("timestamp")).alias("start_date"),
        F.when(k % 53 == 0, False).when(k % 31 == 0, None).otherwise(k % 7 != 3).alias("completed"), *values,
    )


def plain(schedule):
    """(rest_days, form...) by game of one team's rows."""
    least = (float("-inf"),)
    key = lambda r: [(x,) if x is not None else least for x in (r.season, r.week, r.start, r.game_id)]
    out, facts, last = {}, [], None
    for r in sorted(schedule, key=key):
        days = (r.start // 10**6 - last // 10**6) // 86400 if r.start is not None and last is not None else 4
        held = facts[-6:]
        weights = [(i + 1.0) / len(held) * (1.0 if f.season == r.season and f.season is not None else 0.35) for i, f in enumerate(held)]
        form = []
        for name, prior in college.FORM_PRIORS.items():
            some = all(f[name] is not None for f in held)
            form.append((3 * prior + sum(f[name] * w for f, w in zip(held, weights, strict=True))) / (3 + sum(weights)) if some else None)
        out[r.game_id] = [float(min(max(days, 4), 28)), *form]
        last = r.start
        if r.completed:
            facts.append(r)
    return out


def test_form_is_that_of_a_plain_loop(spark):
    made = rows(spark).cache()
    teams = {}
    for r in made.withColumn("start", F.unix_micros("start_date")).collect():
        teams.setdefault(r.team, []).append(r)
    want = {g: v for schedule in teams.values() for g, v in plain(schedule).items()}
    got = {r.game_id: [r.rest_days, *[r[f"{k}_l6"] for k in college.FORM_PRIORS]] for r in college.form_state(made).collect()}
    assert got.keys() == want.keys() and len(got) == 900
    for game, expected in want.items():
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(expected, got[game], strict=True)), game


def test_form_needs_no_windows_of_lists(spark):
    plan = college.form_state(rows(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "collect_list" not in plan
