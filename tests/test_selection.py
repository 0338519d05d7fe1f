"""Medians by counting and groups of connected rows."""

import random
from collections import defaultdict
from statistics import median

import pytest

from priorwise.operators.selection import connected_groups, exact_medians


@pytest.mark.parametrize("cells", [2, 7, 1024])
def test_medians_are_exact(spark, cells):
    r = random.Random(cells)
    rows = [(s, r.choice([None, float("nan"), r.gauss(0, 1), r.gauss(0, 1e-9), -0.0, 5.0, 5.0, 1e300, -1e300]), float(r.randint(0, 3))) for s in (1, 1, 1, 2, 3) for _ in range(60)]
    rows += [(4, None, 1.0), (5, 2.5, None), (6, 1.7e308, 1.0), (6, -1.7e308, 4.0), (None, 1.0, 2.0)]
    want = defaultdict(list)
    for s, *values in rows:
        for c, v in zip("xy", values, strict=True):
            if v is not None and v == v:
                want[s, c].append(v)
    df = spark.createDataFrame(rows, "season int, x double, y double").repartition(4)
    got = {(x.season, x.column): x.median for x in exact_medians(df, ["season"], ["x", "y"], cells).collect()}
    assert {k: v for k, v in got.items() if k[0] is not None} == {k: median(v) for k, v in want.items() if k[0] is not None}


def test_medians_of_an_empty_table(spark):
    assert exact_medians(spark.createDataFrame([], "season int, x double"), ["season"], ["x"]).isEmpty()


def test_groups_of_a_schedule(spark):
    r = random.Random(2)
    chain = [(k, k + 1) for k in range(100, 140)]
    rows = chain + [(7, 3), (3, 9), (9, 9), (50, 50), (None, 4), (4, None), (3, 7)]
    r.shuffle(rows)
    got = {x.member: x.group for x in connected_groups(spark.createDataFrame(rows, "home long, away long"), "home", "away").collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, 3: 3, 7: 3, 9: 3, 50: 50}
    assert connected_groups(spark.createDataFrame([], "home long, away long"), "home", "away").isEmpty()
