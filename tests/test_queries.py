"""A sample of registered queries against their SQL; ``python tests/compare.py`` runs them all."""

import pytest
from compare import TESTDATA, checker, differences

from priorwise.plans.catalog import REGISTRY

SAMPLE = [
    "c01_game_team_summary",
    "d05_league_priors",
    "d16_shifted_rolling",
    "e11_attach_consensus",
    "e07_roster_continuity",
    "a11_normalize_lines",
    "f01_build_consensus",
    "h07_disagreement_buckets",
    "d12_d13_elo_ratings",
    "f14_schedule_power_ratings",
    "t01_windowed_consensus_stream",
]
FOLDER = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return checker(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, con, name):
    rows, messages, *_ = differences(spark, con, REGISTRY[name], FOLDER)
    assert not messages and rows > 0


def test_every_sql_text_builds():
    assert len(REGISTRY) > 100
    assert all(q.sql is None or q.sql.startswith("WITH RECURSIVE") for q in REGISTRY.values())
