"""Boosted trees from summed histograms against a plain loop over rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorwise.operators import boosting
from priorwise.operators.boosting import CELLS, HUBER, Profile
from priorwise.operators.ridge import complete_rows


def games(spark, n=260, seed=3, parts=5):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 3)), 2)
    a = 3 * x[:, 0] + np.where(x[:, 1] > 0.3, 4.0, -1.0) * (x[:, 2] > 0) + r.standard_t(2, n)
    b = 40 + 5 * np.abs(x[:, 1]) + r.normal(size=n)
    season = np.sort(r.integers(2000, 2005, n))
    rows = [(k, int(season[k]), 1 + k % 9, *map(float, x[k]), float(a[k]), None if k % 17 == 0 else float(b[k])) for k in range(n)]
    rows += [(n, 2003, 1, None, 0.0, 0.0, 1.0, 1.0), (n + 1, 2001, 2, float("nan"), 0.0, 0.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "game long, season int, week int, f1 double, f2 double, f3 double, a double, b double").repartition(parts)


def plain_forecast(rows, features, target, season, profile, edges):
    """Trees grown on the rows before a season by scanning rows, then applied to the season."""
    train = [r for r in rows if r["season"] < season and r[target] is not None]
    test = [r for r in rows if r["season"] == season]
    y = np.array([r[target] for r in train])
    keys = np.array([r["key"] for r in train], dtype=np.int64).view(np.uint64)
    cut = lambda rs: np.array([[sum(e < r[f] for e in edges[k]) for k, f in enumerate(features)] for r in rs]).reshape(len(rs), len(features))
    xb, tb = cut(train), cut(test)
    low, high = y.min(), y.max()
    span = max(high - low, 1e-9)
    score, out = np.full(len(y), (low + high) / 2), np.full(len(test), (low + high) / 2)
    bound = span

    def cells(res):
        k = np.clip(((res / span + 1) * (CELLS / 2)).astype(int), 0, CELLS - 1)
        rows_, sums = np.zeros(CELLS), np.zeros(CELLS)
        for i, v in zip(k, res, strict=True):
            rows_[i] += 1
            sums[i] += v
        return rows_, sums

    def value(res, loss):
        if not len(res):
            return 0.0
        if loss == "squared":
            return float(np.mean(res))
        n, s = cells(res)
        k, before = 0, 0.0
        while before + n[k] < len(res) / 2:
            before += n[k]
            k += 1
        middle = (k + (len(res) / 2 - before) / n[k]) * 2 * span / CELLS - span
        if loss == "absolute":
            return middle
        return middle + sum(n[i] * np.clip(s[i] / n[i] - middle, -bound, bound) for i in range(CELLS) if n[i]) / len(res)

    def split(at, pulls):
        best = None
        for f in range(len(features)):
            for b in range(boosting.BINS):
                left = at & (xb[:, f] <= b)
                n, m = left.sum(), at.sum()
                if n < profile.min_leaf or m - n < profile.min_leaf:
                    continue
                g, t, p = pulls[left].sum(), pulls[at].sum(), profile.penalty
                gain = g * g / (n + p) + (t - g) ** 2 / (m - n + p) - t * t / (m + p)
                if gain > 1e-9 * max(1.0, t * t / (m + p)) and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = (gain, f, b)
        return best

    for turn in range(-1, profile.rounds):
        bag = boosting.sampled(keys, profile.sample, turn)
        res = y - score
        pulls = res if profile.loss == "squared" else np.sign(res) if profile.loss == "absolute" else np.clip(res, -bound, bound)
        tree, leaves, fresh = {}, [0], [0]
        member, member_t = {0: np.ones(len(y), bool)}, {0: np.ones(len(test), bool)}
        for level in range(profile.depth if turn >= 0 else 0):
            found = [(split(member[n] & bag, pulls), n) for n in fresh]
            found = sorted((-s[0], n, s[1], s[2]) for s, n in found if s)
            fresh = []
            for _, n, f, b in found[: (profile.leaves or 2**profile.depth) - len(leaves)]:
                for side, right in ((2 * n + 1, False), (2 * n + 2, True)):
                    member[side] = member[n] & ((xb[:, f] > b) == right)
                    member_t[side] = member_t[n] & ((tb[:, f] > b) == right)
                    fresh.append(side)
                leaves.remove(n)
                tree[n] = (f, b)
            leaves += fresh
        loss = "absolute" if turn < 0 and profile.loss == "huber" else profile.loss
        moved = np.zeros(len(y))
        sizes = []
        for n in leaves:
            v = value(res[member[n] & bag], loss) * (profile.rate if turn >= 0 else 1)
            moved[member[n]] += v
            out[member_t[n]] += v
            count, sums = cells(res[member[n]])
            sizes += [(abs(s / c - v), c) for c, s in zip(count, sums, strict=True) if c]
        score = score + moved
        total = 0.0
        for size, c in sorted(sizes):
            total += c
            if total >= HUBER * len(y):
                bound = size
                break
    return dict(zip([r["game"] for r in test], out.tolist(), strict=True))


PROFILES = {
    "huber": Profile(7, 2, 0.3, 5, 0.8),
    "stumps": Profile(9, 1, 0.2, 8, 0.7, "squared"),
    "absolute": Profile(6, 3, 0.4, 4, 1.0, "absolute", leaves=5, penalty=2.0),
}


MODELS = {"a": (["f1", "f2", "f3"], "a"), "b": (["f2", "f1"], "b")}
ONE = {"a": MODELS["a"]}


def test_growth_equals_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(boosting, "STORED", 3)
    monkeypatch.setattr(boosting, "TO_DRIVER", 2)
    monkeypatch.setattr(boosting, "SLOT", 64)
    df, features = games(spark), ["f1", "f2", "f3"]
    got = boosting.boosted_oof(df, MODELS, PROFILES, keep=["game"], min_rows=60).collect()
    keyed = df.withColumn("key", F.xxhash64(F.col("game").cast("string")))
    edges = dict(zip(features, boosting.bin_edges(df, features, 2000), strict=True))
    seen = set()
    for name, profile in PROFILES.items():
        for target, (own, _) in MODELS.items():
            rows = [r.asDict() for r in complete_rows(keyed, own).collect()]
            for season in (2002, 2003, 2004):
                mine = {r.game: r.tree_prediction for r in got if (r.profile, r.model, r.season) == (name, target, season)}
                want = plain_forecast(rows, own, target, season, profile, [edges[f] for f in own])
                assert mine.keys() == want.keys() and mine and max(abs(mine[g] - want[g]) for g in want) < 1e-9
                seen |= {(name, target, season)}
    assert {(r.profile, r.model, r.season) for r in got} - seen <= {(p, t, 2001) for p in PROFILES for t in "ab"}


def test_later_rows_never_change_earlier_forecasts(spark):
    df = games(spark)
    changed = df.withColumn("a", F.when(F.col("season") >= 2003, F.col("a") * 50 + 7).otherwise(F.col("a")))
    changed = changed.withColumn("f1", F.when(F.col("season") >= 2004, F.col("f1") + 9).otherwise(F.col("f1")))
    one = {"huber": PROFILES["huber"]}
    run = lambda d: {(r.game, r.model): r.tree_prediction for r in boosting.boosted_oof(d, ONE, one, keep=["game"], min_rows=40).where("season <= 2003").collect()}
    first, second = run(df), run(changed.repartition(3))
    assert first.keys() == second.keys() and all(abs(first[k] - second[k]) < 1e-9 for k in first) and first


def test_a_season_without_results_is_forecast_and_little_data_gives_nothing(spark):
    df = games(spark)
    ahead = df.where("season = 2004").withColumn("a", F.lit(None).cast("double")).withColumn("season", F.lit(2005))
    got = boosting.boosted_oof(df.unionByName(ahead), ONE, {"h": PROFILES["huber"]}, keep=["game"], seasons=[2005], min_rows=40)
    assert got.count() == complete_rows(ahead, ["f1", "f2", "f3"]).count() and got.where("tree_prediction IS NULL OR actual IS NOT NULL").isEmpty()
    none = boosting.boosted_oof(df, ONE, PROFILES, keep=["game"], min_rows=10**6)
    assert none.columns == ["game", "season", "week", "model", "profile", "actual", "tree_prediction"] and none.isEmpty()


@pytest.mark.parametrize("loss", ["squared", "absolute", "huber"])
def test_leaf_values(loss):
    r = np.random.default_rng(5)
    residual = r.normal(size=4000)
    cell = np.clip(((residual / 8 + 1) * (CELLS / 2)).astype(int), 0, CELLS - 1)
    rows, sums = np.bincount(cell, minlength=CELLS).astype(float), np.bincount(cell, residual, minlength=CELLS)
    exact = {"squared": residual.mean(), "absolute": np.median(residual), "huber": np.median(residual) + np.clip(residual - np.median(residual), -1, 1).mean()}
    assert abs(boosting.leaf_value(rows, sums, loss, 8.0, 1.0) - exact[loss]) < 8 / CELLS
    assert boosting.leaf_value(rows * 0, sums * 0, loss, 8.0, 1.0) == 0.0


def test_a_round_leaves_its_residuals_with_the_rows(spark):
    """So a pass never adds up the trees of earlier rounds again."""
    one = {"huber": PROFILES["huber"]}
    made = boosting.prepare(games(spark), MODELS, one, ["game"], 60, None)
    growth = boosting.Growth(made.blocks, len(made.edges), made.own, made.fits, one)
    start = [boosting.Block.of(r, growth.pairs) for r in growth.blocks.collect()]
    for turn in range(-1, 4):
        growth.round(turn, list(range(len(made.fits))))
    after = [boosting.Block.of(r, growth.pairs) for r in growth.blocks.collect()]
    assert sum(len(x) for b in after for x in b.lefts.values()) > 500
    for a, b in zip(start, after, strict=True):
        for k, left in a.lefts.items():
            assert np.allclose(b.lefts[k], left - growth.trees.added(k, a.codes[:, : len(left)]), atol=1e-9)


@pytest.mark.parametrize("features", [1, 4, 5])
def test_sums_of_pairs_give_those_of_features(features):
    r = np.random.default_rng(8)
    bins = r.integers(0, boosting.BINS, (500, features)).astype(np.uint8)
    weight = r.normal(size=500)
    joint = np.stack([np.bincount(c, weight, minlength=boosting.BINS**2) for c in boosting.paired(bins)]).reshape(-1, boosting.BINS, boosting.BINS)
    plain = np.stack([np.bincount(bins[:, f], weight, minlength=boosting.BINS) for f in range(features)])
    assert np.allclose(boosting.unpaired(joint, features), plain)
