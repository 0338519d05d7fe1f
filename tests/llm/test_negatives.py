"""Hard negatives against brute force, the threshold algorithm against a full scan, and the query against its SQL."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from priorwise.llm import catalog, negatives

FIELDS = "vec_id long, embedding array<{}>, label int, `row` string, score string, `x.y` string, windows string"


def plain(rows, is_anchor, relabel=lambda i, label: label):
    use = []
    for k, (i, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            use.append((k, i, [math.floor(256 * x) for x in v], relabel(i, label)))
    score = lambda a, b: min(max(sum(x * y for x, y in zip(a[2], b[2], strict=False)), -(2**63)), 2**63 - 1)
    order = lambda s: (-s[0], s[1][1] is None, s[1][1] or 0)
    out = []
    for a in use:
        if a[1] is None or not is_anchor(a[1]):
            continue
        scored = sorted(((score(a, b), b) for b in use if b[0] != a[0]), key=order)
        for ps, p in [x for x in scored if x[1][3] == a[3]][:5]:
            fit = [(s, b) for s, b in scored if b[3] != a[3] and 50 * ps <= 100 * s <= 95 * ps]
            out += [(a[1], p[1], k, b[1], ps, s) for k, (s, b) in enumerate(fit[:3], 1)]
    return Counter(out)


def frame(spark, rows, kind="float", parts=5):
    return spark.createDataFrame([(*r, "?", "?", "?", "?") for r in rows], FIELDS.format(kind)).repartition(parts)


def clustered(seed, n, width, labels=4, spread=0.5):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(labels, width))
    for k in range(n):
        label = int(r.integers(labels))
        yield k, [float(np.float32(x)) for x in (centres[label] + spread * r.normal(size=width)) / math.sqrt(width)], label


def answer(df):
    return Counter(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("width,spread,blocks", [(3, 0.5, 4096), (24, 1.0, 37), (24, 0.1, 50)])
def test_negatives_match_brute_force(spark, width, spread, blocks):
    rows = list(clustered(width, 400, width, spread=spread))
    random.Random(2).shuffle(rows)
    got = negatives.hard_negatives(frame(spark, rows), lambda i: i % 9 == 0, candidates=blocks, anchors=11)
    want = plain(rows, lambda i: i % 9 == 0)
    assert answer(got) == want and len(want) > 50


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, v, label) for i, v, label in clustered(5, 60, 4)]
    rows += [(100, None, 1), (110, [], 1), (120, [0.0] * 4, 1), (130, [nan, 1.0, 1.0, 1.0], 1), (140, [inf, 0.0, 0.0, 0.0], 2), (150, [1.0, None, 0.0, 0.0], 2)]
    rows += [(160, [1.0], 0), (170, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5], 0), (180, [0.1, 0.2, 0.3, 0.4], None), (190, [0.3] * 4, 77)]
    rows += [(200 + k, [0.25, -0.5, 0.25, 0.125], k % 3) for k in range(40)]  # ties
    rows += [(300 + 10 * k, [-1.0, -1.0, -1.0, -1.0], 5 + k % 2) for k in range(4)] + [(400, [1e-9, -1e-9, 0.0, 0.0], 0)]
    for parts, blocks in ((1, 4096), (6, 9)):
        got = negatives.hard_negatives(frame(spark, rows, "double", parts), lambda i: i % 10 == 0, candidates=blocks, anchors=5)
        assert answer(got) == plain(rows, lambda i: i % 10 == 0)


def test_repeated_rows_and_rows_without_id(spark):
    """Rows of equal id have equal vectors here, so that no tie is left open."""
    rows = list(clustered(6, 50, 3)) * 2 + [(None, v, label) for _, v, label in clustered(7, 6, 3)]
    assert answer(negatives.hard_negatives(frame(spark, rows), lambda i: i % 10 == 0)) == plain(rows, lambda i: i % 10 == 0)


def test_components_beyond_doubles_are_scored_exactly(spark):
    r = random.Random(3)
    for size in (2.0**24, 2.0**26, 1e30):
        rows = [(k, [r.uniform(-1, 1) * size for _ in range(3)], k % 3) for k in range(60)]
        got = answer(negatives.hard_negatives(frame(spark, rows, "double"), lambda i: i % 5 == 0))
        assert got == plain(rows, lambda i: i % 5 == 0)


def test_query_agrees_with_its_sql(spark, tmp_path):
    rows = list(clustered(9, 600, 16, labels=10, spread=0.7)) + [(1000, None, 1), (1050, [float("nan")] * 16, 3), (1100, [0.1] * 16, None), (1150, [0.0] * 16, 4)]
    path = str(tmp_path / "embeddings.parquet")
    frame(spark, rows).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    names = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    want = Counter(con.execute(f"SELECT {names} FROM ({catalog.SQL['op12_hard_negatives']})").fetchall())
    flip = lambda i, label: (label + 1) % 10 if i % 7 == 0 else label
    assert answer(catalog.QUERIES["op12_hard_negatives"](spark, str(tmp_path))) == want == plain(rows, lambda i: i % 50 == 0, flip)


def test_reading_stops_before_all_is_scored():
    """In few dimensions the threshold falls below the best scores soon."""
    r = np.random.default_rng(1)
    x = np.floor(256 * r.normal(size=(4000, 3)))
    lists = negatives.Lists(x, np.arange(4000))
    scored = []

    class Counted(np.ndarray):
        def __getitem__(self, item):
            out = super().__getitem__(item)
            if isinstance(item, np.ndarray):
                scored.append(len(item))
            return out

    lists.vectors = x.view(Counted)
    for anchor in x[:40]:
        scored.clear()
        ((at, scores),) = lists.best(anchor, np.ones(4000, dtype=bool), [(-np.inf, np.inf)], 5)
        want = np.lexsort((np.arange(4000), -(x @ anchor)))[:5]
        assert at.tolist() == want.tolist() and scores.tolist() == (x @ anchor)[want].tolist()
        assert sum(scored) < 2500


def test_empty_tables(spark):
    empty = spark.createDataFrame([], FIELDS.format("float"))
    assert negatives.hard_negatives(empty, lambda i: i % 50 == 0).count() == 0
    assert negatives.hard_negatives(frame(spark, [(1, [1.0], 0), (2, [1.0], 1)]), lambda i: i % 50 == 0).count() == 0
