"""SimHash fingerprints, vantage-point trees and their shards against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from documents import SCHEMA, awkward, edited, family, lower, prose, table

from priorwise.llm import catalog, simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    runs = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(points, radius=4):
    """Component label of each point by comparing all pairs."""
    points = np.array(sorted(set(points)), dtype=np.uint64)
    label = np.arange(len(points))
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
    while True:
        least = np.where(near, label[None, :], len(points)).min(axis=1)
        if (least == label).all():
            return dict(zip(points.tolist(), label.tolist(), strict=True))
        label = least


def grouped(label):
    groups = {}
    for point, component in label.items():
        groups.setdefault(component, set()).add(point)
    return sorted(map(sorted, groups.values()))


def scattered(seed, centres, around):
    """Points at small distances around centres, some of which are close to each other."""
    r = random.Random(seed)
    points = [0, 2**64 - 1]
    for _ in range(centres):
        c = r.getrandbits(64)
        for _ in range(around):
            x = c
            for _ in range(r.randint(0, 7)):
                x ^= 1 << r.randrange(64)
            points.append(x)
    return points


def test_fingerprints_of_awkward_texts():
    texts = [t for _, t in awkward()] + [prose(k, k) for k in range(1, 12)] + ["A\x1cb c  D\x0be", "word " * 9]
    for text in texts:
        assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("seed", range(6))
def test_blocks_connect_what_is_near(seed):
    points = np.array(scattered(seed, (1, 3, 20, 60)[seed % 4], (900, 200, 30, 4)[seed % 4]), dtype=np.uint64)
    r = np.random.default_rng(seed)
    homes = points[r.random(len(points)) < 0.7]
    queries = np.concatenate((points[r.random(len(points)) < 0.8], homes))
    a, b = simhash.block_links(homes, queries)
    assert (np.bitwise_count(a ^ b) <= 4).all() and len(a) < len(set(points.tolist()))
    want = plain_components(np.concatenate((homes, queries)).tolist())
    # links among queries alone are the business of other blocks: connect the plain way over query-home pairs
    near = {}
    h = np.unique(homes)
    parent = {p: p for p in want}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for q in np.unique(queries).tolist():
        for y in h[np.bitwise_count(h ^ np.uint64(q)) <= 4].tolist():
            parent[root(q)] = root(y)
    near = {p: root(p) for p in want}
    parent = {p: p for p in want}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        parent[root(x)] = root(y)
    assert grouped({p: root(p) for p in want}) == grouped(near)


@pytest.mark.parametrize("shard,query", [(65_536, 65_536), (60, 50), (5, 7)])
def test_shards_lose_no_link(spark, shard, query):
    points = sorted(set(scattered(3, 25, 40)))
    signed = np.array(points, dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4)
    links = simhash.fingerprint_links(frame, shard_points=shard, query_points=query).collect()
    parent = {p: p for p in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in links:
        assert ((x ^ y) & (2**64 - 1)).bit_count() <= 4
        parent[root(x)] = root(y)
    ours = grouped({p & (2**64 - 1): root(p) for p in signed})
    assert ours == grouped(plain_components(points))


def test_routes_meet_each_near_pair_once(spark):
    points = sorted(set(scattered(8, 12, 20)))
    signed = np.array(points, dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    levels = simhash.shard_levels(frame, signed[0], 20)
    assert len(levels) > 1
    sent = [(r.path, r.fp & (2**64 - 1), r.home) for r in simhash.routed(frame, levels, signed[0]).collect()]
    home = {fp: path for path, fp, at_home in sent if at_home}
    assert sorted(home) == points and sum(h for *_, h in sent) == len(points)
    reach = {(fp, path) for path, fp, _ in sent}
    for k, x in enumerate(points):
        for y in points[k + 1 :]:
            if (x ^ y).bit_count() <= 4 and home[x] != home[y]:
                assert ((x, home[y]) in reach) != ((y, home[x]) in reach)
    assert len(sent) < len(points) * len(set(home.values()))


def plain(rows):
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    label = plain_components(prints)
    least = {}
    for (i, *_), p in zip(rows, prints, strict=True):
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    return Counter((i, f"{p:016x}", least.get(label[p])) for (i, *_), p in zip(rows, prints, strict=True))


def test_groups_of_awkward_rows_and_families(spark, tmp_path):
    rows, ids = awkward(), iter(range(100, 10_000))
    for seed in range(4):
        rows += [(next(ids), t) for t in family(seed + 50, 150, 40, (0, 6))]
    rows += [(next(ids), "a hot text of more than four words") for _ in range(200)]
    rows += [(None, edited(prose(51, 150), 1, 1)), (-5, "a hot text of more than four words")]
    random.Random(1).shuffle(rows)
    docs = table(spark, rows, 7)
    got = simhash.fingerprint_groups(docs, shard_points=50, query_points=40).select("doc.*", "fp", "component_id").collect()
    assert Counter((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in got) == plain(rows)
    assert all(r["lang"] == "en" and r["x.y"] == "?" for r in got)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = catalog.QUERIES["op13_simhash_near_dedup"](spark, str(tmp_path))
    assert Counter(tuple(r) for r in out.select("doc_id", "fingerprint", "component_id").collect()) == plain(rows)


def test_empty_table(spark):
    assert simhash.fingerprint_groups(spark.createDataFrame([], SCHEMA)).count() == 0
