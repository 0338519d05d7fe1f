"""Exact copies, near copies and repeated passages against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from documents import SCHEMA, awkward, edited, exact, family, near, prose, repeated, table

from priorwise.llm import bwt, exact_dedup, minhash, substrings
from priorwise.llm.components import connected_components


def test_exact_groups_of_awkward_rows(spark):
    rows = awkward() + [(100 + k, "hot text") for k in range(60)]
    docs = table(spark, rows, 5)
    groups = exact_dedup.exact_groups(docs)
    got = groups.select("doc.doc_id", "doc.text", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == exact(rows)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert exact_dedup.exact_dedup(docs).columns == docs.columns


def test_chains_compare_bytes_of_equal_keys():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([7, 7, 7, 9]), pa.array([1, 2, 3, 4]), pa.array(["a", "b", "A", "a"])], names=["key", "leaf", "text"])
    (out,) = exact_dedup._chains(iter([batch]))
    assert out.to_pydict() == {"leaf": [1, 2, 3, 4], "class": [1, 2, 1, 4]}


def test_directory_splits_overfull_buckets():
    cells = {k: 1 + 50 * (k < 3) for k in range(16)}
    directory = exact_dedup.split_buckets(cells, 60, 4)
    sizes = Counter()
    for cell, bucket in enumerate(directory):
        sizes[bucket] += cells[cell]
    assert max(sizes.values()) <= 60 and directory == sorted(directory, key=directory.index)
    assert exact_dedup.split_buckets({}, 60, 4) == [0] * 16


def test_near_groups_of_families(spark):
    rows, ids = [], iter(range(1, 10_000))
    for seed in range(6):  # with some copies too far from the base, and copies of copies
        texts = family(seed + 10, 60, 40, (0, 5))
        texts += [edited(texts[7], k, 1) for k in range(3)]
        random.Random(seed).shuffle(texts)
        rows += [(next(ids), t) for t in texts]
    shared = prose(77, 30)  # a passage that makes many documents alike, but not near
    rows += [(next(ids), shared + " " + prose(500 + k, 14)) for k in range(80)]
    rows += [(next(ids), t) for _, t in awkward()]
    for size, percent in ((3, 85), (5, 80)):
        got = minhash.near_groups(table(spark, rows), size, percent, carry=["doc_id"]).select("doc.doc_id", "n_shingles", "component_id", "kept").collect()
        want = near(rows, size, percent)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_rows_of_one_id_are_kept_as_the_id_is(spark, tmp_path):
    from priorwise.llm import catalog

    base = prose(4, 200)
    rows = [(5, base), (5, edited(base, 1, 1)), (6, edited(base, 2, 1)), (7, prose(5, 50))]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.doc_id, r.component_id, r.kept) for r in catalog.QUERIES["op8_minhash_near_dedup"](spark, str(tmp_path)).collect())
    assert got == {(5, 5, True): 2, (6, 5, False): 1, (7, 7, True): 1}


def test_near_dedup_keeps_one_of_a_group(spark):
    rows = awkward()
    docs = table(spark, rows)
    left = minhash.near_dedup(docs)
    assert left.columns == docs.columns
    got = Counter(r.doc_id for r in left.collect())
    # the repeated row of 10 is one document; a null id loses to a known one
    assert got == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 8: 1, 9: 1, None: 2, 10: 2, 12: 1, 14: 1, 15: 1, 16: 1})


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**32, 1000, dtype=np.uint32)
    b = np.concatenate((a[:800], r.integers(0, 2**32, 200, dtype=np.uint32)))
    sig = minhash.signatures(np.concatenate((a, b)), np.array([0, 1000]), 512)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.08


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(1, 20)] + [(100, k) for k in range(101, 160)] + [(200, 201)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 21)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeated_passages(spark, hot):
    r, passage = random.Random(5), prose(9, 40)
    rows = awkward() + [(200 + k, prose(900 + k, r.randint(5, 60)) + " " + passage[r.randint(0, 50) :] + prose(k, 5)) for k in range(40)]
    rows += [(300 + k, "Der Der Der " * r.randint(3, 30) + prose(k, 3)) for k in range(10)]
    found = substrings.repeated_passages(table(spark, rows), carry=["doc_id"], part_bytes=50_000, hot=hot, keep_text=True)
    got = found.select("doc.doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept").collect()
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, len(x.spans), x.kept_sha256) for x in got) == repeated(rows, 50)
    assert all(len(x.kept) == x.n_bytes - x.n_removed == x.n_bytes - sum(s.end - s.start for s in x.spans) for x in got)


def test_least_by_window():
    r = random.Random(2)
    base = bytes(r.choice(b"ab\x00") for _ in range(150))
    for length in (2, 9, 17, 50):
        pieces = [base[k : k + length + r.randint(0, 40)] for k in range(0, 60, 3)]
        values = np.array([r.randint(0, 9) for _ in pieces])
        least = {}
        for p, v in zip(pieces, values.tolist(), strict=True):
            for k in range(len(p) - length + 1):
                least[p[k : k + length]] = min(v, least.get(p[k : k + length], 99))
        got = bwt.least_by_window(pieces, values, length)
        assert [g.tolist() for g in got] == [[least[p[k : k + length]] for k in range(len(p) - length + 1)] for p in pieces]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(docs).count() == minhash.near_dedup(docs).count() == substrings.repeated_passages(docs).count() == 0
