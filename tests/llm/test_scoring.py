"""Contamination, language, personal data and quality."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from documents import SCHEMA, awkward, contaminated, personal, prose, table
from pyspark.sql import functions as F

from priorwise.llm import decontaminate, language, pii, quality

ITEMS = [(1, prose(50, 30)), (2, "Seven words, are an item; of: seven!"), (3, None), (4, ""), (None, prose(51, 12)), (5, "one"), (1, prose(52, 11)), (6, prose(2, 30_000)[3000:3400])]


def test_only_words_of_the_benchmark_are_hashed(monkeypatch):
    windows = [(b"alpha", b"beta", b"gamma", b"delta"), (b"beta", b"alpha")]
    hashes = decontaminate.window_words(windows)
    shingles = decontaminate.window_shingles(windows, 3, hashes)
    assert [(size, len(h)) for size, h in shingles] == [(3, 2), (2, 1)]
    texts = ["Alpha beta gamma delta x", "new words only", "beta ALPHA", "x gamma, beta alpha beta gamma", None, "", "alpha", "beta gamma delta"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", None)  # no word of a document needs it
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 40)
    seen, n, found = 0, 0, []
    for _, a, _, _, flat, starts in decontaminate._sliced(iter([batch]), hashes):
        seen, n = seen + int((flat != 0).sum()), n + len(flat)
        for size, known in ((3, np.unique(shingles[0][1])), (2, shingles[1][1])):
            at, _ = decontaminate._found(flat, starts, size, known)
            rows = np.searchsorted(starts, at, side="right") - 1
            found += [(a + int(r), int(p - starts[r]), size) for p, r in zip(at, rows, strict=True)]
    assert (seen, n) == (15, 20)
    assert sorted(found) == [(0, 0, 3), (0, 1, 3), (2, 0, 2), (3, 2, 2), (3, 3, 3), (7, 0, 3)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_benchmark_hits(spark, block_bytes):
    r = random.Random(3)
    rows = awkward()
    for k in range(40):
        words = (r.choice(ITEMS)[1] or "x").split()
        a = r.randint(0, len(words) - 1)
        rows.append((100 + k, f"{prose(k, r.randint(0, 20))} {' '.join(words[a : a + r.randint(1, 30)])}. {prose(k, 3)}".upper() if k % 2 else " ".join(words)))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = table(spark, rows)
    hits = decontaminate.benchmark_hits(docs, items, block_bytes=block_bytes).select("doc.doc_id", "doc.text", "n_words", "ranges", "items").collect()
    assert len(hits) == len(rows)
    for x in hits:
        covered = {p for h in x.ranges for p in range(h.start, h.end)}
        assert all(a.end < b.start for a, b in zip(x.ranges, x.ranges[1:], strict=False)) and (x.ranges == []) == (x.items == [])
        want = contaminated(x.text, [("" if i is None else i, t) for i, t in ITEMS], 10)
        assert (x.n_words, len(covered), x.items) == want
    left = decontaminate.decontaminate(docs, items)
    assert left.columns == docs.columns and left.count() == sum(not x.items for x in hits)
    none = items.limit(0)
    assert decontaminate.decontaminate(docs, none).count() == len(rows)
    assert decontaminate.benchmark_hits(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 24, 20_000])
def test_items_that_share_windows_cost_a_document_once(spark, block_bytes):
    """Three thousand items open alike, and a document holds that opening two hundred times."""
    opening = prose(60, 12)
    items = spark.createDataFrame([(k, f"{opening} {prose(k, 3)}") for k in range(3000)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{opening}. unseen words " * 200), (2, opening), (3, prose(62, 40))], "doc_id long, text string")
    got = {x.doc.doc_id: x for x in decontaminate.benchmark_hits(docs, items, block_bytes=block_bytes).collect()}
    assert len(got[1].ranges) == 200 and sum(r.end - r.start for r in got[1].ranges) == 2400
    assert got[1].items == got[2].items == sorted(map(str, range(3000))) and got[3].items == got[3].ranges == []


def test_languages_are_told_apart(spark):
    rows = awkward()[:10] + [(200 + k, prose(k, 40, letters), lang) for k in range(60) for lang, letters in (("aa", "abcde"), ("bb", "defgh"), ("cc", "éèxyz"))]
    rows += [(900, "1234 !?", "aa"), (901, None, "aa"), (902, prose(7, 2_00_000, "defgh"), None)]
    docs = table(spark, rows)
    profiles = language.fit_profiles(docs, F.col("doc_id") >= 230)
    assert list(profiles) == ["aa", "bb", "cc"]
    got = language.identify(docs, profiles).select("doc.*", "lang_pred", F.col("score").alias("s")).collect()
    assert len(got) == len(rows)
    assert all(r.lang_pred == r.lang for r in got if r.doc_id and 200 <= r.doc_id < 900)
    by_id = {r.doc_id: r for r in got}
    assert by_id[900].lang_pred == by_id[901].lang_pred == by_id[2].lang_pred == "und" and by_id[902].lang_pred == "bb"
    assert all(0 <= r.s <= 1 for r in got)
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}
    assert language.fit_profiles(docs.limit(0), F.lit(True)) == {}


def test_out_of_place_distance(spark):
    """By hand: ranks of the n-grams of a text against a profile."""
    text = b"ab ab b"
    row, code, count = language.text_counts([text])
    _, order = language.by_rank(row, code, count)
    profile = order.tolist()
    same = language.identify(spark.createDataFrame([(1, text.decode())], "doc_id long, text string"), {"x": profile, "y": profile[::-1]}).first()
    assert same.lang_pred == "x" and same.score == 1.0
    m = len(profile)
    far = sum(abs(2 * k - m + 1) for k in range(m))
    other = language.identify(spark.createDataFrame([(1, text.decode())], "doc_id long, text string"), {"y": profile[::-1]}).first()
    assert abs(other.score - (1 - far / (m * language.PROFILE))) < 1e-12


def test_base_spans_match_the_plain_patterns(spark):
    r = random.Random(4)
    bits = ["a@b.c", "x@y", "a@b.c_x@d.e", "é@b.co", "1.2.3.4", "999.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "5", "😀", " ", ".", "-", "word", "+1+", "00255.01.1.1", "@"]
    rows = awkward() + [(500 + k, "".join(r.choice(bits) + r.choice(["", " ", ",", "-"]) for _ in range(r.randint(1, 25)))) for k in range(150)]
    found = pii.find_personal_data(table(spark, rows))
    base = F.flatten(F.array(*[pii.joined(F.col(k), F.lit(k)) for k in pii.KINDS]))
    got = found.select("doc.text", base.alias("base")).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.base == personal(x.text), x.text


def test_contexts_discover_identifiers(spark):
    rows = [(k, f"{prose(k, 5)} write to: user{k}@mail.example.com {prose(k, 4)} {k}") for k in range(40)]
    rows += [(100, "please write to: agent77-at-desk now"), (101, "we write to: agent78-at-desk"), (102, "they count 12345 things"), (103, "aim to: nothing")]
    docs = table(spark, rows)
    got = {r.doc_id: r for r in pii.find_personal_data(docs).select("doc.doc_id", "doc.text", "context").collect()}
    assert [(s.kind, got[100].text[s.start : s.end]) for s in got[100].context] == [("context_email", "agent77-at-desk")]
    assert [s.kind for s in got[101].context] == ["context_email"]
    assert not any(got[k].context for k in [*range(40), 102, 103])
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_pattern_scores_by_hand(spark):
    edges = [("p", f"v{k}", "email") for k in range(9)] + [("p", "new", None), ("q", "new", None), ("q", "other", None)]
    known, scores = pii.score_patterns(spark.createDataFrame(edges, "pattern string, value string, seed string"), rounds=1)
    assert [(r.pattern, r.kind, r.support, round(r.confidence, 6)) for r in known.collect()] == [("p", "email", 9, round(9 / 11, 6))]
    assert {r.value: round(r.score, 6) for r in scores.collect() if r.value == "new"} == {"new": round(9 / 11, 6)}


def test_quality_model_learns_tables_and_pairs(spark):
    r = np.random.default_rng(0)
    x = r.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_tables(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    assert quality.fit_tables(x, np.ones(4000)).score(x[:1])[0] > 0.9
    assert quality.fit_tables(x[:0], y[:0]).score(x[:1])[0] == 0.5


def test_quality_of_awkward_rows(spark):
    rows = awkward() + [(200 + k, prose(k, 50) + ".") for k in range(60)] + [(400 + k, "$$$ ### " * 20 + prose(k, 3)) for k in range(60)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, 1 if i < 400 else 0, "?") for i, *_ in rows if i and i >= 200] + [(None, 1, "?"), (200, None, "?")], "doc_id long, quality int, text string")
    model = quality.fit_quality(docs, labels, F.lit(True))
    scored = quality.score_quality(docs, model).select("doc.doc_id", "score").collect()
    assert len(scored) == len(rows) and all(0 <= s.score <= 1 for s in scored)
    assert all((s.score >= 0.3) == (s.doc_id < 400) for s in scored if s.doc_id and s.doc_id >= 200)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id >= 400").isEmpty()
    empty = quality.fit_quality(docs.limit(0), labels, F.lit(True))
    assert quality.score_quality(spark.createDataFrame([], SCHEMA), empty).count() == 0


def test_held_out_accuracy_on_given_tables(spark):
    folder = "/root/testdata/sf0.01"
    from priorwise.llm.catalog import QUERIES

    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    langs = QUERIES["op2_language_id"](spark, folder).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert langs.filter("lang_pred = lang").count() >= 0.97 * langs.count()
    marks = QUERIES["op10_quality"](spark, folder).filter("held_out").join(labels, "doc_id")
    assert marks.filter("predicted = quality").count() >= 0.95 * marks.count()
