"""The source audit against brute force and its SQL."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from documents import awkward, lower, prose

from priorwise.llm import catalog, divergence

CUT = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
FIELDS = "doc_id long, text string, lang string, source string, term string, level int, `x.y` string, value string"


def plain(rows, min_docs, top):
    """rows: (text, lang, source)."""
    docs, uses, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        key = (lang or "", source or "")
        groups.add(key)
        terms = Counter(re.findall(CUT, lower(text)))
        docs[key[0]].update(terms.keys())
        uses[key].update(terms)
    kept = {lang: {t for t, n in c.items() if n >= min_docs} for lang, c in docs.items()}

    def shares(counts, terms):
        total = sum(counts[t] for t in terms)
        return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(terms)) for t in terms}

    def far(p, q):
        return (p - q) * (p - q) // (p + q)

    out = []
    for lang, source in groups:
        terms = kept.get(lang, set())
        p = shares(uses[lang, source], terms)
        q = shares(sum((uses[g] for g in groups if g[0] == lang), Counter()), terms)
        pairs = [(-sum(far(p[t], r[t]) for t in terms), o.encode()) for g, o in groups if g == lang and o != source for r in [shares(uses[g, o], terms)]]
        out += [(lang, source, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(sorted(pairs), 1)]
        above = [(-far(p[t], q[t]), t.encode()) for t in terms if uses[lang, source][t] and p[t] > q[t]]
        out += [(lang, source, "term", t.decode(), -v, k) for k, (v, t) in enumerate(sorted(above)[:top], 1)]
    return Counter(out)


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(k, *r, "?", 1, "?", "?") for k, r in enumerate(rows)], FIELDS).repartition(parts)


def texts(seed, n):
    """Texts whose terms share prefixes of all lengths, in a few languages and sources; one source is hot."""
    r = random.Random(seed)
    stems = ["a", "ab", "abc", "abcd", "abcde", "été", "ét", "мир", "мира", "x" * 40, "x" * 41, "x" * 64, "x" * 65] + prose(seed, 40, "abc").split()
    for _ in range(n):
        words = [r.choice(stems) + r.choice(["", "", "s", "é", "z" * 9]) for _ in range(r.randint(0, 40))]
        lang = r.choice(["en", "en", "fr", None, ""])
        yield r.choice([" ", ", ", "1"]).join(words).title() if r.random() < 0.9 else None, lang, r.choice(["s1", "s1", "s1", "S1", "é", "", None, f"s{r.randint(2, 5)}"])


@pytest.mark.parametrize("min_docs,top", [(10, 10), (3, 4), (1, 1000), (10**6, 5)])
def test_audit_matches_brute_force(spark, min_docs, top):
    rows = list(texts(min_docs, 160)) + [(t, "xx", f"s{k % 2}") for k, (_, t) in enumerate(awkward())] + [(None, "empty", s) for s in "ab"] + [("lonely", "one", "only")]
    rows += rows[:20]
    got = divergence.source_divergence(frame(spark, rows), min_docs, top).collect()
    assert Counter(tuple(r) for r in got) == plain(rows, min_docs, top)


def test_query_agrees_with_its_sql(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    rows = list(texts(77, 300)) + [("word " * 20_000, "en", "s1"), ("x" * 60_000, "en", "s1")] * 11 + [(None, None, None)]
    frame(spark, rows).write.parquet(path)
    got = catalog.QUERIES["op11_source_divergence"](spark, str(tmp_path)).select("lang", "source", "part", "item", "value", "rank")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(f"SELECT lang, source, part, item, value, rank FROM ({catalog.SQL['op11_source_divergence']})").fetchall()
    assert Counter(tuple(r) for r in got.collect()) == Counter(want) == plain(rows, 10, 10)


def test_refinement_counts_distinct_documents_of_prefixes(spark):
    """Many rare terms below one prefix, in few documents each: the prefix falls, though its terms are many."""
    rows = [(" ".join(f"qq{chr(97 + k)}{chr(97 + j)}" for j in range(26)), "en", "s") for k in range(9)] + [("qa qb", "en", "s")] * 10
    words = divergence.vocabulary(frame(spark, rows))
    assert sorted(tuple(r) for r in divergence.frequent_terms(words, 10).collect()) == [("en", b"qa"), ("en", b"qb")]
    assert sum(sum(r.docs) for r in words.collect()) == 9 * 26 + 20
    terms = [b"a", b"abcd", b"abcde", b"abcdefgh", b"abcdefghi", b"b"]
    doc, rank = divergence.np.array([0, 0, 0, 0, 0, 0, 1, 1, 2]), divergence.np.array([0, 1, 2, 3, 4, 5, 2, 4, 4])
    assert divergence.new_levels(terms, doc, rank).tolist() == [0, 0, 1, 1, 2, 0, 0, 1, 0]


def test_small_pieces_give_the_same(spark, monkeypatch):
    """Tasks that give their counts early and merge few rows at once (workers are forked anew for each value)."""
    rows = list(texts(5, 150))
    want = plain(rows, 3, 6)
    batch = [divergence.pa.RecordBatch.from_arrays([divergence.pa.array([f(r[k]) for r in rows]) for k, f in ((1, lambda x: x or ""), (2, lambda x: x or ""), (0, lambda x: x or ""))], names=["lang", "source", "text"])]
    whole = [b.to_pylist() for b in divergence._vocabulary(iter(batch))]
    monkeypatch.setattr(divergence, "HELD", 900)
    monkeypatch.setattr(divergence, "GIVEN", 7)
    parts = list(divergence._vocabulary(iter(batch)))

    def counted(batches):
        docs, uses = Counter(), Counter()
        for b in batches:
            for r in b:
                docs.update({(r["lang"], r["term"], k): n for k, n in zip(r["levels"], r["docs"], strict=True)})
                uses.update({(r["lang"], r["term"], k): n for k, n in zip(r["sources"], r["uses"], strict=True)})
        return docs, uses

    assert len(parts) > len(whole) and counted(b.to_pylist() for b in parts) == counted(whole)
    nos = {s: k for k, s in enumerate(sorted({r[2] or "" for r in rows}))}
    flat = sorted(({"lang": r["lang"], "term": r["term"], "nos": [nos[s] for s in r["sources"]], "uses": r["uses"]} for b in parts for r in b.to_pylist()), key=lambda r: (r["lang"], r["term"]))
    schema = divergence.pa.schema([("lang", "string"), ("term", divergence.pa.binary()), ("nos", divergence.pa.list_(divergence.pa.int32())), ("uses", divergence.pa.list_(divergence.pa.int64()))])
    dealt = [divergence.pa.RecordBatch.from_pylist(flat[a : a + 5], schema) for a in range(0, len(flat), 5)]
    grid = {(r["lang"], r["term"], h["no"]): h["c"] for b in divergence._grid(iter(dealt), len(nos)) for r in b.to_pylist() for h in r["held"]}
    assert grid == {(lang, t, nos[s]): n for (lang, t, s), n in counted(whole)[1].items()}
    assert Counter(tuple(r) for r in divergence.source_divergence(frame(spark, rows), 3, 6).collect()) == want


def test_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], FIELDS)).count() == 0


def test_shares_of_very_many_occurrences(spark):
    from pyspark.sql import functions as F

    rows = [(c, n, v) for c in (0, 10**12, 9 * 10**15) for n in (10**13, 9 * 10**15) for v in (1, 10**7)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in rows]


def test_a_task_holds_bounded_texts():
    """What a task holds doesn't grow with its batch: 24 MB of texts in one batch of rows take far less than their words would."""
    r = random.Random(5)
    lines = [" ".join(r.choice("bcdfg") * r.randint(1, 9) + r.choice("aeiou") for _ in range(1000)) for _ in range(20)]
    rows = [" ".join(r.sample(lines, 4)) for _ in range(1000)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(rows), "source": ["s"] * len(rows), "text": rows})
    del rows
    tracemalloc.start()
    uses = sum(sum(map(sum, given.column("uses").to_pylist())) for given in divergence._vocabulary(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert uses == 4_000_000
    assert peak < 80 << 20
