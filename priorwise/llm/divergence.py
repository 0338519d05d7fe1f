"""Audit of how sources of a language diverge from each other and from the language, over its frequent terms.

Which terms are frequent is found by iceberg prefix refinement. The terms' byte prefixes are extended level by
level, to 4, 8, 16, ... bytes; a prefix that fewer documents than the threshold hold is discarded with all
terms below it, since none of them can be in more documents. A term that is shorter than the prefixes of a
level is a prefix of its own there, so what is left of it is kept.

No level reads the texts again. Of a document's distinct terms in byte order, each notes the first level at
which its prefix differs from that of the term before it. A document then counts once for a prefix: at the
first of its terms there, the only one whose prefix is new at that level. So the number of distinct documents
of a prefix is a sum over the vocabulary of the notes up to its level, and texts are read once. That pass also
counts occurrences by source, a row for each term and task, which are taken up for the kept terms only.

All arithmetic is on whole numbers: shares are per thousand million and divided as decimals.
"""

from __future__ import annotations

from operator import ne

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorwise.llm.common import Batches, stored, utf8

MIN_DOCS = 10
TOP_TERMS = 10
SHORTEST = 4  # bytes of a prefix on the first level
HELD = 8 << 20  # bytes of texts whose words a task holds before it gives their counts
READ = 256  # texts of a batch that are taken up at once
GIVEN = 50_000  # terms of a batch that is given
PAIRS = 1 << 20  # pairs of sources that a task handles at once

#: Bytes of terms: A-Z are lowered, letters and all bytes beyond ASCII stay, the rest separates.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


VOCABULARY = "lang string, term binary, levels array<int>, docs array<long>, sources array<string>, uses array<long>"


class Ids(dict):
    """A number for each term seen."""

    def __missing__(self, term: bytes) -> int:
        value = self[term] = len(self)
        return value


def new_levels(terms: list[bytes], doc: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For the distinct (document, term) pairs, in order, the first level at which a term's prefix isn't that of the one before it.

    ``rank`` is a term's place among the sorted ``terms``; terms of one prefix are neighbours there.
    """
    level = np.zeros(len(rank), dtype=np.int64)
    same = doc[1:] == doc[:-1]
    size = SHORTEST
    while same.any():
        prefixes = [t[:size] for t in terms]
        group = np.cumsum([0, *map(ne, prefixes[1:], prefixes)])
        same = same & (group[rank[1:]] == group[rank[:-1]])
        level[1:] += same
        size *= 2
    return level


def _lists(places: np.ndarray, n: int, values: pa.Array, counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """For each of n places the list of its values and that of its counts; places are in order."""
    ends = np.concatenate(([0], np.cumsum(np.bincount(places, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(ends, values), pa.ListArray.from_arrays(ends, pa.array(counts))


def _counted(lang: str, words: list[np.ndarray], ids: Ids, sources: list[str]) -> pa.RecordBatch:
    """Counts of the terms of some documents of a language: by level the documents in which they are new, by source their occurrences."""
    terms = sorted(ids)
    ranks = np.empty(len(terms), dtype=np.int64)
    ranks[np.fromiter(map(ids.__getitem__, terms), dtype=np.int64, count=len(terms))] = np.arange(len(terms))
    names = list(dict.fromkeys(sources))
    number = np.array(list(map({s: k for k, s in enumerate(names)}.__getitem__, sources)))
    cells = np.repeat(np.arange(len(words)) * len(terms), [len(w) for w in words]) + ranks[np.concatenate(words)]
    cells, counts = np.unique(cells, return_counts=True)
    doc, rank = np.divmod(cells, len(terms))
    level = new_levels(terms, doc, rank)
    levels = level.max() + 1
    notes, docs = np.unique(rank * levels + level, return_counts=True)
    pairs = rank * len(names) + number[doc]
    order = np.argsort(pairs, kind="stable")
    pairs, first = np.unique(pairs[order], return_index=True)
    uses = np.add.reduceat(counts[order], first)
    columns = [
        *_lists(notes // levels, len(terms), pa.array((notes % levels).astype(np.int32)), docs),
        *_lists(pairs // len(names), len(terms), pa.array(names, pa.string()).take(pa.array(pairs % len(names))), uses),
    ]
    fields = ["lang", "term", "levels", "docs", "sources", "uses"]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array(terms, pa.binary()), *columns], names=fields)


def _vocabulary(batches: Batches) -> Batches:
    """Partial counts of a task's documents: a row for each term of a language."""
    held: dict[str, tuple[list[np.ndarray], Ids, list[str]]] = {}
    size = 0

    def given() -> Batches:
        while held:  # what is given is no longer held
            lang, (words, ids, sources) = held.popitem()
            if ids:
                whole = _counted(lang, words, ids, sources)
                del words, ids, sources
                for a in range(0, whole.num_rows, GIVEN):
                    yield whole.slice(a, GIVEN)

    for part in (batch.slice(a, READ) for batch in batches for a in range(0, batch.num_rows, READ)):
        langs, sources = part.column("lang").to_pylist(), part.column("source").to_pylist()
        for lang, source, text in zip(langs, sources, utf8(part.column("text")), strict=True):
            own = held.setdefault(lang, ([], Ids(), []))
            terms = text.translate(LETTERS).split()
            own[0].append(np.fromiter(map(own[1].__getitem__, terms), dtype=np.int32, count=len(terms)))
            own[2].append(source)
            size += len(text)
            if size > HELD:
                yield from given()
                size = 0
    yield from given()


def vocabulary(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Partial counts of terms by language: documents in which a term is new, by level, and occurrences, by source."""
    some = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    return docs.select(*some).mapInArrow(_vocabulary, VOCABULARY)


def frequent_terms(words: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term) of the terms that at least ``min_docs`` documents of a language hold, from a vocabulary."""
    notes = words.select("lang", "term", F.explode(F.arrays_zip("levels", "docs")).alias("n")).select("lang", "term", F.col("n.levels").alias("level"), F.col("n.docs").alias("docs"))
    open_ = stored(notes.groupBy("lang", "term", "level").agg(F.sum("docs").alias("docs")))
    kept, level = [], 0
    while True:
        size = SHORTEST << level
        prefixes = open_.withColumn("prefix", F.substring("term", 1, size))
        counts = prefixes.groupBy("lang", "prefix").agg(F.sum(F.when(F.col("level") <= level, F.col("docs"))).alias("n"))
        left = stored(prefixes.join(counts.filter(F.col("n") >= min_docs), ["lang", "prefix"], "left_semi").select("lang", "term", "level", "docs"))
        kept.append(left.filter(F.length("term") < size))
        open_ = left.filter(F.length("term") >= size)
        if open_.isEmpty():
            break
        level += 1
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out.select("lang", "term").distinct()


GRID = "lang string, term binary, total long, held array<struct<no:int,c:long>>"


def _grid(batches: Batches, numbers: int) -> Batches:
    """Rows (lang, term, nos, uses) in order: one row for each term, with its occurrences by number of the source."""
    waiting: list[pa.RecordBatch] = []

    def merged(table: pa.Table) -> Batches:
        lang, term = (pc.dictionary_encode(table.column(c).combine_chunks()) for c in ("lang", "term"))
        key = lang.indices.to_numpy().astype(np.int64) * len(term.dictionary) + term.indices.to_numpy()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        place = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(key)]))))
        nos, uses = table.column("nos").combine_chunks(), table.column("uses").combine_chunks()
        of = np.repeat(place, pc.list_value_length(nos).to_numpy(zero_copy_only=False))
        cell = of * numbers + nos.flatten().to_numpy(zero_copy_only=False)
        cells, at = np.unique(cell, return_inverse=True)
        sums = np.zeros(len(cells), dtype=np.int64)
        np.add.at(sums, at, uses.flatten().to_numpy(zero_copy_only=False))
        of = cells // numbers
        total = np.zeros(len(first), dtype=np.int64)
        np.add.at(total, of, sums)
        ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(first))))).astype(np.int32)
        held = pa.StructArray.from_arrays([pa.array((cells % numbers).astype(np.int32)), pa.array(sums)], names=["no", "c"])
        rows = table.select(["lang", "term"]).take(pa.array(first)).combine_chunks()
        arrays = [rows.column(c).combine_chunks() for c in ("lang", "term")]
        yield from pa.table([*arrays, pa.array(total), pa.ListArray.from_arrays(ends, held)], names=["lang", "term", "total", "held"]).to_batches(max_chunksize=GIVEN)

    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= GIVEN:
            table = pa.Table.from_batches(waiting)
            last = table.num_rows - 1
            end = last
            while end >= 0 and table.column("term")[end] == table.column("term")[last] and table.column("lang")[end] == table.column("lang")[last]:
                end -= 1  # the last term may go on
            if end >= 0:
                yield from merged(table.slice(0, end + 1))
            waiting = table.slice(end + 1).to_batches()
    if waiting and sum(b.num_rows for b in waiting):
        yield from merged(pa.Table.from_batches(waiting))


def share(count: Column, total: Column, terms: Column) -> Column:
    """One more than the smoothed share per thousand million; null without terms."""
    above = (count + 2).cast("decimal(19,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.call_function("div", above, F.nullif((total + 2 * terms).cast("decimal(20,0)"), F.lit(0))) + 1


def gap(p: Column, q: Column) -> Column:
    """The difference of two shares, squared and divided by their sum."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) that occurs.

    Part ``pair`` has each other source of the language with the sum of ``gap`` over all frequent terms of the
    language, those that neither source holds included; part ``term`` the ``top`` frequent terms whose share in
    the source is above that in the language. Ranks go by value, falling, then by item in byte order. Null lang,
    source and text count as empty; every row is a document, repeated rows too; documents without terms still
    make their source occur; a language without frequent terms has pairs of value 0; ties are resolved by item.
    Other columns take no part, whatever their names.
    """
    words = stored(vocabulary(docs, lang_col, source_col, text_col))
    kept = stored(frequent_terms(words, min_docs))
    key = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    named = docs.select(*key).distinct()
    named = stored(named.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    numbers = (named.agg(F.max("no")).first()[0] or 0) + 1
    # sources by their numbers in the language: an array of names becomes one of numbers, with one map for each language
    table = named.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", "no"))).alias("no_of"))
    mine = words.select("lang", "term", "sources", "uses").join(kept, ["lang", "term"], "left_semi").join(table, "lang")
    mine = mine.select("lang", "term", F.transform("sources", lambda s: F.element_at("no_of", s)).alias("nos"), "uses")
    dealt = mine.repartition("lang", "term").sortWithinPartitions("lang", "term")
    grid = stored(dealt.mapInArrow(lambda batches: _grid(batches, numbers), GRID))

    totals = grid.select("lang", F.explode("held").alias("h")).groupBy("lang", F.col("h.no").alias("no")).agg(F.sum("h.c").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = named.join(totals, ["lang", "no"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", "no", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = stored(groups.withColumn("base", share(F.lit(0).cast("long"), F.col("n"), F.col("v"))))
    parts = _pairs(groups, grid, numbers).unionByName(_terms(groups, grid, top))
    return parts.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def _ranked(part: str, rows: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", place.alias("rank"))


def _terms(groups: DataFrame, grid: DataFrame, top: int) -> DataFrame:
    whole = groups.groupBy("lang").agg(F.sum("n").alias("n"), F.max("v").alias("v"))
    lang = grid.join(whole, "lang").withColumn("q", share(F.col("total"), F.col("n"), F.col("v")))
    rows = lang.select("lang", "term", "q", F.inline("held")).join(groups, ["lang", "no"]).withColumn("p", share(F.col("c"), F.col("n"), F.col("v")))
    above = rows.filter("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    return _ranked("term", above).filter(F.col("rank") <= top)


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _both(batches: Batches, numbers: int) -> Batches:
    """Rows (lang, nos, ps, bases) of terms: for each pair of sources what a term that both hold adds."""
    for batch in batches:
        lang = pc.dictionary_encode(batch.column("lang"))
        code, names = lang.indices.to_numpy(zero_copy_only=False), lang.dictionary
        lengths = pc.list_value_length(batch.column("nos")).to_numpy(zero_copy_only=False).astype(np.int64)
        no, p, base = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("nos", "ps", "bases"))
        starts = np.cumsum(lengths) - lengths
        ends = np.repeat(starts + lengths, lengths)
        here = np.arange(len(no))
        own = np.repeat(code, lengths)
        after = ends - here - 1  # partners of a source: those after it in its term
        cuts = [0, *(np.searchsorted(np.cumsum(after), np.arange(PAIRS, after.sum(), PAIRS)) + 1).tolist(), len(no)]
        for a, b in zip(cuts, cuts[1:]):
            n = after[a:b]
            one = np.repeat(here[a:b], n)
            two = one + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            if not len(one):
                continue
            rest = _gaps(p[one], p[two]) - _gaps(p[one], base[two]) - _gaps(base[one], p[two]) + _gaps(base[one], base[two])
            cells, at = np.unique((own[one].astype(np.int64) * numbers + no[one]) * numbers + no[two], return_inverse=True)
            sums = np.zeros(len(cells), dtype=np.int64)
            np.add.at(sums, at, rest)
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(cells // numbers // numbers)), pa.array((cells // numbers % numbers).astype(np.int32)), pa.array((cells % numbers).astype(np.int32)), pa.array(sums)],
                names=["lang", "a", "b", "value"],
            )


def _pairs(groups: DataFrame, grid: DataFrame, numbers: int) -> DataFrame:
    """Sums over all terms of a language, from those that a source holds.

    With the share ``base`` of a term that a source lacks, a sum starts as the number of terms times the gap of
    the two bases. Terms of one source are added by how often they occur there, a count of terms for each number
    of occurrences; what that leaves out for a term of both is added from the terms that both hold.
    """
    other = groups.select("lang", F.col("no").alias("other"), F.col("base").alias("other_base"))
    ends = [F.least("no", "other").alias("a"), F.greatest("no", "other").alias("b")]
    start = groups.join(other, "lang").filter("no < other")
    start = start.select("lang", *ends, F.coalesce(F.col("v") * gap(F.col("base"), F.col("other_base")), F.lit(0)).alias("value"))
    steps = grid.select("lang", F.inline("held")).groupBy("lang", "no", "c").agg(F.count("*").alias("k"))
    steps = steps.join(groups, ["lang", "no"]).withColumn("p", share(F.col("c"), F.col("n"), F.col("v")))
    one = steps.join(other, "lang").filter("no <> other")
    one = one.select("lang", *ends, (F.col("k") * (gap(F.col("p"), F.col("other_base")) - gap(F.col("base"), F.col("other_base")))).alias("value"))
    # what a share is reckoned from, for each source of a language, in the order of the numbers
    known = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("no", "n", "v", "base"))).alias("known"))
    of = lambda h: F.get("known", h["no"])
    ps = F.transform("held", lambda h: share(h["c"], of(h)["n"], of(h)["v"]))
    both = grid.filter(F.size("held") > 1).join(known, "lang").select("lang", F.col("held.no").alias("nos"), ps.alias("ps"), F.transform("held", lambda h: of(h)["base"]).alias("bases"))
    both = both.mapInArrow(lambda batches: _both(batches, numbers), "lang string, a int, b int, value long")
    sums = start.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.array(F.struct(F.col("a").alias("no"), F.col("b").alias("with")), F.struct(F.col("b").alias("no"), F.col("a").alias("with")))
    sums = sums.select("lang", "value", F.inline(sides))
    names = groups.select("lang", "no", "source")
    sums = sums.join(names, ["lang", "no"]).join(names.select("lang", F.col("no").alias("with"), F.col("source").alias("item")), ["lang", "with"])
    return _ranked("pair", sums.select("lang", "source", "item", "value"))
