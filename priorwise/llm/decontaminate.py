"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is a set of windows of ``window`` consecutive words (an item of fewer words is one
window), a window is a set of word shingles. Containment of the whole window is asked for, so one
shingle of it, its rarest in the documents, is a sufficient prefix. Documents are joined with the
prefixes; the place of the shingle in its window gives the only place where the window could start
(positional bound), the words that the document has there must suffice (length bound), and what is
left is compared word by word over the item-sized window. Only words of the benchmark have hashes in a document:
a shingle with any other word can't be one of the benchmark's, and is never looked up.

The benchmark is read in blocks of bounded size; every block meets all documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorwise.llm.common import Batches, packed, slices, stored, text_key, utf8
from priorwise.llm.words import ALNUM, WordHashes, shingle_hashes

BLOCK_BYTES = 16 << 20  # of benchmark text in the memory of a task
SLICE_BYTES = 4 << 20
RANGES = "array<struct<start:int,end:int>>"


def item_windows(items: list[tuple[str, bytes]], window: int) -> dict[tuple[bytes, ...], list[str]]:
    """The items of each window of words."""
    out: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        words = text.translate(ALNUM).split()
        for k in range(max(1, len(words) - window + 1) if words else 0):
            out[tuple(words[k : k + window])].add(item)
    return {w: sorted(ids) for w, ids in out.items()}


def window_words(windows: list[tuple[bytes, ...]]) -> dict[bytes, int]:
    """The hash of each word of the windows, never 0."""
    hashes = WordHashes()
    return {w: hashes[w] or 1 for w in set(chain.from_iterable(windows))}


def window_shingles(windows: list[tuple[bytes, ...]], shingle: int, hashes: dict[bytes, int]) -> list[tuple[int, np.ndarray]]:
    """Shingle size and hashes of each window; a window shorter than a shingle is one."""
    return [(min(shingle, len(w)), shingle_hashes(_hashed(w, len(w), hashes), min(shingle, len(w)))) for w in windows]


def _hashed(words: Iterable[bytes], n: int, hashes: dict[bytes, int]) -> np.ndarray:
    """The hashes of ``n`` words, 0 for those without."""
    return np.fromiter(map(hashes.get, words, repeat(0)), dtype=np.uint64, count=n)


def _sliced(batches: Batches, hashes: dict[bytes, int]):
    """Documents of a slice of a batch: batch, its rows, words of each row, all word hashes (0: no benchmark word), first word of each row."""
    for batch in batches:
        texts = utf8(batch.column("text"))
        for a, b in slices([len(t) for t in texts], SLICE_BYTES):
            words = [t.translate(ALNUM).split() for t in texts[a:b]]
            starts = np.cumsum([0] + [len(w) for w in words])
            yield batch, a, b, words, _hashed(chain.from_iterable(words), int(starts[-1]), hashes), starts


def _count(batches: Batches, hashes: dict[bytes, int], vocabulary: dict[int, np.ndarray]) -> Batches:
    """How often each benchmark shingle stands in the documents of this task."""
    counts = {k: np.zeros(len(v), dtype=np.int64) for k, v in vocabulary.items()}
    for _, _, _, _, flat, starts in _sliced(batches, hashes):
        for size, known in vocabulary.items():
            at, place = _found(flat, starts, size, known)
            counts[size] += np.bincount(place, minlength=len(known))
    for size, n in counts.items():
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), size), pa.int32()), pa.array(hit, pa.int32()), pa.array(n[hit], pa.int64())], names=["size", "place", "n"])


def _found(flat: np.ndarray, starts: np.ndarray, size: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of known shingles (a sorted array) that lie in one document, and their places in ``known``."""
    seen = shingle_hashes(flat, size)
    if not len(seen) or not len(known):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    whole = np.ones(len(seen), dtype=bool)
    for k in range(size):
        whole &= flat[k : k + len(seen)] != 0
    at = np.flatnonzero(whole)
    seen = seen[at]
    place = np.minimum(np.searchsorted(known, seen), len(known) - 1)
    same = known[place] == seen
    at, place = at[same], place[same]
    row = np.searchsorted(starts, at, side="right") - 1
    inside = at + size <= starts[row + 1]
    return at[inside], place[inside]


def _scan(batches: Batches, hashes: dict[bytes, int], windows: list[tuple[bytes, ...]], ids: list[list[str]], prefixes: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]]) -> Batches:
    """Of each document the word ranges that windows cover, and the items whose windows occur: never more than its words and the items."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch, a, b, words, flat, starts in _sliced(batches, hashes):
        edges: dict[int, np.ndarray] = {}  # of a document with hits: how many windows start, less those that end, at each word
        found: dict[int, set[int]] = defaultdict(set)
        for size, (known, uses) in prefixes.items():
            at, place = _found(flat, starts, size, known)
            rows = np.searchsorted(starts, at, side="right") - 1
            for p, k, row in zip(at.tolist(), place.tolist(), rows.tolist(), strict=True):
                own, first = words[row], p - int(starts[row])
                for w, offset in uses[k]:
                    start, n = first - offset, len(windows[w])
                    if start >= 0 and start + n <= len(own) and tuple(own[start : start + n]) == windows[w]:
                        if row not in edges:
                            edges[row] = np.zeros(len(own) + 1, dtype=np.int64)
                        edges[row][start] += 1
                        edges[row][start + n] -= 1
                        found[row].add(w)
        ranges: list[list[dict]] = [[] for _ in words]
        items: list[list[str]] = [[] for _ in words]
        for row, steps in edges.items():
            covered = np.concatenate(([False], np.cumsum(steps) > 0))
            turns = np.flatnonzero(covered[1:] != covered[:-1]).tolist()
            ranges[row] = [{"start": x, "end": y} for x, y in zip(turns[::2], turns[1::2], strict=True)]
            items[row] = sorted({item for w in found[row] for item in ids[w]})
        part = batch.slice(a, b - a)
        counts = pa.array([len(w) for w in words], pa.int64())
        yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("key"), counts, pa.array(ranges, kind), pa.array(items, pa.list_(pa.string()))], names=["doc", "key", "n_words", "ranges", "items"])


def joined_ranges(ranges: Column) -> Column:
    """Ranges that overlap or touch made one, in order."""
    start = F.array().cast(RANGES)

    def add(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (last["end"] >= r["start"]), grown).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(ranges), start, add)


def _of_block(rows: DataFrame, items: list[tuple[str, bytes]], window: int, shingle: int) -> DataFrame:
    found = item_windows(items, window)
    windows, ids = list(found), list(found.values())
    hashes = window_words(windows)
    shingles = window_shingles(windows, shingle, hashes)
    vocabulary = {size: np.unique(np.concatenate([s for k, s in shingles if k == size])) for size in {k for k, _ in shingles}}
    counted = rows.select("text").mapInArrow(partial(_count, hashes=hashes, vocabulary=vocabulary), "size int, place int, n long")
    seen = {size: np.zeros(len(v), np.int64) for size, v in vocabulary.items()}
    for size, place, n in counted.groupBy("size", "place").agg(F.sum("n")).collect():  # one row per shingle of the block
        seen[size][place] = n
    uses: dict[int, dict[int, list[tuple[int, int]]]] = {size: defaultdict(list) for size in vocabulary}
    for w, (size, own) in enumerate(shingles):
        places = np.searchsorted(vocabulary[size], own)
        offset = int(np.lexsort((own, seen[size][places]))[0])
        if seen[size][places[offset]]:  # else no document has this window
            uses[size][int(own[offset])].append((w, offset))
    prefixes = {size: (np.array(sorted(u), dtype=np.uint64), [u[h] for h in sorted(u)]) for size, u in uses.items() if u}
    kind = T.StructType([rows.schema["doc"], rows.schema["key"], *T._parse_datatype_string(f"n_words long, ranges {RANGES}, items array<string>")])
    return rows.mapInArrow(partial(_scan, hashes=hashes, windows=windows, ids=ids, prefixes=prefixes), kind)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``doc``, with n_words, ``ranges`` (covered words [start, end), in order and apart) and ``items``, sorted as strings.

    Null or empty texts have no words and no hits; items without words have no windows; a null item_id
    counts as the empty string. An empty benchmark hits nothing, an empty table gives no rows. A row holds at most
    its words and the distinct items, however many items share a window and however often it occurs.
    """
    rows = packed(docs, text=F.col(f"`{text_col}`"), key=text_key(id_col, text_col))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))

    def block(k: int) -> list[tuple[str, bytes]]:
        return [(i, t.encode()) for i, t in dealt.filter(F.col("block") == k).select("item_id", "text").collect()]

    first = _of_block(rows, block(0), window, shingle)
    if blocks == 1:
        return first.select("doc", "n_words", "ranges", "items")
    more = None
    for k in range(1, blocks):
        part = _of_block(rows, block(k), window, shingle).filter(F.size("items") > 0).groupBy("key")
        part = stored(part.agg(F.first("ranges").alias("more_ranges"), F.first("items").alias("more_items")))
        more = part if more is None else more.unionByName(part)
    more = more.groupBy("key").agg(F.flatten(F.collect_list("more_ranges")).alias("more_ranges"), F.flatten(F.collect_list("more_items")).alias("more_items"))
    ranges = F.when(F.col("more_ranges").isNull(), F.col("ranges")).otherwise(joined_ranges(F.concat("ranges", "more_ranges")))
    items = F.when(F.col("more_items").isNull(), F.col("items")).otherwise(F.array_sort(F.array_union("items", "more_items")))
    return first.join(more, "key", "left").select("doc", "n_words", ranges.alias("ranges"), items.alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs."""
    return benchmark_hits(docs, benchmark, **options).filter(F.size("items") == 0).select("doc.*")
