"""Near-duplicate detection by circulant MinHash with exact verification.

Signatures. Two permutations of the 32-bit shingle space are enough: one shuffles the space, the other,
shifted by k places round the circle, gives coordinate k. Coordinates are cut into bands; documents that
agree on a band share a bucket. Documents of equal shingle sets are one class, and classes are compared.

Verification without all pairs. In each bucket of more than ``SMALL`` members one leader, the member that meets most others over all
buckets, is compared on full sets with every member. What remains are links between members of which at
least one, x, is no link of the leader L. Write B(x) for the elements that x has and L lacks, A(x) for those
that L has and x lacks. If x and y share nothing in B, then they can share at most all of A(y), and
J(x, y) <= |x & L| / (|x | L| + |B(y)| - |A(y)|). So x and y are linked only if they share an element of B,
or if they share one of A and y is shorter than L by the deficit of x, |x | L| - |x & L| / threshold, at
least. A prefix suffices, new elements before missing ones, because linked sets differ in a bounded number
of elements. What is left of a leader's members after that, less what lies in its largest component, is a set
of queries against all of them, in blocks. In a bucket of at most ``SMALL`` members each is compared with each
of another component. No link between members of a bucket is lost, what is sent grows with the members, and a
large bucket is dealt over tasks by salting its leader and by blocks.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorwise.llm.common import Batches, slices, stored, text_key, utf8
from priorwise.llm.components import connected_components
from priorwise.llm.words import MIX, WordHashes, mixed, shingle_hashes

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 20, 6
SLICE_BYTES = 1 << 20
SALT_MEMBERS = 256  # members compared with one copy of their leader
QUERY_BLOCK, MEMBER_BLOCK = 512, 2048
SMALL = 16  # members of a bucket that are compared each with each; larger buckets go by leaders


def permuted(x: np.ndarray, odd: int) -> np.ndarray:
    """A permutation of 32-bit numbers."""
    x = (x ^ np.uint32(odd)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(items: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates for each run of 32-bit items; no run is empty."""
    first = permuted(items, 0x2545F491)
    out = np.empty((len(starts), size), dtype=np.uint32)
    for k in range(size):
        out[:, k] = np.minimum.reduceat(permuted(first - np.uint32(k), 0x7F4A7C15), starts)
    return out


def shingle_set(text: bytes, hashes: WordHashes, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; fewer words than a shingle are one, no words none."""
    words = hashes.of(text.lower().split())
    return np.unique(shingle_hashes(words, min(shingle, len(words)))) if len(words) else np.empty(0, np.uint64)


def _sign(batches: Batches, shingle: int, bands: int, rows: int) -> Batches:
    hashes = WordHashes()
    for batch in batches:
        texts = utf8(batch.column("text"))
        for a, b in slices([len(t) for t in texts], SLICE_BYTES):
            sets = [shingle_set(t, hashes, shingle) for t in texts[a:b]]
            some = [s for s in sets if len(s)]
            keys = np.empty((0, bands), dtype=np.uint64)
            if some:
                items = (np.concatenate(some) >> np.uint64(32)).astype(np.uint32)
                sig = signatures(items, np.cumsum([0] + [len(s) for s in some[:-1]]), bands * rows).astype(np.uint64).reshape(len(some), bands, rows)
                keys = mixed((sig * MIX[:rows]).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * MIX[rows])
            left = iter(keys.view(np.int64).tolist())
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc"),
                    part.column("id"),
                    part.column("key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets], pa.string()),
                    pa.array([next(left) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc", "id", "key", "n_shingles", "digest", "bands"],
            )


def _compare(batches: Batches, shingle: int, percent: int) -> Batches:
    """Each member against the leader above it: whether linked, and the prefix of their difference."""
    hashes = WordHashes()
    leader = None
    for batch in batches:
        out: list[tuple] = []
        for lead, member, text in zip(batch.column("leader").to_pylist(), batch.column("member").to_pylist(), utf8(batch.column("text")), strict=True):
            own = shingle_set(text, hashes, shingle)
            if member == lead:
                leader = own
                continue
            place = np.minimum(np.searchsorted(leader, own), len(leader) - 1)
            common = leader[place] == own
            both = int(common.sum())
            linked = 100 * both >= percent * (len(own) + len(leader) - both)
            missing = np.ones(len(leader), dtype=bool)
            missing[place[common]] = False
            new, gone = own[~common], leader[missing]
            most = int(len(own) * (1 + 100 / percent) * (100 - percent) / (100 + percent)) + 2  # elements in which a linked set may differ, and one
            shorter = len(gone) - len(new)
            deficit = len(own) + len(gone) - both * 100 / percent
            out.append((lead, member, bool(linked), new[:most].view(np.int64), gone[: max(0, most - len(new))].view(np.int64), shorter, deficit))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.float64())
            columns = [pa.array(values, kind) for values, kind in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["leader", "member", "linked", "new", "gone", "shorter", "deficit"])


def _pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """(leader, member, star) to compare: in large buckets every member with the one that meets most others (``star``), in small ones each with each."""
    large = buckets.filter(F.col("size") > SMALL)
    degree = large.groupBy("node").agg(F.sum("size").alias("degree"))
    leaders = large.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("top"))
    stars = large.join(leaders.select("bucket", F.col("top.node").alias("leader")), "bucket")
    stars = stars.filter("node <> leader").select("leader", F.col("node").alias("member"), F.lit(True).alias("star"))

    one = F.struct("node", "n", "component")
    few = buckets.filter(F.col("size") <= SMALL).groupBy("bucket").agg(F.collect_set(one).alias("all")).select("all", F.explode("all").alias("x"))
    y = F.explode(F.filter("all", lambda y: (y["node"] > F.col("x.node")) & (y["component"] != F.col("x.component"))))
    fit = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent  # sets of too different sizes can't be linked
    each = few.select("x", y.alias("y")).filter(fit).select(F.col("x.node").alias("leader"), F.col("y.node").alias("member"), F.lit(False).alias("star"))
    return stars.unionByName(each).groupBy("leader", "member").agg(F.max("star").alias("star"))


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs compared on full sets; a leader is sent once for every ``SALT_MEMBERS`` members."""
    salts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / SALT_MEMBERS).alias("salts"))
    salted = pairs.join(salts, "leader").select("leader", F.pmod(F.xxhash64("member"), F.col("salts")).alias("salt"), "member")
    leaders = salts.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("leader").alias("member"))
    rows = salted.unionByName(leaders).join(texts.withColumnRenamed("node", "member"), "member")
    dealt = rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", F.col("member") != F.col("leader"))
    return dealt.select("leader", "member", "text").mapInArrow(partial(_compare, shingle=shingle, percent=percent), "leader long, member long, linked boolean, new array<long>, gone array<long>, shorter long, deficit double")


def near_links(classes: DataFrame, texts_of, shingle: int, percent: int) -> DataFrame | None:
    """Components (node, component) of the classes (node, n, bands); ``texts_of`` gives the texts of nodes."""
    members = classes.select("node", "n", F.col("node").alias("component"), F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = stored(members.join(sizes, "bucket"))
    if buckets.isEmpty():
        return None
    texts = stored(texts_of(buckets.select("node").distinct()))
    pairs = stored(_pairs(buckets, percent))
    found = stored(_verified(pairs, texts, shingle, percent).join(pairs, ["leader", "member"]))
    links = found.filter("linked").select(F.col("leader").alias("a"), F.col("member").alias("b"))
    components = stored(connected_components(links))
    # members of a leader that share an element of their difference from it, one of them not linked with it;
    # of missing elements only if another of the group is short enough
    open_leaders = found.filter("star AND NOT linked").select("leader").distinct()
    of = found.filter("star").join(open_leaders, "leader", "left_semi").join(components.withColumnRenamed("node", "member"), "member", "left")
    of = of.withColumn("component", F.coalesce("component", "member")).withColumn("lacks", F.when(~F.col("linked"), F.col("deficit")))
    columns = [F.col("member").alias("node"), "leader", "component", "linked", "shorter", "lacks"]
    short = F.col("shorter") >= 1
    spread = of.select(*columns, F.lit(True).alias("has"), F.explode("new").alias("element"))
    spread = spread.unionByName(of.filter(short | ~F.col("linked")).select(*columns, F.lit(False).alias("has"), F.explode("gone").alias("element")))
    groups = spread.groupBy("leader", "element").agg(
        F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("linked").alias("all"),
        F.max("has").alias("has"), F.max("shorter").alias("shorter"), F.min("lacks").alias("lacks"),
    )
    groups = groups.filter("size > 1 AND low <> high AND NOT all AND (has OR shorter >= lacks - 1e-6)").select("leader", "element")
    rest = stored(spread.join(groups, ["leader", "element"]).select("leader", "node", "component").distinct())
    if rest.isEmpty():
        return components
    more = stored(_searched(rest, texts, shingle, percent))
    if more.isEmpty():
        return components
    return stored(connected_components(links.unionByName(more)))


def _searched(rest: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between components among the remaining members of each leader.

    Of two components one is not the leader's largest, so the members outside of it are queries against
    all, in blocks of queries and of members. Blocks give links, at most one for each of their documents.
    """
    counts = rest.groupBy("leader", "component").agg(F.count("*").alias("n"))
    largest = counts.groupBy("leader").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("members"))
    shape = largest.select(
        "leader",
        F.col("top.component").alias("largest"),
        F.ceil((F.col("members") - F.col("top.n")) / QUERY_BLOCK).alias("query_blocks"),
        F.ceil(F.col("members") / MEMBER_BLOCK).alias("member_blocks"),
    ).filter("query_blocks > 0")
    rows = rest.join(shape, "leader")
    zero = F.lit(0).cast("long")
    as_member = rows.select(
        "leader", "node", "component", F.lit(False).alias("query"),
        F.pmod(F.xxhash64("node"), F.col("member_blocks")).alias("m"), F.explode(F.sequence(zero, F.col("query_blocks") - 1)).alias("q"),
    )
    as_query = rows.filter("component <> largest").select(
        "leader", "node", "component", F.lit(True).alias("query"),
        F.explode(F.sequence(zero, F.col("member_blocks") - 1)).alias("m"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("query_blocks")).alias("q"),
    )
    blocks = as_member.unionByName(as_query).join(texts, "node")
    dealt = blocks.repartition("leader", "q", "m").sortWithinPartitions("leader", "q", "m", "query", "node")
    return dealt.select("leader", "q", "m", "query", "node", "component", "text").mapInArrow(partial(_search, shingle=shingle, percent=percent), "a long, b long").distinct()


def _search(batches: Batches, shingle: int, percent: int) -> Batches:
    """Each query of a block against the members of the block that came before it, by counting shared shingles."""
    hashes = WordHashes()
    block, members, index = None, [], None
    joined: dict[int, int] = {}

    def root(x: int) -> int:
        while joined.get(x, x) != x:
            x = joined[x]
        return x

    for batch in batches:
        out = []
        for row, text in zip(batch.drop_columns(["text"]).to_pylist(), utf8(batch.column("text")), strict=True):
            if (row["leader"], row["q"], row["m"]) != block:
                block, members, index, joined = (row["leader"], row["q"], row["m"]), [], None, {}
            own = shingle_set(text, hashes, shingle)
            if not row["query"]:
                members.append((row["node"], row["component"], own))
                continue
            if not members:
                continue
            if index is None:
                sizes = np.array([len(s) for _, _, s in members])
                order = np.argsort(flat := np.concatenate([s for _, _, s in members]), kind="stable")
                index = flat[order], np.repeat(np.arange(len(members)), sizes)[order], sizes
            tokens, owners, sizes = index
            low, high = np.searchsorted(tokens, own), np.searchsorted(tokens, own, side="right")
            n = high - low
            at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
            both = np.bincount(owners[at], minlength=len(members))
            for k in np.flatnonzero(100 * both >= percent * (sizes + len(own) - both)).tolist():
                node, component, _ = members[k]
                a, b = root(component), root(row["component"])
                if a != b:
                    joined[a] = b
                    out.append((node, row["node"]))
        if out:
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row as ``doc`` (columns ``carry``, or all) with key, n_shingles, component_id and kept.

    Words are cut at white space after lower-casing A-Z. Documents are linked when their sets of distinct
    word shingles have a Jaccard similarity of ``percent`` or more; component_id is the smallest id that
    links reach. A document without words is alone. Repeated rows (same id, same text) are one document, so
    they stay or go together; a null id is the greatest, and component_id is null if a component has no other.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("doc")
    text = F.col(f"`{text_col}`")
    base = docs.select(doc, F.col(f"`{id_col}`").cast("long").alias("id"), text_key(f"`{id_col}`", f"`{text_col}`").alias("key"), text.alias("text"))
    kind = T.StructType([base.schema["doc"], *T._parse_datatype_string("id long, key string, n_shingles long, digest string, bands array<long>")])
    signed = stored(base.mapInArrow(partial(_sign, shingle=shingle, bands=bands, rows=rows), kind))

    alone = F.when(F.col("n_shingles") == 0, F.col("key")).otherwise("")
    rank = F.struct(F.col("id").isNull().alias("null_id"), "id", "key")
    classes = signed.groupBy("digest", alone.alias("alone")).agg(F.min(rank).alias("least"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))

    def texts_of(nodes: DataFrame) -> DataFrame:
        keys = nodes.join(classes.select("node", F.col("least.key").alias("key")), "node")
        return base.select("key", "text").join(keys, "key").groupBy("node").agg(F.first("text").alias("text"))

    components = near_links(classes.select("node", "n", "bands"), texts_of, shingle, percent)
    least = classes.select("digest", "alone", "node", "least")
    if components is not None:
        placed = least.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        tops = placed.groupBy("component").agg(F.min("least").alias("top"))
        least = placed.join(tops, "component").select("digest", "alone", F.col("top").alias("least"))
    out = signed.withColumn("alone", alone).join(least.select("digest", "alone", "least"), ["digest", "alone"])
    return out.select("doc", "key", "n_shingles", F.col("least.id").alias("component_id"), (F.col("key") == F.col("least.key")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with the columns of ``docs``."""
    kept = near_groups(docs, id_col=id_col, text_col=text_col, carry=[id_col], **options).filter("kept").select("key").distinct()
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return docs.select(doc, text_key(f"`{id_col}`", f"`{text_col}`").alias("key")).join(kept, "key", "left_semi").select("doc.*")
