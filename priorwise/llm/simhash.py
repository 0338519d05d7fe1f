"""Near-duplicate detection by SimHash, linked exactly through vantage-point trees.

A fingerprint has a bit set where over half of the hashes of a document's word shingles have it. Fingerprints
that differ in at most ``RADIUS`` bits are linked. Equal fingerprints are one point.

The tree. A node parts its points by their Hamming distance from a vantage point, taken on one byte of the
fingerprint, another byte on each level. For points x and y and vantage point v the triangle inequality
bounds the bytes' distance of x and y from below by |d(x, v) - d(y, v)|, and as the bytes are disjoint, the
bounds of all levels add up. So a search carries what is left of the radius, and a branch is pruned as soon as
the bounds on the way to it exceed the radius.

Shards. The upper levels of one tree deal the points to shards, level by level, until none holds more than
``SHARD_POINTS``. Every point is at home in one shard and is sent as a query to each shard that its ball
overlaps; as links are symmetric, where two ways part only the point on the smaller side is sent across.
A shard's queries are dealt in blocks (and so are its homes, where all bytes are used up and a shard is still
too large), so a task holds at most a block of each. It builds a vantage-point tree of the homes with vantage
points of its own, walks it with all queries at once, and compares what reaches a leaf.

Families. Only which points are connected counts. A task gives a link only where it joins two components that
it hasn't yet joined, and skips comparisons of points it has joined: what it gives grows with its points, and a
dense family costs about one comparison for each member besides those of members that stay apart.
"""

from __future__ import annotations

from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorwise.llm.common import Batches, packed, slices, stored, utf8
from priorwise.llm.components import connected_components

SHINGLE, SEED = 4, 42
RADIUS = 4
LEVELS = 8  # bytes of a fingerprint
MASKS = [0xFF << 8 * k for k in range(LEVELS)]
SHARD_POINTS, QUERY_POINTS = 65_536, 65_536  # a point is eight bytes; small shards would send each point to many
LEAF = 48  # homes of a leaf
SLICE_BYTES = 1 << 20
COUNTED = 1 << 16  # hashes whose bits are counted at once
CELLS = 1 << 21  # comparisons at once


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as an unsigned number; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))  # where the blank before each word is
    hashes = [digest(joined[a + 1 : b], SEED) for a, b in zip(ends, ends[shingle:])]
    counts = np.zeros(64, dtype=np.int64)
    array = np.array(hashes, dtype="<u8")
    for k in range(0, len(array), COUNTED):
        part = array[k : k + COUNTED].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(array), bitorder="little").view("<u8")[0])


def _sign(batches: Batches, shingle: int) -> Batches:
    for batch in batches:
        texts = utf8(batch.column("text"))
        for a, b in slices([len(t) for t in texts], SLICE_BYTES):
            part = batch.slice(a, b - a)
            found = np.array([fingerprint(t, shingle) for t in texts[a:b]], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("id"), pa.array(found, pa.int64())], names=["doc", "id", "fp"])


class Joined:
    """Components of the points of one task, and the links that joined them."""

    def __init__(self, points: np.ndarray):
        self.points, self.parent, self.links = points, np.arange(len(points)), []

    def roots(self, of: np.ndarray) -> np.ndarray:
        root = self.parent[of]
        while (up := self.parent[root]).tolist() != root.tolist():
            root = up
        self.parent[of] = root
        return root

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((x, y))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def compare(self, homes: np.ndarray, queries: np.ndarray, radius: int) -> None:
        """Join each query with the homes within the radius, skipping homes and queries that are joined already."""
        while len(homes) and len(queries):
            root = self.roots(homes)
            order = np.argsort(root, kind="stable")
            homes, root = homes[order], root[order]
            run = int(np.searchsorted(root, root[0], side="right"))  # homes of one component
            size = min(run, 4096) if run >= 16 else LEAF
            some, homes = homes[:size], homes[size:]
            asked = queries[self.roots(queries) != root[0]] if run >= len(some) else queries
            step = max(1, CELLS // len(some))
            for k in range(0, len(asked), step):
                self._hits(some, asked[k : k + step], radius)

    def _hits(self, homes: np.ndarray, queries: np.ndarray, radius: int) -> None:
        near = np.bitwise_count(self.points[queries][:, None] ^ self.points[homes][None, :]) <= radius
        at = np.flatnonzero(near.any(axis=1))
        near, queries = near[at], queries[at]
        for x, y in zip(queries.tolist(), homes[near.argmax(axis=1)].tolist(), strict=True):
            self.join(x, y)
        several = np.flatnonzero(near.sum(axis=1) > 1)
        if len(several):  # the other homes of a query, once for each set of homes
            patterns, first = np.unique(np.packbits(near[several], axis=1), axis=0, return_index=True)
            for k in several[first].tolist():
                for y in homes[near[k]].tolist():
                    self.join(int(queries[k]), y)

    def search(self, homes: np.ndarray, queries: np.ndarray, left: np.ndarray, radius: int, level: int = 0) -> None:
        """Walk the tree of the homes with all queries; ``left`` is what remains of each query's radius."""
        if not len(queries):
            return
        if len(homes) <= LEAF or level == LEVELS:
            self.compare(homes, queries, radius)
            return
        mask = np.uint64(MASKS[level])
        vantage = self.points[homes[len(homes) // 2]] & mask
        inside = np.bitwise_count(self.points[homes] & mask ^ vantage)
        away = np.bitwise_count(self.points[queries] & mask ^ vantage).astype(np.int8)
        for distance in np.unique(inside).tolist():
            rest = left - np.abs(away - np.int8(distance))
            open_ = rest >= 0
            self.search(homes[inside == distance], queries[open_], rest[open_], radius, level + 1)


def block_links(homes: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever the links between queries and homes connect; at most one for each point."""
    points = np.unique(np.concatenate((homes, queries)))
    at = np.searchsorted(points, np.unique(homes)), np.searchsorted(points, np.unique(queries))
    joined = Joined(points)
    joined.search(*at, np.full(len(at[1]), radius, dtype=np.int8), radius)
    pairs = np.array(joined.links, dtype=np.int64).reshape(-1, 2)
    return points[pairs[:, 0]], points[pairs[:, 1]]


def _link(batches: Batches, radius: int) -> Batches:
    """Blocks arrive one after another; a block is held until it is whole."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    block = None

    def done() -> Batches:
        fps, asks = (np.concatenate(x) for x in zip(*held, strict=True))
        a, b = block_links(fps[~asks].view(np.uint64), fps[asks].view(np.uint64), radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("path", "h", "q")])
        fps, asks = batch.column("fp").to_numpy(zero_copy_only=False), batch.column("query").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if tuple(keys[:, a].tolist()) != block:
                if held:
                    yield from done()
                block, held = tuple(keys[:, a].tolist()), []
            held.append((fps[a:b], asks[a:b]))
    if held:
        yield from done()


def _distance(level: int, vantage: int):
    """Hamming distance from the vantage point on the byte of a level."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(vantage)).bitwiseAND(F.lit(signed(MASKS[level]))))


def shard_levels(points: DataFrame, vantage: int, shard_points: int = SHARD_POINTS) -> list[DataFrame]:
    """For each level of the tree its nodes (path, n, leaf); a path has a hexadecimal digit for each distance, plus one."""
    levels, open_ = [], points.select("fp", F.lit(0).cast("long").alias("path"))
    for k in range(LEVELS):
        open_ = open_.withColumn("path", F.col("path") * 16 + _distance(k, vantage) + 1)
        leaf = F.lit(True) if k == LEVELS - 1 else F.col("n") <= shard_points
        nodes = stored(open_.groupBy("path").agg(F.count("*").alias("n")).withColumn("leaf", leaf))
        levels.append(nodes)
        inner = nodes.filter("NOT leaf").select("path")
        if inner.isEmpty():
            break
        open_ = open_.join(inner, "path", "left_semi")
    return levels


def routed(points: DataFrame, levels: list[DataFrame], vantage: int, radius: int = RADIUS) -> DataFrame:
    """(path, fp, home, n): the shard in which a point is at home, and those that its ball overlaps.

    The whole radius is left on a point's own way only. From there it is sent to larger distances alone; a point
    there, whose ball overlaps this one's shard, isn't sent back, so each pair of shards meets once.
    """
    way = points.select("fp", F.lit(0).cast("long").alias("path"), F.lit(radius).alias("left"))
    parts = []
    for k, nodes in enumerate(levels):
        own = _distance(k, vantage)
        low = F.when(F.col("left") == radius, own).otherwise(F.greatest(own - F.col("left"), F.lit(0)))
        child = F.explode(F.sequence(low, F.least(own + F.col("left"), F.lit(8)))).alias("child")
        step = way.select("fp", "path", "left", own.alias("own"), child)
        step = step.select("fp", (F.col("path") * 16 + F.col("child") + 1).alias("path"), (F.col("left") - F.abs(F.col("own") - F.col("child"))).alias("left"))
        reached = step.join(nodes, "path")
        parts.append(reached.filter("leaf").select("path", "fp", (F.col("left") == radius).alias("home"), "n"))
        way = reached.filter("NOT leaf").select("fp", "path", "left")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fingerprint_links(points: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS, query_points: int = QUERY_POINTS) -> DataFrame | None:
    """Links (a, b) among distinct fingerprints ``fp`` that connect all within ``radius``; None without points."""
    top = points.agg(F.min_by("fp", F.xxhash64("fp"))).first()[0]  # any member serves as vantage point of the upper levels
    if top is None:
        return None
    sent = stored(routed(points, shard_levels(points, top, shard_points), top, radius))
    zero = F.lit(0).cast("long")
    shape = sent.groupBy("path").agg(F.ceil(F.max("n") / shard_points).alias("hs"), F.ceil(F.count("*") / query_points).alias("qs"))
    rows = sent.join(shape, "path")
    h, q = F.pmod(F.xxhash64("fp"), F.col("hs")), F.pmod(F.xxhash64("fp", F.lit(1)), F.col("qs"))
    every = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    homes = rows.filter("home").select("path", h.alias("h"), every("qs").alias("q"), F.lit(False).alias("query"), "fp")
    queries = rows.select("path", every("hs").alias("h"), q.alias("q"), F.lit(True).alias("query"), "fp")
    dealt = homes.unionByName(queries).repartition("path", "h", "q").sortWithinPartitions("path", "h", "q", "query")
    return dealt.mapInArrow(partial(_link, radius=radius), "a long, b long")


def fingerprint_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, **sizes) -> DataFrame:
    """Every row as ``doc`` (columns ``carry``, or all) with fp and component_id, the smallest id that links reach.

    Words are cut at white space after lower-casing A-Z; a fingerprint is of runs of ``shingle`` words, repeats
    included, of the whole sequence where there are fewer. Null and empty texts have the fingerprint zero and are
    linked like any other, repeated rows are rows of one fingerprint, and a null id is the greatest: component_id
    is null only if no row of a component has an id. Other columns are carried along, whatever their names.
    """
    doc = packed(docs.select(*[f"`{c}`" for c in carry]) if carry else docs).schema["doc"]
    base = packed(docs, id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`"))
    if carry:
        base = base.withColumn("doc", F.struct(*[F.col(f"doc.`{c}`") for c in carry]))
    kind = T.StructType([doc, *T._parse_datatype_string("id long, fp long")])
    signed = stored(base.mapInArrow(partial(_sign, shingle=shingle), kind))
    points = stored(signed.groupBy("fp").agg(F.min("id").alias("least")))
    links = fingerprint_links(points.select("fp"), radius, **sizes)
    if links is None:
        return signed.withColumn("component_id", F.col("id"))
    components = connected_components(links).select(F.col("node").alias("fp"), "component")
    placed = stored(points.join(components, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    names = placed.join(least, "component").select("fp", "component_id")
    return signed.join(names, "fp").select("doc", "fp", "component_id")
