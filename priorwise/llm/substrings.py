"""Removal of passages that repeat across documents, on Burrows-Wheeler transforms of bounded parts.

Two equal strings of ``length`` bytes have the same least gram (by hash, the leftmost of equal ones) at the
same place, their anchor. So windows are dealt by anchor, and windows of different parts are never equal:

1. Tasks send the anchor hashes of their documents to owners, which tell back those of two documents or more.
2. Groups of documents cut the neighbourhoods of shared anchors out of their texts (the windows of one
   anchor overlap and make one piece), put equal pieces together, and send them to the anchor's part.
3. A part puts equal pieces together again and builds the transform of the pieces of each anchor that has
   several, in runs of bounded size. Threshold-bounded interval expansion gives the classes of equal
   windows; each class knows the smallest document id that has it.
4. Groups mark the bytes of windows whose class has a smaller id than their document.

Texts are shuffled once, into a table bucketed by group, which steps 2 and 4 read where it lies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorwise.llm.bwt import least_by_window
from priorwise.llm.common import Batches, shared_folder, slices, stored, utf8
from priorwise.llm.words import MIX, mixed

LENGTH = 50
GRAM = 20  # long enough that documents seldom share one by chance, short enough for few anchors
#: Rows that are worked on together, by the bytes of their texts: no group holds more than 64 MB, and texts beyond 1 MB are alone.
GROUPS = ((1 << 16, 1024), (1 << 20, 64))
FLAT_BYTES = 1 << 19  # bytes whose grams are hashed at once; places in them have 20 bits
PART_BYTES = 24 << 20  # of document text for each part of anchors
BUCKET_BYTES = 16 << 20  # of document text in a bucket
RUN_BYTES = 2 << 20  # of one transform
LOW = (1 << 40) - 1  # bits of an anchor that are sent
HOT = 20_000  # groups with an anchor from which its windows are dealt one by one
LAST = np.iinfo(np.int64).max
SPANS = "array<struct<start:long,end:long>>"

#: Columns of what a group sends: a row per document with shared anchors (row not null), and a row per part with pieces.
SENT = "part int, grp long, row long, a binary, b binary, c binary, d binary"


def member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(x), dtype=bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), dtype=kind)


def window_anchors(text: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts [start, end) that have one anchor, and the anchor's hash, in bytes of at most 2 ** 20."""
    n, grams = len(text), len(text) - gram + 1
    padded = np.concatenate((text, np.zeros(16, np.uint8)))
    word = np.empty(n, dtype=np.uint64)
    for k in range(8):
        lane = padded[k : k + (n - k + 7) // 8 * 8].view("<u8") if k < n else padded[:0].view("<u8")
        word[k::8] = lane[: len(word[k::8])]
    hashes = word[:grams] * MIX[0]
    for k, at in enumerate([*range(8, gram - 8, 8), gram - 8], 1):
        hashes += word[at : at + grams] * MIX[k]
    hashes = mixed(hashes)
    least = (hashes & ~np.uint64((1 << 20) - 1)) | np.arange(grams, dtype=np.uint64)
    want, have = length - gram + 1, 1
    while have < want:
        more = min(have, want - have)
        least = np.minimum(least[:-more], least[more:])
        have += more
    place = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    return first, np.append(first[1:], len(place)), hashes[place[first]]


def anchor_runs(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, start, end, hash) of the runs of all windows, a few texts or a piece of a long one at a time."""
    segments = [(k, s, t[s : s + FLAT_BYTES + length - 1]) for k, t in enumerate(texts) for s in range(0, len(t) - length + 1, FLAT_BYTES)]
    for a, b in slices([len(x) for _, _, x in segments], FLAT_BYTES):
        part = segments[a:b]
        begin, end, anchor = window_anchors(np.frombuffer(b"".join(x for _, _, x in part), dtype=np.uint8), length, gram)
        edges = np.cumsum([0] + [len(x) for _, _, x in part])
        # a run over an edge between texts is cut there; windows that reach over an edge are none
        cuts = edges[1:-1]
        whole = np.unique(np.concatenate((begin, cuts[cuts < end[-1]])))
        of = np.searchsorted(begin, whole, side="right") - 1
        begin, end, anchor = whole, np.append(whole[1:], end[-1]), anchor[of]
        text = np.searchsorted(edges, begin, side="right") - 1
        end = np.minimum(end, edges[text + 1] - length + 1)
        some = begin < end
        begin, end, anchor, text = begin[some], end[some], anchor[some], text[some]
        shift = np.array([s for _, s, _ in part])[text] - edges[text]
        yield np.array([k for k, _, _ in part])[text], begin + shift, end + shift, anchor


def part_ids(anchors: np.ndarray, parts: int) -> np.ndarray:
    """Part (16 bits) and 40 bits of the hash. Anchors that share an id by chance only cost work: bytes are compared later."""
    return ((anchors >> np.uint64(48)) % np.uint64(parts)) << np.uint64(48) | anchors & np.uint64(LOW)


def _ask(batches: Batches, parts: int, length: int, gram: int) -> Batches:
    """Anchor ids of each group by part; an id of two documents of the slice stands twice."""
    for batch in batches:
        groups, texts = np.array(batch.column("grp").to_pylist()), utf8(batch.column("text"))
        for g in np.unique(groups).tolist():
            part_of, group_of, blobs = [], [], []
            for text, _, _, anchor in anchor_runs([t for t, x in zip(texts, groups.tolist(), strict=True) if x == g], length, gram):
                ids = part_ids(anchor, parts)
                order = np.argsort(ids, kind="stable")
                ids, text = ids[order], text[order]
                new = np.concatenate(([True], ids[1:] != ids[:-1]))
                again = np.concatenate(([False], (ids[1:] == ids[:-1]) & (text[1:] != text[:-1])))
                second = np.flatnonzero(again)
                second = second[np.unique(np.cumsum(new)[second], return_index=True)[1]]  # once for each id
                sent = np.sort(np.concatenate((ids[new], ids[second])))
                part = (sent >> np.uint64(48)).astype(np.int64)
                for cut in np.split(np.arange(len(sent)), np.flatnonzero(np.diff(part)) + 1):
                    part_of.append(int(part[cut[0]]))
                    group_of.append(g)
                    blobs.append(sent[cut].view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
            if blobs:
                yield pa.RecordBatch.from_arrays([pa.array(part_of, pa.int32()), pa.array(group_of, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "grp", "ids"])


def _ids(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 5)
    return np.concatenate((raw, np.zeros((len(raw), 3), np.uint8)), axis=1).copy().view("<u8").ravel()


def _tell(batches: Batches, hot: int) -> Batches:
    """For each group the ids of its anchors that two documents have, and of those the hot ones."""
    by_part: dict[int, list[tuple[int, np.ndarray]]] = {}
    for batch in batches:
        for part, g, blob in zip(batch.column("part").to_pylist(), batch.column("grp").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            by_part.setdefault(part, []).append((g, _ids(blob)))
    for part, asked in by_part.items():
        ids, counts = np.unique(np.concatenate([x for _, x in asked]), return_counts=True)
        shared, often = ids[counts > 1], ids[counts >= hot]
        out: dict[int, list[np.ndarray]] = {}
        for g, x in asked:
            out.setdefault(g, []).append(x[member(x, shared)])
        rows = [(g, np.unique(np.concatenate(x))) for g, x in out.items()]
        rows = [(g, x | np.uint64(part << 48)) for g, x in rows if len(x)]
        for k in range(0, len(rows), 500):
            some = rows[k : k + 500]
            hots = [x[member(x & np.uint64(LOW), often)] for _, x in some]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in some], pa.int64()), pa.array([pack(x) for _, x in some], pa.binary()), pa.array([pack(x) for x in hots], pa.binary())], names=["grp", "ids", "hot"])


def _cut(docs: pa.Table, told: pa.Table, parts: int, length: int, gram: int) -> pa.Table:
    """Runs of the documents of a group that have shared anchors, and the distinct pieces around these, by part."""
    out: list[dict] = []
    asked = told.column("ids").to_pylist()
    if len(docs) and asked:
        texts, ids = utf8(docs.column("text")), docs.column("id").to_pylist()
        shared = np.unique(np.concatenate([unpack(x, np.uint64) for x in asked]))
        hot = np.unique(np.concatenate([unpack(x, np.uint64) for x in told.column("hot").to_pylist()]))
        seen: dict[bytes, tuple[int, int]] = {}
        pieces: dict[int, tuple[list[bytes], list[int], list[int]]] = {}
        runs: list[tuple[list[int], list[int], list[int]]] = [([], [], []) for _ in texts]
        for text, start, end, anchor in anchor_runs(texts, length, gram):
            own = part_ids(anchor, parts)
            keep = member(own, shared)
            text, start, end, own = text[keep], start[keep], end[keep], own[keep]
            for k, s, e, a, single in zip(text.tolist(), start.tolist(), end.tolist(), own.tolist(), member(own, hot).tolist(), strict=True):
                for s1, e1 in ((x, x + 1) for x in range(s, e)) if single else ((s, e),):
                    piece = texts[k][s1 : e1 + length - 1]
                    known = seen.get(piece)
                    if known is None:
                        part = int.from_bytes(hashlib.blake2b(piece, digest_size=4).digest(), "big") % parts if single else a >> 48
                        box = pieces.setdefault(part, ([], [], []))
                        known = seen[piece] = (part, len(box[0]))
                        box[0].append(piece)
                        box[1].append(LAST)
                        box[2].append(a)
                    lows = pieces[known[0]][1]
                    if ids[k] is not None and ids[k] < lows[known[1]]:
                        lows[known[1]] = ids[k]
                    runs[k][0].append(s1)
                    runs[k][1].append(e1 - s1)
                    runs[k][2].append(known[0] << 40 | known[1])
        g = docs.column("grp")[0].as_py()
        for row, (starts, sizes, places) in zip(docs.column("row").to_pylist(), runs, strict=True):
            if starts:
                out.append({"part": g % parts, "grp": g, "row": row, "a": pack(np.diff(np.array(starts, np.int64), prepend=0)), "b": pack(np.array(sizes, np.int32)), "c": pack(np.diff(np.array(places, np.int64), prepend=0))})
        for part, (found, lows, anchors) in pieces.items():
            sizes = np.array([len(x) for x in found], np.int32)
            out.append({"part": part, "grp": g, "a": zstandard.compress(b"".join(found), 1), "b": pack(sizes), "c": pack(np.array(lows, np.int64)), "d": pack(np.array(anchors, np.uint64))})
    return pa.Table.from_pylist(out, schema=_arrow(SENT))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), SPANS: pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])


def _classes(batches: Batches, length: int) -> Batches:
    """For each group the least id of every window of the pieces it sent; rows of documents pass through."""
    boxes: dict[int, list[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        table = pa.Table.from_batches([batch])
        whole = table.filter(table.column("row").is_valid()).drop_columns(["d"])
        yield from whole.to_batches()
        for row in table.filter(table.column("row").is_null()).to_pylist():
            boxes.setdefault(row["part"], []).append((row["grp"], zstandard.decompress(row["a"]), unpack(row["b"], np.int32), unpack(row["c"], np.int64), unpack(row["d"], np.uint64)))
    for part, sent in boxes.items():
        low: dict[bytes, int] = {}
        of_anchor: dict[int, list[bytes]] = {}
        cut: list[list[bytes]] = []
        for _, text, sizes, lows, anchors in sent:
            ends = np.cumsum(sizes)
            cut.append([text[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)])
            for piece, value, a in zip(cut[-1], lows.tolist(), anchors.tolist(), strict=True):
                known = low.get(piece)
                if known is None:
                    of_anchor.setdefault(a, []).append(piece)
                if known is None or value < known:
                    low[piece] = value
        result: dict[bytes, np.ndarray] = {}
        run: list[bytes] = []
        size = 0
        for pieces in of_anchor.values():
            if len(pieces) == 1:  # all that have this anchor have the whole piece
                result[pieces[0]] = np.full(len(pieces[0]) - length + 1, low[pieces[0]], np.int64)
                continue
            run += pieces
            size += sum(map(len, pieces))
            if size >= RUN_BYTES:
                result.update(zip(run, least_by_window(run, np.array([low[x] for x in run], np.int64), length), strict=True))
                run, size = [], 0
        if run:
            result.update(zip(run, least_by_window(run, np.array([low[x] for x in run], np.int64), length), strict=True))
        for (g, *_), own in zip(sent, cut, strict=True):
            least = np.concatenate([result[x] for x in own])
            sizes = np.array([len(result[x]) for x in own], np.int32)
            row = {"part": part, "grp": g, "row": None, "a": pack(np.diff(least, prepend=0)), "b": pack(sizes), "c": None}
            yield pa.RecordBatch.from_pylist([row], schema=_arrow(SENT.removesuffix(", d binary")))


def _mark(docs: pa.Table, told: pa.Table, length: int, keep_text: bool, kind: str) -> pa.Table:
    """Removed spans of each document of the group, and the digest of what is left."""
    least, first, begin, runs = [np.empty(0, np.int64)], {}, [np.empty(0, np.int64)], {}
    windows = pieces = 0
    for part, row, a, b, c in zip(*(told.column(n).to_pylist() for n in ("part", "row", "a", "b", "c")), strict=True):
        if row is not None:
            runs[row] = (np.cumsum(unpack(a, np.int64)), unpack(b, np.int32).astype(np.int64), np.cumsum(unpack(c, np.int64)))
            continue
        values, sizes = np.cumsum(unpack(a, np.int64)), unpack(b, np.int32)
        first[part] = pieces
        least.append(values)
        begin.append(windows + np.cumsum(sizes) - sizes)
        windows, pieces = windows + len(values), pieces + len(sizes)
    least, begin = np.concatenate(least), np.concatenate(begin)
    base = np.zeros(max(first, default=0) + 1, np.int64)
    base[list(first)] = list(first.values())
    out = []
    for row, own, text in zip(docs.column("row").to_pylist(), docs.column("id").to_pylist(), utf8(docs.column("text")), strict=True):
        gone = np.zeros(len(text), dtype=bool)
        if row in runs:
            starts, sizes, places = runs[row]
            at = begin[base[places >> 40] + (places & LOW)]
            shift = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            found = least[np.repeat(at, sizes) + shift] < (LAST if own is None else own)
            hits = np.bincount((np.repeat(starts, sizes) + shift)[found], minlength=len(text) + 1)[: len(text) + 1]
            hits[length:] -= hits[:-length].copy()
            gone = np.cumsum(hits)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).reshape(-1, 2)
        left = np.frombuffer(text, np.uint8)[~gone].tobytes() if len(edges) else text
        out.append({"row": row, "n_bytes": len(text), "n_removed": int(gone.sum()), "spans": [{"start": a, "end": b} for a, b in edges.tolist()], "sha": hashlib.sha256(left).hexdigest()} | ({"kept": left} if keep_text else {}))
    return pa.Table.from_pylist(out, schema=_arrow(kind))


def repeated_passages(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, keep_text: bool = False, part_bytes: int = PART_BYTES, hot: int = HOT) -> DataFrame:
    """Every row as ``doc`` (columns ``carry``, or all), with n_bytes, spans (removed byte ranges), n_removed, kept_sha256, and with ``keep_text`` the bytes left.

    A byte goes if it is covered by a string of ``length`` bytes that also starts in a document with a
    smaller id; strings are judged on the input. A null text is empty, a null id is greater than all others,
    rows of one id never remove from each other. ``length`` exceeds ``GRAM``, ``GRAM`` exceeds 8.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("doc")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    total = docs.select(F.octet_length(text).alias("n")).agg(F.sum("n")).first()[0] or 0
    parts = min(max(8, -(-total // part_bytes)), 60_000)
    base = docs.select(doc, F.col(f"`{id_col}`").cast("long").alias("id"), text).withColumn("row", F.monotonically_increasing_id())
    base = bucketed(base.withColumn("grp", group_of("text", "row")), "grp", max(8, -(-total // BUCKET_BYTES)))
    texts = base.select("grp", "row", "id", "text")

    asked = base.select("grp", "text").mapInArrow(partial(_ask, parts=parts, length=length, gram=GRAM), "part int, grp long, ids binary")
    told = asked.repartitionById(parts, F.col("part")).mapInArrow(partial(_tell, hot=hot), "grp long, ids binary, hot binary")

    def cut(documents: pa.Table, replies: pa.Table) -> pa.Table:
        return _cut(documents, replies, parts, length, GRAM)

    sent = texts.groupBy("grp").cogroup(stored(told).groupBy("grp")).applyInArrow(cut, SENT)
    classes = stored(sent.repartitionById(parts, F.col("part")).mapInArrow(partial(_classes, length=length), SENT.removesuffix(", d binary")))
    kind = f"row long, n_bytes long, n_removed long, spans {SPANS}, sha string" + (", kept binary" if keep_text else "")

    def mark(documents: pa.Table, replies: pa.Table) -> pa.Table:
        return _mark(documents, replies, length, keep_text, kind)

    found = texts.groupBy("grp").cogroup(classes.groupBy("grp")).applyInArrow(mark, kind)
    out = base.select("doc", "row").join(found, "row")
    return out.select("doc", "n_bytes", "n_removed", "spans", F.col("sha").alias("kept_sha256"), *(["kept"] if keep_text else []))


def group_of(text: str, row: str) -> Column:
    """The group of a row: consecutive rows of short texts, fewer of longer ones, one of a very long one."""
    kinds = len(GROUPS) + 1
    out = F.col(row) * kinds + len(GROUPS)
    for kind, (size, rows) in reversed(list(enumerate(GROUPS))):
        out = F.when(F.octet_length(text) <= size, F.floor(F.col(row) / rows) * kinds + kind).otherwise(out)
    return out


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by ``column``: grouping by it needs no further shuffle."""
    path = shared_folder(df.sparkSession)
    name = "groups_" + path.rsplit("-", 1)[1]
    df.repartition(buckets, column).write.option("path", path).option("compression", "zstd").bucketBy(buckets, column).saveAsTable(name)
    table = df.sparkSession.table(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the catalogue forgets it; the files stay, and the frame knows them
    return table
