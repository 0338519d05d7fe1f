"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each with a price. Documents are cut into pieces of at most the
greatest length, pieces are taken in falling length, and each goes to the open bin that it fills best. If
none has room, a bin is opened. For each permitted size the pieces still to come tell how far it would fill:
the longest that fits is laid into it until none does. The size that costs least per token, at the length to
which such contents would be downsized, is opened; so a short piece opens a long bin where that wastes less.
In the end each bin is downsized to the least permitted length that holds its contents.

Pieces are dealt by a hash into shards of about ``SHARD_TOKENS`` tokens, which pack on their own; a shard
leaves a few bins part-filled, so what dealing costs is a fixed small share at any table size.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorwise.llm.common import Batches, stored, utf8

CAPACITIES = (512, 1024, 2048, 4096)
#: A sequence of c tokens costs c for its tokens, c * c / ATTENTION for pairs of tokens, and a fixed price.
ATTENTION, BIN_PRICE = 8192, 64
SHARD_TOKENS = 2_000_000


def price(capacity: int) -> float:
    return capacity + capacity * capacity / ATTENTION + BIN_PRICE


def expected_fill(room: int, lengths: int, counts: list[int]) -> int:
    """Tokens that the pieces to come would lay into a room, the longest that fits first; bit n of ``lengths`` tells whether there are any of n."""
    left, taken, last = room, 0, 0
    while fitting := lengths & ((2 << left) - 1):
        n = fitting.bit_length() - 1
        taken = taken + 1 if n == last else 1
        if taken > counts[n]:  # no more of these: shorter ones are next
            lengths &= (1 << n) - 1
            continue
        left -= n
        last = n
    return room - left


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the capacity of each bin. ``lengths`` fall and none exceeds the greatest capacity.

    Of open bins that a piece fits, the one with least room left is taken, the latest opened of equal ones; of
    sizes that cost the same per token, the greatest is opened, which leaves more choice to the pieces to come.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]  # by room left
    mask = 0  # bit r: some open bin has r tokens of room
    counts = [0] * (capacities[-1] + 1)  # pieces to come, by length
    for n in lengths:
        counts[n] += 1
    coming = sum(1 << n for n, k in enumerate(counts) if k)
    bins, offsets, used, size = [], [], [], []
    for n in lengths:
        counts[n] -= 1
        if not counts[n]:
            coming ^= 1 << n
        fitting = mask >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            k = open_bins[room].pop()
            if not open_bins[room]:
                mask ^= 1 << room
        else:
            k = len(size)
            filled = [(n + expected_fill(c - n, coming, counts), c) for c in capacities if c >= n]
            most = -min((price(next(d for d in capacities if d >= f)) / f, -c) for f, c in filled)[1]
            size.append(most)
            used.append(0)
            room = most
        bins.append(k)
        offsets.append(used[k])
        used[k] += n
        room -= n
        if room:
            open_bins[room].append(k)
            mask |= 1 << room
    return bins, offsets, [next(c for c in capacities if c >= n) for n in used]


def _lengths(batches: Batches) -> Batches:
    for batch in batches:
        n = [len(t.split()) + 1 for t in utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int64())], names=["doc", "n_tokens"])


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, shard_tokens: int = SHARD_TOKENS, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per piece: ``doc``, piece (from 0), start (first token in the document), length, bin_id, capacity, offset (in the bin).

    ``doc`` has the columns ``carry``, or all; without the text far less is stored and joined.

    Tokens are words between white space, and one end mark per document, so a null or empty text is a piece
    of one token. Documents are cut at every ``capacities[-1]`` tokens, never dropped. An empty table gives no rows.
    """
    capacities = tuple(sorted(capacities))
    most = capacities[-1]
    doc = F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("doc")
    rows = docs.select(doc, F.col(f"`{text_col}`").alias("text"))
    kind = T.StructType([rows.schema["doc"], T.StructField("n_tokens", T.LongType())])
    rows = stored(rows.mapInArrow(_lengths, kind).select("doc", "n_tokens", F.monotonically_increasing_id().alias("row")))
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    piece = F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / most).cast("int")))
    pieces = rows.select("row", "n_tokens", piece.alias("piece")).select(
        F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"),
        "row",
        "piece",
        F.least(F.lit(most), F.col("n_tokens") - F.col("piece") * most).alias("length"),
    )

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "row", "piece"], ascending=[False, True, True], ignore_index=True)
        bins, offsets, sizes = best_fit(part["length"].tolist(), capacities)
        return part.assign(bin=bins, offset=offsets, capacity=[sizes[k] for k in bins])

    out = "shard long, row long, piece int, length long, bin long, offset long, capacity long"
    placed = pieces.groupBy("shard").applyInPandas(pack, out)
    return rows.join(placed, "row").select(
        "doc",
        "piece",
        (F.col("piece").cast("long") * most).alias("start"),
        "length",
        F.concat_ws("-", "shard", "bin").alias("bin_id"),
        "capacity",
        "offset",
    )
