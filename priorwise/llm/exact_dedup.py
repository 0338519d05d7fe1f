"""Exact deduplication over an extendible-hash index on shared files.

1. Tasks normalise and hash their texts, put equal texts of the task together by comparing bytes, and
   write the rows with one leaf entry per distinct text to the shared folder.
2. The directory over the leading bits of the keys starts with one bucket; an overfull bucket is
   split, and a split deeper than the directory doubles it.
3. Each bucket, a range of keys, belongs to one owner task. It reads its entries in key order, chains
   entries of equal key and compares their bytes.
4. Counts and largest ids are aggregated per entry, then per chain link, and joined back by entry.

Copies are put together inside a task before anything is shuffled, so a text that fills a third of the
table costs its owner one entry per task.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorwise.llm.common import Batches, packed, stored, utf8

DIRECTORY_BITS = 14  # the directory never has more than 2 ** 14 cells
BUCKET_BYTES = 32 << 20
HELD_BYTES = 32 << 20  # distinct texts a task holds to find copies among its own rows


def _leaves(batches: Batches) -> Batches:
    """Rows with their key, digest and leaf entry (the row id of an equal text seen before in this task)."""
    row_id = (TaskContext.get().partitionId() << 33) - 1
    held: dict[bytes, tuple[bytes, int]] = {}
    size = 0
    for batch in batches:
        keys, digests, ids, leaves = [], [], [], []
        for text in utf8(batch.column("text")):
            row_id += 1
            text = text.lower()  # of bytes: A-Z only
            digest = hashlib.sha256(text)
            mark = digest.digest()
            known = held.get(mark)
            if known and known[0] == text:
                leaf = known[1]
            else:
                leaf = row_id
                if size + len(text) > HELD_BYTES:
                    held.clear()
                    size = 0
                held[mark] = (text, row_id)
                size += len(text) + 100
            keys.append(xxhash.xxh3_64_intdigest(text) - (1 << 63))
            digests.append(digest.hexdigest())
            ids.append(row_id)
            leaves.append(leaf)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(digests, pa.string()), pa.array(leaves, pa.int64())],
            names=["doc", "row_id", "key", "digest", "leaf"],
        )


def split_buckets(cells: dict[int, int], capacity: int, bits: int = DIRECTORY_BITS) -> list[int]:
    """Directory of the leading key bits: the bucket of each cell. Overfull buckets are halved, down to one cell."""
    depth, directory, sizes = 0, [0], [sum(cells.values())]
    local = [0]
    below = [dict(cells)]
    while any(n > capacity and d < bits for n, d in zip(sizes, local, strict=True)):
        over = {b for b, (n, d) in enumerate(zip(sizes, local, strict=True)) if n > capacity and d < bits}
        if any(local[b] == depth for b in over):
            directory = [b for b in directory for _ in (0, 1)]
            depth += 1
        for b in sorted(over):
            shift = bits - local[b] - 1
            right = {c: n for c, n in below[b].items() if c >> shift & 1}
            left = {c: n for c, n in below[b].items() if not c >> shift & 1}
            local[b] += 1
            below[b], sizes[b] = left, sum(left.values())
            new = len(sizes)
            below.append(right)
            sizes.append(sum(right.values()))
            local.append(local[b])
            places = [k for k, x in enumerate(directory) if x == b]
            for k in places[len(places) // 2 :]:
                directory[k] = new
    return [directory[c >> (bits - depth)] for c in range(1 << bits)]


def _chains(batches: Batches) -> Batches:
    """Entries in key order: each entry with the first entry of its chain that has the same bytes."""
    last, chain = None, []
    for batch in batches:
        leaves, classes = batch.column("leaf").to_pylist(), []
        for key, leaf, text in zip(batch.column("key").to_pylist(), leaves, utf8(batch.column("text")), strict=True):
            if key != last:
                last, chain = key, []
            text = text.lower()
            first = next((known for known, other in chain if other == text), None)
            if first is None:
                chain.append((leaf, text))
                first = leaf
            classes.append(first)
        yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(classes, pa.int64())], names=["leaf", "class"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``doc``, with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts the
    row with the largest id stays (a null id is the smallest; of rows with the same id one stays). An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = packed(docs, text=F.col(f"`{text_col}`"))
    fields = [rows.schema["doc"], *[T.StructField(n, T.LongType()) for n in ("row_id", "key")], T.StructField("digest", T.StringType()), T.StructField("leaf", T.LongType())]
    rows = stored(rows.mapInArrow(_leaves, T.StructType(fields)))

    cell = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 64 - DIRECTORY_BITS).cast("int")
    entries = rows.filter("row_id = leaf").select("leaf", "key", F.col(f"doc.`{text_col}`").alias("text"), cell.alias("cell"))
    cells = {r[0]: r[1] for r in entries.groupBy("cell").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).collect()}
    capacity = min(BUCKET_BYTES, max(1 << 20, sum(cells.values()) // (2 * spark.sparkContext.defaultParallelism)))
    bucket_of = split_buckets(cells, capacity)
    directory = spark.createDataFrame([(c, b) for c, b in enumerate(bucket_of) if c in cells], "cell int, bucket int")
    owned = entries.join(F.broadcast(directory), "cell").select("bucket", "key", "leaf", "text")  # at most 2 ** 14 cells
    classes = owned.repartitionById(max(bucket_of) + 1, F.col("bucket")).sortWithinPartitions("key", "leaf").select("key", "leaf", "text").mapInArrow(_chains, "leaf long, class long")

    best = F.max(F.struct(F.col(f"doc.`{id_col}`").alias("id"), F.col("row_id")))
    of_leaf = rows.groupBy("leaf").agg(best.alias("best"), F.count("*").alias("n"))
    of_leaf = stored(of_leaf.join(classes, "leaf"))
    of_class = of_leaf.groupBy("class").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    links = of_leaf.select("leaf", "class").join(of_class, "class").select("leaf", "best", "n")
    return rows.join(links, "leaf").select(
        "doc",
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row_id") == F.col("best.row_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    return exact_groups(docs, id_col, text_col).filter("kept").select("doc.*")
