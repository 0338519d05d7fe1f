"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix (built-in functions only).

The rows of each source block are permuted, the number of rows that each block sends to each cell (a
range of slots of one shard) is drawn from the multivariate hypergeometric law, rows are exchanged by
these counts, and each cell permutes what it got. Together that is a uniform permutation of all rows,
with no sort of the whole table and no task that sees a whole shard.

The matrix has at most ``max_blocks`` x ``max_cells`` entries at any table size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorwise.llm.common import packed, stored

CELL_ROWS, MAX_CELLS, MAX_BLOCKS = 1_000_000, 256, 1024


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` without replacement, by inverting the law on a window of 12 deviations around its mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    spread = (draws * good / total * (bad / total) * max(total - draws, 1) / max(total - 1, 1)) ** 0.5
    reach = int(12 * spread) + 40
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    steps = np.log((good - k[:-1]) * (draws - k[:-1])) - np.log((k[:-1] + 1) * (bad - draws + k[:-1] + 1))
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    law = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(np.searchsorted(law, rng.random() * law[-1], side="right"), len(k) - 1)])


def communication_matrix(blocks: list[int], cells: list[int], seed: int) -> list[list[int]]:
    """Rows that each block sends to each cell; row sums are ``blocks``, column sums are ``cells``."""
    rng, left, matrix = np.random.default_rng(seed), list(cells), []
    for n in blocks:
        row, pool = [], sum(left)
        for size in left:
            take = hypergeometric(rng, size, pool - size, n)
            row.append(take)
            n, pool = n - take, pool - size
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def shard_cells(total: int, shards: int, cell_rows: int = CELL_ROWS, max_cells: int = MAX_CELLS) -> list[tuple[int, int, int]]:
    """(shard, first slot, size) of each cell; shard sizes differ by one row at most."""
    out = []
    for shard in range(shards):
        size = total // shards + (shard < total % shards)
        parts = min(max(1, -(-size // cell_rows)), max(1, max_cells // shards))
        for k in range(parts):
            first, end = size * k // parts, size * (k + 1) // parts
            out.append((shard, first, end - first))
    return out


def shuffle_into_shards(rows: DataFrame, shards: int, seed: int = 7, max_blocks: int = MAX_BLOCKS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Every row as ``doc``, with ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard).

    Values play no part, so nulls, ties, repeated rows and long texts are rows like any other. Fewer rows
    than shards leave the last shards empty; an empty table gives no rows.
    """
    spark = rows.sparkSession
    base = stored(packed(rows, block=F.spark_partition_id() % max_blocks, first=F.rand(seed), second=F.rand(seed + 1)))
    counts = sorted(map(tuple, base.groupBy("block").count().collect()))  # max_blocks rows at most
    cells = shard_cells(sum(n for _, n in counts), shards, cell_rows)
    matrix = communication_matrix([n for _, n in counts], [n for _, _, n in cells], seed)
    bounds = [(b, [int(x) for x in np.cumsum(row)]) for (b, _), row in zip(counts, matrix, strict=True)]
    sent = spark.createDataFrame(bounds, "block int, bounds array<long>")
    starts = spark.createDataFrame([(k, s, f) for k, (s, f, _) in enumerate(cells)], "cell int, shard int, start long")

    place = F.row_number().over(Window.partitionBy("block").orderBy("first", "second"))
    local = base.withColumn("place", place).join(F.broadcast(sent), "block")  # one row per block
    dealt = local.select("doc", "second", F.size(F.filter("bounds", lambda b: b < F.col("place"))).alias("cell"))
    slot = F.row_number().over(Window.partitionBy("cell").orderBy("second"))
    return dealt.withColumn("slot", slot).join(F.broadcast(starts), "cell").select("doc", "shard", (F.col("start") + F.col("slot") - 1).alias("slot"))
