"""Bounded looks into the past of a key.

A point-in-time feature is a function of the last ``k`` facts known before a row. The operators here
fetch those facts without ever holding a whole history: frames are ``k`` rows wide, and a key that
owns a large part of all rows can be cut into time blocks that are processed by separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def last_items(array: Column, k: int) -> Column:
    """The last ``k`` items of an array, all of them where it is shorter."""
    return F.when(F.size(array) > k, F.slice(array, -k, k)).otherwise(array)


def attach_recent(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[str],
    fact: Column,
    k: int,
    out: str,
    block: Column | None = None,
) -> DataFrame:
    """Add ``out``: the array of ``fact`` over the ``k`` rows before each row, oldest first.

    Without ``block`` this is one window over ``keys``. With ``block`` (a coarse function of the
    first order column, such as its day) each ``(key, block)`` is its own group, so a hot key spreads
    over as many tasks as it has blocks. Only the last ``k`` facts of a block travel on to the next
    one: ``k`` earlier blocks always suffice, since every block present holds at least one row. The
    row side keeps its ``(key, block)`` partitioning through the window and the join; only the small
    table of tails is shuffled by key.
    """
    if block is None:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, F.collect_list(fact).over(window.rowsBetween(-k, -1)))
    base = df.withColumn("_fact", fact).withColumn("_block", block)
    window = Window.partitionBy(*keys, "_block").orderBy(*order)
    tails = (
        base.select(*keys, "_block", *order, "_fact")
        .select(
            *keys,
            "_block",
            F.collect_list("_fact").over(window.rowsBetween(-(k - 1), 0)).alias("_tail"),
            F.lead(F.lit(True)).over(window).isNull().alias("_is_last"),
        )
        .where("_is_last")
    )
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(-k, -1)
    carried = tails.select(
        *keys,
        "_block",
        last_items(F.flatten(F.collect_list("_tail").over(earlier)), k).alias("_carry"),
    )
    local = F.collect_list("_fact").over(window.rowsBetween(-k, -1))
    joined = base.withColumn("_local", local).join(carried, [*keys, "_block"], "left")
    merged = F.concat(F.coalesce("_carry", F.array_repeat(F.col("_fact"), F.lit(0))), "_local")
    return joined.withColumn(out, last_items(merged, k)).drop(
        "_fact", "_block", "_local", "_carry"
    )


def recency_weighted_mean(values: Column) -> Column:
    """Mean with weights ``exp(linspace(-1, 0, n))`` over the finite values, oldest first."""
    finite = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))

    def weighted(clean: Column) -> Column:
        n = F.size(clean)
        step = F.when(n > 1, F.lit(1.0) / (n - 1)).otherwise(F.lit(0.0))
        pairs = F.transform(
            clean,
            lambda v, i: F.struct(
                (v * F.exp(i * step - 1.0)).alias("x"), F.exp(i * step - 1.0).alias("w")
            ),
        )
        zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("w"))
        return F.aggregate(
            pairs,
            zero,
            lambda acc, p: F.struct((acc.x + p.x).alias("x"), (acc.w + p.w).alias("w")),
            lambda acc: F.when(acc.w > 0, acc.x / acc.w),
        )

    return F.get(F.transform(F.array(finite), weighted), F.lit(0))  # the values are filtered once, not for each weight


def _weights(spark: SparkSession, k: int) -> np.ndarray:
    """``exp(linspace(-1, 0, n))`` by number of values n and place, to the last bit what Spark's columns have."""
    steps = {n: 1.0 / (n - 1) if n > 1 else 0.0 for n in range(1, k + 1)}
    row = spark.range(1).select(*[F.exp(F.lit(i * step - 1.0)) for n, step in steps.items() for i in range(n)]).first()
    out = np.zeros((k + 1, k))
    out[np.tril_indices(k + 1, -1, k)] = list(row)
    return out


def _weighted_means(values: np.ndarray, finite: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Recency-weighted means by row and which rows have one, from values by (place, row), oldest first."""
    n = finite.sum(axis=0)
    place = np.cumsum(finite, axis=0) - 1
    total, weight = np.zeros(values.shape[1]), np.zeros(values.shape[1])
    for own, some, at in zip(values, finite, place, strict=True):
        w = np.where(some, weights[n, np.maximum(at, 0)], 0.0)
        total += own * w
        weight += w
    return np.divide(total, weight, out=np.zeros_like(total), where=weight > 0), weight > 0


def _means_before(batches: Iterator[pa.RecordBatch], key: str, facts: Sequence[str], windows: Sequence[int], weights: np.ndarray, kept: Sequence[str], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and order with the means of the rows before them; the widest window's rows go on to the next batch."""
    widest = max(windows)
    last_keys, last = None, np.empty((len(facts), 0))
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(f).fill_null(float("nan")).to_numpy(zero_copy_only=False) for f in facts]
        values = np.concatenate((last, np.stack(columns)), axis=1)
        keys = batch.column(key) if last_keys is None else pa.concat_arrays([last_keys, batch.column(key)])
        code = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        at = np.arange(len(code))
        opens = np.concatenate(([True], code[1:] != code[:-1]))
        before = at - np.maximum.accumulate(np.where(opens, at, 0))  # rows of the key at hand, those that were passed on too
        finite = np.isfinite(values)
        values = np.where(finite, values, 0.0)
        own = at[len(code) - batch.num_rows :]
        lags = [(np.maximum(own - lag, 0), before[own] >= lag) for lag in range(widest, 0, -1)]
        out = []
        for k in windows:
            for x, some in zip(values, finite, strict=True):
                held = lags[widest - k :]
                mean, has = _weighted_means(np.stack([x[i] for i, _ in held]), np.stack([some[i] & here for i, here in held]), weights)
                out.append(pa.array(mean, mask=~has))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *out], names=[*kept, *names])
        rest = max(len(code) - widest, 0)
        last_keys, last = keys.slice(rest), np.where(finite, values, np.nan)[:, rest:]


def shifted_rolling(
    df: DataFrame,
    stats: Sequence[str],
    *,
    key: str = "player_id",
    order: Sequence[str] = ("game_date", "game_id"),
    windows: Sequence[int] = (4, 8),
    block: Column | None = None,
) -> DataFrame:
    """``<stat>_l<k>``: recency-weighted mean of the ``k`` rows before each row of the key.

    The frame is ``k`` rows wide before missing values are skipped. All stats and window lengths
    share one pass over the data: without ``block`` an Arrow pass over the sorted rows, which holds a
    batch and the widest window's rows however long a key is.
    """
    widest = max(windows)
    if block is None:
        names = [f"{stat}_l{k}" for k in windows for stat in stats]
        as_double = {f"_fact{i}": F.col(s).cast("double") for i, s in enumerate(stats)}
        kept = [c for c in df.columns if c not in names]
        sent = df.withColumns(as_double).repartition(F.col(key)).sortWithinPartitions(key, *order)
        schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(n, T.DoubleType()) for n in names]])
        run = partial(_means_before, key=key, facts=list(as_double), windows=list(windows), weights=_weights(df.sparkSession, widest), kept=kept, names=names)
        return sent.mapInArrow(run, schema).select(*dict.fromkeys([*df.columns, *names]))
    fact = F.struct(*[F.col(s).cast("double").alias(s) for s in stats])
    held = attach_recent(
        df, keys=[key], order=list(order), fact=fact, k=widest, out="_recent", block=block
    )
    columns = {}
    for k in windows:
        window = F.col("_recent") if k == widest else last_items(F.col("_recent"), k)
        for stat in stats:
            columns[f"{stat}_l{k}"] = recency_weighted_mean(window.getField(stat))
    return held.withColumns(columns).drop("_recent")


def rank_in_group(
    df: DataFrame, *, group: Sequence[str], order: str, out: str, width: int = 1 << 20
) -> DataFrame:
    """``row_number`` of a unique integer ``order`` within ``group``, safe for a hot group.

    Rows are numbered inside ranges of ``width`` consecutive order values (at most ``width`` rows
    each) and shifted by the row count of the ranges before; those counts are combined map-side.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / F.lit(width)))
    counts = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*group, "_range").orderBy(order)
    return (
        ranged.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*group, "_range"])
        .withColumn(out, F.col("_inside") + F.col("_before"))
        .drop("_range", "_inside", "_before")
    )


def keep_one(
    df: DataFrame, keys: Sequence[str], ordinal: str, *, keep: str = "first"
) -> DataFrame:
    """One row per key, the first or last by ingest ordinal.

    An aggregate instead of a row-number window: candidates shrink to one per key before the
    shuffle, so a key repeated in a third of all rows costs one row per map task.
    """
    pick = F.min_by if keep == "first" else F.max_by
    rest = [c for c in df.columns if c not in keys and c != ordinal]
    kept = df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(ordinal)).alias("_row"))
    return kept.select(*keys, *[F.col("_row").getField(c).alias(c) for c in rest])


def top_n(df: DataFrame, order: Sequence[Column], n: int, *, rank: str = "rank") -> DataFrame:
    """Global top ``n`` with its rank. The limit runs per task before the merge."""
    limited = df.orderBy(*order).limit(n)
    return limited.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
