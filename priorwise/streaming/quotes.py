"""Quotes as a stream: windowed consensus and rejection of late or stale quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.releases import is_published, publish_together, read_published


def windowed_consensus(
    quotes: DataFrame, *, event_time: str = "ts", key: str = "game_id", line: str = "line",
    window: str = "1 hour", delay: str = "30 minutes", unique: str | None = None,
) -> DataFrame:
    """Consensus line per event and tumbling window of a quote stream.

    Works on a stream (append mode closes a window once the watermark passes it) and on a table
    with the same result. ``unique`` drops redelivered quotes within the watermark. The percentile
    state is a count per distinct line, not a list of quotes.
    """
    marked = quotes.withWatermark(event_time, delay) if quotes.isStreaming else quotes
    if unique is not None:
        marked = (
            marked.dropDuplicatesWithinWatermark([unique]) if quotes.isStreaming else marked.dropDuplicates([unique])
        )
    quartiles = F.percentile(line, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        marked.groupBy(F.window(event_time, window).alias("w"), key)
        .agg(
            quartiles.alias("q"),
            F.count(line).alias("book_count"),
            F.min(line).alias("line_min"),
            F.max(line).alias("line_max"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            key,
            F.bround(F.col("q")[1], 3).alias("line"),
            F.bround(F.col("q")[2] - F.col("q")[0], 3).alias("line_iqr"),
            "book_count",
            "line_min",
            "line_max",
        )
    )


def verdict(taken: Column, kickoff: Column, max_lead: str = "8 days") -> Column:
    """valid, late (not before kickoff), stale (longer before it than ``max_lead``) or unknown game."""
    return (
        F.when(kickoff.isNull(), "unknown game")
        .when(taken >= kickoff, "late")
        .when(taken < kickoff - F.expr(f"INTERVAL {max_lead}"), "stale")
        .otherwise("valid")
    )


def valid_quotes(
    quotes: DataFrame, kickoffs: DataFrame, *, event_time: str = "ts", key: str = "game_id",
    max_lead: str = "8 days",
) -> DataFrame:
    """Quotes before kickoff and not older than ``max_lead`` at kickoff."""
    return quotes.join(kickoffs, key).where(verdict(F.col(event_time), F.col("kickoff_at"), max_lead) == "valid")


def judged_stream(
    quotes: DataFrame, kickoffs: DataFrame, root: str, state: str, *, unique: str, event_time: str = "ts",
    key: str = "game_id", max_lead: str = "8 days", delay: str = "30 minutes",
) -> StreamingQuery:
    """Judge a stream of quotes against the schedule and write valid and rejected ones to two sinks.

    A quote that is delivered again within the watermark is dropped; one without event time or key is rejected
    as of an unknown game, if it carries an id. Each micro-batch joins the schedule as it is then, and its two
    tables are published by one manifest under the batch's id: a batch that is run again after a failure finds
    its manifest and writes nothing, so every quote is in one sink, once.
    """
    spark = quotes.sparkSession
    once = quotes.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([unique])

    def write(batch: DataFrame, number: int) -> None:
        release = f"batch-{number:012d}"
        if is_published(spark, root, release):
            return
        judged = batch.join(kickoffs, key, "left").withColumn("verdict", verdict(F.col(event_time), F.col("kickoff_at"), max_lead))
        judged = judged.persist()
        sinks = {"valid": judged.where("verdict = 'valid'"), "rejected": judged.where("verdict <> 'valid'")}
        publish_together(spark, sinks, root, release)
        judged.unpersist()

    return once.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def judged_quotes(spark: SparkSession, root: str) -> DataFrame:
    """All quotes that the stream has judged so far, from both sinks."""
    return read_published(spark, root, "valid", start="batch-").unionByName(read_published(spark, root, "rejected", start="batch-"))
