"""Reading season-partitioned feeds and bundling them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_seasons(
    spark: SparkSession, root: str, seasons: Sequence[int], schema: StructType | str
) -> DataFrame:
    """Union of the seasons that are published under ``root/season=<year>``.

    Unpublished seasons are skipped; the season comes from the folder, so a filter on it prunes
    folders. Only file-system metadata is touched here.
    """
    paths = [f"{root}/season={s}" for s in seasons]
    present = [p for p in paths if _exists(spark, p)]
    if not present:
        declared = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        empty = spark.createDataFrame([], declared)
        return empty if "season" in empty.columns else empty.withColumn("season", F.lit(None).cast("int"))
    return spark.read.schema(schema).option("basePath", root).parquet(*present)


def require_rows(feeds: Mapping[str, DataFrame], required: Sequence[str]) -> None:
    """Fail before any work when a required feed has no row; optional feeds may be empty."""
    for name in required:
        if name not in feeds or feeds[name].isEmpty():
            raise ValueError(f"feed {name} has no published rows for the requested seasons")


def with_season_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Rows of ``primary``, and of ``fallback`` for the seasons ``primary`` does not cover.

    The list of covered seasons is a handful of rows.
    """
    covered = primary.select("season").where("season IS NOT NULL").distinct()
    missing = fallback.join(covered, "season", "left_anti")
    return primary.unionByName(missing, allowMissingColumns=True)


def combine_bundles(parts: Sequence[Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
    """Feed-wise union of bundles, for history plus current season."""
    out: dict[str, DataFrame] = {}
    for part in parts:
        for name, frame in part.items():
            out[name] = (
                out[name].unionByName(frame, allowMissingColumns=True) if name in out else frame
            )
    return out


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add the columns a tolerant feed may lack."""
    missing = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def fingerprint(feeds: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Reproducible digest of the columns that matter in every feed, one row per feed.

    Row hashes are summed in full width and xor-ed, so neither row order nor partitioning changes
    the digest; the count keeps repeated rows apart. A hash skips nulls, so each column also gives
    whether it is null. Absent columns are left out of both name list and hash.
    """
    out = None
    for name, (df, wanted) in feeds.items():
        columns = [c for c in wanted if c in df.columns]
        row = F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())]) if columns else F.lit(0).cast("bigint")
        part = df.agg(
            F.lit(name).alias("feed"),
            F.lit(",".join(columns)).alias("columns"),
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.bit_xor(row), F.lit(0)).alias("xor"),
            F.coalesce(F.sum(row.cast("decimal(20,0)")).cast("string"), F.lit("0")).alias("total"),
        )
        out = part if out is None else out.unionByName(part)
    text = F.concat_ws("|", "feed", "columns", "rows", "xor", "total")
    return out.withColumn("digest", F.sha2(text, 256))


def upcoming_games(games: DataFrame, season: int, week: int | None = None) -> DataFrame:
    """Unplayed games of the season's earliest open week, or of the chosen week."""
    open_games = games.where((F.col("season") == season) & F.col("home_score").isNull())
    if week is not None:
        return open_games.where(F.col("week") == week)
    first = open_games.agg(F.min("week").alias("week"))
    return open_games.join(F.broadcast(first), "week")  # a single row


def latest_injuries(injuries: DataFrame, prediction_season: int) -> DataFrame:
    """Rows of the newest season's newest week that carry a report or practice status."""
    newest = injuries.agg(F.max(F.struct("season", "week")).alias("_n")).select("_n.*")
    current = injuries.join(F.broadcast(newest), ["season", "week"])  # a single row
    status = [F.col(c).isNotNull() for c in ("report_status", "practice_status") if c in injuries.columns]
    kept = current.where(status[0] | status[-1]) if status else current.limit(0)
    return kept.withColumn("stale", F.col("season") != prediction_season)
