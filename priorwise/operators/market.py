"""Market quotes: consensus, temporal validity, snapshot planning, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.odds import (
    home_cover_probability,
    implied_probability,
    no_vig,
    over_probability,
    score_pair,
    spread_to_margin,
)
from ..functions.timeparse import local_kickoff, parse_instant

#: Price of one historical request per region and market, oldest usable snapshot, and
#: how far the kickoff of a snapshot's event may be from the planned one.
CREDITS_PER_REQUEST = 10
MAX_AGE = "8 days"
KICKOFF_TOLERANCE_SECONDS = 6 * 3600

_PRICES = ("home_price", "away_price", "over_price", "under_price")


def flatten_payload(payload: DataFrame, clubs: DataFrame) -> DataFrame:
    """Event -> bookmakers[] -> markets[] -> outcomes[] to one row per quoted market.

    Club names resolve through a small dimension table; events with an unknown name drop out.
    Outcomes stay arrays of a handful of entries and are picked by filter, so nothing is regrouped.
    """
    home = clubs.select(F.col("name").alias("home_team"), F.col("code").alias("home_code"))
    away = clubs.select(F.col("name").alias("away_team"), F.col("code").alias("away_code"))
    keep = ["event_id", "snapshot_at", "commence_time", "home_team", "away_team", "home_code", "away_code"]
    markets = (
        payload.join(F.broadcast(home), "home_team")  # one row per club name
        .join(F.broadcast(away), "away_team")
        .select(*keep, F.explode("bookmakers").alias("_b"))
        .select(
            *keep,
            F.col("_b.key").alias("book"),
            F.col("_b.last_update").alias("book_update"),
            F.explode("_b.markets").alias("_m"),
        )
    )

    def outcome(name: str) -> Column:
        return F.expr(f"get(filter(_m.outcomes, o -> o.name = {name}), 0)")

    spread = F.col("_m.key") == "spreads"
    main = F.when(spread, outcome("home_team")).otherwise(outcome("'Over'"))
    other = F.when(spread, outcome("away_team")).otherwise(outcome("'Under'"))
    own_update = (
        F.col("_m.last_update")
        if "last_update" in _market_fields(payload)
        else F.lit(None).cast("string")
    )
    rows = markets.where(F.col("_m.key").isin("spreads", "totals")).select(
        *keep,
        "book",
        F.col("_m.key").alias("market"),
        main.alias("_main"),
        other.alias("_other"),
        parse_instant(F.coalesce(own_update, F.col("book_update"))).alias("last_update"),
    )
    point, price = F.col("_main.point").cast("double"), F.col("_main.price").cast("double")
    back = F.col("_other.price").cast("double")
    is_spread = F.col("market") == "spreads"
    return rows.where(F.col("_main.point").isNotNull()).select(
        *keep,
        "book",
        "market",
        point.alias("line"),
        F.when(is_spread, price).alias("home_price"),
        F.when(is_spread, back).alias("away_price"),
        F.when(~is_spread, price).alias("over_price"),
        F.when(~is_spread, back).alias("under_price"),
        "last_update",
    )


def _market_fields(payload: DataFrame) -> list[str]:
    books = payload.schema["bookmakers"].dataType.elementType
    return books["markets"].dataType.elementType.fieldNames()


def line_summary(line: str, prices: tuple[str, ...], update: str) -> list[Column]:
    """Consensus aggregates of one market. Exact percentiles merge per distinct value, map-side."""
    quartiles = F.percentile(line, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [
        F.bround(quartiles[1], 3).alias("line"),
        F.count(line).alias("book_count"),
        F.bround(F.min(line), 3).alias("line_min"),
        F.bround(F.max(line), 3).alias("line_max"),
        F.bround(quartiles[2] - quartiles[0], 3).alias("line_iqr"),
        *[F.bround(F.median(p), 3).alias(p) for p in prices],
        F.min(update).alias("oldest_update"),
        F.max(update).alias("latest_update"),
    ]


def build_consensus(quotes: DataFrame) -> DataFrame:
    """One row per (snapshot, event) with spread and total structs; the spread sign flips once."""
    keys = ["snapshot_at", "event_id", "commence_time", "home_code", "away_code"]
    per_market = quotes.groupBy(*keys, "market").agg(*line_summary("line", _PRICES, "last_update"))
    body = F.struct(*[c for c in per_market.columns if c not in (*keys, "market")])
    return (
        per_market.groupBy(*keys)
        .agg(
            F.max_by(body, F.when(F.col("market") == "spreads", 1)).alias("spread"),
            F.max_by(body, F.when(F.col("market") == "totals", 1)).alias("total"),
        )
        .withColumn("market_home_margin", F.bround(spread_to_margin(F.col("spread.line")), 3))
    )


def attach_consensus(
    predictions: DataFrame, consensus: DataFrame, as_of: Column, *, max_age: str = MAX_AGE
) -> DataFrame:
    """As-of validity join of forecasts with a consensus snapshot.

    A snapshot counts if it was taken before ``as_of``, is no older than ``max_age`` and precedes
    the kickoff (the market's own, else the schedule's). Forecasts without a valid snapshot stay,
    with null market columns. Of several events of a pairing the last in feed order wins; they
    shrink to one map-side before the join.
    """
    body = F.struct("snapshot_at", "commence_time", "market_home_margin", "market_total", "home_spread")
    last = consensus.groupBy("home_team", "away_team").agg(F.max_by(body, "ordinal").alias("m"))
    kickoff = F.coalesce(F.col("m.commence_time"), local_kickoff(F.col("gameday"), F.col("gametime")))
    taken = F.col("m.snapshot_at")
    valid = (
        (taken <= as_of)
        & (taken >= as_of - F.expr(f"INTERVAL {max_age}"))
        & (kickoff.isNull() | (taken < kickoff))
    )
    joined = predictions.join(last, ["home_team", "away_team"], "left").withColumn(
        "m", F.when(valid, F.col("m"))
    )
    home, away = score_pair(F.col("m.market_home_margin"), F.col("m.market_total"))
    both = F.col("m.market_home_margin").isNotNull() & F.col("m.market_total").isNotNull()
    return joined.withColumns(
        {
            "market_snapshot_at": F.col("m.snapshot_at"),
            "market_line": F.col("m.home_spread"),
            "market_margin": F.when(both, F.bround("m.market_home_margin", 2)),
            "market_total": F.when(both, F.bround("m.market_total", 1)),
            "market_home_score": F.when(both, F.bround(home, 1)),
            "market_away_score": F.when(both, F.bround(away, 1)),
        }
    ).drop("m")


def snapshot_plan(games: DataFrame, minutes: int = 30) -> DataFrame:
    """One request per kickoff instant, ``minutes`` before it, with the number of games it covers.

    The games of a request are found again by joining on ``kickoff_at``; they are not collected.
    """
    if minutes <= 0:
        raise ValueError("a snapshot must be requested before kickoff")
    kickoff = local_kickoff(F.col("gameday"), F.col("gametime"))
    return (
        games.withColumn("kickoff_at", kickoff)
        .where(F.col("kickoff_at").isNotNull())
        .groupBy("kickoff_at")
        .agg(F.count(F.lit(1)).alias("games"), F.min("game_id").alias("first_game"))
        .withColumn("requested_at", F.col("kickoff_at") - F.expr(f"INTERVAL {minutes} MINUTES"))
    )


def request_budget(
    plan: DataFrame, cached: DataFrame, *, regions: str = "us", markets: int = 2, max_credits: int | None = None
) -> DataFrame:
    """Requests, cache hits and the credit estimate of a plan; ``within_budget`` gates the spending."""
    region_count = max(len([r for r in regions.split(",") if r.strip()]), 1)
    marked = plan.join(
        cached.select("requested_at").distinct().withColumn("hit", F.lit(1)), "requested_at", "left"
    )
    cost = CREDITS_PER_REQUEST * region_count * markets
    totals = marked.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count("hit").alias("cache_hits"),
        ((F.count(F.lit(1)) - F.count("hit")) * cost).alias("estimated_credits"),
    )
    limit = F.lit(max_credits).cast("bigint")
    return totals.withColumn(
        "within_budget", F.coalesce(F.col("estimated_credits") <= limit, F.lit(True))
    )


def match_snapshots(games: DataFrame, events: DataFrame, minutes: int = 30) -> DataFrame:
    """Games with the event of their own snapshot request, or the reason why there is none.

    Equi-join on request and pairing, then the time conditions: the event's kickoff within six hours
    of the planned one, and the snapshot strictly before the planned kickoff.
    """
    kickoff = local_kickoff(F.col("gameday"), F.col("gametime"))
    planned = games.withColumn("kickoff_at", kickoff).withColumn(
        "requested_at", F.col("kickoff_at") - F.expr(f"INTERVAL {minutes} MINUTES")
    )
    # A request that lists a pairing twice means its last event, as when quotes are attached.
    keys = ["requested_at", "home_team", "away_team"]
    rest = [c for c in events.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct("commence_time", *[c for c in rest if c != "commence_time"]))
    events = events.groupBy(*keys).agg(last.alias("_e")).select(*keys, "_e.*")
    joined = planned.join(events, keys, "left")
    apart = F.abs(F.unix_timestamp("commence_time") - F.unix_timestamp("kickoff_at"))
    missing_line = F.col("market_home_spread").isNull() | F.col("market_total").isNull()
    return joined.withColumn(
        "miss",
        F.when(F.col("commence_time").isNull() | missing_line, F.lit("no event"))
        .when(apart > KICKOFF_TOLERANCE_SECONDS, F.lit("other kickoff"))
        .when(F.col("snapshot_at") >= F.col("kickoff_at"), F.lit("late snapshot")),
    )


def edge_table(df: DataFrame) -> DataFrame:
    """Side pick, model probability and edge for spread and total.

    Expects ``margin``, ``margin_std``, ``total``, ``total_std`` of the model and ``home_spread``,
    ``home_price``, ``away_price``, ``market_total``, ``over_price``, ``under_price`` of the market.
    """
    c = F.col
    cover = home_cover_probability(c("margin"), c("home_spread"), F.greatest(c("margin_std"), F.lit(0.01)))
    over = over_probability(c("total"), c("market_total"), F.greatest(c("total_std"), F.lit(0.01)))
    scored = df.withColumns({"home_cover": cover, "over": over})
    home, high = c("home_cover") >= 0.5, c("over") >= 0.5
    picked = scored.withColumns(
        {
            "spread_side": F.when(home, F.lit("home")).otherwise("away"),
            "spread_probability": F.when(home, c("home_cover")).otherwise(1.0 - c("home_cover")),
            "spread_fair": F.when(home, no_vig(c("home_price"), c("away_price"))).otherwise(
                no_vig(c("away_price"), c("home_price"))
            ),
            "spread_implied": implied_probability(F.when(home, c("home_price")).otherwise(c("away_price"))),
            "total_side": F.when(high, F.lit("Over")).otherwise("Under"),
            "total_probability": F.greatest(c("over"), 1.0 - c("over")),
            "total_fair": F.when(high, no_vig(c("over_price"), c("under_price"))).otherwise(
                no_vig(c("under_price"), c("over_price"))
            ),
            "total_implied": implied_probability(F.when(high, c("over_price")).otherwise(c("under_price"))),
        }
    )
    return picked.withColumns(
        {
            "spread_edge": c("spread_probability") - c("spread_fair"),
            "total_edge": c("total_probability") - c("total_fair"),
        }
    )
