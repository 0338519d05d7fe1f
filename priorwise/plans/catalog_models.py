"""Registered queries: ratings, walk-forward ridge, ensembles, ablations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from ..operators import college, ensemble, evaluate, ratings, ridge, teamform
from ..session import cut_lineage, store
from . import catalog_college as cc
from . import jobs
from .bindings import SQL_BINDINGS
from .catalog_form import _features_sql, game_features_completed
from .registry import query

# --- conjugate gradients in SQL: an independent solver for the checking engine --------------------


def cg_bindings(name: str, source: str, keys: Sequence[str], steps: int) -> None:
    """Bind ``name`` to the solution of ``a @ x = b`` per key, for ``source(keys, a, b)``."""
    k = ", ".join(keys)
    SQL_BINDINGS[f"{name}_cg"] = (
        (source,),
        f"""SELECT {k}, 0 AS it, a, list_transform(b, lambda v: 0.0::DOUBLE) AS x, b AS r, b AS p, list_inner_product(b, b) AS rs FROM {source}
        UNION ALL SELECT {k}, it + 1, a, x2, r2,
        list_transform(range(1, len(p) + 1), lambda i: r2[i] + list_inner_product(r2, r2) / rs * p[i]), list_inner_product(r2, r2)
        FROM (SELECT *, list_transform(range(1, len(p) + 1), lambda i: x[i] + al * p[i]) AS x2,
          list_transform(range(1, len(p) + 1), lambda i: r[i] - al * ap[i]) AS r2 FROM
          (SELECT *, rs / list_inner_product(p, ap) AS al FROM
            (SELECT *, list_transform(a, lambda w: list_inner_product(w, p)) AS ap FROM {name}_cg WHERE it < {steps} AND rs > 1e-22)))""",
    )
    SQL_BINDINGS[name] = (
        (f"{name}_cg",),
        f"SELECT {k}, x FROM {name}_cg QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY it DESC) = 1",
    )


# --- ratings -------------------------------------------------------------------------------------

_GROUP = ("season", "league")


def market_games(t):
    books = t.quotes.groupBy("game_id").agg(
        F.median("home_spread").alias("_s"),
        F.count(F.lit(1)).alias("book_count"),
        (F.max("home_spread") - F.min("home_spread")).alias("line_iqr"),
    )
    return t.games.join(books, "game_id").select(
        "game_id", *_GROUP, "home_team", "away_team", "book_count", "line_iqr",
        (-F.col("_s")).alias("market_home_margin"),
        F.when(F.col("neutral_site"), 0.0).otherwise(1.0).alias("home_field"),
    )


def schedule_games(t):
    return t.predictions.select(
        "game_id", *_GROUP, "home_team", "away_team", F.col("predicted_home_margin").alias("margin"),
        F.when(F.col("neutral_site"), 0.0).otherwise(1.0).alias("home_field"),
    )


SQL_BINDINGS["market_games"] = (
    ("games", "quotes"),
    """SELECT game_id, season, league, home_team, away_team, CASE WHEN neutral_site THEN 0.0 ELSE 1.0 END AS home_field, n AS book_count, iqr AS line_iqr,
    -s AS margin, CAST(n AS DOUBLE) AS weight FROM games JOIN (SELECT game_id, median(home_spread) AS s, count(*) AS n,
    max(home_spread) - min(home_spread) AS iqr FROM quotes GROUP BY 1) USING (game_id) WHERE n > 1""",
)
SQL_BINDINGS["schedule_games"] = (
    ("predictions",),
    """SELECT game_id, season, league, home_team, away_team, CASE WHEN neutral_site THEN 0.0 ELSE 1.0 END AS home_field,
    predicted_home_margin AS margin, 1.0 AS weight FROM predictions""",
)


def _normal_bindings(prefix: str, games: str, bias: bool, penalty: float) -> None:
    extra = "UNION ALL SELECT *, '~bias' AS u, 1.0 AS c FROM {g}".format(g=games) if bias else ""
    SQL_BINDINGS[f"{prefix}_x"] = (
        (games,),
        f"""SELECT *, home_team AS u, 1.0 AS c FROM {games} UNION ALL SELECT *, away_team, -1.0 FROM {games}
        UNION ALL SELECT *, '~field', home_field FROM {games} {extra}""",
    )
    SQL_BINDINGS[f"{prefix}_u"] = (
        (f"{prefix}_x",),
        f"SELECT DISTINCT season, league, u FROM {prefix}_x",
    )
    SQL_BINDINGS[f"{prefix}_n"] = (
        (f"{prefix}_x",),
        f"""SELECT a.season, a.league, a.u AS i, b.u AS j, sum(a.weight * a.c * b.c) AS v
        FROM {prefix}_x a JOIN {prefix}_x b USING (game_id) GROUP BY 1, 2, 3, 4""",
    )
    SQL_BINDINGS[f"{prefix}_system"] = (
        (f"{prefix}_n", f"{prefix}_u"),
        f"""SELECT season, league, list(i ORDER BY i) AS us, list("row" ORDER BY i) AS a, list(y ORDER BY i) AS b FROM
        (SELECT p.season, p.league, p.u AS i, list(COALESCE(n.v, 0.0) + CASE WHEN p.u = q.u AND p.u NOT LIKE '~%' THEN {penalty} ELSE 0.0 END ORDER BY q.u) AS "row",
          any_value(s.y) AS y FROM {prefix}_u p JOIN {prefix}_u q ON q.season = p.season AND q.league = p.league
          LEFT JOIN {prefix}_n n ON n.season = p.season AND n.league = p.league AND n.i = p.u AND n.j = q.u
          JOIN (SELECT season, league, u, sum(weight * c * margin) AS y FROM {prefix}_x GROUP BY 1, 2, 3) s
            ON s.season = p.season AND s.league = p.league AND s.u = p.u GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    )
    cg_bindings(f"{prefix}_solved", f"{prefix}_system", _GROUP, 120)
    SQL_BINDINGS[f"{prefix}_ratings"] = (
        (f"{prefix}_solved", f"{prefix}_system", games),
        f"""SELECT season, league, team, rating - avg(rating) OVER (PARTITION BY season, league) AS rating, hf AS home_field_points, bias AS home_bias, games FROM
        (SELECT season, league, unnest(us) AS team, unnest(x) AS rating, x[list_position(us, '~field')] AS hf,
          {"x[list_position(us, '~bias')]" if bias else "0.0"} AS bias FROM {prefix}_solved JOIN {prefix}_system USING (season, league))
        JOIN (SELECT season, league, team, count(*) AS games FROM (SELECT season, league, home_team AS team FROM {games}
          UNION ALL SELECT season, league, away_team FROM {games}) GROUP BY 1, 2, 3) USING (season, league, team)
        JOIN (SELECT season, league, count(*) AS n_games, count(DISTINCT home_team) AS n_home FROM {games} GROUP BY 1, 2) USING (season, league)
        WHERE team NOT LIKE '~%' AND n_games >= 33""",
    )


_normal_bindings("market", "market_games", False, 0.0)
_normal_bindings("schedule", "schedule_games", True, 0.25)
_RATING_SPEC = "season:i league:i team:s rating:d games:i home_field_points:d home_bias:d"


@query(
    "f11_normal_equations",
    "season:i league:i i:s j:s value:d",
    """SELECT season, league, replace(i, '~field', '+field') AS i, replace(j, '~field', '+field') AS j, v AS "value" FROM market_n""",
    "market_n",
)
def _(t):
    games = ratings.usable_games(market_games(t).withColumnRenamed("market_home_margin", "margin"))
    weighted = games.where("book_count > 1").withColumn("weight", F.col("book_count").cast("double"))
    entries = ratings.normal_entries(weighted, _GROUP, bias=False).where("j IS NOT NULL")
    named = {c: F.when(F.col(c) == ratings.HOME_FIELD, "+field").otherwise(F.col(c)) for c in ("i", "j")}
    return entries.withColumns(named)


@query("f11_market_power_ratings", _RATING_SPEC, "SELECT * FROM market_ratings", "market_ratings")
def _(t):
    return ratings.market_ratings(market_games(t), _GROUP)


@query("f14_schedule_power_ratings", _RATING_SPEC, "SELECT * FROM schedule_ratings", "schedule_ratings")
def _(t):
    return ratings.schedule_ratings(schedule_games(t), _GROUP)


def _diagnostics_sql(prefix: str, games: str, field: str, extra: str = "") -> str:
    gap = f"h.rating - a.rating + h.home_bias + h.home_field_points * {field} - g.margin"
    return f"""SELECT g.season, g.league, count(*) AS games, avg(abs({gap})) AS line_fit_mae, sqrt(avg(pow({gap}, 2))) AS line_fit_rmse{extra}
    FROM {games} g JOIN {prefix}_ratings h ON h.season = g.season AND h.league = g.league AND h.team = g.home_team
    JOIN {prefix}_ratings a ON a.season = g.season AND a.league = g.league AND a.team = g.away_team GROUP BY 1, 2"""


@query(
    "f15_market_fit_diagnostics",
    "season:i league:i games:i line_fit_mae:d line_fit_rmse:d median_book_count:d median_line_iqr:d",
    _diagnostics_sql("market", "market_games", "1.0", ", median(book_count) AS median_book_count, median(line_iqr) AS median_line_iqr"),
    "market_games market_ratings",
)
def _(t):
    games = market_games(t).where("book_count > 1")
    fitted = ratings.market_ratings(games, _GROUP)
    named = games.withColumnRenamed("market_home_margin", "margin")
    return ratings.fit_diagnostics(named, fitted, _GROUP, flag_home_field=False)


@query(
    "f15_schedule_fit_diagnostics",
    "season:i league:i games:i line_fit_mae:d line_fit_rmse:d",
    _diagnostics_sql("schedule", "schedule_games", "g.home_field"),
    "schedule_games schedule_ratings",
)
def _(t):
    games = schedule_games(t)
    return ratings.fit_diagnostics(games, ratings.schedule_ratings(games, _GROUP), _GROUP, flag_home_field=True)


@query(
    "d23_top_ratings",
    "rank:i season:i team:s rating:d",
    """SELECT row_number() OVER (ORDER BY round(rating, 9) DESC, season, team) AS rank, season, team, rating FROM schedule_ratings
    QUALIFY rank <= 30""",
    "schedule_ratings",
)
def _(t):
    from ..operators.history import top_n

    rated = ratings.schedule_ratings(schedule_games(t), _GROUP).drop("rank")
    return top_n(rated, [F.desc(F.round("rating", 9)), F.col("season"), F.col("team")], 30)


@query(
    "f12_football_form_ratings",
    "team:s rating:d rank:i",
    f"""SELECT team, rating, row_number() OVER (ORDER BY rating DESC, team) AS rank FROM (SELECT team, points_for_l4 - points_against_l4 + 8 * (off_epa_l4 - def_epa_l4)
    + 3 * (pressure_generated_l4 - pressure_allowed_l4) AS rating FROM (SELECT team, {_features_sql(lambda m: str(teamform.DEFAULT_PRIORS[m]))} FROM states
    QUALIFY row_number() OVER (PARTITION BY team ORDER BY seq DESC) = 1))""",
    "states",
)
def _(t):
    states = teamform.team_states(t.games, t.plays, plays_by="side")
    return ratings.form_ratings(teamform.team_snapshot(states))


@query(
    "f13_neutral_matchups",
    "away_team:s home_team:s",
    "SELECT DISTINCT away_team, home_team FROM games WHERE neutral_site",
    "games",
)
def _(t):
    return ratings.neutral_matchups(t.games)


@query(
    "f10_preseason_calibration",
    "game_id:i football_margin:d prior_home_margin:d calibration_weight:d predicted_home_margin:d home_score:d away_score:d forecast_method:s",
    """SELECT game_id, round_even(predicted_home_margin, 2) AS football_margin, round_even(prior, 2) AS prior_home_margin,
    w AS calibration_weight, round_even(m, 2) AS predicted_home_margin, round_even(greatest((total + m) / 2, 0), 1) AS home_score,
    round_even(greatest((total - m) / 2, 0), 1) AS away_score, CASE WHEN w > 0 THEN 'preseason calibrated' ELSE 'football only' END AS forecast_method FROM
    (SELECT *, w * prior + (1 - w) * predicted_home_margin AS m FROM
    (SELECT p.*, h.rating - a.rating + h.home_field_points * CASE WHEN neutral_site THEN 0 ELSE 1 END AS prior,
      least(greatest(1.25 - 0.25 * greatest("week", 1), 0), 1) AS w
      FROM predictions p JOIN market_ratings h ON h.season = p.season AND h.team = p.home_team
      JOIN market_ratings a ON a.season = p.season AND a.team = p.away_team))""",
    "predictions market_ratings",
)
def _(t):
    rows = t.predictions.withColumn(
        "home_field", F.when(F.col("neutral_site"), 0.0).otherwise(1.0)
    )
    latest = ratings.market_ratings(market_games(t), _GROUP)
    return ratings.calibrate_preseason(rows, latest, "2000-01-01T00:00:00Z")


# --- walk-forward ridge --------------------------------------------------------------------------

def ridge_bindings(name: str, source: str, features: Sequence[str], target: str, alpha: float, min_rows: int, keep: str) -> None:
    """Out-of-fold ridge predictions of ``source`` rows, solved by conjugate gradients."""
    q = len(features) + 2
    columns = ", ".join(f"CAST({c} AS DOUBLE)" for c in (*features, target))
    known = " AND ".join(f"{c} IS NOT NULL" for c in (*features, target))
    SQL_BINDINGS[f"{name}_z"] = (
        (source,),
        f'SELECT {keep}, season, "week", [1.0::DOUBLE, {columns}] AS z FROM {source} WHERE {known}',
    )
    SQL_BINDINGS[f"{name}_g"] = (
        (f"{name}_z",),
        f"""SELECT season, "week", list("row" ORDER BY i) AS g FROM (SELECT season, "week", i, list(v ORDER BY j) AS "row" FROM
        (SELECT season, "week", i, j, sum(v) OVER (PARTITION BY i, j ORDER BY season, "week" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM
        (SELECT season, "week", i, j, sum(z[i] * z[j]) AS v FROM {name}_z, range(1, {q + 1}) a(i), range(1, {q + 1}) b(j) GROUP BY 1, 2, 3, 4))
        WHERE v IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING max("row"[1]) FILTER (WHERE i = 1) >= {min_rows}""",
    )
    SQL_BINDINGS[f"{name}_s"] = (
        (f"{name}_g",),
        f"""SELECT *, list_transform(range(1, {q - 1}), lambda k: CASE WHEN g[k + 1][k + 1] / n - mu[k] * mu[k] <= 1e-12 * greatest(mu[k] * mu[k], 1e-12)
          THEN 1.0 ELSE sqrt(g[k + 1][k + 1] / n - mu[k] * mu[k]) END) AS sc FROM
        (SELECT season, "week", g, g[1][1] AS n, list_transform(range(1, {q - 1}), lambda k: g[1][k + 1] / g[1][1]) AS mu, g[1][{q}] / g[1][1] AS ym FROM {name}_g)""",
    )
    SQL_BINDINGS[f"{name}_system"] = (
        (f"{name}_s",),
        f"""SELECT season, "week", list_transform(range(1, {q - 1}), lambda k: list_transform(range(1, {q - 1}), lambda l:
          n * (g[k + 1][l + 1] / n - mu[k] * mu[l]) / (sc[k] * sc[l]) + CASE WHEN k = l THEN {alpha} ELSE 0.0 END)) AS a,
        list_transform(range(1, {q - 1}), lambda k: n * (g[k + 1][{q}] / n - mu[k] * ym) / sc[k]) AS b FROM {name}_s""",
    )
    cg_bindings(f"{name}_w", f"{name}_system", ("season", '"week"'), 60)
    SQL_BINDINGS[f"{name}_fit"] = (
        (f"{name}_w", f"{name}_s"),
        f"""SELECT season, "week", n, w, ym - list_inner_product(w, mu) AS c FROM
        (SELECT s.*, list_transform(range(1, {q - 1}), lambda k: f.x[k] / sc[k]) AS w FROM {name}_s s JOIN {name}_w f USING (season, "week"))""",
    )
    SQL_BINDINGS[name] = (
        (f"{name}_z", f"{name}_fit"),
        f"""SELECT {keep}, season, "week", n AS train_rows, z[{q}] AS actual, c + list_inner_product(w, z[2:{q - 1}]) AS predicted
        FROM {name}_z JOIN {name}_fit USING (season, "week")""",
    )


_ELO = college.CONFIGURATIONS["elo_context"]
_FORM = college.CONFIGURATIONS["elo_form"]
CFB_RIDGE, CFB_MIN = 50.0, 1200
SQL_BINDINGS["cdone"] = (("cfeatures",), "SELECT * FROM cfeatures WHERE completed")
ridge_bindings("ridge_elo", "cdone", _ELO, "home_margin", CFB_RIDGE, CFB_MIN, "game_id")
ridge_bindings("ridge_form", "cdone", _FORM, "home_margin", CFB_RIDGE, CFB_MIN, "game_id")
_OOF_SPEC = "game_id:i season:i week:i train_rows:i actual:d predicted:d"


def college_oof(t, specs):
    games = cc.features(t).where("completed")
    return ridge.walk_forward_predictions(games, specs, min_rows=CFB_MIN, keep=["game_id"])


@query("g01_walk_forward_ridge", _OOF_SPEC, "SELECT * FROM ridge_elo", "ridge_elo")
def _(t):
    return college_oof(t, {"elo_context": (_ELO, "home_margin", CFB_RIDGE)})


@query(
    "g01_walk_forward_coefficients",
    "season:i week:i train_rows:i intercept:d elo_weight:d",
    'SELECT season, "week", n AS train_rows, c AS intercept, w[3] AS elo_weight FROM ridge_elo_fit',
    "ridge_elo_fit",
)
def _(t):
    games = cc.features(t).where("completed")
    fits = ridge.walk_forward_fits(games, {"m": (_ELO, "home_margin", CFB_RIDGE)}, min_rows=CFB_MIN)
    return fits.withColumn("elo_weight", F.element_at("coefficients", 3))


@query(
    "g12_college_model_metrics",
    "rows:i mae:d rmse:d bias:d residual_std:d interval_80_coverage:d latest_holdout_season:i latest_holdout_rows:i latest_holdout_mae:d",
    """SELECT count(*) AS "rows", avg(abs(predicted - actual)) AS mae, sqrt(avg(pow(predicted - actual, 2))) AS rmse, avg(predicted - actual) AS bias,
    any_value(sd) AS residual_std, avg(CASE WHEN abs(actual - predicted) <= 1.2816 * sd THEN 1.0 ELSE 0.0 END) AS interval_80_coverage,
    any_value(ls) AS latest_holdout_season, count(CASE WHEN season = ls THEN 1 END) AS latest_holdout_rows,
    avg(CASE WHEN season = ls THEN abs(predicted - actual) END) AS latest_holdout_mae FROM
    (SELECT *, stddev_samp(actual - predicted) OVER () AS sd, max(season) OVER () AS ls FROM ridge_form)""",
    "ridge_form",
)
def _(t):
    oof = college_oof(t, {"elo_form": (_FORM, "home_margin", CFB_RIDGE)})
    return ensemble.ensemble_metrics(oof, forecast="predicted")


_COLLEGE_TARGETS = {"margin": "home_margin", "total": "total_points"}
_COLLEGE = [(t, n) for t in _COLLEGE_TARGETS for n in college.CONFIGURATIONS]
for _target, _name in _COLLEGE:
    ridge_bindings(f"college_{_target}_{_name}", "cdone", college.CONFIGURATIONS[_name], _COLLEGE_TARGETS[_target], CFB_RIDGE, CFB_MIN, "game_id")


def college_configurations(t):
    """Out-of-fold forecasts of every configuration on both targets, from shared Gram matrices."""
    specs = {f"{m}:{n}": (college.CONFIGURATIONS[n], _COLLEGE_TARGETS[m], CFB_RIDGE) for m, n in _COLLEGE}
    parts = F.split("model", ":")
    return college_oof(t, specs).withColumns({"target": parts[0], "configuration": parts[1]})


_COLLEGE_OOF = " UNION ALL ".join(f"SELECT '{m}' AS target, '{n}' AS model, season, predicted - actual AS e FROM college_{m}_{n}" for m, n in _COLLEGE)
_COLLEGE_USES = " ".join(f"college_{m}_{n}" for m, n in _COLLEGE)


@query(
    "h15_college_configuration_benchmark",
    "target:s model:s split:s rows:i mae:d rmse:d bias:d",
    f"""SELECT target, model, split, count(*) AS "rows", avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias FROM
    (SELECT *, unnest(['all_oof', CASE WHEN season < 2000 THEN 'development' WHEN season = 2000 THEN 'holdout' END]) AS split FROM ({_COLLEGE_OOF}))
    WHERE split IS NOT NULL GROUP BY 1, 2, 3""",
    _COLLEGE_USES,
)
def _(t):
    """Every feature configuration and both targets, before, in and over the holdout."""
    parts = college_configurations(t).groupBy("target", F.col("configuration").alias("model"), "season").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.abs(F.col("predicted") - F.col("actual"))).alias("a"),
        F.sum(F.pow(F.col("predicted") - F.col("actual"), 2)).alias("q"),
        F.sum(F.col("predicted") - F.col("actual")).alias("s"),
    )
    split = F.array(F.lit("all_oof"), F.expr("CASE WHEN season < 2000 THEN 'development' WHEN season = 2000 THEN 'holdout' END"))
    return (
        parts.withColumn("split", F.explode(split)).where("split IS NOT NULL").groupBy("target", "model", "split")
        .agg(F.sum("n").alias("rows"), (F.sum("a") / F.sum("n")).alias("mae"),
             F.sqrt(F.sum("q") / F.sum("n")).alias("rmse"), (F.sum("s") / F.sum("n")).alias("bias"))
    )


@query(
    "h15_configuration_selection",
    "target:s selected:s selected_mae:d",
    f"""SELECT target, arg_min(model, {{'m': mae, 'n': model}}) AS selected, min(mae) AS selected_mae FROM
    (SELECT target, model, avg(abs(e)) AS mae FROM ({_COLLEGE_OOF}) WHERE season < 2000 GROUP BY 1, 2) GROUP BY 1""",
    _COLLEGE_USES,
)
def _(t):
    """Of all configurations the one with the least development error, for each target."""
    mae = college_configurations(t).where("season < 2000").groupBy("target", "configuration").agg(F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae"))
    return ensemble.best_configuration(mae, "configuration", ["target"], "mae")


# Two game targets, one Gram matrix; the second candidate is a stronger penalty.
_CORE = teamform.CORE_GAME_FEATURES
ridge_bindings("nfl_a", "features", _CORE, "home_margin", 10.0, 350, "game_id")
ridge_bindings("nfl_b", "features", _CORE, "home_margin", 100.0, 350, "game_id")
ridge_bindings("nfl_t", "features", _CORE, "total_points", 50.0, 350, "game_id")


def game_oof(t, specs, keep=("game_id",)):
    return ridge.walk_forward_predictions(game_features_completed(t), specs, min_rows=350, keep=list(keep))


def _candidates(t):
    """Both margin candidates side by side, with the simple baseline of the game."""
    games = teamform.game_baselines(game_features_completed(t))
    oof = ridge.walk_forward_predictions(
        games,
        {"first": (_CORE, "home_margin", 10.0), "second": (_CORE, "home_margin", 100.0)},
        min_rows=350, keep=["game_id", "baseline_margin"],
    )
    wide = oof.groupBy("game_id", "season", "week").agg(
        F.max("actual").alias("actual"), F.max("baseline_margin").alias("baseline"),
        *[F.max(F.when(F.col("model") == m, F.col("predicted"))).alias(m) for m in ("first", "second")],
    )
    return cut_lineage(wide)


SQL_BINDINGS["candidates"] = (
    ("nfl_a", "nfl_b", "features"),
    """SELECT a.game_id, a.season, a."week", a.actual, a.predicted AS first, b.predicted AS second,
    (home_points_for_l4 - home_points_against_l4) - (away_points_for_l4 - away_points_against_l4) + 1.5 * home_field AS baseline
    FROM nfl_a a JOIN nfl_b b USING (game_id) JOIN features f USING (game_id)""",
)


@query(
    "g16_independent_oof_table",
    "game_id:i season:i week:i actual_home_margin:d independent_home_margin:d actual_total_points:d independent_total:d",
    """SELECT a.game_id, a.season, a."week", a.actual AS actual_home_margin, a.predicted AS independent_home_margin,
    b.actual AS actual_total_points, b.predicted AS independent_total FROM nfl_a a JOIN nfl_t b USING (game_id)""",
    "nfl_a nfl_t",
)
def _(t):
    oof = game_oof(t, {"margin": (_CORE, "home_margin", 10.0), "total": (_CORE, "total_points", 50.0)})
    return one_to_one(oof)


def one_to_one(oof):
    """Margin and total forecasts of a game on one row; a game without exactly one of each fails."""
    def pick(model: str, column: str):
        return F.max(F.when(F.col("model") == model, F.col(column)))

    merged = oof.groupBy("game_id", "season", "week").agg(
        pick("margin", "actual").alias("actual_home_margin"),
        pick("margin", "predicted").alias("independent_home_margin"),
        pick("total", "actual").alias("actual_total_points"),
        pick("total", "predicted").alias("independent_total"),
        F.count_if(F.col("model") == "margin").alias("_m"),
        F.count_if(F.col("model") == "total").alias("_t"),
    )
    paired = (F.col("_m") == 1) & (F.col("_t") == 1)
    bad = F.raise_error(F.concat(F.lit("not one to one: game "), F.col("game_id").cast("string")))
    checked = F.when(paired, F.col("game_id")).otherwise(bad.cast("bigint"))
    return merged.withColumn("game_id", checked).drop("_m", "_t")


@query(
    "e17_one_to_one_merge",
    "season:i games:i margin_mae:d total_mae:d",
    """SELECT a.season, count(*) AS games, avg(abs(a.predicted - a.actual)) AS margin_mae, avg(abs(b.predicted - b.actual)) AS total_mae
    FROM nfl_a a JOIN nfl_t b USING (game_id) GROUP BY 1""",
    "nfl_a nfl_t",
)
def _(t):
    oof = game_oof(t, {"margin": (_CORE, "home_margin", 10.0), "total": (_CORE, "total_points", 50.0)})
    c = F.col
    return one_to_one(oof).groupBy("season").agg(
        F.count(F.lit(1)).alias("games"),
        F.avg(F.abs(c("independent_home_margin") - c("actual_home_margin"))).alias("margin_mae"),
        F.avg(F.abs(c("independent_total") - c("actual_total_points"))).alias("total_mae"),
    )


_BLEND = """SELECT c.*, w, b, b * (w * first + (1 - w) * second) + (1 - b) * baseline AS ens FROM candidates c,
    (SELECT w, arg_min(i / 100.0, {'e': round(e, 6), 'i': i}) AS b FROM
      (SELECT w, i, sum(abs(actual - (i / 100.0 * (w * first + (1 - w) * second) + (1 - i / 100.0) * baseline))) AS e FROM candidates,
        (SELECT CASE WHEN sum(pow(first - second, 2)) > 1e-12 THEN
          least(greatest(sum((first - second) * (actual - second)) / sum(pow(first - second, 2)), 0), 1) ELSE 0.5 END AS w FROM candidates),
        range(0, 101) r(i) GROUP BY 1, 2) GROUP BY 1)"""
SQL_BINDINGS["ensemble"] = (("candidates",), _BLEND)


@query(
    "g06_ensemble_with_baseline",
    "game_id:i actual:d first_weight:d second_weight:d baseline_weight:d ensemble:d",
    "SELECT game_id, actual, b * w AS first_weight, b * (1 - w) AS second_weight, 1 - b AS baseline_weight, ens AS ensemble FROM ensemble",
    "ensemble",
)
def _(t):
    return ensemble.blend_out_of_fold(_candidates(t), baseline="baseline")


@query(
    "g06_ensemble_metrics",
    "rows:i mae:d rmse:d bias:d residual_std:d interval_80_coverage:d pinball_p10:d pinball_p90:d latest_holdout_mae:d baseline_mae:d "
    "mae_improvement_vs_baseline:d winner_brier:d winner_log_loss:d winner_calibration_error:d",
    """SELECT count(*) AS "rows", avg(abs(ens - actual)) AS mae, sqrt(avg(pow(ens - actual, 2))) AS rmse, avg(ens - actual) AS bias, any_value(sd) AS residual_std,
    avg(CASE WHEN abs(actual - ens) <= 1.2816 * sd THEN 1.0 ELSE 0.0 END) AS interval_80_coverage,
    avg(greatest(0.1 * (actual - ens + 1.2816 * sd), -0.9 * (actual - ens + 1.2816 * sd))) AS pinball_p10,
    avg(greatest(0.9 * (actual - ens - 1.2816 * sd), -0.1 * (actual - ens - 1.2816 * sd))) AS pinball_p90,
    avg(CASE WHEN season = ls THEN abs(ens - actual) END) AS latest_holdout_mae, avg(abs(baseline - actual)) AS baseline_mae,
    avg(abs(baseline - actual)) - avg(abs(ens - actual)) AS mae_improvement_vs_baseline, avg(pow(p - o, 2)) AS winner_brier,
    -avg(o * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - o) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6))) AS winner_log_loss,
    (SELECT sum(abs(sp - so)) / sum(n) FROM (SELECT sum(p) AS sp, sum(o) AS so, count(*) AS n FROM pe GROUP BY least(CAST(floor(p * 10) AS INTEGER), 9))) AS winner_calibration_error
    FROM pe""",
    "pe",
)
def _(t):
    blended = cut_lineage(ensemble.blend_out_of_fold(_candidates(t), baseline="baseline"))
    return ensemble.ensemble_metrics(blended, baseline="baseline", winner=True)


from .bindings import sql_cdf  # noqa: E402

SQL_BINDINGS["pe"] = (
    ("ensemble",),
    f"""SELECT *, {sql_cdf('(ens / sd)')} AS p, CASE WHEN actual > 0 THEN 1.0 ELSE 0.0 END AS o FROM
    (SELECT *, stddev_samp(actual - ens) OVER () AS sd, max(season) OVER () AS ls FROM ensemble)""",
)


_PENALTIES = (10.0, 30.0, 50.0, 100.0)
_TARGETS = {"margin": "home_margin", "total": "total_points"}
for _target, _column in _TARGETS.items():
    for _alpha in _PENALTIES:
        ridge_bindings(f"tune_{_target}_{_alpha:g}", "features", _CORE, _column, _alpha, 350, "game_id")



def full_fit_bindings(name: str, source: str, where: str, features: Sequence[str], targets: dict[str, str], alpha: float, min_rows: int) -> None:
    """Bind ``<name>_<model>`` to the fit of each target on all rows: the walk-forward fit of a week after the last."""
    columns = [*features, *targets.values()]
    own = [c for c in dict.fromkeys(columns) if c not in ("season", "week")]
    SQL_BINDINGS[f"{name}_rows"] = (
        (source,),
        f"""SELECT game_id, season, "week", {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in own)} FROM {source} WHERE {where}
        UNION ALL SELECT -1, 9999, 1, {', '.join('0.0' for _ in own)}""",
    )
    for model, target in targets.items():
        ridge_bindings(f"{name}_{model}", f"{name}_rows", features, target, alpha, min_rows, "game_id")
        SQL_BINDINGS[f"{name}_{model}_last"] = ((f"{name}_{model}_fit",), f"SELECT n, c, w FROM {name}_{model}_fit WHERE season = 9999")


full_fit_bindings("game", "features", "home_margin IS NOT NULL", _CORE, _TARGETS, 50.0, 350)


@query(
    "g02_standardized_ridge_fit",
    "feature:s coefficient:d train_rows:i",
    f"SELECT unnest([{', '.join(repr(f) for f in ['intercept', *_CORE])}]) AS feature, unnest(list_concat([c], w)) AS coefficient, n AS train_rows FROM game_margin_last",
    "game_margin_last",
)
def _(t):
    fit = ridge.full_fits(game_features_completed(t), {"m": (_CORE, "home_margin", 50.0)})
    named = F.arrays_zip(F.array(*[F.lit(f) for f in ["intercept", *_CORE]]).alias("feature"),
                         F.concat(F.array("intercept"), "coefficients").alias("coefficient"))
    return fit.select("train_rows", F.inline(named))


_SETS = ensemble.group_combinations(_CORE, teamform.CANDIDATE_GROUPS)
_ABLATION = [(m, k, n) for m in _TARGETS for k, n in enumerate(_SETS)]
for _target, _k, _name in _ABLATION:
    ridge_bindings(f"ablation_{_target}_{_k}", "features", _SETS[_name], _TARGETS[_target], 10.0, 350, "game_id")


@query(
    "h12_feature_group_ablation",
    "target:s model:s rows:i mae:d mae_change:d",
    """SELECT target, model, n AS "rows", mae, mae - max(CASE WHEN model = 'core' THEN mae END) OVER (PARTITION BY target) AS mae_change FROM ("""
    + " UNION ALL ".join(f"SELECT '{m}' AS target, '{n}' AS model, count(*) AS n, avg(abs(predicted - actual)) AS mae FROM ablation_{m}_{k}" for m, k, n in _ABLATION)
    + ")",
    " ".join(f"ablation_{m}_{k}" for m, k, _ in _ABLATION),
)
def _(t):
    """Sixteen feature sets times two targets from one Gram matrix over all their features."""
    sets = ensemble.group_combinations(_CORE, teamform.CANDIDATE_GROUPS)
    return _ablation(game_features_completed(t), sets, 10.0)


def _ablation(games, sets, alpha):
    specs = {
        f"{target}:{name}": (names, column, alpha)
        for target, column in (("margin", "home_margin"), ("total", "total_points"))
        for name, names in sets.items()
    }
    oof = ridge.walk_forward_predictions(games, specs, min_rows=350, keep=["game_id"])
    mae = oof.groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae")
    ).withColumns({"target": F.split_part("model", F.lit(":"), F.lit(1)), "model": F.split_part("model", F.lit(":"), F.lit(2))})
    return ensemble.change_versus(mae, "model", "core", ["target"])


@query(
    "h14_penalty_tuning",
    "model:s season:i rows:i mae:d",
    " UNION ALL ".join(
        f"SELECT '{m}:{a:g}' AS model, season, count(*) AS \"rows\", avg(abs(predicted - actual)) AS mae FROM tune_{m}_{a:g} GROUP BY 2"
        for m in _TARGETS for a in _PENALTIES
    ),
    " ".join(f"tune_{m}_{a:g}" for m in _TARGETS for a in _PENALTIES),
)
def _(t):
    """Every penalty of the tuning candidates on both targets."""
    oof = game_oof(t, {f"{m}:{a:g}": (_CORE, c, a) for m, c in _TARGETS.items() for a in _PENALTIES})
    return oof.groupBy("model", "season").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae")
    )


@query(
    "g11_score_forecasts",
    "game_id:i margin_forecast:d total_forecast:d home_score_forecast:d away_score_forecast:d",
    """SELECT a.game_id, round_even(a.predicted, 2) AS margin_forecast, round_even(greatest(b.predicted, 0), 1) AS total_forecast,
    round_even(greatest((b.predicted + a.predicted) / 2, 0), 1) AS home_score_forecast,
    round_even(greatest((b.predicted - a.predicted) / 2, 0), 1) AS away_score_forecast FROM nfl_a a JOIN nfl_t b USING (game_id)""",
    "nfl_a nfl_t",
)
def _(t):
    oof = game_oof(t, {"margin": (_CORE, "home_margin", 10.0), "total": (_CORE, "total_points", 50.0)})
    return ensemble.score_forecasts(one_to_one(oof), "independent_home_margin", "independent_total")


full_fit_bindings("asof", "cdone", "start_date <= TIMESTAMP '2000-06-30'", _ELO, _COLLEGE_TARGETS, CFB_RIDGE, CFB_MIN)


@query(
    "g13_learned_in_two_runs",
    "model:s train_rows:i intercept:d elo_weight:d new_rows:i",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS model, n AS train_rows, c AS intercept, w[3] AS elo_weight,
        (SELECT count(*) FROM cdone WHERE start_date > TIMESTAMP '1999-12-31' AND start_date <= TIMESTAMP '2000-06-30') AS new_rows FROM asof_{m}_last"""
        for m in _COLLEGE_TARGETS
    ),
    " ".join(f"asof_{m}_last" for m in _COLLEGE_TARGETS) + " cdone",
)
def _(t):
    """A second weekly run reads only the games that the first hasn't learned, and fits as one over all of them would."""
    needed = dict.fromkeys(["game_id", *ridge.FOLD, "start_date", *_ELO, *_COLLEGE_TARGETS.values()])
    rows = store(cc.features(t).where("completed").select(*needed))
    specs = {m: (_ELO, c, CFB_RIDGE) for m, c in _COLLEGE_TARGETS.items()}
    root = jobs.shared_root(t.spark)
    for day in ("1999-12-31", "2000-06-30", "2000-06-30"):  # the last run is repeated
        new = ridge.learn_new_rows(rows.where(F.col("start_date") <= F.to_timestamp(F.lit(day))), specs, root, f"upto-{day}", id_col="game_id")
    fits = ridge.learned_fits(t.spark, specs, root, min_rows=CFB_MIN).withColumn("elo_weight", F.element_at("coefficients", 3))
    return fits.crossJoin(F.broadcast(new.agg(F.count(F.lit(1)).alias("new_rows"))))  # a single row
