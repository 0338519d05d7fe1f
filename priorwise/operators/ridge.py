"""Walk-forward ridge regression from sufficient statistics.

A ridge fit needs only the Gram matrix of its rows. Gram matrices of disjoint weeks add up, so the
fit for every week comes from one pass over the rows, a running sum over weeks and one small solve
per week. Rows are never re-read per fold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, store
from ..sources.releases import publish_together, read_published, releases

FOLD = ("season", "week")


def known(columns: Iterable[str]) -> str:
    """Whether none of the columns is null or NaN."""
    return " AND ".join(f"{c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))" for c in sorted(columns))


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which none of ``columns`` is null or NaN."""
    return df.where(known(columns))


def check_features(df: DataFrame, features: Sequence[str], what: str = "model") -> None:
    """Fail early, naming the features a frame lacks."""
    missing = sorted(set(features) - set(df.columns))
    if missing:
        raise ValueError(f"missing features for {what}: {missing}")


def _gram_task(keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            values = batch.drop(columns=keys).to_numpy(dtype=float)
            rows = np.column_stack([np.ones(len(values)), values])
            groups = batch.groupby(keys, sort=False).indices if keys else {(): np.arange(len(rows))}
            for key, index in groups.items():
                part = rows[index].T @ rows[index]
                before = totals.get(key)
                totals[key] = part if before is None else before + part
        out = [
            {**dict(zip(keys, key if isinstance(key, tuple) else (key,), strict=True)), "gram": g.ravel()}
            for key, g in totals.items()
        ]
        if out:
            yield pd.DataFrame(out)

    return run


#: Column that tells which models have all their columns in a row, a bit each, for so many sets of columns.
PATTERN, MOST_SETS = "_pattern", 62
#: Cells of a matrix that run over the weeks together.
PIECE = 512


def column_sets(specs: Mapping[str, Spec]) -> list[frozenset[str]]:
    """Distinct sets of columns of the models; a model's bit in a pattern is the place of its set."""
    return list(dict.fromkeys(frozenset([*features, target]) for features, target, _ in specs.values()))


def patterned_rows(df: DataFrame, specs: Mapping[str, Spec]) -> DataFrame:
    """Rows that some model can use, with their pattern; missing values of the other models' columns become 0."""
    sets = column_sets(specs)
    columns = sorted(frozenset().union(*sets))
    bits = F.lit(0).cast("bigint")
    for k, own in enumerate(sets):
        bits = bits + F.when(F.expr(known(own)), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    # The pattern is taken from the values as they came, hence before they are filled.
    marked = df.withColumn(PATTERN, bits).where(f"{PATTERN} <> 0")
    filled = {c: F.expr(f"COALESCE(NULLIF(CAST({c} AS DOUBLE), CAST('NaN' AS DOUBLE)), 0D)") for c in columns if c not in FOLD}
    return marked.withColumns(filled)


def _sum_task(keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *key, gram in batch[[*keys, "gram"]].itertuples(index=False):
                before = totals.get(tuple(key))
                totals[tuple(key)] = np.asarray(gram) if before is None else before + gram
        if totals:
            yield pd.DataFrame([{**dict(zip(keys, key, strict=True)), "gram": g} for key, g in totals.items()])

    return run


def fold_grams(df: DataFrame, features: Sequence[str], targets: Sequence[str], keys: Sequence[str] = (*FOLD, PATTERN)) -> DataFrame:
    """Gram matrix of ``[1, features, targets]`` per key: (key..., gram), the rows of a matrix one after another.

    Each task multiplies its own rows and gives one matrix per key it saw; the matrices of a key are added in
    the task that the key is dealt to. Traffic depends on tasks and folds only.
    """
    names = list(keys)
    # Positional names: a fold key such as the week may be a feature as well.
    columns = [F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate((*features, *targets))]
    kinds = {k: "bigint" if k == PATTERN else "int" for k in names}
    rows = df.select(*[F.col(k).cast(kind).alias(k) for k, kind in kinds.items()], *columns)
    schema = ", ".join([*(f"{k} {kind}" for k, kind in kinds.items()), "gram array<double>"])
    return rows.mapInPandas(_gram_task(names), schema).repartition(*names).mapInPandas(_sum_task(names), schema)


def _before_task(cells: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Sums of the pieces that came before, for pieces in the order of their folds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, total = None, np.empty(0)
        for batch in batches:
            sums = []
            for pattern, piece, values in zip(batch[PATTERN], batch["piece"], batch["value"], strict=True):
                if (pattern, piece) != place:
                    place, total = (pattern, piece), np.zeros(min(PIECE, cells - piece * PIECE))
                sums.append(total)
                if values is not None:
                    total = total + values
            yield batch.assign(value=sums)

    return run


def expanding_grams(grams: DataFrame, cells: int) -> DataFrame:
    """Per (season, week) the Gram matrices of all strictly earlier weeks, as pieces of each pattern.

    ``grams`` is read three times and must be stored. A week without rows of a pattern still carries the
    pattern's earlier sums. Matrices are cut in pieces, and each piece runs over the weeks in a task of its own.
    """
    weeks, kinds = grams.select(*FOLD).distinct(), grams.select(PATTERN).distinct()
    every = weeks.crossJoin(F.broadcast(kinds)).join(grams, [*FOLD, PATTERN], "left")  # weeks times a few patterns
    places = F.sequence(F.lit(0), F.lit((cells - 1) // PIECE))
    cut = F.transform(places, lambda i: F.slice("gram", i * PIECE + 1, PIECE))
    pieces = every.select(*FOLD, PATTERN, F.posexplode(cut).alias("piece", "value"))
    dealt = pieces.repartition(PATTERN, "piece").sortWithinPartitions(PATTERN, "piece", *FOLD)
    before = dealt.mapInPandas(_before_task(cells), f"season int, week int, {PATTERN} bigint, piece int, value array<double>")
    return before.groupBy(*FOLD).agg(F.collect_list(F.struct(F.col(PATTERN).alias("pattern"), "piece", "value")).alias("grams"))


def solve_ridge(gram: np.ndarray, picks: Sequence[int], target: int, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of standardized ridge, from a Gram matrix with a leading 1."""
    n = gram[0, 0]
    index = list(picks)
    mean, y_mean = gram[0, index] / n, gram[0, target] / n
    cov = gram[np.ix_(index, index)] / n - np.outer(mean, mean)
    cross = gram[index, target] / n - mean * y_mean
    variance = np.diag(cov).copy()
    flat = variance <= 1e-12 * np.maximum(mean * mean, 1e-12)
    scale = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, variance)))
    standard = cov / np.outer(scale, scale)
    # A constant feature carries no information; rounding must not make it look otherwise.
    standard[flat, :] = 0.0
    standard[:, flat] = 0.0
    right = np.where(flat, 0.0, cross / scale)
    weights = np.linalg.solve(n * standard + alpha * np.eye(len(index)), n * right) / scale
    return float(y_mean - weights @ mean), weights


#: A model specification: its features, target and penalty.
Spec = tuple[Sequence[str], str, float]


def _solve_task(specs: Mapping[str, Spec], columns: list[str], keys: list[str], min_rows: int):
    place = {c: i + 1 for i, c in enumerate(columns)}
    size = len(columns) + 1
    sets = column_sets(specs)
    bit = {name: 1 << sets.index(frozenset([*fs, t])) for name, (fs, t, _) in specs.items()}

    def whole(pieces) -> list[tuple[int, np.ndarray]]:
        parts: dict[int, list] = {}
        for g in sorted(pieces, key=lambda g: g["piece"]):
            parts.setdefault(g["pattern"], []).append(np.asarray(g["value"], dtype=float))
        return [(p, np.concatenate(values).reshape(size, size)) for p, values in parts.items()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                parts = whole(row.grams)
                sums: dict[int, np.ndarray] = {}
                for name, (features, target, alpha) in specs.items():
                    own = bit[name]
                    if own not in sums:
                        sums[own] = sum((g for p, g in parts if p & own), np.zeros((size, size)))
                    gram = sums[own]
                    if gram[0, 0] < max(min_rows, 1):
                        continue
                    intercept, weights = solve_ridge(gram, [place[f] for f in features], place[target], alpha)
                    out.append(
                        {
                            **{k: getattr(row, k) for k in keys},
                            "model": name,
                            "train_rows": int(gram[0, 0]),
                            "intercept": intercept,
                            "coefficients": weights,
                        }
                    )
            if out:
                yield pd.DataFrame(out)

    return run


_SOLUTION = "model string, train_rows bigint, intercept double, coefficients array<double>"


def _union(specs: Mapping[str, Spec]) -> tuple[list[str], list[str]]:
    features = list(dict.fromkeys(f for fs, _, _ in specs.values() for f in fs))
    targets = list(dict.fromkeys(t for _, t, _ in specs.values()))
    return features, targets


def _batches_of(specs: Mapping[str, Spec]) -> list[dict[str, Spec]]:
    """The specifications in lots of at most ``MOST_SETS`` sets of columns."""
    sets = column_sets(specs)
    lots: dict[int, dict[str, Spec]] = {}
    for name, spec in specs.items():
        lots.setdefault(sets.index(frozenset([*spec[0], spec[1]])) // MOST_SETS, {})[name] = spec
    return list(lots.values())


def walk_forward_fits(df: DataFrame, specs: Mapping[str, Spec], *, min_rows: int) -> DataFrame:
    """Coefficients per (season, week, model), fitted on strictly earlier weeks only.

    Feature sets, targets and penalties share Gram matrices over all their columns, one for each pattern of
    missing values; a model leaves out only rows that miss one of its own columns. The matrices of the weeks
    are stored once.
    """
    check_features(df, [c for part in _union(specs) for c in part])
    out = None
    for lot in _batches_of(specs):
        features, targets = _union(lot)
        grams = cut_lineage(fold_grams(patterned_rows(df, lot), features, targets))
        task = _solve_task(lot, [*features, *targets], list(FOLD), min_rows)
        cells = (len(features) + len(targets) + 1) ** 2
        part = expanding_grams(grams, cells).mapInPandas(task, f"season int, week int, {_SOLUTION}")
        out = part if out is None else out.unionByName(part)
    return out


def _solved(grams: DataFrame, lot: Mapping[str, Spec], min_rows: int) -> DataFrame:
    """Fits of a lot of models from one Gram matrix for each pattern."""
    features, targets = _union(lot)
    one = grams.agg(F.collect_list(F.struct(F.col(PATTERN).alias("pattern"), F.lit(0).alias("piece"), F.col("gram").alias("value"))).alias("grams"))
    return one.mapInPandas(_solve_task(lot, [*features, *targets], [], min_rows), _SOLUTION)


def full_fits(df: DataFrame, specs: Mapping[str, Spec], *, min_rows: int = 1) -> DataFrame:
    """One set of coefficients per model, fitted on all rows that have the model's columns."""
    check_features(df, [c for part in _union(specs) for c in part])
    out = None
    for lot in _batches_of(specs):
        part = _solved(fold_grams(patterned_rows(df, lot), *_union(lot), keys=(PATTERN,)), lot, min_rows)
        out = part if out is None else out.unionByName(part)
    return out


def _state_of(specs: Mapping[str, Spec], root: str) -> str:
    """The folder of the state of these very models."""
    text = repr([(name, list(features), target) for name, (features, target, _) in specs.items()])
    return f"{root.rstrip('/')}/{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def learn_new_rows(df: DataFrame, specs: Mapping[str, Spec], root: str, release: str, *, id_col: str) -> DataFrame:
    """Add the rows that no release before has learned to the state of the models; returns their ids.

    The state is append-only: each release adds the Gram matrices of its weeks and the ids of its rows, published
    together. A row that comes late is learned late; one that was learned isn't read again for its columns. A
    release that was published before is left as it is, so a run can be repeated.
    """
    check_features(df, [id_col, *[c for part in _union(specs) for c in part]])
    spark, state = df.sparkSession, _state_of(specs, root)
    if not releases(spark, state, release).get(release):
        rows = df.where(" OR ".join(f"({known(own)})" for own in column_sets(specs)))
        if releases(spark, state):
            rows = rows.join(read_published(spark, state, "ids").select(id_col), id_col, "left_anti")
        rows = store(rows.select(*dict.fromkeys([id_col, *FOLD, *[c for part in _union(specs) for c in part]])))
        tables = {"ids": rows.select(id_col, *[c for c in FOLD if c != id_col])}
        for k, lot in enumerate(_batches_of(specs)):
            tables[f"grams{k}"] = fold_grams(patterned_rows(rows, lot), *_union(lot))
        publish_together(spark, tables, state, release)
    return read_published(spark, state, "ids", release)


def learned_fits(spark: SparkSession, specs: Mapping[str, Spec], root: str, *, min_rows: int = 1) -> DataFrame:
    """Fits on all rows that the state has learned so far, from its Gram matrices alone."""
    out, state = None, _state_of(specs, root)
    for k, lot in enumerate(_batches_of(specs)):
        grams = read_published(spark, state, f"grams{k}").select(PATTERN, "gram").repartition(PATTERN)
        part = _solved(grams.mapInPandas(_sum_task([PATTERN]), f"{PATTERN} bigint, gram array<double>"), lot, min_rows)
        out = part if out is None else out.unionByName(part)
    return out


def linear_prediction(features: Sequence[str]) -> Column:
    """Prediction of a row joined with its ``intercept`` and ``coefficients``."""
    terms = [
        F.col(f).cast("double") * F.element_at("coefficients", i + 1) for i, f in enumerate(features)
    ]
    return sum(terms, F.col("intercept"))


def walk_forward_predictions(
    df: DataFrame, specs: Mapping[str, Spec], *, min_rows: int, keep: Sequence[str], stored: bool = False
) -> DataFrame:
    """Out-of-fold predictions in long form: ``keep``, season, week, model, train_rows, actual, predicted.

    A table that is ``stored`` isn't stored again. The fits of a week travel to its rows as one array. A row's features are an array too, so the plan is the
    same for one model and for many, and rows multiply only in what comes out.
    """
    features, targets = _union(specs)
    check_features(df, [*features, *targets])
    # The feature table is read twice, for the Gram matrices and for the predictions. Building it
    # is the expensive part, so it is written once to the shared checkpoint folder, if it isn't there yet.
    needed = list(dict.fromkeys([*keep, *FOLD, *features, *targets]))
    usable = " OR ".join(f"({known(own)})" for own in column_sets(specs))
    rows = df.where(usable).select(*needed)
    rows = rows if stored else store(rows)
    fits = walk_forward_fits(rows, specs, min_rows=min_rows)

    place, at = {c: i for i, c in enumerate(features)}, {c: i for i, c in enumerate(targets)}
    ways = [
        F.struct(F.lit(name).alias("model"), F.array(*[F.lit(place[f]) for f in names]).alias("of"), F.lit(at[target]).alias("target"))
        for name, (names, target, _) in specs.items()
    ]
    way = F.element_at(F.map_from_entries(F.array(*[F.struct(w["model"], w) for w in ways])), F.col("model"))
    one = F.struct("model", "train_rows", "intercept", "coefficients", way["of"].alias("of"), way["target"].alias("target"))
    weekly = fits.groupBy(*FOLD).agg(F.collect_list(one).alias("_fits"))
    joined = rows.select(
        *[c for c in dict.fromkeys([*keep, *FOLD])],
        F.array(*[F.col(f).cast("double") for f in features]).alias("_x"),
        F.array(*[F.col(t).cast("double") for t in targets]).alias("_y"),
    ).join(F.broadcast(weekly), list(FOLD))  # one row per week

    def scored(fit: Column) -> Column:
        total = F.aggregate(
            F.zip_with(fit["of"], fit["coefficients"], lambda i, w: F.get("_x", i) * w), fit["intercept"], lambda a, v: a + v
        )
        return F.struct(fit["model"].alias("model"), fit["train_rows"].alias("train_rows"), F.get("_y", fit["target"]).alias("actual"), total.alias("predicted"))

    out = joined.select(*dict.fromkeys([*keep, *FOLD]), F.inline(F.transform("_fits", scored)))
    return complete_rows(out, ["actual", "predicted"])  # a model forecasts the rows that have its columns
