"""Text quality by a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins; the model is a table of additions per feature and per chosen pair
of features. The tables are learned by cyclic boosting: in turn, each feature gets a shallow tree fitted
to the current residuals, added to its table with a small weight. Pairs are ranked by what a table of the
pair would still explain and are then boosted the same way. A score is the logistic of the summed additions.

The model is fitted on at most ``MAX_TRAIN`` labelled rows, chosen by a hash of the id; features and scores
are computed for every row and whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import partial
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorwise.llm.common import Batches, packed, utf8

MAX_TRAIN = 20_000
BINS, PAIR_BINS, PAIRS = 64, 12, 12
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 200, 60, 0.1, 4
THRESHOLD = 0.3

NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
NOT_LOWER = bytes(b for b in range(256) if not 97 <= b <= 122)
NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
MARKS = b"#$%&*@^~=<>{}[]\\_+"
NOT_MARK = bytes(b for b in range(256) if b not in MARKS)
ASCII = bytes(range(128))
END = re.compile(rb"[.!?:;\"')]\s*$")
FEATURES = (
    "log_bytes", "log_words", "mean_word", "upper_share", "digit_share", "mark_share", "pipes_per_word", "exclaims_per_word",
    "distinct_share", "top_share", "repeat_share", "distinct_pairs", "line_repeat_share", "words_per_line", "open_line_share",
    "capital_share", "stops_per_word", "commas_per_word", "short_share", "beyond_ascii_share", "longest_word", "letter_share",
)


def features(text: bytes) -> tuple[float, ...]:
    """Shape of one text; every ratio of an empty text is 0."""
    words = text.split()
    n, size = len(words), len(text)
    some, m = max(n, 1), max(size, 1)
    upper, lower = size - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")), size - len(text.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    beyond = len(text.translate(None, ASCII))
    lengths = list(map(len, words))
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(len(lines), 1)
    return (
        np.log1p(size),
        np.log1p(n),
        sum(lengths) / some,
        upper / max(upper + lower, 1),
        len(text.translate(None, NOT_DIGIT)) / m,
        len(text.translate(None, NOT_MARK)) / m,
        text.count(b"|") / some,
        text.count(b"!") / some,
        len(seen) / some,
        max(seen.values(), default=0) / some,
        sum(a == b for a, b in pairwise(words)) / some,
        len(set(pairwise(words))) / some,
        (len(lines) - len(set(lines))) / k,
        n / k,
        sum(not END.search(x[-8:]) for x in lines) / k,
        sum(65 <= w[0] <= 90 for w in words) / some,
        text.count(b".") / some,
        text.count(b",") / some,
        sum(x <= 3 for x in lengths) / some,
        beyond / m,
        max(lengths, default=0),
        (upper + lower + beyond) / m,
    )


@dataclass
class AdditiveModel:
    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[k], x[:, k], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_cuts[a], x[:, a], side="right"), np.searchsorted(self.pair_cuts[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Additions of each bin of one feature by a tree that splits the best leaf again and again."""
    g, h = np.concatenate(([0.0], np.cumsum(gradient))), np.concatenate(([0.0], np.cumsum(weight)))

    def gain(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        c = np.arange(a + 1, b)
        value = (g[c] - g[a]) ** 2 / (h[c] - h[a] + 1) + (g[b] - g[c]) ** 2 / (h[b] - h[c] + 1) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1)
        k = int(value.argmax())
        return float(value[k]), int(c[k])

    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        best, cut, part = max((*gain(*p), p) for p in parts)
        if best <= 1e-9:
            break
        parts.remove(part)
        parts += [(part[0], cut), (cut, part[1])]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1)
    return out


def _pair_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and additions of a tree over two features: a cut of one, then a cut of the other on either side."""
    best, out = -1.0, np.zeros_like(gradient)
    for turned in (False, True):
        gr, we = (gradient.T, weight.T) if turned else (gradient, weight)
        for cut in range(1, len(gr)):
            low, high = _tree(gr[:cut].sum(0), we[:cut].sum(0), 2), _tree(gr[cut:].sum(0), we[cut:].sum(0), 2)
            value = float(low @ gr[:cut].sum(0) + high @ gr[cut:].sum(0))
            if value > best:
                table = np.vstack([np.tile(low, (cut, 1)), np.tile(high, (len(gr) - cut, 1))])
                best, out = value, table.T if turned else table
    return best, out


def fit_tables(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boost the tables on a bounded sample. Labels of one class or none give a constant score."""
    if not len(y) or y.min() == y.max():
        return AdditiveModel(intercept=0.0 if not len(y) else 4.0 if y[0] else -4.0)
    rate = y.mean()
    model = AdditiveModel(float(np.log(rate / (1 - rate))), [_cuts(v, BINS) for v in x.T], [_cuts(v, PAIR_BINS) for v in x.T])
    binned = [np.searchsorted(c, v, side="right") for c, v in zip(model.cuts, x.T, strict=True)]
    coarse = [np.searchsorted(c, v, side="right") for c, v in zip(model.pair_cuts, x.T, strict=True)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(y), model.intercept)

    def residual():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            r, h = residual()
            step = RATE * _tree(np.bincount(binned[k], r, len(table)), np.bincount(binned[k], h, len(table)), LEAVES)
            table += step
            total += step[binned[k]]

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        wide = len(model.pair_cuts[b]) + 1
        return np.bincount(coarse[a] * wide + coarse[b], values, (len(model.pair_cuts[a]) + 1) * wide).reshape(-1, wide)

    r, h = residual()
    ranked = sorted(((-_pair_tree(grid(a, b, r), grid(a, b, h))[0], a, b) for a, b in combinations(range(x.shape[1]), 2)))
    model.pairs = [(a, b) for _, a, b in ranked[:PAIRS]]
    model.pair_tables = [np.zeros((len(model.pair_cuts[a]) + 1, len(model.pair_cuts[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            r, h = residual()
            step = RATE * _pair_tree(grid(a, b, r), grid(a, b, h))[1]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def _features(batches: Batches) -> Batches:
    for batch in batches:
        x = [features(t) for t in utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("y")], names=["x", "y"])


def _score(batches: Batches, model: AdditiveModel) -> Batches:
    for batch in batches:
        x = np.array([features(t) for t in utf8(batch.column("text"))]).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(model.score(x), pa.float64())], names=["doc", "score"])


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, max_train: int = MAX_TRAIN, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """Fit on the labelled rows that ``train`` (a column over the id) holds for, ``max_train`` at most, the least by a hash of the id.

    Rows without an id or a label are not used; an id labelled twice counts twice. Of rows with the same id the
    one with the least hash of its text stands for all, so that no more than ``max_train`` rows reach the driver.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("double").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isNotNull())
    sample = known.filter(train).orderBy(F.xxhash64("id"), "id", "y").limit(max_train)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marks = sample.groupBy("id").agg(F.sort_array(F.collect_list("y")).alias("ys"))
    whole = F.coalesce("text", F.lit(""))
    least = F.min_by(whole, F.struct(F.xxhash64(whole), whole)).alias("text")
    one = texts.join(F.broadcast(marks), "id").groupBy("id", "ys").agg(least)  # the broadcast side has max_train labels at most
    rows = one.select("text", F.explode("ys").alias("y"))
    got = rows.select("text", "y").mapInArrow(_features, "x array<double>, y double").collect()
    order = sorted(((tuple(r["x"]), r["y"]) for r in got))
    x, y = np.array([a for a, _ in order]).reshape(-1, len(FEATURES)), np.array([b for _, b in order])
    return fit_tables(x, y)


def score_quality(docs: DataFrame, model: AdditiveModel, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``doc``, with ``score`` (0 to 1). A null text counts as empty."""
    rows = packed(docs, text=F.col(f"`{text_col}`"))
    kind = T.StructType([rows.schema["doc"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(partial(_score, model=model), kind)


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold."""
    return score_quality(docs, model, text_col).filter(F.col("score") >= threshold).select("doc.*")
