"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent n-grams of letters, by rank. A document's own most
frequent n-grams are compared with each profile by the out-of-place distance: the sum over its n-grams of
the difference of ranks, or the greatest difference if the profile lacks the n-gram.

N-grams are of one to three UTF-8 bytes of the lowered words, with a space on either side of a word. All
labelled documents are counted; profiles are as small as the number of languages times their length.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorwise.llm.common import Batches, packed, slices, utf8

PROFILE = 400
MAX_LANGUAGES = 5000  # fitting stops with an error beyond: so many profiles would not be small
SLICE_BYTES = 1 << 20
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
ASCII_LETTER = re.compile(rb"[A-Za-z]")
UNKNOWN = "und"


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "ignore")))


def ngram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, n-gram code and count of the n-grams of a few texts."""
    marked = [b" " + b" ".join(t.translate(LETTERS).split()) + b" " for t in texts]
    flat = np.frombuffer(b"".join(marked), dtype=np.uint8)
    symbols = np.flatnonzero(np.bincount(flat, minlength=256))
    width = len(symbols)
    dense = np.zeros(256, dtype=np.uint64)
    dense[symbols] = np.arange(width)
    flat = dense[flat]
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(m) for m in marked])
    rows, codes, counts = [], [], []
    for n in (1, 2, 3):
        m = len(flat) - n + 1
        if m <= 0:
            break
        key = row[:m]
        for k in range(n):
            key = key * np.uint64(width) + flat[k : k + m]
        inside = row[:m] == row[n - 1 :]
        if n == 1:
            inside &= flat != dense[32]
        small = np.uint32 if len(texts) * width**n < 2**32 else np.uint64  # narrow numbers sort much faster
        found, count = np.unique(key[inside].astype(small), return_counts=True)
        code, found = np.full(len(found), n, np.int64), found.astype(np.int64)
        for k in range(n - 1, -1, -1):
            code = code << 8 | symbols[found // width**k % width]
        rows.append(found // width**n)
        codes.append(code)
        counts.append(count)
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(counts)


def text_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for texts of any length: a text longer than a slice is counted in pieces that end at words."""
    if len(texts) > 1 or len(texts[0]) <= 2 * SLICE_BYTES:
        return ngram_counts(texts)
    text, start, pieces = texts[0], 0, []
    while start < len(text):
        end = text.find(b" ", start + SLICE_BYTES)
        end = len(text) if end < 0 else end
        pieces.append(ngram_counts([text[start:end]]))
        start = end
    codes, inverse = np.unique(np.concatenate([c for _, c, _ in pieces]), return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate([n for _, _, n in pieces])).astype(np.int64)
    return np.zeros(len(codes), np.int64), codes, counts


def by_rank(row: np.ndarray, code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and codes by row, then falling count, then code."""
    if len(row) and (row.max() >= 1 << 14 or count.max() >= 1 << 22):
        order = np.lexsort((code, -count, row))
        return row[order], code[order]
    key = (row << 49) | ((1 << 22) - count << 27) | code  # codes have 26 bits
    key.sort()
    return key >> 49, key & (1 << 27) - 1


def _count(batches: Batches) -> Batches:
    """N-gram counts by language of this task's documents."""
    languages: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def summed():
        keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(inverse, weights=np.concatenate([n for _, n in held])).astype(np.int64)

    for batch in batches:
        texts, langs = utf8(batch.column("text")), batch.column("lang").to_pylist()
        for a, b in slices([len(t) for t in texts], SLICE_BYTES):
            rows, codes, counts = text_counts(texts[a:b])
            of = np.array([languages.setdefault(x, len(languages)) for x in langs[a:b]], dtype=np.int64)
            held.append((of[rows] << 32 | codes, counts))
            if len(held) >= 16:
                held = [summed()]
    if held:
        keys, counts = summed()
        names = list(languages)
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in (keys >> 32).tolist()], pa.string()), pa.array(keys & 0xFFFFFFFF, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "code", "n"])


def fit_profiles(docs: DataFrame, train: Column, length: int = PROFILE, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """The ``length`` most frequent n-grams of each language, from every row that ``train`` holds for and that has a language."""
    rows = docs.filter(train & F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    counts = rows.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    languages = rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    top = counts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "code"))).alias("all"))  # n-grams of three bytes: bounded
    profiles = {r["lang"]: list(r["codes"]) for r in top.select("lang", F.slice("all.code", 1, length).alias("codes")).collect()}
    return dict(sorted(profiles.items()))


def _predict(batches: Batches, names: list[str], codes: np.ndarray, ranks: np.ndarray, length: int) -> Batches:
    for batch in batches:
        texts = utf8(batch.column("text"))
        for a, b in slices([len(t) for t in texts], SLICE_BYTES):
            part, own = batch.slice(a, b - a), texts[a:b]
            n = len(own)
            row, code, count = text_counts(own)
            row, code = by_rank(row, code, count)
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            row, code, rank = row[rank < length], code[rank < length], rank[rank < length]
            sizes = np.bincount(row, minlength=n)
            distance = np.zeros((n, len(names)))
            if len(codes) and len(row):
                place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                off = np.where((codes[place] == code)[:, None] & (ranks[place] >= 0), np.abs(ranks[place] - rank[:, None]), length)
                for k in range(len(names)):
                    distance[:, k] = np.bincount(row, weights=off[:, k], minlength=n)
            known = [bool(names) and has_letter(t) for t in own]
            best = distance.argmin(axis=1) if names else np.zeros(n, int)
            least = distance[np.arange(n), best] if names else np.zeros(n)
            score = 1 - least / np.maximum(sizes * length, 1)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array([names[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]), pa.array(np.where(known, np.clip(score, 0, 1), 0.0), pa.float64())],
                names=["doc", "lang_pred", "score"],
            )


def identify(docs: DataFrame, profiles: dict[str, list[int]], length: int = PROFILE, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``doc``, with lang_pred and score (1: all ranks agree, 0: nothing in common).

    Equal distances go to the first language by name. A null text, one without letters, or no profile at
    all give ``und`` and score 0. Whole texts are counted.
    """
    names = list(profiles)
    codes = np.unique(np.array([c for p in profiles.values() for c in p], dtype=np.int64))
    ranks = np.full((len(codes), len(names)), -1, dtype=np.int64)
    for k, p in enumerate(profiles.values()):
        ranks[np.searchsorted(codes, np.array(p, dtype=np.int64)), k] = np.arange(len(p))
    rows = packed(docs, text=F.col(f"`{text_col}`"))
    kind = T.StructType([rows.schema["doc"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(partial(_predict, names=names, codes=codes, ranks=ranks, length=length), kind)
