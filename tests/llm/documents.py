"""Small document tables with the awkward cases, and plain versions of the operators to hold results against."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import types as T

#: Columns that operators use as names of their own are here as columns of the table.
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("lang", "doc", "row", "key", "digest", "leaf", "kept", "hits", "score", "block", "node", "shard", "n_tokens", "email", "grp", "id", "x.y")]
)


def table(spark, rows, parts=3):
    extra = len(SCHEMA) - 3
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", *["?"] * extra) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def prose(seed, words, letters="abcdefghij"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(words))


def edited(text, seed, edits):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(edits):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


def awkward():
    base, long = prose(1, 120), prose(2, 30_000)
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, "Same Words"), (7, "same words"), (8, "ÉTÉ"), (9, "été"),
        (None, "a row without an id but with some words"), (None, None), (10, base), (10, base), (11, base.upper()), (12, long), (13, edited(long, 3, 40)),
        (14, "x" * 60_000), (15, "5" * 60_000), (16, "a|b\x00c <|user|> " * 30),
    ]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def family(seed, base_words, copies, edits):
    base = prose(seed, base_words)
    return [base] + [edited(base, seed * 1000 + k, random.Random(k).randint(*edits)) for k in range(copies)]


def exact(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(lower(text), []).append(doc_id)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((i, keep[lower(t)], len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t, *_ in rows)


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def near(rows, size, percent):
    """Smallest id that each document reaches through links (ids are unique)."""
    sets, parent = {i: shingles(t, size) for i, t, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def contaminated(text, items, window):
    cut = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words, hit, found = re.findall(cut, lower(text)), set(), set()
    for item, passage in items:
        own = re.findall(cut, lower(passage))
        for k in range(max(1, len(own) - window + 1) if own else 0):
            w = own[k : k + window]
            for s in range(len(words) - len(w) + 1):
                if words[s : s + len(w)] == w:
                    hit |= set(range(s, s + len(w)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def repeated(rows, length):
    """(bytes, removed, spans, digest of the rest) by id; a null id is greater than all."""
    first, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    rank = lambda i: (i is None, i or 0)
    for doc_id, text, *_ in order:
        data = (text or "").encode()
        for k in range(len(data) - length + 1):
            first.setdefault(data[k : k + length], rank(doc_id))
    for doc_id, text, *_ in order:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] < rank(doc_id):
                gone[k : k + length] = b"\x01" * length
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return Counter(out)


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text):
    def luhn(digits):
        doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0

    def passes(kind, match):
        digits = re.sub("[^0-9]", "", match)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in match.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    return [f"{kind}:{m.start()}:{m.end()}" for kind, pattern in PII.items() for m in re.finditer(pattern, text or "") if passes(kind, m.group())]
