"""Pairs of conversations with the same opening, however far apart their ids are."""

import random

from priorwise.llm import chat


def test_pairs_do_not_depend_on_the_distance_of_ids(spark):
    r = random.Random(5)
    opened = {"a": [1, 10**12], "b": [r.randrange(-(10**15), 10**15) for _ in range(301)], "c": [7 + 4096 * k for k in range(6)], "d": [2]}
    turns = [(i, 0, "user", o) for o, ids in opened.items() for i in ids] + [(i, 1, "assistant", "x" * (i % 5)) for ids in opened.values() for i in ids]
    clean = chat.clean_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    want = []
    for ids in opened.values():
        ids = sorted(ids)
        for a, b in zip(ids[::2], [*ids[1::2], None], strict=False):
            want.append((a, a, b) if b is None or b % 5 <= a % 5 else (a, b, a))
    got = [tuple(x) for x in chat.preference_pairs(clean).select("pair_id", "chosen", "rejected").collect()]
    assert sorted(got) == sorted(want)


def test_pairs_agree_with_the_registered_sql(spark, tmp_path):
    """The given tables hold next to no shared openings; here every opening is shared, over far ids, null turns and repeated rows."""
    import duckdb

    from priorwise.llm import catalog

    r = random.Random(11)
    rows = []
    for k in range(60):
        conv, opening, shared = r.randrange(10**9), f"question {k % 7}", r.randrange(3)
        rows.append((conv, 0, "user", opening))
        rows += [(conv, 2 * j + 1, "assistant", "agreed") if j < shared else (conv, 2 * j + 1, "assistant", f"answer {r.randrange(4)} <|x") for j in range(r.randrange(4))]
        rows += [(conv, 2 * j + 2, "user", None if r.random() < 0.1 else "go on") for j in range(r.randrange(3))]
        rows += [(conv, None, "user", "unnumbered")] * (k % 11 == 0) + [rows[-1]] * (k % 5 == 0)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = str(tmp_path / "conversations.parquet")
    turns.write.parquet(path)
    got = catalog.QUERIES["op5_preference_chat"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.SQL['op5_preference_chat']})").fetchall()
    key = lambda row: tuple((v is None, v) for v in row)
    assert sorted((tuple(x) for x in got.collect()), key=key) == sorted(want, key=key)
    assert sum(row[2] is not None for row in want) > 60 and len({row[3] for row in want}) == 3
