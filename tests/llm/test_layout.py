"""Sharding, packing, chat formatting and the pipeline."""

from collections import Counter, defaultdict

import numpy as np
from documents import SCHEMA, awkward, prose, table

from priorwise.llm import chat, packing, sharding


def test_shards_are_exact_and_gapless(spark):
    rows = awkward() * 7
    docs = table(spark, rows, 6)
    got = sharding.shuffle_into_shards(docs, 5, max_blocks=4, cell_rows=3).select("doc.doc_id", "shard", "slot").collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 5
    assert sharding.shuffle_into_shards(docs.limit(0), 5).count() == 0
    assert sorted((r.shard, r.slot) for r in sharding.shuffle_into_shards(docs.limit(2), 5).collect()) == [(0, 0), (1, 0)]


def test_communication_matrix_has_its_sums_and_law():
    matrix = np.array(sharding.communication_matrix([70, 0, 30, 400], [125, 125, 125, 125], 3))
    assert matrix.sum(1).tolist() == [70, 0, 30, 400] and matrix.sum(0).tolist() == [125] * 4
    rng = np.random.default_rng(1)
    ours = np.array([sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)])
    assert abs(ours.mean() - 6) < 0.15 and abs(ours.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    big = sharding.hypergeometric(rng, 10**12, 3 * 10**12, 10**9)
    assert abs(big - 2.5 * 10**8) < 12 * (10**9 * 0.1875) ** 0.5
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0


def plain_best_fit(lengths, capacities):
    bins, placed = [], []
    for i, n in enumerate(lengths):
        rooms = [(b["room"], -k) for k, b in enumerate(bins) if b["room"] >= n]
        if rooms:
            least = min(rooms)[0]
            k = max(bins[-j]["stamp"] * 10**6 - j for r, j in rooms if r == least) % 10**6
        else:
            costs = []
            for c in [c for c in capacities if c >= n]:
                room, fill = c - n, n
                for m in lengths[i + 1 :]:  # they fall, so the longest that fits comes first
                    if m <= room:
                        room, fill = room - m, fill + m
                costs.append((packing.price(min(d for d in capacities if d >= fill)) / fill, -c))
            bins.append({"room": -min(costs)[1], "used": 0, "stamp": 0})
            k = len(bins) - 1
        placed.append((k, bins[k]["used"]))
        bins[k]["used"] += n
        bins[k]["room"] -= n
        for b in bins:
            b["stamp"] = b["stamp"] - 1 if b is not bins[k] else 0
    return placed, [next(c for c in capacities if c >= b["used"]) for b in bins]


def test_sizes_are_chosen_jointly_and_cost_less_than_one_size():
    r = np.random.default_rng(4)
    for mean, spread in ((5.5, 1.0), (6.5, 0.8), (4.5, 1.4)):
        lengths = sorted((int(x) for x in np.clip(r.lognormal(mean, spread, 6000), 1, 4096)), reverse=True)
        bins, _, sizes = packing.best_fit(lengths)
        opened = {}
        for k, n in zip(bins, lengths, strict=True):
            opened.setdefault(k, n)
        need = lambda n: next(c for c in packing.CAPACITIES if c >= n)
        assert sum(sizes[k] > need(n) for k, n in opened.items()) > len(sizes) / 20  # more than the first piece needs
        cost = sum(map(packing.price, sizes))
        longest = packing.CAPACITIES[-1]  # the one fixed size that holds every piece uncut
        assert cost < 0.95 * packing.price(longest) * len(packing.best_fit(lengths, (longest,))[2])
        assert cost <= 1.001 * plain_least(lengths)


def plain_least(lengths):
    """Cost where each bin opens at the least size that its first piece needs."""
    rooms, cost = [], 0.0
    for n in lengths:
        fit = [k for k, room in enumerate(rooms) if room >= n]
        if fit:
            k = min(fit, key=rooms.__getitem__)
        else:
            c = next(c for c in packing.CAPACITIES if c >= n)
            cost += packing.price(c)
            rooms.append(c)
            k = len(rooms) - 1
        rooms[k] -= n
    return cost


def test_the_last_bins_are_downsized():
    """A bin is opened for the pieces to come, which then go to better places."""
    r = np.random.default_rng(8)
    found = 0
    for _ in range(60):
        lengths = sorted((int(x) for x in r.integers(1, 33, 40)), reverse=True)
        _, _, sizes = packing.best_fit(lengths, (8, 16, 32))
        found += sum(a > b for a, b in zip(plain_opened(lengths, (8, 16, 32)), sizes, strict=True))
    assert found > 0


def plain_opened(lengths, capacities):
    """The sizes at which the plain form opens its bins."""
    opened = []
    plain_sizes = plain_best_fit(lengths, capacities)[0]
    seen = set()
    for i, ((k, _), n) in enumerate(zip(plain_sizes, lengths, strict=True)):
        if k not in seen:
            seen.add(k)
            costs = []
            for c in [c for c in capacities if c >= n]:
                room, fill = c - n, n
                for m in lengths[i + 1 :]:
                    if m <= room:
                        room, fill = room - m, fill + m
                costs.append((packing.price(min(d for d in capacities if d >= fill)) / fill, -c))
            opened.append(-min(costs)[1])
    return opened


def test_best_fit_matches_the_plain_form():
    r = np.random.default_rng(2)
    for _ in range(30):
        lengths = sorted((int(x) for x in r.integers(1, 33, r.integers(1, 60))), reverse=True)
        bins, offsets, sizes = packing.best_fit(lengths, (8, 16, 32))
        want, want_sizes = plain_best_fit(lengths, (8, 16, 32))
        assert list(zip(bins, offsets, strict=True)) == want and sizes == want_sizes
        used = Counter()
        for k, o, n in zip(bins, offsets, lengths, strict=True):
            assert o == used[k]
            used[k] += n
        assert all(used[k] <= sizes[k] for k in used)
        smaller = {16: 8, 32: 16}
        assert all(used[k] > smaller.get(sizes[k], 0) for k in used)


def test_packing_keeps_every_token(spark):
    rows = awkward()
    docs = table(spark, rows)
    got = packing.pack_documents(docs, (16, 64, 256), shard_tokens=5_000).select("doc.*", "piece", "start", "length", "bin_id", "capacity", "offset").collect()
    want = Counter()
    for i, t, *_ in rows:
        want[i] += len((t or "").encode().split()) + 1
    have, bins = Counter(), defaultdict(list)
    for r in got:
        have[r.doc_id] += r.length
        bins[r.bin_id, r.capacity].append((r.offset, r.length))
        assert r.start == r.piece * 256
    assert have == want
    for (_, capacity), parts in bins.items():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(parts[-1]) <= capacity
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "short"), (1, 2, "user", "more"), (1, 3, "assistant", "end"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "short"), (2, 2, "user", "more"), (2, 3, "assistant", "a longer end"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "alone <|end|>"), (3, 1, "assistant", "alone <|end|>"),
    (4, 0, "system", "x"), (4, None, None, None), (5, 0, "system", "x"), (5, None, None, None), (None, 0, "user", "hi"),
]


def test_preferences_by_hand(spark):
    turns = chat.clean_turns(spark.createDataFrame([(*t, "?", "?") for t in TURNS], "conv_id long, turn long, role string, text string, part string, mask string"))
    got = chat.format_preferences(turns, chat.preference_pairs(turns)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.pair_id, r.chosen, r.rejected, r.part].append((r.turn, r.role, r.rendered, r.mask))
    user = lambda t, x: (t, "user", f"<|user|>\n{x}<|end|>\n", 0)
    said = lambda t, x, m: (t, "assistant", f"<|assistant|>\n{x}<|end|>\n", m)
    assert sorted(by[1, 2, 1, "prompt"]) == [user(0, "hi"), said(1, "short", 0), user(2, "more")]
    assert by[1, 2, 1, "chosen"] == [said(3, "a longer end", 1)] and by[1, 2, 1, "rejected"] == [said(3, "end", 1)]
    assert by[3, 3, None, "prompt"] == [user(0, "hi")] and by[3, 3, None, "chosen"] == [said(1, "alone < |end|>", 1)]
    assert Counter(r.part for r in got if r.pair_id == 4) == {"prompt": 2}
    assert chat.format_preferences(turns.limit(0), chat.preference_pairs(turns.limit(0))).count() == 0


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline
    from documents import contaminated, exact, near

    folder = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.unionByName(docs.limit(0)).unionByName(spark.createDataFrame([(10_000, None, "en", "s", 0), (10_001, "", None, None, None)], docs.schema))
    before = [(r.doc_id, r.text) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        after = [(r.doc_id, r.text) for r in out.collect()]
        if name == "quality":
            assert len(after) < len(before) and set(after) <= set(before)
        if name == "exact_dedup":
            assert sorted(i for i, _ in after) == sorted({k for _, k, _, _ in exact(before)})
        if name == "near_dedup":
            assert sorted(i for i, _ in after) == sorted({k for _, k in near(before, 5, 80).values()})
        if name == "decontamination":
            assert sorted(i for i, _ in after) == sorted(i for i, t in before if not contaminated(t, items, 10)[1])
        docs, before = spark.createDataFrame(out.collect(), docs.schema), after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in before}
    assert prose(1, 2)
