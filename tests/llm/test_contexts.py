"""Discovery of personal data by context: whole values as seeds and instances, and labels of any script."""

from documents import prose, table

from priorwise.llm import pii


def contexts(spark, rows):
    got = pii.find_personal_data(table(spark, rows)).select("doc.doc_id", "doc.text", "context").collect()
    return {r.doc_id: [(s.kind, r.text[s.start : s.end]) for s in r.context] for r in got}


def luhn(k):
    """A card number in groups of four."""
    head = f"4111{k:011d}"
    odd = sum(sum(divmod(2 * int(c), 10)) for c in head[::2]) + sum(int(c) for c in head[1::2])
    whole = head + str(-odd % 10)
    return " ".join(whole[a : a + 4] for a in range(0, 16, 4))


NAMES = [a + "." + b for a in ("ann", "bob", "cleo") for b in ("smith", "jones", "brown", "young")]


def test_whole_values_are_seeds_and_instances(spark):
    rows = [(k, f"{prose(k, 4)} phone: +1 ({200 + k}) 555-{7000 + k} {prose(k, 3)}") for k in range(12)]
    rows += [(100 + k, f"{prose(k, 4)} card: {luhn(k)} {prose(k, 3)}") for k in range(12)]
    rows += [(200 + k, f"{prose(k, 4)} mail: {name}@example.com {prose(k, 3)}") for k, name in enumerate(NAMES)]
    rows += [(300, "phone: (838) 555-7235 please"), (301, "phone: 555 1234567."), (302, "card: 4111 1111 1111 1112, expired"), (303, "mail: dan.white@desk, thanks"), (304, "they count 12345 things")]
    got = contexts(spark, rows)
    assert got[300] == [("context_phone", "(838) 555-7235")] and got[301] == [("context_phone", "555 1234567")]
    assert got[302] == [("context_card", "4111 1111 1111 1112")] and got[303] == [("context_email", "dan.white@desk")]
    assert not any(v for k, v in got.items() if k < 300 or k == 304)


LABELS = ["почта: ", "clé: ", "tel. ", "email:\n", "e-mail (", "числодлинноеслововкоторомбольшедвадцатичетырёхбукв: ", "電子郵件：", "ключ — ", "write to the\r\n\r\n"]


def test_labels_of_any_script_and_form(spark):
    rows = []
    for n, label in enumerate(LABELS):
        rows += [(1000 * n + k, f"{prose(k, 4)} {label}user{n}x{k}@mail.example.com) {prose(k, 3)}") for k in range(12)]
        rows += [(1000 * n + 100, f"{label}agent{n}-at-desk"), (1000 * n + 101, f"{prose(1, 3)} {label.upper()}agent{n}-at-home")]
    got = contexts(spark, rows)
    for n, label in enumerate(LABELS):
        assert got[1000 * n + 100] == [("context_email", f"agent{n}-at-desk")], label
        assert got[1000 * n + 101] == [("context_email", f"agent{n}-at-home")], label
        assert not any(got[1000 * n + k] for k in range(12))


def test_two_words_tell_apart_what_one_word_does_not(spark):
    rows = [(k, f"write to user{k}@mail.example.com") for k in range(40)] + [(100 + k, f"up to {k}x") for k in range(40)]
    rows += [(200, "write to agent77-at-desk"), (201, "up to agent78-at-desk")]
    got = contexts(spark, rows)
    assert got[200] == [("context_email", "agent77-at-desk")] and not any(v for k, v in got.items() if k != 200)


def test_nested_patterns_count_once(spark):
    edges = [(p, f"v{k}", "email") for k in range(5) for p in ("to:", "write to:")] + [(p, v, None) for v in ("new", "x", "y") for p in ("to:", "write to:")]
    known, scores = pii.score_patterns(spark.createDataFrame(edges, "pattern string, value string, seed string"), rounds=1)
    assert {r.value: round(r.score, 6) for r in scores.collect() if r.value == "new"} == {"new": round(5 / 9, 6)}
