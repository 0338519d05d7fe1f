"""Registered queries of the document operators and the SQL that some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorwise.llm import chat, decontaminate, divergence, exact_dedup, language, minhash, negatives, packing, pii, quality, sharding, simhash, substrings
from priorwise.llm.common import LOWER, UPPER, held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SHARDS = 40


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


@query(
    "op6_exact_dedup",
    f"""
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM d
    """,
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, folder, "documents", "doc_id", "text"))
    return groups.select("doc.doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op7_sharding")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, folder, "documents", "doc_id", "text").select(
        "doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    dealt = sharding.shuffle_into_shards(rows, SHARDS)
    return dealt.select("doc.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Words as the contract cuts them, and the rows that models may learn labels from.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10


@query(
    "op1_decontamination",
    f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
    bw AS (
      SELECT DISTINCT item_id, w[k : least(k + {WINDOW - 1}, len(w))] AS win
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS k FROM b WHERE len(w) > 0)
    ),
    sizes AS (SELECT DISTINCT len(win) AS n FROM bw),
    spots AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n),
    hit AS (SELECT doc_id, k, n, item_id FROM spots JOIN d USING (doc_id) JOIN bw ON bw.win = w[k : k + n - 1]),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text"), WINDOW)
    covered = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return hits.select(
        "doc.doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (covered > 0).alias("contaminated"),
    )


@query("op2_language_id")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    profiles = language.fit_profiles(docs, ~held_out("doc_id"))
    found = language.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc.doc_id", held_out("doc.doc_id").alias("held_out"), "lang_pred", "score")


@query("op10_quality")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    model = quality.fit_quality(docs, table(spark, folder, "labels", "doc_id", "quality"), ~held_out("id"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc.doc_id", held_out("doc.doc_id").alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query("op4_best_fit_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    placed = packing.pack_documents(table(spark, folder, "documents", "doc_id", "text"), carry=["doc_id"])
    return placed.select("doc.doc_id", "piece", "start", "length", "bin_id", "capacity", "offset")


@query(
    "op5_preference_chat",
    f"""
    WITH t AS (
      SELECT DISTINCT conv_id, coalesce(turn, {chat.LAST}) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
      FROM conversations WHERE conv_id IS NOT NULL
    ),
    c AS (
      SELECT conv_id, min_by(ROW(turn, role, text), ROW(turn, role, sha256(text))) AS opening,
             sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS size
      FROM t GROUP BY conv_id
    ),
    r AS (
      SELECT *, row_number() OVER g AS k, lead(conv_id) OVER g AS other, lead(size) OVER g AS other_size
      FROM c WINDOW g AS (PARTITION BY opening ORDER BY conv_id)
    ),
    p AS (
      SELECT conv_id AS pair_id, CASE WHEN other_size > size THEN other ELSE conv_id END AS chosen,
             CASE WHEN other_size > size THEN conv_id ELSE other END AS rejected
      FROM r WHERE k % 2 = 1
    ),
    a AS (SELECT p.*, turn, role, text FROM p JOIN t ON t.conv_id = chosen),
    b AS (SELECT p.*, turn, role, text FROM p JOIN t ON t.conv_id = rejected),
    ends AS (
      SELECT pair_id, min(turn) AS first FROM (
        (SELECT pair_id, turn, role, text FROM a WHERE rejected IS NOT NULL EXCEPT SELECT pair_id, turn, role, text FROM b)
        UNION ALL (SELECT pair_id, turn, role, text FROM b EXCEPT SELECT pair_id, turn, role, text FROM a)
        UNION ALL (SELECT pair_id, turn, role, text FROM a WHERE rejected IS NULL AND role = 'assistant')
      ) GROUP BY pair_id
    ),
    parts AS (
      SELECT a.*, CASE WHEN first IS NULL OR turn < first THEN 'prompt' ELSE 'chosen' END AS part FROM a LEFT JOIN ends USING (pair_id)
      UNION ALL SELECT b.*, 'rejected' FROM b JOIN ends USING (pair_id) WHERE turn >= first
    )
    SELECT pair_id, chosen, rejected, part, CASE WHEN turn <> {chat.LAST} THEN turn END AS turn, role,
           '<|' || role || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS rendered,
           CASE WHEN part <> 'prompt' AND role = 'assistant' THEN 1 ELSE 0 END AS mask
    FROM parts
    """,
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    turns = chat.clean_turns(table(spark, folder, "conversations", "conv_id", "turn", "role", "text"))
    return chat.format_preferences(turns, chat.preference_pairs(turns))


@query("op3_personal_data")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, folder, "documents", "doc_id", "text"))
    base = F.flatten(F.array(*[pii.joined(F.col(k), F.lit(k)) for k in pii.KINDS]))
    return found.select(
        "doc.doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, pii.joined(F.col("context"))), ",").alias("spans"),
    )


#: Words between white space.
WHITE = r"[^\x20\x09-\x0D]+"


@query(
    "op8_minhash_near_dedup",
    f"""
    WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WHITE}') AS w FROM documents),
    s AS MATERIALIZED (
      SELECT DISTINCT doc_id, array_to_string(w[k : least(k + 2, len(w))], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0)
    ),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS MATERIALIZED (
      SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
      UNION ALL SELECT y, x FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
    ),
    reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = r),
    least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
    """,
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    groups = minhash.near_groups(table(spark, folder, "documents", "doc_id", "text"), shingle=3, percent=85, carry=["doc_id"])
    # rows of one id stay or go together here, whatever their texts
    return groups.select("doc.doc_id", "n_shingles", "component_id", F.col("doc.doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query(
    "op9_repeated_passages",
    f"""
    WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    win AS MATERIALIZED (
      SELECT doc_id, k, hash(substr(h, 2 * k + 1, {2 * substrings.LENGTH})) AS one, hash(substr(h, 2 * k + 1, {2 * substrings.LENGTH}) || '-') AS two
      FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {substrings.LENGTH} + 1)) AS k FROM d)
    ),
    first AS (SELECT one, two, min(doc_id) AS least FROM win GROUP BY one, two),
    gone AS (SELECT doc_id, k FROM win JOIN first USING (one, two) WHERE least < doc_id),
    steps AS (SELECT doc_id, k, k > coalesce(lag(k) OVER (PARTITION BY doc_id ORDER BY k) + {substrings.LENGTH}, -1) AS opens FROM gone),
    runs AS (SELECT doc_id, k, count_if(opens) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM steps),
    spans AS (SELECT doc_id, run, min(k) AS a, max(k) + {substrings.LENGTH} AS b FROM runs GROUP BY doc_id, run),
    pieces AS (
      SELECT doc_id, coalesce(lag(b) OVER w, 0) AS start, a AS stop FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY run)
      UNION ALL SELECT doc_id, max(b), 1000000000 FROM spans GROUP BY doc_id
    ),
    left_ AS (SELECT doc_id, string_agg(substr(h, CAST(2 * start + 1 AS BIGINT), CAST(2 * (stop - start) AS BIGINT)), '' ORDER BY start) AS rest FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
    FROM d LEFT JOIN left_ USING (doc_id) LEFT JOIN (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS removed, count(*) AS n FROM spans GROUP BY doc_id) USING (doc_id)
    """,
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.repeated_passages(table(spark, folder, "documents", "doc_id", "text"), carry=["doc_id"])
    return found.select("doc.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query("op13_simhash_near_dedup")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.fingerprint_groups(table(spark, folder, "documents", "doc_id", "text"), carry=["doc_id"])
    return groups.select("doc.doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


@query(
    "op11_source_divergence",
    f"""
    WITH d AS (
      SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents
    ),
    t AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d),
    kept AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
    sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    uses AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
    grid AS MATERIALIZED (
      SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang, source) + 2 * v) AS p
      FROM (SELECT g.lang, g.source, kept.term, coalesce(uses.c, 0) AS c, v FROM g JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN uses USING (lang, source, term))
    ),
    whole AS (
      SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang) + 2 * v) AS q
      FROM (SELECT lang, term, sum(c) AS c FROM grid GROUP BY lang, term) JOIN sizes USING (lang)
    ),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM grid a JOIN grid b USING (lang, term) GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND item = b.source),
    above AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM grid JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
    ranked AS (
      SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
      UNION ALL BY NAME SELECT *, 'term' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM above
    )
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.source_divergence(table(spark, folder, "documents", "lang", "source", "text"))


ANCHOR_STEP, FLIP_STEP, LABELS = 50, 7, 10


@query(
    "op12_hard_negatives",
    f"""
    WITH e AS MATERIALIZED (
      SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % {FLIP_STEP} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
             list_transform(embedding, lambda x: floor({negatives.SCALE} * CAST(x AS DOUBLE))) AS v
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    a AS (SELECT * FROM e WHERE vec_id % {ANCHOR_STEP} = 0),
    s AS MATERIALIZED (
      SELECT a.r, a.vec_id AS anchor_id, a.label AS anchor_label, e.r AS other, e.vec_id, e.label,
             CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
      FROM a JOIN e ON a.r <> e.r
    ),
    p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other) AS k FROM s WHERE label = anchor_label QUALIFY k <= {negatives.POSITIVES}),
    n AS (
      SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.vec_id NULLS LAST, s.other) AS rank
      FROM p JOIN s ON s.r = p.r AND s.label <> s.anchor_label
      WHERE {negatives.LOW} * p.score <= 100 * s.score AND 100 * s.score <= {negatives.HIGH} * p.score
    )
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives.NEGATIVES}
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    flipped = lambda i, label: F.when(F.coalesce(i % FLIP_STEP == 0, F.lit(False)), (label + 1) % LABELS).otherwise(label)
    return negatives.hard_negatives(table(spark, folder, "embeddings", "vec_id", "embedding", "label"), lambda i: i % ANCHOR_STEP == 0, flipped)
