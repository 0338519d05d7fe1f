"""Personal data by patterns and by bootstrapped contextual extraction (built-in functions only).

Base spans come from four patterns. They seed the extraction: the last word and the last two words to the left
of a seed, with what stands between them and the seed, are lexical patterns, and any token with a digit or an @
that stands behind such a pattern is an instance of it; digit groups behind blanks, hyphens or in brackets belong
to the token. Patterns and instances form a graph that is scored in rounds: a pattern is as good as the share of
its distinct instances that are good, an instance that is no seed as good as its patterns together. Instances
behind patterns that end with high confidence and support become spans of kind ``context_<kind>``.

The text is read once; spans and mentions are stored, and the rounds work on distinct edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorwise.llm.common import packed, stored

#: Fixed values of the contract: kinds in their order. The look-behind and \G start a match only where one
#: could start anyway (left of a run, or where the last match ended); that and the possessive runs keep the
#: search linear on very long runs.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PARTS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: A word of any script, and what may stand between words or before a token: no letter, digit or @, and neither
#: the plus nor the bracket that opens a number.
WORD = r"[\p{L}\p{M}]"
GAP = r"(?:(?!\+?(?:\(\p{Nd}{1,6}\)|\p{Nd}))[^\p{L}\p{M}\p{N}@])"
#: One or two words at the end of a text.
LEFT = rf"(?<!{WORD})((?:{WORD}++{GAP}{{1,16}})?{WORD}++{GAP}{{0,16}})\z"
#: The last word of a pattern.
LAST = rf"{WORD}++[^\p{{L}}\p{{M}}]*+\z"
#: A token with a digit or an @, or a number that starts with a bracket, and further digit groups. A token starts
#: only where one could start, so that no run is scanned once for each of its words.
GROUP = r"(?:(?<=[\p{Nd})])(?:[\x20\t]{1,2}|[.-])?(?:\(\p{Nd}{1,6}\)|\p{Nd}++(?![\p{L}\p{M}@])))"
TOKEN = rf"(?:\+?\(\p{{Nd}}{{1,6}}\)|[\p{{L}}\p{{M}}._+-]*+[\p{{Nd}}@](?:[._+-]*+[\p{{L}}\p{{M}}\p{{N}}@]++)*+){GROUP}*+"
MENTION = rf"(?<!{WORD})((?:{WORD}++{GAP}{{1,16}})?{WORD}++{GAP}{{1,16}})(?<![\p{{L}}\p{{M}}\p{{N}}@._+-])({TOKEN})"
ROUNDS, CONFIDENCE, SUPPORT, LIKELY = 3, 0.8, 5, 0.5


def _starts(pieces: Column, matches: Column) -> Column:
    """Start of each match in code points: lengths of the pieces between matches and of the matches, summed up."""
    sizes = F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size")))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        return F.struct((start + x["size"]).alias("at"), F.array_append(acc["out"], start).alias("out"))

    return F.slice(F.aggregate(sizes, first, step, lambda acc: acc["out"]), 1, F.size(matches))


def patterns_of(left: Column) -> Column:
    """The patterns of the text left of a token: its last word and, if there are two, its last two words.

    Blanks and line breaks count only between words, and an opening bracket or plus before the token not at all.
    """
    tidy = F.lower(F.regexp_replace(left, r"[\s\p{Z}(+]+\z", ""))
    tidy = F.regexp_replace(tidy, r"(?<![\p{L}\p{M}])[\s\p{Z}]++|[\s\p{Z}]++(?!\p{L})", "")
    tidy = F.regexp_replace(tidy, r"[\s\p{Z}]++", " ")
    return F.filter(F.array_distinct(F.array(tidy, F.regexp_extract(tidy, LAST, 0))), lambda p: p != "")


def same_value(value: Column) -> Column:
    """Equal for all ways to write a value: lower case, and without blanks, brackets and hyphens in a number."""
    return F.lower(F.when(value.rlike(r"[\p{L}@]"), F.regexp_replace(value, r"[\x20\t]+", "")).otherwise(F.regexp_replace(value, r"[\x20\t()-]+", "")))


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        back = F.reverse(digits)

        def add(total, k):
            d = F.substring(back, k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
            return total + d - F.when(d > 9, 9).otherwise(0)

        luhn = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0
        return F.when(F.length(digits).between(13, 19), luhn).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


SPANS = "array<struct<start:int,end:int,value:string,left:string>>"


def with_base_spans(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds an array of (start, end, value, left) for each kind to rows with a text column; left are the words before."""
    col = F.col(text)
    for kind, pattern in PATTERNS.items():
        may = F.contains(col, F.lit("@")) if kind == "email" else F.contains(col, F.lit("+")) if kind == "phone" else col.rlike(r"[0-9]\.[0-9]" if kind == "ip" else "[0-9]")
        rows = rows.withColumn("m", F.when(may, F.regexp_extract_all(col, F.lit(pattern), F.lit(0))))
        if kind == "card":  # short runs of digits are common, and only their places are wanted
            hit = F.exists("m", lambda m: F.length(m) >= 13)
        else:
            hit = F.size("m") > 0
        rows = rows.withColumn("p", F.when(hit, F.split(col, pattern, -1)))
        rows = rows.withColumn("s", F.when(hit, _starts(F.col("p"), F.col("m"))))
        good = F.filter(F.arrays_zip("s", "m", "p"), lambda x: x["s"].isNotNull() & _passes(kind, x["m"]))
        spans = F.transform(good, lambda x: F.struct(x["s"].alias("start"), (x["s"] + F.length(x["m"])).alias("end"), x["m"].alias("value"), F.regexp_extract(x["p"], LEFT, 1).alias("left")))
        rows = rows.withColumn(kind, F.coalesce(spans, F.array().cast(SPANS))).drop("m", "p", "s")
    return rows


def with_mentions(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds the array of (start, end, value, left) of all tokens behind a word."""
    col = F.col(text)
    whole, left, token = (F.regexp_extract_all(col, F.lit(MENTION), F.lit(k)) for k in (0, 1, 2))
    rows = rows.withColumn("m_all", F.when(col.rlike(r"[\p{Nd}@]"), whole))
    some = F.size("m_all") > 0
    rows = rows.withColumn("m_left", F.when(some, left)).withColumn("m_token", F.when(some, token)).withColumn("m_start", F.when(some, _starts(F.split(col, MENTION, -1), F.col("m_all"))))
    parts = F.arrays_zip("m_start", "m_left", "m_token")

    def mention(x):
        start = x["m_start"] + F.length(x["m_left"])
        return F.struct(start.alias("start"), (start + F.length(x["m_token"])).alias("end"), x["m_token"].alias("value"), x["m_left"].alias("left"))

    return rows.withColumn("mentions", F.coalesce(F.transform(parts, mention), F.array().cast(SPANS))).drop("m_all", "m_left", "m_token", "m_start")


def score_patterns(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, likely: float = LIKELY) -> tuple[DataFrame, DataFrame]:
    """Confidence by (pattern, kind) and score by (value, kind) from edges (pattern, value, seed kind or null)."""
    edges = stored(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    wide = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = edges.filter("seed IS NOT NULL").select("value", F.col("seed").alias("kind")).distinct().withColumn("score", F.lit(1.0))
    scores = stored(seeds)
    confidence = None
    for _ in range(rounds):
        scored = edges.select("pattern", "value", F.col("seed").isNotNull().alias("own")).join(scores, "value")
        summed = scored.groupBy("pattern", "kind").agg(F.sum("score").alias("good"), F.count(F.when(F.col("own"), 1)).alias("support"))
        confidence = stored(summed.join(wide, "pattern").select("pattern", "kind", (F.col("good") / (F.col("n") + 1)).alias("confidence"), "support"))
        good = confidence.filter((F.col("confidence") >= likely) & (F.col("support") >= support))
        doubt = F.log(1 - F.least(F.col("confidence"), F.lit(0.99)))
        behind = edges.join(good, "pattern").join(seeds.select("value", "kind"), ["value", "kind"], "left_anti")
        best = behind.groupBy("value", "kind", F.regexp_extract("pattern", LAST, 0)).agg(F.max("confidence").alias("confidence"))  # two words end in the one
        new = best.groupBy("value", "kind").agg((1 - F.exp(F.sum(doubt))).alias("score"))
        scores = stored(seeds.unionByName(new))
    return confidence, scores


def find_personal_data(docs: DataFrame, text_col: str = "text", confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """Every row of ``docs`` as ``doc``, with email, ip, card, phone (arrays of start, end, value) and ``context`` (kind, start, end, value).

    Positions are code points of the whole text, the end is exclusive. A null text counts as empty and has
    no spans. A context span never touches a base span. Without seeds, or without patterns that reach
    ``support`` distinct seeds and ``confidence``, there are no context spans.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = with_mentions(with_base_spans(packed(docs, text=text)))
    rows = stored(rows.drop("text").withColumn("row", F.monotonically_increasing_id()))

    def of_kind(kind: str) -> Column:
        return F.transform(kind, lambda s: F.named_struct(F.lit("kind"), F.lit(kind), F.lit("start"), s["start"], F.lit("end"), s["end"], F.lit("value"), s["value"], F.lit("left"), s["left"]))

    seeds = F.flatten(F.array(*map(of_kind, KINDS)))
    pattern = F.explode(patterns_of(F.col("left"))).alias("pattern")
    value = same_value(F.col("value")).alias("value")
    own = rows.select(F.explode(seeds).alias("s")).select("s.*").select(pattern, value, F.col("kind").alias("seed"))
    m = rows.filter(F.size("mentions") > 0).select("row", seeds.alias("base"), F.explode("mentions").alias("m")).select("row", "base", "m.*")
    touched = F.exists("base", lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"]))
    mentions = m.filter(~touched).select("row", "start", "end", value, pattern)
    known, scores = score_patterns(own.unionByName(mentions.select("pattern", "value", F.lit(None).cast("string").alias("seed"))), support=support)
    sure = known.filter((F.col("confidence") >= confidence) & (F.col("support") >= support)).select("pattern", "kind")
    found = mentions.join(sure, "pattern").join(scores.filter(F.col("score") >= confidence), ["value", "kind"])
    span = F.struct(F.concat(F.lit("context_"), F.col("kind")).alias("kind"), "start", "end", "value")
    by_row = found.groupBy("row").agg(F.sort_array(F.collect_set(span)).alias("context"))  # of one document
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    plain = [F.transform(k, lambda s: s.dropFields("left")).alias(k) for k in KINDS]
    return rows.join(by_row, "row", "left").select("doc", *plain, F.coalesce("context", none).alias("context"))


def joined(spans: Column, kind: Column | None = None) -> Column:
    """``kind:start:end`` of each span."""
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"] if kind is None else kind, s["start"], s["end"]))
