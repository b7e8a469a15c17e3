"""Quality rules combined by weak supervision.

Every rule reads a document and votes good, votes bad or abstains. What documents are
good is not known; it is a hidden variable, given which rules vote independently. How
often each rule votes either way on good and on bad documents, and the share of good
ones, are estimated by expectation maximisation on the counts of the vote patterns
(at most 3 to the number of rules, whatever the number of documents). A document is kept
if it is good with a probability of at least ``KEEP``, so a single odd vote of a rule
that is often wrong no longer rejects a document.

Two plain tests stand before the model and always reject: fewer than ten words, and more
than 20 % of the words in repeated windows of five words.

All of it is built-in column functions: a text is split once, windows are compared as
hashes inside their row, and only the pattern counts are aggregated.

Edge cases: a null or empty text has no words, all counts 0, and fails the first test.
Repeated rows count as often as they occur. Without documents the result is empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from fungo.llm.common import BLANK, WORD, free, stored

STEPS = 12
KEEP = 0.5
#: Start of the estimation: share of good documents; how often a rule votes good and bad on them, and on bad ones,
#: of which each shows a few faults only.
GOOD, ON_GOOD, ON_BAD = 0.8, (0.9, 0.02), (0.5, 0.3)

#: (name, good where, bad where); neither is an abstention.
RULES = (
    ("length", "n_words >= 30 and n_words <= 50000", "n_words < 15"),
    ("word_length", "word_chars between 3 * n_words and 10 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    ("symbols", "100 * n_symbols <= 2 * n_words", "100 * n_symbols > 20 * n_words"),
    ("symbol_share", "1000 * n_symbols <= 5 * word_chars", "100 * n_symbols > 5 * word_chars"),
    ("symbol_count", "n_symbols <= 10", "n_symbols > 10 and 2 * n_symbols > n_words"),
    ("dup_lines", "n_dup_lines = 0", "10 * n_dup_lines > 2 * n_lines"),
    ("repeats", "100 * n_repeat_words <= 5 * n_words", "100 * n_repeat_words > 12 * n_words"),
    ("upper", "100 * n_upper <= 10 * word_chars", "100 * n_upper > 30 * word_chars"),
    ("marks", "100 * n_marks <= 8 * n_words", "100 * n_marks > 40 * n_words"),
    ("digits", "100 * n_digits <= 5 * word_chars", "100 * n_digits > 25 * word_chars"),
)


def _texts(docs: DataFrame) -> DataFrame:
    """Words, lines and counts that regular expressions give."""
    t = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    words = F.filter(F.split(t, BLANK + "+", -1), lambda x: x != "")
    return docs.select("*", words.alias("_words"), lines.alias("_lines"),
                       *(F.regexp_count(t, F.lit(p)).cast("long").alias(n) for n, p in (("n_symbols", r"[#*$%&|<>]"), ("n_upper", "[A-Z]"), ("n_marks", r"[!?]"), ("n_digits", "[0-9]"))))


def _windows(df: DataFrame) -> DataFrame:
    """Hashes of the windows of five words, as ``_w``, for texts that have one."""
    h = F.transform("_words", lambda w: F.xxhash64(w))
    df = df.withColumn("_h", h)
    at = F.sequence(F.lit(0), F.size("_h") - 5)
    mixed = F.transform(at, lambda i: F.xxhash64(*(F.get("_h", i + k) for k in range(5))))
    return df.withColumn("_w", F.when(F.size("_h") >= 6, mixed).otherwise(F.array().cast("array<bigint>")))


def _repeat_words() -> Column:
    """Words in windows whose hash occurs again: the union of five-word stretches at their places."""
    placed = F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = F.filter(F.transform(F.sequence(F.lit(0), F.size("_s") - 1),
                                lambda k: F.when((F.get("_s", k)["h"] == F.get("_s", k - 1)["h"]) | (F.get("_s", k)["h"] == F.get("_s", k + 1)["h"]), F.get("_s", k)["i"])),
                    lambda x: x.isNotNull())
    return placed, same


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` plus the counts that the rules read."""
    df = _windows(_texts(docs))
    placed, same = _repeat_words()
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), placed))
    df = df.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(same)))
    spans = F.aggregate("_p", F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")),
                        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n")), lambda a: a["n"])
    return df.select(*docs.columns, F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
                     "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                     F.when(F.col("_s").isNotNull(), spans).otherwise(0).cast("long").alias("n_repeat_words"),
                     F.size("_lines").cast("long").alias("n_lines"), "n_upper", "n_marks", "n_digits")


def votes(df: DataFrame) -> list[Column]:
    return [F.when(F.expr(good), 1).when(F.expr(bad), -1).otherwise(0).alias(f"_v_{name}") for name, good, bad in RULES]


def start() -> dict[str, float]:
    p = {"good": GOOD}
    for name, *_ in RULES:
        p |= {f"{name}_up_good": ON_GOOD[0], f"{name}_down_good": ON_GOOD[1], f"{name}_up_bad": ON_BAD[0], f"{name}_down_bad": ON_BAD[1]}
    return p


def probability(p: dict[str, float]) -> Column:
    """Probability that a document with these votes is good."""
    odds = F.lit(math.log(p["good"] / (1 - p["good"])))
    for name, *_ in RULES:
        up, down = (math.log(p[f"{name}_{way}_good"] / p[f"{name}_{way}_bad"]) for way in ("up", "down"))
        none = math.log((1 - p[f"{name}_up_good"] - p[f"{name}_down_good"]) / (1 - p[f"{name}_up_bad"] - p[f"{name}_down_bad"]))
        v = F.col(f"_v_{name}")
        odds = odds + F.when(v == 1, F.lit(up)).when(v == -1, F.lit(down)).otherwise(F.lit(none))
    return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame) -> dict[str, float]:
    """Parameters after ``STEPS`` steps over rows of votes with their count ``_k``. One row is read back a step."""
    p = start()
    for _ in range(STEPS):
        row = patterns.withColumn("_q", probability(p)).withColumn("_b", 1 - F.col("_q"))
        sums = [F.sum("_k").alias("all"), F.sum(F.col("_k") * F.col("_q")).alias("good")]
        for name, *_ in RULES:
            for way, v in (("up", 1), ("down", -1)):
                for side, c in (("good", "_q"), ("bad", "_b")):
                    sums.append(F.sum(F.when(F.col(f"_v_{name}") == v, F.col("_k") * F.col(c)).otherwise(0.0)).alias(f"{name}_{way}_{side}"))
        r = row.agg(*sums).first().asDict()
        if not r["all"]:
            return p
        side = {"good": r["good"], "bad": r["all"] - r["good"]}
        p = {"good": (r["good"] + 1) / (r["all"] + 2)} | {k: (r[k] + 1) / (side[k.rsplit("_", 1)[1]] + 3) for k in p if k != "good"}
    return p


BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def judged(docs: DataFrame) -> DataFrame:
    """Columns of ``docs`` but the text, plus counts, votes, base_failed, quality (the probability) and kept.

    What is measured is written once without the text, since the estimation and the verdict both read it.
    Columns of ``docs`` are carried in a struct, so their names meet no working column; a result whose
    name they have gets underscores.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    df = measured(docs.select(F.struct(*own or [F.lit(0).alias("_")]).alias("_doc"), "text")).drop("text")
    voted = df.select("*", *votes(df), F.expr(BASE_FAILED).alias("base_failed"))
    names = [f"_v_{name}" for name, *_ in RULES]
    voted = stored(voted, "votes")
    patterns = stored(voted.groupBy(*names).agg(F.count("*").alias("_k")), "patterns")
    quality = probability(estimate(patterns))
    out = voted.withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))
    rest = docs.drop("text")
    return out.select(*["_doc.*"] * bool(own), *[F.col(c).alias(free(rest, c)) for c in out.columns if c != "_doc"])


def sql(where: str) -> str:
    """The answer in DuckDB SQL, the steps written out."""
    names = [name for name, *_ in RULES]

    def q(i: int) -> str:
        odds = f"ln(p{i}.good / (1 - p{i}.good))"
        for n in names:
            ratio = "/".join(f"(1 - {n}_up_{s} - {n}_down_{s})" for s in ("good", "bad"))
            odds += f" + CASE v_{n} WHEN 1 THEN ln({n}_up_good / {n}_up_bad) WHEN -1 THEN ln({n}_down_good / {n}_down_bad) ELSE ln({ratio}) END"
        return f"1 / (1 + exp(-({odds})))"

    steps = ["p0 AS (SELECT " + ", ".join(f"{v!r}::DOUBLE AS {k}" for k, v in start().items()) + ")"]
    for i in range(STEPS):
        sums = ", ".join(f"(sum(CASE WHEN v_{n} = {v} THEN k * {c} ELSE 0 END) + 1) / (sum(k * {c}) + 3) AS {n}_{way}_{side}"
                         for n in names for way, v in (("up", 1), ("down", -1)) for side, c in (("good", "q"), ("bad", "(1 - q)")))
        steps.append(f"q{i} AS (SELECT pat.*, {q(i)} AS q FROM pat, p{i})")
        steps.append(f"p{i + 1} AS MATERIALIZED (SELECT (sum(k * q) + 1) / (sum(k) + 2) AS good, {sums} FROM q{i})")
    vote = ", ".join(f"CASE WHEN {g} THEN 1 WHEN {b} THEN -1 ELSE 0 END AS v_{n}" for n, g, b in RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM {where}),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ 	-
]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM d),
f AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM f),
h AS (SELECT r, sum(least(5, coalesce(i - before, 5)))::BIGINT AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM g WHERE c > 1) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(h.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS n_upper,
        len(regexp_extract_all(t, '[!?]')) AS n_marks, len(regexp_extract_all(t, '[0-9]')) AS n_digits FROM w LEFT JOIN h USING (r)),
v AS MATERIALIZED (SELECT *, {vote}, {BASE_FAILED} AS base_failed FROM m),
pat AS MATERIALIZED (SELECT {", ".join(f"v_{n}" for n in names)}, count(*)::DOUBLE AS k FROM v GROUP BY ALL),
{", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {q(STEPS)} >= {KEEP} AS kept FROM v, p{STEPS}
"""
