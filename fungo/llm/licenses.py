"""License scans by an exact set-similarity join with license templates.

A text block is a window of 32 words that starts at every 16th word, so any 17 words in a
row lie in one block. A block carries a template's label if it holds at least 4/5 of the
template's distinct words. The join finds all such pairs:

* Words of templates are ordered by the number of documents that hold them, rare first.
* **Prefix filter.** Of a template of n words that needs m, a qualifying block holds one
  of the n - m + 1 rarest. Blocks without any such word are never formed.
* **Length filter.** A block needs at least m words of the templates' vocabulary.
* **Positional filter.** Where the p-th word of the template is the q-th vocabulary word
  of the block, at most min(n - p, words of the block - q) words can agree from there on;
  for the first common word this must reach m.
* What is left is counted exactly.

Templates are a table of bounded size (``TEMPLATES``); only they are broadcast. Besides,
``PHRASES`` are looked for word by word, and their places are reported.

Edge cases: a null or empty text has no words and no labels. Rows that repeat are scanned
one by one. Words are cut at ASCII characters other than letters and digits; A-Z are
lower-cased, other characters are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CUT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, STEP = 32, 16
NEED = (4, 5)

# Phrases and labels of the base scan, and sentences that licenses are known by.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-family", "this work is licensed under the gnu general public license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-release", "released under the mit license"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("no-warranty", "the software is provided as is without warranty of any kind"),
)


def words(text: str = "text") -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), CUT, -1), lambda w: w != "")


def least_common(n: int) -> int:
    """Words that a template of n distinct words needs in a block."""
    return -(-n * NEED[0] // NEED[1])


def document_frequency(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each word of the templates: one row a word comes back."""
    held = docs.select(F.explode(F.array_distinct(F.filter(words(), lambda w: w.isin(vocabulary)))).alias("w"))
    return {r.w: r["count"] for r in held.groupBy("w").count().collect()}


def _starts(parts: list[str]) -> Column:
    """Places in ``_words`` where these words stand in a row."""
    at = F.filter(F.transform("_words", lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())

    def all_there(i: Column) -> Column:
        there = F.lit(True)
        for k, part in enumerate(parts[1:], 1):
            there = there & F.coalesce(F.get("_words", i + k) == part, F.lit(False))
        return there

    return F.filter(at, all_there)


def _labelled(at: Column, label: str) -> Column:
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def _phrase_places() -> Column:
    """Places of phrases in ``_words``, as (place, label)."""
    found = [_labelled(_starts(phrase.split()), label) for phrase, label in PHRASES]
    none = F.array().cast("array<struct<at:int,label:string>>")
    return F.when(F.array_contains("_words", "license"), F.concat(*found)).otherwise(none)


def scanned(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row per row of ``docs``."""
    sets = {label: sorted(set(text.split())) for label, text in templates}
    vocabulary = sorted({w for s in sets.values() for w in s})
    df_ = document_frequency(docs, vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (df_.get(w, 0), w)))}
    ordered = {label: sorted(s, key=rank.get) for label, s in sets.items()}
    prefix = {label: s[:len(s) - least_common(len(s)) + 1] for label, s in ordered.items()}
    rare = sorted({w for s in prefix.values() for w in s})

    rows = docs.select("doc_id", words().alias("_words")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumn("_base", _phrase_places())
    hit = F.filter(F.transform("_words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda h: h["w"].isin(vocabulary))
    rows = rows.withColumn("_hits", F.when(F.exists("_words", lambda w: w.isin(rare)), hit))
    rows = rows.select("_row", "doc_id", F.size("_words").cast("long").alias("n_words"), "_base", "_hits")
    starts = F.array_distinct(F.flatten(F.transform(F.filter("_hits", lambda h: h["w"].isin(rare)),
                                                    lambda h: F.array(F.floor(h["i"] / STEP), F.floor(h["i"] / STEP) - 1))))
    rows = rows.withColumn("_start", F.explode_outer(F.filter(starts, lambda b: b >= 0)))
    ranks = F.create_map(*(F.lit(x) for w, i in rank.items() for x in (w, i)))
    inside = F.filter("_hits", lambda h: (h["i"] >= F.col("_start") * STEP) & (h["i"] < F.col("_start") * STEP + WINDOW))
    # the block's vocabulary words as ranks, rare first
    block = F.array_sort(F.array_distinct(F.transform(inside, lambda h: ranks[h["w"]])))
    rows = rows.withColumn("_block", F.when(F.col("_start").isNotNull(), block)).drop("_hits", "_start")

    table = [F.struct(F.lit(label).alias("label"), F.lit(rank[w]).alias("_first"), F.lit(p).alias("_p"), F.lit(len(s)).alias("_n"),
                      F.lit(least_common(len(s))).alias("_m"), F.array(*(F.lit(rank[x]) for x in s)).alias("_set"))
             for label, s in ordered.items() for p, w in enumerate(prefix[label])]
    table = docs.sparkSession.range(1).select(F.inline(F.array(*table)))
    rare_ranks = [rank[w] for w in rare]
    asks = F.filter(F.transform("_block", lambda x, i: F.struct(i.alias("q"), x.alias("first"))), lambda a: a["first"].isin(rare_ranks))
    rows = rows.withColumn("_ask", F.explode_outer(asks)).join(F.broadcast(table), F.col("_ask.first") == F.col("_first"), "left")
    passes = F.expr("size(_block) >= _m and least(_n - _p, size(_block) - _ask.q) >= _m")
    share = F.when(passes, F.size(F.array_intersect("_block", "_set")))
    rows = rows.withColumn("_c", share).withColumn("_met", F.col("_c") >= F.col("_m"))
    rows = (rows.groupBy("_row", "doc_id", "n_words")
            .agg(F.first("_base").alias("_base"), F.collect_set(F.when(F.col("_met"), F.col("label"))).alias("_labels"),
                 F.max(F.when(F.col("_met"), F.col("_c") / F.col("_n"))).alias("_share")))
    at, base = F.transform("_base", lambda b: b["at"]), F.array_distinct(F.transform("_base", lambda b: b["label"]))
    return rows.select("doc_id", "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"),
                       F.array_max(at).cast("long").alias("last_word"), F.array_join(F.array_sort(base), ",").alias("base_labels"),
                       F.array_join(F.array_sort(F.array_union(base, "_labels")), ",").alias("labels"),
                       F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"))


def sql(where: str, templates=TEMPLATES) -> str:
    """The answer in DuckDB SQL, every block against every template."""
    sets = {label: sorted(set(text.split())) for label, text in templates}
    rows = ", ".join(f"('{label}', {w!r}, {len(s)}, {least_common(len(s))})" for label, s in sets.items() for w in s)
    places = " UNION ALL ".join(
        f"SELECT r, i - 1 AS pos, '{label}' AS label FROM x WHERE " + " AND ".join(f"ws[i + {k}] = '{p}'" for k, p in enumerate(phrase.split()))
        for phrase, label in PHRASES)
    return rf"""
WITH t(label, w, n, m) AS (VALUES {rows}),
d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{CUT}'), lambda w: w <> '') AS ws FROM {where}),
x AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
b AS ({places}),
h AS (SELECT r, i - 1 AS pos, ws[i] AS w FROM x WHERE ws[i] IN (SELECT w FROM t)),
k AS (SELECT r, pos, w, unnest([pos // {STEP}, pos // {STEP} - 1]) AS block FROM h),
f AS (SELECT r, label, count(DISTINCT k.w) / any_value(n)::DOUBLE AS share FROM k JOIN t USING (w) WHERE block >= 0 GROUP BY r, block, label HAVING count(DISTINCT k.w) >= any_value(m)),
s AS (SELECT r, max(share) AS share FROM f GROUP BY r),
p AS (SELECT r, count(*) AS n, min(pos) AS a, max(pos) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM b GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM (SELECT r, label FROM b UNION SELECT r, label FROM f) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_base, p.a::BIGINT AS first_word, p.z::BIGINT AS last_word, coalesce(p.l, '') AS base_labels,
  coalesce(l.l, '') AS labels, CASE WHEN p.n > 0 THEN 1.0::DOUBLE ELSE coalesce(s.share, 0) END AS score
FROM d LEFT JOIN p USING (r) LEFT JOIN l USING (r) LEFT JOIN s USING (r)
"""
