"""Registered queries of the text operators, with their SQL where SQL can state the answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fungo.llm import chat, cuckoo, katz, licenses, mixing, negatives, packing, quality, quality_rules, runs, topk, toxicity
from fungo.llm.common import WORD, is_held_out, table
from fungo.llm.ngram_join import NgramJoin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def _classified(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", is_held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _classified(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 0.5)


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _classified(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 0.3)


# Links, then components by the smallest label that any chain of links brings.
NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
t AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
links AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS c FROM d UNION SELECT links.v, reach.c FROM reach JOIN links ON links.u = reach.u WHERE reach.c < links.v)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, m.c AS component_id FROM s JOIN (SELECT u, min(c) AS c FROM reach GROUP BY u) m ON m.u = s.doc_id
"""


@query("op2_ngram_join", NEAR_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NgramJoin(table(spark, sf_dir, "documents")).membership()


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
c AS (SELECT *, floor(sqrt(size))::INT AS cls, coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 6))::BIGINT % 256, 0) AS bucket FROM d),
s AS (SELECT source IS NULL AS none, coalesce(source, '') AS src, sum(size)::BIGINT AS source_size FROM c GROUP BY ALL),
w AS (SELECT *, ((row_number() OVER (ORDER BY none, src) - 1) % 3 + 1)::DOUBLE AS w, 3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, none, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(w) OVER (ORDER BY cap / w, none, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, max(CASE WHEN level * w <= cap THEN level END) OVER () AS top FROM l),
t AS (SELECT none, src, source_size, least(cap::DOUBLE, top * w) AS target,
        ('0x' || substr(md5(CASE WHEN none THEN 'n' ELSE 's' END || src), 1, 5))::BIGINT / 1048576.0::DOUBLE AS off FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0 END AS copies FROM t),
r AS (SELECT c.*, row_number() OVER (PARTITION BY source ORDER BY cls, bucket, size, doc_id, text) AS pos FROM c)
SELECT doc_id, size, source_size, target,
  (size * (floor(pos * copies + off) - floor((pos - 1) * copies + off))::BIGINT)::BIGINT AS taken
FROM r JOIN e ON none = (source IS NULL) AND src = coalesce(source, '')
"""


@query("op3_mixing", MIX_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(mixing.sized(table(spark, sf_dir, "documents"), ["doc_id"]))
    return rows.select("_doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op4_quality_rules", quality_rules.sql("documents"))
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_licenses", licenses.sql("documents"))
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


CHAT_SQL = r"""
WITH c AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM c),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM c),
s AS (SELECT n.conv_id, speaker, place, (place // 64)::INT AS block, role = speaker AS own,
        CASE WHEN role = speaker THEN '<|assistant|>' || chr(10) ELSE '<|user:' || replace(replace(role, '<|', '< |'), '|>', '| >') || '|>' || chr(10) END
        || replace(replace(text, '<|', '< |'), '|>', '| >') || '<|end|>' || chr(10) AS piece FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
e AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, speaker, block ORDER BY place) AS z FROM s)
SELECT conv_id, speaker, block, count(*)::BIGINT AS n_turns, count(*) FILTER (own)::BIGINT AS n_trained, string_agg(piece, '' ORDER BY place) AS rendered,
  coalesce(string_agg((z - length(piece) + 14)::BIGINT || '-' || z::BIGINT, ',' ORDER BY place) FILTER (own), '') AS spans
FROM e GROUP BY conv_id, speaker, block
"""


@query("op5_chat", CHAT_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.rotated(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["from"].cast("string"), F.lit("-"), s["to"].cast("string"))), ",")
    return rows.withColumn("spans", spans)


TOPK_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.v, v.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""


@query("op6_topk", TOPK_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)


@query("op10_katz")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = katz.scores(docs, "crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2")
    return rows.select("doc_id", is_held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


# A run of at least 24 words and three periods has two equal stretches of 16 words one period apart.
RUNS_SQL = r"""
WITH k AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM documents, k),
g AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS cut FROM d),
e AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // cut) END]) END AS w FROM g),
s AS (SELECT r, n, w, unnest(range(n - 15)) AS i FROM e WHERE n >= 24),
u AS MATERIALIZED (SELECT r, n, i, array_to_string(w[i + 1:i + 16], ' ') AS x FROM s),
p AS (SELECT a.r, a.i, b.i - a.i AS p FROM u a JOIN u b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
o AS (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM p),
f AS (SELECT r, p, min(i) AS start, max(i) + 16 + p - min(i) AS length FROM o GROUP BY r, p, island),
m AS MATERIALIZED (SELECT r, start, length, min(p) AS period FROM f WHERE length >= greatest(24, 3 * p) GROUP BY r, start, length),
b AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
        first({'s': start, 'l': length, 'p': period} ORDER BY length / period DESC, start, period) AS best FROM m GROUP BY r),
x AS (SELECT r, w, unnest(range(n)) AS i FROM e WHERE r IN (SELECT r FROM m)),
y AS (SELECT DISTINCT x.r, x.i FROM x JOIN m ON x.r = m.r AND x.i >= m.start + m.period AND x.i < m.start + m.length),
z AS (SELECT r, string_agg(w[i + 1], ' ' ORDER BY i) AS left_over FROM x ANTI JOIN y USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period, (1000 * best.l // best.p)::BIGINT AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(left_over, array_to_string(w, ' '))) AS collapsed_sha256
FROM e LEFT JOIN b USING (r) LEFT JOIN z USING (r)
"""


@query("op11_runs", RUNS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.regexp_extract_all("text", F.lit(WORD), 0)
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    docs = docs.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = "slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)"
    text = F.when(F.col("a").isNull(), F.col("text")).otherwise(F.expr(f"array_join(concat(slice(words, 1, a), {tail}), ' ')"))
    rows = runs.annotated(docs.select("doc_id", text.alias("text"))).drop("text")
    best = F.expr("array_max(transform(runs, r -> struct(r.length / r.period as ratio, -r.start as start, -r.period as period, r.length as length)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    rows = rows.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


DEDUP_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER g = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t ORDER BY n DESC, doc_id, r)
"""


@query("op12_exact_dedup", DEDUP_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.CuckooIndex(spark).insert(table(spark, sf_dir, "documents")).decisions()


NEGATIVES_SQL = """
WITH v AS (SELECT DISTINCT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS y, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, a.v AS av, a.y, c.vec_id AS c, a.y = c.y AS same, list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a, av, y ORDER BY score DESC, c) <= 5)
SELECT p.a AS anchor_id, p.c AS positive_id, (row_number() OVER w)::INT AS rank, s.c AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND p.av = s.av AND p.y = s.y AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.a, p.av, p.y, p.c, p.score ORDER BY s.score DESC, s.c)
QUALIFY row_number() OVER w <= 5
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return negatives.mined(table(spark, sf_dir, "embeddings").withColumn("label", label), "vec_id % 100 = 0")
