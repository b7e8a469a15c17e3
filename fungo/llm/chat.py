"""Chat formatting by multi-party perspective rotation.

Every participant of a dialogue (a distinct role) gets a rendering of the whole dialogue
in which that participant is the assistant and all others are users under their own
names. Only the assistant's text and its end mark are trained on; their character spans
are the mask.

A rendering comes in blocks of at most ``TURNS`` turns, numbered from 0, so a dialogue of
any length is never gathered in one row or task; the blocks in order are the dialogue.
Turns are numbered by two steps: turn numbers are cut into chunks whose row counts are
summed per dialogue, and rows are ordered within their chunk only.

Edge cases: a null role is "unknown", a null text is empty, a null turn comes first. Turns
with the same number are ordered by role, then text; rows that repeat are turns of their
own. A dialogue of one participant has one rendering. Marks that occur in a text or a name
are broken by a blank, so no text can open or close a turn. Without turns there is nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

TURNS = 64
OPEN_OWN, OPEN_OTHER, OPEN_END, CLOSE = "<|assistant|>\n", "<|user:", "|>\n", "<|end|>\n"


def _safe(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def rotated(conversations: DataFrame, turns: int = TURNS) -> DataFrame:
    """(conv_id, speaker, block, n_turns, n_trained, rendered, spans): spans are (from, to) of trained characters."""
    rows = conversations.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("chunk", F.floor(F.col("turn") / turns))
    counts = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"))
    before = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text"))
    rows = rows.withColumn("place", place).join(counts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk")))
    rows = rows.withColumn("place", F.col("place") + F.col("_before") - 1).withColumn("block", F.floor(F.col("place") / turns).cast("int"))
    own, name = _safe(F.col("text")), _safe(F.col("role"))
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("place", "role", name.alias("name"), own.alias("text")))).alias("t"))
    people = rows.select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    out = blocks.join(people, F.col("conv_id").eqNullSafe(F.col("_conv")))

    def piece(t: Column) -> Column:
        mine = F.concat(F.lit(OPEN_OWN), t["text"], F.lit(CLOSE))
        return F.when(t["role"] == F.col("speaker"), mine).otherwise(F.concat(F.lit(OPEN_OTHER), t["name"], F.lit(OPEN_END), t["text"], F.lit(CLOSE)))

    out = out.withColumn("pieces", F.transform("t", piece))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("spans"))

    def step(a: Column, i: Column) -> Column:
        end = a["at"] + F.length(F.get("pieces", i))
        span = F.struct((a["at"] + len(OPEN_OWN)).alias("from"), end.alias("to"))
        mine = F.get("t", i)["role"] == F.col("speaker")
        return F.struct(end.alias("at"), F.when(mine, F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    spans = F.aggregate(F.sequence(F.lit(0), F.size("t") - 1), start, step, lambda a: a["spans"])
    return out.select("conv_id", "speaker", "block", F.size("t").cast("long").alias("n_turns"),
                      F.size(F.filter("t", lambda t: t["role"] == F.col("speaker"))).cast("long").alias("n_trained"),
                      F.array_join("pieces", "").alias("rendered"), spans.alias("spans"))
