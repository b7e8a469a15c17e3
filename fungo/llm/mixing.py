"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words. Sources in code-point order, null last, weigh
1, 2, 3, 1, 2, 3, ... and share the sum of all sizes by weight. A target stops at
``MOST`` times its source's size; what is over is shared again by weight until no target
is above. That is ``least(MOST * size, level * weight)`` for the one level at which the
targets add up, found over one row per source.

Each document of a source expects ``target / size of the source`` copies. The documents
of a source stand in one order, their expected copies are summed in that order, one
offset in [0, 1) is added, and a document is emitted once for each integer that its step
crosses. Similar sizes stand together, so what is taken stays near the target.

A source may hold a third of all rows and is no single group: the order runs through
cells of (size class, bucket of the id's md5). Cells are counted, the counts summed per
source (as many rows as there are size classes, square roots of sizes, times ``BUCKETS``),
and only the rows of one cell are ordered together.

Edge cases: a null text has size 0, a document without an id stands in bucket 0. A source
whose documents are all empty has target 0 and nothing is emitted. Rows that repeat are
documents of their own. Nothing depends on chance: the offset is derived from the source.
Extra columns pass through ``emit``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fungo.llm.common import WORD

MOST = 3
BUCKETS = 256
KEY = ("_none", "_source")


def _hex(c: Column, digits: int) -> Column:
    """Leading hexadecimal digits of the md5 of a text, as a number."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, digits), 16, 10).cast("long")


def sized(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Size, key of the source, cell and a number for ties of each document; ``_doc`` holds the columns to carry, by default all."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    bucket = F.coalesce(_hex(F.col("doc_id").cast("string"), 6) % BUCKETS, F.lit(0)).cast("int")
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("_doc"), F.col("doc_id").alias("_id"), F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"),
                       size.alias("_size"), F.xxhash64("text").alias("_tie"), bucket.alias("_bucket"))
    return rows.withColumn("_class", F.floor(F.sqrt("_size")).cast("int"))


def targets(cells: DataFrame) -> DataFrame:
    """One row per source: its size, target, expected copies of a document and offset."""
    s = cells.groupBy(*KEY).agg(F.sum("_words").alias("source_size"))
    order = W.orderBy(*KEY)
    s = s.withColumn("_w", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("_cap", F.lit(MOST) * F.col("source_size"))
    # sources by the level at which they stop; those before the first that fits are at their cap
    rising = W.orderBy(F.col("_cap") / F.col("_w"), *KEY)
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    rest = rising.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("_level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(rest))
    s = s.withColumn("_fits", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level")))
    s = s.withColumn("_level", F.max("_fits").over(everything))
    s = s.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")))
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    name = F.concat(F.when(F.col("_none"), "n").otherwise("s"), F.col("_source"))
    return s.select(*KEY, "source_size", "target", copies.alias("_copies"), (_hex(name, 5) / F.lit(float(1 << 20))).alias("_offset"))


def mixed(rows: DataFrame) -> DataFrame:
    """(_doc, size, source_size, target, copies) of rows of ``sized``; copies are the times a document is taken."""
    cell = [*KEY, "_class", "_bucket"]
    cells = rows.select(*cell, "_size").groupBy(*cell).agg(F.count("*").alias("_n"), F.sum("_size").alias("_words"))
    before = W.partitionBy(*KEY).orderBy("_class", "_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    starts = starts.join(targets(cells), list(KEY)).drop("_n", "_words")
    rows = rows.withColumn("_at", F.row_number().over(W.partitionBy(*cell).orderBy("_size", "_id", "_tie")))
    rows = rows.join(starts, cell)
    end = (F.col("_before") + F.col("_at")) * F.col("_copies") + F.col("_offset")
    begin = (F.col("_before") + F.col("_at") - 1) * F.col("_copies") + F.col("_offset")
    return rows.select("_doc", F.col("_size").alias("size"), "source_size", "target", (F.floor(end) - F.floor(begin)).cast("int").alias("copies"))


def emit(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    rows = mixed(sized(docs)).where("copies > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_doc.*")
