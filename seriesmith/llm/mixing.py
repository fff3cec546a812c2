"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, lookup

#: A source's target is at most so many times its size.
MOST = 3


def ranked(sources: DataFrame, key: str, parts: int = 32) -> DataFrame:
    """``sources`` with ``rank`` (from 0) by code point of ``key``, null last.

    Rows are range-partitioned and numbered in their part, behind the rows of earlier parts, so
    many sources do not meet in one task."""
    nulls = F.col(key).isNull()
    dealt = cut(sources.repartitionByRange(parts, nulls, F.col(key)).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # at most ``parts`` rows
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(nulls, F.col(key))) - 1
    return dealt.withColumn("inside", inside).join(F.broadcast(before), "part") \
        .withColumn("rank", (F.col("inside") + F.col("before")).cast("bigint")).drop("part", "inside", "before")


def targets(sizes: DataFrame, most: int = MOST, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``.

    Targets share the sum of all sizes by weight; a source whose share exceeds ``most`` times its
    size gets just that, and the excess is shared again by weight until none exceeds.  Each round
    fixes sources for good and is one small aggregate."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = cut(ranked(sizes, "source").select("source", "source_size", weight.cast("bigint").alias("weight"),
                                              (F.col("source_size") * most).alias("cap")))
    rest, total_weight = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    full = 0
    while True:
        # cap < weight * rest / total_weight, in whole numbers
        above = F.lit(False) if not total_weight else \
            (F.col("cap") * F.lit(total_weight).cast("decimal(38,0)") < F.col("weight") * F.lit(rest).cast("decimal(38,0)"))
        n, taken, used, total, all_weight = rows.agg(
            F.count_if(above), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(above, F.col("weight"))),
            F.sum("source_size"), F.sum("weight")).first()
        if n == full:
            share = F.col("weight") * F.lit(rest or 0) / F.lit(total_weight or 1).cast("double")
            return rows.select("source", "source_size", "weight",
                               F.when(above, F.col("cap").cast("double")).otherwise(share.cast("double")).alias("target"))
        full, rest, total_weight = n, total - taken, all_weight - used


def unit_hash(seed: str, *columns):
    """A number in [0, 1) from the seed and the columns' strings (null and '' differ)."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         seed: str = "mix-1", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``mix_size`` (words), ``mix_source_size``, ``mix_target`` and ``mix_copies``.

    A source's rate is its target by its size; a document is taken floor(rate) times, and once
    more if the hash of seed, id and text falls below the fraction.  So reruns agree, no document
    is taken more than three times, and rows of equal id and text are decided alike.  Null text
    has size 0, a null source is a source of its own, a source of size 0 has target 0 and no
    copies; an empty table gives an empty result.  Sizes are summed before the shuffle; the
    per-source table is joined behind a size check, salted beyond it."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    u = unit_hash(seed, id_col, "__digest")
    rows = docs.withColumn("mix_size", size).withColumn("__digest", F.md5(F.col(text_col))).withColumn("mix_u", u)
    rows = rows.drop("__digest")
    if not keep_text:
        rows = cut(rows.select(id_col, source_col, "mix_size", "mix_u"))
    sizes = rows.groupBy(F.col(source_col).alias("source")).agg(F.sum("mix_size").alias("source_size"))
    table = targets(sizes).select(F.col("source").alias(source_col), F.col("source_size").alias("mix_source_size"),
                                  F.col("target").alias("mix_target"))
    rows = lookup(rows, table, [source_col], F.col("mix_u"))
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (F.col("mix_u") < rate - F.floor(rate)).cast("bigint")
    return rows.withColumn("mix_copies", copies.cast("bigint")).drop("mix_u")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: str = "mix-1") -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as ``plan`` says, columns unchanged."""
    rows = plan(docs, id_col, text_col, source_col, seed).where("mix_copies > 0")
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("mix_copies")))
    return rows.withColumn("mix_copy", copy).select(*[F.col(f"`{c}`") for c in docs.columns])
