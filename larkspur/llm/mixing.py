"""Mixing sources to target weights by repetition rates.

Tokens are aggregated per source, a target is derived for each source, and
every document is emitted ``floor(rate)`` times plus one further copy with the
probability of the rate's fraction, drawn from a hash of its id.  A rerun, or a
task that is run again on another executor, makes the same draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import set_aside, stored, word_count

#: Up to this many sources the table of rates is broadcast (about 10 MB).
BROADCAST_SOURCES = 100_000


def hash_uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**52))


def source_targets(
    sizes: DataFrame, source: str = "source", size: str = "size", weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """Per source: ``mix_source``, ``source_size`` and ``target``.

    Sources by code point, null last, weigh ``weights`` in turn.  Together the
    targets make ``share`` of all sizes; one that would exceed ``cap`` times
    its source stops there and what is over goes to the others by weight.
    That fixed point is found in one pass: by growing ``cap * size / weight``,
    sources are capped until the level that is left no longer reaches the
    next.  The windows run over one row per source, not over documents.
    An empty table has no sources; a source without words has target 0.
    """
    per = sizes.groupBy(F.col(source).alias("mix_source")).agg(F.sum(size).cast("long").alias("source_size"))
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("mix_source").asc_nulls_last())
    per = per.withColumn("_turn", F.row_number().over(by_name)).withColumn(
        "_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_turn") - 1) % len(weights) + 1)
    )
    per = per.withColumn("_cap", F.col("source_size") * F.lit(cap))
    by_level = Window.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col("_turn").asc())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight = F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    per = per.withColumn("_level", left / weight)
    free = F.col("_level") * F.col("_weight") < F.col("_cap")
    per = per.withColumn("_level", F.max(F.when(free, F.col("_level"))).over(every))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_weight"), F.col("_cap")))
    return per.select("mix_source", "source_size", target.alias("target"))


def mix_plan(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: str = "mix:", **targets
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``.

    Null texts have size 0; documents of a source without words get no copy.
    Rows with one id draw alike; a null id draws as the empty string.  Columns
    of ``docs`` by those four names, or ``mix_source``, are replaced.
    The hot source costs nothing extra: sums are combined before the shuffle,
    and the table of rates is broadcast while it has at most
    ``BROADCAST_SOURCES`` rows; beyond, it is joined by shuffle, where adaptive
    execution splits the partition of a hot source.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "mix_source")
    docs = docs.withColumn("size", word_count(F.col(text)))
    rates = stored(source_targets(docs.select(source, "size"), source, "size", **targets), "mix-rates")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    out = docs.join(rates, docs[source].eqNullSafe(F.col("mix_source")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    drawn = (hash_uniform(F.col(doc_id), seed) < rate - whole).cast("long")
    return out.withColumn("copies", (whole + drawn).cast("long")).drop("mix_source")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken.

    Columns stay as they are, whatever their names.  Rows with null texts or of
    sources without words are not taken; repeated rows are rows of their own.
    """
    own, now = set_aside(docs, ("size", "source_size", "target", "copies", "mix_source", "_copy"))
    planned = mix_plan(own, now[text], now[source], now[doc_id], **options)
    taken = planned.where("copies > 0").withColumn("_copy", F.explode(F.expr("sequence(1L, copies)")))
    return taken.select(*[F.col(f"`{now[c]}`").alias(c) for c in docs.columns])
