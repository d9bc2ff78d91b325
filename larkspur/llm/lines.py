"""Line dedup by a distributed suffix array over line ids.

Only DataFrame functions run here.  Distinct repeated lines are numbered in
order; prefix doubling then ranks the suffixes of every document's sequence of
lines by their first 2, 4, ... lines: a suffix's rank at twice the depth is that
of the pair of its own rank and the rank of the suffix that starts that much
later.  A suffix alone in its rank has its place in the array and drops out;
doubling goes on with the others until none is left.  Suffixes of equal rank are
an interval of the array whose longest common prefix is at least the depth, and
under the next depth for those that part there.  In each interval that is deep
enough, all but the earliest suffix start a later copy as long as the interval's
depth.  Copies that overlap or touch make up maximal runs, which are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, set_aside, stored


def _ranked(classes: DataFrame, by: list[str], tag: str) -> DataFrame:
    """``classes`` (one row each) numbered in the order of ``by``, written.

    Rows are dealt by range and sorted within partitions, so the numbers,
    partition first and place second, ascend with ``by`` without any task that
    sees all rows.
    """
    ordered = classes.repartitionByRange(*by).sortWithinPartitions(*by)
    return stored(ordered.withColumn("rank", F.monotonically_increasing_id()), tag)


def line_table(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, pos, chars, id): every line; its id is its MD5 digest."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text).cast("string"), "\n", -1)).alias("pos", "line"))
    return lines.select(F.col(key).alias("key"), "pos", F.length("line").alias("chars"), F.unhex(F.md5("line")).alias("id"))


def suffix_levels(lines: DataFrame, least: int = 1) -> Iterator[tuple[int, DataFrame]]:
    """(depth, suffixes that share their first ``depth`` lines with another), by rising depth, until there are none.

    Depths are powers of two up to ``least``, and then its doubles.  A level is
    (key, pos, chars, rank, later), written: ``rank`` orders suffixes by their
    ids up to that depth, and ``later`` tells those that start after an equal
    one.  A rank that a third of all lines has is one pre-aggregated row;
    joining it back is left to adaptive execution, which splits it.
    """
    first = F.min(F.struct("key", "pos")).alias("first")
    start = F.struct("key", "pos")
    classes = lines.groupBy("id").agg(first, F.count("*").alias("n")).where("n > 1").drop("n")
    classes = _ranked(classes, ["id"], "line-ranks")
    level = lines.join(classes, "id").select("key", "pos", "chars", "rank", (start != F.col("first")).alias("later"))
    level = stored(level, "suffixes-1")
    done = 1
    while level.head(1):
        yield done, level
        # Twice as deep, or up to the least depth by overlapping ranks.
        step = min(done, least - done) if done < least else done
        ahead = level.select("key", (F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
        pairs = level.select("key", "pos", "chars", F.col("rank").alias("own")).join(ahead, ["key", "pos"])
        classes = pairs.groupBy("own", "next").agg(first, F.count("*").alias("n")).where("n > 1").drop("n")
        classes = _ranked(classes, ["own", "next"], "ranks")
        level = pairs.join(classes, ["own", "next"]).select("key", "pos", "chars", "rank", (start != F.col("first")).alias("later"))
        done += step
        level = stored(level, f"suffixes-{done}")


def suffix_ranks(lines: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """The levels of suffixes that share their first line, and that share ``depth`` lines."""
    single = level = None
    for done, level in suffix_levels(lines, depth):
        single = single or level
        if done >= depth:
            return single, level
    none = lines.select("key", "pos", "chars", F.lit(0).cast("long").alias("rank"), F.lit(False).alias("later")).where("false")
    return single or none, none


def repeated_runs(lines: DataFrame, min_lines: int = 4, min_chars: int = 20) -> DataFrame:
    """(key, start, stop): the maximal runs of lines that are later copies."""
    parts = None
    for depth, level in suffix_levels(lines, min_lines):
        later = level.where("later")
        if depth < min_lines:
            later = later.where(F.col("chars") >= min_chars) if depth == 1 else later.where("false")
        if depth == 1 or depth >= min_lines:
            part = later.select("key", "pos", F.lit(depth).alias("depth"))
            parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = lines.select("key", "pos", F.lit(1).alias("depth")).where("false")
    in_order = Window.partitionBy("key").orderBy("pos", "depth")
    reach = F.max(F.col("pos") + F.col("depth")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("pos") > reach, F.lit(True)).cast("int")
    runs = parts.withColumn("opens", opens).withColumn("run", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("key", "run").agg(F.min("pos").alias("start"), F.max(F.col("pos") + F.col("depth")).alias("stop")).drop("run")


def removal_masks(docs: DataFrame, text: str = "text", key: str = "_key", min_lines: int = 4, min_chars: int = 20) -> DataFrame:
    """(mask_key, removed, mask): per document with copies, their number and a byte string.

    Byte i of ``mask`` is '1' if line i goes; lines beyond it stay.
    """
    runs = repeated_runs(line_table(docs, text, key), min_lines, min_chars)
    gone = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("at"))
    bits = F.expr("array_join(transform(at, (r, i) -> concat(repeat('0', r.start - if(i = 0, 0, at[i - 1].stop)), repeat('1', r.stop - r.start))), '')")
    removed = F.aggregate("at", F.lit(0), lambda n, r: n + r["stop"] - r["start"]).cast("long")
    return gone.select(F.col("key").alias("mask_key"), removed.alias("removed"), F.encode(bits, "UTF-8").alias("mask"))


def remove_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_lines: int = 4, min_chars: int = 20) -> DataFrame:
    """``docs`` with its text freed of later copies, and n_lines and n_removed.

    Lines are parted by a line feed and compared as they are.  Copies are lines
    of at least ``min_chars`` characters, and runs of at least ``min_lines``
    lines, that also start earlier (smaller id, or same document, earlier
    line); each is judged on the input.  Null texts stay null with no lines, an
    empty text is one empty line, and a text all of whose lines go is empty.
    Rows whose id repeats or lacks are documents of their own in the order of
    (id, text).  Columns of ``docs`` by the names n_lines and n_removed are
    replaced, others stay as they are.
    """
    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    rows, now = set_aside(docs.select(*[F.col(f"`{c}`") for c in columns]), ("_key", "mask_key", "removed", "mask", "_lines"))
    text, doc_id = now[text], now[doc_id]
    rows = keyed(rows, text, doc_id)
    masks = stored(removal_masks(rows, text, "_key", min_lines, min_chars), "masks")
    # Merged at every size: a plan that broadcasts masks while they are few would not be the one that runs on many.
    out = rows.join(masks.hint("merge"), rows["_key"] == masks["mask_key"], "left")
    out = out.withColumn("_lines", F.split(F.col(text).cast("string"), "\n", -1))
    left = F.filter("_lines", lambda line, i: F.coalesce(F.substring(F.col("mask"), i + 1, F.lit(1)) != F.lit(b"1"), F.lit(True)))
    kept = F.when(F.col("mask").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    out = out.withColumn("n_lines", F.coalesce(F.size("_lines"), F.lit(0)).cast("long"))
    out = out.withColumn("n_removed", F.coalesce("removed", F.lit(0).cast("long"))).withColumn(text, kept)
    return out.select(*[F.col(f"`{now[c]}`").alias(c) for c in columns], F.greatest("n_lines", F.lit(0).cast("long")).alias("n_lines"), "n_removed")
