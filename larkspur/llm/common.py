"""What the operators share: the shared work folder, stored tables, words."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words, as a Java pattern of the words between them.
WORD = r"[^\x20\x09-\x0D]+"


_SCRATCH: list[list[str]] = []
_FOLDERS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``; only a session without that setting (a
    single-process test) gets a local temporary folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jsc = spark.sparkContext._jsc.sc()
        known = jsc.getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="larkspur-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path for one written table in the shared folder."""
    folder = f"{shared_dir(spark).rstrip('/')}/larkspur-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        atexit.register(_leave, at, spark.sparkContext._jsc.hadoopConfiguration())
    path = f"{folder}/{tag}-{uuid.uuid4().hex[:12]}"
    for made in _SCRATCH[-1:]:
        made.append(path)
    return path


def _leave(folder, configuration) -> None:
    """Deletes an application's intermediate tables when the driver's process ends."""
    with suppress(Exception):  # the JVM or the storage may be gone by then
        folder.getFileSystem(configuration).delete(folder, True)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes what is :func:`stored` within, once it is over and what was made of it is written.

    Paths taken off the list stay.  Within one process and thread only.
    """
    _SCRATCH.append([])
    try:
        yield _SCRATCH[-1]
    finally:
        for path in _SCRATCH.pop():
            delete(spark, path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the actions within; the session's own setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, tag: str, codec: str = "zstd", rows: int = 1000) -> DataFrame:
    """``df`` written to the shared folder and read again.

    This cuts lineage: a lost executor costs a reread, not a recomputation,
    and later plans see one fixed version of every row.  Python stages of its
    plan get batches of ``rows`` rows, since with Spark's own bound of 64 MB a
    batch is held several times over on its way.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    with arrow_rows(spark, rows):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", key: str = "_key") -> DataFrame:
    """``docs`` with a unique long ``key``, in the order of ids.

    That is the id itself; only where ids repeat or lack, the rows are written
    with a number in the order of (id, text), nulls first.
    """
    n, known, ids = docs.agg(F.count("*"), F.count(doc_id), F.countDistinct(doc_id)).first()
    if n == known == ids:
        return docs.withColumn(key, F.col(doc_id).cast("long"))
    by = [F.col(doc_id).asc_nulls_first(), F.col(text).asc_nulls_first()]
    ordered = docs.repartitionByRange(*by).sortWithinPartitions(*by)
    return stored(ordered.withColumn(key, F.monotonically_increasing_id()), "keyed")


def slices(batches: Iterable[pa.RecordBatch], column: int, rows: int = 1000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """``batches`` cut, in the worker, into parts of few enough rows and bytes of ``column``.

    Spark bounds a batch at 64 MB whatever its rows; a worker that holds several
    arrays for each word wants less.  A row is never cut, so one that is longer
    is a part of its own.
    """
    for batch in batches:
        n = batch.num_rows
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, min(n, at + rows, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, stop - at)
            at = stop


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores before it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with those columns renamed that have one of ``names``, and what each column is called now."""
    taken = {c.lower() for c in (*df.columns, *names)}
    now = {}
    for c in df.columns:
        now[c] = c
        if c.lower() in {n.lower() for n in names}:
            while now[c].lower() in taken:
                now[c] = "_" + now[c]
            taken.add(now[c].lower())
    return df.select(*[F.col(f"`{c}`").alias(now[c]) for c in df.columns]), now


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that near values land far apart."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """64-bit hashes of all words of a byte string at once, in numpy.

    A word's bytes, through a table of random odd-seeded values, are the digits
    of a polynomial in an odd base modulo 2**64; prefix sums give each word's
    value, and multiplying by the base's inverse power makes it independent of
    the word's place.  Such a polynomial has collisions that can be built from
    long regular words, so words above ``SHORT`` bytes are hashed one by one
    with XXH64 instead.  Hashers of different seeds are independent.
    """

    SHORT = 24
    BASE = 0x5851F42D4C957F2D

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.seed = seed
        self.digit = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)
        self.inverse = pow(self.BASE, -1, 2**64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.BASE), ("down", self.inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])

    def words(self, data: bytes, prefix: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words of ``data``, or of their first ``prefix`` bytes."""
        raw = np.frombuffer(data, np.uint8)
        n = len(raw)
        edge = np.ones(n + 2, bool)
        edge[1:-1] = self.SPACE[raw]
        turn = np.flatnonzero(edge[1:] != edge[:-1])
        start, end = turn[::2], turn[1::2]
        if not len(start):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64)
        if prefix:
            end = np.minimum(end, start + prefix)
        self._powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.digit[raw] * self.up[:n], out=total[1:])
        value = (total[end] - total[start]) * self.down[start]
        hashes = mix64(value ^ (end - start).astype(np.uint64))
        for i in np.flatnonzero(end - start > self.SHORT):
            hashes[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]], self.seed)
        return start, end, hashes
