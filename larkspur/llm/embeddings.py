"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected at random to eight dimensions, once per table, and
decoded to the nearest point of the E8 lattice, their cell.  Vectors that meet
in a cell, or whose nearest neighbouring cells hold another, are compared by
their exact cosine.  A pair that shares cells in several tables is counted at
the first, so links of a cell are summed where they are found and need not be
collected; what leaves a cell is a count and a component per vector, and the
few pairs that only a neighbouring cell found.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, stored
from .components import connected_components, forest

TABLES = 8
#: Neighbouring cells that a vector looks into.
PROBES = 2
#: Length to which unit vectors are scaled before they are decoded.
SCALE = 1.5
#: Rows of a cell that are compared at a time.
BLOCK = 2048


def lattice_steps() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled so that they are whole numbers."""
    whole = [v for v in product((-2, 0, 2), repeat=8) if sum(x != 0 for x in v) == 2]
    half = [v for v in product((-1, 1), repeat=8) if v.count(-1) % 2 == 0]
    return np.array(whole + half)


STEPS = lattice_steps()


def _even(points: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: where it is odd, the worst rounding goes the other way."""
    near = np.rint(points)
    off = points - near
    worst = np.abs(off).argmax(axis=1)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    near[odd, worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1, -1)
    return near


def decode(points: np.ndarray) -> np.ndarray:
    """Nearest points of E8, doubled."""
    a, b = _even(points), _even(points - 0.5) + 0.5
    closer = ((points - a) ** 2).sum(axis=1) <= ((points - b) ** 2).sum(axis=1)
    return np.rint(2 * np.where(closer[:, None], a, b)).astype(np.int64)


def _cell(table: int, points: np.ndarray) -> np.ndarray:
    """One number for a table's lattice point; unequal points that share one are told apart by their cosines."""
    key = np.full(points.shape[:-1], table + 1, np.uint64)
    for k in range(8):
        key = mix64(key * np.uint64(0xD1342543DE82EF95) + points[..., k].astype(np.uint64))
    return key.view(np.int64)


def cells(vectors: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Own cells (n, tables) and neighbouring cells (n, tables, probes) of unit vectors."""
    n, size = vectors.shape
    own, near = np.empty((n, tables), np.int64), np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        turn = np.random.default_rng([size, t]).normal(size=(size, 8))
        turn = np.linalg.qr(turn)[0] * (size / 8) ** 0.5 if size >= 8 else turn
        points = vectors @ turn * scale
        at = decode(points)
        own[:, t] = _cell(t, at)
        # The nearest neighbours are those whose steps agree best with what decoding left over.
        gain = (2 * points - at) @ STEPS.T - (STEPS**2).sum(axis=1) / 2
        best = np.argpartition(-gain, probes, axis=1)[:, :probes]
        near[:, t] = _cell(t, at[:, None, :] + STEPS[best])
    return own, near


def _typed(rows: DataFrame, embedding: str) -> Column:
    """Components as they are stored if those are floats, else as doubles; a negative zero is a zero."""
    kind = "float" if dict(rows.dtypes)[embedding] == "array<float>" else "double"
    return F.transform(F.col(embedding).cast(f"array<{kind}>"), lambda x: x + F.lit(0.0).cast(kind))


def digested_vectors(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, embedding, digest) of every row; those that can't link have no digest and no embedding.

    The digest is SHA-256 of the components' texts, which tell all floats apart,
    and stands for the vector wherever rows are grouped or joined.
    """
    usable = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    some = F.exists(embedding, lambda x: x != 0)
    own = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(usable & some, _typed(rows, embedding)).alias("embedding"))
    text = F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",")
    return own.withColumn("digest", F.unhex(F.sha2(text, 256)))


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(digest, rep, n, embedding): usable vectors, equal ones as one named by their smallest id."""
    good = vectors.where("digest IS NOT NULL").groupBy("digest")
    return good.agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding"))


def _dealt(vectors: DataFrame, ship: bool) -> DataFrame:
    """Rows of cells: (t, cell, role) and, to ``ship``, (id, n, own, vector); role 0 is at home, 1 looks in."""
    names = ["t", "cell", "role"] + ["id", "n", "own", "vector"] * ship
    single = dict(vectors.dtypes)["embedding"] == "array<float>"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            every = batch.column(2).to_pylist()
            ids, counts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for size in sorted({len(v) for v in every}):
                at = [i for i, v in enumerate(every) if len(v) == size]
                raw = np.array([every[i] for i in at], float)
                own, near = cells(_unit(raw))
                more = []
                if ship:
                    data = pa.array([r.tobytes() for r in raw.astype(np.float32 if single else float)], pa.binary())
                    more = [pa.array(ids[at]), pa.array(counts[at]), pa.array([o.tobytes() for o in own], pa.binary()), data]
                for t in range(TABLES):
                    for role, keys in [(0, own[:, t])] + [(1, near[:, t, p]) for p in range(PROBES)]:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(keys), pa.array(np.full(len(at), role, np.int32)), *more], names)

    spark = vectors.sparkSession
    spread = vectors.select("rep", "n", "embedding").repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spread.mapInArrow(deal, "t int, cell long, role int" + ", id long, n long, own binary, vector binary" * ship)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _blocks(vectors: DataFrame) -> DataFrame:
    """Rows of cells with (kind, i, j): cells of over BLOCK rows are compared by pairs of blocks.

    Each pair of a cell's rows meets in exactly one block pair: rows at home in
    (0, i, j) with i <= j, those that look in at (1, q, j).  Cells are counted
    first, without their vectors; large ones are few, one for BLOCK rows at
    most, and joined by broadcast while they are at most 100,000.
    """
    sizes = _dealt(vectors, False).groupBy("t", "cell").agg(F.sum(1 - F.col("role")).alias("homes"), F.sum("role").alias("guests"))
    large = stored(sizes.where((F.col("homes") > BLOCK) | (F.col("guests") > BLOCK)), "large-cells")
    met = _dealt(vectors, True).join(F.broadcast(large) if large.count() <= 100_000 else large, ["t", "cell"], "left")
    met = met.withColumn("nh", F.greatest(F.ceil(F.coalesce("homes", F.lit(1)) / BLOCK), F.lit(1)))
    met = met.withColumn("ng", F.greatest(F.ceil(F.coalesce("guests", F.lit(1)) / BLOCK), F.lit(1)))
    met = met.withColumn("mine", F.pmod(F.xxhash64("id"), F.when(F.col("role") == 0, F.col("nh")).otherwise(F.col("ng"))))
    # A cell of one block is one group, of both kinds at once.
    home = F.expr(
        "concat(transform(sequence(0L, nh - 1), j -> named_struct('kind', 0, 'i', least(mine, j), 'j', greatest(mine, j))), "
        "transform(sequence(0L, ng - 1), q -> named_struct('kind', 1, 'i', q, 'j', mine)))"
    )
    guest = F.expr("transform(sequence(0L, nh - 1), j -> named_struct('kind', 1, 'i', mine, 'j', j))")
    whole = F.expr("array(named_struct('kind', 2, 'i', 0L, 'j', 0L))")
    block = F.when(F.col("nh") + F.col("ng") == 2, whole).when(F.col("role") == 0, home).otherwise(guest)
    return met.withColumn("block", F.explode(block)).select("t", "cell", "block.*", "role", "mine", "id", "n", "own", "vector")


def _compare(blocks: DataFrame, least: float, kept: str) -> DataFrame:
    """Per vector its links found at home and a reachable id, (id, count, other id, -1); or a pair (a, n_b, b, n_a)."""
    names = ["a", "x", "b", "y"]

    def one(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        t, kind, i, j = rows[0][0], rows[0][2], rows[0][3], rows[0][4]
        role, mine = np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
        ids, n = np.array([r[7] for r in rows]), np.array([r[8] for r in rows])
        own = np.frombuffer(b"".join(r[9] for r in rows), np.int64).reshape(len(rows), -1)
        sizes = np.array([len(r[10]) for r in rows])
        home, guest = role == 0, role == 1
        for size in np.unique(sizes):
            same = sizes == size
            sides = []
            if kind in (0, 2):
                sides.append((0, same & home & (mine == i), same & home & (mine == j)))
            if kind in (1, 2):
                sides.append((1, same & guest, same & home))
            for what, left, right in sides:
                left, right = np.flatnonzero(left), np.flatnonzero(right)
                if not len(left) or not len(right) or (what == 0 and i == j and len(left) < 2):
                    continue
                a, b = (_unit(np.frombuffer(b"".join(rows[k][10] for k in x), kept).reshape(len(x), -1).astype(float)) for x in (left, right))
                for start in range(0, len(left), 512):  # a slab of the block at a time
                    part = left[start : start + 512]
                    link = (a[start : start + 512] @ b.T >= least) & (ids[part][:, None] != ids[right][None, :])
                    p, q = np.nonzero(link)
                    seen = own[part[p]] == own[right[q]]
                    new = ~(seen if what else seen[:, :t]).any(axis=1)
                    p, q = part[p[new]], right[q[new]]
                    if len(p):
                        yield from links(ids, n, p, q, what, i == j)

    def links(ids: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray, what: int, both: bool) -> Iterator[pa.RecordBatch]:
        if what == 1:
            low, high = np.where(ids[p] < ids[q], p, q), np.where(ids[p] < ids[q], q, p)
            yield pa.RecordBatch.from_arrays([pa.array(ids[low]), pa.array(n[high]), pa.array(ids[high]), pa.array(n[low])], names)
            return
        # Links of rows of one block are seen from both ends here, others from one.
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, p, n[q])
        if not both:
            np.add.at(count, q, n[p])
        edges = forest(p, q, len(ids))
        got = np.flatnonzero(count)
        rows = [(ids[got], count[got], ids[got]), (ids[edges[:, 0]], np.zeros(len(edges), np.int64), ids[edges[:, 1]])]
        for x, c, y in rows:
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(c), pa.array(y), pa.array(np.full(len(x), -1))], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in parts(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:5] != key:
                    if len(rows) > 1:
                        yield from one(rows)
                    key, rows = row[:5], []
                rows.append(row)
        if len(rows) > 1:
            yield from one(rows)

    keys = ["t", "cell", "kind", "i", "j"]
    ordered = blocks.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "role", "mine", "id", "n", "own", "vector")
    return ordered.mapInArrow(compare, "a long, x long, b long, y long")


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, zero, or hold null or non-finite components, and
    those without an id, link with nothing and are their own component.  Equal
    vectors are compared once and count as often as they come; vectors of other
    lengths never link.  Other columns of ``rows`` are left behind whatever
    their names.
    """
    vectors = digested_vectors(rows, vec_id, embedding)
    members = stored(vectors.select("vec_id", "digest"), "members")
    distinct = stored(distinct_vectors(vectors), "distinct-vectors")
    kept = "<f4" if dict(distinct.dtypes)["embedding"] == "array<float>" else "<f8"
    found = stored(_compare(_blocks(distinct), least, kept), "links")
    pairs = found.where("y >= 0").distinct()
    counts = found.where("y < 0").select("a", "x").unionByName(pairs.select("a", "x")).unionByName(pairs.select(F.col("b").alias("a"), F.col("y").alias("x")))
    counts = counts.groupBy("a").agg(F.sum("x").alias("links"))
    components = connected_components(found.select("a", "b"))
    known = distinct.join(counts, distinct["rep"] == counts["a"], "left").join(components, distinct["rep"] == components["node"], "left")
    known = known.select(
        F.col("digest").alias("_digest"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("_links"),
        F.coalesce("component", "rep").alias("_component"),
    )
    out = members.join(known, (F.col("digest") == F.col("_digest")) & F.col("vec_id").isNotNull(), "left")
    out = out.select("vec_id", F.coalesce("_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("_component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
