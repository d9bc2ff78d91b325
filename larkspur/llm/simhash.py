"""SimHash near-duplicates by multi-index hashing.

Fingerprints within ``radius`` bits of each other agree, up to a share of those
bits, in one half of their digits.  So each half is a table: a small Hamming
ball around the half is enumerated, matches are fetched, and the complete
distance is verified.  A bucket that holds many fingerprints is not compared
pair by pair but indexed again on the other half in the same way, so work
stays in proportion to the fingerprints, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, mix64, slices, stored
from .components import connected_components, forest

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE = np.arange(8) * 256


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included.

    A-Z are lower-cased and words are parted by ASCII white space; fewer words
    than ``width`` are one shingle, and no words give none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(flat, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[: -width]])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[a:b], seed) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]
    return np.array(hashes, np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes; 0 without any."""
    data = hashes.view(np.uint8).reshape(-1, 8)
    ones = (np.bincount((data + _BYTE).ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """A text's 64-bit SimHash."""
    return majority(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` has the fingerprint's bits as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            values = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, fp long")


def _ball(width: int, most: int) -> list[tuple[int, int]]:
    """(mask, flips) for all masks of ``width`` bits with at most ``most`` set."""
    return [(sum(1 << i for i in on), n) for n in range(most + 1) for on in combinations(range(width), n)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _key(group: Column, half: int, value: Column) -> Column:
    return F.xxhash64(group, F.lit(half), value)


def _split(rest: Column, width: int) -> tuple[Column, Column]:
    half = width // 2
    low = rest.bitwiseAND(F.lit((1 << half) - 1))
    return F.shiftrightunsigned(rest, half).bitwiseAND(F.lit((1 << half) - 1)), low


def near_pairs(fps: DataFrame, radius: int = 2, bucket: int = 64) -> DataFrame:
    """All pairs of distinct fingerprints at most ``radius`` bits apart.

    ``fps`` has one row per fingerprint: fp and node (its representative).
    Returns (a, b): the nodes of each linked pair, possibly more than once.
    ``bucket`` is not a cap: buckets above it are split on further digits,
    until they have no more digits than fit below it.
    """
    table = fps.select(F.lit(0).cast("long").alias("g"), F.col("fp").alias("rest"), "fp", "node")
    probe = table.withColumn("r", F.lit(radius)).withColumn("both", F.lit(True))
    width, found = 64, None
    while True:
        half = width // 2
        high, low = _split(F.col("rest"), width)
        entries = F.array(
            F.struct(_key(F.col("g"), 1, high).alias("g"), low.alias("rest")),
            F.struct(_key(F.col("g"), 0, low).alias("g"), high.alias("rest")),
        )
        table = table.select(F.explode(entries).alias("e"), "fp", "node").select("e.*", "fp", "node")
        # Where both ends of a pair probe, the one whose bit is 0 flips it, and exact matches are taken from the smaller.
        parts = []
        for side, mine, other, most in ((1, high, low, "r div 2"), (0, low, high, "r - r div 2 - 1")):
            masks = _ball(half, radius // 2 if side else radius - radius // 2 - 1)
            ball = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.lit(n).alias("n")) for m, n in masks])
            part = probe.withColumn("e", F.explode(ball)).where(F.col("e.n") <= F.expr(most))
            one_way = ~F.col("both") | (F.col("e.n") != 1) | (mine.bitwiseAND(F.col("e.mask")) == 0)
            parts.append(
                part.where(one_way).select(
                    _key(F.col("g"), side, mine.bitwiseXOR(F.col("e.mask"))).alias("g"),
                    other.alias("rest"),
                    "fp",
                    "node",
                    (F.col("r") - F.col("e.n")).alias("r"),
                    (F.col("both") & (F.col("e.n") != 1)).alias("both"),
                )
            )
        probe = parts[0].unionByName(parts[1])
        width = half
        sizes = table.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
        hot = stored(sizes.select("g"), "hot-buckets")
        any_hot = 2**width > bucket and hot.head(1)
        if any_hot:
            # Each level is written, so that the next is planned from few rows.
            split_table, split_probe = table.join(hot, "g", "left_semi"), probe.join(hot, "g", "left_semi")
            table_now, probe_now = table.join(hot, "g", "left_anti"), probe.join(hot, "g", "left_anti")
        else:
            table_now, probe_now = table, probe
        y = table_now.select("g", F.col("fp").alias("fp2"), F.col("node").alias("node2"))
        pairs = probe_now.join(y, "g").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius)
        pairs = pairs.where((F.col("fp") != F.col("fp2")) & (~F.col("both") | (F.col("fp") < F.col("fp2"))))
        pairs = pairs.select(F.col("node").alias("a"), F.col("node2").alias("b"))
        found = pairs if found is None else found.unionByName(pairs)
        if not any_hot:
            return found
        table, probe = stored(split_table, "hot-table"), stored(split_probe, "hot-probe")


def classes(prints: DataFrame, radius: int = 2, bucket: int = 64) -> DataFrame:
    """(fp, component_id) for every fingerprint of ``prints`` (doc_id, fp, written).

    Equal fingerprints are one node, named by its smallest doc_id, whatever
    their number; a component is named by its smallest doc_id.  Rows without
    an id count only where others share their fingerprint.
    """
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprints")
    named = nodes.where("node IS NOT NULL")
    components = stored(connected_components(near_pairs(named, radius, bucket)), "components")
    joined = nodes.join(components, nodes["node"] == components["node"], "left")
    return joined.select(nodes["fp"], F.coalesce(components["component"], nodes["node"]).alias("component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, radius: int = 2, bucket: int = 64) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    prints = stored(fingerprints(docs, text, doc_id, width), "prints")
    return prints.join(classes(prints, radius, bucket), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# Similarity ---------------------------------------------------------------
#
# A share of common shingles is a distance too long for exact search in 64
# bits: at a Jaccard similarity of 0.8 about 0.15 of all bits differ.  So the
# same index is used with longer fingerprints and more segments, as many as a
# pair at that distance needs to agree in one of them with the wanted recall.

#: 64-bit words of a long fingerprint.
LONG = 4
_WORDS = tuple(f"f{k}" for k in range(LONG))


def bit_distance(similarity: float) -> float:
    """Share of SimHash bits that differ between texts of a Jaccard similarity and one length."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def long_fingerprints(docs: DataFrame, text: str, doc_id: str, width: int) -> DataFrame:
    """(doc_id, f0, ...): independent SimHashes of the same shingles."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out = np.zeros((batch.num_rows, LONG), np.uint64)
            for i, t in enumerate(batch.column(1).to_pylist()):
                hashes = shingle_hashes(t, width)
                for k in range(LONG if len(hashes) else 0):
                    out[i, k] = majority(mix64(hashes + np.uint64(k)))
            columns = [pa.array(np.ascontiguousarray(out[:, k]).view(np.int64)) for k in range(LONG)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *_WORDS])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, " + ", ".join(f"{w} long" for w in _WORDS))


def segments(n: int, distance: float, recall: float) -> list[np.ndarray]:
    """Bit positions of each table's segment.

    A segment has as many bits as keep the fingerprints of unlike texts about
    one to a bucket, so candidates stay in proportion to ``n``.
    """
    bits = int(np.clip(np.ceil(np.log2(max(n, 2))), 16, 48))
    tables = int(np.ceil(np.log(1 - recall) / np.log(1 - (1 - distance) ** bits)))
    rng = np.random.default_rng(bits)
    return [np.sort(rng.choice(64 * LONG, bits, replace=False)) for _ in range(tables)]


def _dealt(nodes: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """(key, node, f0, ...): each fingerprint once per table, by its segment there."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([batch.column(1 + k).to_numpy() for k in range(LONG)], 1)
            bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
            for t, at in enumerate(tables):
                value = bits[:, at].astype(np.uint64) @ (np.uint64(1) << np.arange(len(at), dtype=np.uint64))
                key = mix64(value ^ (np.uint64(t) << np.uint64(50))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns], ["key", "node", *_WORDS])

    return nodes.select("node", *_WORDS).mapInArrow(deal, "key long, node long, " + ", ".join(f"{w} long" for w in _WORDS))


def _verified(dealt: DataFrame, most: int, block: int) -> DataFrame:
    """(a, b): edges that join the fingerprints of a bucket that are at most ``most`` bits apart.

    Every pair of a bucket is compared, but for those that are joined already:
    rows of a bucket above ``block`` are held against its smallest node first,
    and two that are both near it need no edge of their own.  All other pairs
    meet in one pair of blocks each: the rest's blocks with one another, and
    with those of the rows near the smallest node.  No task holds a whole
    bucket; copies of one text cost their rows, texts that are unlike their
    bucket's smallest cost a row for each block.
    """
    names = ["a", "b"]

    def verify(key: np.ndarray, node: np.ndarray, side: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
        live = np.arange(len(key))
        found_p, found_q = [], []
        step = 1
        while len(live):
            live = live[live + step < len(key)]
            live = live[key[live] == key[live + step]]
            due = live[(side[live] == 0) | (side[live] != side[live + step])]
            apart = np.bitwise_count(words[due] ^ words[due + step]).sum(axis=1)
            near = due[apart <= most]
            found_p.append(near)
            found_q.append(near + step)
            step += 1
        p, q = np.concatenate(found_p or [live]), np.concatenate(found_q or [live])
        edges = forest(p, q, len(key)) if len(p) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(node[edges[:, 0]]), pa.array(node[edges[:, 1]])], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            key = batch.column(0).to_numpy()
            words = np.stack([batch.column(3 + k).to_numpy() for k in range(LONG)], 1).view(np.uint64)
            now = (key, batch.column(1).to_numpy(), batch.column(2).to_numpy(), words)
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last bucket may go on
            if cut:
                yield verify(*(x[:cut] for x in now))
            held = tuple(x[cut:] for x in now)
        if held is not None and len(held[0]):
            yield verify(*held)

    sizes = stored(dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lead")).where(F.col("n") > block), "large-buckets")
    small = dealt.join(sizes, "key", "left_anti").select("key", "node", F.lit(0).alias("side"), *_WORDS)
    if sizes.isEmpty():
        met, led = small, None
    else:
        large = stored(dealt.join(sizes.select("key", "lead"), "key"), "large-rows")
        leads = large.where("node = lead").select("key", *[F.col(w).alias(f"l{w}") for w in _WORDS])
        apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"l{w}"))) for w in _WORDS), F.lit(0))
        large = stored(large.join(leads, "key").select("key", "node", "lead", (apart <= most).alias("near"), *_WORDS), "led-rows")
        led = large.where("near AND node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
        # Blocks of the rest and of the rows near the lead, in buckets that have a rest.
        counts = large.groupBy("key").agg(F.count_if(~F.col("near")).alias("rest"), F.count_if("near").alias("held")).where("rest > 0")
        counts = counts.select("key", F.ceil(F.col("rest") / block).alias("nr"), F.ceil(F.col("held") / block).alias("nh"))
        paired = large.join(stored(counts, "large-rests"), "key")
        paired = paired.withColumn("mine", F.pmod(F.xxhash64("key", "node"), F.when(F.col("near"), F.col("nh")).otherwise(F.col("nr"))))
        # Rows of side 0 are compared with all of their group, others with those of the other side.
        rest = F.expr(
            "concat(transform(sequence(0L, nr - 1), j -> named_struct('kind', 0, 'i', least(mine, j), 'j', greatest(mine, j), 'side', CASE WHEN mine = j THEN 0 WHEN mine < j THEN 1 ELSE 2 END)), "
            "transform(sequence(0L, nh - 1), q -> named_struct('kind', 1, 'i', mine, 'j', q, 'side', 1)))"
        )
        held = F.expr("transform(sequence(0L, nr - 1), i -> named_struct('kind', 1, 'i', i, 'j', mine, 'side', 2))")
        paired = paired.withColumn("block", F.explode(F.when(F.col("near"), held).otherwise(rest)))
        paired = paired.select(F.xxhash64("key", "block.kind", "block.i", "block.j").alias("key"), "node", "block.side", *_WORDS)
        met = small.unionByName(paired)
    found = met.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")
    return found if led is None else found.unionByName(led)


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, similarity: float = 0.8, recall: float = 0.97, block: int = 256) -> DataFrame:
    """(doc_id, component_id) of every row: texts that share ``similarity`` of their shingles.

    Similarity is estimated from 256 bits.  A pair is linked up to one standard
    error (about 6 bits) beyond the similarity's distance, so most of those just
    above it are found, and some of those just below; ``recall`` is the chance
    that a pair just at the similarity is compared, which nearer ones exceed.
    Texts without words are one another's copies.
    """
    prints = stored(long_fingerprints(docs, text, doc_id, width), "long-prints")
    nodes = stored(prints.where("doc_id IS NOT NULL").groupBy(*_WORDS).agg(F.min("doc_id").alias("node")), "long-nodes")
    distance = bit_distance(similarity)
    tables = segments(nodes.count(), distance, recall)
    most = 64 * LONG * distance + np.sqrt(64 * LONG * distance * (1 - distance))
    edges = stored(_verified(stored(_dealt(nodes, tables), "segments"), int(most), block), "near-edges")
    components = connected_components(edges)
    joined = nodes.join(components, "node", "left").select(*_WORDS, F.coalesce("component", "node").alias("component_id"))
    return prints.join(joined, list(_WORDS), "left").select("doc_id", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seen: DataFrame | None = None) -> DataFrame:
    """``docs`` with one document of each group of ``seen``: that with the smallest id.

    ``seen`` has (doc_id, component_id), by default those of
    :func:`near_duplicates`.  Only ids are compared, so texts move once.  Rows
    that share the kept id stay together; rows without an id stay.  Columns of
    ``docs`` stay as they are, whatever their names.
    """
    seen = near_duplicates(docs, text, doc_id) if seen is None else seen
    name = free_name(docs, "_gone")
    gone = seen.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(name))
    gone = stored(gone.distinct(), "gone").hint("merge")
    return docs.join(gone, docs[doc_id].cast("long") == F.col(name), "left_anti")
