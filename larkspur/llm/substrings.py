"""Substring dedup: repeated word windows, found by level-wise doubling.

Windows of ``length`` words that start earlier in the corpus as well are
removed.  A window repeats only if its halves do, so each level looks at half
the length of the next one, and there only at one sample for each window of the
next: the smallest hash among the half-length windows within it, which equal
windows share.  Windows whose sample repeats are the candidates of the next
level; without any the search is over.  At ``length`` they are compared by 128
bits: 64 of one hash of all their words, and 64 of the sample by another,
independent one.  Longer windows cannot add to what is covered, so doubling
stops there.

Within an Arrow batch the earliest of equal windows stands for all and the
others are known to be later copies; what repeated in a batch is remembered by
its task.  So a passage that very many documents share reaches a shuffle once
per task, not once per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHasher, keyed, mix64, slices, stored

#: Up to this many ids are broadcast (16 MB); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
_HASHERS: dict[int, WordHasher] = {}
_SIGN = np.uint64(1 << 63)  # lets signed keys be compared as unsigned ones
_MIX = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F))


def _hashed(text: str, which: int = 0) -> np.ndarray:
    """Hashes of a text's words, by one of several independent hashes."""
    hasher = _HASHERS.get(which) or _HASHERS.setdefault(which, WordHasher(20 + which))
    return hasher.words(text.encode())[2]


def _found(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The places in ascending ``known`` of what may be there: compare what is found with what was wanted."""
    return np.minimum(np.searchsorted(known, wanted), max(0, len(known) - 1))


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all ``n`` consecutive words, by doubling."""
    level, size = words, 1
    out, done = None, 0
    while True:
        if n & size:
            if out is None:
                out, done = level, size
            else:  # the part so far follows this level's window
                m = max(0, min(len(level), len(out) - size))
                out, done = mix64(level[:m] * _MIX[0] + out[size : size + m]), done + size
        if done == n:
            return out
        m = max(0, len(level) - size)
        level = mix64(level[:m] * _MIX[1] + level[size : size + m])
        size *= 2


def slide(least, values: np.ndarray, n: int) -> np.ndarray:
    """``least`` over all ``n`` consecutive values."""
    size = 1
    while size < n:
        step = min(size, n - size)
        values = least(values[:-step], values[step:]) if len(values) > step else values[:0]
        size += step
    return values


def samples(words: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` words its smallest half-length hash."""
    half = (length + 1) // 2
    return slide(np.minimum, windows(words, half), length - half + 1)


def _without(rows: DataFrame, ids: DataFrame, n: int, how: str) -> DataFrame:
    return rows.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "key", how)


def levels(length: int, start: int) -> list[int]:
    """Window sizes from about ``start`` words up to ``length``, each (about) half the next; two at least."""
    sizes = [(length + 1) // 2, length]
    while sizes[0] > start:
        sizes.insert(0, (sizes[0] + 1) // 2)
    return sizes


def _candidates(words: np.ndarray, repeated: np.ndarray, before: int, size: int) -> np.ndarray:
    """Which windows of ``size`` have a sample, of ``before`` words, among those that repeat."""
    least = slide(np.minimum, windows(words, before), size - before + 1)
    wanted = np.sort(repeated)
    return wanted[_found(wanted, least)] == least


def _level(rows: DataFrame, before: int, size: int, span: int) -> DataFrame:
    """(key, repeated array): per document the samples of ``size`` words, one for each window of ``span``, that repeat somewhere.

    ``rows`` has key and text; from the second level on also ``repeated``, what
    repeats of ``before`` words, and only windows made of candidates count.
    """
    names = ["key", "text"] + ["repeated"] * bool(before)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)  # hashes that repeated in a batch of this task
        for batch in slices(batches, 1):
            hashes, keys, often = [], [], []
            known_before = batch.column(2) if before else [None] * batch.num_rows
            for key, text, repeated in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), known_before, strict=True):
                words = _hashed(text or "")
                if len(words) < span:
                    continue
                small = windows(words, size)
                least = slide(np.minimum, small, span - size + 1)
                if before:
                    good = _candidates(words, repeated.values.to_numpy(zero_copy_only=False).view(np.uint64), before, size)
                    least = np.where(slide(np.minimum, good, span - size + 1), least, np.uint64(0))
                chosen = _chosen(small, least)
                if not len(chosen):
                    continue
                own, n = np.unique(chosen, return_counts=True)
                hashes.append(own)
                often.append(n)
                keys.append(np.full(len(own), key))
            if not hashes:
                continue
            h, k, n = np.concatenate(hashes), np.concatenate(keys), np.concatenate(often)
            order = np.argsort(h, kind="stable")
            h, k, n = h[order], k[order], n[order]
            first = np.append(True, h[1:] != h[:-1])
            group = np.cumsum(first) - 1
            many = np.bincount(group, weights=n)[group] > 1
            again = seen[_found(seen, h)] == h if len(seen) else np.zeros(len(h), bool)
            # One row for each hash that is single here; those known to repeat go by document.
            single = ~many & ~again
            lone = pa.array([None] * int(single.sum()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(h[single].view(np.int64)), pa.array(k[single]), lone], ["h", "key", "known"])
            lead = many & first & ~again  # for other tasks' sake
            seen = np.sort(np.concatenate([seen, h[lead]]))
            many |= again
            yield pa.RecordBatch.from_arrays([pa.array(h[lead].view(np.int64)), pa.array(k[lead]), pa.array([None] * int(lead.sum()), pa.list_(pa.int64()))], ["h", "key", "known"])
            h, k = h[many], k[many]
            by_doc = np.argsort(k, kind="stable")
            h, k = h[by_doc], k[by_doc]
            cuts = np.flatnonzero(k[1:] != k[:-1]) + 1 if len(k) else np.zeros(0, np.int64)
            docs = k[np.append(0, cuts)] if len(k) else k
            known = [np.unique(x).view(np.int64) for x in np.split(h, cuts)] if len(k) else []
            yield pa.RecordBatch.from_arrays([pa.array(mix64(docs.astype(np.uint64)).view(np.int64)), pa.array(docs, pa.int64()), pa.array(known, pa.list_(pa.int64()))], ["h", "key", "known"])

    rows = rows.select(*names).mapInArrow(emit, "h long, key long, known array<long>")
    same = Window.partitionBy("h")
    rows = rows.withColumn("n", F.count(F.when(F.col("known").isNull(), 1)).over(same))
    rows = rows.where("known IS NOT NULL OR n > 1")
    part = F.coalesce(F.col("known"), F.array("h"))
    return rows.groupBy("key").agg(F.flatten(F.collect_list(part)).alias("repeated"))


def _chosen(small: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The half-length hashes that are smallest in some window, in linear time."""
    n = len(small) - len(least) + 1
    edge = np.zeros(n - 1, np.uint64)
    top = slide(np.maximum, np.concatenate([edge, least, edge]), n)
    return small[top == small]


def _runs(starts: np.ndarray) -> np.ndarray:
    """Ascending starts as pairs (start, how many in a row)."""
    if not len(starts):
        return np.zeros(0, np.int32)
    cut = np.flatnonzero(np.diff(starts) != 1)
    first = starts[np.append(0, cut + 1)]
    last = starts[np.append(cut, len(starts) - 1)]
    return np.stack([first, last - first + 1], 1).ravel().astype(np.int32)


def _last_level(rows: DataFrame, length: int) -> DataFrame:
    """(key, single array, known array): starts of full windows that begin earlier too.

    ``rows`` has key, text and repeated.  ``known`` holds pairs (start, count).
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["m", "w", "key", "start", "known"]
        seen = np.zeros((5, 0), np.uint64)  # of windows that repeated in a batch of this task: a hash to find them by, m, w, earliest key and start
        for batch in slices(batches, 1):
            parts = []
            for key, text, repeated in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = _hashed(text)
                least = samples(words, length)
                at = np.flatnonzero(_candidates(words, repeated.values.to_numpy(zero_copy_only=False).view(np.uint64), (length + 1) // 2, length))
                if len(at):
                    parts.append((least[at], windows(_hashed(text, 1), length)[at], np.full(len(at), key), at))
            if not parts:
                continue
            m, w, k, s = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((s, k, m, w))
            m, w, k, s = m[order], w[order], k[order], s[order]
            later = np.append(False, (w[1:] == w[:-1]) & (m[1:] == m[:-1]))
            first = np.flatnonzero(~later)
            many = np.diff(np.append(first, len(w))) > 1
            ids = mix64(w[first]) ^ m[first]
            if seen.shape[1]:
                at = _found(seen[0], ids)
                same = (seen[0, at] == ids) & (seen[1, at] == m[first]) & (seen[2, at] == w[first])
                key, start = k[first], s[first]
                before = key.astype(np.uint64) ^ _SIGN, start.astype(np.uint64)
                after = same & ((before[0] > seen[3, at]) | ((before[0] == seen[3, at]) & (before[1] > seen[4, at])))
                later[first[after]] = True
                # An earlier one takes the place of that which is remembered.
                better = np.flatnonzero(same & ~after)
                seen[3, at[better]], seen[4, at[better]] = before[0][better], before[1][better]
                many &= ~same
            new = first[many]
            more = np.stack([ids[many], m[new], w[new], k[new].astype(np.uint64) ^ _SIGN, s[new].astype(np.uint64)])
            seen = np.concatenate([seen, more], axis=1)
            seen = seen[:, np.argsort(seen[0], kind="stable")]
            lead = ~later
            none = pa.array([None] * int(lead.sum()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(m[lead].view(np.int64)), pa.array(w[lead].view(np.int64)), pa.array(k[lead]), pa.array(s[lead].astype(np.int32)), none], names)
            k, s = k[later], s[later]
            if len(k):
                order = np.lexsort((s, k))
                k, s = k[order], s[order]
                cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
                docs = k[np.append(0, cuts)]
                known = [_runs(x) for x in np.split(s, cuts)]
                spread = pa.array(mix64(docs.astype(np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays([spread, spread, pa.array(docs), pa.array(np.zeros(len(docs), np.int32)), pa.array(known, pa.list_(pa.int32()))], names)

    found = rows.select("key", "text", "repeated").mapInArrow(emit, "m long, w long, key long, start int, known array<int>")
    same = Window.partitionBy("m", "w").orderBy(F.col("known").isNotNull(), "key", "start")
    found = found.withColumn("nth", F.row_number().over(same)).where("known IS NOT NULL OR nth > 1")
    return found.groupBy("key").agg(
        F.collect_list(F.when(F.col("known").isNull(), F.col("start"))).alias("single"),
        F.flatten(F.collect_list("known")).alias("known"),
    )


def covered(n_words: int, length: int, single, known) -> np.ndarray:
    """Which words the windows cover."""
    edge = np.zeros(n_words + length + 1, np.int64)
    single = np.asarray(single, np.int64)
    np.add.at(edge, single, 1)
    np.add.at(edge, single + length, -1)
    pairs = np.asarray(known, np.int64).reshape(-1, 2)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, pairs.sum(axis=1) - 1 + length, -1)
    return np.cumsum(edge)[:n_words] > 0


def repeated_windows(docs: DataFrame, length: int = 20, text: str = "text", doc_id: str = "doc_id", start: int = 10) -> DataFrame:
    """Every row with its later windows: (doc_id, text, copy, single, known).

    ``copy`` marks a whole text that a smaller id has too: all its windows
    start earlier, so it takes no part in the search.  Null texts have no
    words.  Rows whose id repeats or lacks are documents of their own, in the
    order of (id, text).  The first level looks at windows of at most ``start``
    words, or of half the length if that is less.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = keyed(rows, "text", "doc_id", "key")
    digests = stored(rows.select("key", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")), "digests")
    groups = digests.groupBy("digest").agg(F.min("key").alias("lead"), F.count("*").alias("n")).where("n > 1")
    # Written first, so that the join reads two exchanges and a text with very many copies can be split.
    copies = digests.join(stored(groups, "copied-texts").hint("merge"), "digest").where("key <> lead").select("key")
    copies = stored(copies, "copies")
    n_copies = copies.count()
    texts = _without(rows, copies, n_copies, "left_anti")
    sizes = levels(length, start)
    left = texts
    for before, size, span in zip([0, *sizes], sizes, sizes[1:], strict=False):
        found = stored(_level(left, before, size, span), f"candidates-{size}")
        n = found.count()
        left = _without(texts, found.select("key"), n, "left_semi").join(found, "key")
        if not n:
            break
    later = _last_level(left, length)
    later = stored(later, "later-windows")
    n_later = later.count()
    ids = later.select("key")
    none = F.array().cast("array<int>")
    plain = _without(texts, ids, n_later, "left_anti").select("doc_id", "text", F.lit(False).alias("copy"), none.alias("single"), none.alias("known"))
    cut = _without(texts, ids, n_later, "left_semi").join(later, "key").select("doc_id", "text", F.lit(False).alias("copy"), "single", "known")
    same = _without(rows, copies, n_copies, "left_semi").select("doc_id", "text", F.lit(True).alias("copy"), none.alias("single"), none.alias("known"))
    return plain.unionByName(cut).unionByName(same)


def remove_repeats(docs: DataFrame, length: int = 20, text: str = "text", doc_id: str = "doc_id", texts: bool = False, start: int = 10) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), and on request ``kept``, the words left.

    Kept words are joined by one space.  Null and empty texts have no words;
    repeated rows are documents of their own, later ones copies; other columns
    of ``docs`` are left behind whatever their names.  The result is written.
    """
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            columns: list[list] = [[] for _ in names]
            for doc, text, copy, single, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (text or "").encode().split()
                n = len(words)
                if copy and n >= length:
                    words = []
                elif single or known:
                    gone = covered(n, length, single, known)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                for column, value in zip(columns, (doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None), strict=False):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    marked = repeated_windows(docs, length, text, doc_id, start).select("doc_id", "text", "copy", "single", "known")
    return stored(marked.mapInArrow(cut, schema), "without-repeats")
