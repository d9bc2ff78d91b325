"""Best-fit packing of tokenised documents by planning over a length histogram.

Pieces are at most ``capacity`` tokens long, so the histogram has at most
``capacity`` rows whatever the corpus: only it goes to the driver.  Best-fit
runs over counts of equal lengths and yields ranges of slots, and pieces take
slots by their rank within their length.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored

#: Ranks within a length that share a lookup of their slots, and ranges of them that one task lists.
BLOCK = 64
SPAN = BLOCK << 14
#: Pieces of one length that one task orders, about.
ORDERED = 1_000_000
_ENCODERS: dict = {}
#: Words that the tokenizer encoded whose ids a Python worker remembers (about 100 MB).
REMEMBERED = 500_000
#: A character that is a token of its own, set between words that are encoded together.
MARK = "\x01"

# The parts of a tokenizer file that `_Words` stands for.
WORDWISE = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
PLAIN_MODEL = {
    "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>",
    "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
}
#: The same parts of lower-cased Latin-1 words, and the spaces between these.
_PARTS = re.compile("'(?:[stmd]|re|ve|ll)|[a-zªµºà-öø-ÿß]+|[0-9²³¹¼½¾]|[^ a-z0-9ªµºà-öø-ÿß²³¹¼½¾]+| ")
#: Parts of more bytes than this are left to the tokenizer.
LONGEST = 48


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + other.index(b)) for b in range(256)]


class _Merges:
    """Byte-pair merges of many parts of equal length at once, in numpy.

    One step merges, in every row that has any, the leftmost pair of the least
    rank, so all rows that go on get shorter by one symbol together.
    """

    NONE = np.int32(2**31 - 1)
    BITS = 18
    SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, vocab: dict[str, int], merges: list):
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.last = np.array([vocab[c + "</w>"] for c in symbols], np.int64)
        self.width = max(vocab.values()) + 1
        pairs = [tuple(m) if isinstance(m, (list, tuple)) else tuple(m.split(" ")) for m in merges]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # An open-addressed table of pairs; of pairs named twice the last counts, as in the tokenizer's own map.
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.full(1 << self.BITS, self.NONE, np.int32)
        ranks = {vocab[a] * self.width + vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        left = np.fromiter(ranks, np.int64, len(ranks))
        rank = np.fromiter(ranks.values(), np.int32, len(ranks))
        at = self._slots(left)
        while len(left):
            free = self.keys[at] < 0
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.ranks[at[put]] = left[put], rank[put]
            left, rank, at = np.delete(left, put), np.delete(rank, put), np.delete(at, put)
            at = (at + 1) & ((1 << self.BITS) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.SPREAD) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.width + right
        at = self._slots(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.ranks[at], self.NONE)
        # Probe on where another pair has the slot.
        rest = np.flatnonzero((seen != keys) & (seen >= 0))
        keys, at = keys.ravel(), at.ravel()
        flat = out.reshape(-1)
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.BITS) - 1)
            seen = self.keys[at[rest]]
            hit = seen == keys[rest]
            flat[rest[hit]] = self.ranks[at[rest[hit]]]
            rest = rest[~hit & (seen >= 0)]
        return out

    def ids(self, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For ``parts`` (rows of bytes): (row numbers, their ids), by number of ids."""
        symbols = np.concatenate([self.inner[parts[:, :-1]], self.last[parts[:, -1:]]], axis=1)
        ranks = self.rank(symbols[:, :-1], symbols[:, 1:])
        rows = np.arange(len(parts))
        while len(rows):
            if not ranks.shape[1]:
                yield rows, symbols
                return
            every = np.arange(len(rows))
            at = ranks.argmin(axis=1)
            least = ranks[every, at]
            live = least != self.NONE
            if not live.all():
                yield rows[~live], symbols[~live]
                rows, symbols, ranks, at, least = rows[live], symbols[live], ranks[live], at[live], least[live]
                every = np.arange(len(rows))
                if not len(rows):
                    return
            n, wide = symbols.shape
            keep = np.ones((n, wide), bool)
            keep[every, at + 1] = False
            symbols = symbols[keep].reshape(n, wide - 1)
            symbols[every, at] = self.merged[least]
            keep = keep[:, 1:]
            ranks = ranks[keep].reshape(n, wide - 2)
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.rank(symbols[some, at[some] - 1], symbols[some, at[some]])
            some = np.flatnonzero(at < wide - 2)
            ranks[some, at[some]] = self.rank(symbols[some, at[some]], symbols[some, at[some] + 1])


class _Texts:
    """Token ids of whole texts, by the tokenizer itself: for any tokenizer file."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def texts(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


class _Words:
    """Token ids by word, for tokenizers whose parts never cross ASCII white space.

    A text's ids are those of its words one after another, and each word of a
    batch is looked at once.  Latin-1 words are cut into parts, and the parts,
    each once again, are merged in numpy; other words go to the tokenizer
    together, with a mark after each at which their ids are cut.
    """

    def __init__(self, tokenizer, vocab: dict[str, int], merges: list):
        self.tokenizer, self.merges = tokenizer, _Merges(vocab, merges)
        self.mark = self._ids(MARK)
        self.known: dict[str, np.ndarray] = {}  # words that the tokenizer encoded

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _odd(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of any kind."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, words
        marked = [w for w in new if MARK not in w and len(self.mark) == 1]
        for at in range(0, len(marked), 2000):
            some = marked[at : at + 2000]
            ids = self._ids(f" {MARK} ".join([*some, ""]))
            ends = np.flatnonzero(ids == self.mark[0])
            self.known.update(zip(some, np.split(ids[ids != self.mark[0]], (ends - np.arange(len(ends)))[:-1]), strict=True))
        return [self.known[w] if w in self.known else self._ids(w) for w in words]

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words one after another, and how many each has."""
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words.cast(pa.string())), " ")[0].as_py()
        parts = pa.array(_PARTS.findall(joined.lower() + " "), pa.large_string()).dictionary_encode()
        which = parts.indices.to_numpy(zero_copy_only=False)
        data, ends = _buffers(parts.dictionary)
        start, size = ends[:-1], np.diff(ends)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        gap = -1
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            if n == 1:  # a space ends each word
                gap = int(rows[data[start[rows]] == 0x20][0])
                rows = rows[rows != gap]
            if n > LONGEST:
                found += [(np.array([r]), self._ids(data[start[r] : ends[r + 1]].tobytes().decode())[None, :]) for r in rows]
            else:
                block = data[start[rows][:, None] + np.arange(n)]
                found += [(rows[some], ids) for some, ids in self.merges.ids(block)]
        ids, many = _joined(found, len(size))
        word = np.cumsum(which == gap)
        flat, sizes = _gathered(ids, many, which)
        return flat, np.bincount(word, weights=sizes, minlength=len(words) + 1)[: len(words)].astype(np.int64)

    def texts(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        rows = pa.array(texts, pa.large_string())
        # Fewer spellings where that cannot change what the normaliser and the search for special tokens see.
        data, ends = _buffers(rows)
        high = np.append(0, np.cumsum(data >= 0xC4))
        latin = pa.array(high[ends[1:]] == high[ends[:-1]])
        rows = pc.if_else(pc.and_not(latin, pc.match_substring(rows, "<|")), pc.ascii_lower(rows), rows)
        split = pc.ascii_split_whitespace(rows)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        odd = pa.array(_odd_words(words))
        flat, sizes = self._plain(words.filter(pc.invert(odd)))
        others = self._odd(words.filter(odd).to_pylist())
        many = np.empty(len(words), np.int64)
        at = odd.to_numpy(zero_copy_only=False)
        many[~at] = sizes
        many[at] = [len(ids) for ids in others]
        order = np.concatenate([np.flatnonzero(~at), np.flatnonzero(at)])
        start = np.empty(len(words), np.int64)
        start[order] = np.cumsum(many[order]) - many[order]
        ids, sizes = _gathered(np.concatenate([flat, *others]), many, coded.indices.to_numpy(zero_copy_only=False), start)
        ends = np.asarray(split.offsets)
        last = np.append(0, np.cumsum(sizes))[ends[1:] - ends[0]] * 4
        out = ids.astype("<u4").tobytes()
        return [out[a:b] for a, b in zip([0, *last[:-1].tolist()], last.tolist(), strict=True)]


def _buffers(rows: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings and their offsets, from 0 on."""
    offsets = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1] if len(rows) else np.zeros(1, np.int64)
    held = rows.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and len(rows) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _odd_words(words: pa.Array) -> np.ndarray:
    """Which words hold other than the visible characters of Latin-1, or the begin of a special token."""
    data, ends = _buffers(words)
    ahead = np.append(data[1:], np.uint8(0))
    odd = (data < 0x21) | (data == 0x7F) | (data >= 0xC4) | ((data == 0xC2) & (ahead < 0xA1)) | ((data == 0x3C) & (ahead == 0x7C))
    seen = np.append(0, np.cumsum(odd))
    return seen[ends[1:]] != seen[ends[:-1]]


def _joined(found: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of rows, given in blocks of equal width, in the order of rows; and how many each has."""
    many = np.zeros(n, np.int64)
    for rows, ids in found:
        many[rows] = ids.shape[1]
    at = np.cumsum(many) - many
    out = np.empty(int(many.sum()), np.uint32)
    for rows, ids in found:
        out[at[rows][:, None] + np.arange(ids.shape[1])] = ids
    return out, many


def _gathered(ids: np.ndarray, many: np.ndarray, which: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of items ``which``, one after another, and how many each has."""
    start = np.cumsum(many) - many if start is None else start
    sizes = many[which]
    end = np.cumsum(sizes)
    return ids[np.repeat(start[which] - end + sizes, sizes) + np.arange(end[-1] if len(end) else 0)], sizes


def encoder(path: str) -> _Words | _Texts:
    """The encoder of a tokenizer file: by word where the file says that this gives the same ids."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    tokenizer, model = Tokenizer.from_file(path), said["model"]
    tokenizer.no_truncation()
    tokenizer.no_padding()
    wordwise = all(said.get(k) == v for k, v in WORDWISE.items()) and all(model.get(k, v) == v for k, v in PLAIN_MODEL.items())
    # Added tokens are looked for in the text itself; such as hold no white space and begin alike stay within odd words.
    wordwise = wordwise and all(re.fullmatch(r"<\|\S+", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in said["added_tokens"])
    return _Words(tokenizer, model["vocab"], model["merges"]) if wordwise else _Texts(tokenizer)


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, text: str = "text", doc_id: str = "doc_id", end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of every row's ids and ``end_id``: only longer ones are cut.

    Columns: doc_id, row (tells rows with one id apart), piece, start, length,
    ids_crc32 and, on request, ids (bytes).  Null and empty texts are the one
    token ``end_id``; null ids stay null, repeated rows are rows of their own,
    and other columns of ``docs`` are left behind whatever their names.
    """
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own_encoder = _ENCODERS.get(tokenizer_path) or _ENCODERS.setdefault(tokenizer_path, encoder(tokenizer_path))
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, 1, 10_000, 8 << 20):
            columns: list[list] = [[] for _ in names]
            ids = own_encoder.texts([t or "" for t in batch.column(1).to_pylist()])
            for doc, data in zip(batch.column(0).to_pylist(), ids, strict=True):
                data += end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    own = data[at : at + 4 * capacity]
                    for column, value in zip(columns, (doc, row, piece, at // 4, len(own) // 4, zlib.crc32(own), own), strict=False):
                        column.append(value)
                row += 1
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(cut, ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names))


def plan(histogram: dict[int, int], capacity: int = 2048) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns ranges (length, first rank, count, first sequence, offset): the
    pieces of that length with ranks from ``first rank`` go to consecutive
    sequences at one offset.  Open sequences are spans with equal room left.
    Among equal pieces, best fit fills the sequence with the least room that
    fits as often as it can before it turns to another, so a whole span takes
    its pieces layer by layer; when nothing fits, new sequences are opened.
    """
    ranges: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # the keys of room, ascending
    opened = 0

    def put(left: int, first: int, n: int) -> None:
        if left not in room:
            room[left] = []
            bisect.insort(order, left)
        room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while count:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                new = -(-count // (capacity // length))
                put(capacity, opened, new)
                opened += new
                continue
            left = order[at]
            first, n = room[left].pop()
            if not room[left]:
                del room[left], order[at]
            each = left // length
            used = min(n, count // each)
            if not used:
                used, each = 1, count
            for layer in range(each):
                ranges.append((length, rank, used, first, capacity - left + layer * length))
                rank += used
            count -= used * each
            if left - each * length:
                put(left - each * length, first, used)
            if used < n:
                put(left, first + used, n - used)
    return ranges


def pack(pieces: DataFrame, capacity: int = 2048, salts: int | None = None) -> DataFrame:
    """``pieces`` (written, with ``length``) with ``sequence_id`` and ``offset``.

    Ranks within a length come from counts per (length, salt): a hot length,
    such as full pieces, is spread over ``salts`` groups, as many as keep one to
    about ``ORDERED`` pieces, instead of being ordered by one task.  Ties are
    ordered by (doc_id, row, piece).
    """
    spark = pieces.sparkSession
    salts = salts or max(64, -(-pieces.count() // ORDERED))
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(salts)))
    counts = stored(pieces.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "pack-counts")
    # At most `capacity` rows, whatever the corpus.
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # At most capacity x salts rows; the join below may broadcast them while they are few (13 MB at 2,048 x 64).
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "row", "piece")
    ranked = pieces.withColumn("_own", F.row_number().over(own) - 1).join(counts, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_own") + F.col("_before"))
    columns = np.array(plan(histogram, capacity), np.int64).reshape(-1, 5)
    names = ["length", "_from", "_many", "_first", "_offset"]
    planned = spark.createDataFrame(pa.table(dict(zip(names, columns.T, strict=True))))
    # A piece finds its range by length and block of ranks; merged, since the plan grows until lengths are many.
    # Long ranges are dealt out by spans first, so that no task lists the blocks of all.
    planned = planned.withColumn("_span", F.explode(F.expr(f"sequence(_from div {SPAN}, (_from + _many - 1) div {SPAN})"))).repartition("length", "_span")
    first, last = f"greatest(_from, _span * {SPAN}) div {BLOCK}", f"least(_from + _many - 1, (_span + 1) * {SPAN} - 1) div {BLOCK}"
    planned = planned.withColumn("_block", F.explode(F.expr(f"sequence({first}, {last})"))).drop("_span")
    found = ranked.withColumn("_block", F.expr(f"_rank div {BLOCK}")).join(planned.hint("merge"), ["length", "_block"])
    found = found.where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_many")))
    return found.select(
        *[c for c in pieces.columns if c != "_salt"],
        (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"),
        F.col("_offset").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, **columns) -> DataFrame:
    """Pieces of ``docs`` with their places; ids are encoded once and digested.

    Nulls, empty texts, repeated rows and other columns as for :func:`tokenize`.
    """
    return pack(stored(tokenize(docs, tokenizer_path, capacity, **columns), "pieces", rows=4000), capacity)
