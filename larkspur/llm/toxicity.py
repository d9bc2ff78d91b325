"""Toxicity: a convolutional text classifier, trained and applied in numpy.

A word's embedding is the sum of those of its hash and of its prefix's hash;
filters of several widths slide over them, and each keeps its maximum over the
text, however long; a logistic layer scores the maxima.  Words and prefixes
that few training texts have keep a zero embedding, so that a long text is not
scored by what nothing was learnt about.  Training takes a bounded sample of labelled rows.  Thresholds are
calibrated by the language that a text's own function words suggest, and a
score is shifted so that 0.5 is its language's threshold.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, free_name, slices

#: Word hashes map to this many embeddings; number 0 is the padding.
BUCKETS = 1 << 16
WIDTHS = (1, 2, 3)
#: Bytes of a word's prefix.
PREFIX = 6
#: Training texts that a word or prefix must be in to have an embedding.
LEAST_TEXTS = 8
#: Words that are scored at a time; a longer text's parts overlap by the widest filter.
PART = 20_000

# Frequent function words by language; the first entry is for texts that have none.
FUNCTION_WORDS = {
    "": "",
    "en": "the of and to in is that it was for on are as with be this have from or by at",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an",
    "fr": "le la les et des une du est dans que qui pour au sur pas avec ce par il",
    "es": "el los las del que una por con para como pero sus más este ser se y un lo",
}
LANGUAGES = tuple(FUNCTION_WORDS)

# Everything but ASCII letters, digits and bytes of other characters parts words.
_CLEAN = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))
_HASHERS: list[WordHasher] = []


def word_ids(texts: list[str | None]) -> list[np.ndarray]:
    """Embedding numbers of each text's lower-cased words and their prefixes, a row a word.

    A word no longer than the prefix has 0 for it.
    """
    if not _HASHERS:
        _HASHERS.append(WordHasher(7))
    out = []
    for text in texts:
        data = (text or "").lower().encode().translate(_CLEAN)
        start, end, whole = _HASHERS[0].words(data)
        part = _HASHERS[0].words(data, PREFIX)[2]
        ids = np.empty((len(whole), 2), np.int32)
        ids[:, 0] = whole % np.uint64(BUCKETS - 1) + np.uint64(1)
        ids[:, 1] = np.where(end - start > PREFIX, (part ^ np.uint64(1)) % np.uint64(BUCKETS - 1) + np.uint64(1), 0)
        out.append(ids)
    return out


def _language_table() -> np.ndarray:
    table = np.zeros((BUCKETS, len(LANGUAGES)), np.float32)
    for i, name in enumerate(LANGUAGES):
        for word in FUNCTION_WORDS[name].split():
            table[word_ids([word])[0][:, 0], i] = 1
    return table


_LANGUAGE: list[np.ndarray] = []


def language(ids: np.ndarray) -> int:
    """Index in LANGUAGES whose function words a text has most of."""
    if not _LANGUAGE:
        _LANGUAGE.append(_language_table())
    votes = _LANGUAGE[0][ids[:, 0]].sum(axis=0) if len(ids) else np.zeros(len(LANGUAGES))
    return int(votes.argmax())


@dataclass
class Model:
    """Parameters; ``shift`` is the threshold by language, in logits."""

    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, size, maps)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    intercept: float
    shift: dict[int, float] = field(default_factory=dict)
    constant: float | None = None

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width and place in the filter, every embedding's contribution."""
        return {w: [self.embedding @ f[j] for j in range(w)] for w, f in self.filters.items()}


def new_model(size: int = 16, maps: int = 16, seed: int = 1) -> Model:
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (BUCKETS, size)).astype(np.float32)
    embedding[0] = 0
    filters = {w: rng.normal(0, (2 / (w * size)) ** 0.5, (w, size, maps)).astype(np.float32) for w in WIDTHS}
    return Model(embedding, filters, {w: np.zeros(maps, np.float32) for w in WIDTHS}, rng.normal(0, 0.1, maps * len(WIDTHS)).astype(np.float32), 0.0)


def _padded(ids: list[np.ndarray], counted: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, each text followed by padding, and bounds for reduceat.

    Every other bound starts a text; the ones between end its ``counted`` first
    words (an empty text counts its padding), so that no window starts in the
    padding or belongs to the next text.
    """
    pad = np.zeros((max(WIDTHS) + 1, 2), np.int32)
    flat = np.concatenate([x for own in ids for x in (own, pad)])
    starts = np.concatenate([[0], np.cumsum([len(x) + len(pad) for x in ids])[:-1]])
    return flat, np.stack([starts, starts + np.maximum(counted, 1)], 1).ravel()


def logits(model: Model, tables: dict[int, list[np.ndarray]], texts: list[np.ndarray]) -> np.ndarray:
    """Scores of whole texts; parts of long ones are pooled together."""
    maps = len(model.out) // len(WIDTHS)
    best = np.full((len(texts), len(model.out)), -np.inf, np.float32)
    parts: list[np.ndarray] = []
    counted: list[int] = []
    owners: list[int] = []

    def flush() -> None:
        flat, bounds = _padded(parts, counted)
        for k, width in enumerate(WIDTHS):
            n = len(flat) - width + 1
            value = tables[width][0][flat[:n, 0]]
            value += tables[width][0][flat[:n, 1]]
            for j in range(1, width):
                value += tables[width][j][flat[j : j + n, 0]]
                value += tables[width][j][flat[j : j + n, 1]]
            np.maximum.at(best[:, k * maps : (k + 1) * maps], owners, np.maximum.reduceat(value, bounds, axis=0)[::2])
        parts.clear()
        counted.clear()
        owners.clear()

    held = 0
    for i, ids in enumerate(texts):
        for at in range(0, max(1, len(ids)), PART):
            own = ids[at : at + PART + max(WIDTHS) - 1]
            parts.append(own)
            counted.append(min(PART, len(ids) - at))
            owners.append(i)
            held += len(own)
            if held >= PART:
                flush()
                held = 0
    if parts:
        flush()
    bias = np.concatenate([model.bias[w] for w in WIDTHS])
    return np.maximum(best + bias, 0) @ model.out + model.intercept


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.2, drop: float = 0.5, seed: int = 1) -> Model:
    """Fit by Adagrad on the logistic loss; both classes weigh the same in total, softened by a square root."""
    model = new_model(seed=seed)
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        model.constant = float(labels[0]) if len(labels) else 0.0
        return model
    rng = np.random.default_rng(seed)
    texts_with = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=BUCKETS)
    texts_with[0] = 0
    model.embedding[texts_with < LEAST_TEXTS] = 0
    positive = np.sqrt((1 - labels.mean()) / labels.mean())
    maps = len(model.out) // len(WIDTHS)
    past = {"e": np.full_like(model.embedding, 1e-3), "o": np.full_like(model.out, 1e-3), "i": 1e-3}
    past |= {w: np.full_like(f, 1e-3) for w, f in model.filters.items()} | {("b", w): np.full(maps, 1e-3, np.float32) for w in WIDTHS}
    for _ in range(epochs):
        # Batches of texts of like length waste least; their order is random.
        order = np.argsort([len(t) for t in texts], kind="stable")
        chunks = [order[a : a + batch] for a in range(0, len(order), batch)]
        for c in rng.permutation(len(chunks)):
            rows = chunks[c]
            flat, bounds = _padded([texts[r] for r in rows], [len(texts[r]) for r in rows])
            # Words left out at random, so that no word is learnt only until another explains its texts.
            flat = flat * (rng.random(len(flat)) >= drop)[:, None]
            vectors = model.embedding[flat[:, 0]] + model.embedding[flat[:, 1]]
            features, where = [], {}
            for w in WIDTHS:
                n = len(flat) - w + 1
                value = sum(vectors[j : j + n] @ model.filters[w][j] for j in range(w))
                top = np.maximum.reduceat(value, bounds, axis=0)[::2]
                where[w] = np.stack([s + value[s:e].argmax(axis=0) for s, e in bounds.reshape(-1, 2)])
                features.append(top + model.bias[w])
            hidden = np.maximum(np.concatenate(features, axis=1), 0)
            score = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.intercept, -30, 30)))
            slope = (score - labels[rows]) * np.where(labels[rows] > 0, positive, 1) / len(rows)
            down = slope[:, None] * model.out[None, :] * (hidden > 0)
            _step(model.out, hidden.T @ slope, past, "o", rate)
            g = float(slope.sum())
            past["i"] += g * g
            model.intercept -= rate * g / past["i"] ** 0.5
            for k, w in enumerate(WIDTHS):
                own = down[:, k * maps : (k + 1) * maps].astype(np.float32)
                grad = np.zeros_like(model.filters[w])
                touched, pull = [], []
                for j in range(w):
                    at = where[w] + j
                    grad[j] = np.einsum("bms,bm->sm", vectors[at], own)
                    back = (own[:, :, None] * model.filters[w][j].T[None]).reshape(-1, vectors.shape[1])
                    for side in (0, 1):
                        touched.append(flat[at, side].ravel())
                        pull.append(back)
                _step(model.bias[w], own.sum(axis=0), past, ("b", w), rate)
                _step(model.filters[w], grad, past, w, rate)
                ids, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                total = np.zeros((len(ids), vectors.shape[1]), np.float32)
                np.add.at(total, inverse, np.concatenate(pull))
                ids, total = ids[learnt := texts_with[ids] >= LEAST_TEXTS], total[learnt]
                past["e"][ids] += total**2
                model.embedding[ids] -= rate * total / np.sqrt(past["e"][ids])
    return model


def _step(values: np.ndarray, grad: np.ndarray, past: dict, key, rate: float) -> None:
    past[key] += grad**2
    values -= rate * grad / np.sqrt(past[key])


def _threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The logit between two scores at which F1 is best."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    at = int(f1.argmax())
    low = scores[order[at + 1]] if at + 1 < len(order) else scores[order[at]] - 1
    return float((scores[order[at]] + low) / 2)


def calibrate(model: Model, texts: list[np.ndarray], labels: np.ndarray, weight: int = 10) -> Model:
    """Set thresholds by language.

    A language's own threshold counts with its rows of the rarer class, the
    one of all languages with ``weight`` rows; without both classes there is
    only the latter.
    """
    labels = np.asarray(labels)
    if model.constant is not None or not len(labels) or labels.min() == labels.max():
        return model
    scores = logits(model, model.tables(), texts)
    spoken = np.array([language(t) for t in texts])
    every = _threshold(scores, labels)
    for i in range(len(LANGUAGES)):
        own = spoken == i
        n = min((labels[own] == 1).sum(), (labels[own] == 0).sum()) if own.any() else 0
        model.shift[i] = float((n * _threshold(scores[own], labels[own]) + weight * every) / (n + weight)) if n else every
    return model


def held_out(doc_id):
    """Rows that no label is learnt from: CRC-32 of the id's text leaves 0 modulo 5."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", most_positive: int = 3000, most_negative: int = 6000) -> Model:
    """A calibrated model from at most ``most_positive`` and ``most_negative`` labelled rows.

    Rows are taken in the order of a hash of their id, never those of
    :func:`held_out`; of repeated labels the largest counts, and null ids or
    labels are left out.  A fifth of them calibrates, the rest trains.  Without
    rows of both classes the score is the one class there is, or 0.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("_id"))
    marks = marks.agg((F.max(label) > 0).cast("int").alias("_label"))
    marks = marks.where(~held_out("_id")).withColumn("_order", F.xxhash64("_id"))
    some = [marks.where(F.col("_label") == v).orderBy("_order", "_id").limit(n) for v, n in ((1, most_positive), (0, most_negative))]
    # At most most_positive + most_negative ids are broadcast.
    sample = F.broadcast(some[0].unionByName(some[1]))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            ids = [x.tobytes() for x in word_ids(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["id", "label", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    rows = rows.join(sample, "_id").select("_id", "_label", "_text").mapInArrow(tokens, "id long, label int, ids binary")
    found = sorted(rows.collect(), key=lambda r: (r[0], r[1], bytes(r[2])))
    texts = [np.frombuffer(r[2], np.int32).reshape(-1, 2) for r in found]
    marks = np.array([r[1] for r in found])
    fold = np.arange(len(found)) % 5 == 4
    model = train([t for t, f in zip(texts, fold, strict=True) if not f], marks[~fold])
    return calibrate(model, [t for t, f in zip(texts, fold, strict=True) if f], marks[fold])


def scores(model: Model, texts: list[str | None], tables: dict | None = None) -> np.ndarray:
    """Calibrated scores from 0 to 1 of whole texts; 0.5 is the threshold of the language."""
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    ids = word_ids(texts)
    shift = np.array([model.shift.get(language(x), 0.0) for x in ids])
    return 1 / (1 + np.exp(-np.clip(logits(model, tables or model.tables(), ids) - shift, -700, 700).astype(float)))


def score_column(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with ``score``; the model (5 MB whatever the corpus) is broadcast.

    Null texts score as empty ones, repeated rows alike; a column of ``docs``
    by the name of the score is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = sent.value.tables()
        for batch in batches:
            parts = slices([pa.RecordBatch.from_arrays([batch], ["text"])], 0)
            found = [scores(sent.value, part.column(0).to_pylist(), tables) for part in parts]
            yield pa.array(np.concatenate([np.zeros(0), *found]))

    return docs.withColumn(name, score(F.col(text).cast("string")))


def reject(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those that score as toxic; columns stay as they are, whatever their names.

    Null texts score as empty ones; repeated rows go or stay alike.
    """
    model = fit(docs, labels, text, doc_id, **options)
    name = free_name(docs, "_toxicity")
    return score_column(docs, model, text, name).where(F.col(name) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
