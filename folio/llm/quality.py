"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Random indexing: every word has a sparse index vector of a few +1 and -1 at places given by its
hash; the vector of a word is the sum of the index vectors of the words around it, over all
documents.  Nothing has to be factorised and sums come from any number of tasks.  Words in
question are described twice: by their letters in lower case, and by their form (case, affixed
marks, length, whether they repeat the word before).  A document is the mean of its words'
vectors and of the index vectors of their forms, with a few ratios.  A two-layer numpy network on the
pooled vectors gives a logit; a temperature fitted on rows kept from training calibrates it.

Every word of all documents has a vector: words are hashed to ``SLOTS`` vectors, which those of one slot share, so the
table has one size whatever the corpus.  The network is fitted on
``SAMPLE`` labelled rows at most, those of the smallest hashed ids.  Vectors and weights are of fixed
size and can be broadcast.  Scoring reads every whole text.
Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts have the zero vector and get a score; labels of null value
or without a document are ignored and repeated ones agree by their mean (ties are 1); without
labels of both kinds every score is the mean label, or 0.5 without any; repeated rows are
each scored; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import drop, keep
from .words import Words, mix, slices

#: Labelled rows to fit on; vectors that words share; width of word vectors and of form vectors.
SAMPLE, SLOTS, WIDTH, FORMS = 12_000, 1 << 14, 32, 64
HIDDEN, EPOCHS, RATE, DECAY = 32, 40, 3e-3, 1e-4
WINDOW, PLACES = 2, 4
EXTRA = 5
#: Text bytes that are pooled at a time; a word takes up to two kilobytes of arrays.
SLICE = 512 << 10


def index_places(h: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The PLACES entries of a sparse ternary vector, from the hash: (place, +1 or -1)."""
    out = []
    for k in range(PLACES):
        x = mix(h + np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        out.append(((x % np.uint64(width)).astype(np.int64), np.where(x >> np.uint64(63), 1.0, -1.0)))
    return out


def index_vectors(h: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(h), width), np.float32)
    for place, sign in index_places(h, width):
        np.add.at(out, (np.arange(len(h)), place), sign.astype(np.float32))
    return out


def word_forms(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(form of each word as a small number, whether it equals the word before in its text)."""
    data = words.data
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
    letters = np.concatenate([[0], np.cumsum(letter)])
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    s, e = words.starts, words.ends
    n = e - s
    ups, alphas, nums = upper[e] - upper[s], letters[e] - letters[s], digits[e] - digits[s]
    marks = n - alphas - nums
    case = np.where(ups == 0, 0, np.where(ups * 2 > alphas, 2, 1))
    last = np.where(letter[e - 1], 0, data[e - 1]) if len(e) else np.zeros(0, np.uint8)
    before = np.where(n > 1, np.where(letter[e - np.minimum(n, 2)], 0, data[e - np.minimum(n, 2)]), 0) if len(e) else last
    again = np.zeros(len(h), bool)
    if len(h):
        again[1:] = h[1:] == h[:-1]
        again[words.first[:-1][words.counts > 0]] = False
    form = last.astype(np.int64)
    for part, base in ((before.astype(np.int64), 256), (case, 4), (np.minimum(marks, 3), 4), (nums > 0, 2), (np.minimum(n, 24) // 4, 8), (alphas > 0, 2), (again, 2)):
        form = form * base + part
    return form, again


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows first[i]:first[i + 1]."""
    total = np.zeros((len(first) - 1, *values.shape[1:]), np.float64)
    some = np.flatnonzero(first[1:] > first[:-1])
    if len(some):
        total[some] = np.add.reduceat(values, first[some], axis=0, dtype=np.float64)
    return total


def slot_of(h: np.ndarray, slots: int) -> np.ndarray:
    return (mix(h ^ np.uint64(0x510E_527F)) % np.uint64(slots)).astype(np.int64)


@dataclass
class Vectors:
    """Word vectors by slot."""

    table: np.ndarray

    def pool(self, column: pa.Array) -> np.ndarray:
        """The vector of each text."""
        w = Words(column)
        h = w.hashes()
        n = w.counts
        per = 1.0 / np.maximum(n, 1)
        row = np.repeat(np.arange(w.n), n)
        # a text's words by vector: each distinct one is read once
        slots = len(self.table)
        key, count = np.unique(row * slots + slot_of(h, slots), return_counts=True)
        weighed = self.table[key % slots]
        weighed *= count[:, None].astype(np.float32)
        parts = [_sums(weighed, np.searchsorted(key, np.arange(w.n + 1) * slots)) * per[:, None]]
        del weighed
        form, again = word_forms(w, h)
        forms, which = np.unique(form, return_inverse=True)
        vectors = index_vectors(mix(forms.astype(np.uint64)), FORMS)
        key, count = np.unique(row * max(len(forms), 1) + which, return_counts=True)
        first = np.searchsorted(key // max(len(forms), 1), np.arange(w.n + 1))
        parts.append(_sums(vectors[key % max(len(forms), 1)] * count[:, None].astype(np.float32), first) * per[:, None])
        order = np.lexsort((h, row))
        hs, rs = h[order], row[order]
        new = np.append(True, (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])) if len(hs) else np.zeros(0, bool)
        distinct = np.bincount(rs[new], minlength=w.n) * per
        size = np.diff(w.offsets)
        lines = np.add.reduceat(np.append(w.data == 10, False), np.minimum(w.offsets[:-1], len(w.data))) if w.n else size
        lines = np.where(size > 0, lines, 0)
        parts.append(
            np.stack([distinct, np.bincount(row[again], minlength=w.n) * per, np.log1p(n), np.log1p(lines), size * per / 16], 1)
        )
        return np.concatenate(parts, 1).astype(np.float32)


def around(column: pa.Array, slots: int, width: int) -> np.ndarray:
    """By slot, the sum of the index vectors of the words around its words; whole numbers, so any order of adding gives the same."""
    w = Words(column)
    h = w.hashes()
    if not len(h):
        return np.zeros(slots * width)
    places = index_places(h, width)
    row, slot = np.repeat(np.arange(w.n), w.counts), slot_of(h, slots) * width
    to, signs = [], []
    for d in (*range(-WINDOW, 0), *range(1, WINDOW + 1)):
        at = np.arange(max(-d, 0), len(h) - max(d, 0))
        at = at[row[at] == row[at + d]]
        for place, sign in places:
            # where a neighbour stands is told by a rotation of its vector
            to.append(slot[at] + (place[at + d] + d) % width)
            signs.append(sign[at + d])
    return np.bincount(np.concatenate(to), np.concatenate(signs), slots * width)


def fit_vectors(docs: DataFrame, text: str = "text", slots: int = SLOTS, width: int = WIDTH) -> Vectors:
    """Random-indexing vectors of the words of all documents, from all places where they stand."""

    def sums(batches):
        total = np.zeros(slots * width)
        for batch in batches:
            for part in slices(batch, text, SLICE):
                total += around(part.column(0), slots, width)
        total = total.reshape(-1, width)
        some = np.flatnonzero(np.abs(total).sum(1))
        for k in range(0, len(some), 1024):
            at = some[k : k + 1024]
            flat = pa.FixedSizeListArray.from_arrays(pa.array(total[at].ravel()), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), flat], ["at", "v"])

    parts = docs.select(text).mapInArrow(sums, "at int, v array<double>")
    # one row for each slot
    found = parts.groupBy("at").agg(*[F.sum(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(width)]).toArrow()
    table = np.zeros((slots, width), np.float64)
    table[found["at"].to_numpy()] = np.stack([found[f"v{k}"].to_numpy() for k in range(width)], 1)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    return Vectors(table.astype(np.float32))


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        hidden = np.maximum(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1, 0)
        return (hidden @ w2 + b2)[:, 0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """Two layers by Adam on four fifths of the rows; the temperature on the other fifth."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    net = Network(x.mean(0) if len(x) else np.zeros(x.shape[1]), (x.std(0) if len(x) else np.ones(x.shape[1])) + 1e-3, [])
    p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    net.weights = [
        rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, 1)),
        np.array([np.log(p / (1 - p))]),
    ]
    if len(np.unique(y)) < 2:
        net.weights[2][:] = 0
        return net
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 5], order[len(y) // 5 :]
    z = np.clip((x - net.mean) / net.scale, -8, 8)
    moment = [np.zeros_like(w) for w in net.weights]
    square = [np.zeros_like(w) for w in net.weights]
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            w1, b1, w2, b2 = net.weights
            a = z[part] @ w1 + b1
            hidden = np.maximum(a, 0)
            out = hidden @ w2 + b2
            d = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[part, None]) / len(part)
            dh = (d @ w2.T) * (a > 0)
            grads = [z[part].T @ dh, dh.sum(0), hidden.T @ d, d.sum(0)]
            step += 1
            for k, g in enumerate(grads):
                g = g + DECAY * net.weights[k] * (k in (0, 2))
                moment[k] = 0.9 * moment[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                net.weights[k] = net.weights[k] - rate * (moment[k] / (1 - 0.9**step)) / (
                    np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8
                )
    if len(held):
        out, t = net.logits(x[held]), y[held]
        loss = lambda k: np.mean(np.logaddexp(0, out / k) - t * out / k)
        net.temperature = float(min(np.geomspace(0.25, 8, 81), key=loss))
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, doc_id: str, text: str) -> DataFrame:
    """text and y of at most ``limit`` labelled rows, those of the smallest hashed ids."""
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    marks = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("mark")).where("mark is not null and id is not null")
    marks = marks.groupBy("id").agg((F.avg("mark") >= 0.5).cast("double").alias("y"))
    marks = marks.where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    marks = marks.join(docs.select("id").distinct(), "id", "left_semi")
    chosen = marks.orderBy(F.xxhash64("id"), "id").limit(limit)
    # ``limit`` rows of two numbers: bounded by the parameter
    rows = docs.join(F.broadcast(chosen), "id").select("text", "y", "id")
    return keep(rows.dropDuplicates(["id"]).drop("id"), "quality-sample")


class QualityModel:
    """A fitted classifier: word vectors and network, both of bounded size, as broadcasts of plain arrays."""

    def __init__(self, docs: DataFrame, labels: DataFrame, label: str, limit: int, doc_id: str, text: str):
        context = docs.sparkSession.sparkContext
        sample = labelled_sample(docs, labels, label, limit, doc_id, text)
        fitted = fit_vectors(docs.select(F.col(text).alias("text")))
        self.vectors = vectors = context.broadcast(fitted.table)
        n_features = WIDTH + FORMS + EXTRA

        def pooled(batches):
            known = Vectors(vectors.value)
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    x = known.pool(part.column(0)).astype(np.float32)
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([flat, part.column(1)], ["x", "y"])

        # at most ``limit`` rows of fixed width
        rows = sample.mapInArrow(pooled, "x array<float>, y double").toArrow()
        drop(sample)
        x = np.array(rows["x"].combine_chunks().flatten().to_numpy() if len(rows) else [], np.float32).reshape(-1, n_features)
        y = rows["y"].to_numpy().astype(np.float64)
        order = np.lexsort((*x.T[:4], y))  # the same rows in the same order whatever tasks delivered them
        net = fit_network(x[order], y[order])
        self.network = context.broadcast((net.mean, net.scale, net.weights, net.temperature))

    def on_worker(self) -> Scorer:
        return Scorer(Vectors(self.vectors.value), Network(*self.network.value))


@dataclass
class Scorer:
    vectors: Vectors
    network: Network

    def scored(self, batch: pa.RecordBatch, column: str):
        """(part of the batch, scores of its texts)"""
        for part in slices(batch, column, SLICE):
            yield part, self.network.scores(self.vectors.pool(part.column(part.schema.get_field_index(column))))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    limit: int = SAMPLE,
    threshold: float = 0.3,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs`` with held_out, score and predicted added; columns of these names, in any case, are replaced."""
    model = QualityModel(docs, labels, label, limit, doc_id, text)
    start = model.on_worker
    names = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]

    def score(batches):
        scorer = start()
        for batch in batches:
            for part, s in scorer.scored(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], [*names, "score"])

    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    out = docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select(
        *[F.col(f"`{c}`") for c in names],
        held.alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    limit: int = SAMPLE,
    threshold: float = 0.3,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, as they are."""
    model = QualityModel(docs, labels, label, limit, doc_id, text)
    start = model.on_worker

    def good(batches):
        scorer = start()
        for batch in batches:
            for part, s in scorer.scored(batch, text):
                yield part.filter(pa.array(s >= threshold))

    return docs.mapInArrow(good, docs.schema)
