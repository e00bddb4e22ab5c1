"""Language-model scores from a hierarchical Pitman-Yor model.

Every text is a row of words and an end.  A word is a customer in the restaurant of its context,
the word before it; every word has a restaurant of its own.  All context restaurants share one
parent, the restaurant of single words, and that one has the uniform distribution over the vocabulary and one unknown word
as its base.  A table in a context restaurant is a customer of the parent.

Seating is sampled by Gibbs sweeps.  At first the customers of a dish sit down one after another, a new table being taken
in proportion to the strength, the tables in the restaurant and the parent's probability.  Then, in each sweep, every customer
leaves about once and sits down again, at an occupied table in proportion to its customers less the discount, or at
a new one: one by one, or where a dish has more than ``ROUNDS`` customers, in as many shares.  Sizes of tables are
integrated out: given its customers and tables, the chance that the one who leaves sat alone has a closed form (``Alone``), so a
dish is two numbers at any count.  One customer at a time is an exact Gibbs move; the customers of a share move by the
chances at its start.  All dishes of a bucket move at once, and see other dishes' tables as of the sweep before.  The parent's
customers are the tables of its children: those who are gone leave, new ones sit down, and then they move as the others.
Discounts are estimated from the numbers of single and double customers.  The predictive probabilities of ``SAMPLES`` sweeps
after ``BURN`` are averaged, and their logarithms summed over each text; its perplexity is that sum's mean a token.

Layout.  Pieces of the input send, for each bucket of words, the distinct (word, context) pairs with
their counts and the documents they occur in, as packed arrays; so a word costs one entry for
each context and piece, however often it occurs.  A word with more than a 512th of all tokens (there
are fewer than 1024 such words) is dealt to all buckets by its context.  Tokens of a pair with such a share never leave
their piece: its two numbers are a fixed size for all pairs together and are kept by the driver, and the piece adds its chance
up.  A bucket's task seats its words.  Customers and tables by context grow with the vocabulary: between sweeps each bucket
sends its own sums, they are added up by ranges of contexts and go back to the buckets that have the
context, in a Spark table for each sweep.  A few totals and the frequent words' tables have a fixed
size and go through the driver.  Sums by document return to the piece they came from.

Seeds depend on the sweep and the bucket alone, so a lost task repeats its draws.  A bucket's seating is a row of a
table of its own after each sweep.

Words are kept as 50-bit hashes.

Defined results: null and empty texts consist of an end; rows of null id are training rows;
repeated rows count and are scored each; without training rows every probability is the
uniform one over a vocabulary of none; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .scratch import drop, keep, keep_bucketed, release
from .words import Words, mix, slices

BURN, SAMPLES, ROUNDS = 1, 2, 32
#: Customers of a dish up to which the chance of sitting alone comes from the recursion.
EXACT = 256
STRENGTH, ROOT_STRENGTH = 2.0, 10.0
#: Tokens of one piece of input, and of one bucket of words on average.
PIECE, BUCKET = 2 << 20, 1 << 20
#: Bytes of sums by document that a task holds before it sends them.
HELD = 16 << 20
_END = 0x5A17_C0DE_0E4D_0001
_WORD_BITS = 50
_LOW = np.uint64(0xFFFF_FFFF)
_HOT_SHARE = 1024


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, row, tokens of each row); every row ends with the end, which is the context of the next row's first word."""
    words = Words(column)
    n = words.counts + 1
    last = np.cumsum(n) - 1
    h = np.full(len(words.starts) + words.n, np.uint64(_END))
    inner = np.ones(len(h), bool)
    inner[last] = False
    h[inner] = words.hashes()
    h >>= np.uint64(64 - _WORD_BITS)
    return h, np.repeat(np.arange(words.n, dtype=np.int32), n), n


def _pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, which compresses well."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, compressed: rows of millions of them pass through joins."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _values(data: bytes, kind) -> np.ndarray:
    raw = pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), codec="zstd")
    planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_values(data, np.uint64), dtype=np.uint64)


def _keys(word_at: np.ndarray, context_at: np.ndarray) -> np.ndarray:
    """Pairs as numbers: the place of the word in the upper, that of the context in the lower half."""
    return word_at.astype(np.uint64) << np.uint64(32) | context_at.astype(np.uint64)


def _word(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(32)).astype(np.int64)


def _context(keys: np.ndarray) -> np.ndarray:
    return (keys & _LOW).astype(np.int64)


def seats(tables: np.ndarray, at: np.ndarray, customers: np.ndarray, strength: np.ndarray, slope: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables of dishes after more of their customers sat down than the first ``at``; a new table's weight is strength + slope * tables."""
    first = (at < 1) & (customers > 0)
    tables, at = np.where(first, 1, tables), np.where(first, 1, at)
    todo = np.flatnonzero(customers > at)
    while len(todo):
        n, t = at[todo], tables[todo]
        block = np.minimum(np.maximum(1, n // 4), customers[todo] - n)
        fresh = strength[todo] + slope[todo] * t
        p = fresh / (fresh + np.maximum(n - discount * t, 1e-9))
        tables[todo] = t + rng.binomial(block, np.clip(p, 0, 1))
        at[todo] = n + block
        todo = todo[customers[todo] > at[todo]]
    return tables


class Alone:
    """The chance that a customer of a dish, drawn at random, sits alone, by the dish's customers and tables.

    Given both, a seating has the weight of its tables' sizes alone, whatever the weight of a new table, so the chance is a
    ratio of generalised Stirling numbers: S(c - 1, t - 1) / S(c, t), with S(c, t) = S(c - 1, t - 1) + (c - 1 - d t) S(c - 1, t).
    Up to ``EXACT`` customers it is taken from that recursion.  Beyond, table sizes follow the law with the generating
    function 1 - (1 - x)^d, x being such that their mean is that of the dish: a share d x / (1 - (1 - x)^d) of the tables is single.
    """

    def __init__(self, discount: float):
        log = np.full((EXACT + 1, EXACT + 1), -np.inf)
        log[0, 0] = 0
        self.table = np.zeros((EXACT + 1, EXACT + 1))
        for c in range(1, EXACT + 1):
            others = c - 1 - discount * np.arange(1, c + 1)
            stay = np.where(others > 0, log[c - 1, 1 : c + 1] + np.log(np.maximum(others, 1e-300)), -np.inf)
            log[c, 1 : c + 1] = np.logaddexp(log[c - 1, :c], stay)
            self.table[c, 1 : c + 1] = np.exp(log[c - 1, :c] - log[c, 1 : c + 1])
        rest = np.logspace(-1e-9, -15, 8192)  # 1 - x
        full = -np.expm1(discount * np.log(rest))
        self.mean = np.log((1 - rest) * discount * rest ** (discount - 1) / full)
        self.single = discount * (1 - rest) / full

    def __call__(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        small = customers <= EXACT
        out = self.table[np.where(small, customers, 0), np.where(small, tables, 0)]
        c, t = customers[~small] - 1, tables[~small] - 1
        out[~small] = t / c * np.interp(np.log(c / np.maximum(t, 1e-9)), self.mean, self.single)
        return out


@lru_cache(maxsize=4)
def alone(discount: float) -> Alone:
    return Alone(discount)


def _several(n: np.ndarray, p: np.ndarray, rng) -> np.ndarray:
    """Binomial draws; most are of one."""
    out = (rng.random(len(n)) < p).astype(np.int64)
    many = np.flatnonzero(n > 1)
    out[many] = rng.binomial(n[many], np.clip(p[many], 0, 1))
    return out


def moved(tables: np.ndarray, customers: np.ndarray, strength: np.ndarray, slope: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables after a sweep, in which every customer leaves about once and sits down again: a dish of up to ``ROUNDS`` customers
    has a round for each of them, others ``ROUNDS`` rounds of an equal share of them; a new table's weight is strength + slope * tables."""
    where = np.flatnonzero(customers > 1)
    where = where[np.argsort(-customers[where], kind="stable")]
    customers, strength, slope = customers[where], strength[where], slope[where]
    all_shares, tables = -(-customers // ROUNDS), tables.copy()
    now = tables[where]
    for k in range(ROUNDS):
        n = int(np.searchsorted(-customers, -k))  # those with more than k customers come first
        if not n:
            break
        c, t, share = customers[:n], now[:n], all_shares[:n]
        gone = np.minimum(_several(share, alone(discount)(c, t), rng), t - 1)
        left = t - gone / share
        fresh = strength[:n] + slope[:n] * left
        now[:n] = np.minimum(t - gone + _several(share, fresh / (fresh + np.maximum(c - 1 - discount * left, 1e-9)), rng), c)
    tables[where] = now
    return tables


def followed(tables: np.ndarray, before: np.ndarray, customers: np.ndarray, strength: np.ndarray, slope: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables of dishes that had others customers before: those who are missing leave, new ones sit down, and then they move."""
    fewer = np.flatnonzero(customers < before)
    tables = tables.copy()
    left = rng.binomial(before[fewer] - customers[fewer], np.clip(alone(discount)(before[fewer], tables[fewer]), 0, 1))
    tables[fewer] = np.clip(tables[fewer] - left, np.minimum(customers[fewer], 1), customers[fewer])
    tables = seats(tables, np.minimum(before, customers), customers, strength, slope, discount, rng)
    return moved(tables, customers, strength, slope, discount, rng)


def _places(among: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each x in a sorted array, or -1."""
    if not len(among):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return np.where(among[at] == x, at, -1)


class Bucket:
    """Training pairs of a bucket of words and their seating."""

    def __init__(self, number: int, keys: np.ndarray, counts: np.ndarray, hot: np.ndarray, names: np.ndarray, contexts: np.ndarray):
        self.number, self.keys, self.counts, self.frequent = number, keys, counts, hot
        self.names, self.contexts = names, contexts  # sorted, whether trained or not; keys hold places in them
        word = _word(keys)
        new = np.append(True, word[1:] != word[:-1]) if len(word) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        self.words = names[word[self.first]]
        self.of = np.cumsum(new) - 1
        self.context = _context(keys)
        self.hot = _places(hot, self.words)
        self.hot_context = _places(contexts, hot)
        self.tables = np.ones(len(keys), np.int64)
        self.seated = False
        self.totals = self._by_word(counts)
        self.customers = self._by_word(self.tables)
        self.root = np.ones(len(self.words), np.int64)

    def _by_word(self, values):
        return np.add.reduceat(values, self.first) if len(values) else np.zeros(0, np.int64)

    def stored(self) -> list[bytes]:
        """The seating: tables of each pair, tables of each word in the root."""
        return [_planes(x.astype(np.uint64)) for x in (self.tables, self.root)]

    def restore(self, tables: bytes, root: bytes) -> None:
        self.tables, self.root = (_values(x, np.uint64).astype(np.int64) for x in (tables, root))
        self.seated = True
        self.customers = self._by_word(self.tables)

    def around(self, data: bytes, frequent: np.ndarray) -> np.ndarray:
        """Sums by context; those of frequent words, which have frequent pairs too, are known to all."""
        out, at = _values(data, np.uint64).astype(float), np.flatnonzero(self.hot_context >= 0)
        out[self.hot_context[at]] = frequent[at]
        return out

    def parent(self, s: dict) -> np.ndarray:
        """The parent's probability of each word, given the state before this sweep."""
        customers, root = self.customers.astype(float), self.root.astype(float)
        is_hot = self.hot >= 0
        customers[is_hot] = s["hot_tables"][self.hot[is_hot]]
        root[is_hot] = s["hot_root"][self.hot[is_hot]]
        return (np.maximum(customers - s["d0"] * root, 0) + base_weight(s)) / (ROOT_STRENGTH + s["tables"])

    def sweep(self, k: int, s: dict, context_tables: np.ndarray) -> None:
        rng = np.random.default_rng([k, self.number])
        p = self.parent(s)[self.of]
        others = context_tables[self.context] - self.tables
        strength, slope = (STRENGTH + s["d1"] * np.maximum(others, 0)) * p, s["d1"] * p
        before = self.customers if self.seated else np.ones(len(self.words), np.int64)
        if not self.seated:
            self.tables = seats(self.tables, np.minimum(self.counts, 1), self.counts, strength, slope, s["d1"], rng)
            self.seated = True
        self.tables = moved(self.tables, self.counts, strength, slope, s["d1"], rng)
        self.customers = self._by_word(self.tables)
        each = np.full(len(self.words), s["d0"] / (s["vocabulary"] + 1))
        weight = np.maximum(base_weight(s) - each * self.root, each)
        self.root = followed(self.root, before, self.customers, weight, each, s["d0"], rng)

    def share(self, ranges: int) -> pa.RecordBatch:
        """What others need of this bucket's seating: (kind, place, value) to be summed, as kind 0 the
        tables and customers by context for each range of contexts, with the bucket as the value, and as kind -1 the
        seating itself, for the next sweep."""
        cold = self.hot < 0
        where = np.flatnonzero(~cold)
        once, twice = [int((self.counts == k).sum()) for k in (1, 2)]
        root_once, root_twice = [int((self.customers[cold] == k).sum()) for k in (1, 2)]
        totals = [once, twice, root_once, root_twice, int(self.root[cold].sum()), int(cold.sum())]
        totals += [int(self.tables.sum()), int(self.counts.sum())]
        tables = np.bincount(self.context, self.tables, len(self.contexts)).astype(np.uint64)
        counts = np.bincount(self.context, self.counts, len(self.contexts)).astype(np.uint64)
        near = np.flatnonzero(self.hot_context >= 0)
        sizes = [len(where), len(where), len(totals), len(near), len(near)]
        kind, place = [np.repeat([2, 3, 4, 5, 6], sizes)], [self.hot[where], self.hot[where], np.arange(len(totals)), near, near]
        value = [self.customers[where], self.totals[where], totals, tables[self.hot_context[near]], counts[self.hot_context[near]]]
        packed = [[None] * sum(sizes) for _ in range(3)]
        to = (self.contexts >> np.uint64(_WORD_BITS - 32)) * np.uint64(ranges) >> np.uint64(32)
        begin = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
        for a, b in zip(begin, np.append(begin[1:], len(to)), strict=True):
            packed[0].append(_pack(self.contexts[a:b]))
            packed[1].append(_planes(tables[a:b]))
            packed[2].append(_planes(counts[a:b]))
        for one, x in zip(packed, [None, *self.stored()], strict=True):
            one.append(x)
        kind += [np.zeros(len(begin)), [-1]]
        place += [to[begin], [0]]
        value += [np.full(len(begin), self.number), [self.number]]
        arrays = [pa.array(np.concatenate([np.asarray(y, np.int64) for y in x])) for x in (kind, place, value)]
        arrays += [pa.array(x, pa.binary()) for x in packed]
        return pa.RecordBatch.from_arrays(arrays, ["kind", "place", "value", "contexts", "tables", "counts"])


def _add_contexts(table: pa.Table) -> pa.Table:
    """Sums over all buckets of a range of contexts, for each bucket in the order of its own contexts."""
    contexts = [_unpack(x) for x in table["contexts"].to_pylist()]
    _, at = np.unique(np.concatenate(contexts), return_inverse=True)
    edges = np.cumsum([len(x) for x in contexts])[:-1]
    out = {"bucket": table["value"].cast(pa.int32()), "place": table["place"]}
    for name in ("tables", "counts"):
        values = np.concatenate([_values(x, np.uint64) for x in table[name].to_pylist()])
        sums = np.zeros(int(at.max()) + 1, np.uint64)
        np.add.at(sums, at, values)
        out[name] = pa.array([_planes(x) for x in np.split(sums[at], edges)], pa.binary())
    return pa.table(out)


def _joined(table: pa.Table) -> pa.Table:
    """The ranges of a bucket in order, as one row."""
    table = table.sort_by("place")
    out = {"bucket": table["bucket"].slice(0, 1)}
    for name in ("tables", "counts"):
        out[name] = pa.array([_planes(np.concatenate([_values(x, np.uint64) for x in table[name].to_pylist()]))], pa.binary())
    return pa.table(out)


def base_weight(s: dict) -> float:
    return (ROOT_STRENGTH + s["d0"] * s["root"]) / (s["vocabulary"] + 1)


def _merged(words: list[bytes], contexts: list[bytes], counts: list[bytes], number: int, hot: np.ndarray) -> tuple[Bucket, list[np.ndarray]]:
    """The bucket of all parts' pairs, and each part's pairs as places in its words and contexts."""
    words, contexts = [_unpack(x) for x in words], [_values(x, np.uint64) for x in contexts]
    names, befores = np.unique(np.concatenate(words)), np.unique(np.concatenate(contexts))
    keys = []
    while words:
        keys.append(_keys(np.searchsorted(names, words.pop(0)), np.searchsorted(befores, contexts.pop(0))))
    k, c = np.concatenate(keys), np.concatenate([_values(x, np.uint32) for x in counts])
    k, c = k[c > 0], c[c > 0]
    order = np.argsort(k)
    k, c = k[order], c[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    c = np.add.reduceat(c.astype(np.int64), at) if len(k) else np.zeros(0, np.int64)
    return Bucket(number, k[at], c, hot, names, befores), keys


def _stored(columns: list[bytes], number: int, hot: np.ndarray) -> Bucket:
    keys, counts, names, contexts = columns
    return Bucket(number, _unpack(keys), _values(counts, np.uint64).astype(np.int64), hot, _unpack(names), _unpack(contexts))


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", burn: int = BURN, samples: int = SAMPLES) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))
    kind = docs.schema[doc_id].dataType
    id_schema = pa.schema([("id", to_arrow_type(kind))])
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held.alias("held"))

    def frequent(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, *_ = _tokens(part.column(1))
                word, at, n = np.unique(tokens, return_inverse=True, return_counts=True)
                many = n >= len(tokens) / _HOT_SHARE
                after = np.flatnonzero(many[at])  # a frequent pair's words are frequent both
                pair, m = np.unique(_keys(at[after], at[after - 1]), return_counts=True)
                pair, m = pair[m >= len(tokens) / _HOT_SHARE], m[m >= len(tokens) / _HOT_SHARE]
                words = [None, *word[many].astype(np.int64), *word[_word(pair)].astype(np.int64)]
                before = [None] * (1 + int(many.sum())) + word[_context(pair)].astype(np.int64).tolist()
                arrays = [pa.array(words, pa.int64()), pa.array(before, pa.int64()), pa.array([len(tokens), *n[many], *m], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["word", "before", "n"])

    # a word, or a pair, with a 512th of all tokens has a 1024th of them in pieces where it has that share: none is missed,
    # and those that have a 1024th of all tokens are 1024 at most
    found = docs.mapInArrow(frequent, "word long, before long, n long").groupBy("word", "before").agg(F.sum("n").alias("n"))
    heavy = keep(found, "lm-heavy")
    tokens = (heavy.where("word is null").first() or {"n": 0})["n"]
    often = heavy.where("word is not null").where(F.col("n") >= tokens / _HOT_SHARE).collect()
    hot = np.array(sorted(r.word for r in often if r.before is None), np.uint64)
    pairs = [(r.word, r.before) for r in often if r.before is not None]
    pairs = np.array(sorted(_HOT_SHARE * int(np.searchsorted(hot, w)) + int(np.searchsorted(hot, c)) for w, c in pairs), np.int64)
    hot, hot_pairs = spark.sparkContext.broadcast(hot), spark.sparkContext.broadcast(pairs)
    buckets = max(1, -(-tokens // BUCKET))
    heads = max(997, tokens >> 24)
    number = np.uint16 if buckets < 1 << 16 else np.uint32

    def pieces(batches):
        count, held_back, size = 0, [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                word, row, n = _tokens(part.column(1))
                held_back.append((word, row, n, part.column(0), part.column(2).to_numpy(zero_copy_only=False).astype(bool)))
                size += len(word)
                if size >= PIECE or sum(len(x[2]) for x in held_back) > 50_000:
                    yield from piece(held_back, count)
                    count, held_back, size = count + 1, [], 0
        if held_back:
            yield from piece(held_back, count)

    def piece(held_back, count):
        name = (TaskContext.get().partitionId() << 24) + count
        base = np.cumsum([0, *(len(x[2]) for x in held_back)])
        n = np.concatenate([x[2] for x in held_back])
        out_of = np.concatenate([x[4] for x in held_back])
        ids = pa.concat_arrays([x[3] for x in held_back])
        row = np.concatenate([x[1] + np.int32(b) for x, b in zip(held_back, base, strict=False)])
        word = np.concatenate([x[0] for x in held_back])
        held_back.clear()
        # slices have at most one text more than their limit allows, so rows stay below 2**16
        for lo in range(0, len(n), 1 << 16):
            yield from part_of_piece(word, row, n, out_of, ids, lo, min(len(n), lo + (1 << 16)), name + (lo << 4))

    def part_of_piece(word, row, n, out_of, ids, lo, hi, name):
        if lo or hi < len(n):
            inside = (row >= lo) & (row < hi)
            row, word = row[inside] - lo, word[inside]
        vocabulary, at = np.unique(word, return_inverse=True)
        del word
        at = at.astype(np.uint32)
        before = np.empty_like(at)
        before[1:], before[:1] = at[:-1], at[-1:]  # the last word is an end, as before every text
        to = ((vocabulary >> np.uint64(_WORD_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(number)[at]
        place = _places(hot.value, vocabulary)
        often = np.flatnonzero(place[at] >= 0)
        to[often] = mix(mix(vocabulary[before[often]]) ^ vocabulary[at[often]]) % np.uint64(buckets)
        # tokens of frequent pairs stay with their piece
        often = often[place[before[often]] >= 0]
        pair = _places(hot_pairs.value, _HOT_SHARE * place[at[often]] + place[before[often]])
        often, pair = often[pair >= 0], pair[pair >= 0]
        frequent_at, frequent_n = np.unique(pair.astype(np.uint32) << np.uint32(16) | row[often].astype(np.uint32), return_counts=True)
        rest = np.ones(len(at), bool)
        rest[often] = False
        del often, pair
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([-1 - name % heads], pa.int32()),
                pa.array([name], pa.int64()),
                pa.array([pa.record_batch([ids[lo:hi]], schema=id_schema).serialize().to_pybytes()], pa.binary()),
                pa.array([n[lo:hi].astype(np.int64).tobytes()], pa.binary()),
                pa.array([out_of[lo:hi].tobytes()], pa.binary()),
                pa.array([frequent_at.tobytes() + frequent_n.astype(np.uint32).tobytes()], pa.binary()),
                pa.array([b""], pa.binary()),
            ],
            names,
        )
        at, before, row, to = at[rest], before[rest], row[rest], to[rest]
        if not len(at):
            return
        key = _keys(at, before)
        del at, before
        order = np.argsort(key)
        order = order[np.argsort(to[order], kind="stable")]
        key, row, to = key[order], row[order], to[order]
        del order
        new = np.append(True, (key[1:] != key[:-1]) | (to[1:] != to[:-1]))
        at = np.flatnonzero(new)
        seen = np.diff(np.append(at, len(key))).astype(np.uint32)
        trained = np.add.reduceat((~out_of[lo:hi])[row].astype(np.uint32), at).astype(np.uint32)
        pair_to = to[at]
        edge = np.append(np.flatnonzero(np.append(True, pair_to[1:] != pair_to[:-1])), len(at))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            x, y = at[a], at[b] if b < len(at) else len(key)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(pair_to[a])], pa.int32()),
                    pa.array([name], pa.int64()),
                    pa.array([_pack(vocabulary[_word(key[at[a:b]])])], pa.binary()),
                    pa.array([_planes(seen[a:b])], pa.binary()),
                    pa.array([_planes(trained[a:b])], pa.binary()),
                    pa.array([row[x:y].astype(np.uint16).tobytes()], pa.binary()),
                    pa.array([_planes(vocabulary[_context(key[at[a:b]])])], pa.binary()),
                ],
                names,
            )

    names = ["bucket", "piece", "keys", "seen", "trained", "rows", "contexts"]
    merged_names = ["pairs", "times", "words", "before"]
    kinds = "piece long, keys binary, seen binary, trained binary, rows binary, contexts binary"

    def gather(table: pa.Table) -> pa.Table:
        """A bucket's training pairs, put together once for all sweeps, and its parts with places in them for words and contexts."""
        table, number = table.combine_chunks(), table["bucket"][0].as_py()
        columns, merged = [table[c].chunk(0) for c in names[1:]], [None] * 4
        if number >= 0:
            words, before, counts = (table[c].to_pylist() for c in ("keys", "contexts", "trained"))
            bucket, keys = _merged(words, before, counts, number, hot.value)
            merged = [_pack(bucket.keys), _planes(bucket.counts.astype(np.uint64)), _pack(bucket.names), _pack(bucket.contexts)]
            none = pa.nulls(len(keys), pa.binary())
            columns = [columns[0], pa.array([_pack(k) for k in keys], pa.binary()), columns[2], none, columns[4], none]
        parts = pa.StructArray.from_arrays(columns, names[1:])
        packed = pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts)
        rows = {"bucket": table["bucket"].slice(0, 1)} | {c: pa.array([x], pa.binary()) for c, x in zip(merged_names, merged, strict=True)}
        return pa.table(rows | {"parts": packed})

    sent = docs.mapInArrow(pieces, f"bucket int, {kinds}")
    struct = kinds.replace(" ", ":").replace(",:", ",")
    # dealt by bucket, so that no sweep shuffles it again; into more parts than buckets, so that few share one
    columns = ", ".join(f"{c} binary" for c in merged_names)
    gathered = sent.groupBy("bucket").applyInArrow(gather, f"bucket int, {columns}, parts array<struct<{struct}>>")
    sent = keep_bucketed(gathered, "lm-buckets", "bucket", min(4 * buckets, 50_000))
    del gathered
    release(spark)  # the shuffle files of the step above are not needed any more

    words = sent.where("bucket >= 0")
    heads = sent.where("bucket < 0").select(F.explode("parts").alias("p"))

    def pair_counts(batches):
        for batch in batches:
            sums = np.zeros(len(hot_pairs.value), np.int64)
            for data, out_of in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                pair, at, n = _frequent(data)
                np.add.at(sums, pair, np.where(np.frombuffer(out_of, bool)[at], 0, n))
            here = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(here.astype(np.int64)), pa.array(sums[here])], ["pair", "n"])

    # 1024 rows at most
    counted = heads.select("p.rows", "p.trained").mapInArrow(pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    trained_pairs = np.zeros(len(pairs), np.int64)
    trained_pairs[counted["pair"].to_numpy()] = counted["n"].to_numpy()
    states: list[dict] = []
    around: list[DataFrame] = []  # by sweep: bucket, tables and customers of its contexts in all buckets

    def seating(k: int, shared: dict | None) -> DataFrame:
        """What the buckets share after sweep k (0: a table for each pair); shared: the state before it."""

        def seat(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    number, *row = (c[r].as_py() for c in batch.columns)
                    bucket = _stored(row[:4], number, hot.value)
                    if k > 1:
                        bucket.restore(*row[5:7])
                    if k:
                        bucket.sweep(k - 1, shared, bucket.around(row[4], shared["near_tables"]))
                    yield bucket.share(buckets)

        rows = words.select("bucket", *merged_names)
        if k:
            rows = rows.join(around[k - 1].select("bucket", "tables"), "bucket")
        if k > 1:
            rows = rows.join(seated[k - 1], "bucket")
        return rows.mapInArrow(seat, "kind long, place long, value long, contexts binary, tables binary, counts binary")

    seated: dict[int, DataFrame] = {}  # by sweep: bucket and its seating
    for k in range(burn + samples + 1):
        done = keep(seating(k, states[-1] if states else None), f"lm-seating{k}")
        # fewer than 1024 rows for each of four kinds, and a few totals: a fixed size
        sums = done.where("kind > 0").groupBy("kind", "place").agg(F.sum("value").alias("value")).toArrow()
        states.append(_state(sums, hot.value, pairs, trained_pairs, states))
        added = done.where("kind = 0").groupBy("place").applyInArrow(_add_contexts, "bucket int, place long, tables binary, counts binary")
        added = added.groupBy("bucket").applyInArrow(_joined, "bucket int, tables binary, counts binary")
        around.append(keep(added, f"lm-contexts{k}"))
        if k:
            state = F.col("tables").alias("seats"), F.col("counts").alias("roots")
            seated[k] = keep(done.where("kind = -1").select(F.col("value").cast("int").alias("bucket"), *state), f"lm-seated{k}")
        drop(done)
        release(spark)

    first = states[0]
    facts = spark.sparkContext.broadcast(states)
    word = pairs // _HOT_SHARE
    pair_base = np.log10(first["hot_counts"][word] + 0.1)
    pair_score = np.log10(sum(_frequent_chance(pairs, trained_pairs, s, first["near_counts"]) for s in states[burn + 1 :]) / samples)
    pair_known = first["hot_counts"][word] > 0

    def scores(batches):
        shared = facts.value
        sums: dict[int, list[np.ndarray]] = {}

        def sent():
            for piece_, (base, score, known, seen) in sums.items():
                here = np.flatnonzero(seen)
                arrays = (here.astype(np.uint16), base[here], score[here].astype(np.float32), known[here].astype(np.uint32))
                columns = [pa.array([piece_], pa.int64())] + [pa.array([x.tobytes()], pa.binary()) for x in arrays]
                yield pa.RecordBatch.from_arrays(columns, ["piece", "rows", "base", "score", "known"])
            sums.clear()

        for batch in batches:
            for r in range(batch.num_rows):
                parts, number = batch.column(5)[r].as_py(), batch.column(0)[r].as_py()
                bucket = _stored([batch.column(k)[r].as_py() for k in range(1, 5)], number, hot.value)
                customers = bucket.around(batch.column(6)[r].as_py(), shared[0]["near_counts"])
                seatings = []
                for k in range(samples):
                    near, *seating = (batch.column(7 + 3 * k + i)[r].as_py() for i in range(3))
                    bucket.restore(*seating)
                    state = shared[burn + k + 1]
                    seatings.append((bucket.tables, bucket.customers, bucket.root, state, bucket.around(near, state["near_tables"])))
                totals = bucket.totals.astype(float)
                is_hot = bucket.hot >= 0
                totals[is_hot] = shared[0]["hot_counts"][bucket.hot[is_hot]]
                while parts:
                    part = parts.pop()
                    key = _unpack(part["keys"])
                    look = _look(bucket, key)
                    p = np.zeros(len(key))
                    for bucket.tables, bucket.customers, bucket.root, state, near in seatings:
                        p += _chance(bucket, look, state, near, customers)
                    p /= len(seatings)
                    count = np.where(look[1], totals[look[0]] if len(totals) else 0.0, 0.0)
                    # a frequent word may be known though this bucket has no training pair of it
                    count = np.where(look[5], shared[0]["hot_counts"][look[4]] if len(hot.value) else 0.0, count)
                    seen = _values(part["seen"], np.uint32)
                    rows = np.frombuffer(part["rows"], np.uint16)
                    size = int(rows.max()) + 1
                    values = (np.log10(count + 0.1), np.log10(p), count > 0, np.ones(len(key)))
                    held = sums.setdefault(part["piece"], [np.zeros(0)] * 4)
                    for i, v in enumerate(values):
                        new = np.bincount(rows, np.repeat(v, seen), max(size, len(held[i])))
                        new[: len(held[i])] += held[i]
                        held[i] = new
                if sum(x.nbytes for h in sums.values() for x in h) > HELD:
                    yield from sent()
            pa.default_memory_pool().release_unused()
        yield from sent()

    rows = words.select("bucket", *merged_names, "parts").join(around[0].select("bucket", "counts"), "bucket")
    for k in range(burn + 1, burn + samples + 1):
        rows = rows.join(around[k].select("bucket", F.col("tables").alias(f"near{k}")), "bucket")
        rows = rows.join(seated[k].toDF("bucket", f"seats{k}", f"roots{k}"), "bucket")
    partial = rows.mapInArrow(scores, "piece long, rows binary, base binary, score binary, known binary")
    heads = heads.select(
        F.col("p.piece").alias("piece"),
        F.lit(None).cast("binary").alias("rows"),
        F.col("p.keys").alias("base"),
        F.concat("p.seen", "p.trained").alias("score"),
        F.col("p.rows").alias("known"),
    )
    n_train, vocabulary = first["tokens"], first["vocabulary"]

    def add_up(table: pa.Table) -> pa.Table:
        parts = table.to_pylist()
        head = next(p for p in parts if p["rows"] is None)
        ids = pa.ipc.read_record_batch(pa.py_buffer(head["base"]), id_schema).column(0)
        m = len(ids)
        n = np.frombuffer(head["score"][: 8 * m], np.int64)
        out_of = np.frombuffer(head["score"][8 * m : 9 * m], bool)
        base, score, known = np.zeros(m), np.zeros(m), np.zeros(m, np.int64)
        for p in sorted((p for p in parts if p["rows"] is not None), key=lambda p: (p["rows"], p["base"])):
            at = np.frombuffer(p["rows"], np.uint16)
            base[at] += np.frombuffer(p["base"], np.float64)
            score[at] += np.frombuffer(p["score"], np.float32)
            known[at] += np.frombuffer(p["known"], np.uint32)
        pair, at, times = _frequent(head["known"])
        for sums, each in ((base, pair_base), (score, pair_score), (known, pair_known)):
            np.add.at(sums, at, times * each[pair])
        base -= n * np.log10(n_train + 0.1 * (vocabulary + 1))
        return pa.table(
            {
                "doc_id": ids,
                "held_out": pa.array(out_of),
                "n_tokens": pa.array(n),
                "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(m, n_train, np.int64)),
                "base_score": pa.array(base),
                "score": pa.array(score),
                "perplexity": pa.array(10 ** (-score / np.maximum(n, 1))),
            }
        )

    schema = T.StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    schema = T.StructType([T.StructField("doc_id", kind), *schema.fields])
    return partial.unionByName(heads).groupBy("piece").applyInArrow(add_up, schema)


def _frequent(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A piece's tokens of frequent pairs: pair, row and how often."""
    at, n = np.split(np.frombuffer(data, np.uint32), 2)
    return (at >> np.uint32(16)).astype(np.int64), (at & np.uint32(0xFFFF)).astype(np.int64), n.astype(np.int64)


def _frequent_parent(s: dict) -> np.ndarray:
    """The parent's probability of each frequent word."""
    return (np.maximum(s["hot_tables"] - s["d0"] * s["hot_root"], 0) + base_weight(s)) / (ROOT_STRENGTH + s["tables"])


def _frequent_chance(pairs: np.ndarray, counts: np.ndarray, s: dict, near_counts: np.ndarray) -> np.ndarray:
    """Predictive probability of each frequent pair."""
    word, context = pairs // _HOT_SHARE, pairs % _HOT_SHARE
    own = np.maximum(counts - s["d1"] * s["pair_tables"], 0)
    return (own + (STRENGTH + s["d1"] * s["near_tables"][context]) * _frequent_parent(s)[word]) / (STRENGTH + near_counts[context])


def _state(sums: pa.Table, hot: np.ndarray, pairs: np.ndarray, counts: np.ndarray, states: list[dict]) -> dict:
    """The totals after a sweep, and the frequent pairs' and words' seating, which has a fixed size and is sampled here."""
    kind, place, value = (sums[c].to_numpy() for c in ("kind", "place", "value"))

    def vector(k: int, size: int) -> np.ndarray:
        out = np.zeros(size)
        out[place[kind == k]] = value[kind == k]
        return out

    word, context = pairs // _HOT_SHARE, pairs % _HOT_SHARE
    own = np.minimum(counts, 1)
    if states:
        rng, last = np.random.default_rng([len(states), len(pairs), 1]), states[-1]
        p, d1 = _frequent_parent(last)[word], last["d1"]
        own = last["pair_tables"].astype(np.int64)
        strength = (STRENGTH + d1 * np.maximum(last["near_tables"][context] - own, 0)) * p
        if len(states) == 1:
            own = seats(own, np.minimum(counts, 1), counts, strength, d1 * p, d1, rng)
        own = moved(own, counts, strength, d1 * p, d1, rng)
    s = {"pair_tables": own.astype(float)}
    for name, k, at, more in (("hot_tables", 2, word, own), ("hot_counts", 3, word, counts), ("near_tables", 5, context, own), ("near_counts", 6, context, counts)):
        s[name] = vector(k, len(hot)) + np.bincount(at, more, len(hot))
    once, twice, root_once, root_twice, root, cold, tables, tokens = vector(4, 8)
    once, twice = once + (counts == 1).sum(), twice + (counts == 2).sum()
    tables, tokens = tables + own.sum(), tokens + counts.sum()
    known_hot = s["hot_counts"] > 0
    s["vocabulary"] = int(cold + known_hot.sum())
    s["tokens"] = int(tokens)
    s["tables"] = tables
    discount = lambda a, b: float(np.clip(a / (a + 2 * b) if a else 0.5, 0.1, 0.95))
    s["d1"] = states[0]["d1"] if states else discount(once, twice)
    s["d0"] = states[0]["d0"] if states else discount(root_once, root_twice)
    rng = np.random.default_rng([len(states), int(tables)])
    # the frequent words' tables in the root restaurant: seated here, there are fewer than 1024
    customers = s["hot_tables"].astype(np.int64)
    before = states[-1]["hot_tables"].astype(np.int64) if len(states) > 1 else np.minimum(customers, 1)
    own = states[-1]["hot_root"].astype(np.int64) if states else before
    each = np.full(len(hot), s["d0"] / (s["vocabulary"] + 1))
    weight = ROOT_STRENGTH / (s["vocabulary"] + 1) + each * np.maximum(root + own.sum() - own, 0)
    s["hot_root"] = (followed(own, before, customers, weight, each, s["d0"], rng) if states else own).astype(float)
    s["root"] = root + s["hot_root"].sum()
    return s


def _look(bucket: Bucket, keys: np.ndarray) -> tuple:
    """(word's place, whether it is trained here, pair's place, whether it is trained, frequent word's place, whether it is one, context)."""

    def find(sorted_, x):
        if not len(sorted_):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
        return at, sorted_[at] == x

    word = bucket.names[_word(keys)]
    return (*find(bucket.words, word), *find(bucket.keys, keys), *find(bucket.frequent, word), _context(keys))


def _chance(bucket: Bucket, look: tuple, s: dict, context_tables: np.ndarray, context_counts: np.ndarray) -> np.ndarray:
    """Predictive probability of each pair under the seating after a sweep; s and context_tables: what it left."""
    word_at, known, pair_at, trained, spot, often, context = look
    base = base_weight(s) / (ROOT_STRENGTH + s["tables"])
    parent = np.full(len(context), base)
    if len(bucket.words):
        parent = np.where(known, bucket.parent(s)[word_at], parent)
    if len(bucket.frequent):
        parent = np.where(often, _frequent_parent(s)[spot], parent)
    own = np.zeros(len(context))
    if len(bucket.keys):
        own = np.where(trained, np.maximum(bucket.counts - s["d1"] * bucket.tables, 0)[pair_at], 0)
    return (own + (STRENGTH + s["d1"] * context_tables[context]) * parent) / (STRENGTH + context_counts[context])
