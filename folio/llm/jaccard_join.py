"""Exact n-gram Jaccard join by universe partitioning and the pigeonhole principle.

A document is the set of its distinct word shingles.  Two sets with a Jaccard similarity of
``num``/``den`` or more differ in at most H tokens, H depending on their sizes alone.  Sets are
dealt into size bands; in each band's scheme every token of the universe is hashed into one of m
segments.  Of m segments at least m - floor(H / (t + 1)) differ by t tokens or less, so two
similar sets share the hash of a whole segment (t = 0), or of a segment with at most one token
deleted from either side (t = 1, the one-deletion neighbourhood).

Cost-based allocation works twice.  Each band takes the t and m of least expected cost.  And of
the m segments each set indexes no more than the bound asks for: it leaves out those whose rarest
token is commonest in the corpus (a fixed-size count of all shingles tells), so passages that
thousands of documents share are hardly ever an index key.  What is left out is chosen by a total
order on segment content, which is the same on both sides, so no pair is lost: of two similar sets,
take the one with the lower cut; it keeps a segment that they share and so does the other.
Empty segments rank last and are indexed only when the bound cannot be met otherwise.

Documents with equal sets are one node.  Of sets that share an index key, sizes and parity sketches
are compared first.  A sketch has a bit for each of several parts of the universe, at least twice as
many as the set has tokens, and tells whether a part holds an odd number of them; no more bits differ
than tokens do, so a pair that is too far apart by its sketches is settled, and nearly all such pairs
are.  The others are compared exactly, on their whole sets.  Within a key's run the members are compared with
one pivot first, the member that shares most keys with others and so lies nearest the middle.  Then only
members that are still in different components are compared, since a link inside a component changes
nothing: at first each member of a smaller component with the nearest of every other component, and where that one
proves too far while others might not be, with all.  So rows are made of links, about one a member and
component, and no link between components is missed.  Large runs are dealt to tasks by pairs of blocks.

Shingles are 64-bit hashes of five whole words; sets are compared on them.

Defined results: null, blank and wordless texts have the empty set and are linked to nothing; a
text with fewer words than a shingle is one token made of all its words; repeated rows and
repeated ids are linked through their equal sets; null ids are never the smallest id of a
component unless it has no other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import bitmap as bits
from .components import components
from .scratch import drop, fresh, keep, release, tasks_for
from .words import Words, mix, shingles, slices

SIZE, NUM, DEN = 5, 80, 100
#: log2 of the counters for token commonness; growth of the bands; spare segments; price of a loose key.
SKETCH_BITS, BAND_GROWTH, SPARE, LOOSE = 18, 1.95, 1.25, 16
#: Bits of a parity sketch for each token, at least; members of a run that one group compares with as many others.
SKETCH, RUN_BLOCK = 2, 4096
#: Shingles of the corpus for each bucket of index keys.
BUCKET = 8 << 20
_ALONE = (0, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x428A2F98D728AE22, 0x7137449123EF65CD)


def token_sets(batch: pa.RecordBatch, column: int, size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words = Words(batch.column(column))
    h = words.hashes()
    whole = shingles(h, size)
    out = []
    for i in range(words.n):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            n = int(b - a)
            out.append(shingles(h[a:b], n) ^ np.uint64(0x9E3779B97F4A7C15 * n & (2**64 - 1)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(tokens ^ np.uint64(0xA0761D6478BD642F))) + np.uint64(len(tokens))
    return int(mix(np.array([total]))[0].view(np.int64))


def sketch_of(tokens: np.ndarray) -> bytes:
    """A bit for each part of the universe that holds an odd number of tokens; parts go by the low bits."""
    bits = max(64, 1 << (SKETCH * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64-bit words as the sketches of fewer parts: ``width`` words each."""
    while sketches.shape[-1] > width:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


def gaps(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many tokens the sets of two sketches differ at least, pair by pair."""
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(a), np.int64)
    for la, lb in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes[:, 0] == la) & (sizes[:, 1] == lb))
        for part in np.array_split(at, -(-len(at) * int(la + lb) // (8 << 20))):
            x = np.frombuffer(b"".join([a[i] for i in part]), np.uint64).reshape(len(part), -1)
            y = np.frombuffer(b"".join([b[i] for i in part]), np.uint64).reshape(len(part), -1)
            width = int(min(la, lb)) // 8
            out[part] = np.bitwise_count(folded(x, width) ^ folded(y, width)).sum(1, dtype=np.int64)
    return out


def apart(a: int, b: int, num: int = NUM, den: int = DEN) -> int:
    """Most tokens in which similar sets of sizes a and b can differ."""
    return (a + b) * (den - num) // (den + num)


@dataclass(frozen=True)
class Scheme:
    band: int
    low: int  # sizes low .. high - 1 are this band's own
    high: int
    segments: int
    t: int


def scheme_of(band: int, num: int = NUM, den: int = DEN) -> Scheme:
    low = 1
    for _ in range(band):
        low = max(low + 1, math.ceil(low * BAND_GROWTH))
    high = max(low + 1, math.ceil(low * BAND_GROWTH))
    most = apart(high - 1, (high - 1) * den // num, num, den)
    middle = math.sqrt(low * high)
    h = apart(int(middle), int(middle) * den // num, num, den)
    best = None
    for t in (0, 1):
        bound = most // (t + 1)
        m = 1 if bound == 0 else math.ceil((bound + 1) * SPARE) + (1 if t == 0 else 0)
        tokens = middle / m
        keys = (h // (t + 1) + 1) * (1 + t * tokens)
        cost = keys * (1 + LOOSE * 0.5 ** max(tokens - t, 0))
        if best is None or cost < best[0]:
            best = (cost, m, t)
    return Scheme(band, low, high, best[1], best[2])


def plans(n: int, schemes: list[Scheme], num: int = NUM, den: int = DEN) -> list[tuple[Scheme, int]]:
    """(scheme, H) under which a set of n tokens is indexed: its own band's, and the band's below
    if that holds sizes similar to n."""
    while schemes[-1].high <= n:
        schemes.append(scheme_of(len(schemes), num, den))
    k = next(i for i, s in enumerate(schemes) if n < s.high)
    out = [(schemes[k], apart(n, n * den // num, num, den))]
    if k and -(-n * num // den) < schemes[k].low:
        out.append((schemes[k - 1], apart(n, schemes[k].low - 1, num, den)))
    return out


def index_keys(tokens: np.ndarray, common: np.ndarray, schemes: list[Scheme], num: int = NUM, den: int = DEN) -> np.ndarray:
    """The index keys of one set. common: corpus count by the top bits of a token."""
    out = []
    rank = common[(tokens >> np.uint64(64 - (len(common).bit_length() - 1))).astype(np.int64)]
    for s, h in plans(len(tokens), schemes, num, den):
        if h == 0:
            continue  # only equal sets are similar
        value = mix(tokens + np.uint64(s.band * 0x9E3779B9 + 0x7F4A7C15))
        seg = (value >> np.uint64(32)).astype(np.int64) % s.segments
        order = np.argsort(seg, kind="stable")
        seg, value, count = seg[order], value[order], rank[order]
        at = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        name = mix((np.arange(s.segments) + (s.band << 40) + (s.t << 39)).astype(np.uint64))
        spare = s.segments - h // (s.t + 1) - 1
        empty = s.segments - len(at)
        if s.t == 0:
            keys = mix(np.add.reduceat(value, at) ^ name[seg[at]])
            cost = np.minimum.reduceat(count, at)
            if empty > spare:
                gone = np.setdiff1d(np.arange(s.segments), seg[at])
                out.append(mix(name[gone]))
                spare = empty
            leave = spare - empty
            if leave:
                keys = keys[np.lexsort((keys, cost))[: max(len(keys) - leave, 0)]]
            out.append(keys)
        else:
            out.append(_deletions(value, count, seg, at, name, spare, s.segments))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _deletions(value, count, seg, at, name, spare, segments) -> np.ndarray:
    """Keys of segments and of segments less one token; the costliest `spare` segments set the cut."""
    never = (np.inf, 0)
    variants: list[list[tuple[tuple[float, int], int]]] = []
    ends = np.append(at[1:], len(seg))
    present = {int(seg[a]): (a, b) for a, b in zip(at, ends, strict=True)}
    for j in range(segments):
        a, b = present.get(j, (0, 0))
        total = np.add.reduce(value[a:b]) if b > a else np.uint64(0)
        sums = np.append(total, total - value[a:b])
        keys = mix(sums ^ name[j])
        mine = []
        for i, key in enumerate(keys):
            rest = np.delete(count[a:b], i - 1) if i else count[a:b]
            mine.append(((float(rest.min()), int(key)) if len(rest) else never, int(key)))
        variants.append(mine)
    worst = sorted((max(c for c, _ in mine) for mine in variants), reverse=True)
    cut = worst[min(spare, len(worst) - 1)]
    return np.array(sorted({k for mine in variants for c, k in mine if c <= cut}), np.uint64)


def jaccard_components(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SIZE,
    num: int = NUM,
    den: int = DEN,
) -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows has doc_id, n_shingles, node, text_hash,
    root and component_id for every input row; links has
    the verified pairs of nodes (a, b, common, size_a, size_b) that hold the components together."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType
    arrow_kind = to_arrow_type(kind)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))

    def facts(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = token_sets(part, 1, size)
                n = np.array([len(s) for s in sets])
                for s in sets:
                    np.add.at(counts, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
                none = pa.nulls(len(n), pa.int32())
                marks = pa.array([sketch_of(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), nodes, none, marks, part.column(2)], names)
        heavy = np.flatnonzero(counts >= max(8, 4 * counts.mean()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(len(heavy), arrow_kind),
                pa.array(counts[heavy]),
                pa.nulls(len(heavy), pa.int64()),
                pa.array(heavy, pa.int32()),
                pa.nulls(len(heavy), pa.binary()),
                pa.nulls(len(heavy), pa.int64()),
            ],
            names,
        )

    names = ["doc_id", "n", "node", "slot", "marks", "text_hash"]
    schema = T.StructType.fromDDL("n long, node long, slot int, marks binary, text_hash long")
    found = keep(docs.mapInArrow(facts, T.StructType([T.StructField("doc_id", kind), *schema.fields])), "join-facts")
    rows = found.where("slot is null")
    # at most 2**SKETCH_BITS rows
    heavy = found.where("slot is not null").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    common = np.ones(1 << SKETCH_BITS, np.int64)
    common[heavy["slot"].to_numpy()] = heavy["n"].to_numpy()
    common = spark.sparkContext.broadcast(common)

    tokens = rows.agg(F.sum("n")).first()[0] or 0
    runs = _runs(docs, common, tokens, size, num, den)
    links = _links(docs, runs, rows.where("node is not null").select("node", "n", "marks"), size, num, den)
    drop(runs)
    release(spark)
    roots = components(links)
    rows = rows.join(roots, "node", "left").withColumn("_class", F.coalesce("root", "node"))
    rows = keep(rows.select("doc_id", "n", "node", "text_hash", "_class"), "join-rows")
    drop(found, *roots.folio_tables)
    heads = rows.where("_class is not null").groupBy("_class").agg(F.min("doc_id").alias("least"), F.count("*").alias("k"))
    heads = keep(heads.where("k > 1").drop("k"), "join-heads")
    out = rows.join(heads.hint("merge"), "_class", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "node",
        "text_hash",
        F.col("_class").alias("root"),
        F.coalesce("least", "doc_id").alias("component_id"),
    )
    return out, links


def _runs(docs: DataFrame, common, tokens: int, size: int, num: int, den: int) -> DataFrame:
    """(run, node, times): the nodes that share an index key; runs of the same nodes are one, ``times`` tells how often.

    Keys travel as packed arrays, a bucket of keys a row, each (key, node) once for each piece of input."""
    spark = docs.sparkSession
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET))

    def index(batches):
        schemes = [scheme_of(0, num, den)]
        keys, nodes, held = [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                for s in token_sets(part, 1, size):
                    if len(s) and len(k := index_keys(s, common.value, schemes, num, den)):
                        keys.append(k)
                        nodes.append(np.full(len(k), node_of(s), np.int64))
                        held += len(k)
                if held >= 1 << 20:
                    yield from packed(keys, nodes)
                    keys, nodes, held = [], [], 0
        if held:
            yield from packed(keys, nodes)

    def packed(keys, nodes):
        k, v = np.concatenate(keys), np.concatenate(nodes)
        order = np.lexsort((v, k, k % np.uint64(buckets)))
        k, v = k[order], v[order]
        new = np.append(True, (k[1:] != k[:-1]) | (v[1:] != v[:-1]))
        k, v = k[new], v[new]
        b = (k % np.uint64(buckets)).astype(np.int32)
        at = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(b[at[:-1]]),
                pa.array([k[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                pa.array([v[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary()),
            ],
            ["bucket", "keys", "nodes"],
        )

    def meet(table: pa.Table) -> pa.Table:
        k = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64)
        v = np.frombuffer(b"".join(table["nodes"].to_pylist()), np.int64)
        order = np.lexsort((v, k))
        k, v = k[order], v[order]
        new = np.append(True, (k[1:] != k[:-1]) | (v[1:] != v[:-1]))
        k, v = k[new], v[new]
        at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        n = np.diff(np.append(at, len(k)))
        at, n = at[n > 1], n[n > 1]
        if not len(at):
            return pa.table({c: pa.array([], pa.int64()) for c in ("run", "node", "times")})
        inside = np.repeat(at - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        v, first = v[inside], np.append(0, np.cumsum(n)[:-1])
        # a run is named by its nodes
        name = mix(np.add.reduceat(mix(v.view(np.uint64)), first) + n.astype(np.uint64)).view(np.int64)
        _, one, times = np.unique(name, return_index=True, return_counts=True)
        pick = np.concatenate([np.arange(first[j], first[j] + n[j]) for j in one])
        return pa.table({"run": np.repeat(name[one], n[one]), "node": v[pick], "times": np.repeat(times, n[one])})

    entries = docs.mapInArrow(index, "bucket int, keys binary, nodes binary")
    met = entries.groupBy("bucket").applyInArrow(meet, "run long, node long, times long")
    return keep(met.groupBy("run", "node").agg(F.sum("times").alias("times")), "join-runs")


def _links(docs: DataFrame, runs: DataFrame, marks: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Verified pairs of nodes, enough to connect whatever is similar."""
    spark = docs.sparkSession
    release(spark)  # of the keys' shuffle
    tasks = tasks_for(runs.count(), spark, 200_000)
    shared = keep(runs.groupBy("node").agg(F.sum("times").alias("shared")), "join-shared", tasks=tasks)
    marks = marks.groupBy("node").agg(F.first("n").alias("n"), F.first("marks").alias("marks"))
    marks = keep(marks.join(shared.select("node"), "node", "left_semi"), "join-marks", tasks=tasks)
    compare = _Comparison(docs, marks, size, num, den)
    pivots = runs.join(shared, "node").groupBy("run").agg(F.max(F.struct("shared", "node")).alias("p"))
    pivots = keep(pivots.select("run", F.col("p.node").alias("a")), "join-pivots", tasks=tasks)
    pairs = runs.join(pivots.hint("merge"), "run").where("node != a").select("a", F.col("node").alias("b")).distinct()
    pairs = keep(pairs, "join-pairs", tasks=tasks)
    links, failed = compare(pairs)
    drop(shared, pivots, pairs)
    release(spark)
    todo = runs
    for nearest in (True, False):
        roots = components(links)
        asked = keep(_apart(todo, roots, marks, nearest, num, den, tasks), "join-asked")
        drop(*roots.folio_tables)
        new = keep(asked.select("a", "b").distinct().join(failed, ["a", "b"], "left_anti"), "join-pairs", tasks=tasks)
        if not new.isEmpty():
            more, gone = compare(new)
            links, failed = links.unionByName(more), failed.unionByName(gone)
        drop(new)
        release(spark)
        # the runs in which a nearest member proved too far and others were left
        again = keep(asked.where("others").join(failed, ["a", "b"], "left_semi").select("run").distinct(), "join-again", tasks=tasks)
        drop(asked)
        if not nearest or again.isEmpty():
            break
        todo = keep(runs.join(again, "run", "left_semi"), "join-todo", tasks=tasks)
    compare.close()
    drop(marks)
    return links


def _apart(runs: DataFrame, roots: DataFrame, marks: DataFrame, nearest: bool, num: int, den: int, tasks: int) -> DataFrame:
    """(run, a, b, others), a < b: nodes of one run but different components that may be similar by their sizes and sketches.

    Members of a run's largest component meet the others alone.  The members are dealt to blocks and so are those
    others; a group holds a block of each, so its size is bounded.  nearest: of each other component's
    members in a group only the one nearest by its sketch; ``others`` tells whether there are more."""
    labelled = keep(runs.join(roots, "node", "left").select("run", "node", F.coalesce("root", "node").alias("root")), "join-labelled", tasks=tasks)
    parts = labelled.groupBy("run", "root").agg(F.count("*").alias("c"))
    facts = parts.groupBy("run").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("k"), F.count("*").alias("parts"))
    # runs of two have been compared by their pivot
    facts = facts.where("parts > 1 and k > 2").select(
        "run",
        F.col("m.root").alias("main"),
        F.ceil(F.col("k") / RUN_BLOCK).cast("int").alias("s"),
        F.ceil((F.col("k") - F.col("m.c")) / RUN_BLOCK).cast("int").alias("t"),
    )
    rows = labelled.join(keep(facts, "join-open", tasks=tasks).hint("merge"), "run").withColumn("away", F.col("root") != F.col("main"))
    place = F.xxhash64("node")
    entry = lambda s, t, role: F.struct(s.cast("int").alias("s"), t.cast("int").alias("t"), role.alias("role"))
    member = F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda t: entry(F.pmod(place, F.col("s")), t, F.lit(1)))
    other = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda s: entry(s, F.pmod(place, F.col("t")), F.lit(2)))
    one = F.array(entry(F.lit(0), F.lit(0), F.when(F.col("away"), 3).otherwise(1)))
    to = F.when((F.col("s") == 1) & (F.col("t") == 1), one).when(F.col("away"), F.concat(member, other)).otherwise(member)
    rows = rows.select("run", "node", "root", "away", F.explode(to).alias("to")).select("run", "node", "root", "away", "to.*")
    rows = rows.join(marks, "node").select("run", "s", "t", "node", "root", "away", "role", "n", "marks")

    def near(table: pa.Table) -> pa.Table:
        node, root, n, role = (table[c].to_numpy() for c in ("node", "root", "n", "role"))
        away, sketches = table["away"].to_numpy(), table["marks"].to_pylist()
        widths = np.array([len(x) for x in sketches]) // 8
        # members by the width of their sketches, each in order of size
        held = []
        for w in np.unique(widths[role & 1 > 0]):
            at = np.flatnonzero((widths == w) & (role & 1 > 0))
            at = at[np.argsort(n[at], kind="stable")]
            held.append((at, {int(w): np.frombuffer(b"".join([sketches[i] for i in at]), np.uint64).reshape(-1, w)}))
        a, b, rest = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for i in np.flatnonzero(role & 2):
            mine, its = np.frombuffer(sketches[i], np.uint64), int(widths[i])
            other, gap = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at, tables in held:
                lo, hi = np.searchsorted(n[at], [-(-n[i] * num // den), n[i] * den // num + 1])
                if lo == hi:
                    continue
                width = min(its, max(tables))
                if width not in tables:
                    tables[width] = folded(tables[max(tables)], width)
                # two members apart from the largest component meet twice: the lesser one asks
                good = (root[at[lo:hi]] != root[i]) & (~away[at[lo:hi]] | (node[at[lo:hi]] > node[i]))
                good = lo + np.flatnonzero(good)
                other.append(at[good])
                gap.append(np.bitwise_count(tables[width][good] ^ folded(mine, width)).sum(1, dtype=np.int64))
            other, gap = np.concatenate(other), np.concatenate(gap)
            fits = gap <= (n[other] + n[i]) * (den - num) // (den + num)
            other, gap = other[fits], gap[fits]
            several = np.zeros(len(other), bool)
            if nearest and len(other) > 1:
                other = other[np.lexsort((node[other], gap / (n[other] + n[i])))]
                _, first, count = np.unique(root[other], return_index=True, return_counts=True)
                other, several = other[first], count > 1
            rest.append(several)
            a.append(np.minimum(node[other], node[i]))
            b.append(np.maximum(node[other], node[i]))
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"run": np.full(len(a), table["run"][0].as_py(), np.int64), "a": a, "b": b, "others": np.concatenate(rest)})

    return rows.groupBy("run", "s", "t").applyInArrow(near, "run long, a long, b long, others boolean")


class _Comparison:
    """Compares pairs of nodes: the sketches settle most that are not similar, whole sets the rest."""

    def __init__(self, docs: DataFrame, marks: DataFrame, size: int, num: int, den: int):
        self.docs, self.marks, self.size, self.num, self.den = docs, marks, size, num, den
        self.sets: list[DataFrame] = []
        self.nears: list[DataFrame] = []

    def __call__(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(similar pairs with their overlap and sizes, the other pairs, a < b)."""
        tasks = tasks_for(pairs.count(), pairs.sparkSession)
        near = keep(self._near(pairs, tasks), "join-near", tasks=tasks)
        self.nears.append(near)
        close = near.where("near").select("a", "b")
        # a pair comes with both its sets, so fewer of them make a task
        tested = keep(self._verify(close), "join-tested", tasks=tasks_for(close.count(), pairs.sparkSession, 2_000))
        failed = near.where("not near").select("a", "b").unionByName(tested.where("not similar").select("a", "b"))
        return tested.where("similar").drop("similar"), failed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def close(self) -> None:
        drop(*self.sets, *self.nears)

    def _near(self, pairs: DataFrame, tasks: int) -> DataFrame:
        num, den = self.num, self.den
        # later rounds have few pairs, and need little of the table
        marks = self._needed(self.marks, pairs) if self.sets else self.marks
        side = lambda k: marks.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("marks").alias(f"m{k}"))
        # rows of one pivot lie together, so its sketch compresses on the way to the other side
        both = pairs.join(side("a"), "a").coalesce(tasks).join(side("b"), "b")

        def judge(batches):
            for batch in batches:
                a, b, na, nb = (batch.column(k).to_numpy() for k in range(4))
                fits = np.minimum(na, nb) * den >= np.maximum(na, nb) * num
                at = pa.array(np.flatnonzero(fits))
                gap = gaps(batch.column(4).take(at).to_pylist(), batch.column(5).take(at).to_pylist())
                fits[fits] = gap <= ((na + nb) * (den - num) // (den + num))[fits]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(fits)], ["a", "b", "near"])

        return both.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(judge, "a long, b long, near boolean")

    def _fetch(self, nodes: DataFrame) -> DataFrame:
        """(node, tokens): the sets of these nodes and of a few others, read from the documents again."""
        size = self.size
        live = self.docs.sparkSession.sparkContext.broadcast(bits.build(nodes, "node"))

        def live_sets(batches):
            for batch in batches:
                for part in slices(batch, "text"):
                    sets = [s for s in token_sets(part, 1, size) if len(s)]
                    names = np.array([node_of(s) for s in sets], np.int64)
                    hit = np.flatnonzero(bits.has(live.value, names.view(np.uint64)))
                    tokens = pa.array([sets[i].tobytes() for i in hit], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(names[hit]), tokens], ["node", "tokens"])

        found = self.docs.mapInArrow(live_sets, "node long, tokens binary")
        return keep(found.groupBy("node").agg(F.first("tokens").alias("tokens")), "join-sets")

    def _needed(self, table: DataFrame, pairs: DataFrame) -> DataFrame:
        nodes = keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "join-nodes")
        self.nears.append(nodes)
        return table.join(nodes, "node", "left_semi")

    def _all_sets(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.sets)

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """Pairs with their exact overlap; similar: den * common >= num * all."""
        num, den = self.num, self.den
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
        first = not self.sets
        if first:
            self.sets.append(self._fetch(nodes))
        else:
            missing = keep(nodes.join(self._all_sets().select("node"), "node", "left_anti").distinct(), "join-missing", tasks=6)
            if not missing.isEmpty():
                self.sets.append(keep(self._fetch(missing).join(self._all_sets().select("node"), "node", "left_anti"), "join-sets"))
            drop(missing)
        sets = self._all_sets() if first else self._needed(self._all_sets(), pairs)
        side = lambda k: sets.select(F.col("node").alias(k), F.col("tokens").alias(f"t{k}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
        names = ["a", "b", "common", "size_a", "size_b", "similar"]

        def compare(batches):
            for batch in batches:
                out = []
                for a, b, ta, tb in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    x, y = np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64)
                    n = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                    out.append((a, b, n, len(x), len(y), den * n >= num * (len(x) + len(y) - n)))
                columns, kinds = list(zip(*out)) or [[]] * 6, [pa.int64()] * 5 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        return both.mapInArrow(compare, "a long, b long, common long, size_a long, size_b long, similar boolean")


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of every component: the one of the smallest id.

    Texts without words are linked with nothing and all stay; where an id repeats with an equal text, one row does.
    """
    rows, _ = jaccard_components(docs, doc_id, text, **options)
    # of a component the smallest id, then, where ids repeat, the smallest set and text
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"), F.col("text_hash"))
    first = rows.where("root is not null").groupBy("root").agg(F.min(order).alias("o"))
    stay = first.select(F.col("o.doc_id").alias("id"), F.col("o.text_hash").alias("hash"), F.lit(True).alias("linked"))
    stay = stay.unionByName(rows.where("root is null").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.lit(False).alias("linked")))
    stay = keep(stay.distinct(), "join-stay")
    # rows that go, and rows that are there more than once, are told by a bitmap of their keys: it passes all of them and
    # few others, and only what it passes is shuffled and decided by a join
    counts = rows.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.count("*").alias("k"))
    good = F.col("c.id").eqNullSafe(F.col("s.id")) & F.col("c.hash").eqNullSafe(F.col("s.hash"))
    gone = counts.alias("c").join(stay.alias("s"), good, "left_anti").unionByName(counts.where("k > 1"))
    wanted = bits.build(gone.select(F.xxhash64("id", "hash").alias("key")), "key")
    wanted = docs.sparkSession.sparkContext.broadcast(wanted)
    names = docs.columns
    id_, hash_, linked, key_, row_ = fresh(names, "id", "hash", "linked", "key", "row")
    key = F.xxhash64(F.col(doc_id), F.xxhash64(text))
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], key.alias(key_))

    def passing(doubtful: bool):
        def run(batches):
            for batch in batches:
                hit = bits.has(wanted.value, batch.column(len(names)).to_numpy().view(np.uint64))
                yield batch.filter(pa.array(hit == doubtful)).select(names)

        return run

    sure = keyed.mapInArrow(passing(False), docs.schema)
    doubtful = keyed.mapInArrow(passing(True), docs.schema)
    stay = stay.toDF(id_, hash_, linked)
    same = F.col(doc_id).eqNullSafe(F.col(id_)) & F.xxhash64(text).eqNullSafe(F.col(hash_))
    doubtful = doubtful.join(stay, same)
    # a component keeps one row of its id and text; rows without words are linked with nothing, not with each other either
    one = F.when(F.col(linked), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    doubtful = doubtful.withColumn(row_, one).dropDuplicates([doc_id, text, row_])
    return sure.unionByName(doubtful.select(*[F.col(f"`{c}`") for c in names]))
