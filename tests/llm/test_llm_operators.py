"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and odd columns."""

import hashlib
import html as entities
import math
import os
import random
import re
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict
from difflib import SequenceMatcher
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.llm import bitmap, divergence, jaccard_join, license_scan, pitman_yor, quality, ranked_search
from folio.llm import components as components_
from folio.llm.chat_format import rotate_perspectives
from folio.llm.components import components
from folio.llm.decontaminate import best_stretch, decontaminate, spaced_seed_matches, words_of
from folio.llm.exact_dedup import exact_dedup
from folio.llm.html_extract import extract_main_text, main_text, page_lines, shared
from folio.llm.jaccard_join import apart, jaccard_components, one_of_each_group, plans, scheme_of
from folio.llm.mixing import mix_sources, mixed_documents, targets
from folio.llm.pitman_yor import score_texts
from folio.llm.quality import keep_good, quality_scores
from folio.llm.sharding import SlotMap, rebalance, shard_records
from folio.llm.url_filter import url_filter
from folio.llm.words import Words, mix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASH = (
    "score long, node long, size long, slot int, _row long, hash long, held_out string, predicted string, label string, "
    "_id long, _hash long, y double, _key long, _copies int, id string, mark string"
)
A_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORDS = "alder birch cedar elder hazel larch maple rowan sumac willow yew ash elm fir oak pine teak lime plum pear".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def edge_rows():
    near = prose(1, 300).split()
    changed = list(near)
    changed[150] = "changed"
    rows = [
        (1, "A b\tc", "en", "s1", 5),
        (2, "Ab c", "en", "s1", 4),
        (2, "Ab c", "en", "s1", 4),
        (3, None, None, None, None),
        (4, "", "en", "s2", 0),
        (5, " \n\t ", "en", None, 3),
        (None, "no id at all", "en", "s2", 3),
        (None, None, None, None, None),
        (6, "x" * 300_000, "en", "s3", 300_000),
        (7, prose(7, 30_000), "en", "s3", 1),
        (8, " ".join(near), "en", "s1", 1),
        (9, " ".join(changed), "en", "s1", 1),
        (10, "é ü 漢字 \U0001f600", "fr", "s2", 9),
    ]
    return rows


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


@pytest.fixture(scope="module")
def clashing(spark):
    return spark.createDataFrame([(*r, *([None] * 16)) for r in edge_rows()], f"{DOCS}, {CLASH}")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- exact dedup


def test_exact_dedup_brute_force(spark, edge):
    rows = edge_rows()
    got = exact_dedup(edge).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    want = Counter()
    for body, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        for _, _, doc_id in members:
            want[doc_id, keep, len(members), hashlib.sha256(body.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_long_common_prefixes(spark):
    head = "y" * 70_000
    rows = [(i, head + tail) for i, tail in enumerate(["a", "b", "a", "ab", "", "", "b" * 5000])]
    got = {r.doc_id: r.keep_id for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6}


# ---------------------------------------------------------------- chat format

TURNS = "conv_id long, turn long, role string, text string, begin long, mask string"


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 300, "cid", "late")]
    rows += [(2, 0, "system", "alone"), (None, 0, None, "x"), (3, None, "ann", "a"), (3, 0, "ann", "b"), (3, 0, "ann", "b")]
    got = rotate_perspectives(spark.createDataFrame([(*r, None, None) for r in rows], TURNS)).collect()
    whole = defaultdict(str)
    for r in sorted(got, key=lambda r: (str(r.conv_id), r.speaker, r.part)):
        assert r.begin == len(whole[r.conv_id, r.speaker])
        whole[r.conv_id, r.speaker] += r.text
    assert {k for k in whole} == {(1, "ann"), (1, "bob"), (1, "cid"), (None, "unknown"), (3, "ann")}
    assert whole[1, "ann"] == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
        "<|im_start|>assistant\nbye<|im_end|>\n<|im_start|>user name=cid\nlate<|im_end|>\n"
    )
    spoken = [whole[1, "ann"][m.start : m.end] for r in got if (r.conv_id, r.speaker) == (1, "ann") for m in r.mask]
    assert spoken == ["hi<|im_end|>\n", "bye<|im_end|>\n"]
    assert whole[3, "ann"].count("assistant") == 3
    assert rotate_perspectives(spark.createDataFrame([], TURNS)).count() == 0


def test_perspectives_brute_force(spark):
    """Against a loop: parts of three turns, a conversation with most turns, ties, repeats, nulls, and a very long text."""
    rng = random.Random(12)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), rng.choice([None, *range(240, 262), -3]), rng.choice(["ann", "bob", "system", None, "Zoë"]), rng.choice(["a", "", None, "é" * 3, "b c"])) for _ in range(150)]
    rows += [(7, 255, "ann", "word " * 50_000), (7, 256, "bob", "x"), (8, 1, "system", "only")] + [(9, n, "ann", str(n)) for n in range(250, 261)]
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "unknown", r[3] or ""))
        turns = [(r[2] or "unknown", r[3] or "") for r in turns]
        for speaker in {w for w, _ in turns} - {"system"}:
            text, spans = "", []
            for who, said in turns:
                text += "<|im_start|>" + ("assistant" if who == speaker else "system" if who == "system" else f"user name={who}") + "\n"
                spans += [(len(text), len(text) + len(said) + len("<|im_end|>\n"))] if who == speaker else []
                text += said + "<|im_end|>\n"
            want[conv, speaker] = text, spans, len(turns)
    df = spark.createDataFrame([(*r, None, None) for r in rows], TURNS)
    for part in (3, 256):
        text, spans, n = defaultdict(str), defaultdict(list), Counter()
        for r in sorted(rotate_perspectives(df, part=part).collect(), key=lambda r: (str(r.conv_id), r.speaker, r.part)):
            key = r.conv_id, r.speaker
            assert r.begin == len(text[key]) and r.n_turns <= part and r.part * part == n[key]
            text[key] += r.text
            spans[key] += [(m.start, m.end) for m in r.mask]
            n[key] += r.n_turns
        assert {k: (text[k], spans[k], n[k]) for k in text} == want
    # eleven turns numbered 250 to 260 are one row
    assert rotate_perspectives(df.where("conv_id = 9")).count() == 1


# ---------------------------------------------------------------- sharding


def test_sharding_brute_force(spark):
    """Bytes by slot and shard, counted again; one id with most rows, and loads near equal."""
    rng = random.Random(4)
    rows = [(5 if i % 3 == 0 else i, str(i) + "x" * rng.randrange(200), "en", None, 0) for i in range(20_000)]
    df = spark.createDataFrame(rows, DOCS)
    placed, slot_map = shard_records(df, shards=24)
    got, load, where = placed.collect(), Counter(), {r.vslot: r.shard for r in slot_map.read().collect()}
    by_slot = Counter()
    for r in got:
        assert where[r.vslot] == r.shard
        load[r.shard] += r["size"]
        by_slot[r.vslot] += r["size"]
    assert sum(load.values()) == sum(len(r[1]) + 8 for r in rows) and max(load.values()) - min(load.values()) <= 0.02 * max(load.values())
    assert {r.vslot: r.bytes for r in slot_map.read().collect() if r.bytes} == by_slot


def test_sharding_keeps_copies_together(spark):
    """Equal texts lie in one shard, but for one that is larger than a shard; loads stay near equal."""
    rng = random.Random(6)
    rows = [(i, f"own text {i} " + "y" * rng.randrange(100), "en", None, 0) for i in range(3000)]
    rows += [(3000 + i, f"copy {i % 40} " + "z" * 60, "en", None, 0) for i in range(1200)]
    rows += [(5000 + i, "hot " * 25, "en", None, 0) for i in range(3000)]
    rng.shuffle(rows)
    text_of = {r[0]: r[1] for r in rows}
    got = shard_records(spark.createDataFrame(rows, DOCS), shards=8)[0].collect()
    assert len(got) == len(rows) and all(r.text == text_of[r.doc_id] for r in got)  # all columns come along
    shards, load = defaultdict(set), Counter()
    for r in got:
        shards[text_of[r.doc_id]].add(r.shard)
        load[r.shard] += r["size"]
    assert {t for t, s in shards.items() if len(s) > 1} == {"hot " * 25}
    assert max(load.values()) - min(load.values()) <= 0.02 * max(load.values())
    for k in range(8):
        assert sorted(r["slot"] for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_sharding(spark, edge, clashing, empty):
    for df in (edge, clashing):
        rows, slot_map = shard_records(df, shards=4)
        got = rows.collect()
        assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8) for r in edge_rows())
        assert {r.text_crc32 for r in got} == {zlib.crc32((r[1] or "").encode()) for r in edge_rows()}
        for k in range(4):
            assert sorted(r["slot"] for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
        assert slot_map.versions == [0, 1] and slot_map.read(0).count() == slot_map.read().count() == 8192
    odd = spark.createDataFrame([(1, "a", "mine", "x")], "doc_id long, text string, Shard string, _rank string")
    assert [c for c in shard_records(odd)[0].columns] == ["doc_id", "text", "_rank", "size", "text_crc32", "vslot", "shard", "slot"]
    assert shard_records(empty)[0].count() == 0


def test_rebalance_is_even_and_edits_little():
    rng = random.Random(3)
    slots = [{"vslot": v, "shard": v % 24, "bytes": rng.randrange(1, 5000), "rows": 1} for v in range(4096)]
    old = {s["vslot"]: s["shard"] for s in slots}
    new = rebalance(slots, 24)
    load = Counter()
    for s in new:
        load[s["shard"]] += s["bytes"]
    mean = sum(load.values()) / 24
    assert max(load.values()) < 1.001 * mean and min(load.values()) > 0.999 * mean
    assert sum(old[s["vslot"]] != s["shard"] for s in new) < 0.2 * len(new)


# ---------------------------------------------------------------- decontamination


def test_decontamination(spark, edge, clashing, empty):
    item, short = prose(50, 40).split(), prose(51, 6)
    rng = random.Random(9)
    spoiled = [w if rng.random() > 0.15 else "spoiled" for w in item]
    docs = edge_rows() + [
        (100, f"{prose(52, 50)} {' '.join(item)} {prose(53, 20)}", "en", "s", 1),
        (101, f"{prose(54, 9)} {' '.join(spoiled).upper()}", "en", "s", 1),
        (102, f"So: {short}!", "en", "s", 1),
        (103, " ".join(item[:6]) + " " + prose(55, 60), "en", "s", 1),
        (104, prose(56, 400), "en", "s", 1),
        (105, " Too SHORT. ", "en", "s", 1),
        (106, "too short by far", "en", "s", 1),
    ]
    bench = spark.createDataFrame([(2, " ".join(item)), (1, " ".join(item)), (3, short), (4, None), (5, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in spaced_seed_matches(spark.createDataFrame(docs, DOCS), bench).collect()}
    assert set(got) == {(100, 1), (101, 1), (102, 3), (105, 5)}
    assert (got[100, 1].first_word, got[100, 1].last_word, got[100, 1].matched) == (50, 89, 40)
    kept = decontaminate(spark.createDataFrame([(*r, *([None] * 16)) for r in docs], f"{DOCS}, {CLASH}"), bench)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in docs) - Counter([100, 101, 102, 105])
    assert spaced_seed_matches(empty, bench).count() == spaced_seed_matches(edge, bench.limit(0)).count() == 0


def test_decontamination_counts_any_stretch(spark):
    """Equal words around a stretch that passes do not make it vanish."""
    item = prose(60, 60).split()
    other = lambda n: [f"other{k}" for k in range(n)]
    agree = [k for k in range(46) if k % 5 in (1, 3, 4)]
    tail = [item[13 + k] if k in agree else f"other{k}" for k in range(46)]
    docs = [
        (1, item[:13] + other(12) + item[25:38]),
        (2, item[:20] + other(18) + item[38:58]),
        (3, item[:13] + tail),
        (4, item[:12] + other(12) + item[24:36]),
    ]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    rows = spark.createDataFrame([(i, " ".join(x), None, None, None) for i, x in docs], DOCS)
    got = {r.doc_id: r for r in spaced_seed_matches(rows, bench).collect()}
    assert set(got) == {1, 2, 3}
    assert all(r.matched >= 13 and 10 * r.matched >= 7 * (r.last_word - r.first_word + 1) for r in got.values())


def test_decontamination_brute_force(spark):
    """Every diagonal of every pair: what is found passes there, and all that has a verbatim run of a mask's length is found."""
    rng = random.Random(21)
    items = [prose(700 + k, rng.choice([3, 6, 12, 30, 80])).split() for k in range(12)]
    docs = []
    for k in range(60):
        item = rng.choice(items)
        a = rng.randrange(len(item))
        piece = [w if rng.random() > 0.1 else "other" for w in item[a : a + rng.randrange(1, 60)]]
        docs.append((f"d{k}", prose(800 + k, rng.randrange(0, 40)).split() + piece + prose(900 + k, 5).split()))
    bench = spark.createDataFrame([(f"i{k}", " ".join(x)) for k, x in enumerate(items)], "item_id string, text string")
    rows = spark.createDataFrame([(i, " ".join(x), None, None, None) for i, x in docs], DOCS.replace("doc_id long", "doc_id string"))
    got = {(r.doc_id, r.item_id) for r in spaced_seed_matches(rows, bench).collect()}
    for i, doc in docs:
        for k, item in enumerate(items):
            need = min(13, math.ceil(0.7 * len(item)))
            stretches = [best_stretch(doc, item, line, need, 0.7) for line in range(-len(item), len(doc) + 1)] if len(item) >= 5 else []
            assert (i, f"i{k}") not in got or any(stretches)
            at = {tuple(item[p : p + 13]) for p in range(len(item) - 12)}
            if any(tuple(doc[p : p + 13]) in at for p in range(len(doc) - 12)):
                assert (i, f"i{k}") in got
    assert len(got) > 10


def test_best_stretch_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        n, line, need = rng.randrange(1, 30), rng.randrange(-4, 5), rng.randrange(1, 8)
        doc, item = [rng.choice("ab") for _ in range(n)], [rng.choice("ab") for _ in range(rng.randrange(1, 30))]
        on = {i + line: doc[i + line] == x for i, x in enumerate(item) if 0 <= i + line < n}
        want = []
        for a in on:
            for b in range(a, max(on) + 1):
                e = sum(on[k] for k in range(a, b + 1))
                if e >= need and 10 * e >= 7 * (b - a + 1):
                    want.append(10 * e - 7 * (b - a + 1))
        found = best_stretch(doc, item, line, need, 0.7)
        assert (found and found[0]) == (max(want) if want else None)
        if found:
            _, e, a, b = found
            assert on[a] and on[b] and e == sum(on[k] for k in range(a, b + 1)) >= need and found[0] == 10 * e - 7 * (b - a + 1)


# ---------------------------------------------------------------- Pitman-Yor


def test_pitman_yor(spark, edge, clashing, empty):
    rng = random.Random(2)
    docs = edge_rows() + [(i, " ".join(rng.choice(WORDS[:3]) if i % 2 else rng.choice(WORDS) for _ in range(60)), "en", "s", 1) for i in range(200, 400)]
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + [None]) for i, t, *_ in docs]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    got = score_texts(spark.createDataFrame([(*r, *([None] * 16)) for r in docs], f"{DOCS}, {CLASH}")).collect()
    want = Counter()
    for i, ws in tokens:
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        want[i, held(i), len(ws), sum(count[w] > 0 for w in ws), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    out = [r for r in got if r.held_out and (r.doc_id or 0) >= 200]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert all(r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in got)
    assert score_texts(empty).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("folio_")]


def chances(spark, train, words):
    """Chances that follow a text's beginning, of each word and of the end, from the scores of short texts.

    With x(v) the chance of v at the beginning and e(v) that of the end after v, texts of one word give x(v) e(v) = a(v), and
    texts of two give x(w) p(v|w) e(v) = b(w, v).  If the chances after every word w sum to one, then
    x(w) = a(w) + sum over v of b(w, v) x(v) / a(v), which has one solution; it must sum to one with the empty text's chance.
    """
    held = [k for k in range(100_000) if zlib.crc32(str(k).encode()) % 10 == 0]
    rest = [k for k in range(100_000) if zlib.crc32(str(k).encode()) % 10]
    probes = [""] + words + [f"{w} {v}" for w in words for v in words]
    rows = [(i, t, "", "", 0) for i, t in zip(rest, train, strict=False)] + [(i, t, "", "", 0) for i, t in zip(held, probes, strict=False)]
    found = {r.doc_id: 10**r.score for r in score_texts(spark.createDataFrame(rows, DOCS)).collect() if r.held_out}
    p = [found[i] for i, _ in zip(held, probes, strict=False)]
    n = len(words)
    a, b = np.array(p[1 : n + 1]), np.array(p[n + 1 :]).reshape(n, n)
    x = np.linalg.solve(np.eye(n) - b / a, a)
    return x, p[0]


def test_pitman_yor_predictions_sum_to_one(spark):
    x, end = chances(spark, ["a b", "a a b", "b c", "c", "a"] * 3, ["a", "b", "c", "zzz"])
    assert (x > 0).all() and x.sum() + end == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("share", [1024, 16, 2])
def test_pitman_yor_many_buckets(spark, monkeypatch, share):
    """Small buckets and pieces: frequent words are dealt by context, sums come from many places, chances still sum to one,
    whether every pair is frequent, some are or none is."""
    monkeypatch.setattr(pitman_yor, "_HOT_SHARE", share)
    monkeypatch.setattr(pitman_yor, "BUCKET", 40)
    monkeypatch.setattr(pitman_yor, "PIECE", 64)
    rng = random.Random(3)
    x, end = chances(spark, [" ".join(rng.choice("abcdef") for _ in range(8)) for _ in range(60)], [*"abcdef", "zzz"])
    assert (x > 0).all() and x.sum() + end == pytest.approx(1, abs=1e-5)
    rows = [(f"d{i}", " ".join(rng.choice(WORDS) for _ in range(20)), "", "", 0) for i in range(80)]
    df = spark.createDataFrame(rows, DOCS.replace("doc_id long", "doc_id string"))
    got = {r.doc_id: r for r in score_texts(df).collect()}
    count = Counter(w for i, t, *_ in rows if zlib.crc32(i.encode()) % 10 for w in [*t.split(), None])
    n, v = sum(count.values()), len(count)
    for i, t, *_ in rows:
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*t.split(), None])
        assert got[i].base_score == pytest.approx(base) and got[i].train_tokens == n and got[i].n_tokens == 21


def test_gibbs_moves_reach_the_posterior():
    """Tables of one dish after many moves, against the probabilities of all seatings (counted by their numbers of tables)."""
    c, weight, slope, discount, k = 5, 0.7, 0.3, 0.4, 60_000
    ways = [[1.0] + [0.0] * c]
    for n in range(c):
        ways.append([0.0] + [ways[n][t - 1] + (n - discount * t) * ways[n][t] for t in range(1, c + 1)])
    want = np.array([ways[c][t] * math.prod(weight + slope * j for j in range(t)) for t in range(1, c + 1)])
    rng = np.random.default_rng(1)
    tables = np.ones(k, np.int64)
    for _ in range(20):
        tables = pitman_yor.moved(tables, np.full(k, c), np.full(k, weight), np.full(k, slope), discount, rng)
    assert np.bincount(tables, minlength=c + 1)[1:] / k == pytest.approx(want / want.sum(), abs=0.01)
    # customers who come and go leave the law as it is
    for other in (2, 9, c):
        was, c_now = c if other == 2 else {9: 2, c: 9}[other], other
        tables = pitman_yor.followed(tables, np.full(k, was), np.full(k, c_now), np.full(k, weight), np.full(k, slope), discount, rng)
    assert np.bincount(tables, minlength=c + 1)[1:] / k == pytest.approx(want / want.sum(), abs=0.01)


@pytest.mark.parametrize("discount", [0.3, 0.8])
def test_gibbs_shares_reach_the_posterior(discount):
    """A dish of 2000 customers, a share of which moves at a time, beyond the recursion's table: mean and spread of its tables."""
    c, weight, slope, k = 2000, 3.0, 0.2 * discount, 4000
    log = np.full(c + 1, -np.inf)
    log[0] = 0
    t = np.arange(1, c + 1)
    for n in range(c):
        stay = np.where(n - discount * t > 0, log[1:] + np.log(np.maximum(n - discount * t, 1e-300)), -np.inf)
        log = np.append(-np.inf, np.logaddexp(log[:-1], stay))
    law = log[1:] + np.cumsum(np.log(weight + slope * (t - 1)))
    law = np.exp(law - law.max())
    law /= law.sum()
    mean = (law * t).sum()
    spread = math.sqrt((law * (t - mean) ** 2).sum())
    rng = np.random.default_rng(2)
    tables = np.full(k, 5)
    for _ in range(30):
        tables = pitman_yor.moved(tables, np.full(k, c), np.full(k, weight), np.full(k, slope), discount, rng)
    assert tables.mean() == pytest.approx(mean, rel=0.03) and tables.std() == pytest.approx(spread, rel=0.1)


@pytest.mark.parametrize("discount", [0.1, 0.5, 0.95])
def test_chance_of_sitting_alone(discount, monkeypatch):
    """The closed form against the recursion, where both are there."""
    exact = pitman_yor.Alone(discount)
    monkeypatch.setattr(pitman_yor, "EXACT", 1)
    form = pitman_yor.Alone(discount)
    for c in (200, 256):
        t = np.arange(1, c)
        assert form(np.full(c - 1, c), t) == pytest.approx(exact(np.full(c - 1, c), t), abs=0.006)


def test_pair_with_many_customers_stays_small():
    """A pair that occurs a hundred million times takes two numbers, and moves in a moment."""
    keys = np.array([0, 1], np.uint64)
    bucket = pitman_yor.Bucket(0, keys, np.array([10**8, 3]), np.zeros(0, np.uint64), np.array([7], np.uint64), np.array([7, 9], np.uint64))
    s = {"hot_tables": np.zeros(0), "hot_root": np.zeros(0), "d0": 0.5, "d1": 0.5, "tables": 2, "root": 1, "vocabulary": 1}
    for k in range(4):
        tables = int(bucket.tables.sum())
        bucket.sweep(k, s | {"tables": tables, "root": int(bucket.root.sum())}, np.bincount(bucket.context, bucket.tables, 2))
    assert 1 < bucket.tables[0] < 10**7 and sum(map(len, bucket.stored())) < 200


def test_pitman_yor_contexts_do_not_share(spark):
    """Two words with equal upper 14 bits of their mixed hash, which a table of 16 384 contexts would put together."""
    names = [f"x{k}" for k in range(1000)]
    places = mix(Words(pa.array([" ".join(names)])).hashes()) >> np.uint64(50)
    by = defaultdict(list)
    for name, place in zip(names, places.tolist(), strict=True):
        by[place].append(name)
    one, two = next(x for x in by.values() if len(x) > 1)[:2]
    held = [k for k in range(1000) if zlib.crc32(str(k).encode()) % 10 == 0]
    rest = [k for k in range(1000) if k not in set(held)]
    rows = [(k, f"{one} left" if k % 2 else f"{two} right", "", "", 0) for k in rest[:400]]
    rows += [(held[0], f"{one} left", "", "", 0), (held[1], f"{two} left", "", "", 0), (held[2], f"{two} right", "", "", 0)]
    got = {r.doc_id: r.score for r in score_texts(spark.createDataFrame(rows, DOCS)).collect() if r.held_out}
    assert got[held[0]] > got[held[1]] + 1 and got[held[2]] > got[held[1]] + 1


# ---------------------------------------------------------------- licenses


@pytest.mark.parametrize("few", [4096, 1])
def test_licenses(spark, empty, monkeypatch, few):
    """Whether the hashes of the templates' runs are a list in the plan or a table that is joined."""
    monkeypatch.setattr(license_scan, "FEW", few)
    apache = license_scan.TEMPLATES[0][1]
    docs = edge_rows() + [
        (20, f"Hello. {apache}. More.", "en", "s", 1),
        (21, "the MIT license; and an Apache\nLicense", "en", "s", 1),
        (22, "licensed under the fine Apache License, version 2.0", "en", "s", 1),
        (23, "Licensed under nothing", "en", "s", 1),
        (24, "All rights reserved", "en", "s", 1),
    ]
    rows, spans = license_scan.scan_licenses(spark.createDataFrame([(*r, *([None] * 16)) for r in docs], f"{DOCS}, {CLASH}"))
    got = rows.collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert (by[20].base_labels, by[20].labels, by[20].n_base, by[20].first_word) == ("apache", "apache", 1, 4)
    assert (by[21].base_labels, by[21].n_base, by[21].first_word, by[21].last_word) == ("apache,mit", 2, 1, 5)
    assert by[22].labels == "apache" and by[23].labels == "" and by[23].first_word is None
    assert (by[24].labels, by[24].base_labels, by[24].score) == ("reserved", "", 1.0)
    assert by[4].n_words == 0 and by[10].n_words == 4
    span = {s.doc_id: s for s in spans.collect()}
    assert (span[20].first_word, span[20].last_word, span[20].covered) == (1, 8, 1.0)
    assert license_scan.scan_licenses(empty)[0].count() == 0


# ---------------------------------------------------------------- quality


def test_quality(spark, edge, clashing, empty):
    rng = random.Random(4)
    docs, labels = edge_rows(), []
    for i in range(100, 400):
        good = i % 3 > 0
        words = [rng.choice(WORDS) for _ in range(40)]
        docs.append((i, " ".join(words if good else [w.upper() + "!!" for w in words]), "en", "s", 1))
        labels.append((i, int(good), None))
    labels += [(100, None, 1), (None, 1, 1), (999_999, 0, 0), (101, 1, 0)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(*r, *([None] * 16)) for r in docs], f"{DOCS}, {CLASH}")
    got = quality_scores(df, marks).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    out = [r for r in got if r.held_out and (r.doc_id or 0) >= 100]
    assert len(out) > 30 and sum(r.predicted == int(r.doc_id % 3 > 0) for r in out) / len(out) > 0.95
    again = {r.doc_id: r.score for r in quality_scores(df.repartition(3), marks).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in got if r.doc_id and r.doc_id >= 100)
    kept = keep_good(df, marks)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in got)
    assert {r.score for r in quality_scores(edge, marks.limit(0)).collect()} == {0.5}
    assert quality_scores(empty, marks).count() == 0


# ---------------------------------------------------------------- html

PAGES = "page_id long, url string, html string, text string, _host string"


def test_html(spark):
    chrome = "<nav><ul><li><a href=x>{0}</a><li>{1}</ul></nav><div class='ad box'>Buy {0}</div>"
    page = "<html><head><title>t</title><style>p{{}}</style></head><body>" + chrome + "<p>Cookie notice</p><article><h1>H &amp; {0}</h1><p>Shared line<p>Own <b>bold</b>\n {1}<br>next</article><script>var a='<p>no</p>'</script><footer>&copy; {0}</footer></body>"
    rows = [(i, f"http://h.example/en/{i}", page.format(f"a{i}", f"b{i}"), None, None) for i in range(4)]
    rows += [(10, "http://h.example/en/10", None, None, None), (11, None, "", None, None), (12, "http://other/x", "plain <b>text</b> &lt;1&gt;", None, None)]
    rows += [(13, "http://big.example/1", "<article><p>" + "word " * 60_000 + "</p></article>", None, None), (0, "http://h.example/en/0", rows[0][2], None, None)]
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in extract_main_text(spark.createDataFrame(rows, PAGES)).collect()]
    assert Counter((g[0], g[1]) for g in got) == Counter((r[0], r[1]) for r in rows)
    by = {g[0]: g for g in got}
    for i in range(4):
        assert by[i][2].endswith(f"H & a{i}\nShared line\nOwn bold b{i}\nnext") and "Buy" not in by[i][2]
    # a line outside of the article goes because the neighbour has it as well
    assert main_text(page_lines(rows[1][2]), page_lines(rows[2][2])) == "H & a1\nShared line\nOwn bold b1\nnext"
    assert by[10][2:] == by[11][2:] == ("", 0) and by[12][2] == "plain text <1>" and by[13][3] == 299_999
    assert extract_main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_html_alignment_decides_on_named_containers(spark):
    nav = "<nav>{0}</nav><div class='ad'>Buy {0}</div>"
    page = [page_lines(x) for x in (nav.format("a") + "<div class='book-related'>Only here <nav>x</nav> and on</div><p>Text a", nav.format("b") + "<p>Text b")]
    # the neighbour has an advert too, but nothing like the other container; chrome by its tag goes in any case
    assert main_text(*page) == "Only here\nand on\nText a"
    assert main_text(page[0], None) == "Text a"
    # a chrome word among others says nothing; at the end of a name it counts outside of articles
    kept = "<article><p class='share-price'>1</p><div class='header-text'>2</div><section id='related-work'>3</section><div class='site-header'>4</div></article>"
    assert main_text(page_lines(kept + "<div class='site-header'>no</div><div class='cookie-box'>no</div>"), None) == "1\n2\n3\n4"
    # a name or a form does not swallow the article inside
    for box in ("<div id='header-menu'>", "<form>", "<div class=promo><div class=nav>"):
        a, b = (page_lines(f"<nav>{x}</nav>{box}<p>Same<article><p>News {x}</article><p>After {x}</div></form>") for x in "cd")
        assert main_text(a, b) == "News c\nAfter c"
    # copies are not differenced against each other, first or last in their host
    rows = [(i, f"http://copy.example/{i}", "<p>Same<p>Own" if i < 3 else "<p>Same<p>Other", None, None) for i in range(6)]
    got = extract_main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert {r.page_id: r.text for r in got} == {i: "Own" if i < 3 else "Other" for i in range(6)}


def test_html_chrome_that_the_neighbour_lacks(spark):
    """Adverts, notices, forms and comments go whether or not a neighbour has them, inside articles as well."""
    body = "<div class='ad'>Buy now</div><div class='comments'>Reader says hi</div><article><h1>Head</h1>{}<p>Text {}</article>"
    inside = "<div class='newsletter'>Join</div><section id='cookie-banner'>Cookies</section><ol class='comment-list'><li>First!</ol><form>Send</form>"
    rows = [(1, "http://h.example/1", body.format(inside, "a")), (2, "http://h.example/2", "<article><h1>Head</h1><p>Text b</article>"), (3, "http://alone.example/1", body.format(inside, "c"))]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Head\nText a", 2: "Head\nText b", 3: "Head\nText c"}


def test_html_does_not_depend_on_partitions(spark):
    """Against a loop over each host's blocks, with few and many partitions, tiny blocks, one large host and string ids."""
    rng = random.Random(8)
    rows = []
    for i in range(90):
        host = "big.example" if i % 3 else f"h{i % 5}.example"
        body = "".join(f"<p>{rng.choice(['Menu', 'About', 'Terms', 'News'])}" for _ in range(4)) + (f"<p>Own {i}" if i % 7 else "")
        rows.append((f"p{i}", f"http://{host}/a/{i // 2}", body, None, None))
    schema = PAGES.replace("page_id long", "page_id string")
    df = spark.createDataFrame(rows, schema)
    plain = {r[0]: "\n".join(x.text for x in page_lines(r[2])) for r in rows}
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "4", "211"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append({r.page_id: r.text for r in extract_main_text(df.repartition(int(n) % 9 + 1), block=5).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] and len(found[0]) == 90
    # without blocks: a loop over each host
    whole = {r.page_id: r.text for r in extract_main_text(df).collect()}
    want = {}
    for host in {r[1].split("/")[2] for r in rows}:
        mine = sorted((r for r in rows if r[1].split("/")[2] == host), key=lambda r: (len(r[1]), r[1], r[0]))
        lines = [[x.key for x in page_lines(r[2])] for r in mine]
        for i, r in enumerate(mine):
            near = [k for k in range(i - 1, -1, -1) if lines[k] != lines[i]][:1] or [k for k in range(i + 1, len(mine)) if lines[k] != lines[i]][:1]
            want[r[0]] = main_text(page_lines(r[2]), page_lines(mine[near[0]][2]) if near else None)
    assert whole == want
    # the differencing is what changes the texts
    assert sum(whole[k] != plain[k] for k in whole) > 60


def test_common_subsequence_takes_linear_space():
    rng = random.Random(2)
    a = [str(rng.randrange(40)) for _ in range(700)]
    b = [str(rng.randrange(40)) for _ in range(600)]
    steps = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, steps[j + 1] = steps[j + 1], last + 1 if x == y else max(steps[j], steps[j + 1])
    on = shared(a, b)
    assert on.sum() == steps[-1]
    it = iter(b)
    assert all(x in it for x, keep in zip(a, on, strict=True) if keep)
    many = [f"l{i}" for i in range(30_000)]
    tracemalloc.start()
    shared(many, many[::2000] + many[1::2000] + ["x"])
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()


def test_common_subsequence_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        steps = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                steps[i + 1][j + 1] = steps[i][j] + 1 if x == y else max(steps[i][j + 1], steps[i + 1][j])
        on = shared(a, b)
        assert on.sum() == steps[-1][-1]
        it = iter(b)
        assert all(x in it for x, keep in zip(a, on, strict=True) if keep)


# ---------------------------------------------------------------- Jaccard join


def sets_of(rows):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    for doc_id, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        yield doc_id, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = list(sets_of(rows))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return Counter((doc_id, len(s), least.get(find(i), doc_id)) for i, (doc_id, s) in enumerate(sets))


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_join_brute_force(spark, empty, monkeypatch, small):
    """Also with blocks of two members, components by the plan for large ones, and bitmaps that are full."""
    if small:
        for module, name, value in ((jaccard_join, "RUN_BLOCK", 2), (components_, "LARGE", 1), (bitmap, "LEAST", 6), (bitmap, "MOST", 8)):
            monkeypatch.setattr(module, name, value)
    rng = random.Random(8)
    rows, passage = edge_rows(), prose(77, 60)
    for g in range(14):
        n = [3, 5, 7, 8, 9, 12, 20, 33, 60, 90, 150, 240, 400, 30][g]
        base = prose(1000 + g, n).split()
        for k in range(9):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + max(1, n // 30))):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([["edit" + str(rng.randrange(99))], [], [copy[at], "more"]])
            rows.append((1000 + 10 * g + k, " ".join(copy), "en", "s", 1))
    rows += [(3000 + k, f"{prose(3000 + k, 40)} {passage} {prose(4000 + k, 40)}", "en", "s", 1) for k in range(30)]
    df = spark.createDataFrame([(*r, *([None] * 16)) for r in rows], f"{DOCS}, {CLASH}")
    got, links = jaccard_components(df)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows)
    assert all(100 * r.common >= 80 * (r.size_a + r.size_b - r.common) for r in links.collect())
    assert jaccard_components(empty)[0].count() == 0
    kept = one_of_each_group(df)
    classes = {c for (_, n, c), _ in brute_components(rows).items() if n}
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect() if r.text and r.text.strip()} == classes | {None}


def test_pigeonhole_bound_covers_every_pair_of_sizes():
    schemes = [scheme_of(0)]
    for n in range(1, 700):
        own = plans(n, schemes)[0][0]
        for s in range(math.ceil(0.8 * n), n + 1):
            if apart(n, s) == 0:
                continue
            both = {(p.band, h) for p, h in plans(n, schemes)}, {(p.band, h) for p, h in plans(s, schemes)}
            shared_bands = {b for b, _ in both[0]} & {b for b, _ in both[1]}
            assert shared_bands, (n, s)
            assert any(all(h >= apart(n, s) for bb, h in x if bb == b) for b in shared_bands for x in [both[0] | both[1]]), (n, s, own)


def test_components_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- mixing


def test_targets():
    got = targets({"a": 100, "b": 100, "c": 100, None: 10})
    assert list(got) == ["a", "b", "c", None] or set(got) == {"a", "b", "c", None}
    assert abs(sum(got.values()) - 310) < 1e-9 and got[None] == 30.0
    assert got["a"] / got["b"] == pytest.approx(2.5) and got["b"] / got["c"] == pytest.approx(2)
    assert targets({"a": 0, "b": 5}) == {"a": 0.0, "b": 5.0} and targets({}) == {}


def test_mixing(spark, empty):
    rng = random.Random(6)
    docs = edge_rows() + [(i, prose(i, rng.randrange(1, 300)), "en", f"s{i % 5}", 1) for i in range(100, 500)]
    df = spark.createDataFrame([(*r, *([None] * 16)) for r in docs], f"{DOCS}, {CLASH}")
    rows, schedule = mix_sources(df)
    got = rows.collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], words(r[1])) for r in docs)
    sizes, taken, goal = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        goal[r.source] = r.target
        assert r.taken <= 3 * r["size"]
    assert goal == pytest.approx(targets(dict(sizes)))
    assert all(r.source_size == sizes[r.source] for r in got)
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 33, s
    # what was taken is what the schedule reads, counted again token by token
    read = {(x.doc_id, x.crc): x.h for x in df.select("doc_id", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("crc")).withColumn("h", F.xxhash64("doc_id", "crc", F.lit(17))).collect()}
    turns = defaultdict(Counter)
    for x in schedule.collect():
        turns[x.source][x.block] += 1
    for s in goal:
        length, at = min(64, -(-sizes[s] // 64)), 0
        mine = sorted((r for r in got if r.source == s and r["size"]), key=lambda r: ((read[r.doc_id, r.text_crc32] >> 40) % 4096, read[r.doc_id, r.text_crc32], r.doc_id or -1))
        for r in mine:
            assert r.taken == sum(turns[s][k // length] for k in range(at, at + r["size"]))
            at += r["size"]
    assert sum(taken.values()) <= 64 * schedule.count()
    again = Counter((r.doc_id, r["size"], r.taken) for r in mix_sources(df.repartition(7))[0].collect())
    assert again == Counter((r.doc_id, r["size"], r.taken) for r in got)
    mixed = mixed_documents(df)
    assert mixed.columns == df.columns and max(Counter(r.doc_id for r in mixed.collect() if r.doc_id and r.doc_id >= 100).values()) <= 3
    assert mix_sources(empty)[0].count() == 0 == mixed_documents(empty).count()


def test_mixing_small_sources(spark):
    """Sources of fewer words than a block come near their target too."""
    docs = [(i, "w " * n, "en", src, 1) for i, (n, src) in enumerate([(50, "a"), (70, "b"), (3, "c"), (400, "d"), (900, "e"), (9000, "f"), (1, "g"), (0, "h")])]
    taken, goal, size = Counter(), {}, {}
    for r in mix_sources(spark.createDataFrame(docs, DOCS))[0].collect():
        taken[r.source] += r.taken
        goal[r.source], size[r.source] = r.target, r.source_size
    for s in goal:
        assert abs(taken[s] - goal[s]) <= max(1, min(32, size[s] / 64)), (s, taken[s], goal[s])


def test_quality_brute_force(spark):
    """Vectors, pooling and network recomputed by plain loops; columns that the scores replace are found in any case."""
    rng = random.Random(21)
    texts = [" ".join(rng.choice(WORDS[:9]) + rng.choice(["", ".", "!!"]) for _ in range(rng.randrange(0, 40))) for _ in range(60)] + [None, "", "One", "AA aa AA"]
    rows = [(i, t, i % 3 > 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 1.0, "x") for i, t, _ in rows], "doc_id long, text string, Score double, Held_Out string").repartition(3)
    slots, width = 64, 8
    found = quality.fit_vectors(df.select("text"), slots=slots, width=width).table
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    code = lambda word: Words(pa.array([word])).hashes()
    want = np.zeros((slots, width))
    for t in texts:
        words = split(t)
        for i, word in enumerate(words):
            for d in (-2, -1, 1, 2):
                if 0 <= i + d < len(words):
                    want[quality.slot_of(code(word), slots)[0]] += np.roll(quality.index_vectors(code(words[i + d]), width)[0], d)
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(found, want, atol=1e-5)
    # pooling: the mean of a text's words' vectors, and a few ratios
    pooled = quality.Vectors(found).pool(pa.array(texts))
    for t, x in zip(texts, pooled):
        words = split(t)
        mean = sum((found[quality.slot_of(code(word), slots)[0]] for word in words), np.zeros(width)) / max(len(words), 1)
        assert np.allclose(x[:width], mean, atol=1e-5)
        lower = [w.translate(A_Z) for w in words]
        again = sum(a == b for a, b in zip(lower, lower[1:]))
        ratios_ = [len(set(lower)) / max(len(words), 1), again / max(len(words), 1), math.log1p(len(words)), math.log1p((t or "").count("\n")), len((t or "").encode()) / max(len(words), 1) / 16]
        assert np.allclose(x[-quality.EXTRA :], ratios_, atol=1e-5)
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, quality int")
    model = quality.QualityModel(df, labels, "quality", 1000, "doc_id", "text")
    table, (mean, scale, (w1, b1, w2, b2), temperature) = model.vectors.value, model.network.value
    got = {r.doc_id: r for r in quality_scores(df, labels).collect()}
    assert set(got[0].asDict()) == {"doc_id", "text", "held_out", "score", "predicted"}
    for (i, t, _), x in zip(rows, quality.Vectors(table).pool(pa.array(texts)).astype(float)):
        z = [min(max((x[k] - mean[k]) / scale[k], -8), 8) for k in range(len(x))]
        hidden = [max(sum(z[k] * w1[k][h] for k in range(len(z))) + b1[h], 0) for h in range(len(b1))]
        logit = sum(hidden[h] * w2[h][0] for h in range(len(hidden))) + b2[0]
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-logit / temperature)), abs=1e-6)
        assert got[i].predicted == (got[i].score >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


# ---------------------------------------------------------------- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_ranks(docs, items, top):
    held = [(i, Counter(TERM.findall((t or "").translate(A_Z)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in items:
        asked, found = Counter(TERM.findall((text or "").translate(A_Z))), []
        for i, c in held:
            m = 75 + (25 * sum(c.values()) * n) // length
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in asked.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        for rank, (score, null, i) in enumerate(sorted(found)[:top], 1):
            out[item, rank, None if null else i, -score] += 1
    return out


@pytest.mark.parametrize("limits", [{}, {"LEAF": 2, "TREE_DOCS": 7, "TREE_ITEMS": 3, "ITEMS": 4, "MERGES": 2}])
def test_ranked_search_brute_force(spark, monkeypatch, limits):
    """Many equal scores, copies, shared paths, repeated ids and items, nulls; with large and with tiny trees and blocks."""
    for name, value in limits.items():
        monkeypatch.setattr(ranked_search, name, value)
    rng = random.Random(12)
    words = WORDS[:12]
    docs = [(i % 70, " ".join(rng.choice(words[: 2 + i % 11]) for _ in range(rng.randrange(1, 30)))) for i in range(150)]
    docs += [(200 + i, "Alder BIRCH-cedar alder") for i in range(40)] + [(None, "alder birch"), (None, "alder birch"), (9, None), (8, ""), (7, "- ! -")]
    docs += [(6, "oak " * 50_000 + "É漢 yew"), (5, "É é 漢")]
    items = [(i, " ".join(rng.choice(words + ["É", "nowhere"]) for _ in range(rng.randrange(1, 9)))) for i in range(9)]
    items += [(3, "alder alder birch"), (3, "alder alder birch"), (None, "cedar"), (50, None), (51, ""), (52, "nowhere"), (53, "yew " * 2000)]
    frame = spark.createDataFrame([(*d, None, None) for d in docs], "doc_id long, text string, score long, number int").repartition(5)
    asked = spark.createDataFrame([(*i, None) for i in items], "item_id long, text string, rank int")
    got = ranked_search.ranked_search(frame, asked, top=6).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == brute_ranks(docs, items, 6)
    assert ranked_search.ranked_search(frame.limit(0), asked).count() == ranked_search.ranked_search(frame, asked.limit(0)).count() == 0


def test_ranked_search_bounds_spare_rows():
    """The tree's bounds leave most documents unscored, and the result is that of scoring all."""
    rng = np.random.default_rng(3)
    tf = np.zeros((3000, 60), np.int64)
    for i in range(3000):  # three languages of twenty terms each
        at = rng.integers(0, 20, 12) + 20 * (i % 3)
        np.add.at(tf[i], at, 1)
    rows, ranks = np.nonzero(tf)
    m = rng.integers(75, 200, 3000)
    tree = ranked_search.Tree(rows, ranks, tf[rows, ranks], m, 60)
    assert sorted(tree.order) == list(range(3000)) and (tree.tf == tf[tree.order]).all()
    at, weights = np.array([1, 3, 7, 11]), np.array([900, 1200, 800, 1500])
    best = ranked_search.Best(20)
    scored = ranked_search.descend(tree, at, weights, np.zeros(3000, bool), np.arange(3000), best)
    all_ = ranked_search.part_scores(weights, tf[:, at], m)
    want = sorted(zip(-all_, range(3000)))[:20]
    assert [(-s, i) for s, i in zip(best.scores, best.ids)] == want and scored <= 1500


# ---------------------------------------------------------------- URL filter

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def brute_rule(url, rules):
    rest = (url or "").split("://", 1)
    rest = rest[1] if len(rest) > 1 else ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = host.translate(A_Z)
    fits = [(r[0].count("."), len(r[1]), r[2] == "allow", r) for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return host, path, max(fits)[3] if fits else None


def test_url_rules_brute_force(spark):
    rng = random.Random(2)
    hosts = ["example.org", "a.EXAMPLE.org", "b.a.example.org", "notexample.org", "org", "x.com", "com", "é.com", "x.net", "", "org.", ".org", "x.org:80"]
    paths = ["", "/", "/es/", "/es", "/en/12", "/en/2", "/fr/1", "/de/", "/de", "?q=/es/", "#/es/", "/fr/x?y=/de/#z"]
    urls = [rng.choice(["http://", "https://", "x://y://", "//", ""]) + h + p for h in hosts for p in paths] + [None, "", "://", "no scheme.org/es/"]
    urls += ["http://" + "a." * 3000 + "org/es/" + "x" * 50_000, "http://x.org/\nes/", urls[0], urls[0]]
    rules = RULES + [("org", "/", "block"), ("a.example.org", "", "block")]
    df = spark.createDataFrame([(i, u, None, None) for i, u in enumerate(urls)], "page_id long, url string, Host string, _slot int")
    out = url_filter(df, rules)
    assert out.columns == ["page_id", "url", "_slot", "host", "path", "rule", "verdict", "score", "held_out"]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for got in (out.collect(), url_filter(df, table).collect()):
        assert sorted(r.page_id for r in got) == list(range(len(urls)))
        for r in got:
            host, path, rule = brute_rule(r.url, rules)
            assert (r.host, r.path, r.rule) == (host, path, rule and rule[0] + rule[1]), r.url
            assert r.verdict == (rule[2] if rule else "block" if r.score >= 0.5 else "allow")
    assert url_filter(df.limit(0), rules).count() == 0


def test_url_trees_on_hosts_they_never_saw(spark):
    """Labels by a list of words; hosts kept out of the fit are judged by their form alone."""
    rng = random.Random(1)
    good, bad = WORDS, "casino bets pills spam adult xxx poker".split()
    rows = []
    for k in range(120):
        host = f"www.{rng.choice(good)}{rng.choice(good)}.example.{rng.choice(['com', 'org', 'net'])}" if k % 4 else f"{rng.choice(bad)}-{rng.choice(good)}-{rng.randrange(1000)}.example.com"
        rows += [(f"http://{host}/en/{rng.randrange(10**5)}", int(not k % 4)) for _ in range(20)]
    df = spark.createDataFrame(rows, "url string, bad int")
    found = {r.url: r for r in url_filter(df, []).collect()}
    for held in (False, True):
        mine = [(u, b) for u, b in rows if found[u].held_out is held]
        assert len(mine) > 200 and np.mean([(found[u].score >= 0.5) == bool(b) for u, b in mine]) >= 0.95
    # the caller's labels: one kind only, none at all, nulls and ties
    labels = lambda x: spark.createDataFrame(x, "url string, label int")
    assert {r.verdict for r in url_filter(df, [], labels([(rows[0][0], 1), (rows[0][0], 0), (None, 0), (rows[1][0], None)])).collect()} <= {"block", "allow"}
    assert {r.verdict for r in url_filter(df, [], labels([])).collect()} == {"allow"}


# ---------------------------------------------------------------- source divergence


def brute_divergence(rows, min_df, top):
    found = [(r[0] or "", r[1] or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[2] or "").translate(A_Z)))) for r in rows]
    out = set()
    for lang in {r[0] for r in found}:
        mine = [(s, c) for x, s, c in found if x == lang]
        df = Counter(t for _, c in mine for t in c)
        kept = sorted(t for t in df if df[t] >= min_df)
        counts = defaultdict(Counter)
        for s, c in mine:
            counts[s].update({t: n for t, n in c.items() if df[t] >= min_df})
            counts[None].update({t: n for t, n in c.items() if df[t] >= min_df})
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in counts.items()}
        for s in set(counts) - {None}:
            pairs = [("pair", x, sum(abs(p[s][t] - p[x][t]) for t in kept)) for x in set(counts) - {None, s}]
            terms = [("term", t, p[s][t] - p[None][t]) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, limit in ((pairs, None), (terms, top)):
                for rank, (kind, item, value) in enumerate(sorted(part, key=lambda x: (-x[2], x[1].encode()))[:limit], 1):
                    out.add((lang, s, kind, item, value, rank))
    return out


@pytest.mark.parametrize("limits,parts", [({}, 1), ({"BLOCK": 3, "TILE": 2}, 1), ({"BLOCK": 5}, 3)])
def test_source_divergence_brute_force(spark, monkeypatch, limits, parts):
    """Nulls, ties, repeats, groups without terms, languages without kept terms; with blocks and tiles of a few."""
    for name, value in limits.items():
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(7)
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", "é", None, "alone"][: 5 + (i % 9 == 0)]), " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 20)))) for i in range(200)]
    rows += [("en", "none", None), ("en", "none", "12 34 !"), ("xx", "s1", "once"), ("xx", "s2", ""), ("yy", "s1", "alder " * 9), ("en", "s1", "Alder,ÉCLAIR-été " * 3)]
    rows += [("en", "s1", "alder Birch")] * 7 + [("fr", "s2", "oak " * 40_000)]
    schema = "lang string, source string, text string"
    df = spark.createDataFrame([(*r, None, None) for r in rows], f"{schema}, lang_no int, index int").repartition(3)
    got = divergence.source_divergence(df, min_df=5, top=4, parts=parts).collect()
    assert len(got) == len(set(got)) and {(r.lang, r.source, r["part"], r.item, r.value, r["rank"]) for r in got} == brute_divergence(rows, 5, 4)
    if parts == 1:
        assert divergence.source_divergence(df.limit(0)).count() == 0


def test_spaced_terms():
    texts = ["", None, "a", "  A b ", "1a2b3", "é-È !", " ", "ab  cd\n", "x" * 5]
    want = [" ".join(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(A_Z))) for t in texts]
    assert divergence.spaced(pa.array(texts)).to_pylist() == want
    assert divergence.spaced(pa.array(texts)[3:7]).to_pylist() == want[3:7]


def test_operators_without_the_library_on_workers(tmp_path):
    """The functions that workers run travel with the job: another folder, and no PYTHONPATH."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__
for name in ("op4_decontamination", "op7_quality", "op8_html_extract", "op9_jaccard_join", "op10_mixing"):
    print(name, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len([x for x in done.stdout.splitlines() if x.startswith("op")]) == 5
