"""The pipeline's stages on the smallest tables: columns, decisions, and every stage against its operator."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from test_llm_operators import brute_components

from folio.llm.decontaminate import spaced_seed_matches
from folio.llm.jaccard_join import jaccard_components
from folio.llm.quality import quality_scores

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before, docs
        if name != "sharding":
            assert docs.columns == columns
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    before, after = seen["quality"]
    good = quality_scores(before, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1")
    assert ids(after) == ids(good)
    before, after = seen["near_duplicates"]
    assert set(ids(after)) == {r.component_id for r in jaccard_components(before)[0].collect()}
    before, after = seen["decontamination"]
    found = {r.doc_id for r in spaced_seed_matches(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(ids(before)) - set(ids(after)) == found
    before, after = seen["mixing"]
    assert set(ids(after)) <= set(ids(before)) and max(ids(after).values()) <= 3
    before, after = seen["sharding"]
    assert ids(before) == ids(after) and {r.shard for r in after.collect()} == set(range(24))
    # what ends in the shards are whole documents
    assert after.columns == [*columns, "size", "text_crc32", "vslot", "shard", "slot"]
    assert Counter((r.doc_id, r.text, r.source) for r in after.collect()) == Counter((r.doc_id, r.text, r.source) for r in before.collect())


def test_stages_brute_force(spark, tmp_path):
    """Duplicates, test passages, mix and shards recounted by loops over each stage's rows."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before.collect(), docs.collect()
    before, after = seen["near_duplicates"]
    # one document of each group, the one of the smallest id
    assert sorted(r.doc_id for r in after) == sorted({c for _, _, c in brute_components([(r.doc_id, r.text) for r in before])})
    before, after = seen["decontamination"]
    words = lambda text: re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    runs = lambda ws, n: {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    long_runs, short_runs = set().union(*(runs(x, 13) for x in items)), set().union(*(runs(x, 3) for x in items))
    kept = {r.doc_id for r in after}
    for r in before:
        ws = words(r.text)
        if runs(ws, 13) & long_runs:
            assert r.doc_id not in kept
        elif not runs(ws, 3) & short_runs:
            assert r.doc_id in kept
    before, after = seen["mixing"]
    size = {r.doc_id: len(words(r.text)) for r in before}
    of, taken = defaultdict(int), defaultdict(int)
    for r in before:
        of[r.source] += size[r.doc_id]
    copies = Counter(r.doc_id for r in after)
    for r in {r.doc_id: r for r in after}.values():
        taken[r.source] += copies[r.doc_id] * size[r.doc_id]
    weights = dict(zip(sorted(of, key=lambda s: (s is None, s or "")), [5, 2, 1] * len(of)))
    goal, open_, left = {}, dict(weights), sum(of.values())
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        full = [s for s in share if share[s] > 3 * of[s]]
        goal |= {s: 3 * of[s] for s in full} if full else share
        left -= sum(3 * of[s] for s in full)
        open_ = {s: w for s, w in open_.items() if s in full} and {s: w for s, w in open_.items() if s not in full} if full else {}
    assert max(copies.values()) <= 3
    for s in of:  # whole documents come near a source's words: within one document
        assert abs(taken[s] - goal[s]) <= max(64, *(size[r.doc_id] for r in before if r.source == s))
    before, after = seen["sharding"]
    assert Counter((r.doc_id, r.text) for r in before) == Counter((r.doc_id, r.text) for r in after)
    places, where = defaultdict(list), defaultdict(set)
    for r in after:
        places[r.shard].append(r.slot)
        where[r.text].add(r.shard)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and all(len(x) == 1 for x in where.values())


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeats, columns whose names stages use inside, and no rows at all."""
    text = " ".join(f"word{k} of a sentence that reads well enough." for k in range(40))
    rows = [(None, text + " First.", "en", None, 1), (1, None, None, "s", None), (2, "", "en", "s", 0), (3, text, "en", "s", 1), (3, text, "en", "s", 1)]
    rows += [(4, "long words " * 60_000, "en", "s", 1), (5, text + " Also this.", "en", "t", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = "_id long, _hash long, _key long, y double, score double, shard int, slot int, size long, held_out string, taken long"
    odd = spark.createDataFrame([(*r, *([None] * 10)) for r in rows], f"{schema}, {extra}")
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        columns, ids = docs.columns, None
        for stage, apply in corpus_pipeline.STAGES:
            docs = apply(spark, docs, SF)
            docs.write.parquet(f"{tmp_path}/{name}-{stage}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{stage}")
            if stage != "sharding":
                assert docs.columns == columns
            if stage == "near_duplicates":
                ids = Counter(r.doc_id for r in docs.collect())
                # one of the near copies, whichever of them the classifier kept
                assert sum(ids[k] for k in (3, 5, None)) <= 1 and max(ids.values(), default=0) <= 1
        assert docs.count() == 0 if name == "none" else {r.doc_id for r in docs.collect()} <= set(ids)
