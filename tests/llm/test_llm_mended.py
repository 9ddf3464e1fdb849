"""Damaged pages, other vocabularies, large benchmarks, plans of joins with hot keys, and rows that the sieve passes."""

import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from graphloom.llm import common, decontaminate, exact_dedup, html_extract, minhash, packing, queries, toxicity

SF = "/root/testdata/sf0.001"
PART = "<p>Some main text here, with enough words to be seen as the main text of a page. It has sentences, and more of them.</p>"
BROKEN = {
    "inline": "<b>" * 60000, "unclosed": "<a " * 60000, "vectors": "<svg>" * 40000, "blocks": "<p>" * 60000, "mixed": "<b>" * 30000 + "<h1></h1>" * 10000, "quotes": "<a b='" * 30000,
    "ends": "<b>" * 25000 + "</i>" * 25000, "signs": "<" * 200000, "comments": "x<!-- --> " * 20000, "buttons": "<p><button>" + "<b>" * 25000 + "<h1></h1>" * 10000, "equals": "<a " + "= " * 100000 + ">",
}


@pytest.mark.parametrize("name", BROKEN)
def test_time_of_broken_pages_is_linear(name):
    def seconds(page):
        began = time.process_time()
        html_extract.parse(page)
        return time.process_time() - began

    page = BROKEN[name]
    assert seconds(page) < 6 * seconds(page[: len(page) // 2]) / 2 + 0.5


def test_stray_quotes_and_deep_pages():
    model = html_extract.train()
    pages = ['<article><p>Text before it, some words. <img alt=5"> And after it, more words.</p><p title="x > y">Another one, it is here.</p></article>', "<body>" + "<div>" * 5000 + PART * 3 + "</div>" * 5000 + "</body>"]
    stray, deep = html_extract.extract_many(pages, model)
    assert stray == "Text before it, some words. And after it, more words.\nAnother one, it is here."
    assert deep.count("Some main text") >= 2


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_packing_with_either_vocabulary(spark, name):
    from tokenizers import Tokenizer

    texts = ["Hello World, it's 42 o'clock", "", "Zwölf Boxkämpfer\n\njagen  Viktor", "日本語 text <|endoftext|> x", "a" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    for r in packing.pack(docs, capacity=64, grain=8, vocabulary=public_tokenizers.path(name)).collect():
        ids = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_batches_by_bytes():
    texts = ["x" * n for n in (10, 5000, 0, 20, 9000, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["a", "b"])
    cut = list(common.by_bytes(iter([batch, batch.slice(0, 0)]), 1, 1000))
    assert [x for b in cut for x in b.column(1).to_pylist()] == texts and len(cut) > 3
    assert all(b.num_rows == 1 or sum(len(x or "") for x in b.column(1).to_pylist()) <= 1000 for b in cut)


def test_segments_hold_all_windows():
    rng = random.Random(2)
    words = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(300)]
    text = " ".join(words).encode()
    for size in (1, 50, 200, 5000):
        parts = list(decontaminate.segments(text, 10, size))
        assert {w for p in parts for w in decontaminate.windows_of(p)} == set(decontaminate.windows_of(text)) and all(len(p.split()) >= 10 for p in parts)


def test_automaton_equals_table_of_windows():
    rng = random.Random(4)
    for size in (1, 2, 3, 10):
        items = [(str(k), " ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))).encode()) for k in range(12)]
        matcher = decontaminate.Matcher(items, size)
        for _ in range(60):
            words = [rng.choice("abcd") for _ in range(rng.randint(0, 60))]
            hit, found = set(), set()
            for item, text in items:
                for window in decontaminate.windows_of(text, size):
                    w = window.decode().split()
                    for at in range(len(words) - len(w) + 1):
                        if words[at : at + len(w)] == w:
                            hit |= set(range(at, at + len(w)))
                            found.add(item)
            n, ranges, ids = matcher.scan(" ".join(words).encode())
            assert (n, ids) == (len(words), found) and {p for a, b in ranges for p in range(a, b)} == hit


def test_memory_of_a_large_benchmark():
    import subprocess
    import sys

    code = """
import random, resource
from graphloom.llm.decontaminate import Matcher
rng = random.Random(3)
words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(60000)]
items = [(str(k), " ".join(rng.choices(words, k=110)).encode()) for k in range(12500)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
Matcher(items)
print(sum(len(t) for _, t in items), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    size, kb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert size > 8_000_000 and kb < 600_000


def test_joins_on_hot_keys_can_be_split(spark):
    """Each join that meets a text's rows by its digest is a merge join, the only kind whose large partitions are split."""
    docs = spark.createDataFrame([(k, "same text of five words" if k % 3 else f"own text number {k} here") for k in range(60)], "doc_id long, text string")
    for df in (exact_dedup.exact_dedup(docs), minhash.near_duplicates(docs), exact_dedup.drop_exact_duplicates(docs)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.split("== Initial Plan ==")[0].splitlines() if "Join" in line and ("sha" in line or "digest" in line)]
        assert joins and all("SortMergeJoin" in line for line in joins)


def test_exact_stage_shuffles_only_what_may_go(spark):
    docs = spark.createDataFrame([(k, f"text number {k // 2 if k < 20 else k} " * 50) for k in range(1000)], "doc_id long, text string")
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(1, 20, 2), *range(20, 1000)]
    assert "Union" in kept._jdf.queryExecution().executedPlan().toString()


def test_exact_stage_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", 7, "x"), (2, "a", 8, "y"), (3, None, 9, "z")], "doc_id long, text string, __len int, `__row.x` string").withColumn("__lost_id", F.lit(5))
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r["__len"], r["__row.x"]) for r in kept.collect()) == [(2, 8, "y"), (3, 9, "z")]


def test_repeated_ids_give_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "vile words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    sample, _, _ = toxicity.training_sample(docs, labels, "doc_id", "text", "toxic", 100, ("alpha", "beta"))
    assert len(sample) == 2


def test_score_is_the_sum_of_the_words_weights(spark):
    """Scores by a plain version: the weights of each distinct word's features, and the intercept."""
    import math
    import re

    model = queries._toxicity_model(spark, SF)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op5_toxicity(spark, SF).collect():
        names = {f"w {w}" for w in set(re.findall(r"[^\W_]+", texts[r.doc_id].lower()))}
        words = {n[2:] for n in names}
        total = model.intercept + sum(model.weights[zlib.crc32(x.encode()) % 2**20] for w in words for x in [f"w {w}", *(f"{n} {w[:n]}" for n in (4, 5) if len(w) > n)])
        want = 1 / (1 + math.exp(-max(-35, min(35, total))))
        assert abs(r.score - want) < 1e-5 and r.predicted == (r.score >= 0.7)


def test_sharding_of_each_row(spark):
    """Each row's shard and slot by a plain pass over the table in its order."""
    rows = [(k, "x" * (k * 37 % 101)) for k in range(200)] + [(None, None), (500, "é" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in queries.sharding.shard(docs, 16).collect()}
    sizes = [len((t or "").encode()) + 1 for _, t in rows]
    at, slots = 0, {}
    for (doc, _), size in zip(rows, sizes, strict=True):
        shard = min(15, (2 * at + size) * 16 // (2 * sum(sizes)))
        slot = slots.get(shard, 0)
        slots[shard] = slot + 1
        at += size
        assert (got[doc].size, got[doc].shard, got[doc].slot) == (size, shard, slot)


def test_quality_by_plain_sums(spark):
    """Posteriors of hosts and paths, and the quality, against a version in plain Python."""
    from graphloom.llm import quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = queries.training_labels(spark.read.parquet(f"{SF}/labels.parquet"))
    model = quality.train(docs, labels)
    got = quality.quality_scores(docs, model).collect()
    check_quality(got, {r.doc_id: (r.source, r.lang) for r in docs.collect()})


def check_quality(got, sites):
    def strength(groups):  # of (n, mean, prior mean)
        n, n2 = sum(g[0] for g in groups), sum(g[0] ** 2 for g in groups)
        noise = [max(prior * (1 - prior), 1e-4) for _, _, prior in groups]
        within = sum(g[0] * v for g, v in zip(groups, noise, strict=True)) / n
        spread = sum(m * (mean - prior) ** 2 for m, mean, prior in groups)
        return within / max((spread - len(groups) * within) / max(n - n2 / n, 1.0), within / 1e5)

    by_host, by_path = {}, {}
    for r in got:
        by_host.setdefault(sites[r.doc_id][0], []).append(r.p_document)
        by_path.setdefault(sites[r.doc_id], []).append(r.p_document)
    whole = sum(r.p_document for r in got) / len(got)
    k = strength([(len(p), sum(p) / len(p), whole) for p in by_host.values()])
    host = {h: (sum(p) + k * whole) / (len(p) + k) for h, p in by_host.items()}
    k = strength([(len(p), sum(p) / len(p), host[s[0]]) for s, p in by_path.items()])
    path = {s: (sum(p) + k * host[s[0]]) / (len(p) + k) for s, p in by_path.items()}
    odds = lambda p: np.log(max(p, 1e-9) / max(1 - p, 1e-9))
    for r in got:
        site = sites[r.doc_id]
        want = 1 / (1 + np.exp(-(odds(r.p_document) + odds(path[site]) - odds(whole))))
        assert abs(r.host_posterior - host[site[0]]) < 1e-6 and abs(r.path_posterior - path[site]) < 1e-6 and abs(r.quality - want) < 1e-6
