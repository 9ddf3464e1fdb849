"""Operators against brute force, exact round trips and held-out accuracy."""

import gzip
import random
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import decontaminate, html_extract, minhash, packing, queries, toxicity, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def brute_components(texts, n, percent):
    sets, parent = {i: shingles(t, n) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def test_minhash_equals_brute_force(spark, texts):
    want, sizes = brute_components(texts, 3, 85)
    rows = queries.op6_minhash(spark, SF).collect()
    assert {r.doc_id: r.component_id for r in rows} == want and {r.doc_id: r.n_shingles for r in rows} == sizes


def test_minhash_families_beyond_the_centre(spark):
    """Copies of one text with ever more changes: links that don't touch a bucket's centre, in blocks of two."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    texts = {}
    for i in range(60):
        words = list(base)
        for _ in range(i % 12):
            words[rng.randrange(160)] = f"x{rng.randrange(40)}"
        texts[(i * 37) % 60] = " ".join(words)
    want, _ = brute_components(texts, 3, 85)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = minhash.near_duplicates(df, shingle=3, threshold=0.85, block_docs=2).collect()
    assert {r.doc_id: r.component_id for r in got} == want and 1 < len(set(want.values())) < 60


def test_match_probability():
    for threshold in (0.8, 0.85, 0.9):
        m = minhash.collections_for(threshold)
        assert minhash.match_probability(threshold, m) >= minhash.RECALL > minhash.match_probability(threshold, m - 1)


def test_packing_round_trip(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = queries.op9_packing(spark, SF).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == texts.keys()
    for doc, own in pieces.items():
        ids, at = [*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 1], 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(array("I", ids[at : at + r.length]).tobytes())
            at += r.length
        assert at == len(ids)
    assert 1 - sum(r.length for r in rows) / (2048 * len({r.sequence_id for r in rows})) < 0.03


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(seed):
    rng = random.Random(seed)
    histogram = {}
    for _ in range(rng.choice((3, 400, 30_000))):
        n = rng.randint(1, 2047) if seed % 2 else min(2047, int(rng.lognormvariate(6.5, 1)) + 1)
        histogram[n] = histogram.get(n, 0) + 1
    rules, n = packing.plan(histogram)
    used, seen = {}, {}
    for rest, lo, hi, start, length, sequence, offset in rules:
        for k in range(hi - lo):
            used.setdefault(sequence + k, []).append((offset, length))
            seen.setdefault((rest, lo + k), []).append((start, length))
    for pieces in [*used.values(), *seen.values()]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at <= 2048
    assert len(seen) == sum(histogram.values()) and all(sum(x for _, x in p) == k[0] for k, p in seen.items()) and n == len(used)


ODD = ["", "  ", "a  b\n\nc..d, e'll I'm ÀÉ ß İ 'x' 12ab <|endoftext|> <|startoftext|>x.\x1cq", "the fœtus’s naïve <|endoftext|>x œ. o'clock we'll ll've ½²ªº µ", "ΑΣ ΟΔΟΣ İx Ǆ", " a\u0085b c", "é x́", "日本語 text 한국어"]


def test_word_encoder_is_the_library(texts):
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), words=50)
    all_texts = [*ODD, *texts.values()]
    assert encoder(all_texts) == [array("I", encoder.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in all_texts]


def test_token_counts_are_the_librarys(spark, texts):
    from graphloom.llm import token_counts

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries.op3_token_counts(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    odd = [*ODD, "a " * 50 + "\n b \t\t c<|endoftext|> d" * 30, "x" * 500]
    assert token_counts.count_tokens(odd, public_tokenizers.path("byte_bpe_50k.json"), 64, 10) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in odd]


def test_sharding(spark, texts):
    rows = queries.op10_sharding(spark, SF).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    sums = [sum(r.size for r in rows if r.shard == s) for s in range(16)]
    assert max(sums) - min(sums) <= 2 * max(r.size for r in rows)


def test_decontaminate_equals_brute_force(spark, texts):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    items = {r.item_id: words(r.text or "") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {r.doc_id: r for r in queries.op2_decontaminate(spark, SF).collect()}
    spans = {r.doc_id: r for r in decontaminate.decontaminate(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    for doc, text in texts.items():
        own, hit, found = words(text), set(), set()
        for item, ws in items.items():
            n = min(10, len(ws))
            for k in range(len(ws) - n + 1 if n else 0):
                for at in range(len(own) - n + 1):
                    if own[at : at + n] == ws[k : k + n]:
                        hit |= set(range(at, at + n))
                        found.add(item)
        assert (got[doc].n_words, got[doc].n_hit, got[doc].n_items) == (len(own), len(hit), len(found))
        assert [w for s in spans[doc].spans for w in words(text[s.start : s.end])] == [own[k] for k in sorted(hit)]


def archive(compress):
    one = [warc.record_bytes("response", f"http://x/{k}", f"payload {k} ".encode() * 9, f"<urn:{k}>", compress=compress) for k in range(6)]
    return one, b"".join(one)


@pytest.mark.parametrize("compress", [False, True])
def test_salvage(compress):
    records, data = archive(compress)
    whole = warc.salvage(data)
    assert len(whole.records) == 6 and not whole.gaps
    at = len(records[0]) + len(records[1]) // 2
    broken = warc.salvage(data[:at] + b"\x00" * 7 + data[at + 7 :])
    assert [r.headers["warc-record-id"] for r in broken.records] == [f"<urn:{k}>" for k in (0, 2, 3, 4, 5)]
    assert [(g.start, g.end) for g in broken.gaps] == [(len(records[0]), len(records[0]) + len(records[1]))]
    cut = warc.salvage(data[: -len(records[5]) // 2])
    assert len(cut.records) == 5 and len(cut.gaps) == 1
    lost = warc.salvage(b"rubbish" + data)
    assert len(lost.records) == 6 and (lost.gaps[0].start, lost.gaps[0].end) == (0, 7)
    missing = warc.salvage(data[: len(records[0]) - 9] + b"".join(records[1:]))
    assert len(missing.records) == 5 and missing.gaps


def test_gzip_of_many_records_and_mixture():
    records, data = archive(False)
    assert len(warc.salvage(gzip.compress(data)).records) == 6
    assert len(warc.salvage(records[0] + gzip.compress(records[1]) + records[2]).records) == 3


def test_warc_round_trip(spark):
    import base64
    import hashlib

    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op4_warc(spark, SF).collect()
    first = {}
    for k in sorted(pages):
        first.setdefault(pages[k], k)
    assert len(rows) == len(pages)
    for r in rows:
        body = pages[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[body] == r.page_id else ("revisit", first[body]))


def test_html_on_held_out_pages():
    """Pages composed with another seed than the training pages: words of main text found, and words of others let in."""
    rng, model, right, said, wanted = random.Random(977), html_extract.train(), 0, 0, 0
    for _ in range(120):
        page = html_extract.synthetic_page(rng)
        main = " ".join(re.findall("\ue000([^<\ue000]*)", page)).replace("&amp;", "&").split()
        got = html_extract.extract_many([page.replace("\ue000", "")], model)[0].split()
        both = 0
        left = list(got)
        for w in main:
            if w in left:
                left.remove(w)
                both += 1
        right, said, wanted = right + both, said + len(got), wanted + len(main)
    assert right / said > 0.97 and right / wanted > 0.97


def test_html_of_tables(spark):
    import html

    rows = {r.page_id: r for r in queries.op8_html(spark, SF).collect()}
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = re.split(r"</?(?:h1|p)>", re.sub("<br>", " ", re.sub("</?b>", "", inside)))
        assert rows[p.page_id].text == "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
        assert rows[p.page_id].n_chars == len(rows[p.page_id].text)


def test_html_decoding_is_consistent():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = int(rng.integers(2, 9))
        parents = [-1, *(int(rng.integers(0, k)) for k in range(1, n))]
        raw = rng.normal(0, 3, n).tolist()
        kept = html_extract.decode(parents, raw)
        assert all(kept[parents[k]] for k in range(1, n) if kept[k])
        score = lambda labels: sum(-np.log1p(np.exp(-s if x else s)) for s, x in zip(raw, labels, strict=True))
        legal = [l for l in ([bool(b >> k & 1) for k in range(n)] for b in range(1 << n)) if l[0] and all(l[parents[k]] for k in range(1, n) if l[k])]
        assert score(kept) >= max(map(score, legal)) - 1e-9


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op5_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_counterfactual_penalty():
    """A group's name that goes with toxic sentences in the sample must not raise a neutral sentence's score."""
    terms = ("alphas", "betas", "gammas", "deltas")
    rng = random.Random(1)
    rows, pairs = [], []
    for k in range(400):
        toxic = k % 2
        words = {f"n{rng.randrange(50)}" for _ in range(8)} | ({"scum", "alphas"} if toxic and k % 4 == 1 else {"scum"} if toxic else set())
        rows.append((toxicity.text_features(words), toxic))
        for a, b in toxicity.counterfactuals(" ".join(sorted(words)), terms, k):
            pairs.append((toxicity.text_features(a), toxicity.text_features(b)))
    plain, fair = toxicity.fit_rows(rows, []), toxicity.fit_rows(rows, pairs)
    assert plain.score("n1 alphas n2") - plain.score("n1 betas n2") > 0.1
    assert abs(fair.score("n1 alphas n2") - fair.score("n1 betas n2")) < 0.05 and fair.score("n3 scum n4") > 0.7 and fair.score("n1 alphas n2") < 0.5


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op7_quality(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.kept == bool(labels[r.doc_id]) for r in rows) / len(rows) > 0.97


def test_quality_shrinks_sparse_sites(spark):
    from pyspark.sql import functions as F

    from graphloom.llm import quality

    model = quality.ShapeModel(np.zeros(17), np.ones(17), np.r_[1.0, np.zeros(33)], -4.0)  # by length alone
    good, bad = "word " * 200, "w"
    rows = [(i, good if i % 2 else bad, "even") for i in range(400)] + [(1000 + i, bad, "poor") for i in range(300)] + [(2000, bad, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("x"))
    got = {r.doc_id: r for r in quality.quality_scores(df, model).collect()}
    whole = sum(r.p_document for r in got.values()) / len(got)
    assert got[1000].host_posterior < got[2000].host_posterior < whole and got[1000].quality < got[0].quality


def test_pipeline_equals_plain_version(spark, texts):
    rows = corpus_pipeline.run(spark, SF).collect()
    model = queries._toxicity_model(spark, SF)
    left = {i: t for i, t in texts.items() if model.score(t) < 0.7}
    last = {t: i for i, t in sorted(left.items())}
    left = {i: t for t, i in last.items()}
    components, _ = brute_components(left, 5, 80)
    left = {i: t for i, t in left.items() if components[i] == i}
    matcher = decontaminate.Matcher([(str(r.item_id), (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    left = {i for i, t in left.items() if not matcher.scan(t.encode())[1]}
    assert {r.doc_id for r in rows} == left and [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "packing"]
