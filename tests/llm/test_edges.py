"""Every operator on nulls, empty and long texts, repeated rows, ties, empty tables and clashing column names."""

import hashlib

import pytest

from graphloom.llm import decontaminate, exact_dedup, html_extract, minhash, packing, quality, sharding, token_counts, toxicity, warc
from graphloom.llm.linear import fit

LONG = "w%d " * 3000 % tuple(range(3000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_sha256 string, rep long, n int, kept string, score string, size int, part int, digest string, item_ids string, `__id` long"
ROWS = [
    (1, "same text here", "en", "a", 1), (2, "same text here", "en", "a", 1), (2, "same text here", "en", "a", 1), (3, None, None, None, None), (4, "", "en", None, 0),
    (5, LONG, "en", "b", 9), (None, "no id at all", "en", "b", 3), (6, "   \n\t ", "xx", "b", 5), (7, LONG + "one more word", "en", "b", 9), (None, None, None, None, None),
]
MARKUP = "<html><body><nav><a href='/x'>menu</a></nav><article><h1>Title</h1><p>Some main text, with enough words to be seen as such.</p></article></body></html>"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 0, 0, "x", "x", 0, 0, "x", "x", 99) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "Same TEXT, here"), (2, None), (None, "no id at all"), (3, ""), (4, "w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17")], "item_id long, text string")


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/\r\nb", MARKUP), (2, None, MARKUP), (2, None, MARKUP), (3, "http://c", None), (None, "http://d", ""), (4, "http://e", "plain & text <p"), (5, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n")]
    return spark.createDataFrame([(*r, "x", 1, "x") for r in rows], "page_id long, url string, html string, text string, payload_bytes long, `__html` string")


def by_id(rows, key="doc_id"):
    return {r[key]: r for r in rows}


def test_exact_dedup(docs, none):
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == len(ROWS)
    got = by_id(rows)
    assert (got[1].keep_id, got[1].group_size, got[1].kept) == (2, 3, False)
    assert sum(r.kept for r in rows if r.doc_id == 2) == 2
    assert (got[3].keep_id, got[3].group_size) == (4, 3) and got[4].kept
    assert got[3].text_sha256 == hashlib.sha256(b"").hexdigest() and not next(r for r in rows if r.doc_id is None and r.group_size == 3).kept
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["2", "2", "4", "5", "None", "6", "7"])
    assert exact_dedup.drop_exact_duplicates(none).count() == 0


def test_decontaminate(docs, none, items):
    got = by_id(decontaminate.decontaminate(docs, items).collect())
    assert (got[1].n_words, got[1].n_hit, got[1].item_ids) == (3, 3, ["1"]) and got[1].spans[0].asDict() == {"start": 0, "end": 14}
    assert got[5].item_ids == ["4"] and got[5].n_hit == 11 and (got[3].n_words, got[4].n_words) == (0, 0)
    blocks = by_id(decontaminate.decontaminate(docs, items, max_block_bytes=4).collect())
    for k in (1, 3, 4, 5, 6, 7):
        assert blocks[k] == got[k]
    assert decontaminate.decontaminate(docs, items, max_block_bytes=4).count() == len(ROWS)
    assert decontaminate.decontaminate(none, items).count() == 0 and decontaminate.decontaminate(docs, items.limit(0)).filter("n_hit > 0").count() == 0
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(["3", "4", "6", "None"])
    nameless = [r for r in decontaminate.decontaminate(docs, items).collect() if r.doc_id is None and r.n_words]
    assert [(r.n_words, r.n_hit, r.item_ids) for r in nameless] == [(4, 4, [])]


def test_decontaminate_query_with_an_item_without_id(spark, tmp_path):
    import duckdb

    from graphloom.llm import queries

    docs = [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, "only these three words"), (3, None), (None, "short one"), (4, "short one")]
    bench = [(None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (None, "short one"), (7, "Short One!"), (8, "w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (9, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = queries.op2_decontaminate(spark, str(tmp_path)).filter("doc_id is not null")
    want = db.execute(queries.ORACLES["op2_decontaminate"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(r for r in want.fetchall() if r[names.index("doc_id")] is not None)
    assert {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in got.collect()} == {1: (11, 1, True), 2: (0, 0, False), 3: (0, 0, False), 4: (2, 1, True)}


def test_token_counts(docs, none):
    rows = token_counts.token_counts(docs).collect()
    got = by_id(rows)
    assert len(rows) == len(ROWS) and (got[3].n_bytes, got[3].n_tokens, got[4].n_tokens) == (0, 0, 0) and got[5].n_bytes == len(LONG)
    assert token_counts.token_counts(none).count() == 0


def test_toxicity(docs, none, spark):
    labels = spark.createDataFrame([(1, 0), (5, 0), (7, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    blank = toxicity.train(none, labels)
    assert {r.score for r in toxicity.score_toxicity(docs, blank).collect()} == {0.5}
    assert toxicity.score_toxicity(none, model).count() == 0
    assert toxicity.drop_toxic(docs, blank).count() == len(ROWS) and toxicity.drop_toxic(docs, blank).columns == docs.columns


def test_minhash(docs, none):
    rows = minhash.near_duplicates(docs, shingle=3, threshold=0.85).collect()
    got = by_id(rows)
    assert len(rows) == len(ROWS)
    assert (got[2].component_id, got[7].component_id, got[5].component_id) == (1, 5, 5) and not got[7].kept
    assert (got[3].n_shingles, got[3].component_id, got[6].n_shingles, got[6].kept) == (0, 3, 0, True)
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "None", "None"])


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, 0), (None, 1), (4, None)], "doc_id long, quality int")
    rows = quality.quality_scores(docs, quality.train(docs, labels)).collect()
    assert len(rows) == len(ROWS) and all(r.quality is not None and 0 <= r.quality <= 1 for r in rows)
    assert quality.quality_scores(none, quality.train(none, labels)).count() == 0


def test_html(pages):
    rows = html_extract.extract_text(pages).collect()
    got = by_id(rows, "page_id")
    assert len(rows) == 7 and got[1].text == "Title\nSome main text, with enough words to be seen as such."
    assert got[3].text == "" and got[None].text == "" and html_extract.extract_text(pages.limit(0)).count() == 0


def test_warc(pages, spark, tmp_path):
    warc.write_warc(pages, str(tmp_path / "w"))
    rows = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert len(rows) == 7 and {r.kind for r in rows} == {"response", "revisit"}
    got = by_id(rows, "record_id")
    assert got["1"].target_uri == "http://a/b" and bytes(got["1"].payload) == MARKUP.encode() and got["2"].kind == "revisit" and got["2"].refers_to == "1"
    assert got["2"].payload_bytes == len(MARKUP) and got["3"].payload_bytes == 0 and got["null"].kind == "response"
    warc.write_warc(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_packing(docs, none):
    rows = packing.pack(docs, capacity=64, grain=8).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in ROWS}
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r.length for r in rows if r.doc_id in (3, 4)) == 2 and packing.pack(none).count() == 0


def test_sharding(docs, none):
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == len(ROWS) and {r.size for r in rows if r.doc_id in (3, 4)} == {1}
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(none).count() == 0


def test_fit_of_nothing():
    from graphloom.llm.linear import Rows

    w, b = fit(Rows([]), [], 3, 0.1)
    assert not w.any() and b == 0
