"""Near duplicates: joins with hot keys can be split, blocks are bounded by bytes; the pipeline on odd tables."""

import random

import pytest

from graphloom.llm import minhash


def joins_of(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Join" in line]


def test_joins_with_texts_are_merge_joins(spark):
    pairs = spark.createDataFrame([(2, 1), (3, 1)], "a long, b long")
    texts = spark.createDataFrame([(k, f"text {k}") for k in range(1, 4)], "rep long, text string")
    joins = joins_of(minhash.confirm(pairs, texts, 3, 0.85))
    assert len(joins) == 2 and all("SortMergeJoin" in j for j in joins)
    stars = spark.createDataFrame([(1, 1, 1, False), (1, 2, 1, False), (1, 3, 3, True)], "star long, rep long, component long, odd boolean")
    joins = joins_of(minhash._rest_links(minhash._blocks(stars, texts, 2, 100), texts, 3, 0.85))
    assert len(joins) == 2 and all("SortMergeJoin" in j for j in joins)


def families(seed, n):
    """Texts of families that share most words, in which many pairs aren't linked with their star's centre."""
    rnd = random.Random(seed)
    common = [f"w{k}" for k in range(60)]
    return [(k, " ".join(common[: rnd.randint(40, 60)] + [f"x{rnd.randint(0, 12)}_{j}" for j in range(rnd.randint(2, 9))])) for k in range(n)]


@pytest.mark.parametrize("block_docs,block_bytes", [(128, 8 << 20), (128, 4000), (30, 1 << 20)])
def test_blocks_of_any_size_give_the_same_components(spark, block_docs, block_bytes):
    rows = families(7, 120)
    sets = {k: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, threshold=0.85, block_docs=block_docs, block_bytes=block_bytes)
    assert {r.doc_id: r.component_id for r in got.collect()} == {k: find(k) for k in sets}


def test_pipeline_with_clashing_columns_null_ids_and_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    text = " ".join(f"plain{k}" for k in range(40))
    leak = " ".join(f"leak{k}" for k in range(12))
    docs = [(1, text, "x", 1), (2, text, "y", 2), (None, "a text without id", "x", 3), (None, None, None, None), (3, leak, "x", 4), (4, text + " more", "x", 5), (5, "", "z", 6)]
    schema = "doc_id long, text string, rep string, __lost_id long"
    for name, rows in (("full", docs), ("empty", [])):
        folder = tmp_path / name
        spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, leak), (None, "a text without id")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        spark.createDataFrame([(1, 0), (3, 0), (99, 1)], "doc_id long, toxic int").write.parquet(str(folder / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "full"))
    ids = {r.doc_id for r in got.select("doc_id").collect()}
    # 1 equals 2 and goes; 2 and 4 are near; 3 and the text without id are of the benchmark; of the empty texts the one with an id stays.
    assert ids == {2, 5}
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
