"""The inverted index: against the search over texts, after changes against one built anew, and what it reads."""

import random

import pytest

from graphloom.operators import fulltext, search
from graphloom.operators.fulltext import TextIndex

ROWS = [
    (1, "Big red fox", "runs over the red hill"), (2, "red big fox", None), (3, "Été", "big redder"), (4, None, "éte a_b"), (5, "big", "red"), (6, "", ""), (7, None, None),
    (8, "one two three four five", "six seven eight nine ten eleven twelve"), (9, "red", "x y z red fox big " * 5),
]
QUERIES = ["big red", '"big red"', "red*", '"big red" *', "ete", "a_b", "runs OR ete", "big NOT fox", "red AND fox NOT runs OR a_b", "red", "nothing", "x", '"red red"', "fox red big"]


def index_of(spark, path, rows, **options):
    index = TextIndex(spark, str(path), ("title", "body"), buckets=4, **options)
    index.add(frame(spark, rows))
    return index


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, body string")


def hits(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return index_of(spark, tmp_path_factory.mktemp("index") / "i", ROWS)


def test_same_hits_and_scores_as_over_the_texts(spark, index):
    docs = frame(spark, ROWS)
    for q in QUERIES:
        assert hits(index.bm25(q)) == hits(search.bm25(docs, "id", q, "title", "body")), q
    for q in ("", "a.b", 'big "', "OR big", "big AND", "nowhere: big", "NEAR(big", "a:b"):
        assert fulltext.parse(q, index.columns) is None and hits(index.bm25(q)) == [], q


def test_columns_and_near(index):
    found = lambda q: sorted(d for d, _ in hits(index.bm25(q)))
    assert found("title: red") == [1, 2, 9] and found("body: red") == [1, 5, 9] and found("title: red NOT body: red") == [2]
    assert found('title: "big red"') == [1] and found("body: red*") == [1, 3, 5, 9]
    assert found("NEAR(one five, 3)") == [8] and found("NEAR(one five, 2)") == [] and found("NEAR(five one, 3)") == [8]
    assert found("NEAR(one six, 50)") == []  # in one column
    assert found('NEAR("six seven" "ten eleven" nine, 2)') == [8] and found('NEAR("six seven" "eleven twelve", 2)') == []
    assert found("body: NEAR(seven ni*)") == [8] and found("title: NEAR(seven nine)") == []


def test_changes_equal_an_index_built_anew(spark, tmp_path):
    rnd = random.Random(1)
    words = ["red", "big", "fox", "hill", "ete", "sun", "sea"]
    text = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9)))
    now = {k: (k, text(), text()) for k in range(30)}
    index = index_of(spark, tmp_path / "a", list(now.values()))
    for _ in range(2):
        changed = {k: (k, text(), text()) for k in rnd.sample(range(36), 8)}
        index.add(frame(spark, list(changed.values())))
        now |= changed
        gone = rnd.sample(range(40), 5)
        index.delete(spark.createDataFrame([(k,) for k in gone], "id long"))
        now = {k: v for k, v in now.items() if k not in gone}
    back = (gone[0], "red fox", "big sea")  # one that was deleted comes again
    index.add(frame(spark, [back]))
    now[gone[0]] = back
    anew = index_of(spark, tmp_path / "b", list(now.values()))
    queries = ["red", "big fox", '"red fox"', "se* NOT sun", "title: hill OR body: ete"]
    want = [hits(anew.bm25(q)) for q in queries]
    assert [hits(index.bm25(q)) for q in queries] == want and any(want)
    assert len(index.generations()) == 6
    index.compact()
    assert len(index.generations()) == 1 and [hits(index.bm25(q)) for q in queries] == want


def test_a_generation_without_sums_does_not_count(spark, tmp_path):
    index = index_of(spark, tmp_path / "i", ROWS)
    before = hits(index.bm25("red"))
    frame(spark, [(50, "red", "red")]).write.parquet(str(tmp_path / "i" / "gen=1" / "docs"))  # as if a writer had been lost
    assert index.generations() == [0] and hits(index.bm25("red")) == before
    index.add(frame(spark, [(51, "red", None)]))
    assert index.generations() == [0, 2] and 51 in {d for d, _ in hits(index.bm25("red"))}


def test_a_query_reads_its_terms_folders_and_no_text(spark, index):
    plan = index.bm25("fox hill")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and not any("body" in s or "title" in s for s in scans)
    postings = [s for s in scans if "postings" in s]
    assert postings and all("PartitionFilters: [" in s and "bucket" in s.split("PartitionFilters")[1] for s in postings)


def test_fallback_and_odd_tables(spark, index, tmp_path):
    docs = frame(spark, ROWS)
    assert hits(index.search(docs, "id", "unn")) == []
    assert hits(index.search(docs, "id", "uns over")) == [(1, 0.0)] and hits(index.search(docs, "id", "d fo")) == sorted(hits(index.search(docs, "id", "d fo")))
    assert [d for d, _ in hits(index.search(docs, "id", "runs"))] == [1]
    empty = index_of(spark, tmp_path / "e", [])
    assert hits(empty.bm25("red")) == [] and hits(empty.search(docs.limit(0), "id", "red")) == []
    empty.delete(spark.createDataFrame([(1,)], "id long"))
    empty.add(frame(spark, [(None, "red", ""), (1, "red", "")]))
    assert [d for d, _ in hits(empty.bm25("red"))] == [1]
    both = fulltext.combined(index, docs, index, docs, "hill")
    assert [tuple(r)[:2] for r in both.collect()] == [("symbol", 1), ("doc", 1)]


def test_indexing_keeps_the_index_up(spark, tmp_path):
    from graphloom.engine import Engine
    from graphloom.indexing import index as index_repository
    from graphloom.sources.store import FactStore, StoredGraph

    repo = tmp_path / "r"
    repo.mkdir()
    (repo / "a.py").write_text('"""Salted caramel."""\ndef mix():\n    """Stir the caramel slowly."""\n')
    (repo / "b.py").write_text('def bake():\n    """Bake the cake."""\n')
    store = FactStore(spark, str(tmp_path / "s"))
    index_repository(spark, str(repo), store)
    found = lambda q: {r.qualified_name for r in Engine(StoredGraph(store)).doc_search(q).join(StoredGraph(store).docs.withColumnRenamed("id", "doc"), "doc").join(StoredGraph(store).symbols.withColumnRenamed("id", "symbol_id"), "symbol_id").collect()}
    assert found("caramel") == {"a", "a::mix"} and found("cake") == {"b::bake"}
    (repo / "a.py").write_text('def mix():\n    """Stir the chocolate slowly."""\n')
    (repo / "b.py").unlink()
    index_repository(spark, str(repo), store)
    assert found("chocolate") == {"a::mix"} and found("caramel") == set() and found("cake") == set()
    graph = StoredGraph(store)
    anew = TextIndex(spark, str(tmp_path / "anew"), ("title", "body"))
    anew.add(graph.docs)
    assert hits(graph.text_index("docs").bm25("stir the")) == hits(anew.bm25("stir the"))
    assert {(r.type, r.score < 0) for r in Engine(graph).search("mix").collect()} == {("symbol", True)} | {(r.type, r.score < 0) for r in Engine(graph).search("mix").collect() if r.type == "doc"}
    store.refresh_index("docs")  # nothing to do
    assert len(graph.text_index("docs").generations()) == len(StoredGraph(store).text_index("docs").generations())


def test_words_with_signs(spark):
    rows = spark.createDataFrame([(r"a\Eb.c x",), ("a b",), ("f(x)",)], "t string")
    for word, want in ((r"a\Eb", [True, False, False]), ("f(x)", [False, False, True]), ("x", [True, False, True])):
        assert [r[0] for r in rows.select(search.has_word(rows.t, word)).collect()] == want


def test_words_are_not_shuffled_one_by_one(spark, tmp_path):
    """What indexing shuffles: texts once, lengths, and postings once; not each place of each word."""
    body = " ".join(f"w{k % 40}" for k in range(400))
    docs = spark.range(500).selectExpr("id", f"'{body}' as title", "cast(null as string) as body").coalesce(2)
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: [x for found in [store.stageList(None, False, False, none, None)] for x in (found.apply(k) for k in range(found.size()))]
    before = max((x.stageId() for x in stages()), default=-1)
    index = fulltext.TextIndex(spark, str(tmp_path / "i"), ("title", "body"), buckets=4)
    index.add(docs)
    assert sum(x.shuffleWriteRecords() for x in stages() if x.stageId() > before) < 500 * 40 + 500 * 6
    found = index.postings(["w3"]).collect()
    assert len(found) == 500 and all(r.positions == list(range(3, 400, 40)) and r.length == 400 for r in found)
