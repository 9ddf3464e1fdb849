"""A persisted inverted index: postings by term, with positions, for ranked search without reading the texts.

An index is a folder of generations. Each holds postings ``(term, doc, column, positions, length)`` in Parquet, in folders by the term's
hash and in order of terms within, the length of each doc, and one row of sums; the docs that a generation takes away are its
tombstones. A posting counts if no later generation has a tombstone of its doc. So texts are added, replaced and deleted by writing
what is new, and ``compact`` makes one generation of all. A generation counts from when its sums are written, which is last.

A query reads only its terms' folders (for a beginning: the row groups in all folders whose terms can begin so), and works on
the docs that hold a term: phrases and NEAR are intersections of positions.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.search import B, K1, LEAST_IDF, Phrase, folded, like, words_of

#: Folders of postings in a generation.
BUCKETS = 64
#: Words between the phrases of a NEAR at most, if it doesn't say.
NEAR = 10


class Leaf(NamedTuple):
    """Phrases that must be in one column (in any, or in the one named), ``near`` words apart at most if there are several."""

    phrases: tuple[Phrase, ...]
    column: str | None
    near: int | None


_LEAF = re.compile(r'\s*(?:(\w+)\s*:\s*)?(?:NEAR\s*\(([^()]*?)(?:,\s*(\d+)\s*)?\)|"((?:[^"]|"")*)"|(\w+))\s*(\*?)')
_WORDS = re.compile(r'\s*(?:"((?:[^"]|"")*)"|(\w+))\s*(\*?)')


def parse(query: str, columns: tuple[str, ...]) -> list[list[list[list[Leaf]]]] | None:
    """A query as in ``search.parse``, whose leaves may name a column (``title: word``) or be ``NEAR(a "b c", 5)``; None if it isn't one."""
    out: list[list[list[list[Leaf]]]] = [[[[]]]]
    at, query = 0, query.rstrip()
    while at < len(query):
        m = _LEAF.match(query, at)
        if not m or m[1] and m[1] not in columns:
            return None
        at = m.end()
        if m[5] in ("OR", "AND", "NOT") and not m[6] and not m[1]:
            if not out[-1][-1][-1]:
                return None
            if m[5] == "OR":
                out.append([[[]]])
            elif m[5] == "AND":
                out[-1].append([[]])
            else:
                out[-1][-1].append([])
            continue
        if m[2] is not None:
            parts, k = [], 0
            while k < len(m[2].rstrip()):
                w = _WORDS.match(m[2], k)
                if not w:
                    return None
                parts.append((w[1] or w[2] or "", w[3]))
                k = w.end()
        else:
            parts = [(m[5] or m[4] or "", m[6])]
        phrases = tuple(Phrase(words, bool(star)) for text, star in parts if (words := words_of(text)))
        if phrases:
            out[-1][-1][-1].append(Leaf(phrases, m[1], int(m[3] or NEAR) if m[2] is not None else None))
    return out if out[-1][-1][-1] else None


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class TextIndex:
    """An index over text columns of rows with an id, in a folder of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str, columns: tuple[str, ...], id_type: str = "long", buckets: int = BUCKETS):
        self.spark, self.root, self.columns, self.id_type, self.buckets = spark, root.rstrip("/"), tuple(columns), id_type, buckets

    # --- writing ---

    def add(self, docs: DataFrame, id_col: str = "id") -> None:
        """Take in docs; those that are there already are replaced. Null texts are empty; of rows with one id all count as one doc's.

        A doc without an id can't be found again and is left out.
        """
        new = self._next()
        texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast(self.id_type).alias("doc"), *(F.col(c).cast("string").alias(f"text{k}") for k, c in enumerate(self.columns)))
        self._lengths(self._words(texts)).write.parquet(f"{self.root}/gen={new}/docs")
        lengths = self.spark.read.parquet(f"{self.root}/gen={new}/docs")
        # Texts are dealt by doc once; what is made of a doc's words then stays in its task until postings go to their ranges.
        rows = self._words(texts.repartition("doc")).withColumn("length", F.sum(F.size("words")).over(Window.partitionBy("doc")))
        words = rows.select("doc", "column", "length", F.posexplode("words").alias("at", "term"))
        # Rows of one id: the places of one aren't told from another's; ids are unique in tables that are meant for search.
        postings = words.groupBy("doc", "term", "column", "length").agg(F.sort_array(F.collect_list("at")).alias("positions")).select("term", "doc", "column", "positions", "length")
        # By ranges, so that a term of very many docs is spread over tasks and files.
        ordered = postings.withColumn("bucket", bucket_of(F.col("term"), self.buckets)).repartitionByRange("bucket", "term", "doc").sortWithinPartitions("bucket", "term", "doc")
        ordered.write.partitionBy("bucket").parquet(f"{self.root}/gen={new}/postings")
        self._bury(lengths.select("doc"), new, lengths)

    def delete(self, ids: DataFrame) -> None:
        """Take docs away; ids that aren't there do nothing."""
        new = self._next()
        self._bury(ids.select(F.col(ids.columns[0]).cast(self.id_type).alias("doc")), new, None)

    def compact(self) -> None:
        """Write what counts as one generation, and delete the others. Not while others read or write."""
        old, new = self.generations(), self._next()
        live = self._live(self._read("postings", old).select("term", "doc", "column", "positions", "length", "gen", "bucket")).drop("gen")
        live.repartitionByRange("bucket", "term", "doc").sortWithinPartitions("bucket", "term", "doc").write.partitionBy("bucket").parquet(f"{self.root}/gen={new}/postings")
        self._live(self._read("docs", old)).select("doc", "length").write.parquet(f"{self.root}/gen={new}/docs")
        lengths = self.spark.read.parquet(f"{self.root}/gen={new}/docs")
        lengths.select("doc").limit(0).write.parquet(f"{self.root}/gen={new}/gone")
        self._sums(lengths, new, -1)
        for g in old:
            fs, path = self._path(f"gen={g}")
            fs.delete(path, True)

    def _words(self, texts: DataFrame) -> DataFrame:
        """``doc, column, words`` of ``doc, text0, text1, …``."""
        rows = texts.select("doc", F.posexplode(F.array(*(folded(F.col(f"text{k}")) for k in range(len(self.columns))))).alias("column", "line"))
        words = F.filter(F.split(F.trim("line"), "  "), lambda w: w != "")
        return rows.select("doc", F.col("column").cast("int").alias("column"), words.alias("words"))

    def _lengths(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("doc").agg(F.sum(F.size("words")).cast("long").alias("length"))

    def _bury(self, ids: DataFrame, new: int, added: DataFrame | None) -> None:
        """Tombstones for those of the ids that are there, then the sums, with which the generation counts."""
        old = self.generations()
        gone = self._live(self._read("docs", old)).join(ids.distinct(), "doc", "left_semi").select("doc", "length") if old else None
        none = self.spark.createDataFrame([], f"doc {self.id_type}, length long")
        (none if gone is None else gone).write.parquet(f"{self.root}/gen={new}/gone")
        gone = self.spark.read.parquet(f"{self.root}/gen={new}/gone")
        change = gone.select((-F.lit(1)).cast("long").alias("n"), (-F.col("length")).alias("length"))
        if added is not None:
            change = change.unionByName(added.select(F.lit(1).cast("long").alias("n"), "length"))
        self._sums(change, new, None)

    def _sums(self, rows: DataFrame, new: int, base: int | None) -> None:
        n = F.sum("n") if base is None else F.count(F.lit(1))
        sums = rows.agg(F.coalesce(n, F.lit(0)).alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))
        sums.coalesce(1).write.parquet(f"{self.root}/gen={new}/sums")

    # --- reading ---

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        fs, path = self._path()
        names = [str(x.getPath().getName()) for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removeprefix("gen=")) for n in names if n.startswith("gen="))

    def _has(self, name: str) -> bool:
        fs, path = self._path(name)
        return fs.exists(path)

    def generations(self) -> list[int]:
        return [n for n in self._numbers() if self._has(f"gen={n}/sums/_SUCCESS")]

    def _next(self) -> int:
        return max(self._numbers(), default=-1) + 1

    def _read(self, name: str, generations: list[int]) -> DataFrame:
        """A table of some generations, with their numbers. ``doc`` and all else have fixed types, so no file is opened for its schema."""
        schema = {
            "postings": f"term string, doc {self.id_type}, column int, positions array<int>, length long, bucket int",
            "docs": f"doc {self.id_type}, length long", "gone": f"doc {self.id_type}, length long", "sums": "n_docs long, length long",
        }[name]
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/gen={g}/{name}").withColumn("gen", F.lit(g)) for g in generations if self._has(f"gen={g}/{name}")]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, gen int")

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows of docs that no later generation has taken away."""
        old = self.generations()
        if len(old) < 2:
            return rows
        gone = self._read("gone", old).groupBy(F.col("doc").alias("gone_doc")).agg(F.max("gen").alias("gone_in"))
        return rows.join(gone, F.col("doc") == F.col("gone_doc"), "left").filter("gone_in IS NULL OR gone_in <= gen").drop("gone_doc", "gone_in")

    def postings(self, terms: list[str], beginnings: list[str] = ()) -> DataFrame:
        """Postings of terms, and of all terms that begin with one of ``beginnings``."""
        rows = self._read("postings", self.generations())
        wanted = F.lit(False)
        if terms:
            buckets = [r.b for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of(F.col("t"), self.buckets).alias("b")).distinct().collect()]
            wanted = F.col("bucket").isin(*buckets) & F.col("term").isin(*terms)
        for b in beginnings:
            wanted = wanted | F.col("term").startswith(b)
        return self._live(rows.filter(wanted))

    def bm25(self, query: str) -> DataFrame:
        """``doc, score`` of the docs for which the query holds, the best (smallest) first; none if it isn't a query (see ``parse``)."""
        parsed = parse(query, self.columns)
        leaves = [x for every in parsed or [] for part in every for side in part for x in side]
        if not leaves:
            return self.spark.createDataFrame([], f"doc {self.id_type}, score double")
        words = sorted({(w, p.open and k == len(p.words) - 1) for x in leaves for p in x.phrases for k, w in enumerate(p.words)})
        rows = self.postings([w for w, is_open in words if not is_open], [w for w, is_open in words if is_open])
        # One row a doc and column, with the places of each word; of a beginning, those of all words that have it.
        places = lambda w, is_open: F.flatten(F.collect_list(F.when(F.col("term").startswith(w) if is_open else F.col("term") == w, F.col("positions"))))
        at = rows.groupBy("doc", "column", "length").agg(*(places(w, o).alias(f"w{k}") for k, (w, o) in enumerate(words)))
        number = {w: k for k, w in enumerate(words)}

        def starts(p: Phrase) -> Column:
            back = lambda k: lambda at: at - k  # noqa: E731  to where the phrase would begin
            lists = [F.transform(f"w{number[w, p.open and k == len(p.words) - 1]}", back(k)) for k, w in enumerate(p.words)]
            return reduce(F.array_intersect, lists) if len(lists) > 1 else lists[0]

        def near(x: Leaf, begins: list[Column]) -> Column:
            """Some phrase has all others behind its beginning, ``near`` words behind its end at most."""
            def behind(j: int):
                return lambda s: reduce(and_, [F.exists(b, lambda y: (y >= s) & (y <= s + len(x.phrases[j].words) + x.near)) for b in begins])

            return reduce(or_, [F.exists(begins[j], behind(j)) for j in range(len(begins))])

        counts = []
        for k, x in enumerate(leaves):
            begins = [starts(p) for p in x.phrases]
            ok = F.lit(True) if x.column is None else F.col("column") == self.columns.index(x.column)
            ok = ok & near(x, begins) if len(begins) > 1 else ok
            counts.append(F.array(*(F.when(ok, F.size(b)).otherwise(0) for b in begins)).alias(f"l{k}"))
        at = at.select("doc", "length", *counts)
        n_of = [len(x.phrases) for x in leaves]
        flat = [(k, j) for k, n in enumerate(n_of) for j in range(n)]
        docs = at.groupBy("doc", "length").agg(*(F.sum(F.col(f"l{k}")[j]).alias(f"tf{k}_{j}") for k, j in flat))
        df = [F.count_if(F.col(f"tf{k}_{j}") > 0).alias(f"df{k}_{j}") for k, j in flat]
        sums = self._read("sums", self.generations()).agg(F.sum("n_docs").cast("double").alias("n_docs"), (F.sum("length") / F.sum("n_docs")).alias("avgdl"))
        numbers = docs.agg(*df).crossJoin(F.broadcast(sums))  # one row and one row
        score = F.lit(0.0)
        for k, j in flat:
            idf, tf = F.log((F.col("n_docs") - F.col(f"df{k}_{j}") + 0.5) / (F.col(f"df{k}_{j}") + 0.5)), F.col(f"tf{k}_{j}")
            score = score - F.when(idf <= 0, LEAST_IDF).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
        here = iter(range(len(leaves)))
        leaf = lambda k: reduce(and_, [F.col(f"tf{k}_{j}") > 0 for j in range(n_of[k])])
        there = lambda side: reduce(and_, [leaf(next(here)) for _ in side])
        part_of = lambda part: reduce(and_, [there(side) if k == 0 else ~there(side) for k, side in enumerate(part)])
        holds = reduce(or_, [reduce(and_, [part_of(part) for part in every]) for every in parsed])
        scored = docs.crossJoin(F.broadcast(numbers)).select("doc", F.when(holds, F.round(score, 6)).alias("score"))
        return scored.filter("score IS NOT NULL").orderBy("score", "doc")

    def search(self, docs: DataFrame, id_col: str, query: str) -> DataFrame:
        """Ranked hits; where there are none, or it isn't a query, the docs that have it as a substring. Only then are texts read."""
        if parse(query, self.columns) is not None:
            ranked = self.bm25(query)
            if not ranked.isEmpty():
                return ranked
        return like(docs, id_col, query, *self.columns).withColumn("score", F.lit(0.0))


def combined(symbols: TextIndex, symbol_rows: DataFrame, docs: TextIndex, doc_rows: DataFrame, query: str) -> DataFrame:
    """``type, id, score``: symbols and docs, each ranked, or by substring where nothing is ranked."""
    one = lambda index, rows, kind: index.search(rows, "id", query).select(F.lit(kind).alias("type"), F.col("doc").alias("id"), "score")
    return one(symbols, symbol_rows, "symbol").unionByName(one(docs, doc_rows, "doc"))
