"""Full-text search: BM25 over words, phrases and beginnings, substring fallback, excerpts and the whole-word baseline."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _plain_letters() -> tuple[str, str]:
    """Letters that are an ASCII letter with one mark, and those letters; then the marks themselves, which go."""
    pairs = [(c, d[0]) for c in map(chr, range(0xC0, 0x1F00)) if c.islower() and len(d := unicodedata.normalize("NFD", c)) == 2 and d[0].isascii() and unicodedata.combining(d[1])]
    return "".join(c for c, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(d for _, d in pairs)


MARKED, BARE = _plain_letters()


def folded(text: Column) -> Column:
    """The runs of letters and digits of any script, in lower case and Latin letters without their mark, each between two blanks of its own."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    plain = F.when(lower.rlike(r"[^\x00-\x7F]"), F.translate(lower, MARKED, BARE)).otherwise(lower)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))


def occurrences(text: Column, part: str) -> Column:
    """How many times a folded text has the part; also within itself, where it ends as it begins."""
    if any(part.startswith(part[-k:]) for k in range(2, len(part))):
        return F.regexp_count(text, F.lit(f"(?={part})"))
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / len(part.encode())).cast("int")


def words_of(text: str) -> tuple[str, ...]:
    """The words of a query's part, folded as texts are."""
    gone = dict.fromkeys(map(ord, MARKED)) | dict(zip(map(ord, MARKED), BARE, strict=False))
    return tuple("".join(c if c.isalnum() else " " for c in text.lower().translate(gone)).split())


class Phrase(NamedTuple):
    """Words that follow each other in one column; the last may go on if ``open``."""

    words: tuple[str, ...]
    open: bool

    def count(self, text: Column) -> Column:
        """How many times it begins in a folded text."""
        return occurrences(text, f" {'  '.join(self.words)}{'' if self.open else ' '}")


_PART = re.compile(r'\s*(?:"((?:[^"]|"")*)"|(\w+))\s*(\*?)')


def parse(query: str) -> list[list[list[list[Phrase]]]] | None:
    """A query as alternatives (``OR``) of parts that must hold (``AND``), each of phrases side by side and, after ``NOT``, others.

    Words and quoted phrases side by side must all be there; ``*`` after one leaves its end open. A word that isn't one run of
    letters and digits, as ``a_b``, is a phrase. Anything else (dots, a lone quote, a missing side) is no query: None.
    """
    alternatives: list[list[list[list[Phrase]]]] = [[[[]]]]
    at, query = 0, query.rstrip()
    while at < len(query):
        m = _PART.match(query, at)
        if not m:
            return None
        at = m.end()
        if m[2] in ("OR", "AND", "NOT") and not m[3]:
            if not alternatives[-1][-1][-1]:
                return None
            if m[2] == "OR":
                alternatives.append([[[]]])
            elif m[2] == "AND":
                alternatives[-1].append([[]])
            else:
                alternatives[-1][-1].append([])
        elif words := words_of(m[2] or m[1]):
            alternatives[-1][-1][-1].append(Phrase(words, bool(m[3])))
    return alternatives if alternatives[-1][-1][-1] else None


def is_query(text: str) -> bool:
    """Whether the index takes a query. Others, as names with dots, are looked for as substrings."""
    return parse(text) is not None


def bm25(docs: DataFrame, id_col: str, query: str, *columns: str) -> DataFrame:
    """``doc, score`` of the docs that the query (see ``parse``) holds for, the best (smallest) first; none if it isn't a query.

    A phrase lies within one column. Phrases are counted in each row by searching its words, so beside the final order nothing is
    shuffled but one row of sums a task; what is broadcast is that one row. Null columns are empty.
    """
    parsed = parse(query) or []
    phrases = [p for every in parsed for part in every for side in part for p in side]
    names = [f"t{k}" for k in range(len(columns))]
    rows = docs.select(F.col(id_col).alias("doc"), *(folded(F.col(c)).alias(t) for c, t in zip(columns, names, strict=True)))
    total = lambda each: reduce(lambda a, b: a + b, (each(F.col(t)) for t in names))
    length = total(lambda t: F.when(t == "  ", 0).otherwise(occurrences(t, "  ") + 1))
    rows = rows.select("doc", length.alias("dl"), *(total(p.count).alias(f"tf{k}") for k, p in enumerate(phrases)))
    df = [F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(phrases))]
    sums = rows.agg(F.count(F.lit(1)).cast("double").alias("n_docs"), F.avg("dl").alias("avgdl"), *df)  # one row
    score, numbers = F.lit(0.0), iter(range(len(phrases)))
    for k in range(len(phrases)):
        idf = F.log((F.col("n_docs") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        tf = F.col(f"tf{k}")
        score = score - F.when(idf <= 0, LEAST_IDF).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    there = lambda side: reduce(and_, [F.col(f"tf{next(numbers)}") > 0 for _ in side])
    part_of = lambda part: reduce(and_, [there(side) if k == 0 else ~there(side) for k, side in enumerate(part)])
    holds = reduce(or_, [reduce(and_, [part_of(part) for part in every]) for every in parsed], F.lit(False))
    # The condition stays above the join, as it names the score: pushed down, it would count every phrase twice.
    scored = rows.crossJoin(F.broadcast(sums)).select("doc", F.when(holds, F.round(score, 6)).alias("score"))
    return scored.filter("score is not null").orderBy("score", "doc")


def sanitise(query: str) -> str:
    """What a substring search keeps of a query: letters, digits, white space and ``_ - : .``, trimmed."""
    return "".join(c for c in query if c.isalnum() or c.isspace() or c in "_-:.").strip()


def like(docs: DataFrame, id_col: str, query: str, *columns: str) -> DataFrame:
    """Docs with the text in any of the columns, without regard to case; an empty query finds all."""
    pattern = f"%{sanitise(query)}%"
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return docs.filter(hit).select(F.col(id_col).alias("doc"))


def search(docs: DataFrame, id_col: str, query: str, *columns: str) -> DataFrame:
    """BM25, or the substring search where that finds nothing or the query isn't one for the index."""
    if not is_query(query):
        return like(docs, id_col, query, *columns).withColumn("score", F.lit(0.0))
    ranked = bm25(docs, id_col, query, *columns)
    other = like(docs, id_col, query, *columns).withColumn("score", F.lit(0.0))
    return ranked.unionByName(other.join(ranked.select(F.lit(1).alias("hit")).limit(1), F.lit(True), "left_anti"))


def combined(symbols: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """Symbols and docs, tagged: each ranked, or by substring where nothing is ranked."""
    s = search(symbols, "id", query, "name", "qualified_name").select(F.lit("symbol").alias("type"), F.col("doc").alias("id"))
    return s.unionByName(search(docs, "id", query, "title", "body").select(F.lit("doc").alias("type"), F.col("doc").alias("id")))


def excerpt(body: Column) -> Column:
    """The first line of a trimmed text without its quotes, with ``...`` if there is more."""
    bare = F.trim(F.regexp_replace(F.trim(body), r'^(?:"""|\'\'\'|"|\')|(?:"""|\'\'\'|"|\')$', ""))
    return F.when(bare.contains("\n"), F.concat(F.rtrim(F.substring_index(bare, "\n", 1)), F.lit("..."))).otherwise(bare)


def has_word(text: Column, word: str) -> Column:
    """The word stands alone: no letter, digit or ``_`` beside it."""
    quoted = re.sub(r"([^\w\s])", r"\\\1", word)
    return text.rlike(rf"(?<![\p{{L}}\p{{N}}_]){quoted}(?![\p{{L}}\p{{N}}_])")


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.char_length(text) / F.lit(4.0)).cast("long")


def grep_baseline(docs: DataFrame, text_col: str, word: str) -> DataFrame:
    """Number of texts with the word, and their estimated tokens."""
    hit = docs.filter(has_word(F.col(text_col), word))
    return hit.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum(estimate_tokens(F.col(text_col))), F.lit(0)).alias("tokens"))
