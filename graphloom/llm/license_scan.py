"""Licence scan: ordered signature rules behind a keyword prefilter, overlapping detections resolved by priority and containment.

Only built-in functions of Spark are used and nothing is shuffled: a text is read in its own row. Lower-cased words are put in a
line, each with a space on either side. Texts with a keyword are cut into stretches of ``STRETCH`` characters, each seen with
``MARGIN`` more on either side, and in a stretch only rules whose keyword stands in it are tried. As no rule's match is longer than half the margin
and matches of one rule never overlap, the cuts change nothing, and the work goes with the text's length, however long it is.

A detection is dropped if another one of higher priority overlaps it, or if another one of its own priority contains it (of equal
intervals the earlier rule stays). Which others are kept themselves doesn't matter, so that detections are judged independently.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_or_empty
from graphloom.llm.license_rules import RULES, WEIGHTS, Rule

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: A base phrase is worth as much as a name.
BASE_WEIGHT = WEIGHTS[4]
NOT_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The only letters beyond ASCII whose lower case has a letter of ASCII in it, and one that stands in for them.
KELVIN, DOTTED_I, OTHER = "\u212a", "\u0130", "\u00e5"
STRETCH, MARGIN = 4096, 512


def spaced(phrase: str) -> str:
    return " " + phrase.replace(" ", "  ") + " "


BASE_PATTERN = " (?:" + "|".join(p.replace(" ", "  ") for p in BASE) + ") "


def word_line(text: Column) -> Column:
    """The text's words, A-Z in lower case, each with one space before and one behind it; empty if there are none.

    Letters beyond ASCII are parts of words; the line is only searched for words of ASCII, so their case doesn't matter.
    """
    plain = F.replace(F.replace(text, F.lit(KELVIN), F.lit(OTHER)), F.lit(DOTTED_I), F.lit(OTHER))
    line = F.trim(F.regexp_replace(F.lower(plain), NOT_WORDS, "  "))
    return F.when(line == "", "").otherwise(F.concat(F.lit(" "), line, F.lit(" ")))


def _words(line: Column) -> Column:
    """How many words a piece of a word line has."""
    return F.floor((F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))) / 2).cast("long")


def _by_keyword(rules: list[Rule]) -> Column:
    """Keyword to its rules, as one constant: it is folded before the query runs."""
    by: dict[str, list[dict]] = {}
    for r in rules:
        by.setdefault(r.keyword, []).append({"rule": r.rule, "label": r.label, "priority": r.priority, "pattern": r.pattern})
    return F.from_json(F.lit(json.dumps(by)), "map<string, array<struct<rule: int, label: string, priority: int, pattern: string>>>")


def _keywords(line: Column, keywords: Column) -> Column:
    """Which keywords are among the words of a line, by hashing."""
    return F.array_intersect(F.split(line, "  ?"), keywords)


def _hits(line: Column, rule: Column) -> Column:
    """Where the rule matches: every match, as matches of a rule never overlap."""
    def places(pieces: Column, found: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(pieces, 1, i + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice(found, 1, i), F.lit(0), lambda s, x: s + F.length(x))
        return F.transform(found, lambda m, i: F.struct(
            rule["rule"].alias("rule"), rule["label"].alias("label"), rule["priority"].alias("priority"), before(i).alias("start"), F.length(m).alias("length"), m.alias("matched")))

    bound = F.array(F.struct(F.split(line, rule["pattern"], -1).alias("pieces"), F.regexp_extract_all(line, rule["pattern"], F.lit(0)).alias("found")))
    return F.flatten(F.transform(bound, lambda b: places(b["pieces"], b["found"])))


def _beaten(d: Column, e: Column) -> Column:
    """Whether detection e takes detection d's place."""
    d_end, e_end = d["start"] + d["length"], e["start"] + e["length"]
    overlap = (e["start"] < d_end) & (d["start"] < e_end)
    contains = (e["start"] <= d["start"]) & (e_end >= d_end)
    return (overlap & (e["priority"] < d["priority"])) | (contains & (e["priority"] == d["priority"]) & ((e["length"] > d["length"]) | (e["rule"] < d["rule"])))


def _detections(line: Column, rules: Column) -> Column:
    """Detections of a word line that stay, each with its place in the line."""
    chunks = F.regexp_extract_all(line, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))

    def stretch(before: Column, own: Column, behind: Column, i: Column) -> Column:
        lead = F.length(before)
        seen = F.concat(before, own, behind)
        tried = F.flatten(F.transform(_keywords(seen, F.map_keys(rules)), lambda k: F.element_at(rules, k)))
        hits = F.flatten(F.transform(tried, lambda r: _hits(seen, r)))
        mine = lambda d: (d["start"] >= lead) & (d["start"] < lead + F.length(own))
        stay = lambda hs: F.filter(hs, lambda d: mine(d) & ~F.exists(hs, lambda e: _beaten(d, e)))
        kept = F.flatten(F.transform(F.array(hits), stay))
        return F.transform(kept, lambda d: d.withField("start", (d["start"] - lead + i * STRETCH).cast("long")).withField("matched", F.trim(F.replace(d["matched"], F.lit("  "), F.lit(" ")))))

    def each(cs: Column) -> Column:
        edge = lambda j: F.coalesce(F.get(cs, j), F.lit(""))
        return F.flatten(F.transform(cs, lambda c, i: stretch(F.right(edge(i - 1), F.lit(MARGIN)), c, F.left(edge(i + 1), F.lit(MARGIN)), i)))

    any_keyword = F.arrays_overlap(F.split(line, "  ?"), F.map_keys(rules))
    none = F.array().cast("array<string>")
    return F.flatten(F.transform(F.array(F.when(any_keyword, chunks).otherwise(none)), each))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """One row per document: id, ``n_words``, base places (``n_base``, ``first_word``, ``last_word``, ``base_labels``), ``labels``,
    ``score``, and ``detections`` as an array of (rule, label, priority, start, length, matched), in order of their places.

    ``start`` and ``length`` are characters of the word line (see ``word_line``). Labels are distinct, sorted and joined by commas; base
    labels are always among ``labels``. The score is the weight of the best priority found, 0 if nothing is. Null text is empty: no
    words, no labels, score 0. Repeated rows and repeated or null ids each give a row of their own; other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias(id_col), word_line(text_or_empty(text_col)).alias("__line"))
    line = F.col("__line")
    has_base = line.rlike(BASE_PATTERN)
    pieces, found = F.split(line, BASE_PATTERN, -1), F.regexp_extract_all(line, F.lit(BASE_PATTERN), F.lit(0))
    rows = rows.select(
        id_col, line, _words(line).alias("n_words"), F.when(has_base, pieces).alias("__pieces"), F.when(has_base, F.element_at(found, -1)).alias("__last"),
        _detections(line, _by_keyword(rules)).alias("__found"),
    )
    base = F.filter(F.array(*(F.when(F.contains(line, F.lit(spaced(p))), F.lit(label)) for p, label in BASE.items())), lambda x: x.isNotNull())
    weights = F.array(*(F.lit(WEIGHTS.get(k, 0.0)) for k in range(1, max(WEIGHTS) + 1)))
    rows = rows.select(
        id_col, "n_words", F.coalesce(F.size("__pieces") - 1, F.lit(0)).cast("long").alias("n_base"),
        _words(F.element_at("__pieces", 1)).alias("first_word"),
        (F.col("n_words") - _words(F.element_at("__pieces", -1)) - _words(F.col("__last"))).alias("last_word"),
        F.array_sort(F.array_distinct(base)).alias("__base"),
        F.sort_array(F.transform("__found", lambda d: F.struct(d["start"].alias("start"), d["length"].alias("length"), d["rule"].alias("rule"), d["label"].alias("label"), d["priority"].alias("priority"), d["matched"].alias("matched")))).alias("detections"),
    )
    labels = F.array_sort(F.array_union("__base", F.transform("detections", lambda d: d["label"])))
    best = F.array_max(F.transform("detections", lambda d: F.element_at(weights, d["priority"])))
    return rows.select(
        id_col, "n_words", "n_base", "first_word", "last_word", F.array_join("__base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("__base") > 0, BASE_WEIGHT).otherwise(0.0)).alias("score"), "detections",
    )
