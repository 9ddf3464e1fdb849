"""Licence scan: rules are as they must be, the query equals its SQL and a plain version, odd inputs."""

import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import Row

from graphloom.llm import license_scan, queries
from graphloom.llm.license_rules import RULES, WEIGHTS, parse

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text, rules=RULES):
    """All matches in the whole line, each held against all others."""
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    line = "".join(f" {w} " for w in words)
    hits = [(m.start(), m.end(), r) for r in rules if f" {r.keyword} " in line for m in re.finditer(r.pattern, line)]
    kept = [
        (a, z, r) for a, z, r in hits
        if not any((c < z and a < d and q.priority < r.priority) or (c <= a and d >= z and q.priority == r.priority and (d - c > z - a or q.rule < r.rule)) for c, d, q in hits)
    ]
    places = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    base = {label for _, label in places}
    score = max([0.0, *(WEIGHTS[r.priority] for *_, r in kept), *([license_scan.BASE_WEIGHT] if base else [])])
    starts = [k for k, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {r.label for *_, r in kept})), score)


def rows_of(df):
    return [tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) for r in df.orderBy("doc_id").collect()]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def expand(signature):
    """A few strings that a rule matches: every alternative, every optional part in and out (in turn)."""
    def choices(s):
        out, i = [""], 0
        while i < len(s):
            if s.startswith("(?:", i):
                depth, j = 1, i + 3
                while depth:
                    depth += {"(": 1, ")": -1}.get(s[j], 0)
                    j += 1
                inner, parts, level, part = s[i + 3 : j - 1], [], 0, ""
                for c in inner:
                    level += {"(": 1, ")": -1}.get(c, 0)
                    if c == "|" and not level:
                        parts.append(part)
                        part = ""
                    else:
                        part += c
                opts = [x for p in [*parts, part] for x in choices(p)]
                if s[j : j + 1] == "?":
                    opts, j = ["", *opts], j + 1
                out = [a + b for a, b in itertools.islice(itertools.product(out, opts), 4000)]
                i = j
            elif s[i] == "[":
                j = s.index("]", i)
                c = s[i + 1]
                opts, j = ([c, ""] if s[j + 1 : j + 2] == "?" else [c]), j + 1 + (s[j + 1 : j + 2] == "?")
                out, i = [a + b for a in out for b in opts], j
            elif s[i + 1 : i + 2] == "?":
                out, i = [a + b for a in out for b in (s[i], "")], i + 2
            else:
                out, i = [a + s[i] for a in out], i + 1
        return out

    return choices(signature)


def test_rules_are_hundreds_and_obey_what_the_scan_relies_on():
    assert len(RULES) >= 250 and [r.rule for r in RULES] == list(range(len(RULES)))
    assert len({r.pattern for r in RULES}) == len(RULES)
    for r in RULES:
        assert not re.search(r"[*+{.\\^$]", r.signature), r
        for match in expand(r.signature):
            assert re.fullmatch(r.pattern, license_scan.spaced(match)), (r, match)
            assert r.keyword in match.split(), (r, match)
            assert 2 * len(license_scan.spaced(match)) < license_scan.MARGIN
            words = match.split()
            # What matches from inside a match on doesn't go beyond it.
            for k in range(1, len(words)):
                inner = re.match(r.pattern, license_scan.spaced(" ".join([*words[k:], *words])))
                assert not inner or inner.end() <= len(license_scan.spaced(" ".join(words[k:]))), (r, match)


def test_query_equals_its_sql_and_the_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.op11_licenses(spark, folder)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = db.execute(queries.ORACLES["op11_licenses"])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, got.select(*names).collect())) == sorted(str(Row(**dict(zip(names, r, strict=True)))) for r in want.fetchall())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert [tuple(r)[1:] for r in got.orderBy("doc_id").collect()] == [plain(texts[k]) for k in sorted(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_long_texts_of_rule_words_equal_the_plain_version(spark, seed):
    """Texts beyond one stretch, full of overlapping matches, some across the cuts."""
    rnd = random.Random(seed)
    pieces = [m for r in RULES for m in expand(r.signature)[:2]] + ["cc by", "General Public-License", "ALL\nrights;reserved", "öffentlich", "x" * 300]
    texts = [" ".join(rnd.choice(pieces) for _ in range(n)) for n in (0, 1, 3, 30, 400, 900)]
    texts += ["gnu general public license " * 1500, "a" * 4090 + " mit license", "cc by " * 3000]
    assert rows_of(license_scan.scan_licenses(docs(spark, texts))) == [plain(t) for t in texts]


def test_priority_and_containment(spark):
    texts = ["Licensed under the GNU General Public License, version 3.", "CC BY-NC 4.0", "mit license, mit license", "the new bsd license. © 2020"]
    got = {r.doc_id: [(d.label, d.matched) for d in r.detections] for r in license_scan.scan_licenses(docs(spark, texts)).collect()}
    assert got[0] == [("gpl-3.0", "licensed under the gnu general public license version 3")]
    assert got[1] == [("cc-by-nc", "cc by nc 4 0")]
    assert got[2] == [("mit", "mit license")] * 2
    assert got[3] == [("bsd-3-clause", "new bsd license")]
    # One of a higher priority wins over a longer one that it overlaps.
    own = parse("1 | short | b | b c\n2 | long | b | a b c d\n2 | other | e | d e")
    r = license_scan.scan_licenses(docs(spark, ["a b c d e"]), rules=own).first()
    assert r.labels == "other,short"


def test_letters_whose_lower_case_is_ascii_are_not(spark):
    texts = ["all rights reserKed", "alİ rights reserved", "ALL RIGHTS RESERVED", "LİCENSE MIT", "MIT LİCENSE", "bacK"]
    assert rows_of(license_scan.scan_licenses(docs(spark, texts))) == [plain(t) for t in texts]


def test_odd_rows(spark):
    odd = spark.createDataFrame(
        [(1, None, 5, "x"), (None, "mit license", 6, "y"), (None, "mit license", 6, "y"), (2, "", 7, "z"), (3, " \n.;-", 8, "z")], "doc_id long, text string, n_words long, __line string")
    got = [tuple(r)[:8] for r in license_scan.scan_licenses(odd).orderBy("doc_id").collect()]
    assert got == [(None, 2, 0, None, None, "", "mit", 0.7)] * 2 + [(k, 0, 0, None, None, "", "", 0.0) for k in (1, 2, 3)]
    assert license_scan.scan_licenses(odd.limit(0)).count() == 0


def test_nothing_but_built_in_functions(spark):
    plan = license_scan.scan_licenses(docs(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
