"""Context packs: what fits a token budget, section by section, and how a pack is written out."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.schema import CONTEXT_KINDS
from graphloom.shared import stored

#: Numbers of the sieve over targets: what is broadcast is as many small integers at most.
SIEVE = 1 << 20
#: Sections in the order in which they are tried. The first always goes in; the edges go in all at once or not at all.
SECTIONS = ("target", "target_docs", "target_tests", "edges", "symbols", "docs", "tests")


def fit(items: list[tuple[int, int]], budget: int | None) -> list[bool]:
    """Which of ``(section, tokens)`` items, in order, go into the pack.

    A section stops at its first item that doesn't fit, and later sections are still tried. For the few items of one target; ``pack``
    does the same for all targets.
    """
    used, stopped, out = 0, set(), [False] * len(items)
    whole = sum(n for s, n in items if s == 3)
    for k, (section, tokens) in enumerate(items):
        if section == 0 or budget is None:
            ok = True
        elif section == 3:
            ok = section not in stopped and (out[k - 1] if k and items[k - 1][0] == 3 else used + whole <= budget)
        else:
            ok = section not in stopped and used + tokens <= budget
        if ok:
            used += tokens
        else:
            stopped.add(section)
        out[k] = ok
    return out


def pack(items: DataFrame, budget: int | None) -> DataFrame:
    """Items that fit, for all targets at once. ``items``: target, section (number), position, item, tokens.

    Without a budget all go in. With one, a section ends at its first item that doesn't fit, and later sections are still tried with
    the room that is left. An item has a token at least, so running sums rise, what fits of a section is its beginning, and only the first
    ``budget + 1`` items of a section can matter: a hub's other items are left behind before rows of a target meet. The room is
    passed on from section to section over each target's running sums, at most ``budget`` numbers a section.
    """
    columns = ["target", "section", "position", "item", "tokens"]
    if budget is None:
        return items.select(*columns)
    rows = items.select(*columns[:4], F.greatest("tokens", F.lit(1)).alias("tokens"))
    return _fitting(_beginnings(rows, budget), budget).select(*columns)


def _beginnings(rows: DataFrame, budget: int) -> DataFrame:
    """Rows of the first ``budget + 1`` items of each section, and all of the target's own, which rank alike. Rows are shuffled once, by section, after the limit."""
    other = F.col("section") != 0
    order = Window.partitionBy("target", "section").orderBy(F.when(other, F.col("position")), F.when(other, F.col("item")))
    return rows.withColumn("__rank", F.dense_rank().over(order)).filter(F.col("__rank") <= budget + 1).drop("__rank")


def _fitting(ranked: DataFrame, budget: int) -> DataFrame:
    # Equal items of equal tokens are interchangeable; all others have one order.
    sums = ranked.withColumn("__sum", F.sum("tokens").over(Window.partitionBy("target", "section").orderBy("position", "item", "tokens").rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.col("section").isin(0, 3)
    room = sums.groupBy("target", "section").agg(F.max("__sum").alias("total"), F.collect_list(F.when(~whole & (F.col("__sum") <= budget), F.col("__sum"))).alias("sums"))
    room = room.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("section", "total", "sums"))).alias("parts"))

    def step(state: Column, part: Column) -> Column:
        left = F.lit(budget).cast("long") - state["used"]
        # The most that may be in: all of the target, all edges or none, of others what their running sums let in.
        most = F.when(part["section"] == 0, part["total"]).when(part["section"] == 3, F.when(part["total"] <= left, part["total"]).otherwise(-1)).otherwise(left)
        taken = F.when(part["section"].isin(0, 3), F.greatest(most, F.lit(0))).otherwise(F.coalesce(F.array_max(F.filter(part["sums"], lambda x: x <= left)), F.lit(0)))
        return F.struct((state["used"] + taken).alias("used"), F.concat(state["rooms"], F.array(F.struct(part["section"].alias("section"), most.alias("most")))).alias("rooms"))

    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<section: {ranked.schema['section'].dataType.simpleString()}, most: bigint>>").alias("rooms"))
    rooms = room.select("target", F.explode(F.aggregate("parts", start, step, lambda s: s["rooms"])).alias("r")).select("target", "r.section", "r.most")
    sums = sums.filter((F.col("section") == 0) | (F.col("__sum") <= budget))
    return sums.join(rooms, ["target", "section"]).filter(F.col("__sum") <= F.col("most"))


def _touching(g, targets: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``target, other, kind, out``: edges at targets. Most others end at a broadcast sieve of at most ``SIEVE`` numbers, which goes below the edges' aggregation."""
    own = targets.select(F.col("id").alias("target"))
    number = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE)).cast("int")
    sieve = F.broadcast(own.select(number("target").alias("number")).distinct())
    edges = g.edges.filter(F.col("kind").isin(*kinds) & F.col("target_symbol_id").isNotNull())
    end = lambda at, other, out: edges.join(sieve, number(at) == F.col("number"), "left_semi").join(own, F.col(at) == F.col("target"), "left_semi").select(F.col(at).alias("target"), F.col(other).alias("other"), "kind", F.lit(out).alias("out"))
    return end("source_symbol_id", "target_symbol_id", True).unionByName(end("target_symbol_id", "source_symbol_id", False))


class _Items:
    """``target, section, item``, with repeated ones, of the sections before and behind the room that is left; ``at``: target, id."""

    def __init__(self, g, targets: DataFrame, links: DataFrame, kinds: tuple[str, ...]):
        self.own = targets.select(F.col("id").alias("target")).distinct()
        names = g.symbols.select("id", "kind", "qualified_name")
        self.touching = _touching(g, targets, kinds)
        self.documents = g.docs.select(F.col("symbol_id").alias("id"), F.col("path").alias("item"))
        named = names.select(F.col("id").alias("source_symbol_id"), F.col("qualified_name").alias("item"))
        self.tests = links.join(named.hint("merge"), "source_symbol_id").select(F.col("target_symbol_id").alias("id"), "item")
        self.named = names.join(targets.select("id"), "id", "left_semi").select(F.col("id").alias("target"), F.col("kind").alias("own_kind"), F.col("qualified_name").alias("own_name"))
        self.others = names.select(F.col("id").alias("other"), F.col("kind").alias("other_kind"), F.col("qualified_name").alias("other_name"))

    def docs(self, at: DataFrame, section: int) -> DataFrame:
        return at.join(self.documents, "id").select("target", F.lit(section).alias("section"), "item", *at.columns[2:])

    def tested(self, at: DataFrame, section: int) -> DataFrame:
        return at.join(self.tests.hint("merge"), "id").select("target", F.lit(section).alias("section"), "item", *at.columns[2:])

    def first(self) -> DataFrame:
        whole = self.own.withColumn("id", F.col("target"))
        label = lambda p: F.concat_ws(" ", f"{p}_kind", f"{p}_name")
        ends = F.when(F.col("out"), F.concat("own_name", F.lit(" -> "), "other_name")).otherwise(F.concat("other_name", F.lit(" -> "), "own_name"))
        line = F.concat("kind", F.lit(" "), ends)
        met = self.touching.join(self.named, "target", "left").join(self.others.hint("merge"), "other")
        # One pass for edges and the symbols at their other ends.
        beside = met.select("target", F.inline(F.array(F.struct(F.lit(3).alias("section"), line.alias("item")), F.struct(F.lit(4).alias("section"), F.when(F.col("other") != F.col("target"), label("other")).alias("item")))))
        return self.named.select("target", F.lit(0).alias("section"), label("own").alias("item")).unionByName(self.docs(whole, 1)).unionByName(self.tested(whole, 2)).unionByName(beside).filter("item IS NOT NULL")

    def beside(self) -> DataFrame:
        return self.touching.filter("other <> target").select("target", F.col("other").alias("id")).distinct()


def _costed(rows: DataFrame) -> DataFrame:
    return rows.select("target", "section", F.lit(0).alias("position"), "item", F.ceil(F.char_length("item") / F.lit(4.0)).cast("long").alias("tokens"))


def items(g, targets: DataFrame, links: DataFrame, kinds: tuple[str, ...] = CONTEXT_KINDS) -> DataFrame:
    """Items of all seven sections for all targets at once (``targets``: id), as ``pack`` takes them.

    The target; its docs; the tests that are linked with it (``links``: source_symbol_id of the test, target_symbol_id); its edges in either
    direction; the symbols at their other ends; those symbols' docs and tests. Each is found by joins on ids. Items of a section are distinct
    and in order of their texts; tokens are estimated from them.
    """
    found = _Items(g, targets, links, kinds)
    beside = found.beside()
    rows = found.first().unionByName(found.docs(beside, 5)).unionByName(found.tested(beside, 6)).filter("item IS NOT NULL")
    return _costed(rows.distinct())


def packs(g, targets: DataFrame, links: DataFrame, budget: int | None, kinds: tuple[str, ...] = CONTEXT_KINDS) -> DataFrame:
    """``pack(items(...), budget)`` without all of those items: docs and tests of neighbouring symbols, most of them, are only
    gathered as far as they have room in what the sections before have left.

    Of those that are longer than the room the first of a section is kept, as a section ends there. What is used already goes before them as a target's own item.
    """
    if budget is None:
        return pack(items(g, targets, links, kinds), None)
    found = _Items(g, targets, links, kinds)
    found.touching = stored(found.touching)  # asked for twice, with and without kinds: made once, and its shuffles are gone before the others begin
    columns = ["target", "section", "position", "item", "tokens"]
    some = lambda rows: rows.withColumn("tokens", F.greatest("tokens", F.lit(1)))
    begun = _beginnings(found.first().withColumn("position", F.lit(0)), budget).distinct()
    early = _fitting(some(_costed(begun)), budget).select(*columns)
    used = early.groupBy("target").agg(F.sum("tokens").alias("used"))
    room = found.own.join(used.hint("merge"), "target", "left").select("target", F.coalesce("used", F.lit(0)).alias("used")).filter(F.col("used") < budget)
    at = found.beside().join(room.hint("merge"), "target").select("target", "id", "used")
    rows = found.docs(at, 5).unionByName(found.tested(at, 6)).filter("item IS NOT NULL")
    fits = F.greatest(F.ceil(F.char_length("item") / F.lit(4.0)), F.lit(1)) + F.col("used") <= budget
    rows = rows.groupBy("target", "section", F.when(fits, F.col("item")).alias("fits")).agg(F.min("item").alias("item"))
    before = room.filter("used > 0").select("target", F.lit(0).alias("section"), F.lit(0).alias("position"), F.lit("").alias("item"), F.col("used").alias("tokens"))
    late = _fitting(_beginnings(some(_costed(rows)).unionByName(before), budget), budget).filter("section <> 0").select(*columns)
    return early.unionByName(late)


def as_json(packed: DataFrame) -> DataFrame:
    """``target, json``: each pack as an object with its sections by name, in order, and their items."""
    names = F.array(*(F.lit(s) for s in SECTIONS))
    parts = packed.groupBy("target", "section").agg(F.sort_array(F.collect_list(F.struct("position", "item"))).alias("items"))
    one = F.struct("section", F.to_json(F.struct(F.element_at(names, F.col("section") + 1).alias("section"), F.transform("items", lambda x: x["item"]).alias("items"))).alias("text"))
    body = parts.select("target", one.alias("one")).groupBy("target").agg(F.array_join(F.transform(F.sort_array(F.collect_list("one")), lambda x: x["text"]), ",").alias("body"))
    return body.select("target", F.concat(F.lit('{"target":'), F.col("target").cast("string"), F.lit(',"sections":['), "body", F.lit("]}")).alias("json"))


def rendered(packed: DataFrame) -> DataFrame:
    """``target, text``: each pack as Markdown, its sections in order. A pack is as long as its budget at most, or was asked for whole."""
    names = F.array(*(F.lit(s) for s in SECTIONS))
    items = packed.groupBy("target", "section").agg(F.sort_array(F.collect_list(F.struct("position", "item"))).alias("items"))
    part = F.concat(F.lit("## "), F.element_at(names, F.col("section") + 1), F.lit("\n"), F.array_join(F.transform("items", lambda x: F.concat(F.lit("- "), x["item"])), "\n"), F.lit("\n"))
    body = items.select("target", "section", part.alias("part")).groupBy("target").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "part"))), lambda x: x["part"]), "\n").alias("body"))
    head = F.concat(F.lit("# Context: "), F.col("target").cast("string"), F.lit("\n"))
    estimate = F.ceil(F.char_length(F.concat(head, "body")) / F.lit(4.0)).cast("string")
    return body.select("target", F.concat(head, F.lit("- Estimated Tokens: "), estimate, F.lit("\n\n"), F.col("body")).alias("text"))


def tokens(text: str) -> int:
    return math.ceil(len(text) / 4)


def markdown(target: str, sections: dict[str, list[str]]) -> str:
    """A pack as Markdown; the estimate doesn't count its own line."""
    body = "\n".join(line for name, items in sections.items() if items for line in (f"## {name}", *(f"- {x}" for x in items), ""))
    head = f"# Context: {target}\n"
    return f"{head}- Estimated Tokens: {tokens(head + body)}\n\n{body}"
