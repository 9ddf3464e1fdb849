"""Conversation structure repair: the cheapest edits that give the roles an alternating order, by alignment with target strings.

Targets are the strings of the grammar ``(s?(ua)+)?`` over role initials. A stretch of turns is aligned with every feasible length
of the alternating string by the Wagner-Fischer table (all lengths are columns of one table), kept to an Ukkonen band: cells that
can't come under the cost of a known solution aren't made. Of the cheapest alignments the least audit is traced back.

Long conversations are cut into segments of ``SEGMENT`` rows, aligned from each state of the grammar to each other; segments are
then joined by the cheapest way through them. An audit's segment ends with an edit of a row, so insertions belong to the row behind
them; two audits of the same rows are therefore never one the beginning of the other, and least audits of segments make the
least audit of the whole.

Work on Spark: equal rows are counted, the first of equal messages is found by a join on digests, and rows are put in order by range,
so that a conversation of any share of the table is spread over many tasks, which flag, count and align. A short conversation
inside one partition is finished there. Of others the segments (tables, counts, texts that can be kept) are folded in order in one streaming
pass that holds one batch and four states: joining tables is cheap, and a SHA-256 over a conversation's text can't be computed out of order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import by_bytes, cut, sieve_join
from graphloom.shipping import ship

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the grammar: nothing yet, after the system's turn, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_NAMES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"
#: Rows of a segment.
SEGMENT = 32
#: ``_EMULATE[a][b]``: what it costs at most to go on from state a as one could from b. Used to drop states that can't win.
_EMULATE = {ASSISTANT: {START: 4, SYSTEM: 0, USER: 3}, USER: {ASSISTANT: 3, SYSTEM: 3, START: 7}, START: {ASSISTANT: 0, SYSTEM: 0, USER: 3}, SYSTEM: {}}

#: A row's class: x must go; else its initial (o: none of s, u, a), in upper case if its text is truncated.
Solution = tuple[int, str]


def _expected(state: int) -> str:
    return "a" if state == USER else "u"


def _free_cost(c: str) -> int:
    """What a row costs in any case."""
    return DELETE if c == "x" else TRUNCATED if c.isupper() else 0


def _aligned(classes: str, target: str, rest: list[int], bound: int) -> list[dict[int, int]]:
    """The table's rows within the band: how far along the target, and at what cost. ``rest``: what the rows from each on cost in any case."""
    table = [{0: 0}]
    for i, c in enumerate(classes):
        row, most = table[i], bound - rest[i]
        j = 0
        while j <= max(row):  # insertions before this row
            if j in row and j < len(target) and target[j] != "s" and row[j] + INSERT <= most and row[j] + INSERT < row.get(j + 1, bound + 1):
                row[j + 1] = row[j] + INSERT
            j += 1
        below, most = {}, bound - rest[i + 1]
        for j, cost in row.items():
            if cost + DELETE <= most and cost + DELETE < below.get(j, bound + 1):
                below[j] = cost + DELETE
            if c != "x" and j < len(target) and (edit := _edit(c, target[j])) is not None and cost + edit <= most and cost + edit < below.get(j + 1, bound + 1):
                below[j + 1] = cost + edit
        table.append(below)
        if not below:
            break
    return table


def _edit(c: str, wanted: str) -> int | None:
    """Cost of letting a row stand for a letter of the target; only a row of the system's can stand for its letter."""
    own = TRUNCATED if c.isupper() else 0
    return own if c.lower() == wanted else None if wanted == "s" else own + REROLE


def _traced(classes: str, target: str, table: list[dict[int, int]], length: int) -> str:
    """The least of the cheapest audits that reach ``length`` letters of the target."""
    n = len(classes)
    good = [set() for _ in range(n + 1)]
    good[n].add(length)
    for i in range(n - 1, -1, -1):
        c, row, below = classes[i], table[i], table[i + 1]
        for j, cost in row.items():
            if (j in good[i + 1] and below[j] == cost + DELETE) or (c != "x" and j + 1 in good[i + 1] and j < len(target) and (e := _edit(c, target[j])) is not None and below[j + 1] == cost + e):
                good[i].add(j)
        for j in sorted(row, reverse=True):
            if j + 1 in good[i] and target[j] != "s" and row[j + 1] == row[j] + INSERT:
                good[i].add(j)
    out, i, j = [], 0, 0
    while i < n:
        c, cost = classes[i], table[i][j]
        if j in good[i + 1] and table[i + 1][j] == cost + DELETE:
            out.append("D")
            i += 1
        elif j + 1 in good[i] and target[j] != "s" and table[i][j + 1] == cost + INSERT:
            out.append("I")
            j += 1
        else:
            out.append("K" if c.lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return "".join(out)


@lru_cache(1 << 14)
def align(classes: str, entry: int) -> dict[int, Solution]:
    """For each state in which the rows can leave the grammar when they enter in ``entry``: least cost, and the least audit of that cost."""
    n = len(classes)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + _free_cost(classes[i])
    best: dict[int, Solution] = {entry: (DELETE * n, "D" * n)}

    def offer(state: int, cost: int, audit) -> None:
        if state not in best or cost <= best[state][0]:
            best[state] = min(best.get(state, (cost + 1, "")), (cost, audit()))

    # A known solution: keep or rerole all that may stay. Any other state is at most an insertion and a deletion away from it.
    known, state = 0, entry
    for c in classes:
        known += DELETE if c == "x" else _edit(c, _expected(state))
        state = state if c == "x" else _AFTER[_expected(state)]
    for head in ("", "s") if entry == START else ("",):
        first = "au" if entry == USER else "ua"
        target = head + (first * (n + 4))[: 2 * n + 4]
        if head:  # the system's turn and nothing else
            for i, c in enumerate(classes):
                if c.lower() == "s":
                    offer(SYSTEM, DELETE * (n - 1) + _free_cost(c), lambda i=i: "D" * i + "K" + "D" * (n - 1 - i))
        table = _aligned(classes, target, rest, known + INSERT + DELETE)
        if len(table) <= n:
            continue
        for length, cost in table[n].items():
            if length > len(head):
                offer(_AFTER[target[length - 1]], cost, lambda length=length: _traced(classes, target, table, length))  # noqa: B023
    return best


def _closing(state: int) -> str:
    """Insertions that end the grammar from a state."""
    return {USER: "I", SYSTEM: "II"}.get(state, "")


def pieces(audit: str, rows: Iterator[tuple[str, str]], classes: str, state: int) -> Iterator[str]:
    """``role:text`` of each turn that an audit leaves; ``rows`` are those that aren't of class x."""
    i = 0
    for op in audit:
        if op == "I":
            state = _AFTER[_expected(state)]
            yield f"{'assistant' if state == ASSISTANT else 'user'}:"
            continue
        c = classes[i]
        role, text = next(rows) if c != "x" else ("", "")
        i += 1
        if op == "K":
            state = _AFTER[c.lower()]
            yield f"{role}:{text}"
        elif op == "R":
            name = _expected(state)
            state = _AFTER[name]
            yield f"{_NAMES[name]}:{text}"


@dataclass
class Part:
    """Rows of one conversation that stand together, in order; counts are of these rows alone."""

    classes: str = ""
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None  # initials of the first and last row
    last: str | None = None
    low: int | None = None  # turns that aren't null are in order
    high: int | None = None
    turns: int = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, first: bool, blank: bool, truncated: bool) -> None:
        """The rows of one (turn, role, text), as many as there are copies."""
        if not copies:
            return
        initial = role[:1]
        if blank:
            self.blank += copies
            self.classes += "x" * copies
        else:
            self.duplicate += copies - first
            if first:
                self.truncated += truncated
                c = initial if initial in ("s", "u", "a") else "o"
                self.classes += c.upper() if truncated else c
                self.roles.append(role)
                self.texts.append(text)
            self.classes += "x" * (copies - first)
        self.illegal += copies - 1 + (self.last is not None and self.last + initial not in ("su", "ua", "au"))
        self.first = initial if self.first is None else self.first
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn

    def join(self, other: Part) -> None:
        """Count the rows of ``other`` behind these."""
        self.blank, self.duplicate, self.truncated = self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated
        if other.first is not None:
            self.illegal += other.illegal + (self.last is not None and self.last + other.first not in ("su", "ua", "au"))
            self.first, self.last = other.first if self.first is None else self.first, other.last
        if other.low is not None:
            self.turns += other.turns - (self.high == other.low)
            self.low, self.high = other.low if self.low is None else self.low, other.high

    def counts(self) -> tuple[int, int, int, int, int]:
        return (self.high - self.low + 1 - self.turns if self.low is not None else 0, self.blank, self.duplicate, self.truncated, self.illegal)


class _Way:
    """The best way to a state: its cost, its place among the others' audits, its last segment and the way before it, and the text's hash so far."""

    __slots__ = ("cost", "rank", "audit", "before", "sha")

    def __init__(self, cost: int, rank: int, audit: str, before: _Way | None, sha):
        self.cost, self.rank, self.audit, self.before, self.sha = cost, rank, audit, before, sha


class Fold:
    """Parts of one conversation put together in order."""

    def __init__(self) -> None:
        self.part, self.ways = Part(), {START: _Way(0, 0, "", None, hashlib.sha256())}

    def add(self, part: Part) -> None:
        self.part.join(part)
        if not part.classes:
            return
        found: dict[int, tuple] = {}
        for state, way in self.ways.items():
            for to, (cost, audit) in align(part.classes, state).items():
                found[to] = min(found.get(to, (1 << 62,)), (way.cost + cost, way.rank, audit, state))
        costs = {t: x[0] for t, x in found.items()}
        alive = [t for t in found if not any(costs[a] + more < costs[t] for a in found for b, more in _EMULATE[a].items() if b == t)]
        ways = {}
        for rank, t in enumerate(sorted(alive, key=lambda t: found[t][1:3])):
            cost, _, audit, state = found[t]
            ways[t] = _Way(cost, rank, audit, self.ways[state], _fed(self.ways[state].sha.copy(), pieces(audit, zip(part.roles, part.texts, strict=True), part.classes, state), state))
        self.ways = ways

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        state, way = min(self.ways.items(), key=lambda x: (x[1].cost + INSERT * len(_closing(x[0])), x[1].rank))
        closing = _closing(state)
        sha = _fed(way.sha.copy(), pieces(closing, iter(()), "", state), state)
        out, cost = [closing], way.cost + INSERT * len(closing)
        while way is not None:
            out.append(way.audit)
            way = way.before
        return (*self.part.counts(), cost, "".join(reversed(out)), sha.hexdigest())


def _fed(sha, lines: Iterator[str], state: int):
    """The hash, fed with more lines; in ``START`` there are none before them."""
    between = state != START
    for line in lines:
        if between:
            sha.update(b"\n")
        sha.update(line.encode("utf-8", "surrogatepass"))
        between = True
    return sha


# --- on Spark ------------------------------------------------------------------------------------------------------

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT = [x.split()[0] for x in RESULT.split(", ")]
_PART = "part int, seq long, classes string, roles array<string>, texts array<string>, n_blank long, n_duplicate long, n_truncated long, n_illegal long, first_initial string, last_initial string, low long, high long, turns long"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def _schema(of: str) -> list[tuple[str, pa.DataType]]:
    return [(n, _ARROW[k]) for n, k in (x.split() for x in of.split(", "))]


def _batch(rows: list[tuple], names: list[tuple[str, pa.DataType]], id_type: pa.DataType, id_col: str) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [id_type, *(t for _, t in names)], strict=True)], names=[id_col, *(n for n, _ in names)])


#: Rows and bytes of text after which a batch of results is sent on.
_ROWS, _BYTES = 2000, 4 << 20


def _first_pass(id_col: str, segment: int):
    """Rows in order -> finished conversations (result columns) and parts of others (part columns)."""
    results, parts = _schema(RESULT), _schema(_PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seq, id_type = TaskContext.get().partitionId(), 0, None
        key, part, edge, sent = None, None, True, False
        out, held = [], 0
        no_result, no_part = (None,) * len(results), (None,) * len(parts)

        def ship_part() -> None:
            nonlocal seq, held
            p = part
            out.append((key, *no_result, number, seq, p.classes, p.roles, p.texts, p.blank, p.duplicate, p.truncated, p.illegal, p.first, p.last, p.low, p.high, p.turns))
            held += sum(map(len, p.texts))
            seq += 1

        def done(last: bool) -> None:
            """A conversation's rows in this partition are over. It may go on before or behind it."""
            if part is None:
                return
            if edge or last or sent:
                ship_part()
            else:
                fold = Fold()
                fold.add(part)
                out.append((key, *fold.result(), *no_part))

        for batch in batches:
            id_type = batch.column(0).type
            for piece in by_bytes(iter([batch]), 3):
                for conv, turn, role, text, copies, first, blank, truncated in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    if part is None or conv != key:
                        done(False)
                        edge = part is None
                        key, part, sent = conv, Part(), False
                    while copies >= 0:
                        now = min(copies, segment)  # a message that is repeated very often is cut, too
                        part.add(turn, role, text, now, first, blank, truncated)
                        copies, first = copies - now if copies > now else -1, False
                        if len(part.classes) >= segment and copies > 0:
                            ship_part()
                            part, sent = Part(), True
                    if len(part.classes) >= segment:
                        ship_part()
                        part, sent = Part(), True
                if out and (len(out) >= _ROWS or held >= _BYTES):
                    yield _batch(out, [*results, *parts], id_type, id_col)
                    out, held = [], 0
        done(True)
        if out:
            yield _batch(out, [*results, *parts], id_type, id_col)

    return run


def _second_pass(id_col: str):
    """Parts in order -> finished conversations."""
    results = _schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold, out, id_type = None, None, [], None
        for batch in batches:
            id_type = batch.column(0).type
            for k in range(batch.num_rows):
                conv, _, _, classes, roles, texts, *counts = (c[k].as_py() for c in batch.columns)
                if fold is None or conv != key:
                    if fold is not None:
                        out.append((key, *fold.result()))
                    key, fold = conv, Fold()
                fold.add(Part(classes, roles, texts, *counts))
            if len(out) >= _ROWS:
                yield _batch(out, results, id_type, id_col)
                out = []
        if fold is not None:
            out.append((key, *fold.result()))
        if out:
            yield _batch(out, results, id_type, id_col)

    return run


def _stripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE))


def repair_conversations(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None, segment: int = SEGMENT
) -> DataFrame:
    """One row per conversation: its id, gaps in its turns, numbers of blank, duplicate, truncated and illegal turns, and its cheapest repair.

    Rows are taken by turn, nulls first; rows of one turn by role and text. A null role or text counts as one space. A role's
    initial is its first character; an empty role has none. ``copies`` says how often a row counts (default 1); one that counts 0
    times only names its conversation, whose result then has zeros and an empty audit if it has no other rows. A null id is a conversation
    like others. Repeated rows count as often as they stand there. Other columns are ignored, whatever their names; an empty
    table gives an empty result. Turns are whole numbers; texts may be of any length.
    """
    ship(rows.sparkSession)
    n = F.lit(1) if copies is None else copies
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit(" ")), F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    named = rows.select(F.col(id_col).alias("__conv"), F.col(turn_col).cast("long").alias("__turn"), role.alias("__role"), text.alias("__text"), n.cast("long").alias("__copies"))
    none = F.col("__copies") == 0  # these share one row per conversation
    named = named.select(
        "__conv", F.when(~none, F.col("__turn")).alias("__turn"), F.when(none, "").otherwise(F.col("__role")).alias("__role"), F.when(none, "").otherwise(F.col("__text")).alias("__text"), "__copies")
    counted = named.groupBy("__conv", "__turn", "__role", "__text").agg(F.sum("__copies").alias("__copies"))
    end = F.right(_stripped(F.col("__text")), F.lit(1))
    flagged = cut(counted.withColumn("__blank", end == "").withColumn("__truncated", (end != "") & ~end.isin(".", "!", "?")).withColumn("__digest", F.unhex(F.sha2(F.concat_ws("\n", "__role", "__text"), 256))))
    # Of equal messages in one conversation the first stays: the one without a turn, or that of the least turn.
    known = F.struct(F.col("__conv").isNotNull().alias("known"), F.col("__conv").alias("id"))
    seen = flagged.filter(~F.col("__blank")).groupBy(known.alias("__key"), "__digest").agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(F.col("__turn").isNotNull(), F.col("__turn"))).alias("__first"))
    repeated = cut(seen.filter("__n > 1").select("__key", "__digest", "__first"))
    keyed = flagged.withColumn("__key", known)
    alone = sieve_join(keyed, repeated, "__key", "__digest", anti=True).withColumn("__is_first", F.lit(True))
    looked = sieve_join(keyed, repeated, "__key", "__digest").join(repeated.hint("merge"), ["__key", "__digest"], "left")
    looked = looked.withColumn("__is_first", F.col("__first").isNull() | F.col("__first.__turn").eqNullSafe(F.col("__turn")))
    columns = ["__conv", "__turn", "__role", "__text", "__copies", "__is_first", "__blank", "__truncated"]
    marked = alone.select(columns).unionByName(looked.select(columns))
    order = [F.col("__conv").asc_nulls_first(), F.col("__turn").asc_nulls_first(), "__role"]
    ordered = marked.repartitionByRange(*order, F.left("__text", F.lit(256))).sortWithinPartitions(*order, "__text")

    kind = T.StructType([T.StructField("__conv", rows.schema[id_col].dataType)])
    first_schema = T.StructType([*kind, *T._parse_datatype_string(f"{RESULT}, {_PART}")])
    passed = cut(ordered.mapInArrow(_first_pass("__conv", segment), first_schema))
    over = passed.filter("part IS NULL").select("__conv", *_RESULT)
    open_parts = passed.filter("part IS NOT NULL").drop(*_RESULT)
    in_order = open_parts.repartition("__conv").sortWithinPartitions("__conv", "part", "seq")
    rest = in_order.mapInArrow(_second_pass("__conv"), T.StructType([*kind, *T._parse_datatype_string(RESULT)]))
    return over.unionByName(rest).withColumnRenamed("__conv", id_col)
