"""Benchmark decontamination with one Aho-Corasick automaton, scanned once over each text.

Item texts are normalised to words, and every window of consecutive words becomes a pattern. Documents are normalised the
same way by byte tables (no per-word Python), scanned once, and the hits are mapped back to character spans of the original.
The automaton goes over words, numbered by the benchmark's vocabulary. Its patterns are seeds: every sixth run of five words
of an item, one of which lies in each window of ten; so an item costs a few nodes a word, not ten windows of sixty bytes. Where a
seed is met, the windows around it are looked up in the table of all windows, which makes the result exact.

The automaton is built once in each worker process from the items' texts. These are shipped in blocks of at most
``max_block_bytes``; a larger benchmark takes more blocks, each with an automaton of its own, and the hits are merged.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import as_bytes, by_bytes
from graphloom.shipping import shipped

WINDOW = 10
#: Some 700,000 windows, which take about 300 MB in a worker.
MAX_BLOCK_BYTES = 4 << 20

#: Bytes of words: digits, letters (lower-cased) and everything that isn't ASCII; all else separates.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def windows_of(text: bytes, size: int = WINDOW) -> list[bytes]:
    words = words_of(text)
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


#: Characters of a word's number: the first from U+0080 on, so that matches begin with a word; the others below. No node then has
#: more than 128 children, which the automaton goes through one by one.
_DIGITS = 3
_UNKNOWN = "\0" * _DIGITS  # stands for all words that no item has


def _number(k: int) -> str:
    """The k-th word's characters; there are two million, more than a block can hold."""
    return chr(128 + (k >> 14)) + chr(k >> 7 & 127) + chr(k & 127)


class Matcher:
    """The automaton of some items, over words, with the table of their windows."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.window, self.seed = window, (window + 1) // 2
        self.numbers: dict[bytes, str] = {}
        self.windows: dict[str, tuple[str, ...]] = {}  # items of each window of full size
        self.short: list[tuple[int, list[str]]] = []  # (words, items) of each item that is shorter than a window
        values: dict[str, int] = {}  # 1: a seed; from 2 on, twice the number of the short item and one more, besides
        for item, text in items:
            words = words_of(text)
            for w in words:
                if w not in self.numbers:
                    self.numbers[w] = _number(len(self.numbers))
            line, n = "".join(map(self.numbers.__getitem__, words)), len(words)
            if 0 < n < window:
                if values.setdefault(line, 0) < 2:
                    self.short.append((n, []))
                    values[line] += 2 * len(self.short)
                self.short[values[line] // 2 - 1][1].append(item)
                continue
            owner = (item,)
            for i in range(0, _DIGITS * (n - window + 1), _DIGITS):
                known = self.windows.setdefault(line[i : i + _DIGITS * window], owner)
                if item not in known:
                    self.windows[line[i : i + _DIGITS * window]] = (*known, item)
            # A window holds a run of seed words that begins at a multiple of the step.
            for i in range(0, n - self.seed + 1 if n >= window else 0, window - self.seed + 1):
                seed = line[_DIGITS * i : _DIGITS * (i + self.seed)]
                values[seed] = values.get(seed, 0) | 1
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for pattern, value in values.items():
            self.automaton.add_word(pattern, value)
        self.empty = not values
        if values:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged word ranges [from, to) that are hit, and the items that hit."""
        words = words_of(text)
        if self.empty or not words:
            return len(words), [], set()
        line, size = "".join(map(self.numbers.get, words, repeat(_UNKNOWN))), self.window
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        tried = 0  # windows that begin before have been looked up
        for end, value in self.automaton.iter(line):
            end //= _DIGITS
            if value > 1:
                n, ids = self.short[value // 2 - 1]
                items.update(ids)
                ranges.append((end - n + 1, end + 1))
            if value & 1:
                last = end - self.seed + 1  # where the seed begins; windows that hold it begin there at the latest
                for at in range(max(tried, end - size + 1), min(last, len(words) - size) + 1):
                    if ids := self.windows.get(line[_DIGITS * at : _DIGITS * (at + size)]):
                        items.update(ids)
                        ranges.append((at, at + size))
                tried = last + 1
        merged: list[tuple[int, int]] = []
        for a, b in sorted(ranges):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return len(words), merged, items


_BUILT: dict[tuple[str, int], Matcher] = {}


def matcher_of(key: str, items: list[tuple[str | None, bytes]], window: int) -> Matcher:
    """The automaton of a block, built once a worker process; only the last one is held."""
    if (key, window) not in _BUILT:
        _BUILT.clear()
        _BUILT[key, window] = Matcher(items, window)
    return _BUILT[key, window]


def char_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as [from, to) in characters of the original text."""
    found = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    out, at, chars = [], 0, 0
    for a, b in ranges:
        first, last = found[a][0], found[b - 1][1]
        chars += len(text[at:first].decode("utf-8", "replace"))
        begin = chars
        chars += len(text[first:last].decode("utf-8", "replace"))
        out.append((begin, chars))
        at = last
    return out


def segments(text: bytes, window: int, max_bytes: int) -> Iterator[bytes]:
    """A text in parts of about ``max_bytes``, or of one window, which overlap so that each window lies in one of them."""
    if len(text) <= max_bytes:
        yield text
        return
    words = words_of(text)
    first, size = 0, 0
    for k, word in enumerate(words):
        size += len(word) + 1
        if k + 1 == len(words) or size >= max_bytes and k + 1 - first >= window:
            yield b" ".join(words[first : k + 1])
            first = k + 2 - window
            size = sum(len(w) + 1 for w in words[max(0, first) : k + 1])


def item_blocks(items: DataFrame, id_col: str, text_col: str, max_block_bytes: int, window: int = WINDOW) -> Iterator[tuple[str, list[tuple[str, bytes]]]]:
    """The items in named blocks of about ``max_block_bytes`` of text; the driver holds one at a time."""
    block, size = [], 0
    rows = items.select(F.col(id_col).cast("string"), F.col(text_col).cast("string").alias("__text")).filter(F.col("__text").isNotNull())
    for item, text in rows.toLocalIterator():
        for raw in segments(text.encode("utf-8", "surrogatepass"), window, max_block_bytes):
            if block and size + len(raw) > max_block_bytes:
                yield uuid.uuid4().hex, block
                block, size = [], 0
            block.append((item, raw))
            size += len(raw)
    yield uuid.uuid4().hex, block


HITS = (
    "n_words long, n_hit long, item_ids array<string>, word_ranges array<struct<first:int,last:int>>, "
    "spans array<struct<start:int,end:int>>"
)


def _scanner(handle, window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of(*handle.value, window)
        pair = lambda a, b: pa.list_(pa.struct([(a, pa.int32()), (b, pa.int32())]))
        for batch in by_bytes(batches, 2):
            rows = [], [], [], [], []
            for text in as_bytes(batch.column(2)).to_pylist():
                n, ranges, items = matcher.scan(text or b"")
                rows[0].append(n)
                rows[1].append(sum(b - a for a, b in ranges))
                rows[2].append(sorted(x for x in items if x is not None))
                rows[3].append([{"first": a, "last": b} for a, b in ranges])
                rows[4].append([{"start": a, "end": b} for a, b in char_spans(text, ranges)] if ranges else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.list_(pa.string())), pa.array(rows[3], pair("first", "last")), pa.array(rows[4], pair("start", "end"))],
                names=["__id", "__hash", "n_words", "n_hit", "item_ids", "word_ranges", "spans"],
            )

    return scan


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_block_bytes: int = MAX_BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_words, n_hit, item_ids, word_ranges, spans``.

    ``spans`` are the hit passages as [start, end) in characters of the original text; ``word_ranges`` count words. Null and
    empty texts have no words; items without words or without text match nothing; one without id hits words, too, but isn't in ``item_ids``; equal items all report. An
    empty benchmark hits nothing. Repeated rows are scanned one by one. With more than one block of items, rows are merged
    by id and text hash, so repeated equal rows then come out once for each copy all the same.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__hash"), text.alias("__text"))
    schema = f"__id {source.schema['__id'].dataType.simpleString()}, __hash long, {HITS}"
    parts = [
        shipped(source).mapInArrow(_scanner(spark.sparkContext.broadcast(block), window), schema)
        for block in item_blocks(items, item_id_col, item_text_col, max_block_bytes, window)
    ]
    if len(parts) == 1:
        return parts[0].drop("__hash").withColumnRenamed("__id", id_col)
    hits = [p.filter("n_hit > 0") for p in parts[1:]]
    more = hits[0]
    for p in hits[1:]:
        more = more.unionByName(p)
    # Only documents with hits meet again, and each brings at most one row a block.
    more = more.withColumnsRenamed({"__id": "__mid", "__hash": "__mhash"}).groupBy("__mid", "__mhash").agg(F.flatten(F.collect_list("item_ids")).alias("i"), F.flatten(F.collect_list("word_ranges")).alias("r"), F.flatten(F.collect_list("spans")).alias("s"))
    merge = lambda c, a, b: F.expr(
        f"aggregate(array_sort({c}), cast(array() as array<struct<{a}:int,{b}:int>>), (acc, x) -> case when size(acc) > 0 and x.{a} <= element_at(acc, -1).{b} "
        f"then concat(slice(acc, 1, size(acc) - 1), array(named_struct('{a}', element_at(acc, -1).{a}, '{b}', greatest(element_at(acc, -1).{b}, x.{b})))) else concat(acc, array(x)) end)"
    )
    joined = parts[0].join(more, F.col("__id").eqNullSafe(F.col("__mid")) & (F.col("__hash") == F.col("__mhash")), "left")
    joined = joined.withColumn("r", F.concat("word_ranges", F.coalesce("r", F.expr("array()")))).withColumn("s", F.concat("spans", F.coalesce("s", F.expr("array()"))))
    joined = joined.withColumn("i", F.array_sort(F.array_distinct(F.concat("item_ids", F.coalesce("i", F.expr("array()"))))))
    joined = joined.withColumn("r", merge("r", "first", "last")).withColumn("s", merge("s", "start", "end"))
    return joined.select(
        F.col("__id").alias(id_col), "n_words",
        F.expr("aggregate(r, 0L, (acc, x) -> acc + x.last - x.first)").alias("n_hit"),
        F.col("i").alias("item_ids"), F.col("r").alias("word_ranges"), F.col("s").alias("spans"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without any hit, with all columns: one pass for each block of items, without a join."""
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    for block in item_blocks(items, item_id_col, item_text_col, max_block_bytes, window):
        handle = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(*handle.value, window)
            for batch in by_bytes(batches, at):
                clean = [not matcher.scan(t or b"")[1] for t in as_bytes(batch.column(at)).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = shipped(docs).mapInArrow(run, docs.schema)
    return docs
