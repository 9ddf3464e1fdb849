"""Cost-balanced packing of tokenised documents into fixed-length sequences.

One pass tokenises each document, in the worker, to a narrow row: its token count and checksums. Every full ``capacity`` of
its tokens is a sequence of its own; what remains (fewer than ``capacity`` tokens) is packed. The packing is planned on the
histogram of remainder lengths, of which there are fewer than ``capacity``, whatever the size of the corpus: lengths are
taken in descending order, each to the sequences of lowest estimated cost (linear plus quadratic in a piece's length, as
attention is) that still have room. Sequences in the same state are handled as one class with a multiplicity, so the plan
is a small list of rules "documents number lo to hi of length L go to sequences from s on, at offset o". What fits nowhere
whole is cut at multiples of ``grain`` tokens to fill the room that is left. The rules are joined to the documents.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import by_bytes, cut
from graphloom.shipping import shipped

CAPACITY = 2048
GRAIN = 32
CACHE_WORDS = 200_000
QUADRATIC = 1 / 2048  # cost of a piece of n tokens: n + QUADRATIC * n * n

#: White space on which both the tokenizer's pre-tokeniser and Python agree; texts with the others take the plain path.
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


#: The pre-tokeniser's pattern for lower-cased text below U+0100, where letters, numbers and white space can be listed.
_LETTERS, _NUMBERS, _SPACE = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\\t-\\r \u0085\u00a0"
_PARTS = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'(?:[stmd]|re|ve|ll)|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")


#: The settings of the vocabularies to which the pattern applies.
BY_PARTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _simple(text: str) -> bool:
    """All below U+0100, without white space that only Python knows and without what may be an added token."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return "<|" not in text and not any(c in text for c in _ODD_SPACE)


class _Parts(dict):
    """Ids of parts; a part that isn't there is taken from the older generation, or encoded."""

    def __init__(self, bpe, letters: dict[int, str], old: dict):
        super().__init__()
        self.bpe, self.letters, self.old = bpe, letters, old

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = array("I", [t.id for t in self.bpe(part.encode().decode("latin-1").translate(self.letters))]).tobytes()
        self[part] = ids
        return ids


class WordEncoder:
    """Little-endian 32-bit ids of whole texts, by the tokenizers library, with bounded caches.

    The vocabulary's pre-tokeniser splits a text into parts (letters, one number, marks) and drops white space, so a text's
    ids are its parts' ids in order. Of a simple text the parts are found here, and each part not met before goes through the
    library's BPE model. Other texts are split at white space, and those of their words that aren't simple either go through the
    whole tokenizer. Of a vocabulary with another normaliser or pre-tokeniser all texts go through the whole tokenizer.
    """

    def __init__(self, path: str, words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.letters = self.tokenizer.model, byte_letters()
        settings = json.loads(self.tokenizer.to_str())
        self.by_parts = all(settings[k] == v for k, v in BY_PARTS.items()) and all(t["content"].startswith("<|") for t in settings["added_tokens"])
        self.words, self.now = words, _Parts(self.model.tokenize, self.letters, {})

    def _plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _rest(self, text: str) -> bytes:
        if any(c in text for c in _ODD_SPACE):
            return self._plain(text)
        out = []
        for word in text.split():
            if _simple(word):
                out += map(self.now.__getitem__, _PARTS.findall(word.lower()))
            else:
                out.append(self._plain(word))
        return b"".join(out)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. The older generation of the cache goes when the newer is full."""
        if not self.by_parts:
            return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.now) > self.words:
            self.now.old = {}
            self.now = _Parts(self.model.tokenize, self.letters, self.now)
        get, find = self.now.__getitem__, _PARTS.findall
        return [b"".join(map(get, find(text.lower()))) if _simple(text) else self._rest(text) for text in texts]


@lru_cache(1)
def encoder(path: str) -> WordEncoder:
    """One for the whole worker process, so that its caches outlive a task."""
    return WordEncoder(path)


def _each(encode: WordEncoder, texts: list[str | None], chars: int = 1 << 20) -> Iterator[bytes]:
    """Ids of each text, encoded in groups of about ``chars`` characters."""
    group, size = [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= chars:
            yield from encode(group)
            group, size = [], 0
    yield from encode(group)


def _tokenise(path: str, end_id: int, capacity: int, grain: int):
    step, grid = 4 * capacity, 4 * grain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(path), array("I", [end_id]).tobytes()
        part, numbers, full = TaskContext.get().partitionId(), {}, 0
        for batch in by_bytes(batches, 1):
            out: tuple[list, ...] = tuple([] for _ in range(8))
            for ids in _each(encode, batch.column(1).to_pylist()):
                ids += last
                n = len(ids) // 4
                whole = n // capacity
                rest = ids[whole * step :]
                length = n - whole * capacity
                number = numbers.get(length, 0)
                numbers[length] = number + 1
                row = (n, [zlib.crc32(ids[k * step : (k + 1) * step]) for k in range(whole)], length, [zlib.crc32(rest[k : k + grid]) for k in range(0, len(rest), grid)], zlib.crc32(rest), part, number, full)
                full += whole
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["__id", *TOKENISED])

    return run


TOKENISED = ["n", "whole_crcs", "rest", "grain_crcs", "rest_crc", "part", "number", "whole_before"]


def cost(length: int, quadratic: float = QUADRATIC) -> float:
    return length + quadratic * length * length


def plan(histogram: dict[int, int], capacity: int = CAPACITY, grain: int = GRAIN, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int, int, int]], int]:
    """Rules ``(rest, lo, hi, start, length, sequence, offset)`` and the number of sequences.

    Document number ``lo + i`` of remainder length ``rest`` puts its tokens ``[start, start + length)`` into sequence
    ``sequence + i`` at ``offset``. Work and rules depend on ``capacity``, not on the counts.
    """
    total = sum(n * m for n, m in histogram.items())
    free = -(-total // capacity)
    #: Classes of sequences in one state: (cost, room, first sequence, how many). A class without room for the length at
    #: hand is parked under its room until lengths have come down to it.
    heap: list[tuple[float, int, int, int]] = [(0.0, capacity, 0, free)] if free else []
    parked: dict[int, list[tuple[float, int, int, int]]] = {}
    rules: list[tuple[int, int, int, int, int, int, int]] = []
    left: list[tuple[int, int, int]] = []  # rest, lo, hi
    for rest in range(capacity - 1, 0, -1):
        for state in parked.pop(rest, ()):
            heapq.heappush(heap, state)
        at, count = 0, histogram.get(rest, 0)
        while at < count and heap:
            c, room, first, many = heapq.heappop(heap)
            if room < rest:
                parked.setdefault(room, []).append((c, room, first, many))
                continue
            take = min(many, count - at)
            rules.append((rest, at, at + take, 0, rest, first, capacity - room))
            heapq.heappush(heap, (c + cost(rest, quadratic), room - rest, first, take))
            if take < many:
                heapq.heappush(heap, (c, room, first + take, many - take))
            at += take
        if at < count:
            left.append((rest, at, count))
    rooms = [(-room, first, many) for states in (heap, *parked.values()) for _, room, first, many in states]
    return _fill(rules, left, rooms, free, capacity, grain)


def _fill(rules, left, rooms, free, capacity, grain):
    """Cut what fits nowhere whole at multiples of the grain, largest room first; then open new sequences."""
    rooms = [x for x in rooms if -x[0] >= grain]
    heapq.heapify(rooms)
    todo = [(-rest, rest, lo, hi, 0) for rest, lo, hi in left]  # largest first: (-tokens left, rest, lo, hi, start)
    heapq.heapify(todo)
    while todo:
        minus, rest, lo, hi, start = heapq.heappop(todo)
        tokens = -minus
        if rooms:
            room, first, many = heapq.heappop(rooms)
        else:
            room, first, many = -capacity, free, hi - lo
            free += many
        take = min(many, hi - lo)
        length = tokens if tokens <= -room else -room // grain * grain
        rules.append((rest, lo, lo + take, start, length, first, capacity + room))
        if length < tokens:
            heapq.heappush(todo, (length - tokens, rest, lo, lo + take, start + length))
        if take < hi - lo:
            heapq.heappush(todo, (minus, rest, lo + take, hi, start))
        if -(room + length) >= grain:
            heapq.heappush(rooms, (room + length, first, take))
        if take < many:
            heapq.heappush(rooms, (room, first + take, many - take))
    return rules, free


_MASK = 0xFFFFFFFF


def _crc_zeros(length: int) -> np.ndarray:
    """The 32 columns of the map that ``length`` zero bytes are to a CRC-32 register."""

    def times(m: np.ndarray, v: int) -> int:
        out, k = 0, 0
        while v:
            if v & 1:
                out ^= int(m[k])
            v >>= 1
            k += 1
        return out

    square = lambda m: np.array([times(m, int(c)) for c in m], np.uint64)
    power = np.array([0xEDB88320, *(1 << k for k in range(31))], np.uint64)  # one zero bit
    out = np.array([1 << k for k in range(32)], np.uint64)
    bits = 8 * length
    while bits:
        if bits & 1:
            out = np.array([times(power, int(c)) for c in out], np.uint64)
        power = square(power)
        bits >>= 1
    return out


def join_crcs(crcs: list[int], shift: np.ndarray) -> int:
    """CRC-32 of chunks of one length (that of ``shift``) in a row."""
    out = crcs[0]
    for c in crcs[1:]:
        moved, k, v = 0, 0, out
        while v:
            if v & 1:
                moved ^= int(shift[k])
            v >>= 1
            k += 1
        out = moved ^ c
    return out & _MASK


def _piece_crcs(grain: int):
    """Checksums of pieces that were cut: they consist of whole grains, or reach the remainder's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = _crc_zeros(4 * grain)
        tails: dict[int, np.ndarray] = {}
        names = ["__id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            cols = {k: batch.column(k).to_pylist() for k in ("from", "length", "rest", "rest_crc", "grain_crcs")}
            crcs = []
            for start, length, rest, crc, grains in zip(*cols.values(), strict=True):
                if length != rest:
                    own = grains[start // grain : -(-(start + length) // grain)]
                    tail = length % grain
                    crc = join_crcs(own[:-1] if tail and len(own) > 1 else own, shift)
                    if tail and len(own) > 1:
                        if tail not in tails:
                            tails[tail] = _crc_zeros(4 * tail)
                        crc = join_crcs([crc, own[-1]], tails[tail])
                crcs.append(crc)
            get = batch.column
            yield pa.RecordBatch.from_arrays([get("__id"), get("start"), get("length"), pa.array(crcs, pa.int64()), get("doc_tokens"), get("sequence_id"), get("offset")], names=names)

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
    end_id: int = 1,
    grain: int = GRAIN,
    quadratic: float = QUADRATIC,
) -> DataFrame:
    """One row per piece: the document's id, ``start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids plus ``end_id``, so an empty or null text is one token and in the result too. Each id lies in
    exactly one piece. Sequences are filled from offset 0 without gaps, and only their ends are padded. Repeated rows and
    null ids are documents like any other. A document longer than ``capacity`` gives full sequences and one remainder.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = source.schema["__id"].dataType.simpleString()
    schema = f"__id {kind}, n long, whole_crcs array<long>, rest int, grain_crcs array<long>, rest_crc long, part long, number long, whole_before long"
    rows = cut(shipped(source).mapInArrow(_tokenise(path, end_id, capacity, grain), schema))

    # Numbers inside a partition become global ones by prefix sums over the partitions' totals.
    counts = cut(rows.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("m"), F.sum(F.size("whole_crcs")).alias("w")))
    ahead = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    numbers = counts.select("part", "rest", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("number0"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    wholes = counts.groupBy("part").agg(F.sum("w").alias("w")).select("part", F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("whole0"))

    histogram = {r.rest: r.m for r in counts.groupBy("rest").agg(F.sum("m").alias("m")).collect()}  # fewer than capacity rows
    rules, n_sequences = plan(histogram, capacity, grain, quadratic)
    rules = spark.createDataFrame(
        pa.table({c: pa.array([r[k] for r in rules], pa.int64()) for k, c in enumerate(("rest", "lo", "hi", "from", "length", "sequence", "offset"))})
    )

    rest = rows.filter("rest > 0").join(numbers, ["part", "rest"]).withColumn("number", F.col("number") + F.col("number0")).drop("number0")
    rules = F.broadcast(rules.withColumnRenamed("rest", "rule_rest"))
    hit = (F.col("rest") == F.col("rule_rest")) & (F.col("number") >= F.col("lo")) & (F.col("number") < F.col("hi"))
    rest = rest.join(rules, hit).select(
        "__id", ((F.col("n") - F.col("rest")) + F.col("from")).cast("long").alias("start"), "from", "length", "rest", "rest_crc",
        F.when(F.col("length") != F.col("rest"), F.col("grain_crcs")).alias("grain_crcs"), F.col("n").alias("doc_tokens"),
        (F.col("sequence") + F.col("number") - F.col("lo")).alias("sequence_id"), "offset",
    )
    rest = shipped(rest).mapInArrow(_piece_crcs(grain), f"__id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    full = rows.filter(F.size("whole_crcs") > 0).join(F.broadcast(wholes), "part")  # one row a partition
    full = full.select("__id", "n", (F.col("whole_before") + F.col("whole0") + F.lit(n_sequences)).alias("first"), F.posexplode("whole_crcs").alias("k", "crc"))
    full = full.select(
        "__id", (F.col("k") * F.lit(capacity)).cast("long").alias("start"), F.lit(capacity).cast("long").alias("length"), F.col("crc").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"), (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return rest.unionByName(full).withColumnRenamed("__id", id_col)
