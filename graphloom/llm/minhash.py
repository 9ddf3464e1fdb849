"""MinHash near-duplicates with tensored banding, verified on full shingle sets.

*Signatures.* A text's distinct word shingles are hashed once; ``2 * m`` small collections of ``k`` minhashes each are kept
as one number per collection. A table key joins one collection of the first half with one of the second, so ``m * m`` tables of
``2 * k`` rows cost ``2 * m * k`` minhashes instead of ``2 * m * m * k``. A pair of similarity ``s`` meets in some table with
probability ``(1 - (1 - s**k)**m)**2``; ``m`` is the least number that makes this ``RECALL`` at the threshold (8 at 0.85, 10
at 0.8, with k = 3), and more similar pairs meet more surely.

*Classes.* Texts with equal shingle sets form a class by a digest of the set, by partial aggregation, and only a class's
smallest id takes part in what follows: copies, however many, cost one record each.

*Stars.* In each bucket all members are compared with the member of the smallest id, not with one another, so the pairs are
linear in the bucket's size. What is confirmed on the full sets is a link.

*Rest.* Two members of a bucket may be linked to each other without being linked to its centre. Buckets whose members are
still in more than one component are therefore gone through exactly: members of a star are dealt into small blocks, and
pairs of blocks are compared in tasks of bounded size, by bits of the hashes that more than one of them has. Only links across
components leave these tasks.

*Components.* Smallest reachable id by label propagation with pointer jumping over tables; no links reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import as_bytes, by_bytes, cut, sieve_join
from graphloom.shipping import shipped

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.998  # of pairs just at the threshold, before groups add further ways to be linked
ROWS = 3  # minhashes of a collection
BLOCK_DOCS = 128
#: And about so many bytes of text; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
CACHE_WORDS = 80_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(32)


class Shingler:
    """Sorted distinct 64-bit hashes of word shingles. Words are runs of all but ASCII white space, A-Z lower-cased."""

    def __init__(self, size: int = SHINGLE, words: int = CACHE_WORDS):
        self.size, self.words, self.cache = size, words, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.translate(_LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        cache = self.cache
        try:
            h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(cache) > self.words:
                cache.clear()
            for w in set(words):
                if w not in cache:
                    cache[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        n = min(self.size, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):  # order matters: multiply, add, mix
            out = (out ^ h[i : len(h) - n + 1 + i]) * _ODD
            out ^= out >> _SHIFT
        return np.unique(out)


def coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 63, count, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def collection_keys(hashes: np.ndarray, m: int, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each of the ``2 * m`` collections of ``k`` minhashes."""
    mins = np.empty(2 * m * k, np.uint64)
    for i in range(2 * m * k):
        mins[i] = (hashes * a[i] + b[i]).min()
    mins = mins.reshape(2 * m, k)
    out = np.arange(1, 2 * m + 1, dtype=np.uint64)
    for i in range(k):
        out = (out ^ mins[:, i]) * _ODD
        out ^= out >> _SHIFT
    return out.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, m: int, k: int) -> DataFrame:
    """``id, n`` (set size) ``, digest`` (of the set; null if empty) and the collections' ``keys``."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, (a, b) = Shingler(shingle), coefficients(2 * m * k)
        for batch in by_bytes(batches, 1):
            sizes, digests, keys = [], [], []
            for text in as_bytes(batch.column(1)).to_pylist():
                s = shingles(text or b"")
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_hexdigest(s.data) if len(s) else None)
                keys.append(collection_keys(s, m, k, a, b) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "digest", "keys"]
            )

    return shipped(source).mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n long, digest string, keys array<long>")


def bucket_keys(reps: DataFrame, m: int) -> DataFrame:
    """``key, rep``: the ``m * m`` table keys of each class."""
    # In the worker's order: table, first collection, second collection.
    pairs = F.expr(f"flatten(transform(sequence(0, {m - 1}), i -> transform(sequence(0, {m - 1}), j -> xxhash64(keys[i], keys[{m} + j], i * {m} + j))))")
    return reps.select("rep", F.explode(pairs).alias("key"))


def texts_of(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rep, text`` of the nodes; only rows that pass a bounded sieve are shuffled."""
    rows = docs.select(F.col(id_col).alias("rep"), F.col(text_col).cast("string").alias("text"))
    return sieve_join(rows, nodes, "rep").join(nodes.hint("merge"), "rep", "left_semi")


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """100 * intersection >= 100 * threshold * union, in whole numbers."""
    percent = round(threshold * 100)
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)


#: Hashes that ``intersections`` goes through at once: up to some 16 MB with 256 sets.
PART_HASHES = 1 << 17


def intersections(first: list[np.ndarray], second: list[np.ndarray] | None = None, part: int = PART_HASHES) -> np.ndarray:
    """Sizes of the intersections of each of ``first`` with each of ``second`` (or of ``first``), all of them sorted sets.

    Hashes that only one set has are left out; the others are bits of a row a set, and are counted 64 at once. Sets are gone
    through by ranges of hashes, so the rows stay small however long the sets are.
    """
    sets, n = first + (second or []), len(first)
    out = np.zeros((n, n if second is None else len(second)), np.int64)
    parts = sum(map(len, sets)) // part + 1
    ends = [np.searchsorted(s, np.array([k * ((1 << 64) // parts) for k in range(1, parts)], np.uint64)) for s in sets]
    ends = [[0, *map(int, e), len(s)] for e, s in zip(ends, sets, strict=True)]
    for k in range(parts):
        slices = [s[e[k] : e[k + 1]] for s, e in zip(sets, ends, strict=True)]
        _, at, counts = np.unique(np.concatenate(slices), return_inverse=True, return_counts=True)
        shared = counts > 1
        column, keep, owner = np.cumsum(shared) - 1, shared[at], np.repeat(np.arange(len(sets)), [len(s) for s in slices])
        marks = np.zeros((len(sets), -(-int(shared.sum()) // 64) * 64), np.bool_)
        marks[owner[keep], column[at[keep]]] = True
        bits = np.packbits(marks, axis=1).view(np.uint64)
        others = bits[:n] if second is None else bits[n:]
        for x in range(n):
            out[x] += np.bitwise_count(others & bits[x]).sum(axis=1, dtype=np.int64)
    return out


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Of ``a, b`` those pairs whose full sets are similar enough. Each pair meets its two texts by plain joins."""
    one = texts.select(F.col("rep").alias("a"), F.col("text").alias("a_text"))
    two = texts.select(F.col("rep").alias("b"), F.col("text").alias("b_text"))
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, known = Shingler(shingle), {}

        def of(node, text):
            if node not in known:
                if len(known) >= 256:
                    known.clear()
                known[node] = text, shingles(text or b"")
            return known[node][1] if known[node][0] == text else shingles(text or b"")

        for batch in by_bytes(batches, 2):
            got = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)).to_pylist(), as_bytes(batch.column(3)).to_pylist()]
            keep = [similar(of(a, ta), of(b, tb), threshold) for a, b, ta, tb in zip(*got, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # A star's centre is b for all its members: by merge, as only then are large partitions split.
    joined = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "a_text", "b_text")
    return shipped(joined).mapInArrow(run, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of all nodes of ``a, b``: the smallest node reachable. Rounds go with the logarithm of the paths."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        # The smallest label around each node, then the label of that label.
        # A hub, and the label of a large component, is one key for many rows: by merge, as only then are large partitions split.
        near = both.join(labels.hint("merge"), both.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        near = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        up = labels.select(F.col("node").alias("up_node"), F.col("component").alias("up"))
        new = cut(near.join(up.hint("merge"), near.component == up.up_node).select("node", "was", F.least("component", "up").alias("component")))
        if new.filter("was <> component").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def _blocks(stars: DataFrame, texts: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """``star, i, j, rep, component, side``: members of each star dealt into pairs of blocks of about so many members or bytes of text.

    Members of the centre's component can be linked among themselves already, so pairs of two blocks of them are left out.
    """
    odd = F.col("odd").cast("int")
    # One row a star that isn't of one component yet; partial sums, so a large star is a record a task.
    apart = cut(stars.groupBy("star").agg(F.sum(odd).alias("n")).filter("n > 0").select(F.col("star").alias("s")))
    # By merge, as only then are large partitions split; a broadcast join that is chosen after the shuffle leaves them whole.
    open_ = stars.join(apart.hint("merge"), F.col("star") == F.col("s"), "left_semi")
    open_ = cut(open_.join(texts.select("rep", F.octet_length("text").cast("long").alias("bytes")).hint("merge"), "rep"))
    counts = open_.groupBy(F.col("star").alias("s")).agg(
        F.sum(odd).alias("n_odd"), F.sum(1 - odd).alias("n_own"), F.sum(odd * F.col("bytes")).alias("b_odd"), F.sum((1 - odd) * F.col("bytes")).alias("b_own"))
    # No more blocks than members, however long these are.
    at = lambda k: F.least(F.col(f"n_{k}"), F.greatest(F.ceil(F.col(f"n_{k}") / F.lit(block)), F.ceil(F.col(f"b_{k}") / F.lit(block_bytes)))).cast("int")
    dealt = open_.join(cut(counts).hint("merge"), F.col("star") == F.col("s")).select("star", "rep", "component", "odd", at("odd").alias("p"), at("own").alias("q"))
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("odd"), F.col("p")).otherwise(F.col("q"))).cast("int")
    # Odd members are blocks 0 .. p-1, the others p .. p+q-1; an odd block meets all blocks, another only the odd ones.
    dealt = dealt.withColumn("own", F.when(F.col("odd"), own).otherwise(F.col("p") + own))
    with_ = F.expr("explode(case when odd then sequence(0, p + q - 1) else sequence(0, p - 1) end)")
    dealt = dealt.select("star", "rep", "component", "own", with_.alias("other"))
    return dealt.select("star", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "component", "own")


def _rest_links(dealt: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Links across components inside pairs of blocks."""
    kind = dealt.schema["rep"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        shingles = Shingler(shingle)
        reps, comps, owns = (table.column(c).to_pylist() for c in ("rep", "component", "own"))
        sets = [shingles(t or b"") for t in table.column("text").cast(pa.binary()).to_pylist()]
        i = table.column("i")[0].as_py() if table.num_rows else 0
        j = table.column("j")[0].as_py() if table.num_rows else 0
        first = [x for x, o in enumerate(owns) if o == i]
        second = [x for x, o in enumerate(owns) if o == j]
        names: dict = {}
        root = [names.setdefault(c, len(names)) for c in comps]
        parent = list(range(len(names)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out: tuple[list, list] = [], []
        both = intersections([sets[x] for x in first], None if i == j else [sets[y] for y in second])
        size, own = np.array([len(s) for s in sets], np.int64), np.array(root, np.int64)
        union = size[first][:, None] + size[second][None, :] - both
        hit = (both > 0) & (100 * both >= round(threshold * 100) * union) & (own[first][:, None] != own[second][None, :])
        for x, y in np.argwhere(hit):
            rx, ry = find(root[first[x]]), find(root[second[y]])
            if rx != ry:
                parent[rx] = ry
                out[0].append(reps[first[x]])
                out[1].append(reps[second[y]])
        kind_ = table.schema.field("rep").type
        return pa.table({"a": pa.array(out[0], kind_), "b": pa.array(out[1], kind_)})

    return shipped(dealt.join(texts.hint("merge"), "rep")).groupBy("star", "i", "j").applyInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    k: int = ROWS,
    block_docs: int = BLOCK_DOCS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles, component_id, kept``.

    A text of fewer words than ``shingle`` has its whole word sequence as the one shingle; texts without words and null texts
    have none and are linked with nothing. ``component_id`` is the smallest id reachable over links; ``kept`` is that the
    row has that id. Repeated rows share their component, and rows of one id count as one document in links. A null id is
    never the smallest; a row without id and without links has a null component and is kept. An empty table gives no rows.
    """
    m = collections_for(threshold, recall, k)
    sig = cut(signatures(docs, id_col, text_col, shingle, m, k))
    # Equal sets: one class each, known by the digest, with the smallest id as its node.
    classes = cut(sig.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("rep")))
    reps = sig.join(classes.select(F.col("digest").alias("d"), "rep"), (F.col("digest") == F.col("d")) & (F.col("id") == F.col("rep"))).select("rep", "keys")
    keys = bucket_keys(reps, m)
    centres = keys.groupBy("key").agg(F.min("rep").alias("star"), F.max("rep").alias("last")).filter("star <> last").select("key", "star")
    # Members of buckets with more than one class, as distinct (star, member) pairs: linear in the buckets' sizes.
    stars = cut(keys.join(cut(centres), "key").select("star", "rep").distinct())
    texts = cut(texts_of(docs, stars.select("rep").distinct(), id_col, text_col))
    links = cut(confirm(stars.filter("star <> rep").select(F.col("rep").alias("a"), F.col("star").alias("b")), texts, shingle, threshold))
    labels = components(links)
    # Stars whose members are still apart.
    named = stars.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("star", "rep", F.coalesce("component", "rep").alias("component"))
    centre = labels.select(F.col("node").alias("star"), F.col("component").alias("own"))
    named = cut(named.join(centre.hint("merge"), "star", "left").withColumn("odd", F.col("component") != F.coalesce("own", "star")).drop("own"))
    more = cut(_rest_links(_blocks(named, texts, block_docs, block_bytes), texts, shingle, threshold))
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    by_class = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("digest").alias("d"), F.coalesce("component", "rep").alias("component_id"))
    by_class = cut(by_class)
    # Sets without a shingle have no digest: beside the join, where they would meet in one partition. By merge, as in _blocks.
    full = sig.filter("digest is not null").join(by_class.hint("merge"), F.col("digest") == F.col("d"), "left").select("id", "n", "component_id")
    out = full.unionByName(sig.filter("digest is null").select("id", "n", F.lit(None).cast(sig.schema["id"].dataType).alias("component_id")))
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, with all columns.

    Of a group all rows with its smallest id stay, repeated ones too; ``parameters`` are those of ``near_duplicates``. Texts without words,
    null texts and rows without an id that are linked with nothing stay. A row without id that is linked goes if another of its group has an
    id. Columns may have any names. An empty table gives no rows.
    """
    name = "__lost_id"
    while name in docs.columns:
        name += "_"
    lost = near_duplicates(docs, id_col, text_col, **parameters).filter("not kept").select(F.col(id_col).alias(name)).distinct()
    return docs.join(cut(lost), F.col(id_col) == F.col(name), "left_anti")


def match_probability(similarity: float, m: int, k: int = ROWS) -> float:
    """Probability that a pair of that similarity meets in some table."""
    return (1 - (1 - similarity**k) ** m) ** 2


def collections_for(threshold: float, recall: float = RECALL, k: int = ROWS) -> int:
    """The least number of collections in each half for that recall at the threshold."""
    m = 1
    while match_probability(threshold, m, k) < recall:
        m += 1
    return m
