"""The queries of the text operators: each applies its operator to the whole table and returns the result's digest columns."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, exact_dedup, html_extract, license_scan, minhash, packing, quality, sharding, token_counts, toxicity, turns, warc, whitening
from graphloom.llm.common import cut, ensure_checkpoint_dir, remove, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(~held_out(F.col("doc_id")))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of whole texts."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that lie in benchmark windows."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of whole texts."""
    return token_counts.token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 1024)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives to the shared folder, and what the salvage reader reads back from there: every page, or an error."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages")
    warc.write_warc(pages, path)
    kind = pages.schema["page_id"].dataType
    got = cut(warc.read_warc(spark, path, payloads=False).select("kind", "record_id", "payload_bytes", "payload_digest", "refers_to"))
    read = {r.gap: r["count"] for r in got.groupBy((F.col("kind") == "gap").alias("gap")).count().collect()}
    remove(spark, path)  # all of it has been read
    n = pages.count()
    if read.get(True, 0) or read.get(False, 0) != n:
        raise RuntimeError(f"{read.get(False, 0)} records and {read.get(True, 0)} gaps were read of {n} pages")
    return got.select(
        warc.id_of(F.col("record_id")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), warc.id_of(F.col("refers_to")).cast(kind).alias("refers_to")
    )


def _toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.train(table(spark, sf_dir, "documents"), training_labels(table(spark, sf_dir, "labels")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of whole texts."""
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), _toxicity_model(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates by word 3-shingles at a similarity of 0.85."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, threshold=0.85)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of documents, with their source as host and the source's part in their language as path."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, training_labels(table(spark, sf_dir, "labels")))
    return quality.quality_scores(docs, model).withColumn("held_out", held_out(F.col("doc_id")))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of pages."""
    return html_extract.extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards of near equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), 16)


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence detections of whole texts."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings on the first four principal components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, damaged by a rule, and their cheapest repair."""
    rows = table(spark, sf_dir, "conversations")
    space, kind = F.lit(" "), F.col("kind")
    name = lambda c: F.coalesce(F.col(c).cast("string"), space)
    rows = rows.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20).alias("kind"))
    damaged = rows.withColumn("role", F.when(kind == 4, "user").otherwise(F.col("role"))).withColumn(
        "text", F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    )
    return turns.repair_conversations(damaged, copies=F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))


# --- stages of the pipeline: documents in, documents (or, at the end, pieces) out -----------------------------------------


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from all labelled rows of the table as it was first."""
    return toxicity.drop_toxic(docs, _toxicity_model(spark, sf_dir))


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id, and all that have no equal. Null counts as empty text."""
    ship(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five words, similarity of 0.8."""
    ship(spark)
    return minhash.drop_near_duplicates(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left; null counts as empty text, which is one token."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("exact dedup", stage_exact),
    ("near dedup", stage_near),
    ("decontamination", stage_decontaminate),
    ("packing", stage_packing),
]

QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_decontaminate, op3_token_counts, op4_warc, op5_toxicity, op6_minhash, op7_quality, op8_html, op9_packing, op10_sharding, op11_licenses, op12_whitening, op13_turns)}



def _license_sql() -> str:
    """The licence scan in DuckDB's SQL: the same rules over the whole line of a text, and each detection held against all others of it."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ",\n".join(f"({r.rule}, {r.priority}, {text(r.label)}, {text(f' {r.keyword} ')}, {text(r.pattern)})" for r in license_scan.RULES)
    base = ",\n".join(f"({text(license_scan.spaced(p))}, {len(p.split())}, {text(label)})" for p, label in license_scan.BASE.items())
    weights = " ".join(f"WHEN {k} THEN {w}" for k, w in license_scan.WEIGHTS.items())
    places = "list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0)"
    return f"""
        WITH rules(rule, priority, label, keyword, pattern) AS (VALUES {rules}),
        base(pattern, size, label) AS (VALUES {base}),
        t AS (SELECT row_number() OVER () AS r, doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g')) AS x FROM documents),
        w AS (SELECT r, doc_id, CASE WHEN x = '' THEN '' ELSE ' ' || x || ' ' END AS line FROM t),
        spots AS (SELECT r, base.label, size, unnest(range(1, len(found) + 1)) AS i, pieces, found
               FROM (SELECT r, label, size, string_split_regex(line, pattern) AS pieces, regexp_extract_all(line, pattern) AS found, pattern FROM w JOIN base ON contains(line, pattern)) base),
        bases AS (SELECT r, label, list_sum(list_transform(pieces[1:i], lambda x: length(x) - length(replace(x, ' ', '')))) // 2 + (i - 1) * size AS place FROM spots),
        b AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM bases GROUP BY r),
        tried AS (SELECT r, rule, priority, label, string_split_regex(line, pattern) AS pieces, regexp_extract_all(line, pattern) AS found FROM w JOIN rules ON contains(line, keyword)),
        hits AS (SELECT r, rule, priority, label, {places} AS a, {places} + length(found[i]) AS z
                 FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM tried)),
        kept AS (SELECT r, label, CASE priority {weights} END AS weight FROM hits d WHERE NOT EXISTS (
                 SELECT 1 FROM hits e WHERE e.r = d.r AND (e.a < d.z AND d.a < e.z AND e.priority < d.priority
                 OR e.a <= d.a AND e.z >= d.z AND e.priority = d.priority AND (e.z - e.a > d.z - d.a OR e.rule < d.rule)))),
        labels AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS weight FROM (SELECT * FROM kept UNION ALL SELECT r, label, {license_scan.BASE_WEIGHT} FROM bases) GROUP BY r)
        SELECT doc_id, (length(line) - length(replace(line, ' ', ''))) // 2 AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(weight, 0)::DOUBLE AS score
        FROM w LEFT JOIN b USING (r) LEFT JOIN labels USING (r)"""


#: Damage and repair in DuckDB's SQL: a least (cost, audit) for each state of the grammar, row by row. CRC-32 by its table of 256 numbers.
_TURNS_SQL = r"""
        WITH RECURSIVE bits AS (SELECT n, n AS c, 0 AS k FROM range(256) t(n) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
        tab AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
        named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
        kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind FROM named, tab),
        damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                           unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM damaged),
        seen AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
                        regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut_off, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS i0 FROM placed),
        f AS (SELECT conv_id, pos, turn, role, text, i, i0, blank, again AND NOT blank AS dup, cut_off AND NOT again AND NOT blank AS trunc FROM seen),
        stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
                         count(*) FILTER (trunc) AS truncated, count(*) FILTER (i0 IS NOT NULL AND i0 || i NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
        ways AS (SELECT conv_id, 0::BIGINT AS pos, 0 AS st, {'cost': 0::BIGINT, 'audit': '', 'said': ''} AS best FROM (SELECT DISTINCT conv_id FROM f)
                 UNION ALL
                 SELECT conv_id, pos, st, min({'cost': cost, 'audit': audit, 'said': said}) FROM (
                   SELECT w.conv_id, f.pos, o.op, CASE o.op WHEN 'D' THEN w.st WHEN 'R' THEN CASE w.st WHEN 2 THEN 3 ELSE 2 END ELSE CASE f.i WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS st,
                          w.cost + CASE o.op WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN f.trunc AND o.op <> 'D' THEN 3 ELSE 0 END AS cost, w.audit || o.op AS audit,
                          CASE o.op WHEN 'D' THEN w.said ELSE w.said || CASE w.st WHEN 0 THEN '' ELSE chr(10) END || CASE o.op WHEN 'K' THEN f.role WHEN 'R' THEN CASE w.st WHEN 2 THEN 'assistant' ELSE 'user' END END || ':' || f.text END AS said
                   FROM (SELECT conv_id, pos, CASE k WHEN 0 THEN st ELSE CASE st WHEN 2 THEN 3 ELSE 2 END END AS st, best.cost + 3 * k AS cost, best.audit || repeat('I', k) AS audit,
                                best.said || CASE k WHEN 0 THEN '' ELSE CASE st WHEN 0 THEN '' ELSE chr(10) END || CASE st WHEN 2 THEN 'assistant:' ELSE 'user:' END END AS said
                         FROM ways, (VALUES (0), (1)) ins(k)) w
                   JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1, (VALUES ('D'), ('K'), ('R')) o(op)
                   WHERE o.op = 'D' OR NOT f.blank AND NOT f.dup AND (o.op = 'R' OR f.i = 's' AND w.st = 0 OR f.i = CASE w.st WHEN 2 THEN 'a' ELSE 'u' END)) x
                 GROUP BY conv_id, pos, st),
        ends AS (SELECT w.conv_id, min({'cost': best.cost + CASE st WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, 'audit': best.audit || CASE st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
                        'said': best.said || CASE st WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END}) AS best
                 FROM ways w JOIN stats s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.pos GROUP BY w.conv_id)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.said, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op2_decontaminate": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
        win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS k
                FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
        sizes AS (SELECT DISTINCT n FROM win),
        dw AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS k
               FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
        hit AS (SELECT DISTINCT doc_id, item_id, i, dw.n FROM dw JOIN win ON dw.n = win.n AND dw.k = win.k),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT cast(item_id AS VARCHAR), ',' ORDER BY cast(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN items USING (doc_id) LEFT JOIN pos USING (doc_id)""",
    "op11_licenses": _license_sql(),
    "op13_turns": _TURNS_SQL,
}
