"""The registered queries again, in DuckDB's SQL, written apart from the operators so that each checks the other."""

from __future__ import annotations

import re

from graphloom.plans import generated, generated_oracle

FACTS = """
files AS (SELECT n_nationkey AS id, n_regionkey AS repository_id, 'src/' || n_name || '.py' AS path, 'python' AS language FROM nation),
symbols AS (
  SELECT 1000000 + n_nationkey AS id, n_nationkey AS file_id, n_name AS name, n_name AS qualified_name, 'Module' AS kind FROM nation
  UNION ALL SELECT 2000000 + s_suppkey, s_nationkey, s_name, n_name || '::' || s_name, 'Class' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 3000000 + c_custkey, c_nationkey, c_name, n_name || '::' || c_name, 'Function' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 4000000 + p_partkey, p_partkey % 25, p_name, p_brand || '::' || p_name || '.' || p_partkey, 'Method' FROM part),
raw_edges AS (
  SELECT 3000000 + o_custkey AS source_symbol_id, CASE WHEN l_returnflag <> 'R' THEN 4000000 + l_partkey END AS target_symbol_id,
         CASE WHEN l_returnflag = 'R' THEN p_brand || '.' || p_name END AS unresolved_target, 'Calls' AS kind, l_discount AS confidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT 4000000 + l_partkey, CASE WHEN l_returnflag <> 'R' THEN 2000000 + l_suppkey END,
         CASE WHEN l_returnflag = 'R' THEN n_name || '::' || s_name END, 'ReferencesType', 1.0
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 3000000 + c_custkey, 1000000 + c_nationkey, NULL, 'Imports', 1.0 FROM customer
  UNION ALL SELECT 2000000 + s_suppkey, 1000000 + s_nationkey, NULL, 'Imports', 1.0 FROM supplier
  UNION ALL SELECT 3000000 + o_custkey, NULL, o_orderpriority, 'ModifiedWith', 1.0 FROM orders
  UNION ALL SELECT 3000000 + c_custkey, 1000000 + c_nationkey, NULL, 'ConfiguredBy', 1.0 FROM customer WHERE c_mktsegment = 'BUILDING'),
edges AS (SELECT source_symbol_id, target_symbol_id, unresolved_target, kind, min(confidence) AS confidence FROM raw_edges GROUP BY ALL),
tests AS (SELECT s.* FROM symbols s JOIN customer ON s.id = 3000000 + c_custkey WHERE c_mktsegment = 'BUILDING'),
docs AS (SELECT doc_id AS id, doc_id % 25 AS file_id, CASE WHEN p_partkey IS NOT NULL THEN 4000000 + doc_id END AS symbol_id, p_name AS title, text AS body,
                source || '/' || lang || '/' || doc_id AS path FROM documents LEFT JOIN part ON doc_id = p_partkey),
commits AS (SELECT o_orderkey AS id, c_name AS author_name, lower(c_name) || '@example.org' AS author_email, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS authored_date
            FROM orders JOIN customer ON o_custkey = c_custkey),
cf AS (SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS item FROM lineitem),
cs AS (SELECT DISTINCT l_orderkey AS commit_id, l_suppkey AS item FROM lineitem),
cov AS (SELECT l_suppkey AS file_id, l_linestatus AS suite, l_partkey AS line, max(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS hits FROM lineitem GROUP BY ALL),
named AS (SELECT e.kind AS edge_kind, e.confidence, e.unresolved_target, s.id AS source_id, s.name AS source_name, s.qualified_name AS source_qname, s.kind AS source_kind, sf.path AS source_path,
                 t.id AS target_id, t.name AS target_name, t.qualified_name AS target_qname, t.kind AS target_kind, tf.path AS target_path
          FROM edges e JOIN symbols s ON e.source_symbol_id = s.id JOIN files sf ON s.file_id = sf.id
          LEFT JOIN symbols t ON e.target_symbol_id = t.id LEFT JOIN files tf ON t.file_id = tf.id)
"""


def _matches(name: str) -> str:
    return f"(target_name = '{name}' OR target_qname = '{name}' OR unresolved_target = '{name}' OR unresolved_target ILIKE '%::{name}' OR unresolved_target ILIKE '%.{name}')"


def _sources(name: str, kind: str) -> str:
    return f"SELECT DISTINCT source_qname, source_kind, source_path, confidence FROM named WHERE edge_kind = '{kind}' AND {_matches(name)}"


IMPACT = "('Calls','Imports','ReferencesType','ModifiedWith','Spawns','SendsTo')"
CONTEXT = "('Calls','Imports','ReferencesType','ModifiedWith')"


def _bfs(start: int, forward: bool, depth: int = 2, kinds: str = IMPACT) -> str:
    """Least depth of all nodes within some steps."""
    a, b = ("source_symbol_id", "target_symbol_id") if forward else ("target_symbol_id", "source_symbol_id")
    steps, names = [f"SELECT {start} AS id, 0 AS depth"], []
    inner = f"SELECT {start} AS id"
    for k in range(1, depth + 1):
        inner = f"SELECT DISTINCT {b} AS id FROM edges WHERE kind IN {kinds} AND target_symbol_id IS NOT NULL AND {a} IN ({inner})"
        steps.append(f"SELECT id, {k} AS depth FROM ({inner})")
        names.append(inner)
    return f"SELECT id, min(depth) AS depth FROM ({' UNION ALL '.join(steps)}) GROUP BY id"


_DIRECT = """SELECT DISTINCT source_symbol_id, target_symbol_id FROM edges WHERE kind = 'Calls' AND target_symbol_id IS NOT NULL
  AND source_symbol_id IN (SELECT id FROM tests) AND target_symbol_id NOT IN (SELECT id FROM tests)"""

_DIFF = """SELECT coalesce(n.path, k.path) AS path, CASE WHEN k.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN n.h = k.h THEN 'unchanged' ELSE 'changed' END AS status
  FROM (SELECT source || '/' || lang || '/' || doc_id AS path, sha256(text) AS h FROM documents) n
  FULL OUTER JOIN (SELECT source || '/' || lang || '/' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 0
                   UNION ALL SELECT source || '/' || lang || '/' || doc_id || '.old', sha256(text) FROM documents WHERE doc_id % 10 = 1) k ON n.path = k.path"""

_RESOLVE = """
  home AS (SELECT s.id, repository_id FROM symbols s JOIN files f ON s.file_id = f.id),
  qn AS (SELECT repository_id, qualified_name, min(s.id) AS id FROM symbols s JOIN files f ON s.file_id = f.id GROUP BY ALL),
  un AS (SELECT repository_id, name, count(*) AS n_all, min(s.id) AS id_all, count(*) FILTER (s.kind <> 'Module') AS n_plain, min(s.id) FILTER (s.kind <> 'Module') AS id_plain
         FROM symbols s JOIN files f ON s.file_id = f.id GROUP BY ALL),
  open AS (SELECT e.*, repository_id, CASE WHEN contains(unresolved_target, '.') THEN regexp_replace(unresolved_target, '\\.([^.]*)$', '::\\1') END AS dotted,
                  CASE WHEN starts_with(unresolved_target, 'self.') THEN substr(unresolved_target, 6) WHEN contains(unresolved_target, '.') THEN split_part(unresolved_target, '.', -1)
                       ELSE split_part(unresolved_target, '::', -1) END AS simple
           FROM edges e JOIN home ON e.source_symbol_id = home.id WHERE target_symbol_id IS NULL AND unresolved_target IS NOT NULL),
  tried AS (SELECT o.*, a.id AS ia, b.id AS ib,
                   CASE WHEN kind = 'Imports' OR simple = '*' OR (kind = 'ModifiedWith' AND (contains(unresolved_target, '.') OR contains(unresolved_target, '::'))) THEN NULL
                        WHEN kind IN ('ReferencesType', 'Calls', 'Extends', 'Implements') THEN CASE WHEN n_plain = 1 THEN id_plain END ELSE CASE WHEN n_all = 1 THEN id_all END END AS ic
            FROM open o LEFT JOIN qn a ON o.repository_id = a.repository_id AND o.unresolved_target = a.qualified_name
            LEFT JOIN qn b ON o.repository_id = b.repository_id AND o.dotted = b.qualified_name LEFT JOIN un ON o.repository_id = un.repository_id AND o.simple = un.name),
  resolved AS (SELECT source_symbol_id, kind, coalesce(ia, ib, ic) AS rid, CASE WHEN ia IS NOT NULL THEN 'exact' WHEN ib IS NOT NULL THEN 'dotted' WHEN ic IS NOT NULL THEN 'unique' ELSE 'none' END AS stage FROM tried)
"""


def _bm25(rows: str, words: list[str]) -> str:
    """``rows``: a select of doc and text."""
    quoted = ", ".join(f"'{w}'" for w in words)
    return f"""tok AS (SELECT doc, list_filter(regexp_split_to_array(lower(txt), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ts FROM ({rows})),
      len AS (SELECT doc, len(ts) AS dl FROM tok), n AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a FROM len),
      tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(ts) AS term FROM tok) WHERE term IN ({quoted}) GROUP BY ALL),
      df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
      sc AS (SELECT doc, -sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS s, count(*) AS c
             FROM tf JOIN df USING (term) JOIN len USING (doc), n GROUP BY doc)
      SELECT doc, round(s, 6) AS score FROM sc WHERE c = {len(words)}"""


def _times(*words: str) -> str:
    """How often the words follow each other in ``ts``; a last one with ``*`` is a beginning."""
    same = [f"starts_with(ts[i + {k}], '{w[:-1]}')" if w.endswith("*") else f"ts[i + {k}] = '{w}'" for k, w in enumerate(words)]
    return f"len(list_filter(range(1, len(ts) - {len(words) - 2}), lambda i: {' AND '.join(same)}))"


_PHRASES = [("of", "the"), ("of", "the", "th*"), ("thou*",), ("and",), ("les", "de")]
_PHRASE_SCORE = " + ".join(
    f"(CASE WHEN ln((n - d{k} + 0.5) / (d{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{k} + 0.5) / (d{k} + 0.5)) END) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / a))" for k in range(5)
)
_BM25_PHRASES = f"""tok AS (SELECT id AS doc, list_filter(regexp_split_to_array(strip_accents(lower(coalesce(body, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ts FROM docs),
  tf AS (SELECT doc, len(ts) AS dl, {', '.join(f'{_times(*p)} AS f{k}' for k, p in enumerate(_PHRASES))} FROM tok),
  n AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a, {', '.join(f'count(*) FILTER (f{k} > 0) AS d{k}' for k in range(5))} FROM tf)
  SELECT doc, round(-({_PHRASE_SCORE}), 6) AS score FROM tf, n WHERE f0 > 0 AND NOT f1 > 0 OR f2 > 0 AND f3 > 0 OR f4 > 0"""

_EVENTS = "e AS (SELECT *, epoch_us(ts) AS us FROM events WHERE value IS NOT NULL), fn AS (SELECT user_id, us AS lo, us + trunc(value * 60000000)::BIGINT AS hi FROM e WHERE event_type = 'purchase'), bl AS (SELECT user_id, us FROM e WHERE event_type = 'error')"
_INSIDE = "SELECT user_id, us FROM bl WHERE EXISTS (SELECT 1 FROM fn WHERE fn.user_id = bl.user_id AND us >= lo AND us <= hi)"
_SETS = "sets AS (SELECT lang, list(doc_id) FILTER (n_chars > 900) AS r, list(doc_id) FILTER (quality = 1) AS x FROM documents JOIN labels USING (doc_id) GROUP BY lang)"
_METRICS = """pr AS (SELECT lang, CASE WHEN len(coalesce(r, [])) = 0 AND len(coalesce(x, [])) = 0 THEN 1.0 WHEN len(coalesce(r, [])) = 0 THEN 0.0 ELSE len(list_intersect(r, coalesce(x, [])))::DOUBLE / len(list_distinct(r)) END AS p,
    CASE WHEN len(coalesce(x, [])) = 0 THEN 1.0 ELSE len(list_intersect(coalesce(r, []), x))::DOUBLE / len(list_distinct(x)) END AS q,
    len(list_filter(coalesce(x, []), lambda v: NOT list_contains(coalesce(r, []), v))) = 0 AS ok FROM sets),
  metrics AS (SELECT lang, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1, ok AS success FROM pr)"""
_DIR = """d AS (SELECT DISTINCT path FROM docs), pk AS (SELECT DISTINCT 'root-' || split_part(path, '/', 1) AS package, split_part(path, '/', 1) AS dir FROM docs
  UNION SELECT DISTINCT 'sub-' || split_part(path, '/', 1) || '/' || split_part(path, '/', 2), split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM docs WHERE path LIKE '%/en/%')"""
_START = 4000007
_UP = _bfs(_START, False)
_DOWN = _bfs(_START, True)

def _packs(budget: int) -> str:
    """Seven sections of each supplier, one after the other with the room that those before it left."""
    used = ["u0 AS (SELECT target, coalesce(sum(tokens) FILTER (section = 0), 0) AS used FROM it GROUP BY target)"]
    kept = ["SELECT target, section, item, tokens FROM it WHERE section = 0"]
    for s in range(1, 7):
        fits = "total <= room" if s == 3 else "rs <= room"
        used.append(f"k{s} AS (SELECT i.* FROM (SELECT it.*, {budget} - used AS room FROM it JOIN u{s - 1} USING (target) WHERE section = {s}) i WHERE {fits})")
        used.append(f"u{s} AS (SELECT u.target, used + coalesce(more, 0) AS used FROM u{s - 1} u LEFT JOIN (SELECT target, sum(tokens) AS more FROM k{s} GROUP BY target) USING (target))")
        kept.append(f"SELECT target, section, item, tokens FROM k{s}")
    return f"""own AS (SELECT id AS target FROM symbols WHERE kind = 'Class'),
      te AS (SELECT DISTINCT source_symbol_id AS s, target_symbol_id AS t, kind FROM edges WHERE kind IN {CONTEXT} AND target_symbol_id IS NOT NULL),
      touch AS (SELECT target, t AS other, s, t, kind FROM te JOIN own ON s = target UNION SELECT target, s, s, t, kind FROM te JOIN own ON t = target),
      beside AS (SELECT DISTINCT target, other AS id FROM touch WHERE other <> target), linked AS ({_DIRECT}),
      items AS (SELECT target, 0 AS section, kind || ' ' || qualified_name AS item FROM own JOIN symbols ON id = target
        UNION SELECT target, 1, path FROM own JOIN docs ON symbol_id = target
        UNION SELECT target, 2, qualified_name FROM own JOIN linked ON target_symbol_id = target JOIN symbols ON id = source_symbol_id
        UNION SELECT target, 3, t.kind || ' ' || a.qualified_name || ' -> ' || b.qualified_name FROM touch t JOIN symbols a ON a.id = s JOIN symbols b ON b.id = t.t
        UNION SELECT target, 4, kind || ' ' || qualified_name FROM beside JOIN symbols USING (id)
        UNION SELECT target, 5, path FROM beside b JOIN docs d ON d.symbol_id = b.id
        UNION SELECT target, 6, qualified_name FROM beside b JOIN linked ON target_symbol_id = b.id JOIN symbols y ON y.id = source_symbol_id),
      it AS (SELECT *, sum(tokens) OVER (PARTITION BY target, section ORDER BY item) AS rs, sum(tokens) OVER (PARTITION BY target, section) AS total
             FROM (SELECT *, greatest(ceil(length(item) / 4.0)::BIGINT, 1) AS tokens FROM items WHERE item IS NOT NULL)),
      {", ".join(used)}, kept AS ({" UNION ALL ".join(kept)})"""


def _line_sets(lines: str, target: str) -> str:
    """Sets of lines by target; ``lines`` has target, report, suite, line and hits once each."""
    join = lambda c: f"coalesce(array_to_string(list_sort({c}), ','), '')"
    return f"""one AS (SELECT {target}, report, suite, line, max(hits) AS hits FROM ({lines}) GROUP BY ALL),
      n AS (SELECT {target}, count(DISTINCT report || '/' || suite) AS n_sources FROM one GROUP BY ALL),
      per AS (SELECT {target}, line, count(*) FILTER (hits = 0) AS missed FROM one GROUP BY ALL)
      SELECT {target}, n_sources, {join('list(line)')} AS coverable, {join('list(line) FILTER (missed = n_sources)')} AS uncovered, {join('list(line) FILTER (missed < n_sources)')} AS covered
      FROM per JOIN n USING ({target}) GROUP BY ALL"""


_REPORTED = "SELECT l_suppkey AS file_id, 'report-' || (l_linenumber % 3) AS report, l_linestatus AS suite, l_partkey AS line, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS hits FROM lineitem"

BODIES: dict[str, str] = {
    "callers": _sources("small ring", "Calls"),
    "callers_all": "SELECT target_qname, count(DISTINCT source_qname) AS n_callers FROM named WHERE edge_kind = 'Calls' AND target_id IS NOT NULL GROUP BY ALL",
    "callees": "SELECT coalesce(target_qname, unresolved_target) AS target, target_kind, target_path, confidence FROM named WHERE edge_kind = 'Calls' AND source_name = 'Customer#000000001'",
    "imports": "SELECT source_qname, coalesce(target_qname, unresolved_target) AS target, target_path FROM named WHERE edge_kind = 'Imports' AND source_path = 'src/NATION_3.py'",
    "imported_by": "SELECT DISTINCT source_qname, source_path FROM named WHERE edge_kind = 'Imports' AND target_path = 'src/NATION_3.py' AND target_kind = 'Module'",
    "type_refs": "SELECT coalesce(target_qname, unresolved_target) AS target, target_path, count(*) AS n FROM named WHERE edge_kind = 'ReferencesType' AND source_name = 'small ring' GROUP BY ALL",
    "type_referencers": _sources("Supplier#000000003", "ReferencesType"),
    "decorators": "SELECT coalesce(target_qname, unresolved_target) AS target, confidence FROM named WHERE edge_kind = 'ModifiedWith' AND source_name = 'Customer#000000001'",
    "decorated": _sources("5-LOW", "ModifiedWith"),
    "fixtures": "SELECT DISTINCT coalesce(target_qname, unresolved_target) AS target, target_kind FROM named WHERE edge_kind = 'ConfiguredBy' AND source_name = 'Customer#000000004'",
    "docs_for_symbol": "SELECT d.id AS doc_id, qualified_name, title FROM docs d JOIN symbols s ON d.symbol_id = s.id",
    "symbol_by_qname": "SELECT repository_id, qualified_name, id, kind FROM (SELECT f.repository_id, s.qualified_name, s.id, s.kind, row_number() OVER (PARTITION BY repository_id, qualified_name ORDER BY s.id) AS rn FROM symbols s JOIN files f ON s.file_id = f.id) WHERE rn = 1",
    "find_symbol": "SELECT id, qualified_name, kind, file_id FROM symbols WHERE name = 'small ring'",
    "start_symbols": "SELECT id, qualified_name, kind FROM symbols WHERE qualified_name = 'NATION_2::Customer#000000000' OR (name = 'NATION_2::Customer#000000000' AND NOT EXISTS (SELECT 1 FROM symbols WHERE qualified_name = 'NATION_2::Customer#000000000'))",
    "fuzzy_find": "SELECT id, qualified_name, kind FROM symbols WHERE name ILIKE '%SMALL R%' OR qualified_name ILIKE '%SMALL R%'",
    "symbol_subtree": "SELECT id, qualified_name FROM symbols WHERE qualified_name = 'NATION_5' OR starts_with(qualified_name, 'NATION_5::')",
    "edge_exists": 'SELECT kind, count(*) AS n_edges, count(t) AS n_resolved, sum(s)::BIGINT AS sum_sources FROM (SELECT source_symbol_id AS s, target_symbol_id + source_symbol_id % 2 AS t, unresolved_target AS u, kind FROM edges) w WHERE EXISTS (SELECT 1 FROM edges e WHERE e.kind = w.kind AND e.source_symbol_id = w.s AND e.target_symbol_id = w.t AND e.unresolved_target IS NULL AND w.u IS NULL) OR (t IS NULL AND u IS NOT NULL) GROUP BY kind',
    "files_listing": "SELECT id, path, repository_id FROM files",
    "language_counts": "SELECT CASE WHEN path LIKE '%.py' THEN 'python' END AS language, count(*) AS n_files FROM files GROUP BY ALL",
    "row_counts": "SELECT 'repositories' AS table_name, count(*) AS n_rows FROM region " + " ".join(f"UNION ALL SELECT '{t}', count(*) FROM {t}" for t in ("files", "symbols", "edges", "docs", "tests", "commits")),
    "content_hash_lines": "SELECT doc_id, sha256(text) AS hash, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS n_lines, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents",
    "incremental_diff": _DIFF,
    "index_run_summary": f"SELECT status, count(*) AS n_files FROM ({_DIFF}) GROUP BY ALL",
    "upsert_symbols": "SELECT min(p_partkey) AS id, p_brand, p_name, max(p_partkey) AS last_write, arg_max(p_size, p_partkey) AS p_size FROM part GROUP BY p_brand, p_name",
    "delete_files": 'SELECT kind, count(*) AS n_edges, count(t) AS n_resolved, sum(s)::BIGINT AS sum_sources, sum(t)::BIGINT AS sum_targets, sum(length(u))::BIGINT AS n_chars FROM (SELECT DISTINCT source_symbol_id AS s, CASE WHEN t.file_id < 3 THEN NULL ELSE target_symbol_id END AS t, CASE WHEN t.file_id < 3 THEN t.qualified_name ELSE unresolved_target END AS u, e.kind FROM edges e JOIN symbols s ON e.source_symbol_id = s.id LEFT JOIN symbols t ON e.target_symbol_id = t.id WHERE s.file_id >= 3) GROUP BY kind',
    "replace_coverage": "SELECT file_id, suite, 'old' AS version, count(*) AS n_lines FROM cov WHERE suite <> 'F' GROUP BY ALL UNION ALL SELECT file_id, suite, 'new', count(*) FROM cov WHERE suite = 'F' AND line % 2 = 0 GROUP BY ALL",
    "resolve_edges": "SELECT kind, stage, count(*) AS n_edges, count(DISTINCT rid) AS n_targets, coalesce(sum(rid), 0)::BIGINT AS sum_targets FROM resolved GROUP BY ALL",
    "resolve_fixpoint": "SELECT kind, stage, count(*) AS n_edges, count(DISTINCT rid) AS n_targets, sum(length(unresolved_target))::BIGINT AS n_chars FROM rounds GROUP BY ALL",
    "resolve_incremental": "SELECT kind, stage, count(*) AS n_edges, count(DISTINCT rid) AS n_targets, coalesce(sum(rid), 0)::BIGINT AS sum_targets FROM resolved GROUP BY ALL",
    "unique_match_gate": "SELECT repository_id, name, count(*) AS n_symbols, CASE WHEN count(*) = 1 THEN min(s.id) ELSE -1 END AS symbol_id FROM symbols s JOIN files f ON s.file_id = f.id GROUP BY ALL",
    "write_back": "SELECT kind, late, count(*) AS n_edges FROM (SELECT s, t, kind, min(late) AS late FROM (SELECT source_symbol_id AS s, target_symbol_id AS t, kind, 0 AS late FROM edges WHERE target_symbol_id IS NOT NULL UNION ALL SELECT source_symbol_id, rid, kind, 1 FROM resolved WHERE rid IS NOT NULL) GROUP BY s, t, kind) GROUP BY ALL",
    "direct_call_tests": _DIRECT,
    "tests_for_symbols": f"SELECT target_symbol_id, count(*) AS n_tests FROM ({_DIRECT}) GROUP BY ALL",
    "doc_symbol_links": "SELECT doc_id, count(*) AS n_symbols, min(sid) AS first_symbol FROM (SELECT DISTINCT d.id AS doc_id, s.id AS sid FROM docs d JOIN symbols s ON regexp_replace(regexp_replace(lower(d.title), '[ -]', '_', 'g'), '[^a-z0-9_]', '', 'g') = regexp_replace(regexp_replace(lower(s.name), '[ -]', '_', 'g'), '[^a-z0-9_]', '', 'g')) GROUP BY doc_id",
    "doc_body_links": 'SELECT page_id AS doc_id, count(*) AS n_names FROM pages p JOIN (SELECT DISTINCT t FROM (SELECT unnest(regexp_extract_all(html, \'href="([^"]*)"\', 1)) AS t FROM pages) WHERE t <> \'\') ON contains(p.html, t) OR contains(p.html, replace(t, \'::\', \'.\')) GROUP BY page_id',
    "symbol_names_in_docs": """SELECT d.id AS doc_id, count(DISTINCT s.id) AS n_symbols, min(s.id) AS first_symbol
      FROM (SELECT id, concat_ws(' ', body, 'see', 'Brand#' || (id % 5 + 11) || '::' || title || '.' || id) AS body FROM docs) d
      JOIN symbols s ON contains(body, s.qualified_name) OR contains(body, replace(s.qualified_name, '::', '.')) GROUP BY d.id""",
    "sends_to": """ev AS (SELECT event_id // 200 AS file_id, 'user::' || user_id AS scope, event_type, event_id % 4 AS n, json_extract_string(props, '$.k')::BIGINT % 7 AS k FROM events),
      ends AS (SELECT file_id, scope, event_type = 'click' AS recv, CASE WHEN event_type = 'error' THEN 'my_sender' || k ELSE CASE n WHEN 0 THEN e || k WHEN 1 THEN e || k || '.clone' WHEN 2 THEN e || k || '_x' ELSE 'self.' || e || k END END AS v
               FROM (SELECT *, CASE event_type WHEN 'view' THEN 'tx' ELSE 'rx' END AS e FROM ev) WHERE event_type IN ('view', 'click', 'error')),
      decl AS (SELECT DISTINCT file_id, 'tx' || k AS tx, 'rx' || k AS rx FROM ev WHERE event_type = 'signup')
      SELECT s.file_id, s.scope AS sender, r.scope AS receiver FROM decl d JOIN ends s ON s.file_id = d.file_id AND NOT s.recv AND (s.v = tx OR starts_with(s.v, tx || '.') OR starts_with(s.v, tx || '_') OR ends_with(s.v, '.' || tx))
        JOIN ends r ON r.file_id = d.file_id AND r.recv AND (r.v = rx OR starts_with(r.v, rx || '.') OR starts_with(r.v, rx || '_') OR ends_with(r.v, '.' || rx)) WHERE s.scope <> r.scope
      UNION SELECT s.file_id, s.scope, r.scope FROM ends s JOIN ends r ON s.file_id = r.file_id AND NOT s.recv AND r.recv AND s.scope <> r.scope
        WHERE (contains(s.v, 'tx') OR contains(s.v, 'sender')) AND (contains(r.v, 'rx') OR contains(r.v, 'receiver')) AND NOT EXISTS (SELECT 1 FROM decl d WHERE d.file_id = s.file_id AND d.tx = s.v)""",
    "coverage_sets": _line_sets(_REPORTED, "file_id"),
    "coverage_sets_of_symbols": _line_sets(
        f"SELECT file_id, a || '-' || (a + w - 1) AS symbol, report, suite, line, hits FROM (SELECT *, line // w * w AS a FROM ({_REPORTED}), (VALUES (100), (1000)) v(w))", "file_id, symbol"),
    "context_packs": f"{_packs(400)} SELECT target, section, item, tokens FROM kept",
    "context_packs_json": f"""{_packs(400)}
      SELECT target, '{{"target":' || target || ',"sections":[' || string_agg(part, ',' ORDER BY section) || ']}}' AS json FROM (
        SELECT target, section, '{{"section":"' || ['target', 'target_docs', 'target_tests', 'edges', 'symbols', 'docs', 'tests'][section + 1] || '","items":[' || string_agg('"' || item || '"', ',' ORDER BY item) || ']}}' AS part FROM kept GROUP BY target, section)
      GROUP BY target""",
    "test_name_targets": "SELECT name, nullif(CASE WHEN starts_with(name, 'test_') THEN substr(name, 6) WHEN starts_with(name, 'test') THEN substr(name, 5) WHEN starts_with(name, 'Test') THEN substr(name, 5) END, '') AS target FROM (SELECT ['test_', 'Test', 'x'][c_custkey % 3 + 1] || c_name AS name FROM customer)",
    "file_churn": "SELECT item, count(DISTINCT commit_id) AS churn FROM cf GROUP BY item",
    "symbol_churn": "SELECT item, count(DISTINCT commit_id) AS churn FROM cs GROUP BY item",
    "author_frequency": "SELECT item, author, n_commits, round(n_commits::DOUBLE / sum(n_commits) OVER (PARTITION BY item) * 100.0, 6) AS share FROM (SELECT item, author_name || ' <' || author_email || '>' AS author, count(*) AS n_commits FROM cs JOIN commits c ON cs.commit_id = c.id GROUP BY ALL)",
    "last_commit": "SELECT item, commit_id, author_name, authored_date FROM (SELECT item, commit_id, author_name, authored_date, row_number() OVER (PARTITION BY item ORDER BY authored_date DESC, commit_id DESC) AS rn FROM cf JOIN commits c ON cf.commit_id = c.id) WHERE rn = 1",
    "file_cochange": "SELECT a, b, n_together, round(n_together::DOUBLE / churn * 100.0, 6) AS rate FROM (SELECT x.item AS a, y.item AS b, count(*) AS n_together FROM cf x JOIN cf y ON x.commit_id = y.commit_id AND x.item <> y.item GROUP BY ALL) JOIN (SELECT item AS a, count(*) AS churn FROM cf GROUP BY item) USING (a)",
    "symbol_cochange": "SELECT a, b, n_together, round(n_together::DOUBLE / churn * 100.0, 6) AS rate FROM (SELECT x.item AS a, y.item AS b, count(*) AS n_together FROM cs x JOIN cs y ON x.commit_id = y.commit_id AND x.item <> y.item GROUP BY ALL) JOIN (SELECT item AS a, count(*) AS churn FROM cs GROUP BY item) USING (a)",
    "bfs_forward": _bfs(3000001, True),
    "bfs_backward": _bfs(1000003, False),
    "reached_edges": f"SELECT DISTINCT source_symbol_id, target_symbol_id, kind FROM edges WHERE kind IN {IMPACT} AND target_symbol_id IN (SELECT id FROM ({_UP}) WHERE depth < 2)",
    "impact_nodes": f"SELECT id, 'down' AS direction, depth FROM ({_DOWN}) UNION ALL SELECT id, 'up', depth FROM ({_UP})",
    "impact_tests": f"SELECT source_symbol_id AS test_id, target_symbol_id AS linked_id FROM ({_DIRECT}) WHERE target_symbol_id IN (SELECT id FROM ({_UP}))",
    "impact_docs": f"SELECT DISTINCT id AS doc_id, symbol_id FROM docs WHERE symbol_id IN (SELECT id FROM ({_UP}) UNION SELECT id FROM ({_DOWN}))",
    "context_neighbors": f"SELECT id, min(depth) AS depth FROM ({_bfs(_START, True, 1, CONTEXT)} UNION ALL {_bfs(_START, False, 1, CONTEXT)}) GROUP BY id",
    "context_pack_prefix": 'SELECT target, section, id AS doc_id, tokens FROM kept',
    "call_order": "SELECT rn - 1 AS ordinal, count(*) AS n_calls, sum(l_partkey)::BIGINT AS sum_parts FROM (SELECT l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) GROUP BY rn",
    "pipeline_steps": "SELECT conv_id, step, name, CASE WHEN last IS NULL THEN 'before' WHEN step = last THEN 'target' WHEN step > last THEN 'after' ELSE 'before' END AS mark FROM (SELECT *, max(CASE WHEN name = 'user' THEN step END) OVER (PARTITION BY conv_id) AS last FROM (SELECT conv_id, role AS name, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS DISTINCT FROM role))",
    "coverage_by_symbol": "SELECT file_id, lo || '-' || hi AS symbol, suite, count(*) AS lines_valid, count(*) FILTER (hits > 0) AS lines_covered FROM (SELECT *, line - line % 100 AS lo, line - line % 100 + 99 AS hi FROM cov UNION ALL SELECT *, line - line % 1000, line - line % 1000 + 999 FROM cov) GROUP BY ALL",
    "coverage_profile": "SELECT file_id, coverable, uncovered, coverable - uncovered AS covered, round((coverable - uncovered)::DOUBLE / coverable * 100.0, 6) AS percent FROM (SELECT file_id, count(*) AS coverable, count(*) FILTER (n_not = n_suites) AS uncovered FROM (SELECT file_id, line, count(*) FILTER (hits = 0) AS n_not FROM cov GROUP BY ALL) JOIN (SELECT file_id, count(DISTINCT suite) AS n_suites FROM cov GROUP BY file_id) USING (file_id) GROUP BY file_id)",
    "uncovered_spans": "SELECT file_id, suite, min(line) AS first_line, max(line) AS last_line FROM (SELECT *, line - row_number() OVER (PARTITION BY file_id, suite ORDER BY line) AS g FROM cov WHERE hits = 0) GROUP BY file_id, suite, g",
    "safety_profile": f"SELECT user_id, blocks, unsafe_functions, ffi, exposed, blocks - exposed AS wrapped, score, CASE WHEN score >= 90 THEN 'Low' WHEN score >= 60 THEN 'Medium' ELSE 'High' END AS risk, CASE WHEN blocks > 0 THEN round((blocks - exposed)::DOUBLE / blocks * 100.0, 6) ELSE 100.0 END AS safe_wrapper_percent FROM (SELECT *, greatest(0, least(100, 100 - 15 * ffi - 10 * unsafe_functions - 5 * exposed - 2 * (blocks - exposed)))::BIGINT AS score FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS blocks, count(*) FILTER (event_type = 'purchase') AS unsafe_functions, count(*) FILTER (event_type = 'signup') AS ffi, coalesce(any_value(x), 0) AS exposed FROM e LEFT JOIN (SELECT user_id, count(*) AS x FROM ({_INSIDE}) GROUP BY user_id) USING (user_id) WHERE event_type IN ('error', 'purchase', 'signup') GROUP BY user_id))",
    "unsafe_containment": f"SELECT user_id, us AS at_micros FROM ({_INSIDE})",
    "channel_pairs": "SELECT channel, count(*) AS n_pairs, sum(s)::BIGINT AS sum_senders, sum(r)::BIGINT AS sum_receivers FROM (SELECT DISTINCT user_id AS s, (props->>'$.k')::BIGINT AS channel FROM events WHERE event_type = 'view') JOIN (SELECT DISTINCT user_id AS r, (props->>'$.k')::BIGINT AS channel FROM events WHERE event_type = 'click') USING (channel) WHERE s <> r GROUP BY channel",
    "topology": "SELECT edge_kind, coalesce(target_qname, unresolved_target, 'unknown') AS target, count(*) AS n_sources FROM named WHERE edge_kind IN ('ConfiguredBy', 'ModifiedWith') GROUP BY ALL",
    "longest_prefix_package": "SELECT path, arg_max(package, length(dir)) AS package FROM d LEFT JOIN pk ON starts_with(path, dir || '/') GROUP BY path",
    "suffix_path_match": "SELECT reported, min(k.path) AS known FROM (SELECT DISTINCT CASE WHEN id % 2 = 0 THEN 'build/' || path ELSE split_part(path, '/', 2) || '/' || split_part(path, '/', 3) END AS reported FROM docs) JOIN docs k ON k.path = reported OR ends_with(k.path, '/' || reported) OR ends_with(reported, '/' || k.path) GROUP BY reported",
    "markdown_sections": "SELECT conv_id, section, min(turn) AS start_line, max(turn) AS end_line, sum(length(text))::BIGINT AS n_chars FROM (SELECT *, (sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS section FROM conversations) GROUP BY conv_id, section",
    "bm25_docs": _bm25("SELECT id AS doc, concat_ws(' ', title, body) AS txt FROM docs", ["the", "erth"]),
    "bm25_symbols": _bm25("SELECT id AS doc, name || ' ' || qualified_name AS txt FROM symbols", ["small", "ring"]),
    "bm25_phrases": _BM25_PHRASES,
    "like_docs": "SELECT id AS doc FROM docs WHERE title ILIKE '%ERTH the%' OR body ILIKE '%ERTH the%'",
    "search_docs": "SELECT id AS doc, 0.0::DOUBLE AS score FROM docs WHERE title ILIKE '%rth th%' OR body ILIKE '%rth th%'",
    "combined_search": f"""s AS (WITH {_bm25("SELECT id AS doc, name || ' ' || qualified_name AS txt FROM symbols", ["ring"])}), d AS (WITH {_bm25("SELECT id AS doc, concat_ws(' ', title, body) AS txt FROM docs", ["ring"])})
      SELECT 'symbol' AS type, doc AS id, score FROM s UNION ALL SELECT 'doc', doc, score FROM d""",
    "search_near": """tok AS (SELECT id AS doc, col, list_filter(regexp_split_to_array(lower(coalesce(txt, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ts
             FROM (SELECT id, 'title' AS col, title AS txt FROM docs UNION ALL SELECT id, 'body', body FROM docs)),
      words AS (SELECT doc, col, unnest(ts) AS w, unnest(range(len(ts))) AS i FROM tok)
      SELECT a.doc FROM words a JOIN words b ON a.doc = b.doc AND a.col = b.col AND a.w = 'the' AND b.w = 'erth' AND abs(a.i - b.i) <= 3
      UNION SELECT doc FROM words WHERE col = 'title' AND w = 'ring'""",
    "index_changes": _bm25("SELECT id AS doc, concat_ws(' ', title, body) AS txt FROM docs WHERE id % 10 <> 3 OR id % 7 = 1 OR id % 11 = 5", ["the", "erth"]),
    "grep_baseline": "SELECT count(*) AS n_files, coalesce(sum(ceil(length(body) / 4.0)), 0)::BIGINT AS tokens FROM docs WHERE regexp_matches(body, '(^|[^\\p{L}\\p{N}_])erth($|[^\\p{L}\\p{N}_])')",
    "doc_excerpts": "SELECT doc_id, CASE WHEN contains(t, chr(10)) THEN rtrim(split_part(t, chr(10), 1), ' ') || '...' ELSE t END AS excerpt FROM (SELECT id AS doc_id, trim(regexp_replace(trim(body, ' '), '^(\"{3}|''{3}|\"|'')|(\"{3}|''{3}|\"|'')$', '', 'g'), ' ') AS t FROM docs)",
    "set_metrics": "SELECT * FROM metrics",
    "bench_summary": "SELECT round(avg(precision), 5) AS precision, round(avg(recall), 5) AS recall, round(avg(f1), 5) AS f1, sum(success::INT)::BIGINT AS n_success FROM metrics",
    "page_imports": "SELECT target, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages) GROUP BY target",
    "model_deps": "SELECT target_qname, count(*) AS n_models FROM (SELECT DISTINCT source_qname, target_qname FROM named WHERE edge_kind = 'ReferencesType' AND target_qname IS NOT NULL) GROUP BY ALL",
    "routes_with_deps": "SELECT '/' || lower(name) AS path, CASE WHEN id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, qualified_name, (SELECT count(DISTINCT coalesce(target_qname, unresolved_target)) FROM named n WHERE n.edge_kind = 'ConfiguredBy' AND n.source_qname = t.qualified_name) AS n_deps FROM tests t",
    "workspace_deps": "SELECT package, requirement, count(*) AS n_deps FROM (SELECT p_brand AS package, CASE WHEN m % 2 = 0 THEN 'v' || m WHEN p_partkey % 2 = 0 THEN w ELSE p_size::VARCHAR END AS requirement FROM part JOIN (SELECT p_name, min(p_type) AS w, max(p_size) AS m FROM part GROUP BY p_name) USING (p_name)) GROUP BY ALL",
    "android_refs": "SELECT DISTINCT source_qname, source_path FROM named WHERE target_qname = 'NATION_4'",
    "cochange_of_file": 'SELECT 7 AS a, item AS b, count(*) AS n_together, round(count(*)::DOUBLE / (SELECT count(*) FROM cf WHERE item = 7) * 100.0, 6) AS rate FROM cf WHERE commit_id IN (SELECT commit_id FROM cf WHERE item = 7) AND item <> 7 GROUP BY item',
    "git_metadata": "SELECT item, churn, commit_id, authored_date, authors FROM (SELECT item, count(*) AS churn, arg_max(commit_id, {'d': authored_date, 'c': commit_id}) AS commit_id, max(authored_date) AS authored_date FROM cf JOIN commits c ON cf.commit_id = c.id GROUP BY item) JOIN (SELECT item, string_agg(author, '|' ORDER BY n DESC, author) AS authors FROM (SELECT item, author_name || ' <' || author_email || '>' AS author, count(*) AS n FROM cf JOIN commits c ON cf.commit_id = c.id GROUP BY ALL) GROUP BY item) USING (item)",
    "context_pack_text": "SELECT target, '# Context: ' || target || chr(10) || '- Estimated Tokens: ' || ceil(length('# Context: ' || target || chr(10) || body) / 4.0)::BIGINT || chr(10) || chr(10) || body AS text FROM (SELECT target, string_agg(part, chr(10) ORDER BY section) AS body FROM (SELECT target, section, '## ' || CASE section WHEN 1 THEN 'target_docs' ELSE 'target_tests' END || chr(10) || string_agg('- ' || path, chr(10) ORDER BY id) || chr(10) AS part FROM kept GROUP BY target, section) GROUP BY target)",
    "generated_links": "SELECT g.p_partkey AS generated_id, b.p_partkey AS base_id, CASE WHEN g.p_partkey % 5 IN (1, 3) THEN 'ConfiguredBy' ELSE 'Implements' END AS kind FROM part g JOIN part b ON b.p_partkey = g.p_partkey - g.p_partkey % 5 WHERE g.p_partkey % 5 = b.p_size % 4 + 1",
    "external_targets": "SELECT kind, 'external:' || seg AS external_file, count(*) AS n_edges FROM (SELECT r.kind, CASE WHEN contains(unresolved_target, '::') THEN split_part(unresolved_target, '::', 1) ELSE split_part(unresolved_target, '.', 1) END AS seg, file_id FROM (SELECT *, coalesce(ia, ib, ic) AS rid FROM tried) r JOIN symbols s ON r.source_symbol_id = s.id WHERE rid IS NULL) JOIN deps ON package_id = file_id AND name = seg GROUP BY ALL",
    "test_deps": "SELECT DISTINCT t.qualified_name AS target, t.kind AS target_kind, f.path AS target_path, 1.0::DOUBLE AS confidence FROM (SELECT DISTINCT source_symbol_id, target_symbol_id FROM edges WHERE kind = 'Calls' AND target_symbol_id IS NOT NULL\n  AND source_symbol_id IN (SELECT id FROM tests) AND target_symbol_id NOT IN (SELECT id FROM tests)) e JOIN symbols s ON e.source_symbol_id = s.id JOIN symbols t ON e.target_symbol_id = t.id JOIN files f ON t.file_id = f.id WHERE s.name = 'Customer#000000004' ",
    "repository_by_root": "SELECT r_regionkey::BIGINT AS id, r_name AS root_path, 'git' AS vcs_type FROM region WHERE r_name = 'EUROPE'",
    "file_by_path": "SELECT id::BIGINT AS id, repository_id::BIGINT AS repository_id, path, language FROM files WHERE path = 'src/NATION_3.py'",
    "symbols_of_file": "SELECT id, name, qualified_name, kind, start_line FROM (SELECT s.*, CASE kind WHEN 'Module' THEN 0 WHEN 'Class' THEN id - 2000000 WHEN 'Function' THEN id - 3000000 ELSE id - 4000000 END AS start_line FROM symbols s) WHERE file_id = 3",
    "symbol_by_id": "SELECT id, name, qualified_name, kind, start_line, start_line + 9 AS end_line FROM (SELECT s.*, CASE kind WHEN 'Module' THEN 0 WHEN 'Class' THEN id - 2000000 WHEN 'Function' THEN id - 3000000 ELSE id - 4000000 END AS start_line FROM symbols s) WHERE id = 4000007",
    "tests_of_file": "SELECT id, name, qualified_name, 'Function' AS kind FROM symbols WHERE file_id = 3 AND id IN (SELECT id FROM tests)",
    "all_symbols": "SELECT id, file_id, name, qualified_name, kind, start_line, start_line + 9 AS end_line FROM (SELECT s.*, CASE kind WHEN 'Module' THEN 0 WHEN 'Class' THEN id - 2000000 WHEN 'Function' THEN id - 3000000 ELSE id - 4000000 END AS start_line FROM symbols s)",
    "provenance": "SELECT s.id, qualified_name, CASE WHEN p_size % 7 = 0 THEN 'Implements' END AS provenance FROM symbols s LEFT JOIN part ON s.id = 4000000 + p_partkey WHERE name = 'small ring'",
    "model_fields": "SELECT DISTINCT qualified_name, 'part_' || l_partkey AS name, p_type AS type_annotation, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR END AS default_value, p_size % 2 <> 0 AS is_required FROM symbols s JOIN lineitem ON s.id = 2000000 + l_suppkey JOIN part ON l_partkey = p_partkey WHERE s.name = 'Supplier#000000003'",
    "model_dependencies_of": "SELECT DISTINCT source_qname, target_qname FROM named WHERE edge_kind = 'ReferencesType' AND target_qname IS NOT NULL AND source_name = 'small ring'",
    "workspace": "SELECT n_name AS name, 'src/' || n_name || '/Cargo.toml' AS manifest_path, n_regionkey::VARCHAR AS version FROM nation",
    "package_dependencies": 'SELECT name, version_requirement, is_workspace_dependency FROM deps WHERE package_id = 3',
    "concurrency": "SELECT 'user::7' AS scope, CASE event_type WHEN 'purchase' THEN 'spawn' WHEN 'view' THEN 'tx' ELSE 'rx' END AS what, CASE event_type WHEN 'purchase' THEN 'purchase' ELSE 'mpsc' END AS kind, CASE WHEN event_type <> 'purchase' THEN props->>'$.k' END AS identity, event_id AS line FROM events WHERE user_id = 7 AND event_type IN ('purchase', 'view', 'click')",
    "safety_of_file": "SELECT path, blocks, unsafe_functions, ffi, exposed, score, CASE WHEN score >= 90 THEN 'Low' WHEN score >= 60 THEN 'Medium' ELSE 'High' END AS risk FROM (SELECT *, greatest(0, least(100, 100 - 15 * ffi - 10 * unsafe_functions - 5 * exposed - 2 * (blocks - exposed)))::BIGINT AS score FROM (SELECT 'src/NATION_3.py' AS path, count(*) FILTER (event_type = 'error') AS blocks, count(*) FILTER (event_type = 'purchase') AS unsafe_functions, count(*) FILTER (event_type = 'signup') AS ffi, count(*) FILTER (event_type = 'error' AND EXISTS (SELECT 1 FROM fn WHERE fn.user_id % 25 = 3 AND us BETWEEN lo AND hi)) AS exposed FROM e WHERE user_id % 25 = 3))",
    "coverage_of_file": 'SELECT * FROM (SELECT file_id, coverable, uncovered, coverable - uncovered AS covered, round((coverable - uncovered)::DOUBLE / coverable * 100.0, 6) AS percent FROM (SELECT file_id, count(*) AS coverable, count(*) FILTER (n_not = n_suites) AS uncovered FROM (SELECT file_id, line, count(*) FILTER (hits = 0) AS n_not FROM cov GROUP BY ALL) JOIN (SELECT file_id, count(DISTINCT suite) AS n_suites FROM cov GROUP BY file_id) USING (file_id) GROUP BY file_id)) WHERE file_id = 3',
    "coverage_of_symbols": "SELECT s.file_id, s.qualified_name AS symbol, suite, count(*) AS lines_valid, count(*) FILTER (hits > 0) AS lines_covered FROM cov JOIN (SELECT s.*, CASE kind WHEN 'Module' THEN 0 WHEN 'Class' THEN id - 2000000 WHEN 'Function' THEN id - 3000000 ELSE id - 4000000 END AS start_line FROM symbols s) s ON cov.file_id = s.file_id AND line BETWEEN start_line AND start_line + 9 GROUP BY ALL",
    "uncovered_of_file": 'SELECT suite, min(line) AS first_line, max(line) AS last_line FROM (SELECT *, line - row_number() OVER (PARTITION BY suite ORDER BY line) AS g FROM cov WHERE hits = 0 AND file_id = 3) GROUP BY suite, g',
    "android_components": 'SELECT c_nationkey::BIGINT AS file_id, c_mktsegment AS kind, c_name AS name FROM customer',
    "android_resources": "SELECT p_partkey % 25 AS file_id, p_type AS type, p_name || ' ' || p_partkey AS name, 'R.' || p_type || '.' || p_partkey AS qualified_name FROM part",
    "route_list": "SELECT '/' || lower(name) AS path, CASE WHEN id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, qualified_name, (SELECT count(DISTINCT coalesce(target_qname, unresolved_target)) FROM named n WHERE n.edge_kind = 'ConfiguredBy' AND n.source_qname = t.qualified_name) AS n_deps FROM tests t",
    "name_pattern_find": "SELECT id, qualified_name, kind FROM symbols WHERE contains(lower(name), 'n_1') OR contains(lower(qualified_name), 'n_1')",
}
_DEPS = "deps AS (SELECT p_partkey % 25 AS package_id, p_brand AS name, max(p_type) AS version_requirement, bool_or(p_size > 40) AS is_workspace_dependency FROM part GROUP BY ALL)"
_KEPT = """items AS (SELECT id // 50 AS target, CASE WHEN path LIKE '%/en/%' THEN 1 ELSE 2 END AS section, id, path, greatest(ceil(length(coalesce(body, '')) / 4.0), 1)::BIGINT AS tokens FROM docs),
  first AS (SELECT * FROM (SELECT *, (sum(tokens) OVER (PARTITION BY target ORDER BY id))::BIGINT AS total FROM items WHERE section = 1) WHERE total <= 8000),
  second AS (SELECT * FROM (SELECT *, (sum(tokens) OVER (PARTITION BY target ORDER BY id))::BIGINT + coalesce((SELECT max(total) FROM first f WHERE f.target = i.target), 0) AS total FROM items i WHERE section = 2) WHERE total <= 8000),
  kept AS (SELECT * FROM first UNION ALL SELECT * FROM second)"""
_ROUNDS = """
  segs AS (SELECT t.*, CASE WHEN contains(unresolved_target, '::') THEN split_part(unresolved_target, '::', 1) ELSE split_part(unresolved_target, '.', 1) END AS seg, file_id
           FROM tried t JOIN symbols s ON t.source_symbol_id = s.id WHERE coalesce(ia, ib, ic) IS NULL),
  outside AS (SELECT s.*, name IS NOT NULL AS made FROM segs s LEFT JOIN deps ON package_id = file_id AND name = seg),
  made AS (SELECT DISTINCT repository_id, unresolved_target AS q, regexp_extract(unresolved_target, '([^.:]*)$', 1) AS n FROM outside WHERE made),
  made_n AS (SELECT repository_id, n, count(*) AS k, min(q) AS q FROM made GROUP BY ALL),
  rounds AS (
    SELECT kind, unresolved_target, CASE WHEN ia IS NOT NULL THEN 'exact' WHEN ib IS NOT NULL THEN 'dotted' ELSE 'unique' END AS stage, coalesce(ia, ib, ic)::VARCHAR AS rid FROM tried WHERE coalesce(ia, ib, ic) IS NOT NULL
    UNION ALL SELECT kind, unresolved_target, 'external', repository_id || '|' || unresolved_target FROM outside WHERE made
    UNION ALL SELECT kind, unresolved_target, CASE WHEN x.q IS NOT NULL THEN 'exact' WHEN y.q IS NOT NULL THEN 'dotted' WHEN u THEN 'unique' ELSE 'none' END,
                     o.repository_id || '|' || coalesce(x.q, y.q, CASE WHEN u THEN z END)
    FROM (SELECT o.*, m.q AS z, m.k = 1 AND kind <> 'Imports' AND simple <> '*' AND NOT (kind = 'ModifiedWith' AND (contains(unresolved_target, '.') OR contains(unresolved_target, '::')))
                 AND coalesce(CASE WHEN kind IN ('ReferencesType', 'Calls', 'Extends', 'Implements') THEN n_plain ELSE n_all END, 0) = 0 AS u
          FROM outside o LEFT JOIN made_n m ON o.repository_id = m.repository_id AND simple = m.n LEFT JOIN un ON un.repository_id = o.repository_id AND un.name = simple WHERE NOT made) o
    LEFT JOIN made x ON x.repository_id = o.repository_id AND x.q = unresolved_target LEFT JOIN made y ON y.repository_id = o.repository_id AND y.q = dotted)"""
_CHANGED = """symbols2 AS (SELECT id, file_id, CASE WHEN kind = 'Method' AND id % 1000000 % 5 = 1 THEN 'new name ' || (id % 1000000 % 100) ELSE name END AS name, qualified_name, kind FROM symbols
    WHERE kind <> 'Class' OR id % 1000000 % 10 <> 3),
  edges2 AS (SELECT source_symbol_id, target_symbol_id, unresolved_target, kind FROM edges WHERE source_symbol_id % 17 <> 3
    UNION ALL SELECT id, NULL, 'x.new name ' || (id % 1000000 % 100), 'ReferencesType' FROM symbols WHERE kind = 'Function')"""
_MORE = {"resolve_fixpoint": f"{_RESOLVE}, {_DEPS}, {_ROUNDS}", "resolve_incremental": f"{_CHANGED}, {_RESOLVE.replace('symbols s', 'symbols2 s').replace('FROM edges e', 'FROM edges2 e')}", "context_pack_prefix": _KEPT, "context_pack_text": _KEPT, "package_dependencies": _DEPS, "external_targets": f"{_RESOLVE}, {_DEPS}", "safety_of_file": _EVENTS, "resolve_edges": _RESOLVE, "write_back": _RESOLVE, "safety_profile": _EVENTS, "unsafe_containment": _EVENTS, "set_metrics": f"{_SETS}, {_METRICS}", "bench_summary": f"{_SETS}, {_METRICS}", "longest_prefix_package": _DIR}

_BRANCHES = "(SELECT file_id, suite, line, hits, CASE WHEN line % 3 = 0 THEN 2 ELSE 0 END AS bv, CASE WHEN line % 3 = 0 AND hits > 0 THEN 1 ELSE 0 END AS bc FROM cov)"
BODIES |= generated_oracle.bodies({kind: path for kind, (path, _) in generated.FILES.items()})
_RESOLVED = {f"resolved_{kind}": generated_oracle.resolved(kind, generated.FILES[kind][0], _RESOLVE.strip()) for kind in ("python", "rust", "kotlin", "swift", "fsharp", "mojo")}
BODIES |= _RESOLVED  # with tables of their own
BODIES |= {
    "lcov_lines": f"SELECT 'src/s' || file_id || '.c-' || suite || '.info' AS report_path, suite, 'src/s' || file_id || '.c' AS path, line, hits::BIGINT AS hits, bv::BIGINT AS branches_valid, bc::BIGINT AS branches_covered FROM {_BRANCHES}",
    "cobertura_lines": f"SELECT 'src/s' || file_id || '.c.xml' AS report_path, 'src/s' || file_id || '.c' AS path, line, hits::BIGINT AS hits, bv::BIGINT AS branches_valid, bc::BIGINT AS branches_covered FROM {_BRANCHES} WHERE suite = 'F'",
    "branch_coverage": f"SELECT path, suite, branches_valid, branches_covered FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY branches_covered DESC, suite DESC) AS rn FROM (SELECT 'src/s' || file_id || '.c' AS path, suite, sum(bv)::BIGINT AS branches_valid, sum(bc)::BIGINT AS branches_covered FROM {_BRANCHES} GROUP BY ALL)) WHERE rn = 1",
}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, body in BODIES.items():
        if name in _RESOLVED:
            out[name] = body
            continue
        more = f", {_MORE[name]}" if name in _MORE else ""
        join = ", " if re.match(r"\s*\w+ AS \(", body) else " "
        out[name] = f"WITH {FACTS.strip()}{more}{join}{body}"
    return out
