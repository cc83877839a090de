"""DuckDB SQL of the driver queries, over the same tables."""

from __future__ import annotations

from datetime import datetime, timezone

from ..functions.text import FOLD_FROM, FOLD_TO
from . import queries as q

M = """memories AS (SELECT doc_id AS id, text AS content, CASE WHEN doc_id % 7 = 0 THEN 'persona:' ELSE 'project:' END || source AS scope, lang AS subject, source AS tag,
  CASE WHEN doc_id % 3 = 0 THEN 'episodic' WHEN doc_id % 3 = 1 THEN 'identity' ELSE 'semantic' END AS kind,
  CASE WHEN doc_id % 11 = 0 THEN 'superseded' WHEN doc_id % 13 = 0 THEN 'deleted' ELSE 'active' END AS status, least(1.0::DOUBLE, n_chars / 10000.0::DOUBLE) AS salience, doc_id AS created_at FROM documents)"""
P = """prefs AS (SELECT event_id AS id, 'user:' || user_id AS scope, event_type AS key, value, event_type || ' = ' || coalesce(json_extract_string(props, '$.k'), 'none') AS statement, 1.0::DOUBLE AS confidence, ts AS created_at FROM events)"""
S = """states AS (SELECT event_id AS id, 'p' || user_id AS project_id, 'project:p' || user_id AS scope, props AS state, ts AS created_at FROM events)"""
L = """log AS (SELECT conv_id || '-' || turn AS id, conv_id AS session_id, turn AS created_at, role, text AS content FROM conversations)"""
V = """vecs AS (SELECT vec_id AS memory_id, 'given:64' AS model_id, embedding::DOUBLE[] AS vector FROM embeddings)"""
SHOWN = "NOT starts_with(scope, 'persona:')"
WORDS = r"'[\p{L}\p{N}]+'"


def terms(column: str) -> str:
    return f"regexp_extract_all(translate(lower(coalesce({column}, '')), '{FOLD_FROM}', '{FOLD_TO}'), {WORDS})"


def form(column: str) -> str:
    return f"array_to_string(regexp_extract_all(lower(coalesce({column}, '')), {WORDS}), ' ')"


def dup(column: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({column}, '')), '\s+', ' ', 'g'))"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def bm25(rows: str, fields: list[tuple[str, float]], asked: str, tag: str) -> str:
    """CTEs {tag}_rank (qid, id, rank) of BM25 over weighted fields."""
    parts = " UNION ALL ".join(f"SELECT id, unnest({terms(c)}) AS term, {w}::DOUBLE AS w FROM {rows}" for c, w in fields)
    length = " + ".join(f"len({terms(c)})" for c, _ in fields)
    return f"""{tag}_len AS (SELECT id, {length} AS len FROM {rows}), {tag}_stats AS (SELECT count(*) AS n, avg(len) AS avglen FROM {tag}_len),
    {tag}_terms AS (SELECT qid, term, count(*) AS m FROM (SELECT qid, unnest({terms('query')}) AS term FROM {asked}) GROUP BY ALL),
    {tag}_post AS (SELECT id, term, sum(w) AS tf FROM ({parts}) WHERE term IN (SELECT term FROM {tag}_terms) GROUP BY id, term),
    {tag}_idf AS (SELECT term, CASE WHEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM {tag}_post, {tag}_stats GROUP BY term, n),
    {tag}_rank AS (SELECT qid, p.id, round(-sum(m * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avglen))), 9) AS rank
      FROM {tag}_post p JOIN {tag}_idf USING (term) JOIN {tag}_terms USING (term) JOIN {tag}_len l ON p.id = l.id, {tag}_stats GROUP BY qid, p.id)"""


def memory_hits(asked: str, k: int, keep: str) -> str:
    """CTEs up to m_hits (qid, id, item_type, score, matched_on, created_at)."""
    return f"""{bm25('memories', [('content', 1.0), ('subject', 0.5), ('tag', 0.3)], asked, 'm')},
    m_cand AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, created_at, id) AS r FROM m_rank JOIN memories USING (id) WHERE {keep}),
    m_hits AS (SELECT c.qid, id::VARCHAR AS id, 'memory' AS item_type,
      -rank * (1 + 0.15 * salience) + CASE WHEN contains({form('content')}, {form('query')}) THEN 1 ELSE 0 END AS score,
      CASE WHEN contains({form('content')}, {form('query')}) THEN 'phrase' ELSE 'fts' END AS matched_on, created_at::VARCHAR AS created_at FROM m_cand c JOIN {asked} a ON a.qid = c.qid WHERE r <= {3 * k})"""


def pref_hits(asked: str, k: int) -> str:
    return f"""p_now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY created_at DESC, id DESC) AS v FROM prefs) WHERE v = 1),
    {bm25('prefs', [('key', 1.0), ('statement', 0.5)], asked, 'p')},
    p_cand AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, created_at, id) AS r FROM p_rank JOIN p_now USING (id) WHERE {SHOWN}),
    p_hits AS (SELECT c.qid, id::VARCHAR AS id, 'preference' AS item_type,
      -rank * 1.5 * (1 + 0.15 * confidence) + 0.5 + CASE WHEN contains({form("key || ' ' || statement")}, {form('query')}) THEN 1 ELSE 0 END AS score,
      CASE WHEN contains({form("key || ' ' || statement")}, {form('query')}) THEN 'phrase' ELSE 'fts' END AS matched_on, created_at::VARCHAR AS created_at FROM p_cand c JOIN {asked} a ON a.qid = c.qid WHERE r <= {3 * k})"""


def best(hits: str, k: int) -> str:
    return f"""SELECT qid, id, item_type, round(score, 6) AS score, matched_on, position FROM
      (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_type, created_at, id) AS position FROM {hits}) WHERE position <= {k}"""


def asked(text: str) -> str:
    return f"asked AS (SELECT 0::BIGINT AS qid, {lit(text)} AS query)"


ACTIVE = f"status = 'active' AND {SHOWN}"
COS = "list_sum(list_transform(range(1, len(a.vector) + 1), lambda i: a.vector[i] * b.vector[i]))"
QV = ", ".join(map(str, q.QUERY_VECTORS))
UNIT = "units AS (SELECT memory_id, model_id, list_transform(vector, lambda x: x / sqrt(list_sum(list_transform(vector, lambda y: y * y)))) AS vector FROM vecs)"


def vector_list(extra: str, before: str = "", ids: str = QV) -> str:
    """CTE v_list: ranked vector hits (qid, id, score, position)."""
    return f"""v_all AS (SELECT b.memory_id AS qid, a.memory_id, {COS} AS score FROM vecs a, vecs b WHERE b.memory_id IN ({ids}) {before}),
    v_top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, memory_id) AS r FROM v_all),
    v_list AS (SELECT qid, id::VARCHAR AS id, 'memory' AS item_type, score, 'vector' AS matched_on, created_at::VARCHAR AS created_at, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS position
      FROM v_top JOIN memories m ON m.id = memory_id WHERE r <= 30 AND {extra})"""


V_OUT = "SELECT qid, id, item_type, round(score, 6) AS score, matched_on, position FROM v_list WHERE position <= 10"
NOTES = "notes AS (SELECT 'Projects/' || source || '/' || doc_id || '.md' AS rel_path, text, doc_id, source FROM documents)"



def norm(column: str) -> str:
    """The form of a text that is hashed."""
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({column}, ''), '\r\n?', chr(10), 'g'), '[^\S\n]+(\n|\z)', '\1', 'g'), '\A\n+', ''), '\n+\z', '')"


HASH = f"sha256({norm('content')})"
UTTERANCES = """utt AS (SELECT conv_id * 1000 + turn AS id, 'session:' || conv_id AS scope, conv_id, turn, (conv_id + turn) % 9 AS n, text, coalesce(text, '') AS head FROM conversations)"""
#: Notes of queries._typed_notes as their one chunk: the driver's documents have no blank lines and no headings.
TYPED = rf"""typed AS (SELECT doc_id, source, doc_id % 5 AS n, 'Projects/' || source || '/' || doc_id || '.md' AS rel_path, {norm("CASE WHEN doc_id % 5 = 3 THEN 'remember: ' ELSE '' END || coalesce(text, '')")} AS text FROM documents),
  chunks AS (SELECT *, 'sha256:' || sha256(text) AS content_hash, 'project:' || source AS scope, CASE WHEN n = 2 THEN 'State' ELSE doc_id::VARCHAR END AS title,
    CASE n WHEN 1 THEN 'preference' WHEN 2 THEN 'project_state' WHEN 3 THEN 'declaration' ELSE 'knowledge' END AS route, CASE n WHEN 1 THEN 'tone' || doc_id % 3 WHEN 2 THEN source END AS key,
    CASE n WHEN 1 THEN 'v' || doc_id WHEN 2 THEN '{{"open":"[\"a\"]","phase":"two"}}' END AS value, doc_id IN (SELECT doc_id FROM labels) AS known
    FROM typed WHERE n = 3 OR length(text) >= 40)"""


def sortable(prefix: str, *parts: str) -> str:
    return f"{prefix} || '_0000000000' || substr(sha256({' || chr(31) || '.join(parts)}), 1, 16)"


def imported() -> str:
    """CTEs of what an import appends: ev (each new chunk with its event's id), pick (declarations with content and verdict)."""
    body = r"regexp_replace(regexp_replace(text, '\Aremember: *', ''), '\A[：:,，、;；= \t\n\s]+|\s+\z', '', 'g')"
    return rf"""{M}, {TYPED}, ev AS (SELECT *, 'obsidian:vault/' || rel_path AS ref, {sortable("'evt'", "'obsidian:vault/' || rel_path", "content_hash", "'0'")} AS event_id FROM chunks WHERE NOT known),
    said AS (SELECT *, {body} AS body FROM ev WHERE n = 3), held AS (SELECT DISTINCT scope, {dup('content')} AS form FROM memories WHERE status = 'active'),
    pick AS (SELECT s.*, length({dup('body')}) >= 4 AND h.form IS NULL AS accepted FROM said s LEFT JOIN held h ON h.scope = s.scope AND h.form = {dup('s.body')} WHERE body <> '')"""


def _digits(at: str) -> str:
    """A time as the ten base-32 digits of an id."""
    millis, out = int(datetime.fromisoformat(at).replace(tzinfo=timezone.utc).timestamp() * 1000), ""
    while millis:
        millis, rest = divmod(millis, 32)
        out = "0123456789abcdefghijklmnopqrstuv"[rest] + out
    return out.rjust(10, "0")


def stored() -> str:
    """CTEs of the store that two runs of an import made: s_ev, s_mem, s_pref and s_state, each with b, the run."""
    stamp = " ".join(f"WHEN {b} THEN '{_digits(at)}'" for b, at in enumerate(q.COMMIT_TIMES, 1))
    made = lambda prefix, *parts: f"{prefix} || '_' || CASE b {stamp} END || substr(sha256({' || chr(31) || '.join(parts)}), 1, 16)"
    body = r"regexp_replace(regexp_replace(text, '\Aremember: *', ''), '\A[：:,，、;；= \t\n\s]+|\s+\z', '', 'g')"
    whole = "CASE WHEN doc_id % 5 = 3 THEN 'remember: ' ELSE '' END || coalesce(text, '')"
    return rf"""notes AS (SELECT 1 AS b, doc_id, source, {whole} AS raw FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT 2, doc_id, source, {whole} FROM documents WHERE doc_id % 2 = 0
        UNION ALL SELECT 2, doc_id, source, {whole} || chr(10) || chr(10) || 'A last word that is said for the first time.' || chr(10) FROM documents WHERE doc_id % 30 = 1),
      cut AS (SELECT b, doc_id, source, doc_id % 5 AS n, 'Projects/' || source || '/' || doc_id || '.md' AS rel_path, 'project:' || source AS scope, {norm('raw')} AS text FROM notes),
      s_ch AS (SELECT *, 'obsidian:vault/' || rel_path AS ref, 'sha256:' || sha256(text) AS content_hash, rel_path || '#000000' AS place, CASE b {' '.join(f"WHEN {b} THEN '{at}'" for b, at in enumerate(q.COMMIT_TIMES, 1))} END AS stamp FROM cut WHERE (n = 3 OR length(text) >= 40) AND length(text) <= 20000 AND trim(regexp_replace(text, '\s+', ' ', 'g')) <> '' AND NOT regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')),
      s_ev AS (SELECT *, {made("'evt'", 'ref', 'content_hash', "'0'")} AS event_id FROM s_ch),
      s_said AS (SELECT *, {body} AS body FROM s_ev WHERE n = 3),
      s_one AS (SELECT * FROM s_said WHERE b = 1 AND body <> '' AND length({dup('body')}) >= 4),
      s_mem AS (SELECT *, {made("'memory'", 'event_id', "'add'", "''", dup('body'))} AS id FROM (SELECT * FROM s_one UNION ALL SELECT s.* FROM s_said s WHERE b = 2 AND body <> '' AND length({dup('body')}) >= 4 AND NOT EXISTS (SELECT 1 FROM s_one o WHERE o.scope = s.scope AND {dup('o.body')} = {dup('s.body')}))),
      s_pref AS (SELECT *, 'tone' || doc_id % 3 AS key, 'v' || doc_id AS value, {made("'preference'", 'event_id')} AS id FROM s_ev WHERE n = 1),
      s_state AS (SELECT *, source AS key, '{{"open":"[\"a\"]","phase":"two"}}' AS value, {made("'project_state'", 'event_id')} AS id FROM s_ev WHERE n = 2)"""


def provenance() -> str:
    return "' origin=notes source_ref=' || ref || ' events=' || event_id || ' content_hash=' || content_hash"


BOTH_LOGS = "both_logs AS (SELECT 'preference' AS relation, id, scope, key, value, b, place FROM s_pref UNION ALL SELECT 'project_state', id, scope, key, value, b, place FROM s_state)"
CANDIDATES = """cand AS (SELECT doc_id + 10000000 AS id, 'project:' || source AS scope, CASE WHEN doc_id % 5 = 4 THEN 'preference' ELSE 'memory' END AS target,
  CASE WHEN doc_id % 17 = 0 THEN 'noop' WHEN doc_id % 4 = 1 THEN 'supersede' ELSE 'add' END AS operation, (doc_id % 20) / 20.0 AS confidence,
  CASE WHEN doc_id % 29 = 0 THEN 'ab' ELSE '  ' || text || ' ' || chr(10) END AS content, CASE WHEN doc_id % 10 = 4 THEN 'tone' END AS key, (doc_id * 3)::VARCHAR AS supersedes FROM documents)"""


def changes() -> str:
    return "ch AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'deleted' WHEN quality = 0 THEN 'archived' ELSE 'active' END AS status FROM labels)"


CHANGED = f"""{M.replace('memories AS', 'before AS')}, memories AS (SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN 'changed hand ' || coalesce(content, '') ELSE content END AS content) FROM before WHERE id % 31 <> 0)"""


def frequencies(rows: str) -> str:
    return f"SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest({terms('content')}) AS term FROM {rows} UNION ALL SELECT id, unnest({terms('subject')}) FROM {rows} UNION ALL SELECT id, unnest({terms('tag')}) FROM {rows}) GROUP BY term"


SQL = {
    "store_versions": f"""WITH {stored()}, {BOTH_LOGS} SELECT relation, id, scope, key, value, b::BIGINT AS seq, row_number() OVER w AS version, lead(id) OVER w AS superseded_by FROM both_logs
      WINDOW w AS (PARTITION BY relation, scope, key ORDER BY b, place, id)""",
    "store_current": f"""WITH {stored()}, {BOTH_LOGS}, seen AS (SELECT as_of, l.* FROM both_logs l JOIN (VALUES (1), (2)) v(as_of) ON b <= as_of)
      SELECT as_of, relation, scope, key, arg_max(id, (b, place, id)) AS id FROM seen GROUP BY as_of, relation, scope, key""",
    "store_recall": f"""WITH {stored()}, memories AS (SELECT id, body AS content, 'user:self' AS subject, '' AS tag, scope, 'active' AS status, 'semantic' AS kind, 0.5::DOUBLE AS salience, stamp AS created_at FROM s_mem),
      asked AS (SELECT item_id AS qid, text AS query FROM benchmark), {memory_hits('asked', 5, ACTIVE)} {best('m_hits', 5)}""",
    "store_snapshot": f"""WITH {stored()}, r AS (SELECT 'event' AS relation, event_id AS id, b FROM s_ev UNION ALL SELECT 'memory', id, b FROM s_mem UNION ALL SELECT 'preference', id, b FROM s_pref UNION ALL SELECT 'project_state', id, b FROM s_state)
      SELECT copied, relation, count(id) FILTER (b <= copied) AS n, coalesce(sum(length(id)) FILTER (b <= copied), 0)::BIGINT AS chars FROM r, (VALUES (1), (2)) v(copied) GROUP BY copied, relation""",
    "store_delete": f"""WITH {stored()}, l AS (SELECT id FROM s_mem WHERE scope <> 'project:src1') SELECT id, unnest(['memory', 'vector one', 'vector two']) AS relation FROM l""",
    "store_mirror": f"""WITH {stored()}, nowp AS (SELECT * FROM s_pref QUALIFY row_number() OVER (PARTITION BY scope, key ORDER BY b DESC, place DESC, id DESC) = 1), nows AS (SELECT * FROM s_state QUALIFY row_number() OVER (PARTITION BY scope, key ORDER BY b DESC, place DESC, id DESC) = 1),
      b AS (SELECT scope, 1 AS kind_no, id, '<!-- memory id=' || id || ' kind=semantic confidence=1.0 salience=0.5 created=' || stamp || ' scope=' || scope || {provenance()} || ' -->' || chr(10) || body || chr(10) || '<!-- /memory -->' || chr(10) AS block FROM s_mem
        UNION ALL SELECT scope, 2, id, '<!-- preference id=' || id || ' key=' || key || ' confidence=1.0 created=' || stamp || ' scope=' || scope || {provenance()} || ' -->' || chr(10) || key || ' = "' || value || '"' || chr(10) || '<!-- /preference -->' || chr(10) FROM nowp
        UNION ALL SELECT scope, 3, id, '<!-- project-state id=' || id || ' project=' || key || ' created=' || stamp || ' scope=' || scope || {provenance()} || ' -->' || chr(10) || value || chr(10) || '<!-- /project-state -->' || chr(10) FROM nows),
      h AS (SELECT scope, 0 AS kind_no, '' AS id, '---' || chr(10) || 'generated: true' || chr(10) || 'generator: lorekeep-export' || chr(10) || 'scope: ' || scope || chr(10) || 'exported_at: 2024-03-01' || chr(10) || 'memory_count: ' || count(*) FILTER (kind_no = 1) || chr(10)
        || 'preference_count: ' || count(*) FILTER (kind_no = 2) || chr(10) || 'project_state_count: ' || count(*) FILTER (kind_no = 3) || chr(10) || '---' || chr(10) AS block FROM b GROUP BY scope)
      SELECT replace(scope, ':', '-') || '.md' AS file, kind_no::INTEGER AS kind_no, id, sha256(block) AS sha FROM (SELECT * FROM h UNION ALL SELECT * FROM b)""",
    "embedded_batches": f"""WITH {M}, d AS (SELECT id, id // 16 AS batch, concat_ws(chr(10), content, CASE WHEN subject <> '' THEN subject END, tag) AS text FROM memories WHERE status = 'active'),
      one AS (SELECT * FROM d ORDER BY id LIMIT 300), r1 AS (SELECT *, bool_or(length(text) > 4000) OVER (PARTITION BY batch) AS bad FROM one),
      r2 AS (SELECT *, bool_or(length(text) > 4000) OVER (PARTITION BY batch) AS bad FROM d WHERE id NOT IN (SELECT id FROM r1 WHERE NOT bad)),
      runs AS (SELECT *, 1 AS run FROM r1 WHERE NOT bad UNION ALL SELECT *, 2 FROM r2)
      SELECT id AS memory_id, run, CASE WHEN NOT bad THEN length(text)::BIGINT END AS chars, CASE WHEN NOT bad THEN (length(text) - length(replace(text, 'e', '')))::BIGINT END AS es, CASE WHEN bad THEN 'ValueError: input is too long' END AS error FROM runs""",
    "formation_contexts": f"""WITH {M}, asked AS (SELECT conv_id * 1000 + turn AS qid, text AS query, CASE conv_id % 3 WHEN 0 THEN 'persona:src' || conv_id % 5 WHEN 1 THEN 'project:src' || conv_id % 5 ELSE 'session:' || conv_id END AS own FROM conversations WHERE trim(coalesce(text, '')) <> ''),
      {bm25('memories', [('content', 1.0), ('subject', 0.5), ('tag', 0.3)], 'asked', 'm')},
      cand AS (SELECT r.qid, m.*, rank, query, row_number() OVER (PARTITION BY r.qid ORDER BY rank, created_at, m.id) AS c FROM m_rank r JOIN memories m USING (id) JOIN asked a ON a.qid = r.qid
        WHERE status = 'active' AND (scope = own OR (starts_with(own, 'persona:') AND scope = 'global'))),
      hit AS (SELECT qid, id::VARCHAR AS memory_id, created_at, -rank * (1 + 0.15 * salience) + CASE WHEN contains({form('content')}, {form('query')}) THEN 1 ELSE 0 END AS score FROM cand WHERE c <= 12),
      best AS (SELECT qid AS id, memory_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, created_at::VARCHAR, memory_id) AS position FROM hit) SELECT * FROM best WHERE position <= 4""",
    "sectioned_chunks": f"""WITH d AS (SELECT doc_id, source, 'Projects/' || source || '/' || doc_id || '.md' AS rel_path, trim('A: ' || trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS a,
        'Second paragraph of ' || lang || ' from ' || source || ', which is long enough to be kept.' AS b, CASE WHEN doc_id % 2 = 1 THEN 0 ELSE 2 END AS o FROM documents),
      e AS (SELECT *, o = 2 AND length(a) + length(b) + 4 > 2000 AS apart FROM d),
      c AS (SELECT rel_path, source, 0 AS ordinal, '' AS sub, 3 AS line_start, CASE WHEN apart THEN 3 ELSE 7 + o END AS line_end, CASE WHEN apart THEN a ELSE a || chr(10) || b END AS text, 'knowledge' AS route, NULL AS key, NULL AS value, doc_id FROM e
        UNION ALL SELECT rel_path, source, 1, '', 7 + o, 7 + o, b, 'knowledge', NULL, NULL, doc_id FROM e WHERE apart
        UNION ALL SELECT rel_path, source, 1 + apart::INTEGER, '/Part', 11 + o, 11 + o, '记住：' || source || ' matters', 'declaration', NULL, NULL, doc_id FROM e
        UNION ALL SELECT rel_path, source, 2 + apart::INTEGER, '/Pref', 17 + o, 17 + o, 'Our preference: tone' || doc_id % 3 || ' = calm and clear from now on, in all texts', 'preference', 'tone' || doc_id % 3, 'calm and clear from now on, in all texts', doc_id FROM e
        UNION ALL SELECT rel_path, source, 3 + apart::INTEGER, '/State', 21 + o, 21 + o, 'The project state: p' || doc_id || ' = {{"phase": 2, "next": "the third phase"}}', 'project_state', 'p' || doc_id, '{{"phase": 2, "next": "the third phase"}}', doc_id FROM e)
      SELECT rel_path, ordinal::INTEGER AS ordinal, 'Doc ' || doc_id || sub AS heading, line_start::INTEGER AS line_start, line_end::INTEGER AS line_end, 'sha256:' || sha256(text) AS content_hash, route, 'project:' || source AS scope, key, value FROM c""",
    "preference_by_id": f"WITH {P} SELECT id, scope, key, statement FROM prefs WHERE id = 7",
    "embedding_by_memory": f"WITH {V} SELECT memory_id, model_id, unnest(range(len(vector)))::BIGINT AS place, round(unnest(vector), 6) AS x FROM vecs WHERE memory_id = 57",
    "memory_index": f"WITH {M} {frequencies('memories')}",
    "index_increments": f"WITH {CHANGED} {frequencies('memories')}",
    "keyword_recall_after_changes": f"WITH {CHANGED}, asked AS (SELECT item_id AS qid, text AS query FROM benchmark), {memory_hits('asked', 5, ACTIVE)} {best('m_hits', 5)}",
    "keyword_recall": f"WITH {M}, {asked(q.QUERY)}, {memory_hits('asked', 10, ACTIVE)} {best('m_hits', 10)}",
    "keyword_recall_persona": f"WITH {M}, {asked(q.QUERY)}, {memory_hits('asked', 10, f"status = 'active' AND scope IN ('global', 'persona:{q.PERSONA}')")} {best('m_hits', 10)}",
    "keyword_recall_batch": f"WITH {M}, asked AS (SELECT item_id AS qid, text AS query FROM benchmark), {memory_hits('asked', 5, ACTIVE + " AND kind IN ('semantic', 'episodic')")} {best('m_hits', 5)}",
    "preference_search": f"WITH {P}, {asked(q.PREFERENCE_QUERY)}, {pref_hits('asked', 10)} {best('p_hits', 10)}",
    "mixed_recall": f"WITH {M}, {P}, {asked(q.QUERY + ' purchase')}, {memory_hits('asked', 10, ACTIVE)}, {pref_hits('asked', 10)}, both_hits AS (SELECT * FROM m_hits UNION ALL SELECT * FROM p_hits) {best('both_hits', 10)}",
    "semantic_topk": f"""WITH {V}, {UNIT}, s AS (SELECT b.memory_id AS qid, a.memory_id, {COS} AS score FROM units a, units b WHERE b.memory_id IN ({QV})),
      r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, memory_id) AS position FROM s) SELECT qid, memory_id, round(score, 6) AS score, position FROM r WHERE position <= 10""",
    "semantic_postfilter": f"WITH {M}, {V}, {vector_list(ACTIVE)} {V_OUT}",
    "semantic_prefilter": f"WITH {M}, {V}, {vector_list(ACTIVE, f'AND a.memory_id IN (SELECT id FROM memories WHERE {ACTIVE})')} {V_OUT}",
    "hybrid_recall": f"""WITH {M}, {V}, asked AS (SELECT {q.QUERY_VECTORS[0]}::BIGINT AS qid, {lit(q.QUERY)} AS query UNION ALL SELECT {q.QUERY_VECTORS[1]}::BIGINT, 'er thing inges the'),
      {memory_hits('asked', 10, ACTIVE)}, k_list AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_type, created_at, id) AS position FROM m_hits) WHERE position <= 30),
      {vector_list(ACTIVE, '', ', '.join(map(str, q.QUERY_VECTORS[:2])))},
      both_lists AS (SELECT *, 'k' AS side FROM k_list UNION ALL SELECT *, 'v' AS side FROM v_list WHERE position <= 10),
      sides AS (SELECT qid, count(DISTINCT side) AS sides FROM both_lists GROUP BY qid),
      fused AS (SELECT qid, id, item_type, sum(1.0::DOUBLE / (60 + position)) * CASE WHEN bool_or(side = 'k' AND matched_on = 'phrase') THEN 1.25 ELSE 1.0 END AS score,
        CASE WHEN count(*) > 1 THEN 'hybrid' ELSE max(matched_on) END AS matched_on, max(created_at) AS created_at FROM both_lists JOIN sides USING (qid) WHERE sides = 2 GROUP BY qid, id, item_type)
      {best('fused', 10)}
      UNION ALL SELECT qid, id, item_type, round(score, 6), matched_on, position FROM both_lists JOIN sides USING (qid) WHERE sides = 1 AND position <= 10""",
    "phrase_hits": f"WITH {M} SELECT id, length({form('content')})::BIGINT AS n_chars FROM memories WHERE contains({form('content')}, 'of the')",
    "document_frequencies": f"""WITH {M}, t AS (SELECT id, unnest({terms('content')}) AS term, 1.0 AS w FROM memories UNION ALL SELECT id, unnest({terms('subject')}), 0.5 FROM memories)
      SELECT term, count(DISTINCT id) AS df, round(sum(w::DOUBLE), 6) AS total FROM t GROUP BY term""",
    "corpus_statistics": f"WITH {M} SELECT count(*) AS n, round(avg(len({terms('content')}) + len({terms('subject')})), 6) AS avglen FROM memories",
    "current_preferences": f"WITH {P} SELECT scope, key, id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY created_at DESC, id DESC) AS v FROM prefs) WHERE v = 1",
    "preference_history": f"WITH {P} SELECT scope, key, id, row_number() OVER w AS version, lead(id) OVER w AS superseded_by FROM prefs WINDOW w AS (PARTITION BY scope, key ORDER BY created_at, id)",
    "current_states": f"WITH {S} SELECT project_id, scope, id, json_extract_string(state, '$.k')::BIGINT AS k FROM (SELECT *, row_number() OVER (PARTITION BY project_id, scope ORDER BY created_at DESC, id DESC) AS v FROM states) WHERE v = 1",
    "state_history": f"WITH {S} SELECT id, state, row_number() OVER w AS version, lead(id) OVER w AS superseded_by FROM states WHERE project_id = 'p7' WINDOW w AS (ORDER BY created_at, id)",
    "version_counts": """SELECT 'preferences' AS log, count(*) AS all_rows, count(DISTINCT (user_id, event_type)) AS current_rows FROM events
      UNION ALL SELECT 'states', count(*), count(DISTINCT user_id) FROM events""",
    "dangling_links": f"WITH {P}, h AS (SELECT id, lead(id) OVER (PARTITION BY scope, key ORDER BY created_at, id) AS superseded_by FROM prefs) SELECT id, superseded_by FROM h WHERE id % 50 <> 0 AND superseded_by % 50 = 0",
    "folded_status": f"WITH {M}, {changes()} SELECT m.id, coalesce(ch.status, m.status) AS status, (1 + CASE WHEN ch.id IS NULL THEN 0 ELSE 1 END)::INTEGER AS revision FROM memories m LEFT JOIN ch ON m.id = ch.id",
    "key_upsert": "SELECT vec_id AS memory_id, CASE WHEN vec_id % 4 = 0 THEN 'second' ELSE 'given:64' END AS model_id FROM embeddings",
    "hard_delete": f"WITH {M} SELECT id, scope FROM memories WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "memory_page": f"WITH {M} SELECT id, scope, kind FROM memories WHERE {ACTIVE} AND kind IN ('semantic', 'identity') ORDER BY created_at DESC, id LIMIT 25 OFFSET 20",
    "session_events": f"WITH {L} SELECT id, role, content FROM log WHERE session_id = 5",
    "event_by_id": f"WITH {L} SELECT id, role, content FROM log WHERE session_id = 3 AND created_at = 0",
    "ordered_multi_get": f"WITH {M}, wanted(position, id) AS (VALUES (0::BIGINT, 42), (1, 7), (2, 999999999), (3, 3), (4, 120)) SELECT position, m.id, scope FROM memories m JOIN wanted w ON m.id = w.id",
    "embedding_scan": f"WITH {V} SELECT memory_id, len(vector)::BIGINT AS dim, round(sqrt(list_sum(list_transform(vector, lambda x: x * x))), 6) AS norm FROM vecs",
    "memory_counts": f"WITH {M} SELECT status, count(*) AS n, count(*) FILTER (kind = 'semantic') AS n_semantic, round(avg(salience), 6) AS salience FROM memories GROUP BY status",
    "store_statistics": """SELECT 'memories' AS relation, count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM conversations
      UNION ALL SELECT 'preferences', count(*) FROM events UNION ALL SELECT 'vectors', count(*) FROM embeddings""",
    "all_scopes": f"WITH {M}, {P}, {S} SELECT scope FROM memories UNION SELECT scope FROM prefs UNION SELECT scope FROM states",
    "visible_scopes": f"""WITH {M} SELECT count(*) FILTER ({SHOWN}) AS "default", count(*) FILTER (scope IN ('global', 'persona:{q.PERSONA}')) AS persona, count(*) FILTER (scope = 'project:src1') AS scope,
      count(*) FILTER (scope IN ('project:src1', 'project:src2', 'persona:{q.PERSONA}')) AS scopes FROM memories""",
    "validation_report": rf"""WITH {M} SELECT CASE WHEN content IS NULL THEN 'content is missing' WHEN trim(regexp_replace(content, '\s+', ' ', 'g')) = '' THEN 'content is empty' WHEN length(content) > 20000 THEN 'content is too long'
      WHEN regexp_matches(content, '[\x00-\x08\x0B\x0C\x0E-\x1F]') THEN 'content holds control characters' ELSE 'accepted' END AS verdict, count(*) AS n FROM memories GROUP BY ALL""",
    "latency_percentiles": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
      SELECT event_type, round(max(value) FILTER (r = greatest(1, ceil(n * 0.5))), 6) AS p50, round(max(value) FILTER (r = greatest(1, ceil(n * 0.95))), 6) AS p95, round(avg(value), 6) AS mean, round(max(value), 6) AS highest FROM r GROUP BY event_type""",
    "missing_embeddings": f"WITH {M} SELECT id FROM memories WHERE {ACTIVE} AND id NOT IN (SELECT vec_id FROM embeddings)",
    "index_statistics": f"""WITH {M} SELECT 'given:64' AS model_id, (SELECT count(*) FROM embeddings) AS n_vectors, count(*) AS n_missing FROM memories WHERE status = 'active' AND id NOT IN (SELECT vec_id FROM embeddings)""",
    "embedding_text": f"WITH {M} SELECT id, sha256(concat_ws(chr(10), content, CASE WHEN subject <> '' THEN subject END, tag)) AS sha FROM memories",
    "built_vectors": rf"""WITH {M}, todo AS (SELECT id, lower(content || chr(10) || subject || chr(10) || tag) AS text FROM memories WHERE status = 'active' AND id NOT IN (SELECT vec_id FROM embeddings)),
      runs AS (SELECT id, regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g') AS run FROM todo),
      feats AS (SELECT id, 'w:' || run AS f FROM runs WHERE run <> '' UNION ALL SELECT id, unnest(list_transform(range(1, len(l)), lambda i: 'g:' || l[i] || l[i + 1])) FROM (SELECT id, string_split(run, '') AS l FROM runs)),
      hashed AS (SELECT id, ('0x' || substr(sha1(f), 1, 12))::BIGINT AS v FROM feats),
      counts AS (SELECT id, v % 8 AS b, sum(CASE WHEN (v >> 40) % 2 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS c FROM hashed GROUP BY ALL),
      norms AS (SELECT id, sqrt(sum(c * c)) AS n FROM counts GROUP BY id)
      SELECT id AS memory_id, {', '.join(f"round(coalesce(max(c) FILTER (b = {i}), 0) / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS v{i}" for i in range(8))} FROM counts JOIN norms USING (id) GROUP BY id, n""",
    "search_terms": f"WITH {M} SELECT id, len({terms('content')})::BIGINT AS n_terms, len(list_distinct({terms('content')}))::BIGINT AS n_distinct FROM memories",
    "content_hashes": f"WITH {M} SELECT id, 'sha256:' || {HASH} AS content_hash FROM memories",
    "exact_duplicates": f"WITH {M} SELECT scope, sha256({dup('content')}) AS sha, count(*) AS n, min(id) AS first_id FROM memories GROUP BY ALL HAVING count(*) > 1",
    "previews": rf"""WITH {M}, f AS (SELECT id, scope, trim(regexp_replace(coalesce(content, ''), '\s+', ' ', 'g')) AS flat FROM memories)
      SELECT id, replace(scope, ':', '-') AS slug, CASE WHEN length(flat) <= 120 THEN flat ELSE substr(flat, 1, 120) || '...' END AS preview FROM f""",
    "external_refs": f"WITH {M} SELECT id, 'obsidian:vault/' || subject || '/' || id || '.md' AS ref, subject || '/' || id || '.md' AS rel_path FROM memories",
    "glob_matches": f"""WITH {M} SELECT id, id % 2 = 1 AS not_md, subject = 'de' AS german, id BETWEEN 10 AND 19 AND id % 2 = 0 AS teens, tag IN ('src1', 'src2', 'src3') AS digits FROM memories""",
    "scope_mapping": "SELECT doc_id, CASE WHEN lang = 'de' THEN 'persona:' || source WHEN source = 'src1' THEN 'project:' || lang WHEN lang = 'fr' THEN 'global' WHEN doc_id < 10 THEN 'project:short' END AS scope FROM documents",
    "rule_extract": rf"""WITH {UTTERANCES}, h AS (SELECT *, regexp_replace(regexp_replace(head, '\A[：:,，、;；= \t\n\s]+', ''), '\s+\z', '') AS body FROM utt)
      SELECT id, CASE WHEN n = 0 THEN CASE WHEN body <> '' THEN 'memory' END WHEN n = 3 THEN 'preference' WHEN n = 6 THEN 'project_state' END AS target,
        CASE WHEN n = 0 AND body <> '' THEN 'semantic' END AS kind, CASE WHEN n = 3 THEN 'tone' || turn WHEN n = 6 THEN 'p' || conv_id END AS key,
        CASE WHEN n = 3 THEN 'calm' WHEN n = 6 THEN '{{"turn": ' || turn || '}}' END AS value,
        CASE WHEN n = 0 AND body = '' THEN 'nothing after the trigger' WHEN n IN (0, 3, 6) THEN NULL WHEN trim(coalesce(text, '')) = '' THEN 'empty utterance' ELSE 'no explicit instruction' END AS reason FROM h""",
    "policy_verdicts": f"""WITH {CANDIDATES}, {M}, held AS (SELECT DISTINCT 'project:' || tag AS scope, {dup('content')} AS form FROM memories WHERE status = 'active'),
      v AS (SELECT c.id, CASE WHEN operation = 'noop' THEN 'not worth remembering' WHEN confidence < 0.35 THEN 'low confidence' WHEN target = 'memory' AND length({dup('content')}) < 4 THEN 'too short'
        WHEN target = 'memory' AND h.form IS NOT NULL THEN 'duplicate' WHEN target <> 'memory' AND coalesce(key, '') = '' THEN 'no key'
        WHEN operation = 'supersede' AND supersedes::BIGINT NOT IN (SELECT doc_id FROM documents) THEN 'unknown supersede target' ELSE 'accepted' END AS verdict
        FROM cand c LEFT JOIN held h ON h.scope = c.scope AND h.form = {dup('c.content')})
      SELECT id, verdict, verdict = 'accepted' AS accepted FROM v""",
    "candidate_dedupe": f"WITH {CANDIDATES} SELECT id, target FROM (SELECT *, row_number() OVER (PARTITION BY scope, target, operation, supersedes, {dup("coalesce(nullif(content, ''), key)")} ORDER BY id) AS r FROM cand) WHERE r = 1",
    "commit_routes": rf"""WITH {M}, {UTTERANCES}, h AS (SELECT *, 'evt_' || id AS event_id, regexp_replace(regexp_replace(head, '\A[：:,，、;；= \t\n\s]+', ''), '\s+\z', '') AS body FROM utt),
      held AS (SELECT DISTINCT scope, {dup('content')} AS form FROM memories WHERE status = 'active')
      SELECT 'event' AS log, event_id, scope, NULL::VARCHAR AS key, sha256(CASE n WHEN 0 THEN 'Remember: ' || head WHEN 3 THEN 'preference: tone' || turn || ' = calm' WHEN 6 THEN 'note that project p' || conv_id || ' = {{"turn": ' || turn || '}}' ELSE text END) AS value FROM h
      UNION ALL SELECT 'memory', event_id, h.scope, 'semantic', sha256(body) FROM h LEFT JOIN held ON held.scope = h.scope AND held.form = {dup('body')} WHERE n = 0 AND length({dup('body')}) >= 4 AND held.form IS NULL
      UNION ALL SELECT 'preference', event_id, scope, 'tone' || turn, 'calm' FROM h WHERE n = 3
      UNION ALL SELECT 'project_state', event_id, 'project:p' || conv_id, 'p' || conv_id, '{{"turn": ' || turn || '}}' FROM h WHERE n = 6""",
    "export_lines": f"""WITH {M}, {L} SELECT 'memories' AS "table", id::VARCHAR AS key, '{{"content":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"created_at":' || created_at || ',"id":' || id || ',"kind":"' || kind || '","salience":"' || printf('%.4f', salience) || '","scope":"' || scope || '","status":"' || status
        || '","subject":"' || subject || '","tags":["' || tag || '"]}}' AS line FROM memories
      UNION ALL SELECT 'events', id, '{{"content":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"created_at":' || created_at || ',"id":"' || id || '","role":"' || role || '","session_id":' || session_id || '}}' FROM log""",
    "mirror_files": f"""WITH {M}, {P}, {S}, nowp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY created_at DESC, id DESC) AS v FROM prefs) WHERE v = 1),
      nows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, scope ORDER BY created_at DESC, id DESC) AS v FROM states) WHERE v = 1),
      b AS (SELECT scope, 1 AS kind_no, id::VARCHAR AS id, '<!-- memory id=' || id || ' kind=' || kind || ' confidence=1.0 salience=0.5 created=' || created_at || ' scope=' || scope || ' -->' || chr(10) || coalesce(content, '') || chr(10) || chr(10) || 'tags: ' || tag || chr(10) || '<!-- /memory -->' || chr(10) AS block FROM memories WHERE status = 'active'
        UNION ALL SELECT scope, 2, id::VARCHAR, '<!-- preference id=' || id || ' key=' || key || ' confidence=1.0 created=' || id || ' scope=' || scope || ' -->' || chr(10) || key || ' = "' || substr(statement, length(key) + 4) || '"' || chr(10) || '<!-- /preference -->' || chr(10) FROM nowp
        UNION ALL SELECT scope, 3, id::VARCHAR, '<!-- project-state id=' || id || ' project=' || project_id || ' created=' || id || ' scope=' || scope || ' -->' || chr(10) || coalesce(state, 'null') || chr(10) || '<!-- /project-state -->' || chr(10) FROM nows),
      h AS (SELECT scope, 0 AS kind_no, '' AS id, '---' || chr(10) || 'generated: true' || chr(10) || 'generator: lorekeep-export' || chr(10) || 'scope: ' || scope || chr(10) || 'exported_at: 2024-01-01' || chr(10) || 'memory_count: ' || count(*) FILTER (kind_no = 1) || chr(10)
        || 'preference_count: ' || count(*) FILTER (kind_no = 2) || chr(10) || 'project_state_count: ' || count(*) FILTER (kind_no = 3) || chr(10) || '---' || chr(10) AS block FROM b GROUP BY scope)
      SELECT replace(scope, ':', '-') || '.md' AS file, kind_no::INTEGER AS kind_no, id, sha256(block) AS sha FROM (SELECT * FROM h UNION ALL SELECT * FROM b)""",
    "stale_files": f"""WITH {M} SELECT DISTINCT replace(scope, ':', '-') || '.md' AS path FROM memories WHERE starts_with(scope, 'project:')
      AND scope NOT IN (SELECT scope FROM memories WHERE status = 'active' AND kind = 'identity' AND subject = 'de')""",
    "superseded_memories": f"""WITH {M}, l AS (SELECT DISTINCT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents))
      SELECT id::VARCHAR AS id, CASE WHEN l.doc_id IS NULL THEN status ELSE 'superseded' END AS status, CASE WHEN l.doc_id IS NOT NULL THEN 'n' || id END AS superseded_by, (CASE WHEN l.doc_id IS NULL THEN 1 ELSE 2 END)::INTEGER AS revision
      FROM memories LEFT JOIN l ON l.doc_id = id UNION ALL SELECT 'n' || doc_id, 'active', NULL, 1 FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)""",
    "meta_values": "SELECT event_type || '.' || (user_id % 50) AS key, arg_max(event_id, (ts, event_id)) AS value FROM events GROUP BY 1",
    "parsed_responses": rf"""WITH c AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn % 6 AS n, trim(regexp_replace(coalesce(text, ''), '["\\\x00-\x1F]', ' ', 'g')) AS t FROM conversations),
      e AS (SELECT *, CASE WHEN n = 3 THEN 'memories[0]: unknown operation' WHEN n = 4 THEN 'memories[0]: unknown key' WHEN n <> 2 AND t = '' THEN 'memories[0]: content is missing' WHEN n <> 2 AND length(t) > 20000 THEN 'memories[0]: content is too long'
        WHEN n = 1 AND conv_id % 2 = 1 THEN 'memories[0]: supersedes_id was not among the memories shown' END AS error FROM c)
      SELECT id, CASE WHEN error IS NULL THEN 'memory' END AS target, CASE WHEN error IS NULL THEN CASE n WHEN 1 THEN 'supersede' WHEN 2 THEN 'noop' ELSE 'add' END END AS operation, CASE WHEN error IS NULL AND n <> 2 THEN 'semantic' END AS kind,
        CASE WHEN error IS NULL AND n = 1 THEN conv_id::VARCHAR END AS supersedes, CASE WHEN error IS NOT NULL THEN error WHEN n = 2 THEN 'not worth remembering' END AS reason, CASE WHEN error IS NULL AND n <> 2 THEN sha256(t) END AS content_sha FROM e""",
    "prompt_contexts": f"""WITH {M}, asked AS (SELECT item_id AS qid, text AS query FROM benchmark), {memory_hits('asked', 5, ACTIVE + " AND kind IN ('semantic', 'episodic')")},
      b AS ({best('m_hits', 5)}), l AS (SELECT qid, string_agg('- [' || kind || '] ' || coalesce(content, ''), chr(10) ORDER BY position) AS context FROM b JOIN memories m ON m.id::VARCHAR = b.id GROUP BY qid)
      SELECT asked.qid, sha256(coalesce(context, '(no relevant memories)')) AS sha FROM asked LEFT JOIN l ON l.qid = asked.qid""",
    "chunk_notes": f"WITH {TYPED} SELECT rel_path, title, 0::INTEGER AS ordinal, 1::INTEGER AS line_start, (length(text) - length(replace(text, chr(10), '')) + 1)::INTEGER AS line_end, content_hash FROM chunks",
    "route_chunks": f"WITH {TYPED} SELECT rel_path, 0::INTEGER AS ordinal, route, scope, key, value FROM chunks",
    "import_plan": f"""WITH {TYPED}, p AS (SELECT t.rel_path, c.rel_path IS NOT NULL AS has, coalesce(known, false) AS known FROM typed t LEFT JOIN chunks c USING (rel_path))
      SELECT rel_path, CASE WHEN known THEN 'unchanged' WHEN has THEN 'new' ELSE 'empty' END AS status, CASE WHEN has AND NOT known THEN 1 ELSE 0 END::BIGINT AS n_chunks, CASE WHEN has AND NOT known THEN 1 ELSE 0 END::BIGINT AS n_ingest, 0::BIGINT AS n_skipped FROM p""",
    "import_records": f"""WITH {imported()} SELECT 'event' AS relation, event_id AS id, scope, NULL::VARCHAR AS key, NULL::VARCHAR AS value, ref, content_hash, event_id FROM ev
      UNION ALL SELECT 'memory', {sortable("'memory'", 'event_id', "'add'", "''", dup('body'))}, scope, 'semantic', sha256(body), ref, content_hash, event_id FROM pick WHERE accepted
      UNION ALL SELECT route, {sortable('route', 'event_id')}, scope, key, value, ref, content_hash, event_id FROM ev WHERE n IN (1, 2)""",
    "import_counters": f"""WITH {imported()} SELECT (SELECT count(*) FROM typed) AS documents_scanned, (SELECT count(*) FROM chunks WHERE known) AS documents_unchanged, count(*) AS documents_new, 0::BIGINT AS documents_changed,
      count(*) AS chunks_planned, 0::BIGINT AS chunks_skipped_seen, count(*) AS chunks_ingested, count(*) AS events_created, (SELECT count(*) FROM pick WHERE accepted) AS memories_created,
      count(*) FILTER (n = 1) AS preferences_set, count(*) FILTER (n = 2) AS project_states_set, (SELECT count(*) FROM pick WHERE accepted) AS candidates_accepted, (SELECT count(*) FROM pick WHERE NOT accepted) AS candidates_rejected FROM ev""",
}
