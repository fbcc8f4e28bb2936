"""One query per text operator, each over its whole table with production parameters, and its SQL where SQL can tell."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quakeframe.llm import conversations, decontaminate, lengths, minhash, negatives, packing, pii, quality, rules, secrets, simhash, toxicity, warc
from quakeframe.llm.common import discard, shared_folder, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    found = warc.archive_pages(table(spark, sf_dir, "pages"), at).drop("record_id")
    discard(spark, at)  # what was read from the archives has been written elsewhere
    return found


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.token_counts(table(spark, sf_dir, "documents"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(table(spark, sf_dir, "conversations"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_warc": op2_warc,
    "op3_pii": op3_pii,
    "op4_minhash": op4_minhash,
    "op5_quality": op5_quality,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_counts": op7_token_counts,
    "op8_rules": op8_rules,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
    "op11_negatives": op11_negatives,
    "op12_conversations": op12_conversations,
    "op13_simhash": op13_simhash,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _found(kind: int, pattern: str, group: int) -> str:
    return f"SELECT rid, owner, repository, {kind} AS kind, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS g FROM d"


#: Five hexadecimal digits of a SHA-1 are four letters in base 32.
_BASE32 = "array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, k * 5 + 1, 5))::INT >> b) & 31) + 1)::INT, 1)), '')), '')"

ORACLE_SQL = {
    "op1_secrets": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(source, '') || chr(31) || coalesce(lang, '') AS repository FROM documents),
raw AS ({_found(0, _ASSIGN, 2)} UNION ALL {_found(1, "AKIA[A-Z0-9]+", 0)} UNION ALL {_found(2, "[0-9a-f]{24,}", 0)} UNION ALL {_found(3, "[A-Za-z0-9+/_=-]{24,}", 0)}),
e AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw WHERE len(m) > 0),
c0 AS (SELECT rid, owner, repository, kind, m[i] AS s, v[i] AS v, (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a FROM e),
c1 AS (SELECT *, a + length(s) AS b, list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: -((length(v) - length(replace(v, c, ''))) / length(v)) * log2((length(v) - length(replace(v, c, ''))) / length(v)))) >= {secrets.LIVE_BITS} AS live FROM c0),
base AS (SELECT * FROM c1 WHERE (kind = 0 AND length(v) >= 6) OR (kind = 1 AND length(s) >= 20) OR kind = 2),
own AS (SELECT * FROM c1 WHERE kind = 3 AND live AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM base WHERE base.rid = c1.rid AND base.a < c1.b AND c1.a < base.b)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM own),
held AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories FROM every GROUP BY v),
cl AS (SELECT rid, kind, a, owners, repositories, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || a || ':' || b AS span, CASE WHEN owners >= {secrets.EXAMPLE_OWNERS} OR owners > 1 AND repositories >= {secrets.EXAMPLE_REPOSITORIES} THEN 'example' WHEN live THEN 'live' ELSE 'plain' END AS class FROM every JOIN held USING (v)),
agg AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(span, ',' ORDER BY a, kind) FILTER (kind < 3) AS bs,
  string_agg(span, ',' ORDER BY a, kind) FILTER (kind < 3 OR class = 'live') AS spans, count(*) FILTER (kind < 3 AND class = 'example') AS n_example, count(*) FILTER (class = 'live') AS n_live,
  max(owners) FILTER (kind < 3 OR class = 'live') AS max_owners, max(repositories) FILTER (kind < 3 OR class = 'live') AS max_repositories FROM cl GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(bs, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_example, 0) AS n_example, coalesce(n_live, 0) AS n_live, coalesce(max_owners, 0) AS max_owners, coalesce(max_repositories, 0) AS max_repositories
FROM d LEFT JOIN agg USING (rid)""",
    "op2_warc": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
x AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM x""",
    "op4_minhash": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(c.m, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op6_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda p: array_to_string(w[p:p + n - 1], ' '))) AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda p: {{'p': p, 'g': array_to_string(w[p:p + n - 1], ' ')}})) AS x
  FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
h AS (SELECT DISTINCT dw.doc_id, iw.item_id, x.p AS p, dw.n AS n FROM dw JOIN iw ON dw.n = iw.n AND x.g = iw.g),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op11_negatives": """
WITH e AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)::INT AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}


def _edit(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """A state's least cost, audit and text after one more edit, in SQL."""
    text = f"{state}.text" if line is None else f"CASE WHEN {state}.text = '' THEN {line} ELSE {state}.text || chr(10) || {line} END"
    return f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'text': {text}}}"


def _inserted(states: str) -> str:
    """Rows of `states` with the states 1 to 4 (nothing, s, u, a) after insertions that make one cheaper."""
    u = f"least(b[3], {_edit('b[1]', '5', 'I', chr(39) + 'user:' + chr(39))}, {_edit('b[2]', '5', 'I', chr(39) + 'user:' + chr(39))}, {_edit('b[4]', '5', 'I', chr(39) + 'user:' + chr(39))})"
    return f"SELECT * EXCLUDE (b, u), [b[1], b[2], u, least(b[4], {_edit('u', '5', 'I', chr(39) + 'assistant:' + chr(39))})] AS b FROM (SELECT *, {u} AS u FROM ({states}))"


def _taken() -> str:
    """The four states after row r, from the states b before it."""
    line, never = "r.role || ':' || r.text", "{'cost': 1000000, 'audit': '', 'text': ''}"
    keep = lambda state, initial: f"CASE WHEN r.fault NOT IN ('b', 'd') AND r.ini = '{initial}' THEN {_edit(state, 'more', 'K', line)} ELSE {never} END"
    new = lambda state, role: f"CASE WHEN r.fault NOT IN ('b', 'd') THEN {_edit(state, '1 + more', 'R', chr(39) + role + ':' + chr(39) + ' || r.text')} ELSE {never} END"
    gone = lambda k: _edit(f"b[{k}]", "2", "D")
    to_u = ", ".join(f"{keep(f'b[{k}]', 'u')}, {new(f'b[{k}]', 'user')}" for k in (1, 2, 4))
    return f"[{gone(1)}, least({gone(2)}, {keep('b[1]', 's')}), least({gone(3)}, {to_u}), least({gone(4)}, {keep('b[3]', 'a')}, {new('b[3]', 'assistant')})]"


ORACLE_SQL["op12_conversations"] = f"""
WITH RECURSIVE t AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS n))),
raw AS (SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
kinds AS (SELECT raw.*, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i, 1))::BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c // 256)), 4294967295::BIGINT) % 20 AS kind FROM raw, t),
hurt AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS p FROM hurt),
faults AS (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '?' END AS ini, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY p) > 1 THEN 'd'
  WHEN regexp_matches(text, '[^\\x20\\x09-\\x0D.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '-' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY p) || left(role, 1) AS two FROM placed),
convs AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, list({{'role': role, 'text': text, 'ini': ini, 'fault': fault}} ORDER BY p) AS l FROM faults GROUP BY conv),
dp(conv, l, i, b) AS (SELECT conv, l, 0, [{{'cost': 0, 'audit': '', 'text': ''}}, {{'cost': 1000000, 'audit': '', 'text': ''}}, {{'cost': 1000000, 'audit': '', 'text': ''}}, {{'cost': 1000000, 'audit': '', 'text': ''}}] FROM convs
  UNION ALL SELECT conv, l, i + 1, {_taken()} FROM ({_inserted("SELECT *, l[i + 1] AS r, CASE WHEN l[i + 1].fault = 't' THEN 5 ELSE 0 END AS more FROM dp WHERE i < len(l)")})),
best AS (SELECT conv, least(b[1], b[4]) AS x FROM ({_inserted("SELECT * FROM dp WHERE i = len(l)")}))
SELECT a.conv AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(x.cost, 0)::BIGINT AS cost, coalesce(x.audit, '') AS audit, sha256(coalesce(x.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv FROM raw) a LEFT JOIN convs ON a.conv IS NOT DISTINCT FROM convs.conv LEFT JOIN best ON a.conv IS NOT DISTINCT FROM best.conv"""
