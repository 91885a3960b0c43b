"""The same results in DuckDB SQL, written on their own for the correctness check.

DuckDB's regular expressions know ASCII ``\\b \\d \\s`` only; on the given tables
that finds the same matches.
"""

_THOUSANDS = "'{:,.2f}'"

# The patterns in RE2 syntax; further below also masks, reasons and rule names.
_EMAIL = r"(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b"
_PHONE = (
    r"\+\s*1[\s.\-]*\(\s*\d{3}\s*\)[\s.\-]*\d{3}[\s.\-]*\d{4}"
    r"|\+\s*7[\s.\-]*\d{3}[\s.\-]*\d{3}[\s.\-]*\d{2}[\s.\-]*\d{2}"
    r"|\b\d{3}[.\-]\d{3}[.\-]\d{4}\b"
    r"|\b\(\d{3}\)\s*\d{3}[\s.\-]*\d{4}\b"
)
_SSN = r"\b\d{3}-\d{2}-\d{4}\b"
_CARD = r"\b(?:\d{4}[\s\-]\d{4}[\s\-]\d{4}[\s\-]\d{4}|\d{16})\b"
_TYPES = {"email": _EMAIL, "phone": _PHONE, "ssn": _SSN, "credit_card": _CARD}
_NUMBER = (
    r"[±+\-]?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:[.,]\d+)?)"
    r"(?:\s*%)?(?:\s*(?i:million|thousand|billion)\b)?"
)

_DOCS = "SELECT doc_id AS id, text FROM documents"
_PAGES = "SELECT page_id AS id, html AS text FROM pages"


def _digits(expr: str, width: int) -> str:
    return f"lpad(CAST(({expr}) % {10**width} AS VARCHAR), {width}, '0')"


_CONTACTS = f"""
SELECT c_custkey AS id,
  'SSN ' || {_digits('c_custkey', 3)} || '-' || {_digits('c_custkey', 2)} || '-' ||
  {_digits('c_custkey', 4)} || ', card 4111-' || {_digits('c_custkey * 3', 4)} || '-' ||
  {_digits('c_custkey * 7', 4)} || '-' || {_digits('c_custkey', 4)} || ', phone ' ||
  {_digits('c_custkey', 3)} || '.' || {_digits('c_custkey * 3', 3)} || '.' ||
  {_digits('c_custkey * 7', 4)} || ' or tel(' || {_digits('c_custkey', 3)} || ') 555-' ||
  {_digits('c_custkey', 4)} || ', mail user' || c_custkey || '@mail' || (c_custkey % 7) ||
  '.example.com' AS text
FROM customer"""

_CLAIMS = f"""
SELECT o_orderkey AS id,
  'Order ' || o_orderkey || ' total ' || CASE o_orderkey % 12
    WHEN 0 THEN format({_THOUSANDS}, o_totalprice)
    WHEN 1 THEN format('{{:,.5f}}', o_totalprice / 1000) || ' thousand'
    WHEN 2 THEN format('{{:,.3f}}', o_totalprice + 0.005)
    WHEN 3 THEN format({_THOUSANDS}, o_totalprice + 5)
    WHEN 4 THEN translate(format({_THOUSANDS}, o_totalprice), ',.', '.,')
    WHEN 5 THEN format('{{:,.8f}}', o_totalprice / 1e6) || ' Million'
    WHEN 6 THEN format('{{:,.11f}}', o_totalprice / 1e9) || ' billion'
    WHEN 7 THEN '±' || format({_THOUSANDS}, o_totalprice)
    WHEN 8 THEN '-' || format({_THOUSANDS}, o_totalprice)
    WHEN 9 THEN '+' || format({_THOUSANDS}, o_totalprice) || ' %'
    WHEN 10 THEN format({_THOUSANDS}, o_totalprice) || '%'
    ELSE 'not stated' END || ' in all.' ||
  CASE WHEN o_orderkey % 10 = 0 THEN ' Mail user' || o_orderkey || '@example.com' ELSE '' END AS text,
  CASE WHEN o_orderkey % 7 = 0 THEN ''
    ELSE 'Total ' || format({_THOUSANDS}, o_totalprice) || ', order ' || o_orderkey END AS context
FROM orders"""

_EVIDENCE = f"""
SELECT l_orderkey AS id, 'Line price ' || format({_THOUSANDS}, l_extendedprice) AS text FROM lineitem
UNION ALL SELECT id, context AS text FROM ({_CLAIMS}) WHERE context <> ''"""


def _any_pii(text: str = "text") -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{p}')" for p in _TYPES.values()) + ")"


def _located(source: str, pattern: str) -> str:
    """id, k (from 1), raw and both kinds of offsets of each match."""
    return f"""
SELECT id, k, hits[k] AS raw,
  CAST(list_sum(list_transform(gaps[1:k], lambda x: strlen(x)))
    + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: strlen(x))), 0) AS INTEGER) AS b,
  CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x)))
    + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS INTEGER) AS c
FROM (SELECT id, hits, gaps, unnest(range(1, len(hits) + 1)) AS k FROM (
  SELECT id, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps
  FROM ({source})) WHERE len(hits) > 0)"""


def _last4(raw: str) -> str:
    return f"right(regexp_replace({raw}, '[^0-9]', '', 'g'), 4)"


_MASKS = {
    "email": "substr(raw, 1, 1) || '***@' || substr(raw, strpos(raw, '@') + 1)",
    "phone": f"'***-***-' || {_last4('raw')}",
    "ssn": f"'***-**-' || {_last4('raw')}",
    "credit_card": f"'**** **** **** ' || {_last4('raw')}",
}


def _spans(source: str, types=tuple(_TYPES)) -> str:
    return " UNION ALL ".join(
        f"""
SELECT id, '{t}' AS pii_type, b AS "start", CAST(b + strlen(raw) AS INTEGER) AS "end",
  c AS start_char, CAST(c + length(raw) AS INTEGER) AS end_char, raw, {_MASKS[t]} AS masked,
  {list(_TYPES).index(t)} AS type_rank, k, b, b + strlen(raw) AS e
FROM ({_located(source, _TYPES[t])})"""
        for t in types
    )


def _span_query(source: str, types=tuple(_TYPES)) -> str:
    return (
        "SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY b, e, type_rank) - 1 AS INTEGER) AS ord, "
        'pii_type, "start", "end", start_char, end_char, raw, masked '
        f"FROM ({_spans(source, types)})"
    )


def _value(raw: str) -> str:
    core = f"regexp_extract({raw}, '[0-9.,]+')"
    return f"""
(CASE WHEN starts_with({raw}, '-') THEN -1.0 ELSE 1.0 END) * TRY_CAST({_normal(core)} AS DOUBLE)
 * {_factor(raw)}"""


def _normal(core: str) -> str:
    return f"""CASE
  WHEN contains({core}, ',') AND contains({core}, '.') THEN
    CASE WHEN regexp_matches({core}, ',[^.]*$') THEN replace(replace({core}, '.', ''), ',', '.')
      ELSE replace({core}, ',', '') END
  WHEN contains({core}, ',') THEN
    CASE WHEN regexp_matches({core}, '^[^,]*(,[^,]{{3}})+$') THEN replace({core}, ',', '')
      WHEN regexp_matches({core}, '^[^,]*,[^,]*$') THEN replace({core}, ',', '.')
      ELSE replace({core}, ',', '') END
  WHEN regexp_matches({core}, '^[^.]*([.][^.]{{3}}){{2,}}$') THEN replace({core}, '.', '')
  ELSE {core} END"""


def _factor(raw: str) -> str:
    return f"""(CASE WHEN regexp_matches({raw}, '(?i)billion') THEN 1e9
  WHEN regexp_matches({raw}, '(?i)million') THEN 1e6
  WHEN regexp_matches({raw}, '(?i)thousand') THEN 1e3 ELSE 1.0 END)"""


def _numbers(source: str) -> str:
    return f"""
SELECT id, CAST(k - 1 AS INTEGER) AS ord, hits[k] AS raw, {_value('hits[k]')} AS value
FROM (SELECT id, hits, unnest(range(1, len(hits) + 1)) AS k FROM (
  SELECT id, regexp_extract_all(text, '{_NUMBER}') AS hits FROM ({source})) WHERE len(hits) > 0)"""


def _number_spans(source: str) -> str:
    return f"""
SELECT id, CAST(k - 1 AS INTEGER) AS ord, {_value('raw')} AS value, b AS "start",
  CAST(b + strlen(raw) AS INTEGER) AS "end", c AS start_char,
  CAST(c + length(raw) AS INTEGER) AS end_char, raw
FROM ({_located(source, _NUMBER)})"""


_CLAIM_NUMBERS = _numbers(f"SELECT id, text FROM ({_CLAIMS})")
_CONTEXT_NUMBERS = _numbers(f"SELECT id, context AS text FROM ({_CLAIMS})")
_EVIDENCE_NUMBERS = _numbers(_EVIDENCE)


def _by_key(exists: str, contexts: str) -> str:
    return f"""
WITH a AS MATERIALIZED ({_CLAIM_NUMBERS}), c AS MATERIALIZED ({contexts})
SELECT a.id AS request_id, a.ord, a.value FROM a
WHERE {exists} (SELECT 1 FROM c WHERE c.id = a.id AND abs(c.value - a.value) <= 0.01)"""


def _against(answers: str, facts: str, id_name: str, kind: str = "ANTI") -> str:
    return f"""
WITH a AS MATERIALIZED ({answers}), f AS MATERIALIZED (SELECT DISTINCT value FROM ({facts})),
hit AS (SELECT DISTINCT a.id, a.ord FROM a JOIN f
  ON f.value >= a.value - 0.02 AND f.value <= a.value + 0.02 WHERE abs(f.value - a.value) <= 0.01)
SELECT a.id AS {id_name}, a.ord, a.value FROM a {kind} JOIN hit ON a.id = hit.id AND a.ord = hit.ord"""


def _verdicts(pii: bool, numeric: bool) -> str:
    return f"""
WITH u AS MATERIALIZED ({_by_key('NOT EXISTS', _CONTEXT_NUMBERS)}),
n AS (SELECT request_id, count(*) AS n, sum(value ORDER BY ord) AS s FROM u GROUP BY 1),
p AS MATERIALIZED ({_spans(f'SELECT id, text FROM ({_CLAIMS})')}),
v AS (SELECT id, count(*) AS n,
  string_agg('pii:' || pii_type || ':' || masked, ',' ORDER BY type_rank, k) AS list FROM p GROUP BY 1)
SELECT c.id AS request_id,
  {'coalesce(v.n, 0)' if pii else '0'} + {'coalesce(n.n, 0)' if numeric else '0'} = 0 AS passed,
  CAST({'coalesce(v.n, 0)' if pii else '0'} + {'coalesce(n.n, 0)' if numeric else '0'} AS INTEGER)
    AS n_violations,
  CAST({'coalesce(n.n, 0)' if numeric else '0'} AS INTEGER) AS n_unmatched,
  CAST({'coalesce(n.s, 0)' if numeric else '0'} AS DOUBLE) AS unmatched_sum,
  {"coalesce(v.list, '')" if pii else "''"} AS pii
FROM ({_CLAIMS}) c LEFT JOIN n ON n.request_id = c.id LEFT JOIN v ON v.id = c.id"""


_VERIFY_DOCUMENTS = f"""
WITH n AS (SELECT id, count(*) AS n FROM ({_numbers(_DOCS)}) GROUP BY 1),
p AS (SELECT id, count(*) AS n FROM ({_spans(_DOCS)}) GROUP BY 1)
SELECT d.doc_id AS request_id, coalesce(p.n, 0) + coalesce(n.n, 0) = 0 AS passed,
  CAST(coalesce(p.n, 0) + coalesce(n.n, 0) AS INTEGER) AS n_violations,
  CAST(coalesce(n.n, 0) AS INTEGER) AS n_unmatched
FROM documents d LEFT JOIN n ON n.id = d.doc_id LEFT JOIN p ON p.id = d.doc_id"""

_TOKENS = """
SELECT user_id AS session_id, event_id AS seq, event_id AS token_id, event_id * 10 AS position,
  event_type = 'error' AS is_reset FROM events"""
_SEGMENTS = f"""
SELECT *, CAST(sum(CAST(is_reset AS INTEGER)) OVER (PARTITION BY session_id ORDER BY seq
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM ({_TOKENS})"""

_DELTAS = r"""
SELECT CAST(doc_id AS VARCHAR) AS session_id, CAST(0 AS BIGINT) AS seq, '' AS delta, true AS ids
FROM documents WHERE doc_id % 3 = 0
UNION ALL
SELECT CAST(doc_id AS VARCHAR), CAST(k - 1 + (doc_id % 3 = 0)::INTEGER AS BIGINT), pieces[k], false
FROM (SELECT doc_id, pieces, unnest(range(1, len(pieces) + 1)) AS k FROM (
  SELECT doc_id, regexp_extract_all(text, '(?s).{1,256}') AS pieces FROM documents))"""
_ACCUMULATED = f"""
SELECT session_id, seq, ids, string_agg(delta, '') OVER (PARTITION BY session_id ORDER BY seq
  ROWS UNBOUNDED PRECEDING) AS text FROM ({_DELTAS})"""
_REPEATED = " || ".join(f"repeat('{t},', n_{t})" for t in _TYPES)
_COUNTED = ", ".join(f"len(regexp_extract_all(text, '{p}')) AS n_{t}" for t, p in _TYPES.items())
_STREAM_VERDICTS = f"""
SELECT session_id, seq, action, code AS action_code, CASE code WHEN 1 THEN 'pii detected in stream'
    WHEN 2 THEN 'token_ids without text_delta; decode upstream or send text_delta' ELSE 'ok' END AS reason,
  CASE WHEN code = 2 THEN 'missing_text_delta' ELSE rtrim(found, ',') END AS matched_rules
FROM (SELECT *, CASE code WHEN 1 THEN 'BLOCK' WHEN 2 THEN 'FLAG' ELSE 'PASS' END AS action
  FROM (SELECT *, CASE WHEN found <> '' THEN 1 WHEN text = '' AND ids THEN 2 ELSE 0 END AS code
    FROM (SELECT *, {_REPEATED} AS found FROM (SELECT *, {_COUNTED} FROM ({_ACCUMULATED})))))"""


def _flag(source: str, test: str, name: str = "flag") -> str:
    return f"SELECT id, {test} AS {name} FROM ({source})"


def _match(pattern: str) -> str:
    return f"regexp_matches(text, '{pattern}')"


ORACLES = {
    "contains_pii": _flag(_DOCS, _any_pii(), "has_pii"),
    "contains_pii_pages": _flag(_PAGES, _any_pii()),
    "has_email": _flag(_DOCS, _match(_EMAIL)),
    "has_phone": _flag(_DOCS, _match(_PHONE)),
    "has_credit_card": _flag(_DOCS, _match(_CARD)),
    "has_ssn": _flag(_CONTACTS, _match(_SSN)),
    "filter_documents_with_pii": (
        f"SELECT id, CAST(length(text) AS INTEGER) AS chars FROM ({_DOCS}) WHERE {_any_pii()}"
    ),
    "detect_pii": _span_query(_DOCS),
    "detect_pii_pages": _span_query(_PAGES),
    "detect_pii_contacts": _span_query(_CONTACTS),
    "email_spans": _span_query(_CONTACTS, ["email"]),
    "phone_spans": _span_query(_CONTACTS, ["phone"]),
    "ssn_spans": _span_query(_CONTACTS, ["ssn"]),
    "credit_card_spans": _span_query(_CONTACTS, ["credit_card"]),
    "pii_violations": f"""
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY type_rank, k) - 1 AS INTEGER) AS ord,
  'pii:' || pii_type || ':' || masked AS violation
FROM ({_spans(f"{_DOCS} UNION ALL SELECT -id - 1 AS id, text FROM ({_CONTACTS})")})""",
    "matched_rules": f"""
SELECT id, string_agg(pii_type, ',' ORDER BY type_rank, k) AS matched_rules
FROM ({_spans(_DOCS)}) GROUP BY id""",
    "pii_by_type": f"""
SELECT source, lang, pii_type, count(*) AS matches, CAST(sum("end" - "start") AS BIGINT) AS bytes
FROM ({_spans(_DOCS)}) s JOIN documents d ON d.doc_id = s.id GROUP BY ALL""",
    "extract_numerics_documents": _number_spans(_DOCS),
    "extract_numerics_pages": _number_spans(_PAGES),
    "numeric_values": f"SELECT id AS request_id, ord, value FROM ({_CLAIM_NUMBERS})",
    "lexeme_values": f"""
SELECT raw, count(*) AS n, any_value(value) AS value,
  {_normal("regexp_extract(raw, '[0-9.,]+')")} AS digits, {_factor('raw')} AS factor
FROM (SELECT * FROM ({_CLAIM_NUMBERS}) UNION ALL SELECT * FROM ({_CONTEXT_NUMBERS})) GROUP BY raw""",
    "grounded_numbers_by_order": _by_key("EXISTS", _EVIDENCE_NUMBERS),
    "unmatched_numerics_by_order": _by_key("NOT EXISTS", _EVIDENCE_NUMBERS),
    "answers_grounded_by_order": f"""
WITH u AS (SELECT DISTINCT request_id FROM ({_by_key('NOT EXISTS', _EVIDENCE_NUMBERS)}))
SELECT o_orderkey AS request_id, u.request_id IS NULL AS grounded
FROM orders LEFT JOIN u ON u.request_id = o_orderkey""",
    "unmatched_numerics_in_row": f"""
SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY ord) - 1 AS INTEGER) AS ord,
  value FROM ({_by_key('NOT EXISTS', _CONTEXT_NUMBERS)})""",
    "answer_grounded_in_row": f"""
WITH u AS (SELECT DISTINCT request_id FROM ({_by_key('NOT EXISTS', _CONTEXT_NUMBERS)}))
SELECT o_orderkey AS request_id, u.request_id IS NULL AS grounded
FROM orders LEFT JOIN u ON u.request_id = o_orderkey""",
    "verify_total": f"""
WITH c AS MATERIALIZED ({_CONTEXT_NUMBERS})
SELECT o_orderkey AS request_id, EXISTS (SELECT 1 FROM c
  WHERE c.id = o_orderkey AND abs(c.value - o_totalprice) <= 0.01) AS found FROM orders""",
    "unmatched_against_all_lines": _against(
        _CLAIM_NUMBERS, "SELECT l_extendedprice AS value FROM lineitem", "request_id"
    ),
    "grounded_against_all_lines": _against(
        _CLAIM_NUMBERS, "SELECT l_extendedprice AS value FROM lineitem", "request_id", "SEMI"
    ),
    "document_numbers_not_in_pages": _against(_numbers(_DOCS), _numbers(_PAGES), "id"),
    "verify_text": _verdicts(True, True),
    "verdicts_through_files": _verdicts(True, True),
    "verify_text_pii_only": _verdicts(True, False),
    "verify_text_numeric_only": _verdicts(False, True),
    "verify_text_unknown_rule": _verdicts(False, False),
    "violations_list": f"""
WITH u AS MATERIALIZED ({_by_key('NOT EXISTS', _CONTEXT_NUMBERS)}),
p AS MATERIALIZED ({_spans(f'SELECT id, text FROM ({_CLAIMS})')})
SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY r, k) - 1 AS INTEGER) AS ord,
  kind, number
FROM (SELECT id AS request_id, type_rank AS r, k, 'pii' AS kind,
    CASE WHEN regexp_matches(masked, '^[0-9]+$') THEN CAST(masked AS DOUBLE) END AS number FROM p
  UNION ALL SELECT request_id, 9, ord, 'numeric_unmatched', value FROM u)""",
    "verify_documents": _VERIFY_DOCUMENTS,
    "verdicts_by_label": f"""
SELECT quality, toxic, count(*) AS documents, CAST(sum(CAST(passed AS INTEGER)) AS BIGINT) AS passed,
  CAST(sum(n_violations) AS BIGINT) AS violations
FROM ({_VERIFY_DOCUMENTS}) v JOIN labels ON labels.doc_id = v.request_id GROUP BY ALL""",
    "last_n_tokens_by_user": f"""
SELECT session_id, seq, string_agg(CAST(token_id AS VARCHAR), ',') OVER (PARTITION BY session_id
  ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS last_n FROM ({_TOKENS})""",
    "last_n_tokens_after_clear": f"""
SELECT session_id, segment, seq, string_agg(CAST(token_id AS VARCHAR), ',') OVER
  (PARTITION BY session_id, segment ORDER BY seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS last_n
FROM ({_SEGMENTS}) WHERE NOT is_reset""",
    "retain_last_tokens": f"""
SELECT session_id, seq, token_id, position FROM ({_TOKENS})
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 8""",
    "latest_tokens_by_user": f"""
SELECT session_id, string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY seq) AS last_n
FROM (SELECT * FROM ({_TOKENS})
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 3) GROUP BY 1""",
    "token_segments_by_user": f"SELECT session_id, seq, segment FROM ({_SEGMENTS}) WHERE NOT is_reset",
    "window_length_by_user": f"""
SELECT session_id, seq, CAST(least(held, 3) AS BIGINT) AS window_len, held = 0 AS is_empty,
  CAST(3 AS BIGINT) AS capacity
FROM (SELECT *, sum(CAST(NOT is_reset AS INTEGER)) OVER (PARTITION BY session_id, segment ORDER BY seq
  ROWS UNBOUNDED PRECEDING) AS held FROM ({_SEGMENTS}))""",
    "accumulated_text": f"""
SELECT session_id, seq, length(text) AS chars, md5(text) AS digest FROM ({_ACCUMULATED})""",
    "text_digests_of_documents": f"""
SELECT session_id, seq, length(text) AS chars, list_reduce(list_prepend(CAST(0 AS BIGINT),
  list_transform(list_reverse(regexp_extract_all(text, '(?s).')), lambda c: CAST(unicode(c) AS BIGINT))),
  lambda h, c: (h * 1000003 + c) % 2147483647) AS digest FROM ({_ACCUMULATED})""",
    "verify_deltas_of_documents": _STREAM_VERDICTS,
    "verify_stream_of_documents": _STREAM_VERDICTS,
    "last_n_stream_of_events": f"""
SELECT session_id, seq, string_agg(CAST(token_id AS VARCHAR), ',') OVER w AS last_n,
  least(count(*) OVER (PARTITION BY session_id, segment ORDER BY seq ROWS UNBOUNDED PRECEDING), 4)
    AS window_len
FROM ({_SEGMENTS}) WHERE NOT is_reset
WINDOW w AS (PARTITION BY session_id, segment ORDER BY seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
}
