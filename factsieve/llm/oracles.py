"""DuckDB SQL of the operators that SQL can express."""

from factsieve.llm.license_scan import TEMPLATES, THRESHOLD

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP5 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         {_LOWER.format("regexp_replace(regexp_replace(line, '^[ \\x09-\\x0D]+', ''), '[ \\x09-\\x0D]+$', '')")} AS k
  FROM lines
), owners AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING min(doc_id) <> max(doc_id)
), marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(o.owner <> l.doc_id, false) AS gone
  FROM keyed l LEFT JOIN owners o ON o.k = l.k AND length(l.k) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_NORMAL = f"trim(regexp_replace({_LOWER.format('{}')}, '[^a-z0-9]+', ' ', 'g'))"
_TEMPLATES = ", ".join(
    "('{}', {}, '{}')".format(name, i, text.replace("'", "''")) for name, texts in TEMPLATES.items() for i, text in enumerate(texts)
)

_OP4 = f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), marked AS (
  SELECT *, regexp_replace(line, '[ \x09-\x0D]+', '', 'g') = '' AS blank FROM lines
), parts AS (
  SELECT *, sum(CAST(blank AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY n) AS part FROM marked
), units AS (
  SELECT doc_id, n AS line, line AS unit FROM lines
  UNION ALL
  SELECT doc_id, min(n), string_agg(line, ' ' ORDER BY n) FROM parts WHERE NOT blank GROUP BY doc_id, part
), split AS (
  SELECT row_number() OVER () AS uid, doc_id, line, string_split({_NORMAL.format('unit')}, ' ') AS w FROM units
), grams AS (
  SELECT uid, w[i] || ' ' || w[i + 1] AS gram, count(*) AS n
  FROM (SELECT uid, w, unnest(range(1, len(w))) AS i FROM split) GROUP BY ALL
), template AS (
  SELECT license, nr, string_split({_NORMAL.format('body')}, ' ') AS w
  FROM (VALUES {_TEMPLATES}) AS t(license, nr, body)
), known AS (
  SELECT license, nr, len(w) - 1 AS size, w[i] || ' ' || w[i + 1] AS gram, count(*) AS n
  FROM (SELECT *, unnest(range(1, len(w))) AS i FROM template) GROUP BY ALL
), scored AS (
  SELECT uid, license, nr, 2::DOUBLE * sum(least(g.n, k.n)) / (any_value(len(s.w)) - 1 + any_value(size)) AS dice
  FROM grams g JOIN known k USING (gram) JOIN split s USING (uid) GROUP BY uid, license, nr
), rids AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), rlines AS (
  SELECT rid, doc_id, unnest(l) AS body, generate_subscripts(l, 1) - 1 AS line FROM rids
), rwords AS (
  SELECT rid, doc_id, line, unnest(w) AS w, generate_subscripts(w, 1) AS j
  FROM (SELECT *, list_filter(string_split({_NORMAL.format('body')}, ' '), lambda x: x <> '') AS w FROM rlines)
), places AS (
  SELECT rid, doc_id, line, w || ' ' || lead(w) OVER along AS gram, row_number() OVER along - 1 AS pos,
         count(*) OVER (PARTITION BY rid) - 1 AS len
  FROM rwords WINDOW along AS (PARTITION BY rid ORDER BY line, j)
), hits AS (
  SELECT rid, doc_id, line, pos, len, gram, license, nr, size, n AS most FROM places JOIN known USING (gram)
), capped AS (
  SELECT rid, license, nr, size, least(count(*), any_value(most)) AS n FROM hits GROUP BY rid, license, nr, size, gram
), possible AS (
  SELECT rid, license, nr FROM capped GROUP BY rid, license, nr, size
  HAVING sum(n) >= {THRESHOLD} * size / (2 - {THRESHOLD}) - 1e-9
), near AS (
  SELECT * FROM hits SEMI JOIN possible USING (rid, license, nr)
), begins AS (
  SELECT rid, license, nr, least(pos, greatest(len - size, 0)) AS s, min(line) AS line FROM near GROUP BY ALL
), inside AS (
  SELECT rid, license, nr, b.s, b.line, doc_id, size, len, gram, least(count(*), any_value(most)) AS n
  FROM begins b JOIN near h USING (rid, license, nr) WHERE h.pos BETWEEN b.s AND b.s + size - 1
  GROUP BY rid, license, nr, b.s, b.line, doc_id, size, len, gram
), windows AS (
  SELECT doc_id, license, 2::DOUBLE * sum(n) / (least(len, size) + size) AS dice, line
  FROM inside GROUP BY rid, doc_id, license, nr, s, line, size, len
), best AS (
  SELECT doc_id, license, dice, line, max(dice) OVER (PARTITION BY doc_id, license) AS top
  FROM (SELECT doc_id, license, dice, line FROM scored JOIN split USING (uid) UNION ALL FROM windows)
  WHERE dice >= {THRESHOLD}
)
SELECT doc_id, license, dice, CAST(min(line) AS INTEGER) AS line FROM best WHERE dice = top GROUP BY ALL
"""

ORACLES: dict[str, str] = {"op4_license_scan": _OP4, "op5_line_dedup": _OP5}
