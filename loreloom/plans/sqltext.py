"""SQL fragments the oracles share."""

BLANK = r"[\s\v\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def sql_clean(expr: str) -> str:
    unified = f"regexp_replace({expr}, '\\r\\n?', chr(10), 'g')"
    printable = f"regexp_replace({unified}, '[\\x00-\\x08\\x0b\\x0e-\\x1f]', '', 'g')"
    tight = f"regexp_replace({printable}, '[ \\t]+\\n', chr(10), 'g')"
    return sql_strip(f"regexp_replace({tight}, '\\n{{4,}}', chr(10)||chr(10)||chr(10), 'g')")


TOKEN = "[a-z0-9]+(?:[-_.][a-z0-9]+)*"


def sql_tokens(expr: str) -> str:
    """Latin tokens; the given tables hold no Han text."""
    return f"regexp_extract_all(lower({expr}), '{TOKEN}')"


# Where a chunk ends: at the last line or sentence end of its 1200 characters
# if that lies past half, else after 1200 characters.
_CUT = (
    "greatest("
    "CASE WHEN strpos(r, chr(10)) > 0 THEN length(r) - strpos(r, chr(10)) ELSE -1 END, "
    "CASE WHEN strpos(translate(r, '！？', '。。'), '。') > 0 "
    "THEN length(r) - strpos(translate(r, '！？', '。。'), '。') + 1 ELSE 0 END, "
    "CASE WHEN strpos(r, ' .') > 0 THEN length(r) - strpos(r, ' .') ELSE 0 END)"
)
_END = f"(CASE WHEN s + 1200 < n AND {_CUT} > 600 THEN s + {_CUT} ELSE least(n, s + 1200) END)::BIGINT"
_HEADING = "^#{1,6}[ \\t\\v\\f]+(.+)$"

# CTEs that end in ``chunks(doc_id, ordinal, heading, chunk_text)``.
CHUNKS = f"""
cleaned AS (SELECT doc_id, {sql_clean('text')} AS t FROM documents),
lined AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line,
         generate_subscripts(string_split(t, chr(10)), 1) AS i FROM cleaned
),
numbered AS (
  SELECT doc_id, line, i,
         sum(CASE WHEN i > 1 AND regexp_matches(line, '{_HEADING}') THEN 1 ELSE 0 END)
           OVER (PARTITION BY doc_id ORDER BY i) AS section FROM lined
),
sectioned AS (
  SELECT doc_id, section, regexp_extract(min_by(line, i), '{_HEADING}', 1) AS heading,
         {sql_strip("string_agg(line, chr(10) ORDER BY i)")} AS t
  FROM numbered GROUP BY doc_id, section
),
spans AS (
  WITH RECURSIVE w AS (
    SELECT doc_id, section, heading, t, n, s, {_END} AS e
    FROM (SELECT *, length(t) AS n, 0::BIGINT AS s, reverse(substr(t, 1, 1200)) AS r
          FROM sectioned WHERE length(t) > 0) x
    UNION ALL
    SELECT doc_id, section, heading, t, n, s, {_END} AS e
    FROM (SELECT doc_id, section, heading, t, n, greatest(s + 1, e - 120) AS s,
                 reverse(substr(t, greatest(s + 1, e - 120) + 1, 1200)) AS r
          FROM w WHERE e < n) y
  )
  SELECT doc_id, section, heading, s, {sql_strip('substr(t, s + 1, e - s)')} AS chunk_text FROM w
),
chunks AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section, s) AS ordinal,
         heading, chunk_text
  FROM spans WHERE length(chunk_text) > 0
)
"""
