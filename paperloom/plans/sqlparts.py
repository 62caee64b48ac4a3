"""Shared pieces of the SQL twins: the same logical tables, written independently in SQL."""

# Ten lines per page.
DOC_PAGES = """
lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
),
doc_pages AS (
  SELECT doc_id, CAST(pos // 10 + 1 AS INTEGER) AS page, string_agg(line, chr(10) ORDER BY pos) AS text
  FROM lines GROUP BY ALL
)"""

CONV_PAGES = """
conv_pages AS (SELECT conv_id, CAST(turn + 1 AS INTEGER) AS page, role, text FROM conversations)"""

FULL_TEXT = DOC_PAGES + """,
full_text AS (
  SELECT doc_id, count(*) AS n_pages, trim(string_agg(text, chr(10) || chr(10) ORDER BY page), E' \\t\\n\\r') AS body
  FROM doc_pages GROUP BY doc_id
)"""


def py_round(x: str, digits: int) -> str:
    """Half to even on the exact binary value, through a wide integer (0 <= x < 2^30)."""
    scale = 10 ** digits
    scaled = f"(CAST(trunc({x}) AS HUGEINT) * 1152921504606846976 + CAST(({x} - trunc({x})) * 1152921504606846976 AS HUGEINT)) * {scale}"
    whole = f"({scaled} // 1152921504606846976)"
    rest = f"({scaled} % 1152921504606846976)"
    up = f"CASE WHEN {rest} > 576460752303423488 OR ({rest} = 576460752303423488 AND {whole} % 2 = 1) THEN 1 ELSE 0 END"
    return f"(CAST({whole} + {up} AS DOUBLE) / {scale}.0)"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def text_literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"
