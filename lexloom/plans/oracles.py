"""Building blocks of the SQL statements."""

from __future__ import annotations

#: White space as a character class; the engines under test and the oracle read the same notation.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{WS}+'), lambda w: w <> '')"


#: Lines of every document with words: (doc_id, line_idx, words).
LINES = f"""
    raw AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE {trim("text")} <> ''),
    lines AS (SELECT doc_id, CAST(i AS INTEGER) AS line_idx, {words("parts[i]")} AS words, len(parts) AS n_lines
              FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM raw))"""

#: Proportional buckets of the marked block text: (doc_id, line_idx, words, bucket).
BUCKETS = f"""{LINES},
    blocks AS (SELECT doc_id, list_prepend('EN:', flatten(list(words ORDER BY line_idx))) AS tokens,
                      sum(len(words)) AS total FROM lines GROUP BY doc_id),
    parted AS (SELECT l.*, b.tokens, len(b.tokens) AS n, b.total, len(b.tokens) * len(words) // b.total AS q,
                      len(b.tokens) * len(words) % b.total AS r FROM lines l JOIN blocks b USING (doc_id)),
    taken AS (SELECT *, q + CASE WHEN 2 * r > total OR (2 * r = total AND q % 2 = 1) THEN 1 ELSE 0 END AS take FROM parted),
    placed AS (SELECT *, least(n, coalesce(sum(take) OVER (PARTITION BY doc_id ORDER BY line_idx
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS start FROM taken),
    buckets AS (SELECT doc_id, line_idx, words,
                       CASE WHEN line_idx = n_lines THEN tokens[CAST(start AS INT) + 1:]
                            ELSE tokens[CAST(start AS INT) + 1:CAST(least(start + take, n) AS INT)] END AS bucket FROM placed)"""
