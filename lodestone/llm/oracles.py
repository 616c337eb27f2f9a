"""DuckDB SQL for the corpus queries that SQL can express.

Without SQL are: op3 (scores by context), op4 (too slow over all bytes), op8 and op9.
"""

from __future__ import annotations

from lodestone.llm import licenses, quality, queries

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(_text(v) for v in r) + ")" for r in rows)


def _run(n: int, column: str = "w") -> str:
    """A window of ``n`` words from the present row on; null beyond the text's end."""
    return " || ' ' || ".join([column, *(f"lead({column}, {k}) OVER o" for k in range(1, n))])


def _low(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


def _words(table: str, text: str, word: str, id_: str = "doc_id") -> str:
    """CTEs ``{table}_t`` (row, id, ws) and ``{table}_w`` (row, i, w)."""
    return f"""{table}_t AS (SELECT row_number() OVER () AS row, {id_}, regexp_extract_all({text}, '{word}') AS ws FROM {table}),
 {table}_w AS (SELECT row, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM {table}_t)"""


def _url() -> str:
    return f"""WITH u AS (SELECT page_id, url, false AS listed FROM pages UNION ALL SELECT NULL, url, true FROM pages WHERE regexp_matches(url, '{queries.LISTED}')),
 s AS (SELECT *, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest, split_part(url, '#', 1) AS bare FROM u),
 h AS (SELECT *, CASE WHEN rest IS NULL THEN '' ELSE {_low("regexp_extract(rest, '^[^/?#]*')")} END AS host, CASE WHEN rest IS NULL THEN '' ELSE regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) END AS path,
  list_sort(list_filter(string_split(CASE WHEN instr(bare, '?') > 0 THEN substr(bare, instr(bare, '?') + 1) ELSE '' END, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid|ref)(=|$)'))) AS pairs FROM s),
 c AS (SELECT *, regexp_replace(regexp_replace(host, '^www[.]', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(pairs, '&') ELSE '' END AS own FROM h),
 r(v, rh, rp) AS ({_values(queries.RULES)}),
 f AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM (SELECT DISTINCT host, path FROM c) JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
 SELECT page_id, c.host, c.path, rule, CASE WHEN rule IS NOT NULL THEN v WHEN c.host <> '' AND own IN (SELECT own FROM c WHERE listed) THEN 'block' ELSE 'allow' END AS verdict
 FROM c LEFT JOIN f ON f.host = c.host AND f.path = c.path WHERE NOT listed"""


def _quality() -> str:
    ends = quality.ENDS.replace("'", "''")
    count = lambda x, of: f"length(regexp_replace({x}, '[^{of}]', '', 'g'))"
    n = quality.WINDOW
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {_words("d", "text", _WORD, "doc_id, text")},
 g AS (SELECT row, i, {_run(n)} AS k FROM d_w WINDOW o AS (PARTITION BY row ORDER BY i)),
 a AS (SELECT row, i, CAST(k IS NOT NULL AND count(*) OVER (PARTITION BY row, k) > 1 AS INT) AS again FROM g),
 c AS (SELECT row, max(again) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS hit FROM a),
 rep AS (SELECT row, CAST(sum(hit) AS BIGINT) AS n FROM c GROUP BY row),
 l AS (SELECT row, line, length(line) AS size, len(regexp_extract_all(line, '{_WORD}')) AS n FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d_t) WHERE regexp_matches(line, '{_WORD}')),
 b AS (SELECT *, {count("line", quality.BARS)} AS bars FROM l),
 x AS (SELECT row, line, size, (n < {quality.SHORT_LINE} AND NOT regexp_matches(line, '{ends}')) OR {count("line", quality.SYMBOLS)} * 10 > size OR (bars >= 3 AND n <= (bars + 1) * 4) OR (n <= 25 AND regexp_matches(line, '{quality.BOILERPLATE}')) AS bad FROM b),
 y AS (SELECT row, count(*) - count(DISTINCT line) AS dup, CAST(sum(size) AS BIGINT) AS size, CAST(coalesce(sum(size) FILTER (WHERE bad), 0) AS BIGINT) AS lost FROM x GROUP BY row),
 z AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST({count("text", quality.SYMBOLS)} AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(size, 0) AS size, coalesce(lost, 0) AS lost_chars
  FROM d_t t LEFT JOIN rep ON rep.row = t.row LEFT JOIN y ON y.row = t.row)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
 NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AND lost_chars * 100 <= size * {quality.MAX_LOST_PERCENT} AS kept, lost_chars FROM z"""


def _passages() -> str:
    n = 35
    return f"""WITH {_words("documents", "coalesce(text, '')", _WORD)},
 g AS (SELECT row, i, w, md5({_run(n)}) AS k FROM documents_w WINDOW o AS (PARTITION BY row ORDER BY i)),
 a AS (SELECT row, i, w, CAST(k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 AS INT) AS again FROM g),
 c AS (SELECT row, i, w, max(again) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS hit FROM a),
 s AS (SELECT row, CAST(sum(hit) AS BIGINT) AS n, string_agg(w, ' ' ORDER BY i) FILTER (WHERE hit = 0) AS kept FROM c GROUP BY row)
 SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents_t t LEFT JOIN s ON s.row = t.row"""


def _near() -> str:
    return f"""WITH RECURSIVE {_words("documents", _low("coalesce(text, '')"), _WORD)},
 g AS (SELECT row, i, w, {_run(2)} AS k FROM documents_w WINDOW o AS (PARTITION BY row ORDER BY i)),
 sh AS (SELECT DISTINCT row, hash(k) AS k FROM (SELECT row, k FROM g WHERE k IS NOT NULL UNION ALL SELECT row, w FROM g JOIN documents_t USING (row) WHERE len(ws) = 1)),
 st AS (SELECT row, count(*) AS n, md5(string_agg(k, ',' ORDER BY k)) AS class FROM sh GROUP BY row),
 cl AS (SELECT class, min(row) AS row, any_value(n) AS n FROM st GROUP BY class),
 one AS (SELECT class, n, k FROM sh JOIN cl USING (row)),
 pr AS (SELECT a.class AS a, b.class AS b FROM one a JOIN one b ON a.k = b.k AND a.class < b.class AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
 e AS (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr),
 reach AS (SELECT class AS a, class AS b FROM cl UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
 m AS (SELECT class, min(doc_id) AS least FROM st JOIN documents_t USING (row) GROUP BY class),
 co AS (SELECT a AS class, min(least) AS component FROM reach JOIN m ON m.class = reach.b GROUP BY a)
 SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component END AS component_id, coalesce(doc_id = CASE WHEN n IS NULL THEN doc_id ELSE component END, false) AS kept
 FROM documents_t t LEFT JOIN st ON st.row = t.row LEFT JOIN co ON co.class = st.class"""


def _contamination() -> str:
    grams = " UNION ALL ".join(f"SELECT row, i, {n} AS n, {_run(n)} AS k FROM documents_w WHERE {n} IN (SELECT n FROM iw) WINDOW o AS (PARTITION BY row ORDER BY i)" for n in range(1, 11))
    windows = " UNION ALL ".join(f"SELECT item, {n} AS n, k FROM (SELECT x.row AS item, i, len(ws) AS size, {_run(n)} AS k FROM benchmark_w x JOIN benchmark_t b ON b.row = x.row WINDOW o AS (PARTITION BY x.row ORDER BY i)) WHERE k IS NOT NULL AND {'size >= 10' if n == 10 else f'size = {n}'}" for n in range(1, 11))
    return f"""WITH {_words("documents", _low("coalesce(text, '')"), _LETTERS)}, {_words("benchmark", _low("coalesce(text, '')"), _LETTERS, "item_id")},
 iw AS MATERIALIZED (SELECT DISTINCT item, n, k FROM ({windows})), h AS (SELECT row, i, n, item FROM ({grams}) g JOIN iw USING (n, k)),
 hit AS (SELECT row, count(*) AS n FROM (SELECT DISTINCT row, unnest(range(i, i + n)) AS at FROM h) GROUP BY row),
 it AS (SELECT h.row, count(*) AS n, string_agg(CAST(coalesce(item_id::VARCHAR, '') AS VARCHAR), ',' ORDER BY coalesce(item_id::VARCHAR, '')) AS ids FROM (SELECT DISTINCT row, item FROM h) h JOIN benchmark_t b ON b.row = h.item GROUP BY h.row)
 SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
 FROM documents_t t LEFT JOIN hit ON hit.row = t.row LEFT JOIN it ON it.row = t.row"""


def _licences() -> str:
    rows = [(name, lic, b) for name, lic, text in licenses.TEMPLATES for b in licenses.bigrams_of(text)]
    return f"""WITH t(template, license, g) AS ({_values(rows)}), size AS (SELECT template, count(*) AS m FROM t GROUP BY template),
 d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
 u AS (SELECT row, text AS unit, 0 AS line FROM d UNION ALL SELECT row, unnest(string_split(text, chr(10))), generate_subscripts(string_split(text, chr(10)), 1) FROM d),
 w AS (SELECT row, line, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT row, line, regexp_extract_all(lower(unit), '[a-z0-9]+') AS ws FROM u)),
 b AS (SELECT DISTINCT row, line, g FROM (SELECT row, line, {_run(2)} AS g FROM w WINDOW o AS (PARTITION BY row, line ORDER BY i)) WHERE g IS NOT NULL),
 n AS (SELECT row, line, count(*) AS n FROM b GROUP BY row, line),
 x AS (SELECT b.row, b.line, t.template, t.license, 2.0::DOUBLE * count(*) / (any_value(n) + any_value(m)) AS dice FROM b JOIN t ON t.g = b.g JOIN n ON n.row = b.row AND n.line = b.line JOIN size ON size.template = t.template GROUP BY ALL),
 y AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY round(dice, 6) DESC, template DESC) AS nth FROM x WHERE dice >= {licenses.THRESHOLD}),
 k AS (SELECT row, count(DISTINCT line) FILTER (WHERE line > 0) AS n FROM y GROUP BY row)
 SELECT doc_id, license, template, round(dice, 6) AS dice, coalesce(k.n, 0) AS n_lines FROM d LEFT JOIN (SELECT * FROM y WHERE nth = 1) y ON y.row = d.row LEFT JOIN k ON k.row = d.row"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": _url(),
        "op2_quality_rules": _quality(),
        "op5_substring_dedup": _passages(),
        "op6_minhash": _near(),
        "op7_decontamination": _contamination(),
        "op10_licenses": _licences(),
    }
