"""DuckDB SQL for the queries that SQL can express."""

from pmtspark.llm.license_scan import TEMPLATES
from pmtspark.llm.quality_rules import RULES
from pmtspark.llm.secret_scan import RULES as SECRET_RULES

ORACLES: dict[str, str] = {}

_rows = ", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())
ORACLES["op1_license_scan"] = rf"""
WITH template AS (
  SELECT license, list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda x: x <> '') AS w
  FROM (VALUES {_rows}) v(license, t)),
grams AS (
  SELECT DISTINCT license, len(w) AS t, CASE WHEN len(w) <= 5 THEN 2 ELSE 3 END AS s,
    array_to_string(w[i:i + CASE WHEN len(w) <= 5 THEN 1 ELSE 2 END], ' ') AS g
  FROM template, range(1, len(w) + CASE WHEN len(w) <= 5 THEN 0 ELSE -1 END) r(i)),
wanted AS (SELECT license, t, count(*) AS n FROM grams GROUP BY ALL),
worded AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'),
    lambda x: x <> '') AS w FROM documents),
placed AS (
  SELECT k, doc_id, 2 AS s, i - 1 AS p, w[i] || ' ' || w[i + 1] AS g
  FROM worded, range(1, len(w)) r(i) UNION ALL
  SELECT k, doc_id, 3, i - 1, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]
  FROM worded, range(1, len(w) - 1) r(i)),
hits AS (
  SELECT DISTINCT k, doc_id, license, t, g, unnest(range(
    greatest(0, CAST(ceil((p - 2 * t + s) / greatest(1, t // 2)) AS BIGINT)),
    p // greatest(1, t // 2) + 1)) * greatest(1, t // 2) AS at_word
  FROM placed JOIN grams USING (s, g)),
windows AS (
  SELECT k, doc_id, license, t, at_word, count(*) AS shared FROM hits GROUP BY ALL)
SELECT doc_id, license, round(max(shared / n), 6) AS containment,
  min(at_word)::BIGINT AS first_word, count(*) AS n_windows
FROM windows JOIN wanted USING (license, t) WHERE shared / n >= 0.8 GROUP BY k, doc_id, license
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_rates = {
    "symbol_rate": "CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END",
    "dup_line_rate": "CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END",
    "repeat_rate": "CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END",
    "word_length": "CASE WHEN n_words > 0 THEN 10 * word_chars // n_words ELSE 0 END",
}
_cell = "{0} - {0} % CAST(pow(10, greatest(length({0}::VARCHAR) - 4, 0)) AS BIGINT)"
_cells = " UNION ALL ".join(
    f"SELECT lang, source, '{r.name}' AS rule, {_cell.format(r.name)} AS cell FROM rated"
    " WHERE NOT base_failed"
    for r in RULES
)
_rule = ", ".join(f"('{r.name}', {r.percent}, {r.reach}, {str(r.below).lower()})" for r in RULES)
_values = " UNION ALL ".join(
    f"SELECT k, lang, source, '{r.name}' AS rule, {_cell.format(r.name)} AS value FROM rated" for r in RULES
)
ORACLES["op9_quality_rules"] = rf"""
WITH worded AS (
  SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text,
    {_WORDS} AS w FROM documents),
lines AS (
  SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS l FROM worded)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY k),
grams AS (
  SELECT k, i, w[i:i + 2] AS g FROM worded, range(1, len(w) - 1) r(i)),
again AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM grams) WHERE n > 1),
repeated AS (
  SELECT k, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY k),
measured AS (
  SELECT k, doc_id, lang, source, len(w) AS n_words,
    length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM worded LEFT JOIN lines USING (k) LEFT JOIN repeated USING (k)),
rated AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    {", ".join(f"{v} AS {k}" for k, v in _rates.items())} FROM measured),
cells AS ({_cells}),
own AS (SELECT lang, source, rule, cell, count(*)::HUGEINT AS n FROM cells GROUP BY ALL),
by_lang AS (SELECT lang, rule, cell, count(*)::HUGEINT AS n FROM cells GROUP BY ALL),
whole AS (SELECT rule, cell, count(*)::HUGEINT AS n FROM cells GROUP BY ALL),
size AS (SELECT count(*)::HUGEINT AS all_rows FROM rated WHERE NOT base_failed),
lang_size AS (
  SELECT lang, count(*)::HUGEINT AS lang_rows FROM rated WHERE NOT base_failed GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM rated WHERE NOT base_failed),
lang_mix AS (
  SELECT lang_size.lang, w.rule, w.cell, coalesce(b.n, 0) * all_rows + 200 * w.n AS n
  FROM lang_size CROSS JOIN whole w CROSS JOIN size
  LEFT JOIN by_lang b ON b.lang IS NOT DISTINCT FROM lang_size.lang AND b.rule = w.rule
    AND b.cell = w.cell),
mix AS (
  SELECT g.lang, g.source, m.rule, m.cell,
    coalesce(o.n, 0) * (s.lang_rows + 200) * all_rows + 200 * m.n AS n
  FROM grp g JOIN lang_mix m ON m.lang IS NOT DISTINCT FROM g.lang
  JOIN lang_size s ON s.lang IS NOT DISTINCT FROM g.lang CROSS JOIN size
  LEFT JOIN own o ON o.lang IS NOT DISTINCT FROM g.lang AND o.source IS NOT DISTINCT FROM g.source
    AND o.rule = m.rule AND o.cell = m.cell),
run AS (
  SELECT *, 100 * sum(n) OVER (PARTITION BY lang, source, rule ORDER BY cell) AS upto,
    sum(n) OVER (PARTITION BY lang, source, rule) AS total
  FROM mix JOIN (VALUES {_rule}) r(rule, percent, reach, below) USING (rule)),
quant AS (
  SELECT lang, source, rule, reach, below, min(cell) FILTER (upto >= 50 * total) AS mid,
    min(cell) FILTER (upto >= (100 - percent) * total) AS low,
    min(cell) FILTER (upto >= percent * total) AS high FROM run GROUP BY ALL),
verdict AS (
  SELECT k, bool_and(value <= high + reach * (high - mid)
    AND (NOT below OR value >= low - reach * (mid - low))) AS fits
  FROM ({_values}) v
  JOIN quant c ON c.rule = v.rule AND c.lang IS NOT DISTINCT FROM v.lang
    AND c.source IS NOT DISTINCT FROM v.source
  GROUP BY k)
SELECT doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  base_failed, NOT base_failed AND coalesce(fits, false) AS kept
FROM rated LEFT JOIN verdict USING (k)
"""

_ESC = r"replace(replace(replace({}, '\', '\\'), '<', '\<'), '>', '\>')"
ORACLES["op2_chat_examples"] = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -7, * FROM (VALUES (0, 'user', '\### Assistant: </turn> ok'),
    (1, 'assistant', '\### Assistant: </turn> ok')) v),
sized AS (
  SELECT *, length('<turn ' || {_ESC.format("role")} || '>.' || {_ESC.format("text")}
    || '</turn>..') AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n
  FROM turns),
placed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS upto,
    n = max(n) OVER (PARTITION BY conv_id) AS is_last FROM sized)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  (count(*) FILTER (role = 'assistant' OR is_last)) AS examples,
  (sum(upto) FILTER (role = 'assistant' OR is_last))::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""

ORACLES["op10_warc"] = """
WITH own AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100
    THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM own)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to, true AS complete
FROM firsts
"""

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
ORACLES["op11_ranked_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all({_FOLD.format("coalesce(text, '')")}, {_TERM}) AS t FROM documents),
len AS (SELECT k, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
tot AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM len),
occ AS (SELECT k, t, count(*)::BIGINT AS tf FROM (SELECT k, unnest(t) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, count(*)::BIGINT AS df FROM occ GROUP BY t),
item AS (SELECT row_number() OVER () AS i, * FROM (
  SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)),
asked AS (SELECT DISTINCT i, item_id,
    unnest(regexp_extract_all({_FOLD.format("text")}, {_TERM})) AS t FROM item),
scored AS (
  SELECT i, item_id, k, doc_id, sum(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms)))))::BIGINT AS score
  FROM asked JOIN df USING (t) JOIN occ USING (t) JOIN len USING (k), tot GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
  FROM scored WHERE score > 0) WHERE rank <= 10
"""

_LETTER = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"
_P = "1 + (1000000000::HUGEINT * ({} + 5)) // ({} + 5 * terms)"
ORACLES["op13_source_divergence"] = f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang,
    coalesce(source, '') AS source,
    regexp_extract_all({_FOLD.format("coalesce(text, '')")}, {_LETTER}) AS t FROM documents),
occ AS (SELECT k, lang, source, unnest(t) AS t FROM d),
kept AS (SELECT lang, t, count(*) AS lang_n FROM occ GROUP BY ALL HAVING count(DISTINCT k) >= 30),
size AS (SELECT lang, count(*) AS terms, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
own AS (SELECT lang, source, t, count(*) AS n FROM occ JOIN kept USING (lang, t) GROUP BY ALL),
grp AS (SELECT lang, source, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN own USING (lang, source) GROUP BY ALL),
cell AS (SELECT g.lang, g.source, k.t, coalesce(n, 0) AS n,
    {_P.format("coalesce(n, 0)", "total")} AS p, {_P.format("lang_n", "lang_total")} AS q
  FROM grp g JOIN kept k USING (lang) JOIN size USING (lang)
  LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.t = k.t),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN cell x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN cell y ON y.lang = b.lang AND y.source = b.source AND y.t = x.t GROUP BY ALL),
term AS (SELECT lang, source, 'term' AS part, t AS item, (p - q)::BIGINT AS value
  FROM cell WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)) WHERE part = 'pair' OR rank <= 50
"""


def _either_case(pattern: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.islower() else c for c in pattern)


# The marks are private-use characters, which split a text at its matches.
_MARK, _STOP = "\uf8f0", "\uf8f1"


def _spans(place: int, rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    if rule.any_case:
        head, tail = pattern[: pattern.index(")")], pattern[pattern.index(")") :]
        pattern = _either_case(head) + tail
    pattern = pattern if pattern.startswith("(") else f"({pattern})"
    group = rf"regexp_extract(s, '{pattern}', {rule.group or 1})"
    return rf"""
  SELECT k, '{rule.name}' AS rule, {place} AS place, (pos - length(s))::INT AS start, pos::INT AS stop
  FROM (SELECT k, string_split(x, '{_STOP}')[1] AS s, i,
      sum(length(string_split(x, '{_STOP}')[1])) OVER w
      + coalesce(sum(length(string_split(x, '{_STOP}')[2])) OVER v, 0) AS pos
    FROM (SELECT k, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM (
      SELECT k, string_split('{_STOP}' || regexp_replace(text, '{pattern}', '{_MARK}\0{_STOP}', 'g'),
        '{_MARK}') AS parts FROM blob))
    WINDOW w AS (PARTITION BY k ORDER BY i), v AS (PARTITION BY k ORDER BY i ROWS
      BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE i > 1 AND length({group}) >= {rule.least}"""


_all = " UNION ALL ".join(_spans(i, r) for i, r in enumerate(SECRET_RULES))
_joined = "string_agg(rule || ':' || start || ':' || stop, ',' ORDER BY start, place)"
ORACLES["op12_secret_scan"] = f"""
WITH blob AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
span AS ({_all}),
found AS (
  SELECT k, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access,
    count(*) FILTER (place = 2) AS n_hex, {_joined} FILTER (place < 3) AS base, {_joined} AS spans
  FROM span GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans
FROM blob LEFT JOIN found USING (k)
"""
