"""DuckDB SQL for the pseudonyms of ``pii``: candidates as rows, eight Feistel rounds as nested selects."""

from __future__ import annotations

from pricefold.llm.pii import CANDIDATE, KEY, ROUNDS


def _with_digits(m: str, d: str) -> str:
    return (
        f"array_to_string([CASE WHEN substr({m}, q, 1) BETWEEN '0' AND '9' THEN substr({d}, length(regexp_replace(substr({m}, 1, q), '[^0-9]', '', 'g')), 1)"
        f" ELSE substr({m}, q, 1) END FOR q IN range(1, length({m}) + 1)], '')"
    )


def _luhn(d: str, doubled: int) -> str:
    v = f"CAST(substr({d}, length({d}) + 1 - p, 1) AS INTEGER)"
    return f"list_sum([CASE WHEN p % 2 = {doubled} THEN 2 * {v} - CASE WHEN {v} > 4 THEN 9 ELSE 0 END ELSE {v} END FOR p IN range(1, length({d}) + 1)])"


def _day(y: str, mo: str, d: str) -> str:
    return f"CASE WHEN CAST({y} AS INTEGER) BETWEEN 1901 AND 2096 THEN try_cast({y} || '-' || lpad({mo}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE) END"


def _base36(s: str) -> str:
    return f"coalesce(list_sum([(strpos('0123456789abcdefghijklmnopqrstuvwxyz', substr({s}, i, 1)) - 1) * CAST(pow(36, length({s}) - i) AS BIGINT) FOR i IN range(1, length({s}) + 1)]), 0)::BIGINT"


def _halves(d: str, tag: str) -> str:
    """l, r, a, b of a string of digits."""
    h = f"(length({d}) // 2)"
    return f"'{tag}' AS tag, CAST(substr({d}, 1, {h}) AS BIGINT) AS l, CAST(substr({d}, {h} + 1) AS BIGINT) AS r, CAST('1' || repeat('0', {h}) AS BIGINT) AS a, CAST('1' || repeat('0', length({d}) - {h}) AS BIGINT) AS b"


def oracle(key: str = KEY) -> str:
    pattern = "(" + CANDIDATE + ")"
    rounds = "SELECT * FROM jobs"
    for i in range(ROUNDS):
        left, right, mod = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        f = f"('0x' || substr(sha256('{key}|' || tag || '|' || {mod} || '|{i}|' || {right}), 1, 15))::BIGINT % {mod}"
        rounds = f"SELECT * REPLACE (({left} + {f}) % {mod} AS {left}) FROM ({rounds})"
    digits = "lpad(l::VARCHAR, (length(own) // 2)::INTEGER, '0') || lpad(r::VARCHAR, (length(own) - length(own) // 2)::INTEGER, '0')"
    part = lambda v, w: f"lpad({v}::VARCHAR, greatest(length({w}), length({v}::VARCHAR))::INTEGER, '0')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
found AS (SELECT rid, text, regexp_extract_all(text, '{pattern}') AS ms FROM d WHERE regexp_matches(text, '[0-9][ ./()-]{{0,2}}[0-9]|@')),
m AS (SELECT rid, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS k FROM found),
kinds AS (SELECT m, regexp_replace(m, '[^0-9]', '', 'g') AS ds, regexp_extract_all(m, '[0-9]+') AS x,
  CASE WHEN m LIKE '%@%' THEN 'email' WHEN regexp_full_match(m, '[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}') THEN 'ip'
       WHEN regexp_full_match(m, '[0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}T?|[0-9]{{1,2}}[/.][0-9]{{1,2}}[/.][0-9]{{4}}') THEN 'date'
       WHEN regexp_full_match(m, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') THEN 'ssn'
       WHEN regexp_full_match(m, '[0-9]{{13,19}}|[0-9]{{4}}([ -][0-9]{{4}}){{3}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}') THEN 'card'
       ELSE 'phone' END AS kind FROM (SELECT DISTINCT m FROM m)),
days AS (SELECT *, CASE WHEN length(x[1]) = 4 THEN 'ymd' WHEN m LIKE '%/%' AND {_day('x[3]', 'x[1]', 'x[2]')} IS NOT NULL THEN 'mdy' ELSE 'dmy' END AS style,
  CASE WHEN length(x[1]) = 4 THEN {_day('x[1]', 'x[2]', 'x[3]')} WHEN m LIKE '%/%' AND {_day('x[3]', 'x[1]', 'x[2]')} IS NOT NULL THEN {_day('x[3]', 'x[1]', 'x[2]')}
       ELSE {_day('x[3]', 'x[2]', 'x[1]')} END AS day FROM kinds WHERE kind = 'date'),
dated AS (SELECT m, style, x, day, make_date(1901 + 28 * ((year(day) - 1901) // 28), 1, 1) AS base FROM days WHERE day IS NOT NULL),
phones AS (SELECT m, ds, least(10, length(ds) - CASE WHEN m LIKE '+%' THEN 1 ELSE 0 END) AS n FROM kinds WHERE kind = 'phone' AND length(ds) BETWEEN 8 AND 15),
locals AS (SELECT m, lower(split_part(m, '@', 1)) AS name FROM kinds WHERE kind = 'email'),
chunks AS (SELECT m, unnest(range(0, (length(z) + 7) // 8)) AS c, z FROM (SELECT m, regexp_replace(name, '[^a-z0-9]', '', 'g') AS z FROM locals)),
jobs AS (
  SELECT m, 0 AS c, own, {_halves('own', 'card')} FROM (SELECT m, left(ds, length(ds) - 1) AS own FROM kinds WHERE kind = 'card' AND length(ds) BETWEEN 13 AND 19 AND {_luhn('ds', 0)} % 10 = 0)
  UNION ALL SELECT m, 0, own, {_halves('own', 'phone')} FROM (SELECT m, right(ds, n) AS own FROM phones)
  UNION ALL SELECT m, 0, '', 'date', date_diff('day', base, day) // 487, date_diff('day', base, day) % 487, 21, 487 FROM dated
  UNION ALL SELECT m, 0, '', 'ip', x[1]::BIGINT * 256 + x[2]::BIGINT, x[3]::BIGINT * 256 + x[4]::BIGINT, 65536, 65536 FROM kinds
    WHERE kind = 'ip' AND list_max([o::BIGINT FOR o IN x]) <= 255
  UNION ALL SELECT m, 0, '', 'ssn', x[1]::BIGINT - 1 - CASE WHEN x[1]::BIGINT > 666 THEN 1 ELSE 0 END, (x[2]::BIGINT - 1) * 9999 + x[3]::BIGINT - 1, 898, 989901 FROM kinds
    WHERE kind = 'ssn' AND x[1]::BIGINT BETWEEN 1 AND 899 AND x[1]::BIGINT <> 666 AND x[2]::BIGINT > 0 AND x[3]::BIGINT > 0
  UNION ALL SELECT m, c, own, 'email', {_base36('substr(own, 1, length(own) // 2)')}, {_base36('substr(own, length(own) // 2 + 1)')},
    CAST(pow(36, length(own) // 2) AS BIGINT), CAST(pow(36, length(own) - length(own) // 2) AS BIGINT) FROM (SELECT m, c, substr(z, 8 * c + 1, 8) AS own FROM chunks)),
done AS ({rounds}),
mails AS (SELECT m, string_agg(CASE WHEN length(own) < 2 THEN '' ELSE lower(to_base(l, 36, (length(own) // 2)::INTEGER)) END || lower(to_base(r, 36, (length(own) - length(own) // 2)::INTEGER)), '' ORDER BY c) AS e
  FROM done WHERE tag = 'email' GROUP BY m),
made AS (
  SELECT m, {_with_digits('m', "(e || ((10 - chk % 10) % 10)::VARCHAR)")} AS p FROM (SELECT m, e, {_luhn('e', 1)} AS chk FROM (SELECT m, {digits} AS e FROM done WHERE tag = 'card'))
  UNION ALL SELECT m, {_with_digits('m', 'g')} FROM (SELECT f.m, left(p.ds, length(p.ds) - p.n) || {digits} AS g FROM done f JOIN phones p ON p.m = f.m WHERE tag = 'phone')
  UNION ALL SELECT m, concat_ws('.', l // 256, l % 256, r // 256, r % 256) FROM done WHERE tag = 'ip'
  UNION ALL SELECT m, lpad((l + 1 + CASE WHEN l >= 665 THEN 1 ELSE 0 END)::VARCHAR, 3, '0') || '-' || lpad((r // 9999 + 1)::VARCHAR, 2, '0') || '-' || lpad((r % 9999 + 1)::VARCHAR, 4, '0') FROM done WHERE tag = 'ssn'
  UNION ALL SELECT m, CASE style
      WHEN 'ymd' THEN year(n) || substr(m, 5, 1) || lpad(month(n)::VARCHAR, 2, '0') || substr(m, 5, 1) || lpad(day(n)::VARCHAR, 2, '0') || CASE WHEN m LIKE '%T' THEN 'T' ELSE '' END
      WHEN 'mdy' THEN {part('month(n)', 'x[1]')} || substr(m, length(x[1]) + 1, 1) || {part('day(n)', 'x[2]')} || substr(m, length(x[1]) + 1, 1) || year(n)
      ELSE {part('day(n)', 'x[1]')} || substr(m, length(x[1]) + 1, 1) || {part('month(n)', 'x[2]')} || substr(m, length(x[1]) + 1, 1) || year(n) END
    FROM (SELECT f.m, style, x, CAST(base + CAST(f.l * 487 + f.r AS INTEGER) AS DATE) AS n FROM done f JOIN dated t ON t.m = f.m WHERE tag = 'date')
  UNION ALL SELECT m, array_to_string([CASE WHEN regexp_matches(substr(name, q, 1), '[a-z0-9]') THEN substr(e, length(regexp_replace(substr(name, 1, q), '[^a-z0-9]', '', 'g')), 1)
      ELSE substr(name, q, 1) END FOR q IN range(1, length(name) + 1)], '') || substr(m, length(name) + 1) FROM mails JOIN locals USING (m)),
filled AS (SELECT rid, list(coalesce(p, m.m) ORDER BY k) AS ps, count(p) AS n FROM m LEFT JOIN made ON made.m = m.m GROUP BY rid),
texts AS (SELECT f.rid, n, array_to_string([t[i] || coalesce(ps[i], '') FOR i IN range(1, len(t) + 1)], '') AS text
  FROM filled f JOIN (SELECT rid, string_split_regex(text, '{pattern}') AS t FROM found) s ON s.rid = f.rid)
SELECT d.doc_id, CASE WHEN t.n > 0 THEN t.text ELSE d.text END AS text, coalesce(t.n, 0)::INTEGER AS n_replaced FROM d LEFT JOIN texts t ON t.rid = d.rid
"""
