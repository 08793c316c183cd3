"""Format-preserving pseudonyms for validated numbers and dates, as SQL expressions only.

A keyed Feistel network permutes each value within its own format: separators and length stay,
the result is valid again (check digit, calendar, octets), and equal values get equal pseudonyms in
every document, whatever separators they are written with. Numbers that fail their validation stay.

| kind  | recognised as | domain of the permutation |
|-------|---------------|---------------------------|
| card  | 13 to 19 digits (plain, 4-4-4-4, 4-6-5) with a valid Luhn digit | all digits but the check digit, which is computed anew |
| phone | international with + and 8 to 15 digits, or ten digits in groups 3-3-4 | the last ten digits (fewer if the number has fewer; the first digit stays) |
| ssn   | 3-2-4 digits with a valid area, group and serial | the valid combinations |
| date  | y-m-d, y/m/d, d.m.y, m/d/y (d/m/y where only that is a date), 1901 to 2096 | the days of the same 28-year calendar block |
| ip    | dotted quad, octets 0 to 255 | all quads |
| email | local@domain.tld | the letters and digits of the local part; the domain stays |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KEY = "pricefold-demo-key"

# Fixed formats, in the order in which they are tried at a position. \b before a digit or after
# a word character is what both Java and RE2 read alike; nothing looks behind or ahead further.
PATTERNS = (
    r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T|\b)",
    r"\b[0-9]{4}/[0-9]{2}/[0-9]{2}\b",
    r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b",
    r"\b[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}\b",
    r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    r"\b[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}\b",
    r"\b[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}\b",
    r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}\b",
    r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){1,3}\b",
    r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}\b",
    r"\b[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}\b",
    r"\b[0-9]{13,19}\b",
)
CANDIDATE = "|".join(PATTERNS)
#: Java's \b also knows letters beyond ASCII; these boundaries read as RE2's.
SPARK_CANDIDATE = CANDIDATE.replace(r"(?:T|\b)", r"(?:T|(?![0-9A-Za-z_]))").replace(r"|\b", r"|(?<![0-9A-Za-z_])").replace(r"\b", r"(?![0-9A-Za-z_])")


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _round(key: str, tag: str, i: str, value: str, modulus: str) -> str:
    """A keyed number below ``modulus`` from the first 60 bits of SHA-256."""
    return f"(CAST(conv(substr(sha2(concat({_lit(key)}, '|{tag}|', {modulus}, '|', {i}, '|', {value}), 256), 1, 15), 16, 10) AS BIGINT) % {modulus})"


def _feistel(key: str, tag: str, left: str, right: str, a: str, b: str) -> str:
    """Struct (l, r) of the permuted pair; l stays below a, r below b (any sizes)."""
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', CAST({left} AS BIGINT), 'r', CAST({right} AS BIGINT)), (s, i) -> "
        f"if(i % 2 = 0, named_struct('l', (s.l + {_round(key, tag, 'i', 's.r', a)}) % {a}, 'r', s.r), "
        f"named_struct('l', s.l, 'r', (s.r + {_round(key, tag, 'i', 's.l', b)}) % {b})))"
    )


def _let(name: str, value: str, body: str) -> str:
    """Bind an expression to a name, so that it is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _pow10(n: str) -> str:
    return f"CAST(concat('1', repeat('0', {n})) AS BIGINT)"


def _digits(key: str, tag: str, d: str) -> str:
    """Permutation of a string of 2 to 18 digits."""
    low, high = f"(length({d}) - CAST(floor(length({d}) / 2) AS INT))", f"CAST(floor(length({d}) / 2) AS INT)"
    pair = _feistel(key, tag, f"CAST(substr({d}, 1, {high}) AS BIGINT)", f"CAST(substr({d}, {high} + 1) AS BIGINT)", _pow10(high), _pow10(low))
    return _let("f", pair, f"concat(lpad(CAST(f.l AS STRING), {high}, '0'), lpad(CAST(f.r AS STRING), {low}, '0'))")


def _luhn_sum(d: str, shift: int) -> str:
    """Luhn sum of the digits; shift 1 doubles the last digit (of a payload), 0 the one before it."""
    v = f"CAST(substr({d}, -p, 1) AS INT)"
    return f"aggregate(sequence(1, length({d})), 0, (t, p) -> t + if(p % 2 = {1 - (1 - shift)}, 2 * {v} - if({v} > 4, 9, 0), {v}))"


def _with_digits(m: str, d: str) -> str:
    """The match with its digits replaced, in order, by those of ``d``."""
    return (
        f"array_join(transform(sequence(1, length({m})), q -> if(substr({m}, q, 1) BETWEEN '0' AND '9', "
        f"substr({d}, length(regexp_replace(substr({m}, 1, q), '[^0-9]', '')), 1), substr({m}, q, 1))), '')"
    )


def _day(y: str, mo: str, d: str) -> str:
    """The date, null if it is none or outside 1901 to 2096 (seven 28-year blocks)."""
    made = f"try_to_timestamp(concat({y}, '-', lpad({mo}, 2, '0'), '-', lpad({d}, 2, '0')), 'yyyy-MM-dd')"
    return f"if(CAST({y} AS INT) BETWEEN 1901 AND 2096, CAST({made} AS DATE), NULL)"


def _new_day(key: str, day: str) -> str:
    start = f"make_date(1901 + 28 * CAST(floor((year({day}) - 1901) / 28) AS INT), 1, 1)"
    # 28 years without a skipped leap day have 10227 = 21 * 487 days
    pair = _feistel(key, "date", f"CAST(floor(datediff({day}, b) / 487) AS BIGINT)", f"datediff({day}, b) % 487", "21", "487")
    return _let("b", start, _let("f", pair, "date_add(b, CAST(f.l * 487 + f.r AS INT))"))


def _part(name: str, width: str) -> str:
    return f"lpad(CAST({name} AS STRING), greatest(length({width}), length(CAST({name} AS STRING))), '0')"


def _date(key: str, m: str) -> str:
    """Pseudonym of a date match, or null if it is no date."""
    parts = f"regexp_extract_all({m}, '([0-9]+)', 1)"
    year_first = _let("n", _new_day(key, "y"), f"concat(CAST(year(n) AS STRING), substr({m}, 5, 1), lpad(CAST(month(n) AS STRING), 2, '0'), substr({m}, 5, 1), lpad(CAST(day(n) AS STRING), 2, '0'), if(endswith({m}, 'T'), 'T', ''))")
    sep = "substr(%s, length(x[0]) + 1, 1)" % m
    month_first = _let("n", _new_day(key, "y"), f"concat({_part('month(n)', 'x[0]')}, {sep}, {_part('day(n)', 'x[1]')}, {sep}, CAST(year(n) AS STRING))")
    day_first = _let("n", _new_day(key, "y"), f"concat({_part('day(n)', 'x[0]')}, {sep}, {_part('month(n)', 'x[1]')}, {sep}, CAST(year(n) AS STRING))")
    ymd, mdy, dmy = _day("x[0]", "x[1]", "x[2]"), _day("x[2]", "x[0]", "x[1]"), _day("x[2]", "x[1]", "x[0]")
    rest = f"if({m} LIKE '%/%' AND {mdy} IS NOT NULL, {_let('y', mdy, month_first)}, {_let('y', dmy, f'if(y IS NULL, NULL, {day_first})')})"
    return _let("x", parts, f"if(length(x[0]) = 4, {_let('y', ymd, f'if(y IS NULL, NULL, {year_first})')}, {rest})")


def _ip(key: str, m: str) -> str:
    octets = f"transform(split({m}, '[.]'), o -> CAST(o AS BIGINT))"
    pair = _feistel(key, "ip", "x[0] * 256 + x[1]", "x[2] * 256 + x[3]", "65536", "65536")
    out = "concat_ws('.', CAST(f.l DIV 256 AS STRING), CAST(f.l % 256 AS STRING), CAST(f.r DIV 256 AS STRING), CAST(f.r % 256 AS STRING))"
    return _let("x", octets, f"if(array_max(x) > 255, NULL, {_let('f', pair, out)})")


def _ssn(key: str, m: str) -> str:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    x = f"transform(split({m}, '-'), o -> CAST(o AS BIGINT))"
    ok = "x[0] BETWEEN 1 AND 899 AND x[0] <> 666 AND x[1] > 0 AND x[2] > 0"
    pair = _feistel(key, "ssn", "x[0] - 1 - if(x[0] > 666, 1, 0)", "(x[1] - 1) * 9999 + x[2] - 1", "898", "989901")
    out = "concat(lpad(CAST(f.l + 1 + if(f.l >= 665, 1, 0) AS STRING), 3, '0'), '-', lpad(CAST(f.r DIV 9999 + 1 AS STRING), 2, '0'), '-', lpad(CAST(f.r % 9999 + 1 AS STRING), 4, '0'))"
    return _let("x", x, f"if({ok}, {_let('f', pair, out)}, NULL)")


def _card(key: str, m: str) -> str:
    body = _let(
        "e",
        _digits(key, "card", "substr(d, 1, length(d) - 1)"),
        _let("g", f"concat(e, CAST((10 - {_luhn_sum('e', 1)} % 10) % 10 AS STRING))", _with_digits(m, "g")),
    )
    return _let("d", f"regexp_replace({m}, '[^0-9]', '')", f"if(length(d) BETWEEN 13 AND 19 AND {_luhn_sum('d', 0)} % 10 = 0, {body}, NULL)")


def _phone(key: str, m: str) -> str:
    own = "least(10, length(d) - if(startswith(%s, '+'), 1, 0))" % m
    body = _let("k", own, _let("e", _digits(key, "phone", "right(d, k)"), _let("g", "concat(left(d, length(d) - k), e)", _with_digits(m, "g"))))
    return _let("d", f"regexp_replace({m}, '[^0-9]', '')", f"if(length(d) BETWEEN 8 AND 15, {body}, NULL)")


def _email(key: str, m: str) -> str:
    """Letters and digits of the local part, lower-cased, eight at a time in base 36."""
    local = f"lower(substring_index({m}, '@', 1))"
    high, low = "CAST(floor(length(c) / 2) AS INT)", "(length(c) - CAST(floor(length(c) / 2) AS INT))"
    power = lambda n: f"CAST(pow(36, {n}) AS BIGINT)"
    base36 = lambda s: f"CAST(conv(if({s} = '', '0', {s}), 36, 10) AS BIGINT)"
    back = lambda v, n: f"if({n} = 0, '', lower(lpad(conv(CAST({v} AS STRING), 10, 36), {n}, '0')))"
    pair = _feistel(key, "email", base36(f"substr(c, 1, {high})"), base36(f"substr(c, {high} + 1)"), power(high), power(low))
    chunk = _let("c", "substr(z, 8 * h + 1, 8)", _let("f", pair, f"concat({back('f.l', high)}, {back('f.r', low)})"))
    chunks = f"array_join(transform(sequence(0, CAST(ceil(length(z) / 8) AS INT) - 1), h -> {chunk}), '')"
    placed = f"array_join(transform(sequence(1, length(n)), q -> if(substr(n, q, 1) RLIKE '[a-z0-9]', substr(e, length(regexp_replace(substr(n, 1, q), '[^a-z0-9]', '')), 1), substr(n, q, 1))), '')"
    return _let("n", local, _let("z", "regexp_replace(n, '[^a-z0-9]', '')", _let("e", chunks, f"concat({placed}, substr({m}, length(n) + 1))")))


def _pseudonym(key: str, m: str) -> str:
    """The match's pseudonym, or null if no kind's validation accepts it."""
    return (
        f"CASE WHEN {m} LIKE '%@%' THEN {_email(key, m)}"
        f" WHEN {m} RLIKE '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' THEN {_ip(key, m)}"
        f" WHEN {m} RLIKE '^([0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}T?|[0-9]{{1,2}}([/.])[0-9]{{1,2}}[/.][0-9]{{4}})$' THEN {_date(key, m)}"
        f" WHEN {m} RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN {_ssn(key, m)}"
        f" WHEN {m} RLIKE '^([0-9]{{13,19}}|[0-9]{{4}}([ -][0-9]{{4}}){{3}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}})$' THEN {_card(key, m)}"
        f" ELSE {_phone(key, m)} END"
    )


def pseudonymised(col: str, key: str = KEY) -> Column:
    """Struct (text, replaced): the text with pseudonyms, and how many were set. A null text stays null with 0."""
    text = f"CAST(`{col}` AS STRING)"
    found = f"transform(regexp_extract_all({text}, {_lit('(' + SPARK_CANDIDATE + ')')}, 1), m -> named_struct('m', m, 'p', {_pseudonym(key, 'm')}))"
    pieces = f"split({text}, {_lit(SPARK_CANDIDATE)}, -1)"
    joined = "array_join(transform(sequence(0, size(t) - 1), k -> concat(t[k], coalesce(get(v, k).p, get(v, k).m, ''))), '')"
    done = _let("v", found, f"if(exists(v, w -> w.p IS NOT NULL), named_struct('text', {_let('t', pieces, joined)}, 'replaced', size(filter(v, w -> w.p IS NOT NULL))), named_struct('text', {text}, 'replaced', 0))")
    plain = f"named_struct('text', {text}, 'replaced', 0)"
    return F.expr(f"CASE WHEN {text} RLIKE '[0-9][ ./()-]{{0,2}}[0-9]|@' THEN {done} ELSE {plain} END")


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with ``text`` rewritten and a last column ``n_replaced`` (int).

    Row by row, without a shuffle. Null texts stay null, empty ones empty (n_replaced 0); repeated rows and equal
    values get equal results; all other columns pass through, an own column n_replaced included (then the
    count is named n_replaced_).
    """
    count = "n_replaced"
    while count in docs.columns:
        count += "_"
    names = list(docs.columns)
    own = docs.toDF(*[f"own{i}" for i in range(len(names))])  # no name of the user's meets one used here
    at = f"own{names.index(text)}"
    done = own.withColumn("done", pseudonymised(at, key))
    made = [F.col("done.text") if c == at else F.col(c) for c in own.columns]
    return done.select(*made, "done.replaced").toDF(*names, count)
