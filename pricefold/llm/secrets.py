"""Secret scan with multipart credential linking.

Every text is scanned for parts, each an interval of code points with a role: identifier, secret or endpoint.
Strong parts (the first three kinds) are reported always. Weak parts look like parts of a credential but are
common in clean text; an interval join within scopes decides on them: a part's scope reaches ``SCOPE`` code points beyond both
its ends. A weak identifier is reported if a secret lies in its scope, a weak secret if an identifier or an endpoint does, and a
weak endpoint if an identifier and a secret do.

| kind   | role       | strength | pattern |
|--------|------------|----------|---------|
| assign | secret     | strong   | a secret's name, = or :, and a value of 6 characters or more |
| access | identifier | strong   | AKIA and capitals or digits, 20 characters or more |
| hex    | secret     | strong   | 24 or more lower-case hex digits |
| key    | secret     | weak     | 40 base-64 characters with a capital, a small letter and a digit |
| pass   | secret     | weak     | pass, pwd, pin, auth or key, = or :, and a value |
| user   | identifier | weak     | user, login, account or client id, = or :, and a value |
| host   | endpoint   | weak     | a URL, or host, server, endpoint or database, = or :, and a value |

Values and URLs run to their delimiter, whatever their length, and scopes are measured from the true ends. A weak part that lies inside a
strong one of its role is left out; one that reaches beyond it is kept whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCOPE = 160
KINDS = ("assign", "access", "hex", "key", "pass", "user", "host")
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "key": "secret", "pass": "secret", "user": "identifier", "host": "endpoint"}
STRONG = ("assign", "access", "hex")

_ANY = re.IGNORECASE | re.ASCII
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _ANY)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEY = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
_PASS = re.compile(r"""(?<![A-Za-z])(?:pass(?:phrase|code)?|pwd|pin|auth|key)["']?\x20*[:=]\x20*["']?([^\s"',;]{3,})""", _ANY)
_USER = re.compile(r"""(?<![A-Za-z])(?:user(?:_?name|_?id)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{2,})""", _ANY)
_HOST = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>]{3,}|(?<![A-Za-z])(?:host(?:_?name)?|server|endpoint|database)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._:-]{3,})""", _ANY)

# Words without which a pattern cannot match: a cheap test before the pattern runs.
_NEEDS = (
    ("assign", _ASSIGN, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("pass", _PASS, ("pass", "pwd", "pin", "auth", "key")),
    ("user", _USER, ("user", "login", "account", "client")),
    ("host", _HOST, ("://", "host", "server", "endpoint", "database")),
)


def parts_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all parts of one text, by kind, leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower()
    assigns = ":" in text or "=" in text
    for kind, pattern, words in _NEEDS:
        if assigns and any(w in low for w in words):
            for m in pattern.finditer(text):
                if kind != "assign" or len(m[2]) >= 6:
                    out.append((kind, m.start(), m.end()))
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    for m in _KEY.finditer(text):
        value = m[0]
        if re.search(r"[A-Z]", value) and re.search(r"[a-z]", value) and re.search(r"[0-9]", value):
            out.append(("key", m.start(), m.end()))
    # A weak part inside a strong one of its role says nothing new: of the strong ones that start no later, does the furthest reach its end?
    begins: dict[str, list[int]] = {}
    reach: dict[str, list[int]] = {}
    for k, s, e in sorted((p for p in out if p[0] in STRONG), key=lambda p: p[1]):
        begins.setdefault(ROLE[k], []).append(s)
        far = reach.setdefault(ROLE[k], [])
        far.append(max(e, far[-1]) if far else e)

    def inside(k: str, s: int, e: int) -> bool:
        at = bisect_right(begins.get(ROLE[k], []), s)
        return at > 0 and reach[ROLE[k]][at - 1] >= e

    return [(k, s, e) for k, s, e in out if k in STRONG or not inside(k, s, e)]


_PARTS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(batches):
    for b in batches:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in parts_of(t or "")] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(found, _PARTS)], names=["row", "doc_id", "parts"])


def parts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, kind, role, start, end): every part of every text; a text without parts has one row of nulls.

    row numbers the rows of ``docs`` for this job.
    """
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("parts", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        ]
    )
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    flat = rows.mapInArrow(_scan, schema).select("row", "doc_id", F.explode_outer("parts").alias("p"))
    role = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])
    return flat.select("row", "doc_id", F.col("p.kind").alias("kind"), F.element_at(role, F.col("p.kind")).alias("role"), F.col("p.start").alias("start"), F.col("p.end").alias("end"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``found`` with a column ``reported``: strong parts, and weak ones whose complements lie in their scope.

    The interval join of each part with those around it is one sort by row and start: of each role only the
    nearest interval on either side matters, so no pairs are formed.
    """
    before = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    near = {}
    for role in ("identifier", "secret", "endpoint"):
        own = F.col("role") == role
        ends, starts = F.max(F.when(own, F.col("end"))).over(before), F.min(F.when(own, F.col("start"))).over(after)
        near[role] = F.coalesce(F.col("start") - ends <= scope, F.lit(False)) | F.coalesce(starts - F.col("end") <= scope, F.lit(False))
    weak = (
        F.when(F.col("role") == "identifier", near["secret"])
        .when(F.col("role") == "secret", near["identifier"] | near["endpoint"])
        .when(F.col("role") == "endpoint", near["identifier"] & near["secret"])
    )
    return found.withColumn("reported", F.col("kind").isin(*STRONG) | F.coalesce(weak, F.lit(False)))


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, spans) of every row of ``docs`` (doc_id, text); spans: array of (start, rank, kind, end), by start and kind.

    Positions are code points of the whole text, ends exclusive. Null and empty texts have no spans; null ids pass through;
    repeated rows have a result each; other columns are ignored.
    """
    found = linked(parts(docs), scope)
    rank = F.create_map(*[x for n, k in enumerate(KINDS) for x in (F.lit(k), F.lit(n))])
    span = F.when(F.col("reported"), F.struct("start", F.element_at(rank, F.col("kind")).alias("rank"), "kind", "end"))
    return found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(span)).alias("spans")).drop("row")
