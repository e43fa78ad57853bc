"""Operator 2: secrets in texts, with multipart credential linking.

Strong parts are reported alone: assignments of secrets, access identifiers, long hexadecimal runs. Weak parts are logins,
service endpoints and random-looking tokens. They are common in clean text, so they are reported only where complementary
parts co-occur in one scope, a paragraph (text between blank lines), however long. A reach in code points can be asked for
on top of that.

* a token: beside an access identifier, or beside a login and an endpoint
* a login: beside a secret (assignment, hexadecimal run, token) and an endpoint
* an endpoint: beside an identifier (access identifier, login) and a secret

The parts of a text are joined as intervals: each kind is a list sorted by position, and what lies in the scope of a part
is found by bisection, so a text with very many parts stays near linear. A text's parts never leave its row, hence there
is no shuffle, whatever the key or the size of a text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspark.llm.common import replaced, table

#: Strong kinds, in the order in which equal starts are listed; weak kinds follow.
STRONG = ["assign", "access", "hex"]
WEAK = ["login", "token", "endpoint"]
KINDS = STRONG + WEAK

# ASCII: without it, letters such as the long s would count as ASCII letters in either case
_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
_HEX = re.compile("[0-9a-f]{24,}")
_LOGIN = re.compile(
    r"""(?<![A-Za-z0-9])(?:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
    re.ASCII | re.IGNORECASE,
)
_TOKEN = re.compile("[A-Za-z0-9+/_=-]{16,}")
_ENDPOINT = re.compile(r"""https?://[^\s"'<>]+|(?<![A-Za-z0-9])(?:host|server|endpoint)\x20*[:=]\x20*[A-Za-z0-9.-]{4,}""", re.ASCII)
_SCOPE_END = re.compile(r"\n[ \t\r]*\n")
#: What an assignment can end in before its value; a text without these has none.
_NAMES = re.compile("passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)


def _random_looking(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


class _Scopes:
    """Which parts lie in the scope of a span, and within ``reach`` code points of it if that is given."""

    def __init__(self, text: str, reach: int | None):
        self.ends = [m.start() for m in _SCOPE_END.finditer(text)]
        self.reach = len(text) if reach is None else reach

    def near(self, span: tuple[int, int], parts: list[tuple[int, int]]) -> bool:
        """Parts are sorted and do not overlap each other; the span itself is no part of them. The nearest on either side
        decides: a part further out is in scope and reach only if that one is."""
        scope = bisect_left(self.ends, span[0])
        at = bisect_left(parts, span)
        return any(
            bisect_left(self.ends, a) == scope and a - span[1] <= self.reach and span[0] - b <= self.reach
            for a, b in parts[max(0, at - 1) : at + 1]
        )

    def near_any(self, span, *lists) -> bool:
        return any(self.near(span, parts) for parts in lists)


def scan_text(text: str | None, reach: int | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start, then kind."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if _NAMES.search(text):
        # a match with a short value is dropped, yet what it covers is not searched again
        found["assign"] = [m.span() for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found["access"] = [m.span() for m in _ACCESS.finditer(text)]
    found["hex"] = [m.span() for m in _HEX.finditer(text)]
    logins = [m.span() for m in _LOGIN.finditer(text)]
    if logins or found["access"]:  # every rule needs an identifier
        scopes = _Scopes(text, reach)
        strong = sorted(x for k in STRONG for x in found[k])
        endpoints = [m.span() for m in _ENDPOINT.finditer(text)]
        taken = sorted(strong + logins + endpoints)
        tokens = [m.span() for m in _TOKEN.finditer(text) if _random_looking(m[0])]
        reached = list(accumulate((b for _, b in taken), max))
        tokens = [x for x in tokens if not _overlaps(x, taken, reached)]
        secrets = found["assign"], found["hex"], tokens
        for x in tokens:
            if scopes.near(x, found["access"]) or scopes.near(x, logins) and scopes.near(x, endpoints):
                found["token"].append(x)
        for x in logins:
            if scopes.near_any(x, *secrets) and scopes.near(x, endpoints):
                found["login"].append(x)
        for x in endpoints:
            if scopes.near_any(x, *secrets) and scopes.near_any(x, found["access"], logins):
                found["endpoint"].append(x)
    spans = [(k, a, b) for k in KINDS for a, b in found[k]]
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


def _overlaps(span: tuple[int, int], taken: list[tuple[int, int]], reached: list[int]) -> bool:
    """``taken`` is sorted by start; ``reached`` holds the furthest end of each of its spans and all before it."""
    at = bisect_left(taken, (span[1], 0))
    return at > 0 and reached[at - 1] > span[0]


def redact_text(text: str | None, reach: int | None = None) -> str | None:
    """Each run of reported parts becomes its kind in brackets."""
    spans = scan_text(text, reach)
    if not spans:
        return text
    kept, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            kept += [text[done:a], f"[{kind}]"]
        done = max(done, b)
    return "".join([*kept, text[done:]])


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))



def _scan(text: str, reach: int | None) -> Column:
    @F.arrow_udf(T.ArrayType(_SPAN))
    def run(texts: pa.Array) -> pa.Array:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t, reach)] for t in texts.to_pylist()]
        return pa.array(found, _ARROW)

    return run(text)


def _redact(text: str, reach: int | None) -> Column:
    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([redact_text(t, reach) for t in texts.to_pylist()], pa.string())

    return run(text)


def scan(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """``docs`` with a column ``secrets`` (an input column of that name goes): kind, start and end of each reported part.

    Weak parts are linked in their whole paragraph, or only within ``reach`` code points. A null or empty text has none.
    Each row is judged alone, so repeated rows stay; texts are read whole.
    """
    return replaced(docs, secrets=_scan("text", reach))


def redact(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """``docs`` with reported parts replaced in the texts; no row goes, other texts stay as they are. ``n_chars``, where
    there is such a column, is counted anew for changed texts."""
    out = docs.withColumn("_llm_clean", _redact("text", reach))
    changed = ~F.col("_llm_clean").eqNullSafe(F.col("text"))
    columns = {c: F.col(f"`{c}`") for c in docs.columns}
    columns["text"] = F.col("_llm_clean")
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(changed, F.char_length("_llm_clean").cast(kind)).otherwise(F.col("n_chars"))
    return out.select(*[c.alias(name) for name, c in columns.items()])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    secrets = F.col("secrets")
    count = lambda kind: F.size(F.filter(secrets, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(secrets, lambda s: s["kind"].isin(STRONG))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in STRONG],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(secrets).alias("spans"),
    )


QUERIES = {"op2_secret_scan": query}
ORACLE = {}
