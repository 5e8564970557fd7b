"""Secrets in texts, with the parts of a credential linked to each other."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_schema, in_arrow

#: Parts of one credential stand so many code points apart at most.
REACH = 300
#: Names of the values that are secrets; the three base patterns.
SECRET_NAMES = "password|passwd|secret|token|api_?key"
ASSIGN = re.compile(rf"""({SECRET_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Names whose value tells whose secret it is.
LOGIN_NAMES = "user_?name|user|login|account|client_?id|key_?id"
LOGIN = re.compile(rf"""({LOGIN_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", re.I | re.A)
#: Where a secret is used: an address with its scheme, or four numbers with or without a port.
ENDPOINT = re.compile(
    r"""[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20"'<>]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?::[0-9]{1,5})?"""
)
#: A bare run that may be a secret: 20 to 200 characters with a digit and letters of both cases.
BARE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
BARE_LEAST, BARE_MOST = 20, 200
#: What ends a scope: an empty line.
BREAK = re.compile(r"\n[\x20\x09\x0D]*\n")
#: The base kinds, then those reported only beside a complementary part, in the order of equal starts.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "login", "endpoint", "bare")
#: Whether a kind names a secret, an identifier or an endpoint.
ROLE = {"assign": "secret", "hex": "secret", "bare": "secret", "access": "id", "login": "id", "endpoint": "endpoint"}

Span = tuple[int, int]


class Intervals:
    """Spans of one scope and role that do not contain each other, for nearest-neighbour questions."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted(set(spans))
        self.starts = [s for s, _ in self.spans]
        self.ends = sorted(e for _, e in self.spans)

    def meets(self, span: Span, reach: int) -> bool:
        """Whether one of them, widened by ``reach`` on both sides, touches ``span``."""
        # Those that begin early enough, less those that have ended too early.
        return bisect_right(self.starts, span[1] + reach) > bisect_left(self.ends, span[0] - reach)


def base_spans(text: str) -> dict[str, list[Span]]:
    """The base kinds: whole matches, leftmost and not overlapping within a kind."""
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8],
        "access": [m.span() for m in ACCESS.finditer(text)],
        "hex": [m.span() for m in HEX.finditer(text)],
    }


def _apart(spans: list[Span], others: list[Span]) -> list[Span]:
    """The spans that share no character with any of the others."""
    known = Intervals(others)
    # An interval that only touches has a gap of zero, so both ends give way by one.
    return [s for s in spans if not known.meets((s[0] + 1, s[1] - 1), 0)]


def weak_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Candidates that mean nothing alone; none of what a stronger kind covers already."""
    strong = [s for found in base.values() for s in found]
    login = _apart([m.span() for m in LOGIN.finditer(text) if len(m.group(2)) >= 3], strong)
    endpoint = [m.span() for m in ENDPOINT.finditer(text)]
    bare = [
        m.span()
        for m in BARE.finditer(text)
        if len(m.group()) <= BARE_MOST and all(re.search(c, m.group()) for c in ("[0-9]", "[a-z]", "[A-Z]"))
    ]
    return {"login": login, "endpoint": endpoint, "bare": _apart(bare, strong + login + endpoint)}


def linked(text: str, reach: int = REACH) -> list[tuple[str, int, int, int]]:
    """All reported spans of a text as (kind, start, end, scope), in order of start, then of ``KINDS``."""
    base = base_spans(text)
    found = base | weak_spans(text, base)
    breaks = [m.start() for m in BREAK.finditer(text)]
    scopes: dict[int, dict[str, list[Span]]] = {}
    for kind in KINDS:
        for span in found[kind]:
            scopes.setdefault(bisect_left(breaks, span[0]), {k: [] for k in KINDS})[kind].append(span)
    out = []
    for scope, parts in scopes.items():
        near = {k: Intervals(spans) for k, spans in parts.items()}
        # A bare run needs a known identifier, or a named one and an endpoint.
        parts["bare"] = [
            s
            for s in parts["bare"]
            if near["access"].meets(s, reach) or (near["login"].meets(s, reach) and near["endpoint"].meets(s, reach))
        ]
        secrets = Intervals(parts["assign"] + parts["hex"] + parts["bare"])
        for kind in ("login", "endpoint"):
            parts[kind] = [s for s in parts[kind] if secrets.meets(s, reach)]
        out += [(kind, *span, scope) for kind in KINDS for span in parts[kind]]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", reach: int = REACH) -> DataFrame:
    """Every row of ``docs`` with its ``key`` and ``spans``: kind, start, end and scope of each part found.

    Base kinds always stand: named secrets (assign), access identifiers (access) and long hexadecimal
    runs (hex). Weak kinds stand only where complementary parts co-occur: parts meet if their scope,
    the stretch between two empty lines, is the same and at most ``reach`` code points part them. A
    bare run of mixed characters stands beside an access identifier, or beside both a login and an
    endpoint; a login or an endpoint stands beside a secret that stands. Ends are exclusive, counted
    in code points.

    The intervals of a scope are joined where their text is: each asks a sorted list for the nearest,
    so no pairs are formed and nothing is shuffled. A null or empty text has no spans; a very long
    one costs its matches in memory; repeated rows are searched one by one; a null key stays null; an
    empty table gives no rows; other columns are not looked at.
    """
    schema = f"{key} long, spans array<struct<kind: string, start: int, end: int, scope: int>>"
    kind = arrow_schema(schema)
    names = ("kind", "start", "end", "scope")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[dict(zip(names, s)) for s in linked(body.as_py() or "", reach)] for body in b.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("_key").cast(kind[0].type), pa.array(spans, kind[1].type)], schema=kind
            )

    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    return in_arrow(rows, run, schema)


def named(spans, kinds: tuple[str, ...] = KINDS):
    """A column of spans as text: kind:start:end of the given kinds, joined by commas."""
    some = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    each = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(some, each), ",")


def redacted(docs: DataFrame, text: str = "text", mark: str = "[secret]", reach: int = REACH) -> DataFrame:
    """``docs`` with each reported secret, base or linked, replaced by a mark; nulls stay null.

    Identifiers and endpoints stay readable. Overlapping secrets become one mark. All columns are kept.
    """
    kind = arrow_schema(docs.schema)

    def clean(body: str) -> str:
        out, at = [], 0
        for what, start, end, _ in linked(body, reach):
            if ROLE[what] == "secret" or what == "access":
                out += [body[at:start], mark] if start >= at else []
                at = max(at, end)
        return "".join([*out, body[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = [None if x is None else clean(x) for x in b.column(text).to_pylist()]
            columns = [pa.array(bodies, pa.string()) if n == text else c for n, c in zip(b.schema.names, b.columns)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kind)], schema=kind)

    return in_arrow(docs, run, docs.schema)
