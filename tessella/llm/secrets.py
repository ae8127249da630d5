"""Secret scans with multipart credential linking.

Plain patterns (assignments, access keys, long hex runs) are always reported.
Beyond them, weak parts are collected: access identifiers, unlabelled secrets
and service endpoints. A weak part alone is noise, so parts are joined as
intervals inside scopes (blocks between blank lines, with at most ``REACH`` code
points between them): a weak candidate is reported only when complementary parts
occur together. Parts themselves may have any length. Each part looks up the
nearest complementary one on either side in sorted lists.

Scanning is a map over the scan without a shuffle. A pattern test in the JVM,
which every possible finding satisfies, sends only texts with a chance of one to
Python; the others get their (empty) result there, from nulls.

Edge cases: null text counts as empty; empty texts have no spans. Very long
texts are scanned whole. Repeated rows are scanned alike; extra columns are
carried through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import portable

REACH = 400
KINDS = ("assign", "access", "hex")
WEAK_KINDS = ("identity", "secret", "endpoint")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")
#: Weak parts; each has one group, the part's own span.
IDENTITY = re.compile(r"""(?:client_?id|access_?id|user(?:name)?|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", re.ASCII | re.IGNORECASE)
BARE_SECRET = re.compile(r"(?<![A-Za-z0-9+/=_-])([A-Za-z0-9+/_-]{32,}={0,2})(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"""\b((?:https?|jdbc:\w+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|ftp)://[^\s"'<>]{4,})""", re.ASCII)
#: Dotted names are read in one pass, whatever their length, and then searched for a service's domain.
DOTTED = re.compile(r"(?<![a-z0-9-])[a-z0-9-]++(?:\.[a-z0-9-]++)+")
DOMAIN = re.compile(r"\.(?:amazonaws|azure|googleapis)\.com")
EDGE = re.compile(r"\b[a-z0-9-]", re.ASCII)

#: JVM test that any base or reportable weak finding satisfies (weak ones need a labelled identity or an access key or endpoint).
CHANCE = r"(?i)password|passwd|secret|token|api_?key|akia|[0-9a-f]{24}|client_?id|access_?id|user|login|account|://|amazonaws|azure|googleapis"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base findings as (kind, start, end), by start and then kind as listed."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a maximal run of 24 or more is what [0-9a-f]+ finds and keeps
    found += [("hex", m.start(), m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _mixed(value: str) -> bool:
    """Looks random: upper and lower case letters and digits, many distinct signs."""
    return len(set(value)) >= 12 and bool(re.search("[a-z]", value) and re.search("[A-Z]", value) and re.search("[0-9]", value))


def endpoints(text: str) -> list[tuple[int, int]]:
    """Spans of addresses and, outside of them, of the services' host names."""
    spans = [m.span(1) for m in ENDPOINT.finditer(text)]
    starts = [s for s, _ in spans]
    hosts = []
    for name in DOTTED.finditer(text):
        domains = list(DOMAIN.finditer(text, *name.span()))
        first = EDGE.search(text, *name.span()) if domains else None
        if first and first.start() < domains[-1].start():
            s, e = first.start(), domains[-1].end()
            i = bisect_left(starts, e) - 1
            if i < 0 or spans[i][1] <= s:
                hosts.append((s, e))
    return spans + hosts


def weak_parts(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weak candidates as (part, start, end), without spans that base findings cover whole."""
    starts: list[int] = []
    ends: list[int] = []
    for _, s, e in base:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)

    def covered(s: int, e: int) -> bool:
        i = bisect_right(starts, s) - 1
        return i >= 0 and e <= ends[i]

    parts = [("identity", *m.span(1)) for m in IDENTITY.finditer(text)]
    parts += [("endpoint", s, e) for s, e in endpoints(text)]
    parts += [("secret", *m.span(1)) for m in BARE_SECRET.finditer(text) if _mixed(m[1])]
    return sorted({p for p in parts if not covered(p[1], p[2])}, key=lambda p: (p[1], WEAK_KINDS.index(p[0]), p[2]))


def link(text: str, base: list[tuple[str, int, int]], weak: list[tuple[str, int, int]], reach: int = REACH) -> list[tuple[str, int, int]]:
    """Weak parts with a complementary part in their scope.

    An access identifier (weak identity or base access key) and a secret (weak,
    or base assignment or hex run) complement each other. An endpoint is
    reported when both an identifier and a secret are within its reach.
    """
    if not weak:
        return []
    blocks = [m.end() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    ids = [(s, e) for k, s, e in weak if k == "identity"] + [(s, e) for k, s, e in base if k == "access"]
    secrets = [(s, e) for k, s, e in weak if k == "secret"] + [(s, e) for k, s, e in base if k != "access"]
    id_edges = sorted(s for s, _ in ids), sorted(e for _, e in ids)
    secret_edges = sorted(s for s, _ in secrets), sorted(e for _, e in secrets)

    def near(starts: list[int], ends: list[int], s: int, e: int) -> bool:
        b = bisect_right(blocks, s)
        after = bisect_left(starts, e)
        if after < len(starts) and starts[after] < min(e + reach, blocks[b] if b < len(blocks) else len(text)):
            return True
        before = bisect_right(ends, s) - 1
        return before >= 0 and ends[before] > (blocks[b - 1] if b else 0) and ends[before] >= s - reach

    out = []
    for kind, s, e in weak:
        if kind == "identity":
            linked = near(*secret_edges, s, e)
        elif kind == "secret":
            linked = near(*id_edges, s, e)
        else:
            linked = near(*id_edges, s, e) and near(*secret_edges, s, e)
        if linked:
            out.append((kind, s, e))
    return out


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base findings, and all findings, of one text."""
    base = base_spans(text)
    more = link(text, base, weak_parts(text, base))
    order = [*KINDS, *WEAK_KINDS]
    return base, sorted(base + more, key=lambda s: (s[1], order.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each found span (overlaps merged) replaced by ``<secret>``."""
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if s >= at:
            out += [text[at:s], "<secret>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"
_EMPTY = hashlib.sha256(b"").hexdigest()


def scan(docs: DataFrame, *, text: str = "text", result: str = "found") -> DataFrame:
    """``docs`` with a struct ``found`` of counts, digest, spans and redacted text
    (null where nothing was found). A column of that name is replaced."""

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            if t is None:
                rows.append((0, 0, 0, _EMPTY, "", None))
                continue
            base, every = find(t)
            kinds = [k for k, _, _ in base]
            rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), redact(t, every) if every else None))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])

    return docs.withColumn(result, run(F.when(F.col(text).rlike(CHANCE), F.col(text))))


def cleaned(docs: DataFrame, *, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with every found span replaced and the length column set anew."""
    redacted = F.col("__tessella_found.redacted")
    new = scan(docs, text=text, result="__tessella_found").withColumn(text, F.coalesce(redacted, F.col(text)))
    if n_chars in docs.columns:
        kind = docs.schema[n_chars].dataType
        new = new.withColumn(n_chars, F.when(redacted.isNotNull(), F.length(redacted).cast(kind)).otherwise(F.col(n_chars)))
    return new.select(*[F.col(f"`{c}`") for c in docs.columns])


portable(__name__)
