"""Secret scans with multipart credential linking.

Three patterns are reported wherever they match (the base spans). Beyond them, a credential often
comes in parts of which none is telling alone: an access identifier, a secret and an endpoint.
Every text is cut into scopes (runs of lines without an empty line between them); within a scope
each identifier opens an interval of `REACH` characters to either side, and secrets and endpoints
are joined to the intervals that they lie in. A weak part is reported only when parts of different
roles co-occur so: an identifier with a secret, or a secret with both an identifier and an endpoint
(then the endpoint too). Base matches take part as strong parts: an access key as identifier, an
assignment or a long hexadecimal run as secret.

Span kinds: assign, access, hex (base), then ident, key, endpoint (weak parts that were linked).
Offsets are code points, ends exclusive.

Cases: null and empty texts have no spans; texts of any length are scanned whole; repeated rows and
ids are scanned each; an empty table gives an empty table; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_slices

REACH = 300
ASSIGN = re.compile(
    r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
# Weak parts.
IDENT = re.compile(
    r"(?i:access[_-]?key[_-]?id|client[_-]?id|key[_-]?id|account|username|user|login)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]{3,})",
    re.ASCII,
)
KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"://[A-Za-z0-9._~:@-]+(?:/[A-Za-z0-9._~/-]*)?", re.ASCII)
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
BREAK = re.compile(r"\n[ \t\r]*\n")
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
ORDER = {k: i for i, k in enumerate(KINDS)}
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def entropy(s: str) -> float:
    """Bits a character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each base pattern; too short ones are dropped after
    matching, so that they still use up their characters."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    # Of these two every match is a whole run (or its rest), so the least length may be in the pattern.
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def endpoints(text: str) -> list[tuple[int, int, str]]:
    """Addresses with a scheme of two characters or more, found from their "://" back, so that a run of
    any length is read once."""
    out = []
    for m in ENDPOINT.finditer(text):
        run = m.start()
        while run and text[run - 1] in SCHEME:
            run -= 1
        for i in range(run, m.start() - 1):
            if text[i].isalpha() and (not i or not (text[i - 1].isalnum() or text[i - 1] == "_")):
                out.append((i, m.end(), "endpoint"))
                break
    return out


def weak_parts(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates that count only together; those that overlap a base span are left out."""
    taken = sorted((s, e) for s, e, _ in base)
    starts, reach = [s for s, _ in taken], []
    for _, e in taken:
        reach.append(max(e, reach[-1] if reach else 0))

    def free(s: int, e: int) -> bool:
        i = bisect_left(starts, e) - 1
        return i < 0 or reach[i] <= s

    found = [(m.start(1), m.end(1), "ident") for m in IDENT.finditer(text)] if "=" in text or ":" in text else []
    if "://" in text:
        found += endpoints(text)
    for m in KEY.finditer(text):
        s = m.group()
        # random tokens mix digits with letters; words and paths don't
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and entropy(s) >= 3.5:
            found.append((m.start(), m.end(), "key"))
    return [x for x in found if free(x[0], x[1])]


ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "id", "ident": "id", "endpoint": "at"}


def linked(text: str, base: list[tuple[int, int, str]], weak: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The weak parts that stand together with parts of other roles: an interval join by a sweep
    over each scope's parts in order of start."""
    breaks = [m.start() for m in BREAK.finditer(text)]
    parts = sorted((s, e, k, bisect_left(breaks, s)) for s, e, k in base + weak)
    near: list[set[str]] = [set() for _ in parts]
    ids = [i for i, p in enumerate(parts) if ROLE[p[2]] == "id"]
    # for each part that is no identifier: whether an identifier's interval in its scope reaches it
    left: dict[int, int] = {}
    for i, (s, e, k, scope) in enumerate(parts):
        if ROLE[k] == "id":
            left[scope] = max(left.get(scope, -1), e)
        elif left.get(scope, -10 * REACH) + REACH >= s:
            near[i].add("id")
    right: dict[int, int] = {}
    for i in range(len(parts) - 1, -1, -1):
        s, e, k, scope = parts[i]
        if ROLE[k] == "id":
            right[scope] = s
        elif scope in right and right[scope] - REACH <= e:
            near[i].add("id")
    # and the other way round: which roles lie in each identifier's interval, by counts of starts
    longest = max((e - s for s, e, _, _ in parts), default=0)
    starts: dict[tuple[int, str], list[tuple[int, int]]] = {}
    for s, e, k, scope in parts:
        starts.setdefault((scope, ROLE[k]), []).append((s, e))
    for i in ids:
        s, e, _, scope = parts[i]
        for role in ("secret", "at"):
            own = starts.get((scope, role), [])
            j = bisect_left(own, (s - REACH - longest, -1))
            while j < len(own) and own[j][0] <= e + REACH:
                if own[j][1] >= s - REACH:
                    near[i].add(role)
                    break
                j += 1
    # a secret near an identifier whose interval also holds an endpoint makes that endpoint count
    full: dict[int, list[tuple[int, int]]] = {}
    for i in ids:
        if {"secret", "at"} <= near[i]:
            full.setdefault(parts[i][3], []).append(parts[i][:2])
    out = []
    for i, (s, e, k, scope) in enumerate(parts):
        if k == "ident" and "secret" in near[i] or k == "key" and "id" in near[i]:
            out.append((s, e, k))
        elif k == "endpoint" and (own := full.get(scope)):
            j = bisect_left(own, (s, -1))
            if any(a - REACH <= e and s <= b + REACH for a, b in own[max(0, j - 1) : j + 1]):
                out.append((s, e, k))
    return out


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and linked weak spans of a text, each by start and then kind."""
    by = lambda x: (x[0], ORDER[x[2]])
    base = base_spans(text)
    weak = weak_parts(text, base)
    more = linked(text, base, weak) if weak else []
    return sorted(base, key=by), sorted(more, key=by)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join([f"{k}:{s}:{e}" for s, e, k in spans])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 (of the base spans as kind:start:end joined by
    commas) and spans (all of them, joined likewise), for every row of `docs`."""

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(1):
                base, more = scan(text.as_py() or "")
                n = Counter(k for _, _, k in base)
                spans = sorted(base + more, key=lambda x: (x[0], ORDER[x[2]])) if more else base
                joined = _joined(base)
                digest = hashlib.sha256(joined.encode()).hexdigest()
                out.append((n["assign"], n["access"], n["hex"], digest, joined if not more else _joined(spans)))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(in_slices(run), SCHEMA)


def mask_spans(text: str | None) -> str | None:
    """The text with every span that was found replaced by its kind in angle brackets."""
    if not text:
        return text
    base, more = scan(text)
    if not base and not more:
        return text
    out, at = [], 0
    for s, e, k in sorted(base + more, key=lambda x: (x[0], -x[1])):
        if s >= at:
            out.append(text[at:s])
            out.append(f"<{k}>")
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the secrets in its texts masked; all columns and rows stay."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            masked = pa.array([mask_spans(t.as_py()) for t in b.column(at)], pa.string())
            yield b.set_column(at, b.schema.field(at), masked.cast(b.schema.field(at).type))

    return docs.mapInArrow(in_slices(run), docs.schema)
