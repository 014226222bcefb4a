"""Secret scans: strong patterns, plus weak parts that count only beside their complement.

A leaked credential is often spread over several places: an access identifier, a secret and an endpoint. Strong
patterns are reported wherever they stand. Weak candidates (short assigned values, bare high-variety tokens, user
names, endpoints) are interval-joined within a scope, a stretch of ``reach`` characters around each part that blank
lines end, and are reported only if a secret and an identifier or endpoint meet there. Parts of a document are kept
sorted and joined by bisection, so no pairs are listed and a text with very many parts stays cheap.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The strong patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18}
# Weak parts; each kind names the side of a credential that it can be.
ENDPOINT = re.compile(r"\b(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>|]+", re.A)
USER = re.compile(r"""\b(?:user(?:_?name)?|login|client_id|access_key(?:_id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})""", re.I | re.A)
BARE = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=.-])", re.A)
KINDS = ("assign", "access", "hex", "endpoint", "user", "secret")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_BREAK = re.compile(r"(?>\r\n?|\n)[ \t]*(?>\r\n?|\n)")  # a blank line, by any line end

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Strong spans (start, end, kind); matching is leftmost without overlap within a kind, short matches then fall away."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return found + [(*m.span(), "hex") for m in HEX.finditer(text)]


def varied(token: str) -> bool:
    """Upper case, lower case and digits together, as in generated keys."""
    return any(map(str.isdigit, token)) and any(map(str.isupper, token)) and any(map(str.islower, token))


def linked_spans(text: str, base: list[tuple[int, int, str]], reach: int = 300) -> list[tuple[int, int, str]]:
    """Weak parts whose scope holds their complement: for a secret an identifier or an endpoint, for an identifier a secret, for
    an endpoint a secret that isn't bare hexadecimal, as addresses often stand beside digests.

    The scope of a part reaches ``reach`` characters beyond it on either side, but not over a blank line. Parts are joined
    as intervals: a part of another side counts if any of it lies in the scope, wherever it begins.
    """
    taken = sorted(base)
    begins, tops = [a for a, _, _ in taken], list(accumulate((b for _, b, _ in taken), max))

    def free(a: int, b: int) -> bool:
        """No strong span overlaps: of those begun before b, none reaches beyond a."""
        k = bisect_left(begins, b)
        return not k or tops[k - 1] <= a

    weak = [(*m.span(), "endpoint") for m in ENDPOINT.finditer(text)] if "://" in text else []
    weak += [(*m.span(), "user") for m in USER.finditer(text) if free(*m.span())]
    if not weak and not base:
        return []
    weak += [(*m.span(), "assign?") for m in ASSIGN.finditer(text) if 4 <= m.end(2) - m.start(2) < LEAST["assign"]]
    weak += [(*m.span(), "secret") for m in BARE.finditer(text) if varied(m[0]) and free(*m.span())]
    if not weak:
        return []
    walls = [m.start() for m in _BREAK.finditer(text)]
    sides = {"id": ([], []), "secret": ([], []), "keyed": ([], []), "place": ([], [])}  # starts and ends; keyed: secrets but bare hexadecimal
    side = {"access": "id", "user": "id", "assign": "secret", "hex": "secret", "assign?": "secret", "secret": "secret", "endpoint": "place"}
    for a, b, kind in base + weak:
        for which in (side[kind], "keyed") if side[kind] == "secret" and kind != "hex" else (side[kind],):
            for ends, at in zip(sides[which], (a, b), strict=True):
                ends.append(at)
    for starts, ends in sides.values():
        starts.sort()
        ends.sort()

    def near(a: int, b: int, which: str) -> bool:
        k = bisect_right(walls, a)
        lo = max(a - reach, walls[k - 1] if k else 0)
        hi = min(b + reach, walls[k] if k < len(walls) else len(text))
        starts, ends = sides[which]
        return bisect_left(starts, hi) > bisect_right(ends, lo)  # begun before the scope's end, less those over by its begin

    needs = {"id": ("secret",), "place": ("keyed",), "secret": ("id", "place")}
    out = []
    for a, b, kind in weak:
        if any(near(a, b, which) for which in needs[side[kind]]):
            out.append((a, b, "secret" if kind == "assign?" else kind))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], _ORDER[s[2]], s[1])))


def scan(docs: DataFrame, reach: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, see ``SCHEMA``; offsets are code points of the whole text, ends exclusive.

    Null and empty texts have no spans (the hash is that of the empty string). Repeated rows are scanned each on
    its own; extra columns are ignored; an empty table gives an empty result. Narrow: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                base = base_spans(text)
                n = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
                rows.append((doc, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + linked_spans(text, base, reach))))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")]
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)
