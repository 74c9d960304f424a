"""Secret scans: known shapes, and windows of high Shannon entropy in candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, documents

#: The known shapes.  A shorter match is dropped, and what it covers is not searched again.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_upper", "entropy_lower", "entropy_base64")

#: A candidate is a run of these characters of at least WINDOW.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Character classes: pattern, and the bits a character from which a window counts.
CLASSES = {
    "entropy_hex": (re.compile(r"[0-9A-Fa-f]{20,}"), 3.0),
    "entropy_upper": (re.compile(r"[0-9A-Z]{20,}"), 3.5),
    "entropy_lower": (re.compile(r"[0-9a-z]{20,}"), 3.5),
    "entropy_base64": (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.8),
}
#: What stands for a secret, or counts: a candidate is cut at these, and what is left is looked at by itself.
PLACEHOLDER = re.compile(r"(?i)example|sample|placeholder|dummy|changeme|xxxx+|0123456789|1234567890|abcdefghij|(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Fa-f])")
#: What looks random and is no secret: numbers, words without a digit (random letters alone are passed over with them), and paths of words.
ALLOWED = (
    re.compile(r"[0-9+/_=-]*"),
    re.compile(r"[A-Za-z+/_=-]*"),
    re.compile(r"/?([A-Za-z]+[/_-])+[A-Za-z]*[0-9]{0,4}"),
)
#: c * log2(c), in units of 2^-32 so that adding and taking away leaves no rounding error.
_C_LOG_C = [0, *(round(c * math.log2(c) * 2**32) for c in range(1, WINDOW + 2))]


def entropy_runs(run: str, least: float) -> Iterator[tuple[int, int]]:
    """Maximal spans of run that windows of WINDOW characters with at least so many bits a character cover.

    Moving a window by one changes two counts, and the sum of c * log2(c) by
    their terms alone: the bits are log2(WINDOW) - sum / WINDOW.
    """
    most = (math.log2(WINDOW) - least) * WINDOW * 2**32
    counts: dict[str, int] = {}
    total, begin, end = 0, -1, -1
    for i, new in enumerate(run):
        c = counts.get(new, 0)
        counts[new] = c + 1
        total += _C_LOG_C[c + 1] - _C_LOG_C[c]
        if i >= WINDOW:
            old = run[i - WINDOW]
            c = counts[old]
            counts[old] = c - 1
            total += _C_LOG_C[c - 1] - _C_LOG_C[c]
        if i >= WINDOW - 1 and total <= most:
            if i - WINDOW + 1 > end:
                if end >= 0:
                    yield begin, end
                begin = i - WINDOW + 1
            end = i + 1
    if end >= 0:
        yield begin, end


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the known shapes, in order."""
    out, low = [], text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]  # a run of fewer has no match of 16 in it
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def pieces(candidate: str) -> Iterator[tuple[int, str]]:
    """What placeholders leave of a candidate, with its places; what is shorter than a window can't count."""
    at = 0
    for m in [*PLACEHOLDER.finditer(candidate), None]:
        end = m.start() if m else len(candidate)
        if end - at >= WINDOW:
            yield at, candidate[at:end]
        at = m.end() if m else end


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of high entropy, without what the allow-list has: whole pieces or spans of its shapes, and placeholders.

    A key glued to a placeholder, a path or a name is found; the placeholder
    itself is never part of a span.
    """
    out = []
    for candidate in CANDIDATE.finditer(text):
        for at, piece in pieces(candidate[0]):
            if any(a.fullmatch(piece) for a in ALLOWED):
                continue
            for kind, (shape, least) in CLASSES.items():
                for run in shape.finditer(piece):
                    for s, e in entropy_runs(run[0], least):
                        if not any(a.fullmatch(run[0][s:e]) for a in ALLOWED):
                            start = candidate.start() + at + run.start()
                            out.append((start + s, start + e, kind))
    return out


def scan_text(text: str) -> tuple[list, list]:
    """Base spans, and all spans; a span of high entropy inside a base span, or inside a longer or earlier one of its kind, adds nothing."""
    base, out, end = base_spans(text), [], 0
    order = lambda x: (x[0], -x[1], KINDS.index(x[2]))
    for x in sorted([*base, *entropy_spans(text)], key=order):  # an end so far tells of all spans that start before
        known = x[2] in LEAST
        if known or x[1] > end:
            out.append(x)
        end = max(end, x[1])
    return base, sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex long, base_sha256 string, spans string.

    The counts and base_sha256 are of the known shapes; spans has those of high
    entropy as well.  Positions are code points, ends exclusive.  A null or empty text has no
    spans.  Rows are scanned alone, so repeated rows and ties play no part; an
    empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_assign", "n_access", "n_hex")), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                found = [scan_text(x or "") for x in b.column(1).to_pylist()]
                counts = [[sum(k == kind for _, _, k in base) for base, _ in found] for kind in KINDS[:3]]
                yield batch(schema, b.column(0), *counts, [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], [joined(spans) for _, spans in found])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
