"""Secret scan with multipart credential linking.

Strong findings (``assign``, ``access``, ``hex``) are reported wherever they stand. Weak parts, which alone are
too common to report, are found beside them:

* ``ident``: ``user=``, ``username:``, ``client_id=``, ``account_id=`` and the like with a value, or an e-mail address;
* ``key``: a run of 20 or more of ``[A-Za-z0-9+/_]`` with lower and upper case and a digit;
* ``endpoint``: a URL, an ``host:port`` or a dotted IPv4 address.

A credential has three roles: identifier (``access``, ``ident``), secret (``assign``, ``hex``, ``key``) and
endpoint. Parts are joined as intervals, two by two: two parts meet if they stand in one scope (a paragraph: text
between blank lines), do not overlap, and leave at most ``reach`` code points between them. An identifier and a
secret that meet complete each other; an endpoint completes a part that has been completed. A weak part is reported
only if another part completes it, so nothing chains on from part to part. Of overlapping weak parts the first stands;
one that overlaps a strong finding is dropped, as it is no evidence of its own. Strong findings are never removed.

The join looks at the nearest part on either side only, found by bisection, so a text of n parts costs n log n.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
IDENT = re.compile(r"""\b(?:user(?:name|_?id)?|login|client_?id|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{2,128}|\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}""", re.I | re.A)
KEY = re.compile(r"(?<![A-Za-z0-9+/_])(?=[A-Za-z+/_]*[0-9])[A-Za-z0-9+/_]{20,}(?![A-Za-z0-9+/_])", re.A)
ENDPOINT = re.compile(r"""\b[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]{3,}|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?\b|\b[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}:\d{2,5}\b""", re.A)
SCOPE = re.compile(r"\n[ \t\r]*\n")
STRONG = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate((*STRONG, "ident", "key", "endpoint"))}
ROLE = {"assign": "secret", "access": "ident", "hex": "secret", "ident": "ident", "key": "secret", "endpoint": "endpoint"}


def strong_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of strong findings, by start, then kind as listed."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], ORDER[x[2]]))


def weak_spans(text: str, strong: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak parts, leftmost first, that overlap neither a strong finding nor each other."""
    weak = [(m.start(), m.end(), k) for k, rx in (("ident", IDENT), ("endpoint", ENDPOINT)) for m in rx.finditer(text)]
    weak += [(m.start(), m.end(), "key") for m in KEY.finditer(text) if re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
    taken, ends = sorted((s, e) for s, e, _ in strong), []
    for _, e in taken:
        ends.append(max(e, ends[-1] if ends else 0))
    out, last = [], 0
    for s, e, k in sorted(weak, key=lambda x: (x[0], ORDER[x[2]])):
        before = bisect_left(taken, (e, 0))  # strong findings that start before its end
        if s >= last and not (before and ends[before - 1] > s):
            out.append((s, e, k))
            last = e
    return out


class Nearest:
    """Parts of one scope each, by which the nearest on either side of a part is found."""

    def __init__(self, parts: list[tuple[int, int, str]], scope) -> None:
        self.starts = sorted((scope(s), s) for s, _, _ in parts)
        self.ends = sorted((scope(s), e) for s, e, _ in parts)

    def meets(self, start: int, end: int, scope: int, reach: int) -> bool:
        right, left = bisect_left(self.starts, (scope, end)), bisect_right(self.ends, (scope, start)) - 1
        return (right < len(self.starts) and self.starts[right][0] == scope and self.starts[right][1] - end <= reach) or (left >= 0 and self.ends[left][0] == scope and start - self.ends[left][1] <= reach)


def linked_spans(text: str, strong: list[tuple[int, int, str]], reach: int) -> list[tuple[int, int, str]]:
    """Weak parts that another part completes."""
    weak = weak_spans(text, strong)
    if not weak:
        return []
    breaks = [m.start() for m in SCOPE.finditer(text)]
    scope = lambda at: bisect_right(breaks, at)
    role: dict[str, list] = {"ident": [], "secret": [], "endpoint": []}
    for part in strong + weak:
        role[ROLE[part[2]]].append(part)
    whole: list[tuple[int, int, str]] = []
    for own, other in (("ident", "secret"), ("secret", "ident")):
        near = Nearest(role[other], scope)
        whole += [p for p in role[own] if near.meets(p[0], p[1], scope(p[0]), reach)]
    near = Nearest(whole, scope)
    whole += [p for p in role["endpoint"] if near.meets(p[0], p[1], scope(p[0]), reach)]
    return sorted((p for p in whole if p[2] not in STRONG), key=lambda x: x[0])


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _scan(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n = {k: [] for k in STRONG}
                base, spans, links = [], [], []
                for text in batch.column("text").to_pylist():
                    text = text or ""
                    strong = strong_spans(text)
                    extra = linked_spans(text, strong, reach) if strong or KEY.search(text) else []
                    for k in STRONG:
                        n[k].append(sum(x[2] == k for x in strong))
                    base.append(hashlib.sha256(_joined(strong).encode()).hexdigest())
                    spans.append(_joined(sorted(strong + extra, key=lambda x: (x[0], ORDER[x[2]]))))
                    links.append(len(extra))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(n[k], pa.int64()) for k in STRONG), pa.array(base, pa.string()), pa.array(spans, pa.string()), pa.array(links, pa.int64())],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"],
                )

    return run


def scan_secrets(docs: DataFrame, reach: int = 200) -> DataFrame:
    """Per document doc_id, n_assign, n_access, n_hex, base_sha256, spans (``kind:start:end``), n_linked.

    Offsets are code points, end exclusive, of the whole match. Null and empty texts give zero counts and no
    spans; null ids and repeated rows give a row each; other columns are ignored; an empty table gives no rows.
    Very long texts are scanned whole: one pass for each pattern, then the join of the parts found. Spans that start
    together stand in the order assign, access, hex, ident, key, endpoint.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _scan(reach), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    )
