"""Secrets in text: known shapes, and high entropy in a sliding window.

Candidate strings of at least ``WINDOW`` characters are classed by the characters they use (hexadecimal, letters of both
cases and digits as in base 64, or digits with lower-case letters only as in base 36, or with upper-case letters only as in
base 32).  The classes of one case take the pieces between separators one by one, else every path in words would be one.  A window slides over a candidate; counts of its characters and the sum of
``c log c`` change by two entries a step, so its Shannon entropy costs the same whatever the window.  Candidates whose
best window reaches the class's threshold are reported unless the allow-list knows their form.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from polygate.llm.common import documents, map_batches

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: The kinds whose spans every result digests, in order.
BASE = ("assign", "access", "hex")
WINDOW = 20
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: Bits a character in the best window, by class.
THRESHOLD = {"hex": 3.0, "mixed": 3.9, "lower": 3.4, "upper": 3.3}
_HEX_ONLY = re.compile(r"[0-9a-fA-F]+\Z")
_PIECE = re.compile(r"[A-Za-z0-9]{%d,}" % WINDOW)
_ONE_CASE = {"lower": re.compile(r"(?=[a-z]*[0-9])(?=[0-9]*[a-z])[a-z0-9]+\Z"), "upper": re.compile(r"(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]+\Z")}
_SAMPLE = re.compile(r"(?i).*(?:example|sample|placeholder|your[-_]|xxxx|0123456789)")
_NUMBERED_WORDS = re.compile(r"[0-9]*(?:[a-z]{4,}[0-9]+)*(?:[a-z]{4,})?\Z")
#: Forms that are no secrets: decimals, identifiers in words, padding, UUIDs, sample values.
ALLOW = tuple(re.compile(p) for p in (
    r"[0-9+/_=-]+\Z",
    r"(?:[a-z]+[0-9]{0,4}[-_/=+])*[a-z]+[0-9]{0,4}\Z",
    r"(?:[A-Z][a-z]+)+[0-9]{0,4}\Z",
    r"[A-Z]+(?:[-_/][A-Z0-9]+)*\Z",
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z",
    _SAMPLE.pattern,
))


def _cost(c: int) -> float:
    return c * math.log2(c) if c else 0.0


def window_entropy(s: str, width: int = WINDOW) -> float:
    """The greatest Shannon entropy, in bits a character, of any window of ``width`` characters of ``s``."""
    width = min(width, len(s))
    if not width:
        return 0.0
    counts: dict[str, int] = {}
    total = 0.0  # sum of c log c; entropy = log width - total / width
    for c in s[:width]:
        n = counts.get(c, 0)
        total += _cost(n + 1) - _cost(n)
        counts[c] = n + 1
    least = total
    for i in range(width, len(s)):
        a, b = s[i - width], s[i]
        if a != b:
            n, m = counts[a], counts.get(b, 0)
            total += _cost(n - 1) - _cost(n) + _cost(m + 1) - _cost(m)
            counts[a], counts[b] = n - 1, m + 1
            least = min(least, total)
    return math.log2(width) - least / width


def allowed(s: str) -> bool:
    return any(p.match(s) for p in ALLOW)


def _one_case(s: str) -> bool:
    """Whether a piece of digits and letters of one case looks random."""
    kind = next((k for k, p in _ONE_CASE.items() if p.match(s)), None)
    return kind is not None and not allowed(s) and not _NUMBERED_WORDS.match(s) and window_entropy(s) >= THRESHOLD[kind]


def high_entropy(s: str) -> bool:
    """Whether a candidate string looks random for its class of characters."""
    if not _HEX_ONLY.match(s) and not _SAMPLE.match(s) and any(_one_case(m.group()) for m in _PIECE.finditer(s)):
        return True
    if allowed(s):
        return False
    if _HEX_ONLY.match(s):
        return window_entropy(s) >= THRESHOLD["hex"]
    if not (re.search("[0-9]", s) and re.search("[a-z]", s) and re.search("[A-Z]", s)):
        return False
    return window_entropy(s) >= THRESHOLD["mixed"]


def spans(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all secrets, by start, then kind as listed; starts and ends count code points.

    A high-entropy span is added only where no base span overlaps it.
    """
    text = text or ""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    taken = sorted((a, b) for a, _, b in out)
    extra, k = [], 0
    for m in _CANDIDATE.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if not any(a < m.end() and b > m.start() for a, b in taken[k : k + 3]) and high_entropy(m.group()):
            extra.append((m.start(), 3, m.end()))
    kinds = (*BASE, "entropy")
    return [(a, kinds[k], b) for a, k, b in sorted(out + extra)]


def redact(text: str, found: list[tuple[int, str, int]]) -> str:
    """The text with each secret replaced by its kind in brackets; overlapping spans go together."""
    out, at = [], 0
    for a, kind, b in found:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans, redacted): spans is an array of struct(start, kind, end).

    One row for each row of ``docs`` (doc_id, text), in place, without a shuffle.  A null text has no spans and stays
    null in both text columns; null and repeated ids are kept.  Very long texts are scanned whole, in time linear in their
    length.  An empty table gives an empty one.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        found = [spans(t) for t in texts]
        clean = [redact(t, s) if s else t for t, s in zip(texts, found, strict=True)]
        rows = [[{"start": a, "kind": k, "end": b} for a, k, b in s] for s in found]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(rows, kind), pa.array(clean, pa.string())], names=["doc_id", "text", "spans", "redacted"])

    return map_batches(documents(docs), run, "doc_id long, text string, spans array<struct<start:int,kind:string,end:int>>, redacted string")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in its text column replaced, and n_chars, if there is one, counted anew; other columns stay."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        clean = [redact(t, s) if t and (s := spans(t)) else t for t in texts]
        cols = dict(zip(batch.schema.names, batch.columns, strict=True))
        cols["text"] = pa.array(clean, pa.string())
        if "n_chars" in cols:
            changed = [None if n is None else len(c) if c != t else n for n, c, t in zip(cols["n_chars"].to_pylist(), clean, texts, strict=True)]
            cols["n_chars"] = pa.array(changed, pa.int64())
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return map_batches(docs, run, docs.schema)
