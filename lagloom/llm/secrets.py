"""Secret scans with multipart credential linking.

Strong patterns are reported wherever they stand: assignments to a secret's name, access identifiers, and long
hexadecimal runs. Weak candidates (an account name, a random-looking string, an endpoint) mean little alone. They are
joined as intervals within their scope, a paragraph and ``radius`` characters around them, and reported only where
complementary parts meet: an identifier with a secret, a secret with an identifier, an endpoint with both. A document
is one row, so the interval join is a merge of sorted intervals inside the task and needs no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm.arrow import Columns, map_columns, map_text

KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")

_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_WEAK_ID = re.compile(r"""(?ai:(?:access|client|account|user|login|key)[_-]?(?:key[_-]?)?(?:id|name))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{4,})|AKIA[A-Z0-9]{8,}""")
_WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])")
_WEAK_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key|credential)["']?\x20*[:=]\x20*["']?([^\s"']{6,})""")
_ENDPOINT = re.compile(r"""[a-z][a-z0-9+]{2,9}://[^\s"'<>]{4,}|(?ai:(?:host|endpoint|server|url))["']?\x20*[:=]\x20*["']?([A-Za-z0-9.-]+\.[A-Za-z]{2,}[^\s"'<>]*)""")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n")

Span = tuple[int, int, int]  # start, place of its kind in KINDS, end


def base_spans(text: str) -> list[Span]:
    """The strong spans: leftmost and non-overlapping per kind, too short matches dropped afterwards."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # Runs of [0-9a-f] are disjoint and maximal, so those of 16 and more are found without the shorter ones.
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _random_looking(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s) and len(set(s)) >= 10


def linked_spans(text: str, base: list[Span], radius: int = 300) -> list[Span]:
    """The weak spans that meet complementary parts in their scope; none overlaps a strong span."""
    ids = [(m.start(), m.end()) for m in _WEAK_ID.finditer(text)]
    if not ids and not any(k == 1 for _, k, _ in base):
        return []
    secrets = [(m.start(), m.end()) for m in _WEAK_ASSIGN.finditer(text)]
    secrets += [(m.start(), m.end()) for m in _WEAK_SECRET.finditer(text) if _random_looking(m[0])]
    if not secrets and not any(k != 1 for _, k, _ in base):
        return []
    ends = [(m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    breaks = [m.start() for m in _PARAGRAPH.finditer(text)]
    # Strong spans of different kinds may overlap or hold each other: merged, only the last that begins before a weak
    # span's end can reach into it.
    strong: list[list[int]] = []
    for s, _, e in sorted(base):
        if strong and s <= strong[-1][1]:
            strong[-1][1] = max(strong[-1][1], e)
        else:
            strong.append([s, e])
    starts = [s for s, _ in strong]

    def free(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        kept, last = [], -1
        for s, e in sorted(spans):
            i = bisect_left(starts, e)
            if s >= last and not (i and strong[i - 1][1] > s):
                kept.append((s, e))
                last = e
        return kept

    ids, secrets, ends = free(ids), free(secrets), free(ends)
    all_ids = sorted(ids + [(s, e) for s, k, e in base if k == 1])
    all_secrets = sorted(secrets + [(s, e) for s, k, e in base if k != 1])

    def near(span: tuple[int, int], parts: list[tuple[int, int]]) -> bool:
        at = bisect_right(breaks, span[0])
        low = max(span[0] - radius, breaks[at - 1] if at else 0)
        high = min(span[1] + radius, breaks[at] if at < len(breaks) else len(text))
        i = bisect_left(parts, (low, -1))
        while i < len(parts) and parts[i][0] < high:
            if parts[i][1] <= high and (parts[i][1] <= span[0] or parts[i][0] >= span[1]):
                return True
            i += 1
        return False

    out = [(s, 3, e) for s, e in ids if near((s, e), all_secrets)]
    out += [(s, 4, e) for s, e in secrets if near((s, e), all_ids)]
    out += [(s, 5, e) for s, e in ends if near((s, e), all_ids) and near((s, e), all_secrets)]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """``text`` with each span, or run of overlapping spans, replaced by ``mark``."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, _, e in sorted(spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, radius: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Places are code points, ends exclusive. A null text is empty: no spans, the digest of the empty string. Null ids
    and repeated rows are kept as they are; an empty table gives no rows; other columns of ``docs`` are not read.
    """

    def make():
        def scan(c: Columns) -> Columns:
            out: Columns = {"doc_id": c["doc_id"], "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
            for text in c["text"]:
                base = base_spans(text or "")
                kinds = [k for _, k, _ in base]
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(kinds.count(k))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(base + linked_spans(text or "", base, radius)))
            return out

        return scan

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_columns(texts, make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, radius: int = 300, mark: str = "[SECRET]", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with every span of ``scan_secrets`` replaced by ``mark``; all rows and columns stay.

    ``chars_col``, where there is one, follows the new length. Null texts stay null.
    """

    def make():
        def redact(texts: list) -> list:
            out = []
            for text in texts:
                base = base_spans(text or "")
                spans = base + linked_spans(text or "", base, radius)
                out.append(redacted(text, spans, mark) if spans else text)
            return out

        return redact

    return map_text(docs, make, text_col, chars_col)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
