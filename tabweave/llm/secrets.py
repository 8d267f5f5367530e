"""Secret scans: known shapes by pattern, and unknown ones by sliding-window Shannon entropy.

Patterns find assignments of passwords and keys, access key ids and long hexadecimal strings. Besides, every
candidate string (a long run of key characters), and every long part of it between joiners, is read through a sliding
window for each character class it fits, so a name before a key doesn't hide the key's class:
the window's symbol counts change by one character out and one in, and the sum of c*log2(c) changes with them, so
each step costs two table lookups. Where the entropy reaches the class's bound, the windows unite to a span. The allow
list suppresses candidates that are known to be harmless.

Defined results: null and empty texts have no spans; texts are read whole; equal starts are listed in the order
assign, access, hex, entropy; repeated rows are scanned each; an empty table gives no rows; other columns are not read
(redact() keeps them), and an id may have any type.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.shared import bounded_batches, texts_of

KINDS = ("assign", "access", "hex", "entropy")
#: Patterns of the known shapes (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A run of key characters that may hide a secret.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Its parts between joiners.
PART = re.compile(r"[A-Za-z0-9]{20,}")


@dataclass(frozen=True)
class CharacterClass:
    """symbols: its alphabet; bound: least entropy in bits of a window; mixed: how many of upper, lower, digit it must show."""

    name: str
    symbols: str
    bound: float
    mixed: int


@dataclass(frozen=True)
class SecretRules:
    window: int = 20
    classes: tuple[CharacterClass, ...] = (
        CharacterClass("hex", "0123456789abcdefABCDEF", 3.0, 2),
        CharacterClass("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 3.6, 2),
        CharacterClass("lower36", "abcdefghijklmnopqrstuvwxyz0123456789", 3.6, 2),
        CharacterClass("upper36", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.6, 2),
        CharacterClass("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.8, 3),
    )
    #: Harmless shapes: UUIDs, dates and times, long plain numbers, paths and identifiers in words (fixed values).
    allow: tuple[str, ...] = field(
        default=(
            r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
            r"[0-9]+",
            r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T_-]?[0-9]{2}(?:-?[0-9]{2}){0,2}[0-9]{0,9}Z?)?(?:[/_-]+[A-Z]?[a-z]+)*",
            r"(?:[A-Za-z]+[/_=-]+)+[A-Za-z]*[0-9]{0,4}",
        )
    )


def window_spans(text: str, rules: SecretRules, cls: CharacterClass) -> list[tuple[int, int]]:
    """Spans of text whose windows reach the class's bound; counts are kept incrementally."""
    w, n = rules.window, len(text)
    if n < w:
        return []
    logs = [0.0] + [c * float(np.log2(c)) for c in range(1, w + 1)]
    counts: dict[str, int] = {}
    total, least, out = 0.0, float(np.log2(w)) - cls.bound + 1e-9, []
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += logs[c + 1] - logs[c]
        if i >= w:
            old = text[i - w]
            c = counts[old]
            counts[old] = c - 1
            total += logs[c - 1] - logs[c]
        # entropy = log2(w) - sum(c log2 c) / w
        if i >= w - 1 and total / w <= least:
            s = i - w + 1
            if out and s <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((s, i + 1))
    return out


class Scanner:
    def __init__(self, rules: SecretRules = SecretRules()):
        self.rules = rules
        self.allow = re.compile("|".join(f"(?:{p})" for p in rules.allow))
        self.members = [frozenset(c.symbols) for c in rules.classes]

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, order of kind, end) of the known shapes, sorted."""
        out = []
        low = text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        out.sort()
        return out

    def entropy(self, text: str) -> list[tuple[int, int, int]]:
        """Spans of candidate strings found by their windows' entropy."""
        out = []
        for m in CANDIDATE.finditer(text):
            s = m.group()
            if self.allow.fullmatch(s):
                continue
            found: list[tuple[int, int]] = []
            for at, part in [(0, s), *((p.start(), p.group()) for p in PART.finditer(s) if p.group() != s)]:
                shown = frozenset(part)
                kinds = any(c.isupper() for c in shown) + any(c.islower() for c in shown) + any(c.isdigit() for c in shown)
                if kinds < 2:
                    continue
                for cls, members in zip(self.rules.classes, self.members):
                    if kinds >= cls.mixed and shown <= members:
                        found += [(at + a, at + b) for a, b in window_spans(part, self.rules, cls)]
            found.sort()
            merged: list[list[int]] = []
            for a, b in found:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            out += [(m.start() + a, 3, m.start() + b) for a, b in merged]
        return out

    def scan(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(base spans, all spans)."""
        base = self.base(text)
        return base, sorted(base + self.entropy(text))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_scan(docs: DataFrame, rules: SecretRules = SecretRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy. One pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        scanner = Scanner(rules)
        for batch in batches:
            counts, digests, spans = [[], [], [], []], [], []
            for text in texts_of(batch, text_col):
                base, found = scanner.scan(text)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in found))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(found))
            i64 = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_pydict({id_col: batch.column(id_col), "n_assign": i64(counts[0]), "n_access": i64(counts[1]), "n_hex": i64(counts[2]), "base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string()), "n_entropy": i64(counts[3])})

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_entropy bigint")


def redact(docs: DataFrame, rules: SecretRules = SecretRules(), mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """docs with every span replaced by a mark; all columns stay, and texts without spans are untouched (null too)."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        scanner = Scanner(rules)
        out = []
        for text in texts:
            spans = scanner.scan(text)[1] if text else []
            if spans:
                parts, at = [], 0
                for s, _, e in spans:
                    if s >= at:
                        parts += (text[at:s], mark)
                    at = max(at, e)
                text = "".join((*parts, text[at:]))
            out.append(text)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, clean(F.col(text_col)))
