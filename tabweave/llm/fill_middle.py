"""Fill-in-the-middle by a sparse event scan.

One Aho-Corasick automaton holds the ASCII characters that change the class of what follows (the ends of units) and the
sentinels. A text is scanned once for these events alone; between two events lies a gap of one class, whose units are
counted by arithmetic from its length. The running count at each event is all that is needed to find where the k-th unit
ends: a binary search over events, then a division inside the gap. No list of units is made.

Units: "lines" (a line with its end, the last one maybe without), "words" (a run of white space [\\x20\\x09-\\x0D] and the word
after it; white space at the end is a unit of its own) or "characters" (code points).

Two cuts are dealt from sha256 of "<salt>:<id>" (groups of 8 hex digits h1 to h4): the prefix ends after min(h1, h2) mod (n + 1)
units, the middle after the larger, the suffix is the rest. h3 decides by `rate` whether a text is transformed, h4 by
`spm_rate` its form.

Defined results: null counts as the empty text, which stays plain, as does a text that holds a sentinel; a null id is an
empty one in the hash; repeated rows give repeated rows; texts of any length are scanned whole, batches are bounded; an
empty table gives no rows; columns other than id and text are not read, whatever their names. Map-only: nothing is shuffled.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.shared import bounded_batches, texts_of

SENTINELS = ("<P>", "<S>", "<M>")
#: White space that ends a word, and what ends a line (fixed values).
CHANGES = {"lines": "\n", "words": "\t\n\x0b\x0c\r ", "characters": ""}
SENTINEL = -1


class EventScan:
    """The automaton of one kind of unit, with the sentinels."""

    def __init__(self, unit: str = "lines", sentinels: tuple[str, ...] = SENTINELS):
        if unit not in CHANGES:
            raise ValueError(f"no such unit: {unit}")
        self.unit, self.sentinels = unit, sentinels
        self.machine = ahocorasick.Automaton()
        for c in CHANGES[unit]:
            self.machine.add_word(c, (1, 0))
        for k, s in enumerate(sentinels):
            self.machine.add_word(s, (len(s), SENTINEL - k))
        self.machine.make_automaton()

    def events(self, text: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Ends of the class changes, and the sentinels as (start, which), both in the order of the text."""
        ends, marks = [], []
        for last, (length, kind) in self.machine.iter(text):
            if kind < 0:
                marks.append((last + 1 - length, SENTINEL - kind))
            else:
                ends.append(last + 1)
        return np.array(ends, np.int64), marks


class UnitRanks:
    """How many units end in each gap and with each event, as running counts, and where the k-th unit ends.

    A gap of g characters holds g units of characters, one word if g > 0, and no line's end; an event ends a line.
    What is left after the last event is one more line, or white space after the last word.
    """

    def __init__(self, unit: str, ends: np.ndarray, length: int):
        self.length, self.starts = length, np.append(0, ends)
        gaps = np.append(ends - 1, length) - self.starts
        inside = {"lines": np.zeros_like(gaps), "words": (gaps > 0).astype(np.int64), "characters": gaps}[unit]
        self.by_event = unit == "lines"
        self.gap_ends = self.starts + gaps
        self.done = np.cumsum(inside + (np.arange(len(gaps)) < len(ends) if self.by_event else 0))
        self.rate_one = unit == "characters"
        rest = int(gaps[-1]) if self.by_event else int(length > 0 and gaps[-1] == 0 and unit == "words")
        self.count = int(self.done[-1]) + bool(rest)

    def end_of(self, k: int) -> int:
        """Where the first k units end."""
        if k <= 0:
            return 0
        if k >= self.count:
            return self.length
        at = int(np.searchsorted(self.done, k))
        if self.by_event:
            return int(self.gap_ends[at]) + 1
        if self.rate_one:
            return int(self.gap_ends[at]) - (int(self.done[at]) - k)
        return int(self.gap_ends[at])


class FillMiddle:
    """Cuts, joins and restores texts of one setting."""

    def __init__(self, unit: str = "lines", salt: str = "7", rate: int = 100, spm_rate: int = 50, sentinels: tuple[str, str, str] = SENTINELS):
        self.unit, self.salt, self.rate, self.spm_rate, self.sentinels = unit, salt, rate, spm_rate, sentinels
        self.scan = EventScan(unit, sentinels)

    def transform(self, text: str, key: object) -> tuple[int, str, int | None, int | None, str]:
        """(units, form, characters of the prefix, of the middle, output)."""
        ends, marks = self.scan.events(text)
        ranks = UnitRanks(self.unit, ends, len(text))
        n, digest = ranks.count, hashlib.sha256(f"{self.salt}:{'' if key is None else key}".encode()).hexdigest()
        h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
        if not text or marks or h[2] % 100 >= self.rate:
            return n, "plain", None, None, text
        a, b = (ranks.end_of(x) for x in sorted((h[0] % (n + 1), h[1] % (n + 1))))
        p, s, m = self.sentinels
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h[3] % 100 < self.spm_rate:
            return n, "spm", a, b - a, "".join((s, suffix, p, prefix, m, middle))
        return n, "psm", a, b - a, "".join((p, prefix, s, suffix, m, middle))

    def restore(self, output: str, form: str) -> str:
        """The exact text of an output: its sentinels, found by the same scan, bound the pieces."""
        if form == "plain":
            return output
        _, marks = self.scan.events(output)
        pieces = [""] * 3
        for (at, which), end in zip(marks, [m[0] for m in marks[1:]] + [len(output)]):
            pieces[which] = output[at + len(self.sentinels[which]) : end]
        prefix, suffix, middle = pieces
        return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, **setting) -> DataFrame:
    """One row per row of docs: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, and with
    `texts` the output itself. setting: unit, salt, rate, spm_rate, sentinels of FillMiddle."""
    bounded_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    FillMiddle(**setting)  # a wrong setting fails here, not in a task

    def run(batches):
        own = FillMiddle(**setting)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        for batch in batches:
            rows = [(own.transform(t, key)) for t, key in zip(texts_of(batch), batch.column("doc_id").to_pylist())]
            n, form, before, middle, out = zip(*rows) if rows else ([],) * 5
            cols = {
                "doc_id": batch.column("doc_id"),
                "n": pa.array(n, pa.int64()),
                "form": pa.array(form, pa.string()),
                "prefix_chars": pa.array(before, pa.int64()),
                "middle_chars": pa.array(middle, pa.int64()),
                "output_sha256": pa.array([sha(t) for t in out], pa.string()),
                "restored_sha256": pa.array([sha(own.restore(t, f)) for t, f in zip(out, form)], pa.string()),
            }
            if texts:
                cols["output"] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    schema = f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
    return chosen.mapInArrow(run, schema + (", output string" if texts else ""))
