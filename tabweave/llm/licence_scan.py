"""Licence scans: Dice coefficient over word bigrams against licence templates.

Texts are normalised to lower-case runs of letters and digits. For each template the scan looks for the window of a
text's words whose multiset of bigrams has the largest Dice coefficient with the template's. A window of m bigrams can
reach the bound t against a template of n only if n*t/(2-t) <= m <= n*(2-t)/t, and must then share at least n*t/(2-t)
bigrams with it; where no window of that size holds so many of the template's bigrams, the template is pruned without
any comparison. Windows that pass are grown bigram by bigram with incremental counts.

Defined results: null and empty texts have no licence; of overlapping windows the one with the larger Dice stays, then
the longer, then the first by name of licence; texts are read whole; repeated rows are scanned each; an empty table gives
no rows; other columns are not read, and an id may have any type. No shuffle.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabweave.llm import arrays as A
from tabweave.llm.licence_templates import TEMPLATES
from tabweave.llm.shared import bounded_batches, texts_of


def bigrams(texts: list[str]):
    """(hashes of bigrams, first and last character of each, how many each text has), over normalised words."""
    low = [t.lower() if len(t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts]
    cps = A.code_points("".join(low))
    doc = A.offsets([len(t) for t in low])
    if not len(cps):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    solid = A.classes()[cps] <= A.NUMBER
    first = np.flatnonzero(A.run_starts(solid, doc))
    ends = np.append(first[1:], len(cps))
    keep = solid[first]
    first, ends = first[keep], ends[keep]
    owner = np.searchsorted(doc, first, side="right") - 1
    words = A.segment_hashes(cps, first, ends)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    with np.errstate(over="ignore"):
        pairs = A.mix(words[inner] * np.uint64(0x9E3779B97F4A7C15) + words[inner + 1])
    own = owner[inner]
    return pairs, first[inner] - doc[own], ends[inner + 1] - doc[own], np.bincount(own, minlength=len(texts))


class LicenceScanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, similarity: float = 0.8):
        self.bound = similarity
        self.names, self.counts = [], []
        for name, texts in templates.items():
            for t in texts:
                pairs = bigrams([t])[0].tolist()
                if pairs:
                    self.names.append(name)
                    self.counts.append(Counter(pairs))
        self.sizes = [sum(c.values()) for c in self.counts]
        self.keys = np.array(sorted({k for c in self.counts for k in c}), np.uint64)
        self.member = np.array([[int(k) in c for k in self.keys.tolist()] for c in self.counts], bool)

    def best_window(self, at: np.ndarray, keys: list[int], t: int) -> list[tuple[float, int, int]]:
        """Windows (Dice, first and last bigram) from each start that can reach the bound; at: places of the template's bigrams."""
        n, bound = self.sizes[t], self.bound
        need = int(np.ceil(n * bound / (2 - bound) - 1e-9))
        most = int(n * (2 - bound) / bound + 1e-9)
        if len(at) < need:
            return []
        starts = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < most)
        out, places = [], at.tolist()
        for s in starts.tolist():
            left, shared, best = dict(self.counts[t]), 0, (0.0, 0, 0)
            for e in range(s, len(places)):
                m = places[e] - places[s] + 1
                if m > most:
                    break
                k = keys[e]
                if left[k] > 0:
                    left[k] -= 1
                    shared += 1
                    dice = 2 * shared / (m + n)
                    if dice > best[0]:
                        best = (dice, places[s], places[e])
            if best[0] >= bound:
                out.append(best)
        return out

    def scan(self, texts: list[str]) -> list[list[tuple[str, float, int, int]]]:
        """For each text its matches (licence, Dice, start, end in characters), in text order."""
        pairs, begin, end, counts = bigrams(texts)
        out: list[list[tuple[str, float, int, int]]] = [[] for _ in texts]
        where = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        hits = np.flatnonzero(self.keys[where] == pairs)
        if not len(hits):
            return out
        bounds = A.offsets(counts)
        owner = np.searchsorted(bounds, hits, side="right") - 1
        split = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        for lo, hi in zip(split.tolist(), [*split[1:].tolist(), len(hits)]):
            k, own = int(owner[lo]), hits[lo:hi]
            found = []
            for t in range(len(self.names)):
                if hi - lo < self.sizes[t] * self.bound / (2 - self.bound) - 1e-9:
                    continue
                mine = own[self.member[t][where[own]]]
                found += [(-d, s - e, self.names[t], s, e) for d, s, e in self.best_window(mine, pairs[mine].tolist(), t)]
            taken: list[tuple[int, int]] = []
            for d, _, name, s, e in sorted(found):
                if all(e < a or s > b for a, b in taken):
                    taken.append((s, e))
                    out[k].append((name, -d, int(begin[s]), int(end[e])))
            out[k].sort(key=lambda x: x[2])
        return out


def licence_scan(docs: DataFrame, similarity: float = 0.8, templates: dict[str, list[str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_matches, licence (of the best match, else null), dice, matches (name:start:end, comma-joined)."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        scanner = LicenceScanner(templates, similarity)
        for batch in batches:
            texts = texts_of(batch, text_col)
            for lo, hi in A.chunks(texts):
                found = scanner.scan(texts[lo:hi])
                best = [min(f, key=lambda x: (-x[1], x[0]), default=(None, None)) for f in found]
                yield pa.RecordBatch.from_pydict(
                    {
                        id_col: batch.column(id_col).slice(lo, hi - lo),
                        "n_matches": pa.array([len(f) for f in found], pa.int64()),
                        "licence": pa.array([b[0] for b in best], pa.string()),
                        "dice": pa.array([b[1] for b in best], pa.float64()),
                        "matches": pa.array([",".join(f"{n}:{s}:{e}" for n, _, s, e in f) for f in found], pa.string()),
                    }
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_matches bigint, licence string, dice double, matches string")
