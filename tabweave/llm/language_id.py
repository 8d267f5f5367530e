"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds one bit per language in every slot: an n-gram sets its languages' bits in PROBES slots,
and the AND of those slots is the set of all languages that contain it, found in one lookup for all languages. Each
document's n-grams are looked up, the bits of every language are counted, and the counts are corrected for false
positives: a slice of which a share r of the slots is set answers yes to a share r**PROBES of unknown n-grams. The
largest corrected count decides.

An n-gram is put in for a language if it is common there: at least `share` of its relative frequency in the language
that uses it most, so a language with much training text does not simply know more n-grams.

The filter is learned from a bounded sample of labelled rows (about `per_language` documents of each language, chosen
by a hash of their id; whole texts). An n-gram must occur `least` times in it, or as often as its language has
documents if these are fewer. The filter holds 8 MB for each 64 languages, so more than `most_languages` of them are
refused. Prediction reads whole texts, in one pass without a shuffle.

Defined results: null texts and texts without a letter are `und` with score 0; without any training row all are `und`;
ties go to the language with more training documents, then to the first by name; repeated rows are predicted each; an
empty table gives no rows; other columns are not read, and an id may have any type.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm import arrays as A
from tabweave.llm.shared import bounded_batches, texts_of

PROBES = 2
SIZES = (1, 2, 3, 4)
SLOTS = 1 << 20


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all n-grams, the text of each (ascending), and whether each text has a letter.

    Lower case; every run of other characters than letters is one border mark, and n-grams cross no second border.
    """
    low = [t.lower() for t in texts]
    cps = A.code_points("".join(low))
    doc = A.offsets([len(t) for t in low])
    letter = A.classes()[cps] == A.LETTER
    owner = np.repeat(np.arange(len(texts)), np.diff(doc))
    has = np.bincount(owner[letter], minlength=len(texts)) > 0
    x = np.where(letter, cps, 0).astype(np.uint64)
    keep = letter.copy()
    if len(x):
        keep[1:] |= letter[:-1] & ~letter[1:]  # the first mark after a word
        keep[0] = True
        starts = doc[:-1][doc[:-1] < len(x)]
        keep[starts] = letter[starts]
    x, owner = x[keep], owner[keep]
    keys, owners = [], []
    with np.errstate(over="ignore"):
        for n in SIZES:
            m = len(x) - n + 1
            if m <= 0:
                continue
            k, inner = x[:m].copy(), np.ones(m, bool)
            for j in range(1, n):
                k = k * np.uint64(1 << 21) + x[j : j + m] if j < 3 else A.mix(k) + x[j : j + m]
                if j < n - 1:
                    inner &= x[j : j + m] > 0
            inner &= owner[:m] == owner[n - 1 :]
            if n == 1:
                inner &= x > 0
            keys.append(A.mix(k[inner] + np.uint64(n) * np.uint64(0x9E3779B97F4A7C15)))
            owners.append(owner[:m][inner])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    return np.concatenate(keys), np.concatenate(owners), has


def slots_of(keys: np.ndarray, slots: int) -> list[np.ndarray]:
    return [((keys >> np.uint64(20 * p)) & np.uint64(slots - 1)).astype(np.int64) for p in range(PROBES)]


@dataclass
class LanguageFilter:
    """names: by falling number of training documents; table: slots x words of 64 languages."""

    names: list[str]
    table: np.ndarray

    @classmethod
    def empty(cls, names: list[str], slots: int = SLOTS) -> LanguageFilter:
        return cls(names, np.zeros((slots, max(1, -(-len(names) // 64))), np.uint64))

    def add(self, keys: np.ndarray, language: int) -> None:
        for at in slots_of(keys, len(self.table)):
            self.table[at, language // 64] |= np.uint64(1 << (language % 64))

    def languages_of(self, keys: np.ndarray) -> np.ndarray:
        """For each n-gram the bits of all languages that contain it."""
        found = None
        for at in slots_of(keys, len(self.table)):
            found = self.table[at] if found is None else found & self.table[at]
        return found

    def false_rates(self) -> np.ndarray:
        filled = [np.count_nonzero(self.table[:, k // 64] & np.uint64(1 << (k % 64))) / len(self.table) for k in range(len(self.names))]
        return np.array(filled) ** PROBES

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        keys, owner, has = grams(texts)
        n = len(texts)
        if not self.names:
            return ["und"] * n, np.zeros(n)
        bits, total = self.languages_of(keys), np.bincount(owner, minlength=n)
        counts = np.zeros((n, len(self.names)))
        for k in range(len(self.names)):
            counts[:, k] = np.bincount(owner, weights=(bits[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1), minlength=n)
        wrong = self.false_rates()
        counts = np.maximum((counts - total[:, None] * wrong) / np.maximum(1 - wrong, 1e-9), 0)
        best = counts.argmax(1)
        first = counts[np.arange(n), best]
        second = np.partition(counts, -2, axis=1)[:, -2] if len(self.names) > 1 else np.zeros(n)
        score = np.where(has & (first > 0), first / np.maximum(first + second, 1e-12), 0.0)
        return [self.names[b] if h else "und" for b, h in zip(best.tolist(), has.tolist())], score


def train(rows: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = 1500, share: float = 0.25, least: int = 3, most_languages: int = 1024) -> LanguageFilter:
    """A filter from the labelled rows given; what reaches the driver is bounded by the sample's n-grams."""
    labelled = rows.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    bounded_batches(rows.sparkSession)
    sizes = labelled.groupBy(lang_col).count().limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"{lang_col} has more than {most_languages} values")
    if not sizes:
        return LanguageFilter.empty([])
    sizes = sorted(((r[0], r[1]) for r in sizes), key=lambda x: (-x[1], x[0]))
    names = [s[0] for s in sizes]
    by_name = lambda f, of: F.create_map(*[F.lit(v) for name, n in sizes for v in (name, f(n))])[F.col(of)]
    rate = by_name(lambda n: min(1.0, per_language / n), lang_col)
    chosen = labelled.filter(F.pmod(F.xxhash64(F.lit(17), F.col(id_col).cast("string")), F.lit(1_000_000)) < rate * 1_000_000)

    def count(batches):
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            texts, langs = texts_of(batch, text_col), batch.column(lang_col).to_pylist()
            for lo, hi in A.chunks(texts):
                for lang in set(langs[lo:hi]):
                    keys, _, _ = grams([t for t, g in zip(texts[lo:hi], langs[lo:hi]) if g == lang])
                    k, c = np.unique(keys, return_counts=True)
                    if lang in sums:
                        k, back = np.unique(np.concatenate([sums[lang][0], k]), return_inverse=True)
                        c = np.bincount(back, weights=np.concatenate([sums[lang][1], c])).astype(np.int64)
                    sums[lang] = k, c
        for lang, (k, c) in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(k)), "gram": pa.array(k.view(np.int64)), "n": pa.array(c.astype(np.int64))})

    counted = chosen.select(lang_col, text_col).mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= by_name(lambda n: min(least, n), "lang"))
    table = counted.toArrow()
    lang = np.array(table.column("lang").to_pylist())
    gram, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy().astype(float)
    rates = np.zeros(len(n))
    for name in names:
        own = lang == name
        rates[own] = n[own] / max(n[own].sum(), 1)
    uniq, back = np.unique(gram, return_inverse=True)
    top = np.zeros(len(uniq))
    np.maximum.at(top, back, rates)
    keep = rates >= share * top[back]
    out = LanguageFilter.empty(names)
    for k, name in enumerate(names):
        out.add(gram[keep & (lang == name)], k)
    return out


def predict(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.table))  # 8 MB for up to 64 languages
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = LanguageFilter(*shared.value)
        for batch in batches:
            A.release()
            texts = texts_of(batch, text_col)
            for lo, hi in A.chunks(texts):
                langs, score = own.predict(texts[lo:hi])
                yield pa.RecordBatch.from_pydict({id_col: batch.column(id_col).slice(lo, hi - lo), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(score, pa.float64())})

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
