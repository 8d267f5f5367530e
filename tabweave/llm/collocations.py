"""Phrase collocation mining with position bitmaps, in the manner of SPAM.

A shard is a bounded run of one language's texts. Its words stand at positions, with a blank position between pieces, so
that no phrase crosses one. Every word has a bitmap of its positions, compressed: words of at least one position in 64 as
machine words of bits, all others as their sorted positions. A phrase's bitmap holds where its last word stands; it is
extended by one word by shifting the bitmap and a logical AND with that word's, and the popcount is the phrase's count in the shard.
Dense phrases are extended depth-first, bitmap by bitmap; bitmaps of positions are ANDed with those of all words at once,
since every position is in the bitmap of one word.

Counts of shards are summed by Spark, level by level: a phrase can only reach `least` if the phrases without its first and
without its last word do, and Bloom filters of bounded size over the frequent phrases of the level before prune the
extension in every shard (what they let through by mistake is counted exactly and falls). Scores, the removal of phrases inside longer ones and the ranks
are DataFrame operations with decimals of 38 digits.

Defined results: null counts as the empty text, a null language as `und`; repeated rows count each; an empty table gives no
rows; texts of any length are read whole, in slices that end between pieces (a piece of more than a slice is read whole);
columns other than text and lang are not read, whatever their names; ties of score go to the higher count, then to the
lesser phrase.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.llm.arrays import mix, ragged, release, segment_hashes
from tabweave.llm.bloom import BloomFilter
from tabweave.llm.shared import bounded_batches, stored
from tabweave.llm.wordbytes import byte_table, word_slices

#: White space between words, and what ends a piece (fixed values).
GAP, BREAK = " \t", ".,;:!?\n\x0b\x0c\r"
SCALE = 1_000_000
SHARD_BYTES = 2_000_000
SALTS = 256


class PositionBitmaps:
    """The compressed bitmaps of a shard. at: the word (a number) at each position, -1 at blanks, which also end it."""

    def __init__(self, at: np.ndarray, words: int):
        self.at, self.words, self.n = at, words, len(at)
        counts = np.bincount(at[at >= 0], minlength=words)
        self.dense = np.flatnonzero(counts * 64 >= max(1, self.n))
        is_dense = np.zeros(words + 1, bool)
        is_dense[self.dense] = True
        sparse = np.flatnonzero((at >= 0) & ~is_dense[at])
        self.sparse = sparse[np.argsort(at[sparse], kind="stable")]
        self.bits = {int(w): self.pack(np.flatnonzero(at == w)) for w in self.dense}

    def pack(self, positions: np.ndarray) -> np.ndarray:
        flags = np.zeros((self.n + 64) // 64 * 64, bool)
        flags[positions] = True
        return np.packbits(flags, bitorder="little").view(np.uint64)

    def unpack(self, bits: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))

    @staticmethod
    def shift(bits: np.ndarray) -> np.ndarray:
        """Every position moved on by one."""
        out = bits << np.uint64(1)
        out[1:] |= bits[:-1] >> np.uint64(63)
        return out

    def phrases(self, length: int, allowed) -> list[tuple[np.ndarray, np.ndarray]]:
        """[(phrases as rows of words, counts)] of this length. allowed(rows of words) says which phrases may be frequent;
        it is asked for every shorter one that is extended, and for the last words of each phrase found."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if self.n:
            everywhere = [np.array([[w]]) for w in self.dense]
            for start in everywhere:
                self._extend_dense(start, self.bits[int(start[0, 0])], length, allowed, found)
            words = self.at[self.sparse]
            first = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else words
            self._extend_sparse(words[first][:, None], self.sparse, np.diff(np.append(first, len(words))), length, allowed, found)
        return found

    def _extend_dense(self, phrase: np.ndarray, bits: np.ndarray, length: int, allowed, found: list) -> None:
        if phrase.shape[1] == length:
            found.append((phrase, np.array([int(np.bitwise_count(bits).sum())])))
            return
        moved, last = self.shift(bits), phrase.shape[1] + 1 == length
        for w in self.dense:
            longer = np.append(phrase, [[w]], 1)
            if not (self._ends_fit(longer, allowed) if last else allowed(longer))[0]:
                continue
            both = moved & self.bits[int(w)]
            count = int(np.bitwise_count(both).sum())
            if count * 64 >= self.n or (count and last):
                self._extend_dense(longer, both, length, allowed, found)
            elif count:
                self._extend_sparse(longer, self.unpack(both), np.array([count]), length, allowed, found)
        # the sparse words' positions that the shifted bitmap holds
        hit = self.sparse[(moved[self.sparse >> 6] >> (self.sparse & 63).astype(np.uint64)) & np.uint64(1) != 0]
        if len(hit):
            words = self.at[hit]
            first = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
            longer = np.concatenate([np.repeat(phrase, len(first), 0), words[first][:, None]], 1)
            self._go_on(longer, hit, np.diff(np.append(first, len(hit))), length, allowed, found)

    def _extend_sparse(self, phrases: np.ndarray, positions: np.ndarray, counts: np.ndarray, length: int, allowed, found: list) -> None:
        """phrases: rows of words; positions: of each in turn, `counts` of them."""
        if not len(phrases):
            return
        if phrases.shape[1] == length:
            found.append((phrases, counts))
            return
        moved = positions + 1
        of = np.repeat(np.arange(len(phrases)), counts)
        word = self.at[moved]
        stays = word >= 0
        moved, of, word = moved[stays], of[stays], word[stays]
        order = np.argsort(of * np.int64(self.words) + word, kind="stable")
        moved, of, word = moved[order], of[order], word[order]
        if len(of):
            first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (word[1:] != word[:-1])))
            self._go_on(np.concatenate([phrases[of[first]], word[first][:, None]], 1), moved, np.diff(np.append(first, len(of))), length, allowed, found)

    def _go_on(self, phrases: np.ndarray, positions: np.ndarray, counts: np.ndarray, length: int, allowed, found: list) -> None:
        fit = self._ends_fit(phrases, allowed) if phrases.shape[1] == length else allowed(phrases)
        if not fit.all():
            starts = np.cumsum(counts) - counts
            positions = positions[ragged(starts[fit], counts[fit])]
            phrases, counts = phrases[fit], counts[fit]
        self._extend_sparse(phrases, positions, counts, length, allowed, found)

    @staticmethod
    def _ends_fit(phrases: np.ndarray, allowed) -> np.ndarray:
        return allowed(phrases[:, 1:]) if phrases.shape[1] > 2 else np.ones(len(phrases), bool)


def phrase_keys(phrases: np.ndarray, word_hashes: np.ndarray, lang: str) -> np.ndarray:
    """A 64-bit key of each phrase in its language."""
    raw = np.frombuffer(lang.encode() or b"\0", np.uint8)
    key = np.repeat(segment_hashes(raw, np.array([0]), np.array([len(raw)])), len(phrases))
    with np.errstate(over="ignore"):
        for column in phrases.T:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + word_hashes[column])
    return key.view(np.int64)


def _shards(batches, most: int):
    """(lang, texts) of about `most` bytes of one language. The least full of many languages' shards stay small."""
    held: dict[str, list] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        langs = pc.fill_null(batch.column("lang"), "und")
        texts = batch.column("text").cast(pa.large_string())
        for lang in langs.unique().to_pylist():
            own = texts.filter(pc.equal(langs, lang))
            held.setdefault(lang, []).append(own)
            sizes[lang] = sizes.get(lang, 0) + own.nbytes
            if sizes[lang] >= most:
                yield lang, pa.concat_arrays(held.pop(lang))
                del sizes[lang]
        if sum(sizes.values()) >= 4 * most:
            lang = max(sizes, key=sizes.get)
            del sizes[lang]
            yield lang, pa.concat_arrays(held.pop(lang))
    for lang, own in held.items():
        yield lang, pa.concat_arrays(own)


def _counts(docs: DataFrame, length: int, filters: dict[int, BloomFilter], shard_bytes: int) -> DataFrame:
    """Counts of the phrases of `length` words in each shard: lang, phrase, n; at length 1 also a row without phrase,
    the number of all words."""
    tests = {k: f.tester() for k, f in filters.items()}
    gap, cut = byte_table(GAP), byte_table(BREAK)

    def run(batches):
        for lang, texts in _shards(batches, shard_bytes):
            for words, _ in word_slices(texts, gap, cut, lower=True, most=shard_bytes):
                if not len(words):
                    continue
                coded = words.strings().dictionary_encode()
                names = coded.dictionary
                ids = coded.indices.to_numpy().astype(np.int64)
                ends = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
                hashes = segment_hashes(np.frombuffer(names.buffers()[2], np.uint8), ends[:-1], ends[1:])
                if length == 1:
                    counts, phrases = np.bincount(ids, minlength=len(names)), np.arange(len(names))[:, None]
                    text = names
                else:
                    may = tests[1](phrase_keys(np.arange(len(names))[:, None], hashes, lang))
                    at = np.full(len(ids) + int(words.broken.sum()) + 1, -1, np.int64)
                    at[np.arange(len(ids)) + np.cumsum(words.broken)] = np.where(may[ids], ids, -1)
                    allowed = lambda p: tests[p.shape[1]](phrase_keys(p, hashes, lang))
                    found = PositionBitmaps(at, len(names)).phrases(length, allowed)
                    phrases = np.concatenate([p for p, _ in found]) if found else np.zeros((0, length), np.int64)
                    counts = np.concatenate([c for _, c in found]) if found else np.zeros(0, np.int64)
                    text = pc.binary_join_element_wise(*[names.take(pa.array(phrases[:, k])) for k in range(length)], pa.scalar(" ", pa.large_string()))
                out = pa.table({"lang": pa.array([lang] * len(counts), pa.string()), "phrase": text.cast(pa.string()), "n": pa.array(counts, pa.int64())})
                yield from out.to_batches(max_chunksize=20_000)
                if length == 1:
                    yield pa.RecordBatch.from_pydict({"lang": [lang], "phrase": pa.array([None], pa.string()), "n": pa.array([len(ids)], pa.int64())})
        release()

    return docs.mapInArrow(run, "lang string, phrase string, n bigint")


def _keyed(level: DataFrame, length: int) -> DataFrame:
    """The keys of a level's phrases."""

    def run(batches):
        for b in batches:
            words = pc.split_pattern(b.column("phrase").cast(pa.large_string()), " ").flatten()
            ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
            hashes = segment_hashes(np.frombuffer(words.buffers()[2], np.uint8), ends[:-1], ends[1:]) if len(words) else np.zeros(0, np.uint64)
            phrases, key = np.arange(len(words)).reshape(-1, length), np.zeros(b.num_rows, np.int64)
            for lang in b.column("lang").unique().to_pylist():
                own = pc.equal(b.column("lang"), lang).to_numpy(zero_copy_only=False)
                key[own] = phrase_keys(phrases[own], hashes, lang)
            yield pa.RecordBatch.from_pydict({"key": pa.array(key)})

    return level.select("lang", "phrase").mapInArrow(run, "key bigint")


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, longest: int = 3, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(phrases of 1 to `longest` words with a count of `least` or more: lang, phrase, words, f; all words of each
    language: lang, n). Stored."""
    bounded_batches(docs.sparkSession)
    chosen = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    levels, filters, totals = [], {}, None
    for length in range(1, longest + 1):
        summed = _counts(chosen, length, filters, shard_bytes).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        level = stored(summed.filter((F.col("f") >= least) | F.col("phrase").isNull()), f"phrases{length}")
        if length == 1:
            totals = level.filter("phrase is null").select("lang", F.col("f").alias("n"))
            level = level.filter("phrase is not null")
        levels.append(level.select("lang", "phrase", F.lit(length).alias("words"), "f"))
        if length < longest:
            # stored, so that no task needs a second Python worker beside that of the filter
            filters[length] = BloomFilter(stored(_keyed(level, length), "phrase-keys"), "key", level.count())
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, longest: int = 3, inside: int = 50, top: int = 2000, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The first `top` phrases of 2 to `longest` words of each language: lang, rank, phrase, a, l, r, n, score. A phrase inside a
    longer one of at least `inside` percent of its count is left out."""
    phrases, totals = frequent_phrases(docs, lang_col, text_col, least, longest, shard_bytes)
    parts = F.split("phrase", " ")
    some = lambda begin, n: F.array_join(F.slice(parts, begin, n), " ")
    candidates = phrases.filter("words > 1")
    # every cut: the parts' counts by two joins, since a part of a frequent phrase is frequent
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select("lang", "phrase", "words", F.col("f").alias("a"), "k", some(F.lit(1), F.col("k")).alias("left"), some(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    left = phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("top", (F.lit(SCALE).cast("decimal(7,0)") * wide("a")).cast("decimal(38,0)") * wide("a")).withColumn("under", (wide("l") * wide("r")).cast("decimal(38,0)"))
    scored = scored.withColumn("score", F.expr("cast(top as decimal(38,0)) div under"))
    best = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "words", "a", "cut.score", "cut.l", "cut.r")
    # a longer phrase of any length counts through the one of one word more inside it, whose count is no less
    held = candidates.filter("words > 2").select("lang", F.explode(F.array(some(F.lit(1), F.col("words") - 1), some(F.lit(2), F.col("words") - 1))).alias("phrase"), "f")
    most = held.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    alone = best.join(most, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.lit(100).cast("decimal(3,0)") * wide("longer") < F.lit(inside).cast("decimal(3,0)") * wide("a")))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # first by salt, so that no task ranks a whole language
    salted = alone.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
