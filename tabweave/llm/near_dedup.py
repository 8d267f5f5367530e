"""Near-duplicate detection by Order MinHash, verified by banded alignment.

A text's k-mers are its runs of k words (lower case), each labelled with the number of its occurrence. An order of
Order MinHash picks the `several` least labelled k-mers by a hash, keeps them in text order, and makes them one key; so
two texts share a key with a probability that follows their edit similarity. Texts that share a key are candidates.
- `sketches` orders take two k-mers of five words each.
- Five-word k-mers break under scattered edits, so further orders take k-mers of one word each, still in text order:
  six of them from texts of `long_words` words or more, four from shorter ones (long texts have more words in common
  by chance). Whichever words were edited, a pair at the bound of the links keeps at least 0.8 of the longer text's
  words in order, so it shares such a key with a probability of about (2/3)^6 or (2/3)^4 in each of these orders. Texts
  near `long_words` have the keys of both kinds, so pairs across it share one too.
- A text that may differ in at most two words has a key for each way to delete that many: near pairs of such texts
  always share one.

A candidate pair is a link if 1 - edit distance / longer length, over words, is at least `similarity`: a banded
alignment, done for many pairs at once with a band that widens until it proves the distance or exceeds the limit.
Lengths, binned word counts, and bags of words and of word pairs give exact lower bounds of the distance; pairs that
they settle are not aligned, and the first two settle pairs before any text is moved to them.

Copies with equal words are one node from the start. Links are found in two rounds, so that a bucket of near copies of
any size makes one candidate per member, not all pairs:
1. every member of a bucket against the bucket's first node; linked nodes form components;
2. in buckets that still hold several components, pairs of different components are tested inside tasks, which emit
   links alone and skip pairs already joined. A bucket of more than `block` members or `block_words` words is dealt to
   blocks: by length, by component where one holds much of the bucket, then by hash. Two blocks meet in a task unless
   their lengths allow no link or both belong to one component. Members without any partner that the bounds allow are
   dropped before their texts are fetched.
Together the rounds test or join every pair of every bucket: no bucket is capped.

Defined results: null counts as the empty text, and all empty texts are one class; texts of fewer words than a k-mer
have one k-mer of all of them; of each class the row of the smallest id stays, and one of them if several rows have that
id; a row without an id stays only if its class has no id at all; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm import arrays as A
from tabweave.llm.bloom import BloomFilter
from tabweave.llm.components import components
from tabweave.llm.shared import bounded_batches, discard, fresh, release_shuffles, stored, texts_of

#: Columns of one slice of a block's table of flags.
SLICE = 1 << 13


@dataclass(frozen=True)
class NearParams:
    words: int = 5
    sketches: int = 8
    several: int = 2
    long_words: int = 100
    long_sketches: int = 56
    long_several: int = 6
    short_sketches: int = 40
    short_several: int = 4
    similarity: float = 0.8
    block: int = 1024
    block_words: int = 2_000_000
    deletions: int = 2


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, lower case, and how many each text has."""
    low = [t.lower() for t in texts]
    cps = A.code_points("".join(low))
    starts, ends, counts = A.words(cps, A.offsets([len(t) for t in low]))
    return A.segment_hashes(cps, starts, ends), counts


def order_min_hash(w: np.ndarray, counts: np.ndarray, words: int, sketches: int, several: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (texts with words x sketches), and which texts they are of."""
    with np.errstate(over="ignore"):
        bounds = A.offsets(counts)
        owner = np.repeat(np.arange(len(counts)), counts)
        n, grams = len(w), w.copy()
        for j in range(1, words):
            shifted = np.zeros(n, np.uint64)
            inside = np.arange(n - j)[owner[j:] == owner[: n - j]] if n > j else np.zeros(0, np.int64)
            shifted[inside] = w[inside + j]
            grams = A.mix(grams * np.uint64(0x9E3779B97F4A7C15) + shifted)
        per = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
        if words > 1:
            where = A.ragged(bounds[:-1], per)
            grams, owner = grams[where], owner[where]
        has = np.flatnonzero(per)
        if not len(has):
            return np.zeros((0, sketches), np.uint64), has
        return least_keys(labelled(grams, owner), A.offsets(per)[:-1][has], sketches, several, words), has


def labelled(grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes of k-mers with their occurrence: the place of a k-mer among its equals in the text."""
    bits = max(1, int(len(grams)).bit_length())
    low = np.uint64((1 << bits) - 1)
    mixed = A.mix(grams + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    mixed = np.sort((mixed & ~low) | np.arange(len(grams), dtype=np.uint64))  # by k-mer, then by place
    order = (mixed & low).astype(np.int64)
    mixed >>= np.uint64(bits)
    new = np.append(True, mixed[1:] != mixed[:-1])
    first = np.flatnonzero(new)
    rank = np.empty(len(grams), np.uint64)
    rank[order] = (np.arange(len(grams)) - first[np.cumsum(new) - 1]).astype(np.uint64)
    return A.mix(grams + rank * np.uint64(0xA24BAED4963EE407))


def least_keys(label: np.ndarray, begin: np.ndarray, orders: int, several: int, kind: int) -> np.ndarray:
    """One key per text (they begin at `begin`) and hash order, of its `several` least labels in text order."""
    low = np.uint64((1 << max(1, int(len(label)).bit_length())) - 1)
    at = np.arange(len(label), dtype=np.uint64)
    keys = np.empty((len(begin), orders), np.uint64)
    for s in range(orders):
        h = label * np.uint64(((2 * s + 1) * 0x9FB21C651E98DF25 + 2 * kind * 0xA24BAED4963EE407) & (1 << 64) - 1 | 1)
        h &= ~low
        h |= at
        picked = []
        for _ in range(several):
            least = (np.minimum.reduceat(h, begin) & low).astype(np.int64)
            picked.append(least)
            h[least] = np.uint64(0xFFFFFFFFFFFFFFFF) & ~low | at[least]
        key = np.full(len(begin), (kind << 32) + s, np.uint64)
        for row in label[np.sort(np.stack(picked), axis=0)]:  # a short text repeats its own
            key = A.mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
        keys[:, s] = key
    return keys


def key_lists(w: np.ndarray, counts: np.ndarray, p: NearParams) -> pa.ListArray:
    """All keys of each text."""
    bounds, owners, found = A.offsets(counts), [], []

    def add(which: np.ndarray, words: int, sketches: int, several: int) -> None:
        some = w if len(which) == len(counts) else w[A.ragged(bounds[which], counts[which])]
        keys, has = order_min_hash(some, counts[which], words, sketches, several)
        owners.append(np.repeat(which[has], keys.shape[1]))
        found.append(keys.ravel())

    add(np.arange(len(counts)), p.words, p.sketches, p.several)
    add(np.flatnonzero(counts >= p.long_words), 1, p.long_sketches, p.long_several)
    add(np.flatnonzero(counts <= p.long_words / p.similarity), 1, p.short_sketches, p.short_several)
    for k, keys in deletion_keys(w, counts, p).items():
        owners.append(np.full(len(keys), k))
        found.append(np.array(keys, np.uint64))
    owner = np.concatenate(owners)
    flat = np.concatenate(found)[np.argsort(owner, kind="stable")]
    return pa.ListArray.from_arrays(pa.array(A.offsets(np.bincount(owner, minlength=len(counts))).astype(np.int32)), pa.array(flat.view(np.int64)))


def deletion_keys(w: np.ndarray, counts: np.ndarray, p: NearParams) -> dict[int, list[int]]:
    """By text: a key for each way to delete as many words as its length allows, of texts that may lose few words."""
    bounds, out = A.offsets(counts), {}
    limits = limit_of(counts, counts, p.similarity)
    for k in np.flatnonzero((counts > 0) & (limits <= p.deletions)).tolist():
        words, n = [x.tobytes() for x in w[bounds[k] : bounds[k + 1]]], int(counts[k])
        kept = {b"".join(c) for d in range(min(int(limits[k]), n - 1) + 1) for c in combinations(words, n - d)}
        out[k] = sorted(int.from_bytes(hashlib.blake2b(x, digest_size=8, key=b"deletion").digest(), "little") for x in kept)
    return out


def word_bins(w: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of each text's words in 256 bins, at most 255: an edit changes a sum of rises, or of falls, by one."""
    out = np.zeros((len(counts), 256), np.uint8)
    bounds = A.offsets(counts)
    bins = (w >> np.uint64(56)).astype(np.int64)
    for lo in range(0, len(counts), 4096):
        some = counts[lo : lo + 4096]
        cell = np.repeat(np.arange(len(some)), some) * 256 + bins[bounds[lo] : bounds[lo + len(some)]]
        out[lo : lo + len(some)] = np.minimum(np.bincount(cell, minlength=len(some) * 256), 255).reshape(-1, 256)
    return out


def bins_allow(left: np.ndarray, right: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Whether pairs of rows of word bins are within the limit."""
    out = np.zeros(len(limit), bool)
    for lo in range(0, len(limit), 8192):
        gap = left[lo : lo + 8192].astype(np.int16) - right[lo : lo + 8192]
        rises = np.maximum(gap, 0).sum(1, dtype=np.int64)
        out[lo : lo + 8192] = np.maximum(rises, rises - gap.sum(1, dtype=np.int64)) <= limit[lo : lo + 8192]
    return out


def may_link(bucket: np.ndarray, size: np.ndarray, bins: np.ndarray, similarity: float, apart=None) -> np.ndarray:
    """Which rows have a partner in their bucket that length and bins allow; rows are sorted by bucket, then by size.
    apart(i, j): which pairs of rows count at all."""
    n = len(bucket)
    some = np.zeros(n, bool)
    at = np.arange(n)
    for lag in range(1, n):
        at = at[at + lag < n]
        at = at[bucket[at] == bucket[at + lag]]
        limit = limit_of(size[at], size[at + lag], similarity)
        near = size[at + lag] - size[at] <= limit
        at, limit = at[near], limit[near]  # the next row of that bucket is longer still
        if not len(at):
            break
        test = np.flatnonzero(~(some[at] & some[at + lag]))
        if apart is not None and len(test):
            test = test[apart(at[test], at[test] + lag, False)]
        i = at[test]
        i = i[bins_allow(bins[i], bins[i + lag], limit[test])]
        if apart is not None and len(i):
            i = i[apart(i, i + lag, True)]
        some[i] = some[i + lag] = True
    return some


def digests(w: np.ndarray, counts: np.ndarray) -> list[bytes]:
    raw, at = memoryview(w.tobytes()), (A.offsets(counts) * 8).tolist()
    return [hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(at, at[1:])]


def limit_of(na, nb, similarity: float):
    """The largest edit distance at which the similarity still holds."""
    return np.floor((1 - similarity) * np.maximum(na, nb) + 1e-9).astype(np.int64)


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words, each once, sorted."""
    if len(words) < 2:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return np.unique(A.mix(words[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + words[1:].astype(np.uint64)))


def word_labels(words: np.ndarray) -> np.ndarray:
    """A word with the number of its occurrence, hashed, sorted: a set that stands for the multiset of words."""
    w = np.sort(words)
    new = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, np.int64)
    nth = np.arange(len(w)) - np.repeat(new, np.diff(np.append(new, len(w))))
    with np.errstate(over="ignore"):
        return np.unique(A.mix(w.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + nth.astype(np.uint64)))


def least_distance(words, pairs):
    """A lower bound of the edit distance from (count a, count b, shared) of word labels and of distinct word pairs: an
    edit changes one word, and at most two pairs, of either text."""
    return np.maximum(np.maximum(words[0], words[1]) - words[2], (pairs[0] + pairs[1] - 2 * pairs[2]) / 4)


def band_distances(a: list[np.ndarray], b: list[np.ndarray], width: int) -> np.ndarray:
    """Word edit distances of pairs inside a band of diagonals; right where the result is at most `width`."""
    pairs = len(a)
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    span = 2 * width + 1
    far = np.int32(1 << 28)
    rows = int(na.max())
    left = np.full((pairs, rows), 1 << 33, np.int64)
    over = np.full((pairs, rows + span + 1), 1 << 34, np.int64)
    for k in range(pairs):
        left[k, : na[k]] = a[k]
        m = min(nb[k], rows + width + 1)
        over[k, width : width + m] = b[k][:m]
    cols = np.arange(span, dtype=np.int32)
    now = np.where(cols >= width, cols - width, far)[None, :].repeat(pairs, 0).astype(np.int32)
    out = np.full(pairs, far, np.int64)
    last = nb - na + width
    inside = (last >= 0) & (last < span)

    def take(i):
        hit = np.flatnonzero(inside & (na == i))
        if len(hit):
            out[hit] = now[hit, last[hit]]

    ends = set(na.tolist())
    if 0 in ends:
        take(0)
    for i in range(1, rows + 1):
        cost = now + (over[:, i - 1 : i - 1 + span] != left[:, i - 1 : i])
        cost[:, :-1] = np.minimum(cost[:, :-1], now[:, 1:] + 1)
        if i <= width:
            cost[:, : width - i] = far
            cost[:, width - i] = i  # the border: all of a's words deleted
        now = (np.minimum.accumulate(cost - cols, axis=1) + cols).astype(np.int32)
        if i in ends:
            take(i)
    return out


def wide_distance(a: list[int], b: list[int], limit: int) -> int:
    """Edit distance with the whole matrix as the band: one bit per row of it, one step per word of b. Stops with
    limit + 1 as soon as the words left cannot bring the distance down to the limit."""
    n = len(a)
    if not n:
        return len(b)
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    mask, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, left = mask, 0, n, len(b)
    for x in b:
        same = at.get(x, 0) | down
        diag = (((same & up) + up) ^ up) | same
        over, under = down | (mask & ~(diag | up)), diag & up
        if over & top:
            score += 1
        elif under & top:
            score -= 1
        left -= 1
        if score - left > limit:
            return limit + 1
        over, under = (over << 1 | 1) & mask, (under << 1) & mask
        up, down = under | (mask & ~(diag | over)), over & diag
    return score


def verified(a: list[np.ndarray], b: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether each pair's edit similarity reaches the bound."""
    n = len(a)
    na, nb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    limit = limit_of(na, nb, similarity)
    ok = np.zeros(n, bool)
    open_ = []
    for k in range(n):
        if abs(na[k] - nb[k]) > limit[k]:
            continue
        sides = [(f(a[k]), f(b[k])) for f in (word_labels, pair_hashes)]
        counts = [(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))) for x, y in sides]
        if least_distance(*counts) <= limit[k]:
            open_.append(k)
    open_ = np.array(open_, np.int64)
    for width in (8, 32):
        if not len(open_):
            break
        open_ = open_[np.argsort(na[open_], kind="stable")]
        most = np.minimum(limit[open_], width)
        got = np.full(len(open_), 1 << 28)
        at = 0
        while at < len(open_):
            take = 1
            while at + take < len(open_) and (take + 1) * max(2 * width + 1, 64) <= 40_000 and (take + 1) * na[open_[at + take]] <= 4_000_000:
                take += 1
            ks = open_[at : at + take]
            got[at : at + take] = band_distances([a[k] for k in ks], [b[k] for k in ks], width)
            at += take
        ok[open_[got <= most]] = True
        open_ = open_[(got > most) & (limit[open_] > width)]
    for k in open_.tolist():
        ok[k] = wide_distance(a[k].tolist(), b[k].tolist(), int(limit[k])) <= limit[k]
    return ok


def _as_words(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint32).astype(np.int64) for x in column.to_pylist()]


def _bins(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 256)


def _whole_groups(batches, columns: list[str], done) -> Iterator[pa.RecordBatch]:
    """done(table) of runs of whole groups, of rows that are sorted by `columns`; a group that a batch cuts off waits."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        same = np.ones(t.num_rows, bool)
        for c in columns:
            values = t.column(c).to_numpy()
            same &= values == values[-1]
        cut = int(np.flatnonzero(same)[0])
        if cut:
            yield from done(t.slice(0, cut).combine_chunks())
        rest = t.slice(cut)
    if rest is not None:
        yield from done(rest.combine_chunks())


def _blocks(mixed: DataFrame, p: NearParams) -> DataFrame:
    """Rows of mixed buckets (key, node, root, n_words, size, weight) dealt to pairs of blocks: with part, p, q."""
    heavy = (F.col("size") > p.block) | (F.col("weight") > p.block_words)
    fixed = F.lit("").alias
    light = mixed.filter(~heavy).select("key", "node", "root", fixed("part"), fixed("p"), fixed("q"))
    # lengths of one link differ by at most one band
    step = float(-np.log(p.similarity) * 1.001) if p.similarity < 1 else 1.0
    rows = mixed.filter(heavy).select("key", "node", "root", "n_words", F.floor(F.log1p("n_words") / F.lit(step)).cast("int").alias("band"))
    per_root = rows.groupBy("key", "band", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("n_words").alias("w"))
    giant = (F.col("m") > p.block // 2) | (F.col("w") > p.block_words // 2)
    per_root = per_root.withColumn("lump", F.when(giant, F.col("root")).otherwise(F.lit(-1)))
    parts = F.greatest(F.ceil(F.sum("m") / p.block), F.ceil(F.sum("w") / p.block_words), F.lit(1)).cast("int")
    lumps = per_root.groupBy("key", "band", "lump").agg(parts.alias("parts"))
    named = F.concat_ws(":", F.lpad(F.col("band").cast("string"), 3, "0"), "lump", "nth")
    blocks = lumps.select("key", "band", "lump", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("nth")).withColumn("part", named).select("key", "band", "lump", "part")
    other = blocks.select("key", *(F.col(c).alias(f"{c}_") for c in ("band", "lump", "part")))
    meet = (F.col("part") <= F.col("part_")) & (F.col("band_") - F.col("band") <= 1) & ((F.col("lump") < 0) | (F.col("lump") != F.col("lump_")))
    pairs = blocks.join(other, "key").filter(meet).select("key", F.col("part").alias("p"), F.col("part_").alias("q"))
    wanted = pairs.select("key", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("part"))
    dealt = rows.join(per_root.select("key", "band", "root", "lump"), ["key", "band", "root"]).join(lumps, ["key", "band", "lump"])
    dealt = dealt.withColumn("nth", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("part", named)
    dealt = dealt.join(wanted, ["key", "part"]).select("key", "node", "root", "part", "p", "q")
    return light.unionByName(dealt)


def _class_rows(docs: DataFrame, p: NearParams, id_col: str, text_col: str) -> DataFrame:
    """One row per row of docs: doc_id, mark (a hash of the text as it stands), class_id, class_size, kept."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def sketch(batches):
        for batch in batches:
            A.release()
            texts = texts_of(batch, "text")
            for lo, hi in A.chunks(texts):
                w, counts = word_hashes(texts[lo:hi])
                held = {c: batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "mark")}
                yield pa.RecordBatch.from_pydict(held | {"digest": pa.array(digests(w, counts), pa.binary()), "keys": key_lists(w, counts, p), "n_words": pa.array(counts.astype(np.int64))})

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = plain.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    rows = marked.mapInArrow(sketch, f"doc_id {kind}, mark bigint, digest binary, keys array<bigint>, n_words bigint")
    sketched = stored(rows.withColumn("row", F.monotonically_increasing_id()), "near-sketched")
    rows = stored(sketched.select("doc_id", "mark", "digest", "row"), "near-rows")
    # equal words are one node; its number is fixed once stored
    keep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("keep")
    nodes = sketched.groupBy("digest").agg(keep, F.count(F.lit(1)).alias("copies"), F.first(F.struct("keys", "n_words")).alias("held"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "keep", "copies", "held.*"), "near-nodes")
    shared = nodes.select(F.explode("keys").alias("key"), "node", F.col("n_words").cast("int").alias("n")).groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("lead"), F.min_by("n", "node").alias("n_lead"), F.min("n").alias("least"), F.max("n").alias("most"))
    # two texts that meet by chance mostly differ in length beyond any link: their key goes before anything is joined by it
    may_link_ = (F.col("size") > 2) | (F.col("most") - F.col("least") <= F.floor((1 - p.similarity) * F.col("most") + 1e-9))
    discard(sketched)
    release_shuffles(spark)
    shared = stored(shared.filter((F.col("size") > 1) & may_link_).select("key", "size", "lead", "n_lead"), "near-shared")
    held_by_two = BloomFilter(shared, "key", shared.count()).tester()

    def members_of(batches):
        """A row for each of a node's keys that the filter lets through."""
        for batch in batches:
            keys = batch.column("keys").flatten().to_numpy().astype(np.int64)
            owner = np.repeat(batch.column("node").to_numpy(), np.diff(batch.column("keys").offsets.to_numpy()))
            hit = held_by_two(keys)
            n = np.repeat(batch.column("n_words").to_numpy(), np.diff(batch.column("keys").offsets.to_numpy()))
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys[hit]), "node": pa.array(owner[hit]), "n_words": pa.array(n[hit])})

    # lengths travel with the members, so that pairs are settled by them before they are joined with anything
    routed = nodes.select("node", "keys", "n_words").mapInArrow(members_of, "key bigint, node bigint, n_words bigint")
    members = stored(routed.join(shared.select("key", "lead", "n_lead"), "key"), "near-members")
    release_shuffles(spark)
    wanted = members.select("node").distinct().join(nodes.select("node", "digest", "n_words"), "node")
    wanted = stored(wanted.withColumn("k64", F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("bigint")), "near-wanted")
    route = BloomFilter(wanted, "k64", wanted.count()).tester()

    def words(batches):
        for batch in batches:
            A.release()
            texts = texts_of(batch, "text")
            for lo, hi in A.chunks(texts):
                w, counts = word_hashes(texts[lo:hi])
                own = digests(w, counts)
                pick = np.flatnonzero(route(np.array([int.from_bytes(d[:7], "big") for d in own], np.int64)))
                bins = word_bins(w, counts)
                raw, at = memoryview((w >> np.uint64(32)).astype(np.uint32).tobytes()), A.offsets(counts) * 4
                yield pa.RecordBatch.from_pydict({"digest": pa.array([own[k] for k in pick], pa.binary()), "words": pa.array([bytes(raw[at[k] : at[k + 1]]) for k in pick], pa.binary()), "bins": pa.array([bins[k].tobytes() for k in pick], pa.binary())})

    found = plain.select("text").mapInArrow(words, "digest binary, words binary, bins binary").groupBy("digest").agg(F.first(F.struct("words", "bins")).alias("t"))
    texts = stored(found.join(wanted, "digest").select("node", "t.words", "t.bins", "n_words"), "near-words")
    discard(shared, wanted)
    release_shuffles(spark)

    def possible(batches):
        for batch in batches:
            limit = limit_of(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), p.similarity)
            ok = bins_allow(_bins(batch.column("bins_a")), _bins(batch.column("bins_b")), limit)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok))

    def verify(batches):
        for batch in batches:
            A.release()
            ok = verified(_as_words(batch.column("words_a")), _as_words(batch.column("words_b")), p.similarity)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok))

    side = lambda n, of, short: texts.select(F.col("node").alias(n), F.col(of).alias(f"{short}_{n}"))
    pairs = members.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"), F.col("n_lead").cast("bigint").alias("n_a"), F.col("n_words").alias("n_b"))
    # by length, then by word counts, then by alignment: what each step reads of the texts grows, and fewer pairs are left
    limit = F.floor((1 - p.similarity) * F.greatest("n_a", "n_b") + 1e-9)
    pairs = pairs.filter(F.abs(F.col("n_a") - F.col("n_b")) <= limit).distinct()
    pairs = stored(pairs.join(side("a", "bins", "bins"), "a").join(side("b", "bins", "bins"), "b").mapInArrow(possible, "a bigint, b bigint"), "near-pairs")
    release_shuffles(spark)
    links = pairs.join(side("b", "words", "words"), "b").join(side("a", "words", "words"), "a").select("a", "b", "words_a", "words_b")
    links = stored(links.mapInArrow(verify, "a bigint, b bigint"), "near-links")
    release_shuffles(spark)
    first = components(links)

    # buckets that still hold several components
    placed = members.select("key", "node", "n_words").join(first, "node", "left")
    placed = stored(placed.select("key", "node", "n_words", F.coalesce("root", "node").alias("root")), "near-placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size"), F.sum("n_words").alias("weight")).filter("lo < hi")
    mixed = stored(placed.join(mixed.select("key", "size", "weight"), "key"), "near-mixed")
    held = stored(mixed.groupBy("node").agg(F.collect_list("key").alias("keys")), "near-held")  # at most a text's own keys

    def partnered(batches):
        """Rows sorted by block pair and length: those that have a partner that the bounds allow, in this bucket first."""

        def done(t: pa.Table):
            key, root, part, p_, q_ = (t.column(c).to_numpy() for c in ("key", "root", "part", "p", "q"))
            group = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (p_[1:] != p_[:-1]) | (q_[1:] != q_[:-1])))
            within = p_ == q_
            held = t.column("keys").combine_chunks()
            bounds, flat = held.offsets.to_numpy(), held.values.to_numpy()
            lower: dict[int, frozenset] = {}

            def below(i: int) -> frozenset:
                if i not in lower:
                    own = flat[bounds[i] : bounds[i + 1]]
                    lower[i] = frozenset(own[own < key[i]].tolist())
                return lower[i]

            def apart(i, j, exact: bool):
                if exact:
                    return np.fromiter((below(a).isdisjoint(below(b)) for a, b in zip(i.tolist(), j.tolist())), bool, len(i))
                return np.flatnonzero((root[i] != root[j]) & (within[i] | (part[i] != part[j])))

            ok = may_link(group, t.column("n_words").to_numpy(), _bins(t.column("bins")), p.similarity, apart)
            yield from t.select(["key", "p", "q", "node", "root", "part"]).filter(pa.array(ok)).combine_chunks().to_batches()

        A.release()
        yield from _whole_groups(batches, ["key", "p", "q"], done)

    dealt = _blocks(mixed, p).join(texts.select("node", "n_words", "bins").join(held, "node"), "node")
    dealt = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "n_words")
    left = stored(dealt.mapInArrow(partnered, "key bigint, p string, q string, node bigint, root bigint, part string"), "near-left")

    def inside(t: pa.Table) -> pa.Table:
        node, root = t.column("node").to_numpy(), t.column("root").to_numpy()
        part = np.unique(t.column("part").to_pylist(), return_inverse=True)[1]
        keys = [np.array(x, np.int64) for x in t.column("keys").to_pylist()]
        found = block_links(t.column("key")[0].as_py(), node, root, part, _as_words(t.column("words")), keys, p.similarity)
        return pa.table(dict(zip("ab", (pa.array(x, pa.int64()) for x in found))))

    more = left.join(texts.select("node", "words").join(held, "node"), "node").groupBy("key", "p", "q").applyInArrow(inside, "a bigint, b bigint")
    more = stored(more, "near-more")
    release_shuffles(spark)
    whole = components(links.unionByName(more))
    labelled_ = nodes.select("node", "digest", "keep", "copies").join(whole, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # stored, so that joining it is by size, and a class of very many rows can be split
    classes = stored(labelled_.groupBy("root").agg(F.min("keep").alias("first"), F.sum("copies").alias("class_size")), "near-names")
    named = stored(labelled_.join(classes, "root").select("digest", "first", "class_size"), "near-named")
    discard(nodes, members, texts, pairs, links, placed, mixed, held, left, more, classes)
    named = rows.select("doc_id", "mark", "digest", "row").join(named, "digest")
    return named.select("doc_id", "mark", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"))


def block_links(key: int, node: np.ndarray, root: np.ndarray, part: np.ndarray, own: list[np.ndarray], keys: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links between nodes of different components in one pair of blocks of a bucket.

    A pair is tested in the least of its common buckets only. Pairs are tested by falling overlap of their word pairs,
    and those joined on the way are skipped, so a component's members are not tested against each other.
    """
    n = len(node)
    order = np.argsort(node, kind="stable")
    node, root, part, own, keys = node[order], root[order], part[order], [own[k] for k in order], [keys[k] for k in order]
    size = np.array([len(x) for x in own], np.int64)

    def shared(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count of each row's values, as a column and as a row, and how many each two rows share), by matrix products."""
        held = np.array([len(x) for x in rows], np.float32)
        owner = np.repeat(np.arange(n), held.astype(np.int64))
        _, column, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *rows]), return_inverse=True, return_counts=True)
        place = np.cumsum(times > 1) - 1  # values of one row alone are shared with none
        keep = times[column] > 1
        owner, column = owner[keep], place[column[keep]]
        both = np.zeros((n, n), np.float32)
        for lo in range(0, int(place[-1]) + 1 if len(place) else 0, SLICE):
            flags = np.zeros((n, SLICE), np.float32)
            now = (column >= lo) & (column < lo + SLICE)
            flags[owner[now], column[now] - lo] = 1
            both += flags @ flags.T
        return held[:, None], held[None, :], both

    words, pairs = shared([word_labels(x) for x in own]), shared([pair_hashes(x) for x in own])
    limits = limit_of(size[:, None], size[None, :], similarity)
    near = (np.abs(size[:, None] - size[None, :]) <= limits) & (least_distance(words, pairs) <= limits) & (root[:, None] != root[None, :])
    if len(np.unique(part)) > 1:
        near &= part[:, None] != part[None, :]
    i, j = np.nonzero(np.triu(near, 1))
    # an exact look at the pairs' other buckets
    lower = [frozenset(x[x < key].tolist()) for x in keys]
    first = np.fromiter((lower[x].isdisjoint(lower[y]) for x, y in zip(i.tolist(), j.tolist())), bool, len(i))
    i, j = i[first], j[first]
    order = np.argsort(-words[2][i, j] / np.maximum(np.maximum(size[i], size[j]), 1), kind="stable")
    i, j = i[order].tolist(), j[order].tolist()
    group = {int(r): int(r) for r in root.tolist()}

    def top(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    names = root.tolist()
    a, b, at, step = [], [], 0, 8
    while at < len(i):
        todo = []
        while at < len(i) and len(todo) < step:
            if top(names[i[at]]) != top(names[j[at]]):
                todo.append((i[at], j[at]))
            at += 1
        step = min(64, step * 2)
        ok = verified([own[x] for x, _ in todo], [own[y] for _, y in todo], similarity)
        for (x, y), good in zip(todo, ok.tolist()):
            if good:
                a.append(int(node[x]))
                b.append(int(node[y]))
                p, q = top(names[x]), top(names[y])
                group[max(p, q)] = min(p, q)
    return a, b


def near_dedup(docs: DataFrame, p: NearParams = NearParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest id of its class), class_size, kept (whether the row stays)."""
    return _class_rows(docs, p, id_col, text_col).drop("mark")


def drop_near(docs: DataFrame, p: NearParams = NearParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of every class, by near_dedup()'s rule; all columns. Rows go by id and text together, so
    other rows of the same id stay; only rows that a filter routes here are shuffled."""
    classes = stored(_class_rows(docs, p, id_col, text_col).groupBy("doc_id", "mark").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("not kept or n > 1"), "near-gone")
    own, hashed = fresh(docs, "mark"), F.xxhash64
    route = BloomFilter(classes.select(hashed("doc_id", "mark").alias("k")), "k", classes.count())
    marked = docs.withColumn(own, hashed(F.col(text_col)))
    listed = route.may_hold(hashed(F.col(id_col), F.col(own)))
    gone = classes.filter("not kept").select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"))
    rest = marked.filter(listed).alias("d").join(gone, F.col(f"d.{id_col}").eqNullSafe(F.col("gone_id")) & (F.col(f"d.{own}") == F.col("gone_mark")), "left_anti")
    return marked.filter(~listed).unionByName(rest.dropDuplicates([id_col, own])).drop(own)
