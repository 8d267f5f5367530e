"""Substring deduplication by relative Lempel-Ziv parsing over words.

A window is `words` consecutive words of one document; a word goes if a window over it also starts earlier. Documents are
factored twice against indexed reference text:

1. Every task's run of documents is a reference block of about a million words. Its index maps each window to its first
   place in the order of ids. Each document is factored greedily against the part of the block before it: a factor starts
   at the first window that the index holds and grows word by word while its source does, so a copied document is one
   factor; windows that straddle the end of a factor are looked up as well, so none is missed. Factors are compared with their
   source word by word. What is left of a block is its own text, once.
2. What is left is dealt to reference blocks by content: a window's anchor is the least hash of its runs of `anchor` words,
   so equal windows meet in one block, and consecutive windows of one anchor travel as one segment. Only segments travel whose anchor
   stands in two blocks of the first step or more. Each block factors its segments against those before them.

A passage of a third of all documents is in each first block once. The anchors at its ends lie in windows that are all
different; where an anchor has very many segments its windows are dealt one by one, by their own hash. Spans, not words,
are joined back, to documents that have any.

Defined results: null counts as the empty text, which has no words. "Earlier" is a smaller id, or an earlier start in the
same row; rows of equal id don't precede each other, and rows without an id come after all others and don't precede each
other. So repeated rows have equal results. An empty table gives no rows; texts of any length are read whole (in slices);
columns other than id and text are not read by substring_dedup and kept by drop_repeats, whatever their names. Ids are
integers. docs must give the same rows whenever it is read (a table does).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.arrays import mix, ragged, release
from tabweave.llm.bloom import BloomFilter
from tabweave.llm.shared import bounded_batches, fresh, stored
from tabweave.llm.wordbytes import byte_table, gram_hashes, sliding_min, word_slices

#: White space between words (fixed values).
GAP = " \t\n\x0b\x0c\r"
WORDS, ANCHOR = 20, 10
BLOCK_WORDS = 1_000_000
#: At most so many anchors are dealt window by window; they are shipped to the tasks (8 bytes each).
MOST_HOT, LEAST_HOT = 1_000_000, 1000
SPLIT_TASK_ROWS = 100_000
SPAN = "doc_id bigint, mark bigint, start int, windows int"


class ReferenceBlock:
    """The index and the parse of one block. h: word hashes; doc: the place of each word's text in the block, texts in the
    order of ids; rank: the dense rank of each text's id."""

    def __init__(self, h: np.ndarray, doc: np.ndarray, rank: np.ndarray, words: int = WORDS, anchor: int = ANCHOR):
        self.h, self.doc, self.words = h, doc, words
        n = max(0, len(h) - words + 1)
        self.starts = np.flatnonzero(doc[:n] == doc[words - 1 : words - 1 + n])
        seed = 0
        while True:
            self.window = gram_hashes(h, words, seed)[self.starts]
            self.source = self._sources(rank)
            if self._factors_hold():
                break
            seed += 1  # two different windows of this block have one hash
        self.anchor = sliding_min(gram_hashes(h, anchor, 1), words - anchor + 1)[self.starts]

    def _sources(self, rank: np.ndarray) -> np.ndarray:
        """The index, asked for every window: an earlier place of it (as a place in starts), or -1."""
        source = np.full(len(self.starts), -1, np.int64)
        if not len(source):
            return source
        order = np.argsort(self.window, kind="stable")
        w, d = self.window[order], self.doc[self.starts][order]
        new = np.append(True, w[1:] != w[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
        by_id = rank[d[head]] < rank[d]
        own = np.append(False, ~new[1:] & (d[1:] == d[:-1]))
        found = np.where(by_id, order[head], np.where(own, np.append(0, order[:-1]), -1))
        source[order] = found
        return source

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, windows): runs of windows whose source goes on with them. As a window that straddles two factors
        has been looked up too, neighbours overlap by all but one word."""
        hit = self.source >= 0
        goes_on = np.zeros(len(hit), bool)
        back = self.starts[self.source] if len(hit) else self.starts
        goes_on[1:] = hit[1:] & hit[:-1] & (back[1:] == back[:-1] + 1) & (self.starts[1:] == self.starts[:-1] + 1)
        first = np.flatnonzero(hit & ~goes_on)
        closes = np.flatnonzero(hit & ~np.append(goes_on[1:], False))
        return first, closes - first + 1

    def _factors_hold(self) -> bool:
        first, windows = self.factors()
        if not len(first):
            return True
        to, back = self.starts[first], self.starts[self.source[first]]
        length = windows + self.words - 1
        return bool((self.h[ragged(to, length)] == self.h[ragged(back, length)]).all())

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, windows): maximal runs of windows that have a source, as places in starts."""
        return _runs(self.source >= 0, self.starts)

    def segments(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, windows): runs of wanted windows of one anchor."""
        return _runs(wanted, self.starts, self.anchor)


def _runs(flag: np.ndarray, at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    joined = np.zeros(len(flag), bool)
    joined[1:] = flag[1:] & flag[:-1] & (at[1:] == at[:-1] + 1)
    for s in same:
        joined[1:] &= s[1:] == s[:-1]
    first, last = np.flatnonzero(flag & ~joined), np.flatnonzero(flag & ~np.append(joined[1:], False))
    return first, last - first + 1


def _blocks(batches, words: int, anchor: int, most: int):
    """Reference blocks of a task's rows (doc_id, mark, text), with the ids, marks and begins of their parts. A text of more
    than a block's words is cut into parts that overlap by all but one word of a window."""
    gap = byte_table(GAP)
    held, total = [], 0

    def block():
        held.sort(key=lambda p: (p[0] is None, p[0] or 0, p[1], p[2]))
        ids = [(p[0] is None, p[0] or 0) for p in held]
        rank = np.cumsum([0] + [a != b for a, b in zip(ids, ids[1:])])
        h = np.concatenate([p[3] for p in held])
        sizes = np.array([len(p[3]) for p in held])
        return ReferenceBlock(h, np.repeat(np.arange(len(held)), sizes), rank, words, anchor), [p[:3] for p in held], np.cumsum(sizes) - sizes

    def parts(batch):
        open_doc, pieces = -1, []
        ids, marks = batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist()

        def whole():
            h = np.concatenate(pieces) if len(pieces) > 1 else pieces[0]
            for lo in range(0, max(1, len(h) - words + 1), most):
                yield ids[open_doc], marks[open_doc], lo, h[lo : lo + most + words - 1]

        for found, at in word_slices(batch.column("text"), gap):
            h = found.hashes()
            bounds = np.flatnonzero(np.append(True, found.doc[1:] != found.doc[:-1])) if len(h) else []
            for lo, hi in zip(bounds, np.append(bounds[1:], len(h)).astype(int)):
                d = at + int(found.doc[lo])
                if d != open_doc:
                    if pieces:
                        yield from whole()
                    open_doc, pieces = d, []
                pieces.append(h[lo:hi])
        if pieces:
            yield from whole()

    for batch in batches:
        for part in parts(batch):
            if len(part[3]) < words:
                continue
            held.append(part)
            total += len(part[3])
            if total >= most:
                yield block()
                held, total = [], 0
    if held:
        yield block()
    release()


def _cut(rows: pa.Table | dict, size: int = 20_000):
    yield from (rows if isinstance(rows, pa.Table) else pa.table(rows)).to_batches(max_chunksize=size)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, anchor: int = ANCHOR, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Runs of windows that also start earlier: doc_id, mark (xxhash64 of the text), start (in words), windows. One row or more for
    each run, stored."""
    if not 1 <= anchor <= words:
        raise ValueError("an anchor has 1 to `words` words")
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = marked(docs, id_col, text_col)

    def anchors(batches):
        for block, _, _ in _blocks(batches, words, anchor, block_words):
            first, _ = block.segments(block.source < 0)
            keys, n = np.unique(block.anchor[first], return_counts=True)
            yield from _cut({"anchor": pa.array(keys.view(np.int64)), "n": pa.array(n, pa.int64())})

    shared = stored(texts.mapInArrow(anchors, "anchor bigint, n bigint").groupBy("anchor").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("n")).filter("blocks > 1").select("anchor", "n"), "anchors")
    held, segments = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).collect()[0]
    in_two = BloomFilter(shared, "anchor", held).tester()
    limit = max(LEAST_HOT, segments // MOST_HOT)
    hot = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in shared.filter(F.col("n") > limit).select("anchor").collect()], np.int64)))  # at most MOST_HOT

    def deal(batches):
        empty = pa.array([None], pa.binary())
        for block, ids, begins in _blocks(batches, words, anchor, block_words):
            own, marks, parts = (pa.array([i[k] for i in ids], pa.int64()) for k in range(3))

            def rows(first, windows, key, hashes):
                if not len(first):
                    return
                d = block.doc[block.starts[first]]
                start = block.starts[first] - begins[d] + parts.take(pa.array(d)).to_numpy(zero_copy_only=False)
                yield from _cut({"key": key, "doc_id": own.take(pa.array(d)), "mark": marks.take(pa.array(d)), "start": pa.array(start, pa.int32()), "windows": pa.array(windows, pa.int32()), "hashes": hashes})

            first, windows = block.spans()
            spread = mix(block.window[first]).view(np.int64)
            yield from rows(first, windows, pa.array(spread), pa.array([None] * len(first), pa.binary()))
            anchors = block.anchor.view(np.int64)
            wanted = (block.source < 0) & in_two(anchors)
            many = np.isin(anchors, hot.value)
            first, windows = block.segments(wanted & ~many)
            sent = block.window[ragged(first, windows)]
            ends = np.append(0, np.cumsum(windows)) * 8
            binary = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(sent)]) if len(first) else empty[:0]
            yield from rows(first, windows, pa.array(anchors[first]), binary)
            first = np.flatnonzero(wanted & many)
            with np.errstate(over="ignore"):
                key = mix(block.anchor[first] + np.uint64(3) * block.window[first]).view(np.int64)
            alone = block.window[first]
            binary = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((np.arange(len(first) + 1) * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(alone))]) if len(first) else empty[:0]
            yield from rows(first, np.ones(len(first), np.int64), pa.array(key), binary)

    dealt = texts.mapInArrow(deal, "key bigint, doc_id bigint, mark bigint, start int, windows int, hashes binary")
    sorted_rows = dealt.repartition("key").sortWithinPartitions("key", F.col("doc_id").isNull(), "doc_id", "mark", "start")
    return stored(sorted_rows.mapInArrow(factored_segments, SPAN), "spans")


def factored_segments(batches):
    """Segments sorted by (key, id, mark, start), factored against those before them in their key's block; spans that were
    settled before (no hashes) pass through. A key's rows are held until the next key comes: at most a hot key's limit,
    or, of one window, a row for each first block."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def settle(t: pa.Table):
        done = t.filter(pc.is_null(t.column("hashes"))).select(["doc_id", "mark", "start", "windows"])
        if done.num_rows:
            yield from _cut(done)
        t = t.filter(pc.is_valid(t.column("hashes"))).combine_chunks()
        if not t.num_rows:
            return
        col = lambda c: t.column(c).to_numpy(zero_copy_only=False)
        n = col("windows").astype(np.int64)
        hashes = np.frombuffer(b"".join(t.column("hashes").to_pylist()), np.uint64)
        row = np.repeat(np.arange(len(n)), n)
        none = pc.is_null(t.column("doc_id")).to_numpy(zero_copy_only=False)
        ident = pc.fill_null(t.column("doc_id"), 0).to_numpy(zero_copy_only=False)
        key, mark = col("key"), col("mark")
        new_id = np.append(True, (key[1:] != key[:-1]) | (none[1:] != none[:-1]) | (ident[1:] != ident[:-1]))
        rank, text = np.cumsum(new_id), np.cumsum(new_id | np.append(True, mark[1:] != mark[:-1]))
        place = np.cumsum(np.append(True, key[1:] != key[:-1]))[row]
        order = np.lexsort((np.arange(len(row)), hashes, place))
        w, p, r = hashes[order], place[order], row[order]
        new = np.append(True, (w[1:] != w[:-1]) | (p[1:] != p[:-1]))
        head = np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
        start = col("start").astype(np.int64)
        at = start[row] + ragged(np.zeros(len(n), np.int64), n)
        # of one text's equal windows the first start stays; rows that repeat a text have the same starts
        before = np.append(False, ~new[1:] & (text[r][1:] == text[r][:-1]))
        least = np.maximum.accumulate(np.where(~before, np.arange(len(w)), 0))
        gone = np.zeros(len(row), bool)
        gone[order] = (rank[r[head]] < rank[r]) | (before & (at[order] > at[order][least]))
        first, windows = _runs(gone, at, row)
        if len(first):
            d = pa.array(row[first])
            yield from _cut({"doc_id": t.column("doc_id").take(d), "mark": t.column("mark").take(d), "start": pa.array(at[first], pa.int32()), "windows": pa.array(windows, pa.int32())})

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < SPLIT_TASK_ROWS:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        keys = t.column("key").to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield from settle(t.slice(0, cut))
        held, rows = t.slice(cut).to_batches(), t.num_rows - cut
    if held:
        yield from settle(pa.Table.from_batches(held))
    release()


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), F.col(text_col).alias("text"))


def _with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, span_col: str) -> DataFrame:
    """docs with their spans (null where there are none); only rows that the filter routes are shuffled."""
    mark, own = fresh(docs, "mark"), fresh(docs, "own_id")
    keyed = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    route = BloomFilter(spans, "mark", spans.agg(F.approx_count_distinct("mark")).collect()[0][0] * 11 // 10 + 1)
    by_doc = spans.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "windows")).alias(span_col)).withColumnRenamed("doc_id", own).withColumnRenamed("mark", mark + "_of")
    plain = keyed.filter(~route.may_hold(mark)).withColumn(span_col, F.lit(None).cast(by_doc.schema[span_col].dataType))
    routed = keyed.filter(route.may_hold(mark)).join(by_doc, F.col(id_col).cast("bigint").eqNullSafe(F.col(own)) & (F.col(mark) == F.col(mark + "_of")), "left")
    cols = [*(F.col(f"`{c}`") for c in docs.columns), F.col(span_col)]
    return plain.select(*cols).unionByName(routed.select(*cols))


def kept_words(text: str | None, spans: list | None, words: int) -> tuple[int, list[bytes]]:
    """(words of the text, those that stay)."""
    found = (text or "").encode().split()  # bytes are split at [\\x20\\x09-\\x0D]+
    if not spans:
        return len(found), found
    flag = np.zeros(len(found) + 1, np.int64)
    for s in spans:
        flag[s["start"]] += 1
        flag[s["start"] + s["windows"] + words - 1] -= 1
    stays = np.cumsum(flag)[:-1] == 0
    return len(found), [found[i] for i in np.flatnonzero(stays)]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, anchor: int = ANCHOR, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256."""
    spans = repeated_spans(docs, id_col, text_col, words, anchor, block_words)
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            done = [kept_words(t, s, words) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array([n for n, _ in done], pa.int64()),
                "n_removed": pa.array([n - len(k) for n, k in done], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for _, k in done], pa.string()),
            })

    return _with_spans(chosen, spans, "doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, anchor: int = ANCHOR, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with the words that stay, joined by one space, as text where any word went; all columns of docs."""
    spans = repeated_spans(docs, id_col, text_col, words, anchor, block_words)
    name = fresh(docs, "spans")

    @F.pandas_udf("string")
    def cut(texts, found):
        import pandas as pd

        return pd.Series([b" ".join(kept_words(t, list(s), words)[1]).decode() if s is not None else t for t, s in zip(texts, found)])

    out = _with_spans(docs, spans, id_col, text_col, name)
    changed = F.when(F.col(name).isNotNull(), cut(F.col(text_col), F.col(name))).otherwise(F.col(text_col))
    return out.select(*(changed.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
