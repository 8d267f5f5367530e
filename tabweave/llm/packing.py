"""Sequence packing by Karmarkar-Karp multiway differencing.

Every document's ids (with a separator) are cut into full windows and a rest. The rests of a bounded batch are
dealt to windows by differencing: each rest starts as a partial partition with one loaded window; the two partial
partitions of largest spread are merged with opposing imbalances (the fullest windows of one onto the emptiest of
the other) until one partition is left, whose windows are nearly equal. The window count starts at the least that
can hold the batch and rises whenever a window exceeds the capacity, until none does.

Where pieces may be cut, a batch first sets aside what doesn't fill a whole number of windows, as sequences whose
lengths are powers of two, which need no padding. After differencing, the emptiest windows beyond the least count are
given up, and their rests fill the room of the others, so every other sequence is full and few rests are cut.

Packing is map-only: a batch is a bounded run of rows of one partition, so hot keys don't matter and nothing is
shuffled. sequence_id holds the partition's number and a counter.

Defined results: a null or empty text is its separator alone; repeated rows are packed each; rests of equal length are
dealt by their order in the batch; a very long text is cut into as many windows as it fills; an empty table gives no
rows; other columns are not read, and an id may have any type.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tabweave.llm import arrays as A
from tabweave.llm.bpe import codec
from tabweave.llm.shared import bounded_batches, texts_of

BATCH_ROWS = 1024


def difference(sizes: list[int], k: int) -> np.ndarray:
    """Window of each item, by Karmarkar-Karp differencing into k windows; ties by order of the items."""
    n = len(sizes)
    if n == 0 or k <= 1:
        return np.zeros(n, np.int64)
    left, right = [], []  # what node n + i joins

    # a partial partition: the loads of its windows over the least of them, fullest first, and their nodes;
    # windows beyond those listed are empty, and then nothing has been taken off the loads
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, a, ai = heapq.heappop(heap)
        _, _, b, bi = heapq.heappop(heap)
        if len(a) + len(b) <= k:
            loads, nodes = np.concatenate([a, b]), np.concatenate([ai, bi])
            sorted_already = a[-1] >= b[0]
        else:
            lo = k - len(b)  # the fullest window of b meets the emptiest of a
            nodes = np.full(k, -1)
            loads = np.zeros(k, np.int64)
            nodes[: len(ai)], loads[: len(a)] = ai, a
            loads[lo:] += b[::-1]
            met = nodes[lo:]
            both = met >= 0
            fresh = n + len(left) + np.arange(int(both.sum()))
            left.extend(met[both].tolist())
            right.extend(bi[::-1][both].tolist())
            met[~both] = bi[::-1][~both]
            met[both] = fresh
            sorted_already = False
        if not sorted_already:
            by = np.argsort(-loads, kind="stable")
            loads, nodes = loads[by], nodes[by]
        if len(loads) == k:
            loads = loads - loads[-1]
        heapq.heappush(heap, (-int(loads[0]), order, loads, nodes))
        order += 1
    out = np.zeros(n, np.int64)
    for window, root in enumerate(heap[0][3].tolist()):
        stack = [root]
        while stack:
            v = stack.pop()
            if v < n:
                out[v] = window
            else:
                stack += (left[v - n], right[v - n])
    return out


def whole_windows(sizes: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """Windows for items of at most the capacity each; their count rises until all fit."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        window = difference(sizes, k)
        most = np.bincount(window, weights=sizes).max() if len(sizes) else 0
        if most <= capacity:
            return window, k
        k += max(1, int(k * (most - capacity) / capacity))


def powers(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(lengths: list[int], capacity: int = 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) of items that may be cut; sequences are full or powers of two."""
    out, seq = [], 0
    rests: list[list[int]] = []  # item, start, length
    for i, n in enumerate(lengths):
        for s in range(0, n - n % capacity, capacity):
            out.append((i, s, capacity, seq, 0))
            seq += 1
        if n % capacity:
            rests.append([i, n - n % capacity, n % capacity])
    over = sum(r[2] for r in rests) % capacity
    # what fills no whole window is cut off the ends of the last rests, as powers of two
    tail: list[list[int]] = []
    left = over
    while left:
        i, s, n = rests.pop()
        take = min(left, n)
        if take < n:
            rests.append([i, s, n - take])
        tail.append([i, s + n - take, take])
        left -= take
    for size in powers(over):
        filled = 0
        while filled < size:
            i, s, n = tail.pop()
            take = min(size - filled, n)
            if take < n:
                tail.append([i, s + take, n - take])
            out.append((i, s, take, seq, filled))
            filled += take
        seq += 1
    need = sum(r[2] for r in rests) // capacity
    window, k = whole_windows([r[2] for r in rests], capacity)
    load = np.bincount(window, weights=[r[2] for r in rests], minlength=k).astype(np.int64)
    number = np.full(k, -1)
    number[np.sort(np.argsort(-load, kind="stable")[:need])] = np.arange(need)
    fill, loose = [0] * need, []
    for (i, s, n), w in zip(rests, number[window].tolist()):
        if w < 0:
            loose.append([i, s, n])
        else:
            out.append((i, s, n, seq + w, fill[w]))
            fill[w] += n
    for w in range(need):
        while fill[w] < capacity:
            i, s, n = loose.pop()
            take = min(n, capacity - fill[w])
            out.append((i, s, take, seq + w, fill[w]))
            fill[w] += take
            if take < n:
                loose.append([i, s + take, n - take])
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", batch_rows: int = BATCH_ROWS, tokens: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with tokens=True also its ids."""
    bounded_batches(docs.sparkSession)
    with open(tokenizer, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * tokens

    def emit(held: list, first: int, id_type: pa.DataType):
        """Packs the documents held: (id, ids)."""
        pieces = pack([len(x) for _, x in held], capacity)
        doc = [held[p[0]] for p in pieces]
        cut = [x[p[1] : p[1] + p[2]] for p, (_, x) in zip(pieces, doc)]
        out = {
            id_col: pa.array([d for d, _ in doc], id_type),
            "start": pa.array([p[1] for p in pieces], pa.int64()),
            "length": [p[2] for p in pieces],
            "ids_crc32": [zlib.crc32(c.astype("<u4").tobytes()) for c in cut],
            "doc_tokens": [len(x) for _, x in doc],
            "sequence_id": [first + p[3] for p in pieces],
            "offset": [p[4] for p in pieces],
        }
        if tokens:
            out["ids"] = pa.array([c.tolist() for c in cut], pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(out), max((p[3] for p in pieces), default=-1) + 1

    def run(batches):
        c, held, at, weight = codec(spec.value), [], TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            A.release()
            texts, keys = texts_of(batch, text_col), batch.column(id_col).to_pylist()
            for lo, hi in A.chunks(texts, 2_000_000):
                ids, counts = c.encode(texts[lo:hi])
                bounds = A.offsets(counts)
                for k in range(hi - lo):
                    held.append((keys[lo + k], np.append(ids[bounds[k] : bounds[k + 1]], np.int32(separator))))
                    weight += len(held[-1][1])
                    if len(held) >= batch_rows or weight > 20_000_000:
                        out, used = emit(held, at, batch.schema.field(id_col).type)
                        at, held, weight = at + used, [], 0
                        yield out
        if held:
            yield emit(held, at, batch.schema.field(id_col).type)[0]

    return docs.select(id_col, text_col).mapInArrow(run, schema)

