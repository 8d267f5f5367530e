"""Byte-level BPE by speculation and verification.

A word's encoding is *proposed* by greedy longest match over the vocabulary (one automaton pass over all new
words) and *verified* by vectorised compatibility checks on every adjacent pair of proposed tokens. A token
sequence is the BPE encoding of its word exactly if each token encodes to itself and no pair of neighbours would
have merged across their border, so a proposal that passes is right whatever proposed it. Tokens that don't encode to
themselves are found when the vocabulary is read, and never proposed. Only words with a pair that fails are merged
exactly: many words at a time, and each very long one with a heap.

Why a pair (a, b) is compatible: merges are made in order of rank. While a and b are built separately, the piece x
at the right edge of a and the piece y at the left edge of b stand side by side for a stretch of ranks. They merge
if the rule (x, y) has a rank below the one that absorbs x into its parent, and not above the one that absorbs y
into its parent (of equal ranks the left position goes first). The check walks both edges upwards at once.

Words recur, so each worker keeps a bounded cache from a word's 64-bit hash to its ids.

Defined results: null and empty texts have no tokens and decode to the empty text; the special token's own string
in a text becomes its id, as the tokenizers library does by default; texts and words of any length are encoded whole;
repeated rows are encoded each; there are no ties (equal ranks merge from the left); an empty table gives no rows; other
columns are not read, and an id may have any type.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabweave.llm import arrays as A
from tabweave.llm.shared import bounded_batches, texts_of

NEVER = 1 << 30
#: First letters of the English contractions that the byte-level pattern splits off (fixed values).
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
CACHE_WORDS = 1_200_000
CACHE_PAIRS = 1_000_000
#: Words of more bytes that fail are merged one by one with a heap.
LONG = 64
#: Tokens of at most so many bytes are decoded from rows of one matrix.
WIDE = 16


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(extra)
            extra += 1
    return [names[b] for b in range(256)]


class BpeCodec:
    """Encodes and decodes many texts at once with the vocabulary of a tokenizers JSON file."""

    def __init__(self, spec: bytes | str, cache_words: int = CACHE_WORDS):
        import ahocorasick

        spec = json.loads(spec)
        names = byte_alphabet()
        as_byte = {c: i for i, c in enumerate(names)}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.token_bytes[i] = bytes(as_byte[c] for c in text) if all(c in as_byte for c in text) else text.encode()
        for text, i in self.special.items():
            self.token_bytes[i] = text.encode()
        self.byte_ids = np.array([vocab[c] for c in names], np.int64)
        self.size = size
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order].astype(np.int32)
        self._spines(left, right, made)
        plain = self._plain(left, right, made)
        self.flat_bytes = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.byte_counts = np.array([len(b) for b in self.token_bytes], np.int64)
        self.byte_starts = A.offsets(self.byte_counts)[:-1]
        self.wide_used = np.arange(WIDE) < self.byte_counts[:, None]
        self.wide_bytes = np.zeros((size, WIDE), np.uint8)
        self.wide_bytes[self.wide_used] = np.frombuffer(b"".join(b[:WIDE] for b in self.token_bytes), np.uint8)
        self.longest = ahocorasick.Automaton()
        for text, i in vocab.items():
            if text not in self.special and plain[i]:
                self.longest.add_word(self.token_bytes[i].decode("latin-1"), i)
        self.longest.make_automaton()
        self.cache_words = cache_words
        self.pairs, self.apart = np.zeros(0, np.int64), np.zeros(0, bool)  # pairs of tokens checked so far, sorted
        self.rules: dict[int, tuple[int, int]] = {}
        self.stats = {"words": 0, "new": 0, "merged": 0}
        self._forget()

    def _forget(self) -> None:
        self.known, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes of words, sorted, and their places
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.counts = np.zeros(1 << 14, np.int32)

    def _spines(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        """For each token its edge pieces from the byte up to itself, with the rank that makes the next one."""
        rank = np.full(self.size, -1, np.int64)
        some, at = np.unique(made, return_index=True)  # of several rules for a token, the first
        rank[some] = at
        first, last = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        first[some], last[some] = left[at], right[at]

        def edges(down: np.ndarray):
            piece, absorbed = [np.arange(self.size)], [np.full(self.size, NEVER)]
            while (down[piece[-1]] >= 0).any():
                deeper = down[piece[-1]]
                absorbed.append(np.where(deeper >= 0, rank[piece[-1]], absorbed[-1]))
                piece.append(np.where(deeper >= 0, deeper, piece[-1]))
            # from the byte up: a token that is reached in fewer steps ends earlier
            piece, absorbed = np.array(piece[::-1], np.int32).T, np.array(absorbed[::-1], np.int32).T
            depth = (piece != piece[:, :1]).sum(1)
            shift = np.minimum(np.arange(piece.shape[1]) + (piece.shape[1] - 1 - depth)[:, None], piece.shape[1] - 1)
            return np.ascontiguousarray(np.take_along_axis(piece, shift, 1)), np.ascontiguousarray(np.take_along_axis(absorbed, shift, 1))

        self.right_piece, self.right_until = edges(last)
        self.left_piece, self.left_until = edges(first)

    def _plain(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Which tokens encode to themselves: both parts do, and the first pair that merges across them is the parts."""
        some, at = np.unique(made, return_index=True)
        apart, whole = self.compatible(left[at], right[at])
        ok = np.zeros(self.size, bool)
        ok[self.byte_ids] = True
        for r in np.argsort(at, kind="stable").tolist():
            t = at[r]
            ok[some[r]] = not apart[r] and whole[r] and ok[left[t]] and ok[right[t]]
        return ok

    def rule(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index into keys of the merge rule of each pair, or -1."""
        want = a * np.int64(self.size) + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, at, -1)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair of tokens stays apart when the text of both is encoded; and if not, whether it is the
        tokens as a whole that merge."""
        n = len(a)
        ok, whole, i, j = np.ones(n, bool), np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.arange(n)
        while len(live):
            x, y = self.right_piece[a[live], i[live]].astype(np.int64), self.left_piece[b[live], j[live]].astype(np.int64)
            x_until, y_until = self.right_until[a[live], i[live]], self.left_until[b[live], j[live]]
            at = self.rule(x, y)
            rank = np.where(at >= 0, self.ranks[at], NEVER + 1)
            merges = (rank < x_until) & (rank <= y_until)
            top = np.minimum(x_until, y_until) >= NEVER
            ok[live[merges]], whole[live[merges & top]] = False, True
            up_x = x_until <= y_until
            i[live[up_x]] += 1
            j[live[~up_x]] += 1
            live = live[~(merges | top)]
        return ok, whole

    def _checked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible(), each distinct pair once; verdicts are kept."""
        keys, inverse = np.unique(a * np.int64(self.size) + b, return_inverse=True)
        if len(self.pairs) + len(keys) > CACHE_PAIRS:
            self.pairs, self.apart = self.pairs[:0], self.apart[:0]
        at = np.searchsorted(self.pairs, keys)
        fresh = np.ones(len(keys), bool)
        inside = at < len(self.pairs)
        fresh[inside] = self.pairs[at[inside]] != keys[inside]
        if fresh.any():
            k = keys[fresh]
            self.apart = np.insert(self.apart, at[fresh], self.compatible(k // self.size, k % self.size)[0])
            self.pairs = np.insert(self.pairs, at[fresh], k)
            at = np.searchsorted(self.pairs, keys)
        return self.apart[at][inverse]

    def merge_long(self, word: bytes) -> list[int]:
        """merge() of one word in n log n steps: a heap of the pairs by rank, then from the left."""
        if not self.rules:
            self.rules = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist())))
        ids, size = self.byte_ids[np.frombuffer(word, np.uint8)].tolist(), self.size
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rule[0], i, ids[i], ids[i + 1], rule[1]) for i in range(n - 1) if (rule := self.rules.get(ids[i] * size + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two is gone
            ids[i], ids[j] = made, -1
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                if rule := self.rules.get(made * size + ids[k]):
                    heapq.heappush(heap, (rule[0], i, made, ids[k], rule[1]))
            if h >= 0 and (rule := self.rules.get(ids[h] * size + made)):
                heapq.heappush(heap, (rule[0], h, ids[h], made, rule[1]))
        return [t for t in ids if t >= 0]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words at once: each round merges, in every word, its lowest-ranked leftmost pair."""
        counts = np.array([len(w) for w in words], np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), counts)
        done_ids, done_word, done_pos = [], [], []
        while len(ids):
            best = np.full(len(ids), NEVER, np.int64)
            at = np.full(len(ids), -1, np.int64)
            inner = np.flatnonzero(word[1:] == word[:-1])
            at[inner] = self.rule(ids[inner], ids[inner + 1])
            hit = at >= 0
            best[hit] = self.ranks[at[hit]]
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(best, begins)
            lengths = np.diff(np.append(begins, len(ids)))
            still = np.repeat(least < NEVER, lengths)
            done_ids.append(ids[~still])
            done_word.append(word[~still])
            chosen = still & (best == np.repeat(least, lengths))
            spots = np.flatnonzero(chosen)
            w = word[spots]
            spots = spots[np.append(True, w[1:] != w[:-1])] if len(spots) else spots
            ids = ids.copy()
            ids[spots] = self.made[at[spots]]
            keep = still.copy()
            keep[spots + 1] = False
            ids, word = ids[keep], word[keep]
        all_word = np.concatenate([np.zeros(0, np.int64), *done_word])
        order = np.argsort(all_word, kind="stable")
        return np.concatenate([np.zeros(0, np.int64), *done_ids])[order], np.bincount(all_word, minlength=len(words))

    def exact(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        long = [k for k, w in enumerate(words) if len(w) > LONG]
        if not long:
            return self.merge(words)
        ids, counts = self.merge([w if len(w) <= LONG else b"" for w in words])
        parts, at = np.split(ids, np.cumsum(counts)[:-1]), np.asarray(counts).copy()
        for k in long:
            parts[k] = np.array(self.merge_long(words[k]), np.int64)
            at[k] = len(parts[k])
        return np.concatenate(parts), at

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        gap = "Ā"  # no byte's character, so no match crosses a border
        found = list(self.longest.iter_long(gap.join(r.decode("latin-1") for r in raw)))
        ends = np.fromiter((e for e, _ in found), np.int64, len(found))
        ids = np.fromiter((i for _, i in found), np.int64, len(found))
        bounds = A.offsets(sizes + 1)
        word = np.searchsorted(bounds, ends, side="right") - 1
        counts = np.bincount(word, minlength=len(words))
        failed = np.bincount(word, weights=self.byte_counts[ids], minlength=len(words)) != sizes
        inner = np.flatnonzero(word[1:] == word[:-1])
        if len(inner):
            wrong = inner[~self._checked(ids[inner], ids[inner + 1])]
            failed[word[wrong]] = True
        self.stats["new"] += len(words)
        if failed.any():
            which = np.flatnonzero(failed)
            self.stats["merged"] += len(which)
            exact_ids, exact_counts = self.exact([raw[k] for k in which])
            stay = ~failed[word]
            word = np.concatenate([word[stay], np.repeat(which, exact_counts)])
            ids = np.concatenate([ids[stay], exact_ids])
            order = np.argsort(word, kind="stable")
            ids, counts = ids[order], np.bincount(word, minlength=len(words))
        return ids.astype(np.int32), counts

    def pieces(self, cps: np.ndarray, doc_offsets: np.ndarray) -> np.ndarray:
        """Starts of the words of the byte-level pattern, vectorised over all documents."""
        n = len(cps)
        cls = A.classes()[cps]
        starts = A.run_starts(cls, doc_offsets)
        runs = np.flatnonzero(starts)
        begins_doc = np.zeros(n + 1, bool)
        begins_doc[doc_offsets] = True
        out = starts.copy()
        # white space before a word: its last character stands apart, and a plain space belongs to the word
        after = runs[(runs > 0) & (cls[runs] != A.SPACE) & ~begins_doc[runs]]
        after = after[cls[after - 1] == A.SPACE]
        out[after - 1] = True
        spaced = after[cps[after - 1] == 0x20]
        out[spaced] = False
        # an apostrophe that begins a word takes a contraction with it
        for q in np.flatnonzero(starts & (cps == 0x27)) if (cps == 0x27).any() else ():
            if not out[q]:
                continue
            for tail in CONTRACTIONS:
                e = q + 1 + len(tail)
                if e <= n and not begins_doc[q + 1 : e].any() and all(cps[q + 1 + k] == ord(c) for k, c in enumerate(tail)):
                    out[q + 1] = False
                    if e < n:
                        out[e] = True if not (cls[e] != A.SPACE and starts[e] and not out[e]) else out[e]
                    break
        return np.flatnonzero(out)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (int32), and how many each text has."""
        marked = [k for k, t in enumerate(texts) if any(s in t for s in self.special)] if self.special else []
        if not marked:
            return self._encode(texts)
        parts, owner = [], []
        specials = sorted(self.special, key=len, reverse=True)
        for k, t in enumerate(texts):
            for p in self._split(t, specials):
                parts.append(p)
                owner.append(k)
        plain = [p if isinstance(p, str) else "" for p in parts]
        ids, counts = self._encode(plain)
        where = A.offsets(counts)
        out = [ids[where[k] : where[k + 1]] if isinstance(p, str) else np.array([p], np.int32) for k, p in enumerate(parts)]
        lengths = np.bincount(owner, weights=[len(x) for x in out], minlength=len(texts)).astype(np.int64)
        return np.concatenate(out) if out else ids, lengths

    def _split(self, text: str, specials: list[str]):
        """Plain parts of a text as strings, special tokens as ids."""
        at = 0
        while True:
            hits = [(p, s) for s in specials if (p := text.find(s, at)) >= 0]
            if not hits:
                yield text[at:]
                return
            p, s = min(hits, key=lambda x: x[0])
            yield text[at:p]
            yield self.special[s]
            at = p + len(s)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        for lo, hi in A.chunks(texts):
            out, n = self._encode_chunk(texts[lo:hi])
            ids.append(out)
            counts[lo:hi] = n
        return np.concatenate(ids), counts

    def _encode_chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        doc = A.offsets([len(t) for t in texts])
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        cps = A.code_points(joined)
        starts = self.pieces(cps, doc)
        ends = np.append(starts[1:], len(cps))
        hashes = A.segment_hashes(cps, starts, ends)
        uniq, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        self.stats["words"] += len(starts)
        if len(self.known) + len(uniq) > self.cache_words:
            self._forget()
        at = np.searchsorted(self.known, uniq)
        new = np.ones(len(uniq), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != uniq[inside]
        if new.any():
            spots = first[new]
            slots = self._learn([joined[s:e] for s, e in zip(starts[spots].tolist(), ends[spots].tolist())])
            self.slots, self.known = np.insert(self.slots, at[new], slots), np.insert(self.known, at[new], uniq[new])
            at = np.searchsorted(self.known, uniq)
        slots = self.slots[at]
        word = slots[inverse]
        lengths = self.counts[word]
        ids = self.flat[A.ragged(self.starts[word], lengths)]
        upto = A.offsets(lengths)
        return ids, np.diff(upto[np.searchsorted(starts, doc)])

    def _learn(self, words: list[str]) -> np.ndarray:
        ids, counts = self.encode_words(words)
        base, first = len(self.known), self.used
        slots = np.arange(base, base + len(words), dtype=np.int32)
        while first + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while base + len(words) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.flat[first : first + len(ids)] = ids
        self.used = first + len(ids)
        self.starts[slots], self.counts[slots] = first + A.offsets(counts)[:-1], counts
        return slots

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of each text; bytes that are no valid UTF-8 become U+FFFD, as in the library."""
        lengths = self.byte_counts[ids]
        if len(ids) and lengths.max() > WIDE:
            blob = self.flat_bytes[A.ragged(self.byte_starts[ids], lengths)].tobytes()
        else:
            blob = self.wide_bytes[ids][self.wide_used[ids]].tobytes()
        ends = A.offsets(lengths)[A.offsets(counts)].tolist()
        out = [blob[s:e] for s, e in zip(ends, ends[1:])]
        try:
            blob.decode("utf-8")
        except UnicodeDecodeError:
            out = [b.decode("utf-8", "replace").encode() for b in out]
        return out


_CODECS: dict[str, BpeCodec] = {}


def codec(spec: bytes) -> BpeCodec:
    """One codec per worker and vocabulary; worker processes are reused by many tasks."""
    key = hashlib.md5(spec).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = BpeCodec(spec)
    return _CODECS[key]


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tokens: bool = False) -> DataFrame:
    """One row per document: its id, n_tokens, digests of ids and of the decoded text; with tokens=True also the ids.

    tokenizer: path of a byte-level BPE file of the tokenizers library, read on the driver; its content (some MB,
    bounded by the vocabulary) is broadcast. One pass, no shuffle.
    """
    bounded_batches(docs.sparkSession)
    with open(tokenizer, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * tokens

    def run(batches):
        c = codec(spec.value)
        for batch in batches:
            A.release()
            texts = texts_of(batch, text_col)
            for lo, hi in A.chunks(texts, 2_000_000):
                ids, counts = c.encode(texts[lo:hi])
                back = c.decode(ids, counts)
                raw, at = memoryview(ids.astype("<u4").tobytes()), (A.offsets(counts) * 4).tolist()
                out = {
                    id_col: batch.column(id_col).slice(lo, hi - lo),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(raw[s:e]).hexdigest() for s, e in zip(at, at[1:])], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
                }
                if tokens:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(A.offsets(counts).astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
