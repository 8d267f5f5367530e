"""Fill-in-middle, collocations and substring dedup against brute force, on small random texts and edge cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tabweave.llm import collocations as C
from tabweave.llm import fill_middle, substring_dedup
from tabweave.llm.queries import ORACLES, QUERIES
from tabweave.llm.wordbytes import byte_table, gram_hashes, sliding_min, word_slices

DOCS = "doc_id bigint, text string"
UNITS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "characters": r"(?s)."}
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_collocations", "op13_substring_dedup"])
def test_queries_against_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()
    rows = lambda df: sorted(repr([None if v != v else int(v) if isinstance(v, float) else v for v in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert rows(got) == rows(want) and (len(got) or name == "op12_collocations")


# words as bytes


def test_word_slices():
    rnd, gap = random.Random(2), byte_table(" \t\n\x0b\x0c\r")
    for _ in range(400):
        texts = ["".join(rnd.choice(["a", "B", " ", "\n", "é", ".", "\t"]) for _ in range(rnd.randint(0, 30))) if rnd.random() > 0.1 else None for _ in range(rnd.randint(0, 5))]
        for most in (4, 10, 1000):
            got = [(first + int(d), s) for w, first in word_slices(pa.array(texts, pa.string()), gap, most=most) for s, d in zip(w.strings().to_pylist(), w.doc)]
            assert got == [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
            pieces = [[]]
            for w, _ in word_slices(pa.array(texts, pa.string()), byte_table(" \t"), byte_table(".\n"), True, most):
                for s, b in zip(w.strings().to_pylist(), w.broken):
                    pieces += [[]] if b else []
                    pieces[-1].append(s)
            lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
            assert [p for p in pieces if p] == [w for t in texts for p in re.split(r"[.\n]", lower(t or "")) if (w := re.findall(r"[^ \t]+", p))]


def test_gram_hashes_and_least():
    h = np.random.default_rng(1).integers(0, 3, 200).astype(np.uint64)
    for n in (1, 2, 3, 5, 7, 10, 20):
        g = gram_hashes(h, n)
        assert len(g) == 201 - n and len(set(g.tolist())) == len({tuple(h[i : i + n]) for i in range(201 - n)})
        assert sliding_min(h, n).tolist() == [h[i : i + n].min() for i in range(201 - n)]
        assert not len(gram_hashes(h[: n - 1], n)) and not len(sliding_min(h[: n - 1], n))


# op11


def test_ranks_and_round_trip():
    rnd = random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choice(["a", "b", " ", "\n", "é", "\t", "<", "P", ">", "<S>", "🙂"]) for _ in range(rnd.randint(0, 12)))
        for unit, pattern in UNITS.items():
            ends, marks = fill_middle.EventScan(unit).events(text)
            ranks, want = fill_middle.UnitRanks(unit, ends, len(text)), re.findall(pattern, text)
            assert ranks.count == len(want) and bool(marks) == ("<S>" in text or "<P>" in text)
            assert [ranks.end_of(k) for k in range(len(want) + 1)] == [len("".join(want[:k])) for k in range(len(want) + 1)]
            own = fill_middle.FillMiddle(unit, rate=80)
            n, form, a, b, out = own.transform(text, len(text))
            assert own.restore(out, form) == text and n == len(want) and (form == "plain") == (a is None)


def test_restore_where_pieces_end_like_sentinels():
    own = fill_middle.FillMiddle("characters")
    for text in ("<<", "<S<S", "<P<M", "><S", "P>S>M>", "<<<<<<<<"):
        for key in range(200):
            n, form, a, b, out = own.transform(text, key)
            assert form in ("psm", "spm") and own.restore(out, form) == text


def test_fill_middle_edges(spark):
    texts = [None, "", "\n", "no end", "a\nb\n", "a<M>b\n", "x\n" * 50_000, "é\n🙂\n\n"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, "a\nb\n"), (None, "a\nb\n")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, form string")
    out = fill_middle.fill_in_middle(df, texts=True).collect()
    assert len(out) == len(rows)
    for r in out:
        text = (texts[r.doc_id] if r.doc_id is not None else "a\nb\n") or ""
        units = re.findall(UNITS["lines"], text)
        h = hashlib.sha256(f"7:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        g = [int(h[i : i + 8], 16) for i in (0, 8, 24)]
        a, b = sorted(x % (len(units) + 1) for x in g[:2])
        p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
        form = "plain" if not text or "<M>" in text else "spm" if g[2] % 100 < 50 else "psm"
        want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r.n, r.form, r.output) == (len(units), form, want)
        assert (r.output_sha256, r.restored_sha256) == (sha(want), sha(text))
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if form == "plain" else (len(p), len(m)))
    assert fill_middle.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0
    assert {r.form for r in fill_middle.fill_in_middle(df, rate=0).collect()} == {"plain"}
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(df, unit="pages")


# op12


def brute_phrases(rows, least, longest, inside, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in cand.items():
        longer = max((b for (x, q), b in cand.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))), default=0)
        if longer and 100 * longer >= inside * a:
            continue
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, le, r) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize("longest,least,shard", [(3, 10, 8_000_000), (3, 2, 64), (2, 3, 500), (5, 2, 300)])
def test_collocations_against_brute_force(spark, longest, least, shard):
    rnd = random.Random(longest * 100 + least)
    words = ["the", "The", "of", "é", "cat", "sat", "mat", "ab", "zz9", *(f"w{i}" for i in range(40))]
    weights = [30, 5, 20, 3, 8, 8, 8, 5, 2, *[1] * 40]
    gaps = [" "] * 8 + ["  ", ". ", ",", "\n", "\t", "\x0b"]
    rows = [(rnd.choice(["en", "fr", None]), "".join(w + rnd.choice(gaps) for w in rnd.choices(words, weights, k=rnd.randint(0, 60)))) for _ in range(80)]
    rows += [("en", None), (None, ""), ("en", "a b a b a b a b a b " * 30), ("fr", "x " * 200), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, "c") for r in rows], "lang string, text string, phrase string").repartition(3)
    got = C.collocations(df, least=least, longest=longest, top=60, shard_bytes=shard)
    assert got.dtypes == [("lang", "string"), *((c, "bigint" if c != "phrase" else "string") for c in ("rank", "phrase", "a", "l", "r", "n", "score"))]
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, least, longest, 50, 60)


def test_collocations_of_empty_tables(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(empty).count() == 0
    assert C.collocations(spark.createDataFrame([("en", None), (None, " .")], "lang string, text string")).count() == 0


def test_scores_need_more_than_64_bits(spark):
    """Counts whose products pass 64 bits are divided exactly."""
    df = spark.createDataFrame([(3_000_000_019, 3_000_000_019, 3_000_000_021)], "a bigint, l bigint, r bigint")
    wide = lambda c: df[c].cast("decimal(19,0)")
    from pyspark.sql import functions as F

    top = (F.lit(C.SCALE).cast("decimal(7,0)") * wide("a")).cast("decimal(38,0)") * wide("a")
    got = df.select(top.alias("top"), (wide("l") * wide("r")).cast("decimal(38,0)").alias("under")).select(F.expr("cast(top as decimal(38,0)) div under")).collect()[0][0]
    assert got == 10**6 * 3_000_000_019**2 // (3_000_000_019 * 3_000_000_021)


def test_bitmaps_of_both_kinds():
    rng = np.random.default_rng(5)
    at = np.where(rng.random(4000) < 0.05, -1, rng.zipf(1.5, 4000) % 300)
    at[-1] = -1
    maps = C.PositionBitmaps(at, 300)
    assert len(maps.dense) and len(maps.sparse)
    for length in (2, 3, 4):
        want = collections.Counter(tuple(w) for i in range(4001 - length) if (w := at[i : i + length].tolist()) and min(w) >= 0)
        got = maps.phrases(length, lambda p: np.ones(len(p), bool))
        assert {tuple(p): int(c) for ps, cs in got for p, c in zip(ps.tolist(), cs)} == want
        assert sum(len(c) for _, c in got) == len(want)


# op13


def brute_spans(rows, words):
    first = {}
    for i, (key, text) in enumerate(rows):
        w = (text or "").encode().split()
        for s in range(len(w) - words + 1):
            first.setdefault(tuple(w[s : s + words]), []).append((key is None, key or 0, i, s))
    out = []
    for i, (key, text) in enumerate(rows):
        w, gone = (text or "").encode().split(), set()
        for s in range(len(w) - words + 1):
            if any((none, k) < (key is None, key or 0) or (j == i and t < s) for none, k, j, t in first[tuple(w[s : s + words])]):
                gone |= set(range(s, s + words))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((key, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("words,anchor,block,hot", [(20, 10, 1_000_000, None), (4, 2, 12, None), (3, 3, 7, 1), (5, 1, 40, 0), (1, 1, 9, 2)])
def test_substring_dedup_against_brute_force(spark, monkeypatch, words, anchor, block, hot):
    if hot is not None:
        monkeypatch.setattr(substring_dedup, "LEAST_HOT", hot)
    rnd = random.Random(words)
    own = lambda n: [rnd.choice("abcdefgh") + rnd.choice(["", "x", "é", "12"]) for _ in range(n)]
    shared = [own(rnd.randint(3, 60)) for _ in range(6)]
    rows = []
    for i in range(70):
        parts = [rnd.choice(shared)[rnd.randint(0, 2) :] if rnd.random() < 0.5 else own(rnd.randint(0, 30)) for _ in range(rnd.randint(0, 5))]
        rows.append((rnd.choice([i, i, i, 7, None]), rnd.choice([" ", "\n", "  ", "\t"]).join(w for p in parts for w in p)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "a b " * 60), (504, "q " * 45), (505, "q " * 45), (505, "q " * 45), rows[3], rows[3]]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, mark int").repartition(5)
    df.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/docs{words}-{anchor}")
    got = substring_dedup.substring_dedup(spark.read.parquet(path), words=words, anchor=anchor, block_words=block).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_spans(rows, words)


def test_drop_repeats_keeps_columns_and_untouched_texts(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, f"one\n {passage}", "s"), (2, f"two  {passage} tail", None), (3, "left  as\tit is", "s"), (4, None, "s")]
    df = spark.createDataFrame(rows, "doc_id int, text string, spans string")
    got = {r.doc_id: r for r in substring_dedup.drop_repeats(df).collect()}
    assert [got[i].text for i in (1, 2, 3, 4)] == [rows[0][1], "two tail", "left  as\tit is", None]
    assert got[2].spans is None and substring_dedup.drop_repeats(df).columns == df.columns
    empty = spark.createDataFrame([], DOCS)
    assert substring_dedup.substring_dedup(empty).count() == 0 and substring_dedup.drop_repeats(empty).count() == 0


def test_factors_are_greedy_and_whole():
    """A copied document is one factor; a factor's end is looked up, so a window over it is found as well."""
    rng = np.random.default_rng(3)
    a, b, c = (rng.integers(0, 2**60, n).astype(np.uint64) for n in (100, 80, 50))
    h = np.concatenate([a, b, a, a[50:80], b[40:70], c])
    doc = np.repeat(np.arange(6), [100, 80, 100, 30, 30, 50])
    block = substring_dedup.ReferenceBlock(h, doc, np.arange(6), 20, 10)
    first, windows = block.factors()
    assert [(int(doc[block.starts[f]]), int(n)) for f, n in zip(first, windows)] == [(2, 81), (3, 11), (4, 11)]
    assert (block.source[block.starts < 161] < 0).all()


def test_very_long_text_is_cut_into_parts(spark):
    rnd = random.Random(8)
    words = [f"w{rnd.randrange(50_000)}" for _ in range(30_000)]
    text = " ".join(words + words[100:4000])
    df = spark.createDataFrame([(1, text), (2, " ".join(words[:300]))], DOCS)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(df, block_words=1000).collect()}
    assert got == {1: (33_900, 3900), 2: (300, 300)}


def test_sorted_segments_in_small_batches(monkeypatch):
    """Segments of a key are factored together, however batches fall."""
    rng = np.random.default_rng(4)
    rows = sorted((int(k), int(d), 0, int(s), 1, np.uint64(w).tobytes()) for k, d, s, w in zip(rng.integers(0, 9, 300), rng.integers(0, 20, 300), rng.permutation(300), rng.integers(0, 12, 300)))
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("hashes", pa.binary())])
    seen, want = {}, set()
    for k, d, _, s, _, w in rows:
        if (k, w) in seen:
            first, own = seen[k, w]
            if first < d or d in own:
                want.add((d, s))
            own.add(d)
        else:
            seen[k, w] = (d, {d})
    for most in (1, 7, 100_000):
        monkeypatch.setattr(substring_dedup, "SPLIT_TASK_ROWS", most)
        batches = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema).to_batches(max_chunksize=11)
        got = [r for b in substring_dedup.factored_segments(batches) for r in b.to_pylist()]
        assert {(r["doc_id"], r["start"] + i) for r in got for i in range(r["windows"])} == want
